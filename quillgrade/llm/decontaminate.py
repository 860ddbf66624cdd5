"""Benchmark decontamination over a distributed positional inverted index.

The index holds the postings (term, position) of every word of every training text,
whatever the test set: a table partitioned by documents, whose rows are shards, each a run
of documents with its terms in order, how often each stands there, and their places. It is
written to the shared folder once and searched for any number of test sets. Terms are
64-bit keys of words.

Test items are cut into windows. A shard drops windows with a term it lacks, takes
the shortest posting list of each other window, shifts it by the term's offset to
candidate starts, and intersects these with the shifted lists of the other terms,
rarest first. What remains inside one document are exact phrase matches. With ``slop``
over 0, the terms have to occur in order with at most that many other words among them.

The test set goes to the executors in blocks of bounded size, of which a single longer
text is one; more blocks mean more passes over the index. Null and empty texts have no
words and no matches; without documents there are no rows. A
null item id is written as "null"; rows with one item id count as one item, and copies
of an item are searched once. Repeated documents each get their row. A text of any
length is worked on whole. Keys are whole numbers. Columns besides key and text aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrade.llm.common import chunks, fresh, gather, materialise, sent_if_small, sliced, utf8
from quillgrade.llm.flatwords import unit_keys

#: Bytes that aren't part of words become spaces, A-Z become a-z.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SHARD_BYTES = 1_500_000
BLOCK_BYTES = 8_000_000
WINDOW = 13
WINDOWS_AT_ONCE = 100_000


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words, and the number of words of each text."""
    data = np.frombuffer((b" ".join(texts) + b" ").translate(WORD_BYTES), dtype=np.uint8)
    space = data == 32
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    counts = np.diff(np.r_[0, np.searchsorted(start, ends)])
    return unit_keys(data, start, space) if len(start) else np.zeros(0, np.uint64), counts


class TestSet:
    """Windows of the test items, over ids of their words; ``vocab`` holds the words' keys in order."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        keys, counts = word_keys([(text or "").encode() for _, text in items])
        self.vocab, self.flat = np.unique(keys, return_inverse=True)
        starts: list[int] = []
        lens: list[int] = []
        owners: list[int] = []
        names: dict[str, int] = {}
        for (name, _), words, at in zip(items, counts.tolist(), (np.cumsum(counts) - counts).tolist()):
            if not words:
                continue
            owner = names.setdefault("null" if name is None else name, len(names))
            n = min(window, words)
            k = words - n + 1
            starts += range(at, at + k)
            lens += [n] * k
            owners += [owner] * k
        self.names = np.array(list(names), dtype=object)
        self.starts, self.lens, self.owners = (np.array(x, dtype=np.int64) for x in (starts, lens, owners))
        self.lengths = sorted(set(lens))

    def postings(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and places of the test set's words in a shard, sorted by both."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(terms, self.vocab), len(terms) - 1)
        have = np.flatnonzero(terms[at] == self.vocab)
        n = counts[at[have]].astype(np.int64)
        first = (np.cumsum(counts, dtype=np.int64) - counts)[at[have]]
        return np.repeat(have, n), places[gather(first, n)].astype(np.int64)

    def matches(self, terms: np.ndarray, positions: np.ndarray, slop: int):
        """Window, first and last position of each match in postings sorted by (term, position)."""
        found = []
        if len(terms):
            span = np.int64(positions.max()) + 2 + WINDOW + slop
            postings = terms.astype(np.int64) * span + positions
            upto = np.searchsorted(terms, np.arange(len(self.vocab) + 1))
            count = np.diff(upto)
            for n in self.lengths:
                own = np.flatnonzero(self.lens == n)
                for a in range(0, len(own), WINDOWS_AT_ONCE):
                    w = own[a : a + WINDOWS_AT_ONCE]
                    t = self.flat[self.starts[w][:, None] + np.arange(n)]
                    sizes = count[t]
                    live = sizes.min(axis=1) > 0
                    w, t, sizes = w[live], t[live], sizes[live]
                    if len(w):
                        found.append((self._near if slop else self._exact)(w, t, sizes, upto, positions, postings, span, slop))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def _exact(self, w, t, sizes, upto, positions, postings, span, slop):
        order = np.argsort(sizes, axis=1, kind="stable")
        row = np.arange(len(w))
        term, n = t[row, order[:, 0]], sizes[row, order[:, 0]]
        start = positions[gather(upto[term], n)] - np.repeat(order[:, 0], n)
        of = np.repeat(row, n)
        of, start = of[start >= 0], start[start >= 0]
        for k in range(1, t.shape[1]):
            want = t[of, order[of, k]] * span + start + order[of, k]
            at = np.minimum(np.searchsorted(postings, want), len(postings) - 1)
            hit = postings[at] == want
            of, start = of[hit], start[hit]
        return w[of], start, start + t.shape[1] - 1

    def _near(self, w, t, sizes, upto, positions, postings, span, slop):
        first, n = t[:, 0], sizes[:, 0]
        start = positions[gather(upto[first], n)]
        of, at = np.repeat(np.arange(len(w)), n), start.copy()
        for k in range(1, t.shape[1]):
            term = t[of, k]
            i = np.searchsorted(postings, term * span + at, side="right")
            ok = i < upto[term + 1]
            of, start, i = of[ok], start[ok], i[ok]
            at = positions[i]
        ok = at - start + 1 <= t.shape[1] + slop
        return w[of[ok]], start[ok], at[ok]


INDEX = "row long, keys array<long>, hashes array<long>, words array<long>, terms binary, counts binary, places binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards: documents (key, text hash, number of words) and the postings of all their words.

    ``terms`` (64-bit) are in order, ``counts`` (32-bit) says how many of the ``places``
    (32-bit, from the shard's first word on, in order) belong to each. ``row`` numbers the
    first document of the shard.
    """

    def run(batches):
        row = np.int64(TaskContext.get().partitionId()) << 33
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(2))]
            for a, b in chunks([len(t) for t in texts], SHARD_BYTES):
                keys, words = word_keys(texts[a:b])
                order = np.argsort(keys, kind="stable").astype(np.uint32)
                keys = keys[order]
                head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
                listed = lambda x: pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), x)  # noqa: B023, E731
                made = {"row": pa.array([int(row)], pa.int64()), "keys": listed(batch.column(0).slice(a, b - a)), "hashes": listed(batch.column(1).slice(a, b - a)), "words": listed(pa.array(words, pa.int64()))}
                blobs = {"terms": keys[head], "counts": np.diff(np.r_[head, len(keys)]).astype(np.uint32), "places": order}
                yield pa.RecordBatch.from_pydict(made | {k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()})
                row += b - a

    return docs.select(F.col(key).cast("long"), F.xxhash64(text), F.col(text)).mapInArrow(run, INDEX)


def search_index(index: DataFrame, tests, slop: int = 0) -> DataFrame:
    """A row each document: words, the disjoint spans [first, last] of matches, and the matching items sorted. ``tests`` is a broadcast TestSet."""

    def run(batches):
        found: TestSet = tests.value
        for batch in batches:
            for i in range(batch.num_rows):
                keys, hashes, words = (batch.column(c)[i].values for c in range(1, 4))
                terms, sizes, places = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((4, np.uint64), (5, np.uint32), (6, np.uint32)))
                counts = words.to_numpy(zero_copy_only=False)
                ends = np.cumsum(counts)
                bases = ends - counts
                w, first, last = found.matches(*found.postings(terms, sizes, places), slop)
                n = len(counts)
                doc = np.searchsorted(ends, first, side="right")
                inside = last < ends[doc] if len(doc) else np.zeros(0, bool)
                w, first, last, doc = w[inside], first[inside], last[inside], doc[inside]
                order = np.lexsort((first, doc))
                doc_s, first_s, last_s = doc[order], first[order], last[order]
                # spans of a document that meet or overlap become one
                reach = np.maximum.accumulate(last_s) if len(last_s) else last_s
                head = np.flatnonzero(np.r_[True, (first_s[1:] > reach[:-1] + 1) | (doc_s[1:] != doc_s[:-1])]) if len(first_s) else np.zeros(0, np.int64)
                tail = np.r_[head[1:], len(first_s)] - 1
                spans_doc = doc_s[head]
                cut = np.searchsorted(spans_doc, np.arange(n + 1))
                offset = bases[spans_doc] if len(head) else np.zeros(0, np.int64)
                pairs = np.unique(doc * max(1, len(found.names)) + found.owners[w]) if len(w) else np.zeros(0, np.int64)
                items: list[list[str]] = [[] for _ in range(n)]
                for d, o in zip((pairs // max(1, len(found.names))).tolist(), (pairs % max(1, len(found.names))).tolist()):
                    items[d].append(found.names[o])
                listed = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64()))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(batch.column(0)[i].as_py() + np.arange(n)),
                        "key": keys,
                        "text_hash": hashes,
                        "n_words": words,
                        "span_from": listed(first_s[head] - offset),
                        "span_to": listed(reach[tail] - offset if len(head) else reach[:0]),
                        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    }
                )

    return index.mapInArrow(run, "row long, key long, text_hash long, n_words long, span_from array<long>, span_to array<long>, items array<string>")


def _joined(firsts: pd.Series, lasts: pd.Series, items: pd.Series) -> pd.DataFrame:
    """Union of the spans and items that the blocks of a test set found."""
    hits, names = [], []
    for f, e, i in zip(firsts, lasts, items):
        spans = sorted((a, b) for x, y in zip(f, e) for a, b in zip(x, y))
        n, upto = 0, -1
        for a, b in spans:
            n += max(0, b - max(a, upto + 1) + 1)
            upto = max(upto, b)
        hits.append(n)
        names.append(sorted({s for x in i for s in x}))
    return pd.DataFrame({"n_hit": hits, "items": names})


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """Per document: key, text_hash, n_words, n_hit, items (sorted array) and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.col("text").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    index = materialise(build_index(docs, key, text), "index", "none")  # keys and places don't compress
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        tests = spark.sparkContext.broadcast(TestSet([(r[0], r[1]) for r in part.toLocalIterator()]))
        found.append(materialise(search_index(index, tests, slop), f"found-{b}"))  # rows of the index are large, so batches are bounded
    if blocks == 1:
        n_hit = F.aggregate(F.zip_with("span_to", "span_from", lambda a, b: a - b + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        out = found[0].select("key", "text_hash", "n_words", n_hit.alias("n_hit"), "items")
    else:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        every = every.groupBy("row").agg(*[F.first(c).alias(c) for c in ("key", "text_hash", "n_words")], F.collect_list(F.when(F.size("items") > 0, F.struct("span_from", "span_to", "items"))).alias("found"))
        joined = every.withColumn("j", F.pandas_udf(_joined, "struct<n_hit:long,items:array<string>>")("found.span_from", "found.span_to", "found.items"))
        out = joined.select("key", "text_hash", "n_words", "j.n_hit", "j.items")
    flag = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", flag).withColumnRenamed("key", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    k, h = fresh(docs, "bad_key"), fresh(docs, "bad_hash")
    bad = contamination(docs, benchmark, key, text).where("contaminated").select(F.col(key).alias(k), F.col("text_hash").alias(h)).distinct()
    bad = sent_if_small(materialise(bad, "contaminated"))
    return docs.join(bad, docs[key].cast("long").eqNullSafe(bad[k]) & (F.xxhash64(docs[text]) == bad[h]), "left_anti")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        "contaminated",
    )
