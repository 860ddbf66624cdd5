"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become term vectors: hashed words, word shapes (case, digits, symbols,
punctuation, length), pairs of neighbouring shapes, marks for words that repeat
the word before or a word of the text, and how often words repeat on average. Terms are weighted by inverse document
frequency and projected on the leading singular directions of the labelled rows.
The labelled vectors go to every executor, exact cosine products with all of them
are computed in blocks, and the nearest vote with their similarity.

The fit uses at most ``most`` labelled rows, those with the least hash of their id;
document frequencies are counted over all documents, and scores cover every row. A null text counts as empty; a text without words has no
direction and gets the labelled rows' mean. Rows without a label, or with a null
one, don't vote; a document labelled twice votes twice. Repeated rows score alike, a
text of any length is worked on whole, an empty table gives no rows, and a column
that stands under the score's name is replaced. Label, language, source and
id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrade.llm.common import bounded_batches, chunks, fresh, sum_arrays, sliced, utf8
from quillgrade.llm.flatwords import unit_keys

WORD_TERMS = 2048
SHAPES = 64
PAIR_TERMS = 1024
REPEAT_STEPS = 16
TERMS = WORD_TERMS + SHAPES + PAIR_TERMS + 3 + REPEAT_STEPS
MOST_LABELLED = 4000
DIRECTIONS = 48
NEIGHBOURS = 15
CHUNK_BYTES = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!@=_~^\\/{}[]"]] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[ord(c) for c in ".,;:?\"'()-"]] = True


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows, terms and shares: each text's terms with their share of its words."""
    raw = b" ".join(texts) + b" "
    data = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    keys = unit_keys(data, start, space)
    upto = lambda t: np.r_[0, np.cumsum(t[data], dtype=np.int32)]
    of = lambda t: (lambda c: c[end] - c[start])(upto(t))
    n = end - start
    upper, lower, digit, symbol, point = of(_UPPER), of(_LOWER), of(_DIGIT), of(_SYMBOL), of(_POINT)
    case = np.where(upper == 0, 0, np.where((upper > 1) & (lower == 0), 2, 1))
    mark = np.where(symbol == n, 3, np.where(symbol > 1, 2, np.where(symbol == 1, 1, 0)))
    shape = case + 3 * mark + 12 * (digit > 0) + 24 * (point > 0)
    fresh = np.r_[True, doc[1:] != doc[:-1]]
    before = np.r_[0, shape[:-1]]
    pair = ((before * 48 + shape) * 2654435761 >> 7) % PAIR_TERMS
    again = ~fresh & (keys == np.r_[keys[:1], keys[:-1]])
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    seen = np.zeros(len(keys), dtype=bool)
    seen[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    base = WORD_TERMS + SHAPES + PAIR_TERMS
    rows = np.concatenate([doc, doc, doc[~fresh], doc[again], doc[seen], doc[n > 20]])
    terms = np.concatenate([(keys % np.uint64(WORD_TERMS)).astype(np.int64), WORD_TERMS + shape, WORD_TERMS + SHAPES + pair[~fresh], np.full(again.sum(), base), np.full(seen.sum(), base + 1), np.full((n > 20).sum(), base + 2)])
    cell, count = np.unique(rows * TERMS + terms, return_counts=True)
    rows, terms = cell // TERMS, cell % TERMS
    words = np.bincount(doc, minlength=len(texts))
    shares = count / words[rows]
    # how often a word stands in the text, on average, in steps of a factor of two
    some = np.flatnonzero(words)
    times = words[some] / (words - np.bincount(doc[seen], minlength=len(texts)))[some]
    step = np.minimum(np.log2(times).astype(np.int64), REPEAT_STEPS - 1)
    at = np.searchsorted(rows, some, side="right")
    return np.insert(rows, at, some), np.insert(terms, at, base + 3 + step), np.insert(shares, at, 1.0)


class Model:
    """Term weights, directions, and the labelled vectors with their labels."""

    def __init__(self, rows, terms, shares, labels, documents: float, df: np.ndarray, directions: int = DIRECTIONS, neighbours: int = NEIGHBOURS):
        n = len(labels)
        self.weight = np.log((1 + documents) / (1 + df)) + 0.1
        self.weight[:WORD_TERMS] *= 0.3
        self.neighbours = min(neighbours, n)
        x = np.zeros((n, TERMS), dtype=np.float32)
        x[rows, terms] = self._values(rows, terms, shares, n)
        rng = np.random.default_rng(7)
        k = min(directions, n, TERMS)
        q = np.linalg.qr(x @ rng.standard_normal((TERMS, min(k + 12, n))).astype(np.float32))[0]
        for _ in range(4):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
        self.v = np.ascontiguousarray(v[:k].T, dtype=np.float32)
        self.labelled = self._unit(x @ self.v)
        self.labels = np.asarray(labels, dtype=np.float32)
        self.mean = float(self.labels.mean())

    def _values(self, rows, terms, shares, n):
        value = np.sqrt(shares) * self.weight[terms]
        norm = np.sqrt(np.bincount(rows, value * value, minlength=n))
        return (value / norm[rows]).astype(np.float32)

    @staticmethod
    def _unit(x):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-6)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, terms, shares = term_counts(texts)
        latent = np.zeros((len(texts), self.v.shape[1]), dtype=np.float32)
        if len(rows):
            value = self._values(rows, terms, shares, len(texts))
            head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            latent[rows[head]] = np.add.reduceat(self.v[terms] * value[:, None], head, axis=0)
        latent = self._unit(latent)
        out = np.empty(len(texts))
        for a in range(0, len(texts), 512):
            sims = latent[a : a + 512] @ self.labelled.T
            near = np.argpartition(-sims, self.neighbours - 1, axis=1)[:, : self.neighbours]
            vote = np.maximum(np.take_along_axis(sims, near, axis=1), 0) ** 4
            total = vote.sum(axis=1)
            out[a : a + 512] = np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), self.mean)
        return np.clip(out, 0, 1)


def held_out(key) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[float, np.ndarray]:
    """The number of documents with a word, and how many of all hold each term."""

    def run(batches):
        total = np.zeros(TERMS + 1)
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(0))]
            for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
                rows, terms, _ = term_counts(texts[a:b])
                total[:TERMS] += np.bincount(terms, minlength=TERMS)
                total[TERMS] += np.count_nonzero(np.diff(rows)) + 1 if len(rows) else 0
        yield pa.RecordBatch.from_pydict({"some": pa.array([TaskContext.get().partitionId()], pa.int64()), "value": pa.array([total], pa.list_(pa.float64()))})

    total = sum_arrays(bounded_batches(docs).select(F.col(text)).mapInArrow(run, "some long, value array<double>"))
    return (0.0, np.zeros(TERMS)) if total is None else (float(total[TERMS]), total[:TERMS])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Model | None:
    """Trains on at most ``most`` labelled rows that aren't held out, also where an id stands in many documents; None where there are none."""
    chosen = labels.where(~held_out(key) & F.col(label).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("float").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__key"), "__label").limit(most)
    rows = bounded_batches(docs).select(F.col(key).alias("__k"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__k") == F.col("__key")).select("__label", "__text", "__key")

    def run(batches):
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(1))]
            for i, t in enumerate(texts):
                _, terms, shares = term_counts([t])
                yield pa.RecordBatch.from_pydict({"key": batch.column(2).slice(i, 1).cast(pa.string()), "label": batch.column(0).slice(i, 1), "terms": pa.array([terms.tolist()], pa.list_(pa.int32())), "shares": pa.array([shares.tolist()], pa.list_(pa.float32()))})

    found = rows.mapInArrow(run, "key string, label float, terms array<int>, shares array<float>").orderBy("key", "label", "terms", "shares").limit(most).toArrow()
    if not found.num_rows:
        return None
    lens = pc.list_value_length(found["terms"]).to_numpy()
    flat = lambda c: pc.list_flatten(found[c]).to_numpy()
    return Model(np.repeat(np.arange(len(lens)), lens), flat("terms").astype(np.int64), flat("shares").astype(np.float64), found["label"].to_numpy(), *document_frequencies(docs, text))


def score(docs: DataFrame, model: Model | None, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the score to every row and keeps all columns; 0.5 everywhere where nothing was learned."""
    spark = docs.sparkSession
    docs = docs.drop(into)
    if model is None:
        return docs.withColumn(into, F.lit(0.5))
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))] + ["score"]

    def run(batches):
        m = sent.value
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(at))]
            for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(texts[a:b]), pa.float64())], names=names)

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return bounded_batches(docs).mapInArrow(run, fields + ", score double").toDF(*docs.columns, into)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with a score of 0.5 or more, with their columns."""
    own = fresh(docs, "score")
    return score(docs, fit(docs, labels, key, text), text, own).where(F.col(own) >= 0.5).drop(own)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
