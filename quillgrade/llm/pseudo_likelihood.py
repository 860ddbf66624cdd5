r"""Language-model scores by masked pseudo-likelihood.

A network reads the words on both sides of a position and predicts the word there:
embeddings of the ``SIDE`` words before and after, one hidden layer, and a two-level
output (a class, then a member of the class) whose probabilities sum to one. A
document's score is the sum over its words of the log-probability of each given the
others around it.

The members are the most frequent words of the corpus and, for all other words, the
groups of their last bytes. Within a group a word's probability is its share of the
corpus counts without the position that is predicted, with ``PRIOR`` added to each of
the group's words. So every word has a probability of its own, and those of
the corpus's words sum to one. The counts are of all words of all documents, a table
that grows with the corpus and is joined by word; it never leaves the executors.

Each text is cut into words twice: to count them, and to write its ids. Training masks a
fixed share of the positions of every document: each
partition trains in numpy from the same parameters, the parameters are averaged with
the positions as weights, and the next round starts from the average. What the
rounds gather grows with the partitions and is averaged in blocks by many tasks; one set
of parameters, the frequent words and two numbers for each group come to the driver.

Words are runs of ``[^\x20\x09-\x0D]`` with A-Z lower-cased. A null or empty text has no
words and the score 0. Repeated rows score alike; an empty table gives no rows. Scores
depend a little on how the rows are dealt over partitions, as their models are averaged.
Columns besides key and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrade.llm.common import bounded_batches, chunks, materialise, sliced, utf8
from quillgrade.llm.flatwords import unit_keys

WORDS = 4032
RARE = 64
CLASSES = 64
PER_CLASS = (WORDS + RARE) // CLASSES
PAD = WORDS + RARE
WIDTH = 24
SIDE = 2
ROUNDS = 2
MASKED_PERMILLE = 150
BATCH = 4096
RATE = 0.08
CHUNK_BYTES = 2_000_000
CHUNK_WORDS = 300_000
SCORED = 32768
BLOCK = 1024
MERGED = 64
PRIOR = 0.1

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Groups of bytes: letters and digits alone, other characters by few.
_GROUP = np.full(256, 59, dtype=np.int64)
_GROUP[97:123], _GROUP[48:58] = np.arange(26), np.arange(26, 36)
_GROUP[33:48], _GROUP[58:65] = np.arange(36, 51), np.arange(51, 58)
_GROUP[91:97], _GROUP[128:] = 58, 60 + np.arange(128) % 4


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words, the last byte's group lowest, and the text of each."""
    data = np.frombuffer((b"\n".join(texts) + b"\n").translate(_LOWER), dtype=np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(~space & np.r_[space[1:], True])
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    keys = unit_keys(data, start, space) if len(start) else np.zeros(0, np.uint64)
    return (keys & ~np.uint64(RARE - 1)) | _GROUP[data[end]].astype(np.uint64), doc


class Vocabulary:
    """The frequent words by their keys, and for each group of other words their count and number."""

    def __init__(self, keys: list[int], counts: np.ndarray | None = None, kinds: np.ndarray | None = None):
        found = np.array(keys, dtype=np.int64).view(np.uint64)
        order = np.argsort(found)
        self.keys, self.ids = found[order], order
        self.counts = np.zeros(RARE) if counts is None else counts
        self.kinds = np.zeros(RARE) if kinds is None else kinds

    def ids_of(self, keys: np.ndarray) -> np.ndarray:
        rare = WORDS + (keys % np.uint64(RARE)).astype(np.int64)
        if not len(self.keys):
            return rare
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], rare)

    def group_logs(self) -> np.ndarray:
        """By id: 0 for a frequent word, for a group the logarithm of what its words' shares are divided by."""
        return np.r_[np.zeros(WORDS), np.log(np.maximum(self.counts - 1, 0) + PRIOR * np.maximum(self.kinds, 1))]


def contexts(ids: np.ndarray, doc: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """The words around each position, or each chosen one, the text's ends padded."""
    n = int(doc[-1]) + 1 if len(doc) else 0
    padded = np.full(len(ids) + (n + 1) * SIDE, PAD, dtype=np.int64)
    at = np.arange(len(ids)) + (doc + 1) * SIDE
    padded[at] = ids
    at = at if chosen is None else at[chosen]
    return np.stack([padded[at + j] for j in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


class Network:
    SHAPES = {"embed": (PAD + 1, WIDTH), "mix": (2 * SIDE * WIDTH, WIDTH), "bias": (WIDTH,), "kinds": (CLASSES, WIDTH), "kinds_bias": (CLASSES,), "words": (CLASSES, PER_CLASS, WIDTH), "words_bias": (CLASSES, PER_CLASS)}

    DTYPE = np.float32

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(11)
            flat = np.concatenate([(rng.standard_normal(int(np.prod(s))) * (0 if "bias" in k else 0.1)) for k, s in self.SHAPES.items()])
        self.flat = np.asarray(flat, dtype=self.DTYPE).copy()
        at = 0
        for k, s in self.SHAPES.items():
            setattr(self, k, self.flat[at : at + int(np.prod(s))].reshape(s))
            at += int(np.prod(s))

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    @staticmethod
    def _log_of(x: np.ndarray, column: np.ndarray, large: bool) -> np.ndarray:
        """One column of the log-softmax of each row; ``x`` is overwritten. ``large``: its exponentials may overflow."""
        if large:
            x -= x.max(axis=1, keepdims=True)
        own = x[np.arange(len(x)), column]
        np.exp(x, out=x)
        return own - np.log(x @ np.ones(x.shape[1], dtype=x.dtype))

    @staticmethod
    def _large(weights: np.ndarray, bias: np.ndarray) -> bool:
        """Whether a product with a hidden layer, whose values are within 1, may pass what an exponential can hold."""
        return bool((np.abs(weights).sum(axis=1) + np.abs(bias)).max() > 80)

    @staticmethod
    def _by_kind(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order by class, and where each class starts."""
        kind = target % CLASSES
        return np.argsort(kind.astype(np.uint8), kind="stable"), np.r_[0, np.cumsum(np.bincount(kind, minlength=CLASSES))]

    def hidden(self, around: np.ndarray):
        x = np.take(self.embed, around, axis=0).reshape(len(around), -1)
        return x, np.tanh(x @ self.mix + self.bias)

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, h = self.hidden(around)
        out = self._log_of(h @ self.kinds.T + self.kinds_bias, target % CLASSES, self._large(self.kinds, self.kinds_bias)).astype(np.float64)
        order, cut = self._by_kind(target)
        h, word = h[order], (target // CLASSES)[order]
        inner = np.zeros(len(target))
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if b > a:
                inner[a:b] = self._log_of(h[a:b] @ self.words[c].T + self.words_bias[c], word[a:b], self._large(self.words[c], self.words_bias[c]))
        out[order] += inner
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, seen: dict) -> None:
        """One Adagrad step on a batch."""
        n = len(target)
        order, cut = self._by_kind(target)
        around, target = around[order], target[order]
        x, h = self.hidden(around)
        kind, word = target % CLASSES, target // CLASSES
        p = self._softmax(h @ self.kinds.T + self.kinds_bias)
        p[np.arange(n), kind] -= 1
        p /= n
        dh = p @ self.kinds
        self._step("kinds", slice(None), p.T @ h, seen)
        self._step("kinds_bias", slice(None), p.sum(axis=0), seen)
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if b > a:
                q = self._softmax(h[a:b] @ self.words[c].T + self.words_bias[c])
                q[np.arange(b - a), word[a:b]] -= 1
                q /= n
                dh[a:b] += q @ self.words[c]
                self._step("words", c, q.T @ h[a:b], seen)
                self._step("words_bias", c, q.sum(axis=0), seen)
        dz = dh * (1 - h * h)
        dx = (dz @ self.mix.T).reshape(-1, WIDTH)
        self._step("mix", slice(None), x.T @ dz, seen)
        self._step("bias", slice(None), dz.sum(axis=0), seen)
        ids = around.reshape(-1)
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        self._step("embed", ids[order][head], np.add.reduceat(dx[order], head, axis=0), seen)

    def _step(self, name, at, grad, seen) -> None:
        if name not in seen:
            seen[name] = np.full(self.SHAPES[name], 1e-6, dtype=self.DTYPE)
        past = seen[name]
        past[at] += grad * grad
        getattr(self, name)[at] -= RATE * grad / np.sqrt(past[at])


def _masked(ids: np.ndarray, doc: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """A fixed share of positions, chosen by id and place in the text, and an order to learn them in."""
    first = np.searchsorted(doc, doc)
    x = ids.astype(np.uint64) + (np.arange(len(ids)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 7919 + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(((x >> np.uint64(20)) % np.uint64(1000)) < MASKED_PERMILLE)
    return at, np.argsort((x[at] ^ at.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")


def _chunked(batches, column: int):
    for batch in sliced(batches):
        texts = [b"" if t is None else t for t in utf8(batch.column(column))]
        for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
            yield batch, a, b, texts[a:b]


def _id_chunks(batches, column: int):
    """(batch, first row, row behind the last, ids, the row of each) of bounded numbers of words; a longer text stands alone."""
    for batch in batches:
        lists = batch.column(column)
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
        upto = np.r_[0, np.cumsum(sizes)]
        for a, b in chunks((sizes + 1).tolist(), CHUNK_WORDS):
            yield batch, a, b, flat[upto[a] : upto[b]], np.repeat(np.arange(b - a), sizes[a:b])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word, by its key, stands in the documents."""

    def run(batches):
        for _, _, _, texts in _chunked(batches, 0):
            keys, n = np.unique(word_keys(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(keys.view(np.int64)), "n": pa.array(n, pa.int64())})

    counts = docs.select(F.col(text)).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counts, "counts", "snappy")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, ties by the smaller key; of all others the sums of each group."""
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    group = F.col("word").bitwiseAND(F.lit(RARE - 1)).cast("int")
    sums = counts.groupBy(group.alias("group")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # RARE rows at most
    n, kinds = np.zeros(RARE), np.zeros(RARE)
    for r in sums:
        n[r["group"]], kinds[r["group"]] = r["n"], r["kinds"]
    for r in top:
        n[r["word"] % RARE] -= r["n"]
        kinds[r["word"] % RARE] -= 1
    return Vocabulary([r["word"] for r in top], n, kinds)


def word_ids(docs: DataFrame, words: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and the keys of its other words, written once; ``row`` tells documents with equal keys apart."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        own, part, before = sent.value, TaskContext.get().partitionId(), 0
        for batch, a, b, texts in _chunked(batches, 1):
            keys, doc = word_keys(texts)
            ids = own.ids_of(keys)
            rare = ids >= WORDS
            lists = lambda mark, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc[mark], minlength=b - a))], pa.int32()), values)
            rows = pa.array((np.int64(part) << 33) + before + np.arange(b - a))
            before += b - a
            every = np.ones(len(ids), dtype=bool)
            yield pa.RecordBatch.from_pydict({"row": rows, "key": batch.column(0).slice(a, b - a), "ids": lists(every, pa.array(ids, pa.int32())), "rare": lists(rare, pa.array(keys[rare].view(np.int64)))})

    kind = docs.schema[key].dataType.simpleString()
    return materialise(docs.select(F.col(key), F.col(text)).mapInArrow(run, f"row long, key {kind}, ids array<int>, rare array<long>"), "word-ids", "snappy")


def _averaged(parts: DataFrame) -> DataFrame:
    """Blocks of parameters averaged by their positions: first of some partitions, then of these."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for block, weight, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held = sums.setdefault(block, [0.0, 0.0])
                held[0] += weight
                held[1] = held[1] + own.values.to_numpy() * weight
        for block, (weight, total) in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "positions": pa.array([weight]), "own": pa.array([total / weight], pa.list_(pa.float64()))})

    schema = "block long, positions double, own array<double>"
    some = parts.repartition("block", "some").select("block", "positions", F.col("own").cast("array<double>").alias("own")).mapInArrow(run, schema)
    return some.repartition("block").mapInArrow(run, schema)


def train(rows: DataFrame, rounds: int = ROUNDS) -> Network:
    """The network after ``rounds`` over the rows of :func:`word_ids`."""
    network = Network()
    for turn in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(network.flat)

        def run(batches, sent=sent, turn=turn):
            own, seen, total = Network(sent.value), {}, 0
            for _, _, _, ids, doc in _id_chunks(batches, 0):
                at, order = _masked(ids, doc, turn)
                at = at[order]
                around = contexts(ids, doc, at)
                for a in range(0, len(at), BATCH):
                    own.learn(around[a : a + BATCH], ids[at[a : a + BATCH]], seen)
                total += len(at)
            if total:
                at = range(0, len(own.flat), BLOCK)
                some = TaskContext.get().partitionId() // MERGED
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array(at, pa.int64()), "some": pa.array([some] * len(at), pa.int64()), "positions": pa.array([float(total)] * len(at)), "own": pa.array([own.flat[a : a + BLOCK] for a in at], pa.list_(pa.float32()))}
                )

        trained = materialise(rows.select("ids").mapInArrow(run, "block long, some long, positions double, own array<float>"), "trained")
        flat = network.flat.copy()
        for r in _averaged(trained).collect():  # one set of parameters
            flat[r["block"] : r["block"] + len(r["own"])] = r["own"]
        network = Network(flat)
    return network


def score(rows: DataFrame, words: Vocabulary, network: Network, counts: DataFrame) -> DataFrame:
    """Per row of :func:`word_ids`: key, n_tokens, log_prob (summed) and mean_log_prob (null without words)."""
    sent = rows.sparkSession.sparkContext.broadcast((network.flat, words.group_logs()))

    def run(batches):
        flat, groups = sent.value
        own = Network(flat)
        for batch, a, b, ids, doc in _id_chunks(batches, 2):
            around = contexts(ids, doc)
            logs = -groups[ids]
            for i in range(0, len(ids), SCORED):
                logs[i : i + SCORED] += own.log_probs(around[i : i + SCORED], ids[i : i + SCORED])
            yield pa.RecordBatch.from_pydict(
                {"row": batch.column(0).slice(a, b - a), "key": batch.column(1).slice(a, b - a), "n_tokens": pa.array(np.bincount(doc, minlength=b - a), pa.int64()), "log_prob": pa.array(np.bincount(doc, logs, minlength=b - a), pa.float64())}
            )

    kind = rows.schema["key"].dataType.simpleString()
    known = bounded_batches(rows).select("row", "key", "ids").mapInArrow(run, f"row long, key {kind}, n_tokens long, log_prob double")
    again = counts.where("n > 1").hint("shuffle_hash")  # a row each word, so its parts are even and small
    shares = rows.select("row", F.explode("rare").alias("word")).join(again, "word", "left")
    shares = shares.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(1)) - 1 + PRIOR)).alias("share"))
    out = known.join(shares, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("share", F.lit(0.0)))
    return out.select("key", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    counts = word_counts(docs, text)
    words = vocabulary(counts)
    rows = word_ids(docs, words, key, text)
    return score(rows, words, train(rows), counts).withColumnRenamed("key", key)
