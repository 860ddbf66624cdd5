r"""Quality rules: base counts, and line labels from a linear-chain conditional random field.

Each line with a word is an observation; Viterbi decoding marks it content or
boilerplate, and a text stays when at least half of its word characters stand in
content lines (and its base counts don't fail it).

The field is trained on the lines of at most ``most`` labelled documents that aren't
held out (those with the least hash of their id, of ``MOST_LINES`` lines at most each).
The labels are of documents, so the lines' own are latent:

- lines that equal an earlier line of their text, or that stand in ``COMMON`` or more of these
  documents (the field keeps their keys), are boilerplate;
- all others start with their document's label. A first model without transitions
  labels line by line, so that texts hold lines of both kinds; then the whole field is
  trained ``ROUNDS`` times on its own labels. After each round the document's label is a
  constraint: in a good document lines of at least half of the word characters are
  content, in a bad one of less than half; where the labels break it, the least
  certain lines change.

Words are runs of ``[^\x20\x09-\x0D]``; a null text has none. A text without words
fails the base rules. With no labelled rows every line counts as content. Repeated
rows are judged alike; a text of any length is worked on whole, in one task; an empty
table gives no rows. Columns besides key and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrade.llm.common import bounded_batches, chunks, sliced, utf8
from quillgrade.llm.flatwords import unit_keys
from quillgrade.llm.knn_quality import held_out

MOST_LABELLED = 2000
MOST_LINES = 2000
COMMON = 3
ROUNDS = 4
CHUNK_BYTES = 1_000_000
CONTENT_SHARE = 0.5
CONTENT = 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_CHAR = np.ones(256, dtype=bool)
_CHAR[128:192] = False
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?:;"]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

#: Steps that line measures are cut at: one indicator for each step reached.
STEPS = {
    "words": [2, 4, 8, 16, 32],
    "symbols": [0.005, 0.02, 0.1],
    "upper": [0.1, 0.3, 0.6],
    "distinct": [0.2, 0.4, 0.7, 0.95],
    "again": [0.05, 0.3],
    "seen": [0.5, 0.9],
    "word_chars": [3, 6, 10],
    "bangs": [0.01, 0.05],
}
#: One for all lines, a repeated line, a sentence end, the steps, and a line known to be common.
N_FEATURES = 4 + sum(map(len, STEPS.values()))


class Lines:
    """Counts of texts, and the features of their lines, in flat arrays."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw, dtype=np.uint8)
        space = _SPACE[data]
        start = np.flatnonzero(~space & np.r_[True, space[:-1]])
        end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        doc_end = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
        line_end = np.flatnonzero(data == 10)
        line_start = np.r_[0, line_end[:-1] + 1]
        line_doc = np.searchsorted(doc_end, line_start, side="right")
        upto = lambda mark: np.r_[0, np.cumsum(mark, dtype=np.int64)]
        chars, symbols = upto(_CHAR[data] & ~space), upto(_SYMBOL[data])
        doc_start = np.r_[0, doc_end[:-1]]
        self.word_chars = chars[doc_end] - chars[doc_start]
        self.n_symbols = symbols[doc_end] - symbols[doc_start]
        doc = np.searchsorted(doc_end, start, side="right")
        self.n_words = np.bincount(doc, minlength=n)
        keys = unit_keys(data, start, space) if len(start) else np.zeros(0, np.uint64)
        self.n_repeat_words = self._repeats(keys, doc, n)

        line = np.searchsorted(line_end, start, side="left")
        words = np.bincount(line, minlength=len(line_end))
        full = words > 0
        later = np.zeros(len(line_end), dtype=bool)
        at = 0
        for t in texts:
            known = set()
            pieces = t.split(b"\n")
            for i, piece in enumerate(pieces):
                if piece in known:
                    later[at + i] = True
                known.add(piece)
            at += len(pieces)
        later &= full
        self.n_dup_lines = np.bincount(line_doc[later], minlength=n)

        # features of the lines that have a word
        a, b = line_start[full], line_end[full]
        w = words[full]
        line_chars = np.maximum(chars[b] - chars[a], 1)
        letters, uppers, bangs = upto(_LETTER[data]), upto(_UPPER[data]), upto(data == 33)
        fresh_line = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)
        same = ~fresh_line & (keys == np.r_[keys[:1], keys[:-1]])
        seen = self._seen(keys, doc)
        in_line = self._seen(keys, line)
        per = lambda mark: np.bincount(line[mark], minlength=len(line_end))[full] / w
        measures = {
            "words": w,
            "symbols": (symbols[b] - symbols[a]) / line_chars,
            "upper": (uppers[b] - uppers[a]) / np.maximum(letters[b] - letters[a], 1),
            "distinct": 1 - per(in_line),
            "again": per(same),
            "seen": per(seen),
            "word_chars": line_chars / w,
            "bangs": (bangs[b] - bangs[a]) / line_chars,
        }
        last = np.zeros(len(line_end), dtype=np.int64)
        last[line] = end - 1
        columns = [np.ones(len(w)), later[full], _END[data[last[full]]]] + [measures[k] >= s for k, steps in STEPS.items() for s in steps]
        self.features = np.stack([*columns, np.zeros(len(w))], axis=1).astype(np.float32)
        place = (np.arange(len(line)) - np.searchsorted(line, line)).astype(np.uint64)
        mixed = (keys ^ (keys >> np.uint64(29))) * (place * np.uint64(2) + _MIX[2])
        head = np.flatnonzero(fresh_line)
        self.line_keys = np.add.reduceat(mixed, head) if len(head) else np.zeros(0, np.uint64)
        self.line_doc = line_doc[full]
        self.line_chars = chars[b] - chars[a]
        self.lines = np.bincount(self.line_doc, minlength=n)

    @staticmethod
    def _seen(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether a key stands earlier in its group."""
        out = np.zeros(len(keys), dtype=bool)
        if len(keys):
            mixed = keys ^ (group.astype(np.uint64) + np.uint64(1)) * _MIX[0]
            order = np.argsort(mixed, kind="stable")
            out[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
        return out

    @staticmethod
    def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Words of each text that stand in a 3-word window found twice or more in it."""
        hit = np.zeros(len(keys), dtype=bool)
        if len(keys) >= 3:
            whole = np.flatnonzero(doc[2:] == doc[:-2])
            if len(whole):
                k = [(x ^ (x >> np.uint64(31))) * m for x, m in zip((keys[whole], keys[whole + 1], keys[whole + 2]), _MIX)]
                tri = k[0] + (k[1] ^ (k[1] >> np.uint64(27))) * _MIX[2] + (k[2] ^ (k[2] >> np.uint64(33))) * _MIX[0]
                tri ^= (doc[whole].astype(np.uint64) + np.uint64(1)) * _MIX[1]
                order = np.argsort(tri)
                same = tri[order[1:]] == tri[order[:-1]]
                twice = np.zeros(len(whole), dtype=bool)
                twice[order[1:]] |= same
                twice[order[:-1]] |= same
                for i in range(3):
                    hit[whole[twice] + i] = True
        return np.bincount(doc[hit], minlength=n)


class LineField:
    """A two-state linear-chain conditional random field."""

    def __init__(self, common: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2))
        self.move = np.zeros((2, 2))
        self.common = np.zeros(0, np.uint64) if common is None else np.sort(common)

    def observed(self, features: np.ndarray, line_keys: np.ndarray) -> np.ndarray:
        """The features, with the mark of lines that are known to be common."""
        out = features.astype(np.float64)
        if len(self.common):
            out[:, -1] = self.common[np.minimum(np.searchsorted(self.common, line_keys), len(self.common) - 1)] == line_keys
        return out

    @staticmethod
    def _layout(lines: np.ndarray):
        starts = np.cumsum(lines) - lines
        order = np.argsort(-lines, kind="stable")
        order = order[lines[order] > 0]
        sizes = lines[order]
        return starts[order], sizes, [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) if len(sizes) else 0)]

    def marginals(self, features: np.ndarray, lines: np.ndarray, layout=None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each line's labels, and the expected transitions, by the forward-backward algorithm."""
        starts, _, active = layout or self._layout(lines)
        n = len(features)
        e = features @ self.emit
        fore, back = np.zeros((n, 2)), np.zeros((n, 2))
        for t, k in enumerate(active):
            at = starts[:k] + t
            fore[at] = e[at] + (np.logaddexp.reduce(fore[at - 1][:, :, None] + self.move, axis=1) if t else 0)
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            back[at - 1] = np.logaddexp.reduce(self.move + (e[at] + back[at])[:, None, :], axis=2)
        total = np.logaddexp.reduce(fore + back, axis=1)
        inner = np.ones(n, dtype=bool)
        inner[starts] = False
        to = np.flatnonzero(inner)
        pair = np.exp(fore[to - 1][:, :, None] + self.move + (e[to] + back[to])[:, None, :] - total[to][:, None, None]).sum(axis=0)
        return np.exp(fore + back - total[:, None]), pair

    def train(self, features: np.ndarray, labels: np.ndarray, lines: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3, chain: bool = True) -> None:
        """Adam on the mean log-likelihood of the label sequences; without ``chain`` transitions stay 0."""
        layout = self._layout(lines)
        n = len(features)
        if not n:
            return
        gold = np.zeros((n, 2))
        gold[np.arange(n), labels] = 1
        want_emit = features.T @ gold
        inner = np.ones(n, dtype=bool)
        inner[layout[0]] = False
        to = np.flatnonzero(inner)
        want_move = gold[to - 1].T @ gold[to]
        state = [np.zeros_like(self.emit), np.zeros_like(self.emit), np.zeros_like(self.move), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            p, pair = self.marginals(features, lines, layout)
            for name, grad, i in (("emit", (want_emit - features.T @ p) / n, 0), ("move", (want_move - pair) / n * chain, 2)):
                value = getattr(self, name)
                grad = grad - ridge * value
                state[i] = 0.9 * state[i] + 0.1 * grad
                state[i + 1] = 0.99 * state[i + 1] + 0.01 * grad * grad
                setattr(self, name, value + rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-8))

    def decode(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest label sequence of each text; ties go to content."""
        starts, sizes, active = self._layout(lines)
        e = features @ self.emit
        best = np.zeros((len(features), 2))
        came = np.zeros((len(features), 2), dtype=np.int8)
        for t, k in enumerate(active):
            at = starts[:k] + t
            if t:
                via = best[at - 1][:, :, None] + self.move
                came[at] = 1 - np.argmax(via[:, ::-1, :], axis=1)
                best[at] = e[at] + via.max(axis=1)
            else:
                best[at] = e[at]
        out = np.zeros(len(features), dtype=np.int64)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            at = starts[:k] + t
            out[at] = best[at][:, 1] >= best[at][:, 0]
            ongoing = active[t + 1] if t + 1 < len(active) else 0
            follow = starts[:ongoing] + t + 1
            out[at[:ongoing]] = came[follow, out[follow]]
        return out


def constrained(marks: np.ndarray, content: np.ndarray, fixed: np.ndarray, chars: np.ndarray, lines: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Line labels that keep each document's label: the least certain lines that aren't ``fixed`` change until its content share does."""
    out = marks.copy()
    upto = np.r_[0, np.cumsum(lines)]
    for d, is_good in enumerate(good):
        own = np.arange(upto[d], upto[d + 1])
        total, have = chars[own].sum(), chars[own][out[own] == CONTENT].sum()
        ranked = own[np.argsort(-content[own] if is_good else content[own], kind="stable")]
        for i in ranked:
            if (have >= CONTENT_SHARE * total) == bool(is_good):
                break
            if not fixed[i] and (out[i] == CONTENT) != is_good:
                out[i] = int(is_good)
                have += chars[i] if is_good else -chars[i]
    return out


def learn(features: np.ndarray, line_keys: np.ndarray, chars: np.ndarray, lines: np.ndarray, good: np.ndarray) -> LineField:
    """The field of documents with labels; the labels of their lines are latent."""
    doc = np.repeat(np.arange(len(lines)), lines)
    pairs = np.unique(np.stack([line_keys, doc.astype(np.uint64)]), axis=1)
    found, n = np.unique(pairs[0], return_counts=True)
    field = LineField(found[n >= COMMON])
    x = field.observed(features, line_keys)
    fixed = (x[:, 1] > 0) | (x[:, -1] > 0)
    marks = np.where(fixed, 1 - CONTENT, np.repeat(good.astype(np.int64), lines))
    for turn in range(1 + ROUNDS):
        field.train(x, marks, lines, steps=80 if turn else 200, chain=turn > 0)
        content = field.marginals(x, lines)[0][:, CONTENT]
        marks = constrained(np.where(fixed, 1 - CONTENT, field.decode(x, lines)), content, fixed, chars, lines, good)
    return field


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> LineField:
    chosen = labels.where(~held_out(key) & F.col(label).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__key"), "__label").limit(most)
    rows = bounded_batches(docs).select(F.col(key).alias("__k"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__k") == F.col("__key")).select("__label", "__text", F.col("__key").cast("string").alias("__key"))

    def run(batches):
        for batch in sliced(batches):
            for i, t in enumerate(utf8(batch.column(1))):
                own = Lines([t or b""])
                if own.lines[0] <= MOST_LINES:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": batch.column(2).slice(i, 1),
                            "label": batch.column(0).slice(i, 1),
                            "lines": pa.array([int(own.lines[0])], pa.int64()),
                            "features": pa.array([np.packbits(own.features > 0, axis=1).tobytes()], pa.binary()),
                            "line_keys": pa.array([own.line_keys.tobytes()], pa.binary()),
                            "chars": pa.array([own.line_chars.astype(np.int64).tobytes()], pa.binary()),
                        }
                    )

    # rows after the join are bounded too: an id may stand in many documents
    found = rows.mapInArrow(run, "key string, label int, lines long, features binary, line_keys binary, chars binary").orderBy("key", "label", "features", "line_keys").limit(most).collect()
    if not found:
        return LineField()
    counts = np.array([r["lines"] for r in found], dtype=np.int64)
    joined = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in found), kind)
    features = np.unpackbits(joined("features", np.uint8).reshape(int(counts.sum()), -1), axis=1)[:, :N_FEATURES] if counts.sum() else np.zeros((0, N_FEATURES))
    return learn(features, joined("line_keys", np.uint64), joined("chars", np.int64), counts, np.array([r["label"] == 1 for r in found]))


def judge(docs: DataFrame, field: LineField, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict of each text, with the share of its word characters in content lines and the numbers of lines."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(field)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        f = sent.value
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(1))]
            for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
                lines = Lines(texts[a:b])
                marks = f.decode(f.observed(lines.features, lines.line_keys), lines.lines)
                content = np.bincount(lines.line_doc, lines.line_chars * (marks == CONTENT), minlength=b - a)
                share = np.divide(content, lines.word_chars, out=np.zeros(b - a), where=lines.word_chars > 0)
                failed = (lines.n_words < 50) | (100 * lines.n_repeat_words > 50 * lines.n_words)
                yield pa.RecordBatch.from_pydict(
                    {"key": batch.column(0).slice(a, b - a)}
                    | {c: pa.array(getattr(lines, c), pa.int64()) for c in names}
                    | {"base_failed": failed, "kept": ~failed & (share >= CONTENT_SHARE), "content_share": share}
                    | {"n_lines": pa.array(lines.lines, pa.int64()), "n_content_lines": pa.array(np.bincount(lines.line_doc[marks == CONTENT], minlength=b - a), pa.int64())}
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
    return bounded_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
