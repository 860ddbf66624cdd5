"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words stand in one flat array. Each round looks all adjacent
pairs up by binary search over the sorted pair keys, finds every word's lowest
rank, and merges all occurrences of that pair, until no word has a pair left.
Units that were met before come from a bounded cache.

Null texts encode as empty texts; an empty text has no ids. A text holds any
number of rows' worth of characters; texts are worked on in chunks, whole.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrade.llm.common import bounded_batches, chunks, fresh, gather, per_group, sliced, utf8
from quillgrade.llm.flatwords import FlatEncoder

#: Fixed value: the public pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 1_000_000
NO_RANK = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary file with its pair table; ``encode`` and ``decode`` work on whole batches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        n = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * n
        for token, i in vocab.items():
            spelled[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.spelled_len = np.array([len(s) for s in spelled], dtype=np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.flat = FlatEncoder(self._units, self._pieces)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each: the merge rounds."""
        n = len(words)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        of = np.repeat(np.arange(n), lens)
        done_sym, done_of = [], []
        while len(sym):
            same = of[:-1] == of[1:]
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(same & (self.pair_keys[at] == key), self.ranks[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            first = np.flatnonzero(np.r_[True, ~same]) if len(sym) > 1 else np.zeros(1, np.int64)
            best = np.minimum.reduceat(rank, first)
            per_word = np.diff(np.r_[first, len(sym)])
            live = np.repeat(best < NO_RANK, per_word)
            if not live.all():
                done_sym.append(sym[~live])
                done_of.append(of[~live])
                if not live.any():
                    break
            hit = (rank == np.repeat(best, per_word)) & (rank < NO_RANK)
            # in a run of overlapping occurrences, every second one counts, from the left
            starts = hit & ~np.r_[False, hit[:-1]]
            pos = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(starts, pos, 0))
            hit &= (pos - run) % 2 == 0
            where = np.flatnonzero(hit)
            sym = sym.copy()
            sym[where] = self.made[at[where]]
            keep = live.copy()
            keep[where + 1] = False
            sym, of = sym[keep], of[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        sym, of = np.concatenate(done_sym), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return sym[order].astype(np.int32), np.bincount(of, minlength=n)

    def pretokens(self, text: str) -> list[str]:
        if self.specials is None or "<|" not in text:
            return self.words.findall(text)
        out: list[str] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.words.findall(part)
        return out

    def _pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts or units by the full pre-token rules; repeated pre-tokens are merged once."""
        words: list[str] = []
        n = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            w = self.pretokens(t.decode())
            n[i] = len(w)
            words += w
        own = {w: j for j, w in enumerate(dict.fromkeys(words))}
        flat, lens = self.merge([b"" if w in self.special else w.encode() for w in own])
        if lens.size and not lens.all():
            kinds, gaps = list(own), np.flatnonzero(lens == 0)
            flat = np.insert(flat, (np.cumsum(lens) - lens)[gaps], [self.special[kinds[g]] for g in gaps.tolist()]).astype(np.int32)
            lens[gaps] = 1
        at = np.fromiter(map(own.__getitem__, words), dtype=np.int64, count=len(words))
        return flat[gather((np.cumsum(lens) - lens)[at], lens[at])], per_group(lens[at], n)

    def _units(self, words: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units: each is one pre-token unless marked."""
        flat, lens = self.merge(words)
        if odd.any():
            rest, n = self._pieces([w for w, o in zip(words, odd.tolist()) if o])
            starts = np.cumsum(lens) - lens
            starts[odd] = len(flat) + np.cumsum(n) - n
            lens[odd] = n
            flat = np.concatenate([flat, rest])[gather(starts, lens)]
        return flat, lens

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and each text's number of ids."""
        return self.flat.encode(texts)

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts' bytes in UTF-8; ids that don't spell whole characters give U+FFFD."""
        lens = self.spelled_len[flat]
        data = self.spelled[gather(self.spelled_at[flat], lens)].tobytes()
        ends = np.cumsum(counts)
        upto = np.r_[0, np.cumsum(lens)]
        cut = upto[np.r_[0, ends]]
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            piece = data[a:b]
            try:
                piece.decode()
            except UnicodeDecodeError:
                piece = piece.decode("utf-8", "replace").encode()
            out.append(piece)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Adds ids and the round trip of every text.

    ``docs`` may have any other columns; they aren't read. Returns ``key``,
    ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on demand, ``ids``.
    """

    def run(batches):
        bpe = load(path)
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(1))]
            for a, b in chunks([len(t) for t in texts], CHUNK_CHARS):
                flat, counts = bpe.encode(texts[a:b])
                ends = np.cumsum(counts).tolist()
                raw, cut = flat.astype("<u4").tobytes(), [0, *ends]
                made = {
                    "key": batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array(counts),
                    "ids_sha256": [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(cut[:-1], cut[1:])],
                    "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in bpe.decode(flat, counts)],
                }
                if ids:
                    made["ids"] = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_pydict(made)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return bounded_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def encode_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``text`` decoded from the ids, and the columns ``n_tokens`` and ``ids``."""
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))] + ["n_tokens", "ids"]

    def run(batches):
        bpe = load(path)
        for batch in sliced(batches):
            texts = [b"" if t is None else t for t in utf8(batch.column(at))]
            for a, b in chunks([len(t) for t in texts], CHUNK_CHARS):
                flat, counts = bpe.encode(texts[a:b])
                cut = np.r_[0, np.cumsum(counts)]
                columns = batch.slice(a, b - a).columns
                columns[at] = pa.array([t.decode() for t in bpe.decode(flat, counts)], pa.string())
                ids = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), ids], names=names)

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return bounded_batches(docs).mapInArrow(run, fields + ", n_tokens long, ids array<int>").toDF(*docs.columns, fresh(docs, "n_tokens"), fresh(docs, "ids"))
