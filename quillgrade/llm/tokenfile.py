"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a run of frames, each with the ids (little-endian unsigned 32-bit
integers) of consecutive documents, then a skippable frame with the document
index, then a seek table in the public seekable-zstandard layout: sizes of every
frame and the low half of the XXH64 of its content. A reader fetches the two
trailing frames, then decompresses only the frames that hold wanted documents.

Files follow each other in ascending key order: rows are range-partitioned by key,
so equal keys stand together, ordered by a hash of their text. Keys are whole numbers
of 64 bits; null keys come first, marked in the index, and null texts count as empty; every document ends with the end id, so an empty
one has one id. Each attempt of a task writes a file of its own; the manifest
names those of the attempts that succeeded. An empty table gives no files. Repeated
rows are documents of their own; columns besides key and text aren't read. Files are
written through pyarrow's file systems; ``s3a`` and ``s3n`` paths name the same objects as ``s3``.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrade.llm.common import chunks, materialise, scratch, sliced, utf8
from quillgrade.llm.flatwords import FlatEncoder

#: Fixed values of the public seekable-zstandard layout.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 16
CHUNK_BYTES = 2_000_000


@lru_cache(maxsize=2)
def _encoder(path: str) -> FlatEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()

    def encode(texts, odd=None):
        made = [e.ids for e in tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        lens = np.array([len(x) for x in made], dtype=np.int64)
        return np.fromiter((i for x in made for i in x), dtype=np.int32, count=int(lens.sum())), lens

    return FlatEncoder(encode, encode)


class Writer:
    """Appends documents to one file; ``close`` adds the index and the seek table."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.keys: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []
        self.frames: list[tuple[int, int, int]] = []
        self.frame_docs: list[int] = []
        self.held: list[np.ndarray] = []
        self.held_ids = self.held_docs = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.held_ids += len(ids)
        self.held_docs += 1
        if self.held_ids >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if not self.held_docs:
            return
        data = np.concatenate(self.held).astype("<u4").tobytes()
        packed = self.pack.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.frame_docs.append(self.held_docs)
        self.held, self.held_ids, self.held_docs = [], 0, 0

    def close(self) -> None:
        self._flush()
        body = struct.pack("<QQ", len(self.keys), len(self.frames))
        body += np.array(self.keys, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.frame_docs, "<u8").tobytes() + np.packbits(np.array(self.nulls, dtype=bool)).tobytes()
        body = self.pack.compress(body)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        entries = [*self.frames, (len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Random access to one file."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.sizes, self.sums = table[:-1, 0], table[:-1, 1], table[:-1, 2]
        self.offsets = np.cumsum(self.packed) - self.packed
        at = int(self.packed.sum())
        body = zstandard.ZstdDecompressor().decompress(self._at(at + 8, int(table[-1, 0]) - 8))
        docs, frames = struct.unpack_from("<QQ", body)
        self.keys = np.frombuffer(body, "<i8", docs, 16)
        self.counts = np.frombuffer(body, "<u8", docs, 16 + 8 * docs).astype(np.int64)
        self.frame_docs = np.frombuffer(body, "<u8", frames, 16 + 16 * docs).astype(np.int64)
        self.nulls = np.unpackbits(np.frombuffer(body, np.uint8, offset=16 + 16 * docs + 8 * frames), count=docs).astype(bool)
        self.first_doc = np.cumsum(self.frame_docs) - self.frame_docs
        self.starts = np.cumsum(self.counts) - self.counts

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, i: int) -> np.ndarray:
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[i]), int(self.packed[i])))
        if len(data) != self.sizes[i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} fails its checksum")
        return np.frombuffer(data, "<u4")

    def frame_documents(self, i: int):
        """Key, place among the file's ids, and ids of each document of a frame."""
        ids, at = self.frame(i), 0
        first = int(self.first_doc[i])
        for d in range(first, first + int(self.frame_docs[i])):
            n = int(self.counts[d])
            yield (None if self.nulls[d] else int(self.keys[d])), int(self.starts[d]), ids[at : at + n]
            at += n

    def documents(self, wanted) -> dict[int, np.ndarray]:
        """The ids of the wanted keys; only frames that hold one are decompressed."""
        hits = np.flatnonzero(np.isin(self.keys, np.fromiter(wanted, np.int64)) & ~self.nulls)
        out = {}
        for f in np.unique(np.searchsorted(self.first_doc, hits, side="right") - 1).tolist():
            out |= {k: ids.copy() for k, _, ids in self.frame_documents(f) if k in wanted}
        return out


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, sep, rest = uri.partition("://")
    return pafs.FileSystem.from_uri("s3" + sep + rest if scheme in ("s3a", "s3n") else uri)


def open_reader(uri: str) -> Reader:
    store, path = file_system(uri)
    return Reader(store.open_input_file(path), store.get_file_info(path).size)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files under ``out``; returns the manifest: place, file, documents and ids of each."""
    spark = docs.sparkSession
    tie = F.xxhash64(text)
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), tie.alias("tie")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def run(batches):
        encoder = _encoder(tokenizer_path)
        place = TaskContext.get().partitionId()
        store, folder = file_system(out)
        store.create_dir(folder, recursive=True)
        name = f"part-{place:06d}-{uuid.uuid4().hex}.tok.zst"
        writer = sink = None
        total = 0
        for batch in sliced(batches):
            keys = batch.column(0).to_pylist()
            texts = [b"" if t is None else t for t in utf8(batch.column(1))]
            for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
                if writer is None:
                    sink = store.open_output_stream(posixpath.join(folder, name), compression=None)
                    writer = Writer(sink)
                flat, counts = encoder.encode(texts[a:b])
                at = 0
                for k, n in zip(keys[a:b], counts.tolist()):
                    writer.add(k, np.append(flat[at : at + n], np.int32(end_id)))
                    at += n
                    total += n + 1
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"place": [place], "file": [name], "docs": [len(writer.keys)], "ids": [total]})

    manifest = ordered.mapInArrow(run, "place long, file string, docs long, ids long")
    return materialise(manifest, "token-manifest")


def read_tokens(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: key, place among all ids, number of ids and their crc32.

    The manifest has one row a file; only these rows come to the driver.
    """
    files, before = [], 0
    for m in manifest.orderBy("place").collect():
        files.append((m["file"], before))
        before += m["ids"]
    rows = spark.createDataFrame(files, "file string, start long").repartition(max(1, len(files)))

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = open_reader(posixpath.join(out, name))
                for f in range(len(reader.frame_docs)):
                    got = list(reader.frame_documents(f))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array([k for k, _, _ in got], pa.int64()),
                            "start": pa.array([start + s for _, s, _ in got], pa.int64()),
                            "n_tokens": pa.array([len(i) for _, _, i in got], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(i.tobytes()) for _, _, i in got], pa.int64()),
                        }
                    )

    return rows.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = scratch(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, tokenizer_path, out, end_id, key, text)
    return read_tokens(docs.sparkSession, out, manifest).withColumnRenamed("key", key)
