"""Hilbert-curve sharding: rows near each other in several metadata dimensions share files.

Each dimension is quantised into cells of about equal row counts: cut points are
percentiles over all rows, for text dimensions the values themselves where the running
row count of the sorted values passes a step. The cells' Hilbert index orders the rows,
then the columns of ``together`` (rows alike in them stand side by side in their cell), the
key and the rest of the row; the order is cut into runs whose row counts differ by one
at most. The cut goes by counts alone: it may run through a group of equal rows.

Null dimension values lie in the first cell; null texts have no bytes. A cell may
hold a third of all rows: the cut runs through it, and so do the partitions, as the
key is part of the order. Repeated rows are adjacent; an empty table gives no rows. Where
a table has a column named as one of the new ones, the new one has an underscore in
front.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrade.llm.common import fresh, materialise


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of points (one row each, one column a dimension, each below 2**bits)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(n):
            up = (x[i] & np.uint64(q)) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def _running(rows: DataFrame, order: list[str], into: str, label: str, weight: Column | None = None) -> tuple[DataFrame, int]:
    """The rows, sorted and written, with the sum of ``weight`` (else their number) over all rows before each; and the sum of all."""
    part, at, own = fresh(rows, "__part"), fresh(rows, "__at"), fresh(rows, "__weight")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.lit(1).cast("long") if weight is None else weight.cast("long"))
    placed = materialise(placed.withColumn(at, F.monotonically_increasing_id()), label)
    placed = placed.withColumn(part, F.shiftright(at, 33))
    sums = placed.groupBy(part).agg(F.sum(own).alias(own)).orderBy(part).collect()  # one row a partition
    total, starts = 0, []
    for r in sums:
        starts.append((r[part], total))
        total += r[own]
    before, inner = fresh(placed, "__before"), Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    known = placed.sparkSession.createDataFrame(starts, f"{part} long, {before} long")
    ahead = F.col(at).bitwiseAND((1 << 33) - 1) if weight is None else F.coalesce(F.sum(own).over(inner), F.lit(0))
    out = placed.withColumn(into, ahead).join(F.broadcast(known), part).withColumn(into, F.col(into) + F.col(before))
    return out.drop(part, at, own, before), total


def _text_cuts(df: DataFrame, dim: str, cells: int) -> list[str]:
    """The values at which a new cell starts: at most ``cells`` - 1."""
    counts = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n"))
    ranked, total = _running(counts, ["value"], "before", "values", F.col("n"))
    if not total:
        return []
    cell = F.floor(F.col("before") * cells / total)
    return sorted(r["value"] for r in ranked.groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).where("cell > 0").collect())  # a row each cell


def hilbert_shards(df: DataFrame, dims: list[str], key: str, n_shards: int, bits: int = 5, together: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``hilbert``, ``position``, ``shard`` and ``slot``; the rows are written once to the shared folder."""
    hilbert, position, shard, slot = (fresh(df, n) for n in ("hilbert", "position", "shard", "slot"))
    texts = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [d for d in dims if d not in texts]
    found = df.agg(*[F.percentile_approx(F.col(d).cast("double"), steps, 10_000).alias(f"d{i}") for i, d in enumerate(numbers)]).first() if numbers else {}
    cuts = {d: [F.lit(float(c)) for c in np.unique(found[f"d{i}"] or [])] for i, d in enumerate(numbers)} | {d: [F.lit(c) for c in _text_cuts(df, d, 1 << bits)] for d in texts}
    cell = lambda d: sum(((F.col(d) if d in texts else F.col(d).cast("double")) >= c).cast("int") for c in cuts[d]) if cuts[d] else F.lit(0)

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([v.to_numpy(np.int64) for v in columns], axis=1), bits))

    rows = df.withColumn(hilbert, curve(*[F.coalesce(cell(d), F.lit(0)) for d in dims]))
    first = [hilbert, *together, key]
    placed, total = _running(rows, [*first, *[c for c in df.columns if c not in first]], position, "hilbert")
    number = F.expr(f"`{position}` * {n_shards}L div {max(total, 1)}L")
    start = F.expr(f"(`{shard}` * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn(shard, number.cast("int")).withColumn(slot, F.col(position) - start)


def write_shards(sharded: DataFrame, out: str) -> None:
    """A folder a shard, each in curve order, so that files hold narrow ranges of every dimension."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)


def document_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        "lang",
        "source",
        F.length("text").cast("long").alias("chars"),
    )
    rows = materialise(rows.withColumn("size", F.col("size") + 16), "slim")  # the texts are read once
    placed = hilbert_shards(rows, ["lang", "source", "size", "chars"], "doc_id", n_shards, together=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
