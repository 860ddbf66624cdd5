"""Per-key ordered state as batch folds: throttle, rolling quota, first events.

The transitions are plain expressions over a state struct; the streaming module
applies the same rules to micro-batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _ordered(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(micros(F.col("ts")).alias("t"), F.col("event_id").alias("id")))).alias("log"))


def throttle(events: DataFrame, key: str, rate_micros: int) -> DataFrame:
    """Events that come at least the rate after the last accepted one; dropped ones don't move the mark.

    Each task reads its keys' events in order and holds one mark: a key's history is never
    gathered, however long it is.
    """

    def run(batches):
        own, last = object(), None
        for batch in batches:
            keep = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k != own:
                    own, last = k, None
                if last is None or t - last >= rate_micros:
                    last = t
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 2])

    rows = events.select(F.col(key).alias("k"), micros(F.col("ts")).alias("t"), F.col("event_id").cast("long").alias("event_id"))
    rows = rows.repartition("k").sortWithinPartitions("k", "t", "event_id")
    return rows.mapInArrow(run, f"k {events.schema[key].dataType.simpleString()}, event_id long").withColumnRenamed("k", key)


def quota(events: DataFrame, key: str, limit: Column, period_micros: int) -> DataFrame:
    """A window opens at the first use after the last one ran out; uses count up to the limit, others are denied. Null limits allow all and keep no state."""

    def step(s, e):
        over = s["start"].isNull() | (e["t"] - s["start"] >= period_micros)
        count = F.when(over, F.lit(0)).otherwise(s["n"])
        ok = count < s["lim"]
        free = s["lim"].isNull()
        return F.struct(
            F.when(free, s["start"]).when(over, e["t"]).otherwise(s["start"]).alias("start"),
            F.when(free, s["n"]).otherwise(count + ok.cast("int")).alias("n"),
            (s["blocked"] + F.when(free | ok, 0).otherwise(1)).alias("blocked"),
            (s["resets"] + F.when(~free & over, 1).otherwise(0)).alias("resets"),
            s["lim"].alias("lim"),
        )

    start = F.struct(F.lit(None).cast("long").alias("start"), F.lit(0).alias("n"), F.lit(0).alias("blocked"), F.lit(0).alias("resets"), limit.cast("int").alias("lim"))
    folded = _ordered(events, key).withColumn("s", F.aggregate("log", start, step))
    return folded.select(key, F.when(F.col("s.lim").isNotNull(), F.col("s.n")).alias("used"), "s.blocked", "s.resets")


def has_quota(limit: Column, used: Column, started: Column, now: Column, period_micros: int) -> Column:
    """Whether another use would be allowed, without using it."""
    return limit.isNull() | started.isNull() | (now - started >= period_micros) | (used < limit)


def run_results(runs: DataFrame, session: str) -> DataFrame:
    """Results of a session, in arrival order."""
    return runs.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "score"))), lambda r: r["score"]), ",").alias("scores"))


def outcomes(events: DataFrame, sent: Column) -> DataFrame:
    return events.agg(F.count_if(sent).alias("sent"), F.count_if(~sent).alias("failed"))
