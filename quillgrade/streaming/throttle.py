"""Streaming forms of the stateful operators.

Events of a key are taken in time order within each micro-batch; state carries
over between batches. First events use a watermark of our own choosing, since the
rule itself knows no lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgrade.operators.state import micros


def throttle_stream(events: DataFrame, key: str, rate_micros: int) -> DataFrame:
    """Accepted events of a stream with columns key, ts and event_id."""

    def accept(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"], kind="stable")
        taken = []
        for t, e in zip(rows["t"].tolist(), rows["event_id"].tolist()):
            if last is None or t - last >= rate_micros:
                last = t
                taken.append(e)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"k": [group[0]] * len(taken), "event_id": taken}, columns=["k", "event_id"]).astype({"k": "int64", "event_id": "int64"})

    rows = events.select(F.col(key).alias("k"), micros(F.col("ts")).alias("t"), "event_id")
    out = rows.groupBy("k").applyInPandasWithState(accept, "k long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("k", key)


def first_events_stream(events: DataFrame, key: str, lateness: str = "1 hour") -> DataFrame:
    """The first event of each key, once, as long as repeats come within the lateness."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, out: str) -> DataFrame:
    """Runs a stream over what is there, into files under ``out`` with its checkpoint beside them, and reads them back."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")
