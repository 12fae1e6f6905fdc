"""Event-time operators that run the same way over a batch and over a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Days begin at midnight of Seoul, nine hours ahead.
DAY_START = "15 hours"
LIMIT = 100
JOB_SECONDS = 1800
#: A day's count is dropped so long after its last event.
KEPT_MS = 3 * 24 * 3600 * 1000


def kst_day(ts) -> Any:
    return F.to_date(ts + F.expr("INTERVAL 9 HOURS"))


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """day, n: tumbling windows of a day in Seoul; on a stream, rows later than the watermark are left out."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, "1 day", "1 day", DAY_START)
    return source.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(kst_day(F.col("w.start")).alias("day"), "n")


def admitted(events: DataFrame, ts: str, key: str, limit: int = LIMIT) -> DataFrame:
    """Batch twin of the admission: the first `limit` events of each day, in order of time and key, are let in.

    A day may hold any number of events: places are counted within minutes, and the counts of at most 1,440 minutes are
    summed for each day. `key` makes the order total.
    """
    rows = events.withColumns({"day": kst_day(F.col(ts)), "_m": F.date_trunc("minute", ts)})
    minutes = rows.groupBy("day", "_m").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("day").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    offsets = minutes.select("day", "_m", F.coalesce(before, F.lit(0)).alias("_before"))
    n = F.col("_before") + F.row_number().over(Window.partitionBy("day", "_m").orderBy(ts, key))
    return rows.join(offsets, ["day", "_m"]).withColumn("n", n).drop("_m", "_before").withColumn("allowed", F.col("n") <= limit)


STATE, OUT = "count long", "day date, op string, allowed boolean, remaining long"


def _admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, limit: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    count = state.get[0] if state.exists else 0
    rows, last = [], 0
    for pdf in batches:
        last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        for op in pdf.sort_values("ts")["op"]:
            allowed = op != "consume" or count < limit
            if op == "consume" and allowed:
                count += 1
            elif op == "refund":
                count = max(0, count - 1)
            rows.append((key[0], op, allowed, max(0, limit - count)))
    state.update((count,))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + KEPT_MS)
    yield pd.DataFrame(rows, columns=["day", "op", "allowed", "remaining"])


def quota(ops: DataFrame, limit: int = LIMIT, late: str = "1 hour") -> DataFrame:
    """day, op, allowed, remaining for a stream of (day, ts, op) with op consume, refund or peek. A day's count never
    falls below zero and is dropped three days after its last event."""
    keyed = ops.withWatermark("ts", late).groupBy("day")
    return keyed.applyInPandasWithState(lambda k, b, s: _admit(k, b, s, limit), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_in_flight(events: DataFrame, ts: str, keys: list[str], within: str = "30 minutes") -> DataFrame:
    """A stream without events that repeat a running one's keys within a time."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def distinct_in_flight(events: DataFrame, ts: str, keys: list[str], order: str, seconds: int = JOB_SECONDS) -> DataFrame:
    """Batch twin: events further than the time from the last admitted event with the same keys, or without one.

    A fold over sorted rows that holds one event of the current keys, so that keys may have any number of events.
    """
    columns, most = events.columns, seconds * 1_000_000
    rows = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(*keys).sortWithinPartitions(*keys, ts, order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, last = None, None
        for batch in batches:
            kept = []
            for i, (t, *own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_us", *keys)), strict=True)):
                if own != running:
                    running, last = own, None
                if t is None or last is None or t - last > most:
                    kept.append(i)
                    last = t
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(fold, events.schema)


def ingest(spark, folder: str, schema, target: str, checkpoint: str) -> None:
    """New files of a folder appended to a table; what an earlier run has done is in the checkpoint and isn't repeated."""
    q = spark.readStream.schema(schema).parquet(folder).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
