"""Quotas and duplicates over the event log: batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.queries.registry import Registry
from gyeol.sources import table
from gyeol.streaming import usage

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("SELECT CAST(ts + INTERVAL 9 HOURS AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_counts(table(spark, d, "events"))


@query("""WITH e AS (SELECT event_id, CAST(ts + INTERVAL 9 HOURS AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts + INTERVAL 9 HOURS AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')
SELECT event_id, day, n, n <= 20 AS allowed FROM e""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return usage.admitted(table(spark, d, "events").where("event_type = 'click'"), "ts", "event_id", 20).select("event_id", "day", "n", "allowed")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS g FROM events) WHERE g IS NULL OR g > 1800 * 1000000")
def inflight_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return usage.distinct_in_flight(table(spark, d, "events"), "ts", ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, count(*) FILTER (WHERE value IS NULL) AS unknown FROM events GROUP BY event_type")
def call_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.count_if(F.col("value").isNull()).alias("unknown"))


@query("SELECT user_id, day, count(*) AS n FROM (SELECT user_id, CAST(ts + INTERVAL 9 HOURS AS DATE) AS day FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY ALL HAVING count(*) >= 2")
def busy_users(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('purchase', 'error')").select("user_id", usage.kst_day(F.col("ts")).alias("day"))
    return e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE k IS NULL) AS unreadable, sum(k) AS total FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """A field of the nested JSON of events; what can't be read counts as unreadable."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k").isNull()).alias("unreadable"), F.sum("k").alias("total"))
