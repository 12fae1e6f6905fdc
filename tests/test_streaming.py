import datetime as dt

from pyspark.sql import functions as F

from gyeol.streaming import usage


def test_quota_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 3)
    rows = [(dt.date(2024, 1, 1), t + dt.timedelta(seconds=i), op) for i, op in enumerate(["peek", "consume", "consume", "consume", "consume", "refund", "peek"])] + [(dt.date(2024, 1, 2), t, "peek")]
    spark.createDataFrame(rows, "day date, ts timestamp, op string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("day date, ts timestamp, op string").parquet(str(tmp_path / "in"))
    q = usage.quota(source, 3).writeStream.format("memory").queryName("quota_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(str(r.day), r.op, r.allowed, r.remaining) for r in spark.table("quota_out").collect()]
    first = [x[1:] for x in got if x[0] == "2024-01-01"]
    assert first == [("peek", True, 3), ("consume", True, 2), ("consume", True, 1), ("consume", True, 0), ("consume", False, 0), ("refund", True, 1), ("peek", True, 1)]
    assert [x[1:] for x in got if x[0] == "2024-01-02"] == [("peek", True, 3)]


def test_daily_stream_equals_batch(spark, small, tmp_path):
    from gyeol.sources import table

    batch = {(r.day, r.n) for r in usage.daily_counts(table(spark, small, "events")).collect()}
    schema = table(spark, small, "events").schema
    (tmp_path / "in").mkdir()
    table(spark, small, "events").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = usage.daily_counts(stream).writeStream.format("memory").queryName("daily_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.day, r.n) for r in spark.table("daily_out").collect()} == batch


def test_ingest_resumes(spark, tmp_path):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    a.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        usage.ingest(spark, str(tmp_path / "in"), a.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([(3,)], "x int").write.mode("append").parquet(str(tmp_path / "in"))
    usage.ingest(spark, str(tmp_path / "in"), a.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_in_flight_counts_from_the_admitted_event(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 3)
    minutes = [0, 20, 40, 60, 80, 200]
    rows = [(i, "u", t + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)] + [(10, "v", t), (11, None, t), (12, None, t)]
    df = spark.createDataFrame(rows, "event_id int, user string, ts timestamp")
    batch = {r.event_id for r in usage.distinct_in_flight(df, "ts", ["user"], "event_id").collect()}
    assert batch == {0, 2, 4, 5, 10, 11}
    for i, m in enumerate(minutes):
        df.where(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = usage.first_in_flight(source, "ts", ["user"]).writeStream.format("memory").queryName("flight_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id for r in spark.table("flight_out").collect()} <= batch
