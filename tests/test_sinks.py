"""Readers and sinks, round trips in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from gyeol.sources import json_artifact, page_files, sinks


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("a", 1, "가"), ("b", 2, "나"), ("b", 3, None)], "book string, n int, text string")


def test_partitions_are_replaced(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(rows, path, "book")
    sinks.replace_partitions(rows.where("book = 'b'").withColumn("n", F.col("n") * 10), path, "book")
    assert sorted((r.book, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 20), ("b", 30)]


def test_only_new_hashes_are_appended(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    hashed = rows.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    hashed.limit(1).write.parquet(path)
    sinks.append_new(hashed.unionByName(hashed), spark.read.parquet(path), "h", path)
    got = spark.read.parquet(path)
    assert got.count() == 3
    assert {r.n for r in sinks.prune(got, hashed.where("n = 1"), "h").collect()} == {1}


def test_reports_logs_and_pages(spark, rows, tmp_path):
    sinks.json_report(rows, str(tmp_path / "r"), compressed=True)
    assert spark.read.json(str(tmp_path / "r")).count() == 3 and list((tmp_path / "r").glob("*.gz"))
    sinks.event_log(rows, str(tmp_path / "log"))
    sinks.event_log(rows.limit(1), str(tmp_path / "log"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(lines) == 4 and {"book": "b", "n": 3} in lines
    sinks.append_pages(rows, str(tmp_path / "p"), "book")
    sinks.append_pages(rows.limit(1), str(tmp_path / "p"), "book")
    assert spark.read.json(str(tmp_path / "p")).count() == 4


def test_upsert(spark, rows):
    fresh = spark.createDataFrame([(2, "새", 1), (2, "다시", 0), (9, "더", 5), (None, "?", 7)], "n int, text string, old int")
    got = sinks.upserted(rows, fresh, "n", ("old",))
    assert got.columns == ["n", "text"]
    assert sorted((r.n or 0, r.text or "") for r in got.collect()) == [(0, "?"), (1, "가"), (2, "다시"), (3, ""), (9, "더")]


def test_cards(spark, tmp_path):
    path = str(tmp_path / "cards")
    cards = spark.createDataFrame([("관형절", "절"), (None, "없음"), ("모음", "소리")], "label string, body string")
    for _ in range(2):
        sinks.write_cards(cards, "label", path)
    got = spark.read.json(path)
    assert {(r.label, r.card) for r in got.select("label", F.col("card").cast("string").alias("card")).collect()} >= {("관형절", "5d9fd3256ffe660c")} and got.count() == 2
    clash = cards.where("label IS NOT NULL").withColumn("label", F.when(F.col("body") == "절", "x").otherwise("y"))
    sinks.card_name, keep = (lambda label: F.lit("same")), sinks.card_name
    try:
        with pytest.raises(ValueError, match="same"):
            sinks.write_cards(clash, "label", path)
    finally:
        sinks.card_name = keep
    assert spark.read.json(path).count() == 2  # nothing was replaced


def test_readers(spark, tmp_path):
    assert json_artifact(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "a.json").write_text('{\n"a": 1\n}', encoding="utf-8")
    assert json_artifact(spark, str(tmp_path / "a.json"), "a int").first().a == 1
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "독서 교육론.txt").write_text("본문", encoding="utf-8")
    (tmp_path / "모르는 책.txt").write_text("글", encoding="utf-8")
    got = {r.name: (r.category, r.text, len(r.id)) for r in page_files(spark, str(tmp_path)).collect()}
    assert got == {"독서 교육론": ("문식성", "본문", 16), "모르는 책": (None, "글", 16)}
