"""Sinks: replace by partition, append by content hash, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_new(df: DataFrame, existing: DataFrame, key: str, path: str) -> None:
    """Append the rows whose content hash isn't there yet, one for each hash."""
    df.join(existing.select(key), key, "left_anti").dropDuplicates([key]).write.mode("append").parquet(path)


def prune(df: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Rows that something still refers to."""
    return df.join(referenced.select(key).distinct(), key, "left_semi")


def json_report(df: DataFrame, path: str, compressed: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("compression", "gzip") if compressed else writer).json(path)


def event_log(df: DataFrame, path: str) -> None:
    """One JSON line for each event; null fields are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def upserted(existing: DataFrame, fresh: DataFrame, key: str, legacy: tuple[str, ...] = ()) -> DataFrame:
    """existing with the rows of fresh in the place of those of the same key, and the others of fresh added.

    Columns come in the order of fresh; legacy columns and others that fresh doesn't have are dropped. Of several fresh
    rows of a key the smallest stays; null keys are added as they are.
    """
    columns = [c for c in fresh.columns if c not in legacy]
    one = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_f")).select("_f.*")
    kept = existing.join(one.select(key), key, "left_anti").select(*(F.col(c) if c in existing.columns else F.lit(None).alias(c) for c in columns))
    return kept.unionByName(one).unionByName(fresh.where(F.col(key).isNull()).select(*columns))


def write_cards(cards: DataFrame, label: str, path: str) -> None:
    """One JSON file for each card, in a folder named after its label; null cards are left out.

    Two labels of one name stop the writing before anything is replaced; the new cards are written beside the old ones
    and then take their place.
    """
    spark = cards.sparkSession
    rows = cards.where(F.col(label).isNotNull()).withColumn("card", card_name(F.col(label)))
    clash = rows.groupBy("card").agg(F.count_distinct(label).alias("n")).where("n > 1").select("card").take(1)
    if clash:
        raise ValueError(f"two labels have the card name {clash[0].card}")
    aside = f"{path}.new"
    rows.repartition("card").write.mode("overwrite").partitionBy("card").json(aside)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{aside} can't be moved to {path}")


def append_pages(df: DataFrame, path: str, by: str = "book_id") -> None:
    """Pages as JSON beside those of earlier runs, a folder for each book; an original is never overwritten."""
    df.write.mode("append").partitionBy(by).json(path)


def card_name(label):
    """File name of a card: first 16 hex digits of the SHA-1 of its label."""
    return F.substring(F.sha1(label), 1, 16)
