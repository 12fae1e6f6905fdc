"""Readers. Schemas are stated where the format has none, so that a missing file is an empty table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder; floats stored by BYTE_STREAM_SPLIT need the row-wise reader of nested columns."""
    if name in ("vectors", "embeddings"):
        spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON artifact; an empty table of the schema if there is none."""
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


#: First match wins: what a file's name says about its subject.
NAME_RULES = (("문법", "문법"), ("음운", "문법"), ("형태", "문법"), ("독서", "문식성"), ("작문", "문식성"), ("읽기", "문식성"), ("쓰기", "문식성"), ("소설", "문학"), ("시", "문학"))


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """path, id, name, category and content of every text file under a root, found recursively.

    The id is the first 16 hex digits of the SHA-256 of the path; unknown names have a null category.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    category = F.coalesce(*(F.when(name.contains(k), v) for k, v in NAME_RULES))
    return files.select("path", F.substring(F.sha2("path", 256), 1, 16).alias("id"), name.alias("name"), category.alias("category"), F.decode("content", "UTF-8").alias("text"))
