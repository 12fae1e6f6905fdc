"""Dense retrieval: cosine top-k and best similarity, in double precision, with defined ties."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def similarity(df: DataFrame, key: str, vector: str, query: Sequence[float]) -> DataFrame:
    """key and cosine of every row whose vector has the query's length, no null or NaN, and isn't all zero.

    The product runs over whole Arrow batches; only two columns enter Python and two leave it.
    """
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q)
    kind = df.schema[key].dataType.simpleString()
    good = (F.size(vector) == len(q)) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists(vector, lambda v: v != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x @ q / np.linalg.norm(x, axis=1))], names=[key, "cosine"])

    return df.where(good).select(key, vector).mapInArrow(run, f"`{key}` {kind}, cosine double")


def top_k(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 60) -> DataFrame:
    """The k most similar rows, ties by key: a partial sort on each partition, k rows from each to the last step."""
    return similarity(df, key, vector, query).orderBy(F.desc("cosine"), F.asc(key)).limit(k)


def best_of_group(similar: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """The best cosine of each group over its members' keys."""
    return members.join(similar, key).groupBy(group).agg(F.max("cosine").alias("cosine"))


def normalised(df: DataFrame, vector: str) -> DataFrame:
    """Vectors of length 1."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x)) + F.lit(1e-12)
    return df.withColumn(vector, F.transform(vector, lambda x: x / norm))


def ranked(df: DataFrame, by: str, score: str, key: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))))
