"""Incremental builds: what has changed since the last one, what can be taken over, and engines that are passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(rows: DataFrame, ledger: DataFrame, key: str, text: str) -> DataFrame:
    """rows with `digest` whose text the ledger (key, digest) doesn't know under their key."""
    digested = rows.withColumn("digest", F.sha2(text, 256))
    return digested.join(ledger.select(key, "digest").distinct(), [key, "digest"], "left_anti")


def with_former_display(new: DataFrame, former: DataFrame) -> DataFrame:
    """new (page_id, raw, ...) with the display that a former passage of the page with the same characters had; of several
    the smallest, null where there is none."""
    known = former.where("display IS NOT NULL").groupBy("page_id", "raw").agg(F.min("display").alias("display"))
    return new.join(known, ["page_id", "raw"], "left")


def with_engine(df: DataFrame, column: str, result: str, kind: str, engine: Callable[[], Callable[[list], list]]) -> DataFrame:
    """df with `result`, what an external engine makes of a column: page images to text, texts to vectors or to scores.

    `engine` is called once in each task and gives a function over lists of non-null values; null values give null.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{result}` {kind}"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = engine()
        for pdf in parts:
            there = pdf[column].notna()
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            if there.any():
                out[there] = pd.Series(apply(pdf[column][there].tolist()), index=pdf.index[there], dtype=object)
            yield pdf.assign(**{result: out})

    return df.mapInPandas(run, schema)
