"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it stays below this many counted rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Rows that a Python worker takes at once.
ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("vectors", "embeddings"):
        # floats stored by BYTE_STREAM_SPLIT: only the row-wise reader of nested columns knows that encoding
        spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only where none is set and all runs on one machine (tests), a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file:///tmp/gyeol-checkpoints-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: The intermediate tables of this process stand in a folder of their own, which goes when the process ends.
_OURS = f"gyeol-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this process; results that were not yet read can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{_OURS}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):
            clear(spark)


def materialised(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: lineage is cut and the copy survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{_OURS}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """What the optimizer expects of the size of df: for a materialised table that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Broadcast `small` (a materialised table) only when its counted rows and its bytes stay under the bounds; else shuffle both."""
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS and planned_bytes(small) <= BROADCAST_BYTES else small, on, how)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over Arrow batches of df of at most ROWS rows; a batch may give any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = fn(batch.slice(at, ROWS))
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def batch_of(**columns: tuple[list, pa.DataType] | pa.Array) -> pa.RecordBatch:
    names = list(columns)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c[0], c[1]) for c in columns.values()], names=names)


def slices(texts: list[str], most: int = 400_000) -> list[list[str]]:
    """Texts in order, in lists of so many code points at most, or of one text: what is held at once stays small."""
    out, size = [[]], 0
    for t in texts:
        if out[-1] and size + len(t) > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return [part for part in out if part]
