"""Problem 9: containers of fixed capacity filled with texts.

Conflict-constrained best fit, largest first: bins are ordered by the room they have left and carry bitmaps of their
sources and duplicate clusters; from the tightest bin that an item fits into, the search goes on until a compatible
one is found. Items are dealt to shards by a hash; each shard is packed by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.encoding import TOKENIZERS, VOCABULARY, encoder
from gyeol.llm.textio import arrow_map, batch_of, materialised
from gyeol.llm.visual import canonical

CAPACITY = 4096
#: Items for each shard: enough that the few open bins at a shard's end hardly count, and bounded for one task.
SHARD_ITEMS = 20_000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item. Two items of one cluster never share a bin; items of one source do only where the
    alternative is a new bin. Items of size 0 and null clusters conflict with nothing. Ties keep the order given.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(x for x in sources if x is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in pd.Series([x for x in clusters if x is not None], dtype=object).value_counts().items() if n > 1)}
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = [0] * len(sizes)
    for i in order:
        size = sizes[i]
        if size == 0 and held_sources:
            continue  # bin 0
        s, c = source_bit.get(sources[i], 0), cluster_bit.get(clusters[i], 0)
        chosen = spare = -1
        for k in range(bisect_left(room, (size, -1)), len(room)):
            b = room[k][1]
            if held_clusters[b] & c:
                continue
            if not held_sources[b] & s:
                chosen = k
                break
            if spare < 0:
                spare = k
        if chosen < 0:
            chosen = spare
        if chosen < 0:
            b, left = len(held_sources), capacity
            held_sources.append(0), held_clusters.append(0)
        else:
            left, b = room.pop(chosen)
        held_sources[b] |= s
        held_clusters[b] |= c
        if left > size:
            insort(room, (left - size, b))
        out[i] = b
    return out


def sized(df: DataFrame, key: str, text: str, source: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """item, source, cluster (digest of the consistent form, null for nothing to see), n_tokens of every row."""
    kind = df.schema[key].dataType.simpleString()
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        n = encoder(path).encode_batch(texts)[1]
        cluster = [xxhash.xxh128_digest(f.encode("utf-8", "replace")) if f else None for f in canonical(texts)]
        return batch_of(item=batch.column(0), source=batch.column(1), cluster=(cluster, pa.binary()), n_tokens=pa.array(n, pa.int64()))

    rows = df.select(F.col(key).alias("item"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return arrow_map(rows, run, f"item {kind}, source string, cluster binary, n_tokens bigint")


def pack(df: DataFrame, key: str, text: str, source: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """item, piece_no, first_token, n_tokens, container: where every text stands.

    A text within the capacity is one piece; a longer one fills containers of its own, and its rest is packed with the
    others. Null and empty texts are a piece of no tokens. Repeated rows are items of their own.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = materialised(sized(df, key, text, source).withColumn("row_id", F.monotonically_increasing_id()))
    kind = items.schema["item"].dataType.simpleString()
    shards = max(1, -(-items.count() // shard_items))
    full = items.where(F.col("n_tokens") > capacity).select("item", "row_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_tokens") / capacity).cast("int") - 1)).alias("piece_no"))
    full = full.select("item", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"), F.format_string("t%d-%d", "row_id", "piece_no").alias("container"))
    rest = F.when(F.col("n_tokens") > capacity, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens"))
    loose = items.select("item", "row_id", "source", "cluster", (F.col("n_tokens") - rest).alias("first_token"), rest.alias("n_tokens"), F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int").alias("shard"))
    loose = loose.where((F.col("n_tokens") > 0) | (F.col("first_token") == 0))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", kind="stable")
        bins = best_fit(pdf["n_tokens"].tolist(), pdf["source"].where(pdf["source"].notna(), None).tolist(), pdf["cluster"].where(pdf["cluster"].notna(), None).tolist(), capacity)
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({
            "item": pdf["item"], "piece_no": (pdf["first_token"] // capacity).astype("int32"), "first_token": pdf["first_token"], "n_tokens": pdf["n_tokens"],
            "container": [f"s{shard}-{b}" for b in bins],
        })

    packed = loose.groupBy("shard").applyInPandas(fill, f"item {kind}, piece_no int, first_token bigint, n_tokens bigint, container string")
    return full.unionByName(packed)
