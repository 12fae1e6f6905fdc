"""Problem 3: how often every distinct value or term occurs, and in how many records.

Vertical layout: for each term, compressed bitmaps of record identifiers (sorted 16-bit arrays while sparse, bit sets
when dense, one container for each 65,536 identifiers) with a parallel counter of occurrences for each identifier.
Containers merge by union; the document frequency is read from their cardinality.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.textio import batch_of

#: Containers with more identifiers than this are kept as bit sets of 8 KiB.
ARRAY_MAX = 4096
#: The entry of the bitmap of all records; no term is empty.
ALL = ""
TERM = re.compile(r"[가-힣]{2,}")

SCHEMA = "field string, entry string, high bigint, ids binary, counts binary"


def pack(low: np.ndarray) -> bytes:
    """A container of ascending distinct 16-bit identifiers."""
    if len(low) <= ARRAY_MAX:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, dtype=np.uint8)
    bits[low] = 1
    return b"B" + np.packbits(bits).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if len(raw) % 2:  # a bit set has its mark before 8,192 bytes, an array an even number of bytes
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=1))).astype(np.int64)
    return np.frombuffer(raw, dtype="<u2").astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Empty if every counter is 1."""
    return b"" if (counts == 1).all() else counts.astype("<u4").tobytes()


def cardinality(raw: bytes) -> int:
    return int(np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=1)).sum()) if len(raw) % 2 else len(raw) // 2


def containers(entries: np.ndarray, ids: np.ndarray, counts: np.ndarray | None) -> Iterator[tuple[str, int, bytes, bytes]]:
    """Containers of occurrences. counts None: one row is one occurrence; else rows of equal (entry, id) are copies."""
    codes, names = pd.factorize(entries)
    order = np.lexsort((ids, codes))
    codes, ids = codes[order], ids[order]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(codes)]) if counts is None else np.maximum.reduceat(counts[order], at)
    codes, ids = codes[at], ids[at]
    high = ids >> 16
    cuts = np.r_[0, np.flatnonzero((codes[1:] != codes[:-1]) | (high[1:] != high[:-1])) + 1, len(codes)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield names[codes[a]], int(high[a]), pack(ids[a:b] & 0xFFFF), pack_counts(n[a:b])


def _batches(field: str, rows: Iterator[tuple[str, int, bytes, bytes]], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for i in range(0, len(rows), size):
        entry, high, ids, counts = zip(*rows[i : i + size], strict=True)
        yield batch_of(field=([field] * len(entry), pa.string()), entry=(list(entry), pa.string()), high=(list(high), pa.int64()), ids=(list(ids), pa.binary()), counts=(list(counts), pa.binary()))


def term_containers(df: DataFrame, key: str, text: str, field: str, terms: Callable[[str], list[str]] = TERM.findall) -> DataFrame:
    """Partial containers of the terms of every record, built by each task over all it reads; rows of SCHEMA.

    A record whose text isn't null also enters the container of ALL. Rows with a null key or text give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each batch is closed by itself, so that copies in other batches merge as copies, not as occurrences
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
            found = [[ALL, *terms(t)] for t in batch.column(1).take(pa.array(first)).to_pylist()]
            entries = np.array([e for f in found for e in f], dtype=object)
            yield from _batches(field, containers(entries, np.repeat(ids, [len(f) for f in found]), None))

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    return rows.mapInArrow(run, SCHEMA)


def merged(partial: DataFrame) -> DataFrame:
    """One row for each (field, entry, high): containers united, counters of an identifier met twice not added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # rows of the last key, which the next batch may go on with

        def unite(rows: list) -> tuple:
            if len(rows) == 1:
                return rows[0]
            ids = [unpack(r[3]) for r in rows]
            counts = [np.frombuffer(r[4], dtype="<u4").astype(np.int64) if r[4] else np.ones(len(i), dtype=np.int64) for r, i in zip(rows, ids, strict=True)]
            i, n = np.concatenate(ids), np.concatenate(counts)
            order = np.argsort(i, kind="stable")
            i, n = i[order], n[order]
            at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            return (*rows[0][:3], pack(i[at]), pack_counts(np.maximum.reduceat(n, at)))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cards = [cardinality(r[3]) for r in rows]
            total = [int(np.frombuffer(r[4], dtype="<u4").sum()) if r[4] else c for r, c in zip(rows, cards, strict=True)]
            first = [int(r[2] << 16) + int(unpack(r[3])[0]) for r in rows]
            return batch_of(
                field=([r[0] for r in rows], pa.string()), entry=([r[1] for r in rows], pa.string()), occurrences=(total, pa.int64()), records=(cards, pa.int64()), first_id=(first, pa.int64()),
            )

        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    done.append(unite(held))
                    held = []
                held.append(row)
                if len(held) >= 64:
                    held = [unite(held)]
            if done:
                yield out(done)
        if held:
            yield out([unite(held)])

    sorted_rows = partial.repartition("field", "entry", "high").sortWithinPartitions("field", "entry", "high")
    return sorted_rows.mapInArrow(run, "field string, entry string, occurrences bigint, records bigint, first_id bigint")


def entry_statistics(partial: DataFrame) -> DataFrame:
    """field, entry, occurrences, records, first_id of every distinct entry, ALL included, read from the merged bitmaps."""
    return merged(partial).groupBy("field", "entry").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.min("first_id").alias("first_id"))


def marked(stats: DataFrame, field: str, rare: int | None, common: Callable[[int], int]) -> DataFrame:
    """Statistics of a field with its mark; common(N) gives the number of records from which an entry is common.

    stats is written to the shared folder first, because N, the cardinality of the bitmap of all records, is needed
    before its rows can be marked.
    """
    rows = stats.where(F.col("field") == field)
    n = rows.where(F.col("entry") == ALL).agg(F.sum("records")).first()[0] or 0
    mark = F.when(F.col("records") >= common(n), "common")
    if rare is not None:
        mark = F.when(F.col("records") < rare, "rare").otherwise(mark)
    return rows.where(F.col("entry") != ALL).withColumn("mark", mark)


def value_key(text: str):
    """128 bits that stand for a whole value while its bitmaps are built."""
    return F.md5(F.col(text))

