"""Problem 1: oversized items cut into overlapping pieces at natural boundaries.

Recursive bisection: the strongest boundary near the midpoint is cut, halves that are still longer than the limit
minus the overlap are cut again, then every piece but the first is extended backwards by the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.textio import arrow_map, batch_of

LIMIT, OVERLAP = 640, 80

#: Strength of a boundary, strongest first: empty line, line end, sentence end, clause mark, white space.
_BOUNDARY = re.compile(
    r"(?P<p>\s*\n\s*\n\s*)|(?P<l>[^\S\n]*\n[^\S\n]*)|(?P<s>[.!?…]+[\"”’»)\]」』〉》]*\s+|[。！？]+[”’」』）〉》]*\s*)|(?P<c>[,;:]\s+|[，；：、]\s*)|(?P<w>\s+)"
)
_STRENGTH = {"p": 5, "l": 3, "s": 4, "c": 2, "w": 1}
#: Between two of these there is a way to cut: white space, or an end mark.
_RUN_BREAK = re.compile(r"[\s.!?。！？]+")


def boundaries(text: str) -> tuple[list[int], np.ndarray]:
    """Positions at which a piece may begin, ascending, and the strength of each."""
    at, strength = [], []
    for m in _BOUNDARY.finditer(text):
        if 0 < m.end() < len(text):
            at.append(m.end())
            strength.append(_STRENGTH[m.lastgroup])
    return at, np.array(strength, dtype=np.int8)


def runs(text: str) -> tuple[int, int, int]:
    """Code points before the first white space or end mark, after the last one, and of the longest stretch between two.

    A text without any is one stretch: it counts as its beginning, and its end is -1.
    """
    longest, first, last = 0, -1, 0
    for m in _RUN_BREAK.finditer(text):
        if first < 0:
            first = m.start()
        else:
            longest = max(longest, m.start() - last)
        last = m.end()
    return (len(text), -1, 0) if first < 0 else (first, len(text) - last, longest)


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, core start, end, strength of the cut at core start) of the pieces, in order.

    The stretches from core start to end tile the text; start lies at most `overlap` before core start, at a
    boundary if there is one. Strength 0 is a forced cut. An empty text is one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")
    if len(text) <= limit:
        return [(0, 0, len(text), 5)]
    core = limit - overlap
    at, strength = boundaries(text)
    cuts: list[tuple[int, int]] = [(0, 5)]
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= core:
            continue
        mid, near = (lo + hi) // 2, max(1, (hi - lo) // 4)
        cut, kind = mid, 0
        for nearby, a, b in ((True, max(lo + 1, mid - near), min(hi - 1, mid + near)), (False, lo + 1, hi - 1)):
            i, j = bisect_left(at, a), bisect_right(at, b)
            if i < j:
                best = strength[i:j].max() if nearby else None
                rows = [k for k in range(i, j) if best is None or strength[k] == best]
                k = min(rows, key=lambda k: (abs(at[k] - mid), at[k]))
                cut, kind = at[k], int(strength[k])
                break
        cuts.append((cut, kind))
        todo += [(lo, cut), (cut, hi)]
    cuts.sort()
    out = []
    for k, (start, kind) in enumerate(cuts):
        end = cuts[k + 1][0] if k + 1 < len(cuts) else len(text)
        back = start
        if k and overlap:
            back = max(0, start - overlap)
            i = bisect_left(at, back)
            if i < len(at) and at[i] < start:
                back = at[i]
        out.append((back, start, end, kind))
    return out


def split_items(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = False) -> DataFrame:
    """keys, piece_no, start_pos, core_pos, end_pos, forced (the cut before it has no boundary), head_run, tail_run,
    inner_run (stretches of its core, by `runs`), piece.

    Null texts give no row, an empty text one empty piece, repeated rows repeated pieces. Texts within the limit
    never leave the JVM and have no stretches. keys are columns of df whose names must not be those of the result.
    """
    df = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numbers = ["piece_no", "start_pos", "core_pos", "end_pos", "head_run", "tail_run", "inner_run"]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} int" for n in numbers), "forced boolean, piece string"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, columns, forced, piece = [], [], [], []
        for i, t in enumerate(batch.column(len(keys)).to_pylist()):
            for n, (a, b, e, kind) in enumerate(split_spans(t, limit, overlap)):
                rows.append(i), columns.append((n, a, b, e, *runs(t[b:e]))), forced.append(kind == 0), piece.append(t[a:e])
        take = pa.array(rows, pa.int64())
        by = list(zip(*columns, strict=True)) or [()] * len(numbers)
        return batch_of(**{k: batch.column(j).take(take) for j, k in enumerate(keys)}, **{n: (list(c), pa.int32()) for n, c in zip(numbers, by, strict=True)}, forced=(forced, pa.bool_()), piece=(piece, pa.string()))

    long = arrow_map(df.where(F.length("_text") > limit), cut, schema)
    if only_long:
        return long
    no = F.lit(None).cast("int")
    short = df.where(F.length("_text") <= limit).select(
        *keys, F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), F.lit(0).alias("core_pos"), F.length("_text").alias("end_pos"),
        no.alias("head_run"), no.alias("tail_run"), no.alias("inner_run"), F.lit(False).alias("forced"), F.col("_text").alias("piece"),
    )
    return short.unionByName(long)


def longest_runs(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys and longest_run: the longest stretch of each item without a way to cut, put together from its pieces.

    Copies of an item give the same pieces again, which count once.
    """
    state = "named_struct('open', 0, 'longest', 0)"
    add = """(s, p) -> named_struct(
        'open', IF(p.tail_run < 0, s.open + p.head_run, p.tail_run),
        'longest', greatest(s.longest, s.open + p.head_run, p.inner_run, p.tail_run))"""
    of = pieces.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("piece_no", "head_run", "tail_run", "inner_run"))).alias("_p"))
    return of.select(*keys, F.expr(f"aggregate(_p, {state}, {add}).longest").alias("longest_run"))
