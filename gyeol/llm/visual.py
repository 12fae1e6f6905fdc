"""Problem 7: one consistent form of texts that look the same but are stored in different characters.

Texts are exploded to positioned code points (one array for a whole Arrow batch), mapped by decomposition and
look-alike tables that every task holds, combining marks are ordered by class, code points recomposed, and strings
rebuilt. Texts that hold nothing the tables map stay in the JVM and are their own form.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.textio import arrow_map, batch_of, slices

#: Letters of other scripts that print as the Latin letter below them.
LOOK_ALIKE = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюяѕіјһԁԛԝѵАВЕЅІЈКМНОРСТУХҮԌԚԜαινορυγκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϹϳ‐‑‒−ˊ"
        "օոսհզցյՕՏᎪᎳᎷᎬᎢᎫᏟᎠᏚᏢᏀᎻᏦᏃᏞᏙᏴᎡ",
        "aбвгдeёжзийклмнoпpcтyфxцчшщъыьэюяsijhdqwvABESIJKMHOPCTYXYGQWαivopuγκABEZHIKMNOPTYXcCj----´"
        "onuhqgjOSAWMETJCDSPGHKZLVBR",
        strict=True,
    )
)
NO_GLYPH = {"Cf"}
#: Compatibility kinds that change only the width, the breaking or the typeface of a character, not which one it is.
WIDTH_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
SPACE = ord(" ")


@functools.lru_cache(maxsize=1)
def mapping() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its place in the targets, -1 if it maps to itself; and for each place (start, end, points).

    A target is the full canonical decomposition after folding widths and look-alikes; a character without a glyph
    has an empty one, a space of any kind or width other than the line feed one space.
    """

    def fold(ch: str) -> str:
        if "가" <= ch <= "힣":
            return ch
        if unicodedata.category(ch) in NO_GLYPH or ch in "ᅟᅠㅤﾠ͏" or "︀" <= ch <= "️":
            return ""
        if ch != "\n" and ch.isspace():
            return " "
        d = unicodedata.decomposition(ch)
        if not d:
            return LOOK_ALIKE.get(ch, ch)
        kind, *points = d.split() if d[0] == "<" else ("", *d.split())
        if kind and kind not in WIDTH_KINDS and not "ﬀ" <= ch <= "ﬆ":
            return LOOK_ALIKE.get(ch, ch)
        return "".join(fold(chr(int(p, 16))) for p in points)

    place = np.full(sys.maxunicode + 1, -1, dtype=np.int32)
    start, flat = [0], []
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000 or 0xE000 <= o < 0xF900 or o >= 0x30000 and o < 0xE0000:
            continue
        ch = chr(o)
        to = fold(ch)
        if to != ch:
            place[o] = len(start) - 1
            flat += map(ord, to)
            start.append(len(flat))
    return place, np.array(start), np.array(flat, dtype=np.uint32)


@functools.lru_cache(maxsize=1)
def marks() -> np.ndarray:
    """The combining class of each code point."""
    of = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for o in range(0x300, 0x20000):
        if c := unicodedata.combining(chr(o)):
            of[o] = c
    return of


@functools.lru_cache(maxsize=1 << 16)
def _pair(a: int, b: int) -> int:
    c = unicodedata.normalize("NFC", chr(a) + chr(b))
    return ord(c) if len(c) == 1 else -1


def recompose(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining jamo and combining marks joined to the character before them, within one owner."""
    for low, high in ((0x1161, 0x1175), (0x11A8, 0x11C2)):
        at = np.flatnonzero((points[1:] >= low) & (points[1:] <= high) & (owner[1:] == owner[:-1])) + 1
        before = points[at - 1]
        if low == 0x1161:
            ok = (before >= 0x1100) & (before <= 0x1112)
            joined = 0xAC00 + ((before - 0x1100) * 21 + (points[at] - 0x1161)) * 28
        else:
            ok = (before >= 0xAC00) & (before <= 0xD7A3) & ((before - 0xAC00) % 28 == 0)
            joined = before + (points[at] - 0x11A7)
        at, joined = at[ok], joined[ok]
        points[at - 1] = joined
        stay = np.ones(len(points), dtype=bool)
        stay[at] = False
        points, owner = points[stay], owner[stay]
    cls = marks()[points]
    spots = np.flatnonzero(cls)
    if not len(spots):
        return points, owner
    # marks of one base stand in canonical order already; the few spots that have any are joined one by one
    stay = np.ones(len(points), dtype=bool)
    base, last = -1, 0
    previous = -2
    for i in spots.tolist():
        if i != previous + 1 or owner[i] != owner[i - 1]:
            base, last = (i - 1, 0) if i and owner[i - 1] == owner[i] else (-1, 0)
        previous = i
        if base < 0:
            continue
        if last < cls[i] or last == 0:
            c = _pair(int(points[base]), int(points[i]))
            if c >= 0:
                points[base], stay[i] = c, False
                continue
        last = cls[i]
    return points[stay], owner[stay]


def canonical(texts: list[str]) -> list[str]:
    """The consistent form of each text; equal for texts that look the same, line breaks included."""
    return [f for part in slices(texts) for f in _canonical(part)]


def _canonical(texts: list[str]) -> list[str]:
    place, start, flat = mapping()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    to = place[points]
    hit = to >= 0
    if hit.any():
        size = np.where(hit, start[np.where(hit, to + 1, 0)] - start[np.where(hit, to, 0)], 1)
        at = np.repeat(np.cumsum(size) - size, size)
        within = np.arange(int(size.sum())) - at
        source = np.repeat(np.arange(len(points)), size)
        mapped = flat[np.minimum(np.where(hit[source], start[np.where(hit, to, 0)][source] + within, 0), len(flat) - 1)]
        points = np.where(hit[source], mapped, points[source]).astype(np.uint32)
        owner = owner[source]
    cls = marks()[points]
    if cls.any():  # canonical order: stable by class within each run of marks
        run = np.cumsum((cls == 0) | np.r_[True, owner[1:] != owner[:-1]])
        order = np.lexsort((np.arange(len(points)), cls, run))
        points, owner = points[order], owner[order]
    points, owner = recompose(points.astype(np.int64), owner)
    # a run of spaces is as wide as it likes; at the ends of a line it can't be seen
    space, feed = points == SPACE, points == 10
    edge = np.r_[True, (owner[1:] != owner[:-1]) | feed[:-1]]
    drop = space & (edge | np.r_[False, space[:-1] & (owner[1:] == owner[:-1])])
    while True:  # spaces after a dropped leading one are leading too
        more = space & ~drop & np.r_[False, drop[:-1] & (owner[1:] == owner[:-1])] & np.r_[False, edge[:-1] & drop[:-1]]
        if not more.any():
            break
        drop |= more
    points, owner = points[~drop], owner[~drop]
    tail = np.r_[(owner[1:] != owner[:-1]) | (points[1:] == 10), True] if len(points) else np.zeros(0, dtype=bool)
    keep = ~((points == SPACE) & tail)
    points, owner = points[keep], owner[keep]
    ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
    whole = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


#: A text of only these characters, without runs of spaces and spaces at the ends of lines, is its own form.
STABLE = r"\n -~가-힣一-鿿ぁ-ゖァ-ヺก-ะเ-ๆ。、「」『』“”‘’·…"
NEEDS_MAPPING = rf"[^{STABLE}]|  |(?:^|\n) | (?:\n|$)"


def consistent_form(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys and `form`, the consistent form of text; null for null, empty for a text without anything to see."""
    df = df.select(*keys, F.col(text).alias("_text"))
    touched = F.col("_text").rlike(NEEDS_MAPPING)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(**{k: batch.column(i) for i, k in enumerate(keys)}, form=(canonical(batch.column(len(keys)).to_pylist()), pa.string()))

    mapped = arrow_map(df.where(touched), run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "form string"]))
    return df.where(~F.coalesce(touched, F.lit(False))).select(*keys, F.col("_text").alias("form")).unionByName(mapped)
