"""Positioned lines to passages in reading order: one page is one group."""

from __future__ import annotations

import re
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a page's width, height and type size that decide a line's lane and a passage's end.
WIDE, TOP, BOTTOM, MARGIN_TOP, MARGIN_BOTTOM, NOTE_LEFT, NOTE_SIZE, CELL_GAP, LINE_GAP, INDENT, LONG = 0.48, 0.07, 0.9, 0.06, 0.93, 0.21, 0.77, 1.8, 1.25, 0.8, 800
SCHEMA = "page_id bigint, ordinal int, lane string, raw string, cells int, x0 double, y0 double, x1 double, y1 double"


def lines_of(pages: DataFrame) -> DataFrame:
    """page_id, width, height, text, x0, y0, x1, y1, size of every line from nested layout blocks; images are skipped.

    pages: page_id, width, height, blocks array<struct<type, lines array<struct<bbox, spans array<struct<text, size>>>>>>.
    """
    blocks = pages.select("page_id", "width", "height", F.explode("blocks").alias("b")).where("b.type = 0")
    lines = blocks.select("page_id", "width", "height", F.explode("b.lines").alias("l"))
    text = F.trim(F.array_join(F.transform("l.spans", lambda s: s["text"]), ""))
    sizes = F.array_sort(F.transform("l.spans", lambda s: s["size"]))
    half = F.floor(F.size(sizes) / 2).cast("int")
    size = F.when(F.size(sizes) % 2 == 1, F.get(sizes, half)).otherwise((F.get(sizes, half - 1) + F.get(sizes, half)) / 2)
    box = [F.get("l.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return lines.select("page_id", "width", "height", text.alias("text"), *box, size.alias("size")).where("text <> ''")


def _lane(line, left: float, size: float, width: float, height: float) -> str:
    if (line.y1 < height * MARGIN_TOP or line.y0 > height * MARGIN_BOTTOM) and len(line.text) < 130:
        return "margin"
    beside = left > width * NOTE_LEFT and line.x1 < left - 3
    return "note" if beside or line.size < size * NOTE_SIZE else "body"


def _baselines(lines: list, size: float) -> list[dict]:
    """Lines on one baseline become one row, cells apart by more than the type size separated by a tab."""
    rows: list[dict] = []
    for ln in sorted(lines, key=lambda x: (round(x.y0 / 3), x.x0)):
        last = rows[-1] if rows else None
        if last and abs(ln.y0 - last["y0"]) < max(3, ln.size * 0.4):
            last["parts"].append(ln)
            last.update(x0=min(last["x0"], ln.x0), y0=min(last["y0"], ln.y0), x1=max(last["x1"], ln.x1), y1=max(last["y1"], ln.y1))
        else:
            rows.append({"parts": [ln], "x0": ln.x0, "y0": ln.y0, "x1": ln.x1, "y1": ln.y1})
    for r in rows:
        parts = sorted(r["parts"], key=lambda x: x.x0)
        gaps = ["\t" if b.x0 - a.x1 > size * CELL_GAP else " " for a, b in zip(parts, parts[1:], strict=False)]
        r["text"] = parts[0].text + "".join(g + p.text for g, p in zip(gaps, parts[1:], strict=True))
        r["cells"] = 1 + gaps.count("\t")
    return rows


def _page(pdf: pd.DataFrame) -> pd.DataFrame:
    width, height = float(pdf["width"].iloc[0]), float(pdf["height"].iloc[0])
    lines = list(pdf.itertuples(index=False))
    wide = [x for x in lines if x.x1 - x.x0 > width * WIDE and height * TOP < x.y0 < height * BOTTOM]
    left = median(x.x0 for x in wide) if wide else width * 0.1
    size = median(x.size for x in (wide or lines))
    found = []
    for lane in ("body", "note", "margin"):
        block: list[dict] = []
        blocks = [block]
        for row in _baselines([x for x in lines if _lane(x, left, size, width, height) == lane], size):
            if block:
                above = block[-1]
                ended = row["x0"] - left > size * INDENT and re.search(r"[다요][.!?。]?\s*$", above["text"])
                if row["y0"] - above["y1"] > size * LINE_GAP or ended or (row["cells"] >= 3) != (above["cells"] >= 3) or sum(len(r["text"]) for r in block) > LONG:
                    block = []
                    blocks.append(block)
            block.append(row)
        for b in filter(None, blocks):
            box = (min(r["x0"] for r in b), min(r["y0"] for r in b), max(r["x1"] for r in b), max(r["y1"] for r in b))
            found.append((lane, "\n".join(r["text"] for r in b), sum(r["cells"] >= 3 for r in b), *box))
    found.sort(key=lambda p: (p[0] == "margin", p[0] == "note", p[4], p[3]))
    page = int(pdf["page_id"].iloc[0])
    return pd.DataFrame([(page, i, *p) for i, p in enumerate(found)], columns=["page_id", "ordinal", "lane", "raw", "cells", "x0", "y0", "x1", "y1"])


def passages(lines: DataFrame) -> DataFrame:
    """Passages of every page in reading order: body, then notes, then margins. A page without lines has none."""
    return lines.groupBy("page_id").applyInPandas(_page, SCHEMA)
