"""Window-shaped page logic: confirmed numbers, gaps, offsets, neighbours, propagation and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_row_per_page(pages: DataFrame) -> DataFrame:
    """Pages scanned twice count once: the row of the smallest id stays."""
    return pages.withColumn("_r", F.row_number().over(Window.partitionBy("book_id", "pdf_page").orderBy("id"))).where("_r = 1").drop("_r")


def neighbour_confirmed(pages: DataFrame) -> DataFrame:
    """book_id, pdf_page, candidate where the page before has the number before and the page after the number after.

    Equi joins on book, page and number, so that no book's pages meet in one task.
    """
    rows = pages.select("book_id", "pdf_page", "candidate").where("candidate <> 0")
    beside = lambda step: pages.select("book_id", (F.col("pdf_page") + step).alias("pdf_page"), (F.col("candidate") + step).alias("candidate"))
    keys = ["book_id", "pdf_page", "candidate"]
    return rows.join(beside(1), keys, "left_semi").join(beside(-1), keys, "left_semi")


#: Pages of a book that one task orders at a time.
BLOCK = 4096


def gap_fill(pages: DataFrame, confirmed: str = "printed_page") -> DataFrame:
    """book_id, pdf_page, number, status: unconfirmed pages between two confirmed ones of equal offset are filled.

    A book is ordered block by block; the last and first offset of each block are carried over to its neighbours.
    """
    p = F.col("pdf_page")
    offset = F.when(F.coalesce(F.col(confirmed), F.lit(0)) != 0, p - F.col(confirmed))
    rows = pages.select("book_id", "pdf_page", F.col(confirmed).alias("_n"), offset.alias("_o"), F.floor(p / BLOCK).alias("_b"))
    ends = rows.groupBy("book_id", "_b").agg(F.max_by("_o", F.when(F.col("_o").isNotNull(), p)).alias("_last"), F.min_by("_o", F.when(F.col("_o").isNotNull(), p)).alias("_first"))
    blocks = Window.partitionBy("book_id").orderBy("_b")
    carried = ends.select(
        "book_id", "_b", F.last("_last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_after")
    )
    rows = rows.join(carried, ["book_id", "_b"])
    within = Window.partitionBy("book_id", "_b").orderBy("pdf_page")
    lo = F.coalesce(F.last("_o", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "_before")
    hi = F.coalesce(F.first("_o", ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing)), "_after")
    status = F.when(F.col("_o").isNotNull(), "confirmed").when(lo == hi, "offset")
    number = F.when(F.col("_o").isNotNull(), F.col("_n")).when(lo == hi, p - lo)
    return rows.select("book_id", "pdf_page", number.cast("int").alias("number"), status.alias("status"))


def mode_offset(pages: DataFrame, number: str = "printed_page") -> DataFrame:
    """The most common offset of each book, ties to the one seen first."""
    rows = pages.where(F.coalesce(number, F.lit(0)) != 0).select("book_id", "pdf_page", (F.col("pdf_page") - F.col(number)).alias("offset"))
    counts = rows.groupBy("book_id", "offset").agg(F.count(F.lit(1)).alias("n"), F.min("pdf_page").alias("first_page"))
    w = Window.partitionBy("book_id").orderBy(F.desc("n"), F.asc("first_page"), F.asc("offset"))
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("book_id", "offset", "n")


def best_offset(pages: DataFrame, low: int = 0, high: int = 40, least: int = 1) -> DataFrame:
    """The offset from a grid that most candidates agree with; the lowest wins ties."""
    near = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda o: o == F.col("pdf_page") - F.col("candidate"))
    hits = pages.where("candidate IS NOT NULL").select("book_id", F.explode(near).alias("offset")).groupBy("book_id", "offset").agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy("book_id").orderBy(F.desc("hits"), F.asc("offset"))
    return hits.withColumn("r", F.row_number().over(w)).where((F.col("r") == 1) & (F.col("hits") >= least)).drop("r")


def adjacent(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """The page after and the page before each selected page of a book: an equi join on (book, page)."""
    wanted = selected.select("book_id", F.explode(F.array(F.struct((F.col("pdf_page") + 1).alias("pdf_page"), F.lit("next").alias("side")), F.struct((F.col("pdf_page") - 1).alias("pdf_page"), F.lit("previous").alias("side")))).alias("x"))
    return wanted.select("book_id", "x.pdf_page", "x.side").join(pages, ["book_id", "pdf_page"])


def missing_pages(pages: DataFrame) -> DataFrame:
    """Numbers between the first and the last page of a book that no page has."""
    ends = pages.groupBy("book_id").agg(F.min("pdf_page").alias("a"), F.max("pdf_page").alias("b"))
    return ends.select("book_id", F.explode(F.sequence("a", "b")).alias("pdf_page")).join(pages.select("book_id", "pdf_page"), ["book_id", "pdf_page"], "left_anti")


def propagated(df: DataFrame, by: str, order: str, starts, apply_to) -> DataFrame:
    """Everything at or after the first row of a group where `starts` holds, if `apply_to` holds: a flag."""
    first = F.min(F.when(starts, F.col(order))).over(Window.partitionBy(by))
    return df.withColumn("propagated", F.coalesce((F.col(order) >= first) & apply_to, F.lit(False)))


def previous_clean(df: DataFrame, by: list[str], order: str, text: str, skip) -> DataFrame:
    """The row before within a group, null where that row is to be skipped."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("previous", F.lag(F.when(~skip, F.col(text))).over(w))


def continued(df: DataFrame, by: list[str], order: str, text: str, stop, most: int = 420) -> DataFrame:
    """A row with up to two that follow it, while none is a stop and the whole stays short enough."""
    w = Window.partitionBy(*by).orderBy(order)
    one, two = F.lead(F.when(~stop, F.col(text))).over(w), F.lead(F.when(~stop, F.col(text)), 2).over(w)
    first = F.when(F.length(text) + 1 + F.length(one) <= most, F.concat_ws(" ", text, one))
    second = F.when(F.length(first) + 1 + F.length(two) <= most, F.concat_ws(" ", first, two))
    return df.withColumn("continued", F.coalesce(second, first, F.col(text)))


def captions(tables: DataFrame, titles: DataFrame, by: str, order: str) -> DataFrame:
    """The k-th caption with the k-th table of a page, only where a page has as many of both."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy(order)
        return df.select(by, F.col("id").alias(f"{name}_id"), F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("n"))

    return numbered(tables, "table").join(numbered(titles, "caption"), [by, "k", "n"])


def islands(df: DataFrame, by: list[str], order: str, boundary) -> DataFrame:
    """A running number of blocks; boundary says whether a row begins a new one."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("block", F.sum(F.when(boundary, 1).otherwise(0)).over(w))
