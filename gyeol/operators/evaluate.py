"""Measures of retrieval, copying and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.functions.text import compact


def retrieval_metrics(ranks: DataFrame, by: str, query: str, rank: str) -> DataFrame:
    """hit@1, 3, 8 and mean reciprocal rank; a query without a relevant result has a null rank and counts as a miss."""
    first = ranks.groupBy(by, query).agg(F.min(rank).alias("r"))
    hit = lambda k: F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"hit{k}")
    return first.groupBy(by).agg(hit(1), hit(3), hit(8), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("queries"))


def copied_share(notes: DataFrame, sources: DataFrame, key: str, on: str, note: str, source: str, run: int = 20) -> DataFrame:
    """key, share: share of the characters of a note inside runs of `run` characters that its source has.

    Runs join by (source, run); the union of the covered places is counted from the ordered starts, without listing
    the places. Notes shorter than a run share nothing.
    """
    grams = lambda df, c, *cols: df.where(F.length(c) >= run).select(*cols, F.posexplode(F.expr(f"transform(sequence(1, length({c}) - {run - 1}), i -> xxhash64(substring({c}, i, {run})))")).alias("at", "g"))
    n = notes.select(key, on, compact(F.col(note)).alias("_n"))
    s = sources.select(on, compact(F.col(source)).alias("_s"))
    hits = grams(n, "_n", key, on).join(grams(s, "_s", on).select(on, "g").distinct(), [on, "g"], "left_semi")
    starts = hits.groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("a"))
    covered = F.expr(f"aggregate(a, named_struct('n', 0, 'last', -{run}), (x, i) -> named_struct('n', x.n + least({run}, i - x.last), 'last', i), x -> x.n)")
    lengths = n.groupBy(key).agg(F.max(F.length("_n")).alias("length"))
    return lengths.join(starts.select(key, covered.alias("covered")), key, "left").select(key, F.coalesce(F.try_divide("covered", "length"), F.lit(0.0)).alias("share"))


def bands(df: DataFrame, share: str) -> DataFrame:
    band = F.when(F.col(share) >= 0.6, "0.6").when(F.col(share) >= 0.3, "0.3").when(F.col(share) >= 0.2, "0.2").otherwise("0")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def near_gold(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results on a gold page or beside one, in the same book: an equi join on the book and the three pages."""
    around = gold.select("query", "book_id", F.explode(F.sequence(F.col("pdf_page") - 1, F.col("pdf_page") + 1)).alias("pdf_page")).distinct()
    return results.join(around, ["query", "book_id", "pdf_page"], "left_semi")


def violations(passages: DataFrame, pages: DataFrame, books: DataFrame) -> DataFrame:
    """rule, n: rows that break a rule of the library."""
    one = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    repeated = passages.groupBy("id").count().where("count > 1")
    changed = passages.where(compact(F.col("raw")) != compact(F.col("display")))
    no_page = passages.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_anti")
    no_book = pages.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti")
    return one(repeated, "repeated passage id").unionByName(one(changed, "display changes characters")).unionByName(one(no_page, "passage without page")).unionByName(one(no_book, "page without book"))
