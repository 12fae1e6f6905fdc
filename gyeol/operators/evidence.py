"""Evidence: round robin over searches, budgets, quotes, citations and answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyeol.functions.text import bigrams, compact

MOST_PAGES, MOST_CHARS, MOST_RESULTS, BOOK_SHARE = 32, 95_000, 24, 0.45

#: The answer of a model: nested JSON of fixed shape.
ANSWER = (
    "id string, title string, insufficient boolean, "
    "sections array<struct<title:string,points:array<struct<text:string,citations:array<struct<source:string,quote:string>>>>>>"
)


def interleaved(df: DataFrame, lists: str, position: str, item: str, by: list[str]) -> DataFrame:
    """Rank 0 of each list of a question, then rank 1 and so on; an item keeps its first place."""
    first = df.groupBy(*by, item).agg(F.min(F.struct(position, lists)).alias("_o"))
    w = Window.partitionBy(*by).orderBy("_o")
    return first.withColumn("rank", F.row_number().over(w)).drop("_o")


def round_robin(df: DataFrame, by: str, book: str, rank: str, group: str, limit: int = MOST_RESULTS) -> DataFrame:
    """Results of several searches in turn: within the cap of each book first, then the others, up to a limit.

    df has one row for each (by, result); by is a question, so that a window holds one question's results.
    """
    cap = round(limit * BOOK_SHARE)
    order = [(F.col(rank) >= 8).cast("int"), F.col(rank), F.col(group), F.col("id")]
    in_book = F.row_number().over(Window.partitionBy(by, book).orderBy(*order))
    capped = df.withColumn("_over", (in_book > cap).cast("int"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_over", *order))
    return capped.withColumn("place", place).where(F.col("place") <= limit).drop("_over")


def within_budget(df: DataFrame, by: str, order: str, chars: str, pages: int = MOST_PAGES, most: int = MOST_CHARS) -> DataFrame:
    """Rows taken in order while they fit: one that doesn't fit is skipped and the next is tried, so no prefix sum.

    One question's candidates are one group; their number is bounded by the searches' limits.
    """
    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used, count, keep = 0, 0, []
        for n in pdf.sort_values(order)[chars]:
            ok = count < pages and used + n <= most
            keep.append(ok)
            used, count = used + n * ok, count + ok
        return pdf.sort_values(order)[keep]

    return df.groupBy(by).applyInPandas(take, df.schema)


def best_quote(claims: DataFrame, quotes: DataFrame, on: str) -> DataFrame:
    """on, claim_id, quote: the quote that shares most pairs of characters with the claim, for its length.

    Ties go to the length nearest to 260, then to the smaller text.
    """
    c = claims.withColumn("_b", bigrams(F.col("claim")))
    q = quotes.withColumn("_q", bigrams(F.col("quote")))
    score = F.size(F.array_intersect("_b", "_q")) / (F.sqrt(F.size("_q").cast("double")) + 1)
    joined = c.join(q, on).withColumn("score", score)
    w = Window.partitionBy(on, "claim_id").orderBy(F.desc("score"), F.abs(F.length("quote") - 260), F.asc("quote"))
    return joined.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(on, "claim_id", "quote", "score")


def claims_of(answers: DataFrame) -> DataFrame:
    """id, section, point, text, citations: the claims of parsed answers as rows."""
    sections = answers.select("id", F.posexplode("sections").alias("section", "s"))
    return sections.select("id", "section", F.posexplode("s.points").alias("point", "p")).select("id", "section", "point", F.col("p.text").alias("text"), F.col("p.citations").alias("citations"))


def validated(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claims with `valid`: every citation names a source and quotes 20 to 500 characters that stand in it, or quotes
    nothing; a claim with any invalid citation, or with none, is rejected. sources: source, text."""
    cited = claims.select("id", "section", "point", F.explode_outer("citations").alias("c")).select("id", "section", "point", F.col("c.source").alias("source"), F.coalesce("c.quote", F.lit("")).alias("quote"))
    held = cited.join(sources.select("source", compact(F.col("text")).alias("_t"), F.lit(True).alias("_known")), "source", "left")
    ok = F.col("_known") & ((F.col("quote") == "") | (F.length("quote").between(20, 500) & F.contains("_t", compact(F.col("quote")))))
    verdict = held.groupBy("id", "section", "point").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("valid"), F.count("source").alias("cited"))
    return claims.join(verdict, ["id", "section", "point"]).withColumn("valid", F.col("valid") & (F.col("cited") > 0))


def volumes_missing(texts: DataFrame, books: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of texts that name a volume of a known series which the library doesn't have. books: stem, volume."""
    named = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"([가-힣]{4,})\s?(\d)"), F.lit(0))).alias("x"))
    named = named.select(key, F.regexp_extract("x", r"^[가-힣]+", 0).alias("stem"), F.regexp_extract("x", r"\d$", 0).cast("int").alias("volume"))
    known = named.join(books.select("stem").distinct(), "stem", "left_semi")
    return known.join(books, ["stem", "volume"], "left_anti").select(key, "stem", "volume").distinct()


def without_meta(text):
    """A text without the sentences that name the process instead of the subject."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.array_join(F.filter(sentences, lambda s: ~s.rlike("제공된 (자료|근거)|근거 자료|검색 결과|주어진 (자료|문서)")), " ")


def collected(searches: list[DataFrame], pages: DataFrame, most: int = MOST_RESULTS, budget: tuple[int, int] = (MOST_PAGES, MOST_CHARS)) -> DataFrame:
    """page_id, place, chars: the pages of the evidence for a planned question.

    searches: ranked results (id, page_id, book_id, rank) of each planned search, few rows each; pages: id, book_id,
    pdf_page, chars. Results are taken in turn with a cap for each book, then the page after and the page before each chosen one, and of
    all these what fits into the pages and characters allowed.
    """
    from functools import reduce

    from gyeol.operators.pages import adjacent

    ranked = [s.select(F.lit("q").alias("question"), F.lit(i).alias("grp"), "book_id", "id", "page_id", (F.col("rank") - 1).alias("rank")) for i, s in enumerate(searches)]
    chosen = round_robin(reduce(lambda a, b: a.unionByName(b), ranked), "question", "book_id", "rank", "grp", most)
    first = chosen.groupBy("page_id").agg(F.min("place").alias("place"))
    at = first.join(pages.select(F.col("id").alias("page_id"), "book_id", "pdf_page"), "page_id")
    beside = adjacent(at.select("book_id", "pdf_page"), pages.select("id", "book_id", "pdf_page")).select(F.col("id").alias("page_id"), F.when(F.col("side") == "next", 1).otherwise(2).alias("turn"))
    # pages beside a chosen one come after all chosen ones, those that follow first
    wanted = first.select("page_id", F.lit(0).alias("turn"), "place").unionByName(beside.select("page_id", "turn", F.lit(0).alias("place")))
    order = wanted.groupBy("page_id").agg(F.min(F.struct("turn", "place", "page_id")).alias("o"))
    w = Window.partitionBy(F.lit(0)).orderBy("o")  # three pages for each of `most` results
    rows = order.join(pages.select(F.col("id").alias("page_id"), "chars"), "page_id").select(F.lit("q").alias("question"), "page_id", F.row_number().over(w).alias("place"), "chars")
    return within_budget(rows, "question", "place", "chars", *budget).drop("question")
