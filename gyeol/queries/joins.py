"""Joins and set operations over the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.operators import evaluate
from gyeol.queries.registry import Registry, compact
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""SELECT b.title, p.kind, count(*) AS n, round(avg(length(p.raw)), 6) AS mean_length FROM passages p JOIN (SELECT DISTINCT id, book_id FROM pages) g ON p.page_id = g.id JOIN books b ON g.book_id = b.id GROUP BY ALL""")
def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "book_id").distinct()
    books = table(spark, d, "books").select(F.col("id").alias("book_id"), "title")
    # partial sums by book before the titles come in
    joined = table(spark, d, "passages").select("page_id", "kind", F.length("raw").alias("n")).join(pages, "page_id")
    sums = joined.groupBy("book_id", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), F.count("n").alias("known"))
    return sums.join(books, "book_id").groupBy("title", "kind").agg(F.sum("rows").alias("n"), F.round(F.try_divide(F.sum("total"), F.sum("known")), 6).alias("mean_length"))


@query("""SELECT l_shipdate::DATE AS day, o_orderpriority, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    revenue = F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue")
    return li.join(o.join(c, "o_custkey"), "l_orderkey").groupBy(F.to_date("l_shipdate").alias("day"), "o_orderpriority").agg(revenue, F.count(F.lit(1)).alias("lines"))


@query("SELECT DISTINCT p.id, p.method FROM pages p LEFT JOIN page_quality q ON q.page_id = p.id WHERE q.page_id IS NULL")
def left_missing_ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("id", "method").join(table(spark, d, "page_quality").select(F.col("page_id").alias("id")), "id", "left_anti").distinct()


@query("SELECT DISTINCT digest FROM vectors WHERE digest NOT IN (SELECT digest FROM chunks WHERE digest IS NOT NULL)")
def orphan_prune(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors").select("digest").join(table(spark, d, "chunks").select("digest"), "digest", "left_anti").distinct()


@query("SELECT id, sha256(text) AS digest FROM chunks WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT digest FROM vectors)")
def resume_antijoin_by_digest(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "chunks").where("text IS NOT NULL").select("id", F.sha2("text", 256).alias("digest"))
    return new.join(table(spark, d, "vectors").select("digest"), "digest", "left_anti")


@query("SELECT id, page_id, kind FROM passages WHERE id IN (SELECT passage_id FROM chunks)")
def semi_join_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("id", "page_id", "kind").join(table(spark, d, "chunks").select(F.col("passage_id").alias("id")), "id", "left_semi")


@query("SELECT c.category, count(*) AS chunks, count(DISTINCT c.digest) AS digests FROM chunks c JOIN (SELECT DISTINCT digest FROM vectors) v USING (digest) GROUP BY c.category")
def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").select("digest").distinct()
    return table(spark, d, "chunks").select("digest", "category").join(v, "digest").groupBy("category").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("digest").alias("digests"))


_WRITTEN, _SPOKEN = "모음", "자음"


@query(f"SELECT id, compact LIKE '%{_WRITTEN}%{_SPOKEN}%' AS ordered, regexp_matches(compact, '{_WRITTEN}[가-힣]{{0,2}}[^가-힣]{{1,4}}{_SPOKEN}') AS close FROM pages WHERE contains(compact, '{_WRITTEN}') AND contains(compact, '{_SPOKEN}')")
def ordered_containment(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("compact")
    p = table(spark, d, "pages").where(c.contains(_WRITTEN) & c.contains(_SPOKEN))
    return p.select("id", c.like(f"%{_WRITTEN}%{_SPOKEN}%").alias("ordered"), c.rlike(f"{_WRITTEN}[가-힣]{{0,2}}[^가-힣]{{1,4}}{_SPOKEN}").alias("close"))


@query("""WITH gold AS (SELECT DISTINCT category AS query, g.book_id, g.pdf_page FROM chunks c JOIN pages g ON c.page_id = g.id WHERE length(c.text) > 640),
r AS (SELECT DISTINCT category AS query, g.book_id, g.pdf_page FROM chunks c JOIN pages g ON c.page_id = g.id WHERE contains(c.text, '운율'))
SELECT r.query, count(*) AS results, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM gold WHERE gold.query = r.query AND gold.book_id = r.book_id AND abs(gold.pdf_page - r.pdf_page) <= 1)) AS near FROM r WHERE r.query IS NOT NULL GROUP BY r.query""")
def tolerance_gold_match(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a word, and how many of them lie within a page of one with a long chunk, by category."""
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), F.col("book_id").alias("book"), "pdf_page").distinct()
    c = table(spark, d, "chunks").where("category IS NOT NULL").join(pages, "page_id").select(F.col("category").alias("query"), F.col("book").alias("book_id"), "pdf_page", "text")
    gold, results = (c.where(w).select("query", "book_id", "pdf_page").distinct() for w in (F.length("text") > 640, F.contains("text", F.lit("운율"))))
    near = evaluate.near_gold(results, gold).groupBy("query").agg(F.count(F.lit(1)).alias("near"))
    return results.groupBy("query").agg(F.count(F.lit(1)).alias("results")).join(near, "query", "left").select("query", "results", F.coalesce("near", F.lit(0)).alias("near"))


@query("SELECT digest FROM chunks WHERE digest IS NOT NULL INTERSECT SELECT digest FROM vectors")
def digest_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("digest IS NOT NULL").select("digest").intersect(table(spark, d, "vectors").select("digest"))


@query(f"""SELECT rule, n FROM (
SELECT 'repeated passage id' AS rule, count(*) AS n FROM (SELECT id FROM passages GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'display changes characters', count(*) FROM passages WHERE {compact('raw')} <> {compact('display')}
UNION ALL SELECT 'passage without page', count(*) FROM passages WHERE page_id NOT IN (SELECT id FROM pages)
UNION ALL SELECT 'page without book', count(*) FROM pages WHERE book_id NOT IN (SELECT id FROM books))""")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.violations(table(spark, d, "passages"), table(spark, d, "pages"), table(spark, d, "books"))


@query("""WITH new AS (SELECT word, n FROM source_words WHERE n IS NOT NULL), old AS (SELECT unnest(regexp_extract_all(display, '[가-힣]{2,}')) AS word FROM passages)
SELECT word, min(n) AS n, 'list' AS origin FROM new GROUP BY word UNION ALL SELECT word, count(*), 'text' FROM old WHERE word NOT IN (SELECT word FROM new) GROUP BY word HAVING count(*) >= 3""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a list, and those of the texts that it lacks, if they are frequent."""
    listed = table(spark, d, "source_words").where("n IS NOT NULL")
    seen = table(spark, d, "passages").select(F.explode(F.regexp_extract_all("display", F.lit("[가-힣]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    added = seen.where("n >= 3").join(listed.select("word"), "word", "left_anti").select("word", "n", F.lit("text").alias("origin"))
    return listed.groupBy("word").agg(F.min("n").alias("n")).select("word", "n", F.lit("list").alias("origin")).unionByName(added)


@query("SELECT s.s_suppkey, s.s_name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' AND l.l_quantity > 49)")
def suppliers_without_returns(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", "s_name").join(r, "s_suppkey", "left_anti")
