"""Page numbers, page order and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.functions.text import EXERCISE, compact
from gyeol.operators import layout, pages
from gyeol.queries.registry import Registry
from gyeol.queries.registry import compact as compact_sql
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_ONE = "one AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY book_id, pdf_page ORDER BY id) = 1)"


def _one(spark: SparkSession, d: str) -> DataFrame:
    return pages.one_row_per_page(table(spark, d, "pages").select("id", "book_id", "pdf_page", "printed_page", "candidate", "number_status"))


@query(f"WITH {_ONE} SELECT p.book_id, p.pdf_page, p.candidate FROM one p JOIN one a ON a.book_id = p.book_id AND a.pdf_page = p.pdf_page - 1 AND a.candidate = p.candidate - 1 JOIN one b ON b.book_id = p.book_id AND b.pdf_page = p.pdf_page + 1 AND b.candidate = p.candidate + 1 WHERE p.candidate <> 0")
def neighbour_confirmed(spark: SparkSession, d: str) -> DataFrame:
    return pages.neighbour_confirmed(_one(spark, d))


@query(f"""WITH {_ONE}, o AS (SELECT *, CASE WHEN coalesce(printed_page, 0) <> 0 THEN pdf_page - printed_page END AS o FROM one),
f AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY pdf_page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
  first_value(o IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY pdf_page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM o)
SELECT book_id, pdf_page, CASE WHEN o IS NOT NULL THEN printed_page WHEN lo = hi THEN pdf_page - lo END AS number, CASE WHEN o IS NOT NULL THEN 'confirmed' WHEN lo = hi THEN 'offset' END AS status FROM f""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return pages.gap_fill(_one(spark, d))


@query(f"""WITH {_ONE}, c AS (SELECT book_id, pdf_page - printed_page AS "offset", count(*) AS n, min(pdf_page) AS f FROM one WHERE coalesce(printed_page, 0) <> 0 GROUP BY ALL)
SELECT book_id, "offset", n FROM c QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n DESC, f, "offset") = 1""")
def mode_offset(spark: SparkSession, d: str) -> DataFrame:
    return pages.mode_offset(_one(spark, d))


@query(f"""WITH {_ONE}, h AS (SELECT book_id, pdf_page - candidate AS "offset", count(*) AS hits FROM one WHERE pdf_page - candidate BETWEEN 0 AND 40 GROUP BY ALL)
SELECT book_id, "offset", hits FROM h QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY hits DESC, "offset") = 1""")
def best_offset(spark: SparkSession, d: str) -> DataFrame:
    return pages.best_offset(_one(spark, d))


@query(f"""WITH {_ONE}, s AS (SELECT book_id, pdf_page FROM one WHERE id IN (SELECT id FROM pages WHERE quality = 'review'))
SELECT o.book_id, o.pdf_page, 'next' AS side, o.id FROM s JOIN one o ON o.book_id = s.book_id AND o.pdf_page = s.pdf_page + 1 UNION ALL SELECT o.book_id, o.pdf_page, 'previous', o.id FROM s JOIN one o ON o.book_id = s.book_id AND o.pdf_page = s.pdf_page - 1""")
def adjacent_pages(spark: SparkSession, d: str) -> DataFrame:
    one = _one(spark, d)
    review = one.join(table(spark, d, "pages").where("quality = 'review'").select("id"), "id", "left_semi")
    return pages.adjacent(review, one.select("book_id", "pdf_page", "id"))


@query("WITH e AS (SELECT book_id, unnest(generate_series(min(pdf_page), max(pdf_page))) AS pdf_page FROM pages GROUP BY book_id) SELECT book_id, pdf_page FROM e WHERE (book_id, pdf_page) NOT IN (SELECT (book_id, pdf_page) FROM pages)")
def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.missing_pages(table(spark, d, "pages"))


_P = "p AS (SELECT DISTINCT id, page_id, ordinal, kind, raw, display, text_version FROM passages WHERE raw IS NOT NULL)"


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").where("raw IS NOT NULL").select("id", "page_id", "ordinal", "kind", "raw", "display", "text_version").distinct()


@query(f"""WITH {_P}, m AS (SELECT *, min(CASE WHEN regexp_matches({compact_sql('raw')}, '{EXERCISE}') THEN ordinal END) OVER (PARTITION BY page_id) AS f FROM p)
SELECT id, coalesce(ordinal >= f AND kind IN ('body', 'fragment', 'catalog'), false) AS propagated FROM m""")
def exercise_propagation(spark: SparkSession, d: str) -> DataFrame:
    p = pages.propagated(_passages(spark, d), "page_id", "ordinal", compact(F.col("raw")).rlike(EXERCISE), F.col("kind").isin("body", "fragment", "catalog"))
    return p.select("id", "propagated")


@query(f"WITH {_P} SELECT id, md5(lag(CASE WHEN kind NOT IN ('margin', 'index') THEN raw END) OVER (PARTITION BY page_id, text_version ORDER BY ordinal, id)) AS previous FROM p")
def previous_clean(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).withColumn("o", F.struct("ordinal", "id"))
    skip = ~F.coalesce(~F.col("kind").isin("margin", "index"), F.lit(False))
    return pages.previous_clean(p, ["page_id", "text_version"], "o", "raw", skip).select("id", F.md5("previous").alias("previous"))


@query(f"""WITH {_P}, n AS (SELECT *, CASE WHEN kind = 'body' THEN raw END AS r FROM p),
l AS (SELECT id, raw, lead(r) OVER w AS a, lead(r, 2) OVER w AS b FROM n WINDOW w AS (PARTITION BY page_id, text_version ORDER BY ordinal, id)),
c AS (SELECT id, raw, CASE WHEN length(raw) + 1 + length(a) <= 420 THEN raw || ' ' || a END AS one, b FROM l)
SELECT id, length(coalesce(CASE WHEN length(one) + 1 + length(b) <= 420 THEN one || ' ' || b END, one, raw)) AS n FROM c""")
def bounded_continuation(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).withColumn("o", F.struct("ordinal", "id"))
    stop = ~F.coalesce(F.col("kind") == "body", F.lit(False))
    return pages.continued(p, ["page_id", "text_version"], "o", "raw", stop).select("id", F.length("continued").alias("n"))


@query(f"""WITH {_P}, t AS (SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY ordinal, id) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM p WHERE kind = 'table'),
c AS (SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY ordinal, id) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM p WHERE kind = 'note')
SELECT page_id, t.id AS table_id, c.id AS caption_id FROM t JOIN c USING (page_id, k, n)""")
def caption_pairing(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).withColumn("o", F.struct("ordinal", "id"))
    return pages.captions(p.where("kind = 'table'"), p.where("kind = 'note'"), "page_id", "o").select("page_id", "table_id", "caption_id")


@query(f"WITH {_P} SELECT r.id AS passage_id, t.id AS table_id FROM p r JOIN p t ON t.page_id = r.page_id AND t.ordinal > r.ordinal AND t.ordinal <= r.ordinal + 3 WHERE t.kind = 'table' AND r.kind = 'body'")
def near_following_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables at most three places after a passage: an equi join on the page and each of the three places."""
    p = _passages(spark, d)
    body = p.where("kind = 'body'").select(F.col("id").alias("passage_id"), "page_id", F.explode(F.sequence(F.col("ordinal") + 1, F.col("ordinal") + 3)).alias("ordinal"))
    return body.join(p.where("kind = 'table'").select(F.col("id").alias("table_id"), "page_id", "ordinal"), ["page_id", "ordinal"]).select("passage_id", "table_id")


@query(f"""WITH {_P}, b AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM p WINDOW w AS (PARTITION BY page_id ORDER BY ordinal, id))
SELECT id, sum(s) OVER (PARTITION BY page_id ORDER BY ordinal, id) AS block FROM b""")
def kind_blocks(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).withColumn("o", F.struct("ordinal", "id"))
    w = Window.partitionBy("page_id").orderBy("o")
    p = p.withColumn("s", ~F.col("kind").eqNullSafe(F.lag("kind").over(w)) | (F.row_number().over(w) == 1))
    return pages.islands(p, ["page_id"], "o", F.col("s")).select("id", "block")


@query("""WITH p AS (SELECT DISTINCT id, page_id, bbox FROM passages WHERE len(bbox) = 4)
SELECT page_id, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1, median(bbox[1]) AS median_left FROM p GROUP BY page_id""")
def box_union(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").where(F.size("bbox") == 4).select("id", "page_id", "bbox").distinct()
    side = lambda i: F.get("bbox", F.lit(i))
    return p.groupBy("page_id").agg(F.min(side(0)).alias("x0"), F.min(side(1)).alias("y0"), F.max(side(2)).alias("x1"), F.max(side(3)).alias("y1"), F.median(side(0)).alias("median_left"))


@query(f"WITH {_P} SELECT page_id, md5(string_agg(raw, chr(10) ORDER BY ordinal, id)) AS digest FROM p WHERE kind <> 'margin' GROUP BY page_id")
def ordered_page_text(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).where("kind <> 'margin'")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "id", "raw")))
    return p.groupBy("page_id").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["raw"]), "\n")).alias("digest"))


@query("SELECT id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN kind = 'margin' THEN 2 WHEN kind = 'note' THEN 1 ELSE 0 END, round_even(bbox[2] / 3, 0), bbox[1], id) AS place FROM (SELECT DISTINCT id, page_id, kind, bbox FROM passages WHERE len(bbox) = 4)")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").where(F.size("bbox") == 4).select("id", "page_id", "kind", "bbox").distinct()
    lane = F.when(F.col("kind") == "margin", 2).when(F.col("kind") == "note", 1).otherwise(0)
    w = Window.partitionBy("page_id").orderBy(lane, F.bround(F.get("bbox", F.lit(1)) / 3, 0), F.get("bbox", F.lit(0)), "id")
    return p.select("id", F.row_number().over(w).alias("place"))


@query()
def layout_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages laid out again from the boxes of the stored ones."""
    p = table(spark, d, "passages").where((F.size("bbox") == 4) & F.col("raw").isNotNull()).select("id", "page_id", "raw", "bbox").distinct()
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return layout.passages(p.select("page_id", F.lit(600.0).alias("width"), F.lit(850.0).alias("height"), F.col("raw").alias("text"), *box, F.lit(10.0).alias("size")))
