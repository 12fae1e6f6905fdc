"""Reading text of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import display as shown
from gyeol.operators import build, lexicon, reading
from gyeol.queries.registry import WS, Registry, compact
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


_SPACE, _GLYPH = WS[:-1], "[^" + WS[1:-1]


def _lists(spark: SparkSession, d: str) -> shown.Lists:
    """What the books print as one word; the table has a fixed size (some 6,600 words)."""
    rows = table(spark, d, "source_words").where("word IS NOT NULL").groupBy("word").agg(F.max(F.coalesce("solid", F.lit(False))).alias("solid")).collect()
    return shown.Lists(one_word=frozenset(r.word for r in rows), solid=frozenset(r.word for r in rows if r.solid), joined=shown.TERMS)


@query()
def displayed_passages(spark: SparkSession, d: str) -> DataFrame:
    """What the screen shows of every passage: spaces, marks, terms, cited letters and Latin words put right."""
    return reading.displayed(table(spark, d, "passages"), "id", "raw", "display", _lists(spark, d)).select("id", F.md5("shown").alias("digest"), "repairs")


@query()
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    """Headings that the layout joined to the paragraph below them."""
    return reading.headings(table(spark, d, "passages"), "id", "raw", "display")


@query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return reading.sentence_chunks(table(spark, d, "passages"), "id", "raw", "display")


@query(rf"""WITH p AS (SELECT DISTINCT id, raw, display FROM passages),
g AS (SELECT *, regexp_extract_all(raw, '({_SPACE}*){_GLYPH}', 1) AS source, regexp_extract_all(display, '({_SPACE}*){_GLYPH}', 1) AS gaps, regexp_extract_all(display, '{_GLYPH}') AS glyphs FROM p)
SELECT id, md5(CASE WHEN raw IS NULL OR display IS NULL OR {compact('raw')} <> {compact('display')} THEN raw ELSE array_to_string(list_transform(range(1, len(glyphs) + 1), lambda i:
  (CASE WHEN i = 1 THEN '' WHEN contains(source[i], chr(10)) THEN chr(10) WHEN contains(source[i], chr(9)) THEN chr(9) WHEN length(gaps[i]) > 0 THEN ' ' ELSE '' END) || glyphs[i]), '') END) AS digest FROM g""")
def aligned_passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("id", "raw", "display").distinct().select("id", F.md5(reading.aligned("raw", "display")).alias("digest"))


_CELLS = "list_filter(list_transform(string_split(r, chr(9)), lambda c: trim(regexp_replace(c, '^[•·]\\s*', ''))), lambda c: c <> '')"
_ODD = r"""[^\p{L}\p{N}\t.,;:!?()\[\]{}<>|/%&+=*@#\-~''"·‥…‘’“”–—《》〈〉「」『』〔〕°※→←↔±×÷○●△▲□■◇◆☆★①-⑩]"""


@query(rf"""WITH v AS (SELECT w FROM (SELECT unnest(regexp_extract_all(display, '[가-힣]{{2,}}')) AS w FROM passages) GROUP BY w HAVING count(*) >= 3),
p AS (SELECT DISTINCT id, raw FROM passages WHERE kind IN ('table', 'note') AND raw IS NOT NULL),
r AS (SELECT id, raw, list_filter(list_transform(string_split(raw, chr(10)), lambda r: {_CELLS}), lambda r: len(r) > 0) AS rows FROM p),
c AS (SELECT *, flatten(rows) AS cells, regexp_replace(array_to_string(flatten(rows), ''), '\s', '', 'g') AS body FROM r),
u AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE v.w IS NULL) AS strange, count(*) FILTER (WHERE v.w IS NULL AND length(t.w) >= 7) AS unparted
  FROM (SELECT id, unnest(regexp_extract_all(raw, '[가-힣]{{2,}}')) AS w FROM p) t LEFT JOIN v ON v.w = t.w GROUP BY id)
SELECT id, coalesce(len(cells) > 0 AND length(body) >= 30 AND len(regexp_extract_all(body, '[가-힣]')) >= length(body) * 0.45 AND len(regexp_extract_all(body, '{_ODD}')) <= length(body) * 0.04
  AND len(list_filter(cells, lambda x: regexp_matches(x, '^[\d\s,.·\-~]+$') OR regexp_matches(x, '\d{{1,3}}(\s*[,.·]\s*\d{{1,3}})+\s*$|\d{{1,4}}\s*[-–~•]\s*\d{{1,4}}\s*\.?\s*$|[(（]\s*[12]\d{{3}}'))) <= 0.3 * len(cells)
  AND len(list_filter(cells, lambda x: len(regexp_extract_all(x, '[가-힣]')) <= 1)) <= 0.4 * len(cells)
  AND NOT (list_max(list_transform(rows, lambda x: len(x))) > 1 AND len(list_filter(rows, lambda x: len(x) = 1)) > 0.4 * len(rows)), false)
  AND NOT coalesce(unparted > 0 OR (n >= 8 AND strange > 0.25 * n), false) AS readable FROM c LEFT JOIN u USING (id)""")
def readable_tables(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages")
    return reading.readable_tables(p.where("kind IN ('table', 'note') AND raw IS NOT NULL"), "id", "raw", lexicon.vocabulary(p, "display"))


@query()
def page_readings(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees of every page."""
    p = table(spark, d, "passages")
    rows = reading.page_readings(p, lexicon.vocabulary(p, "display"), _lists(spark, d))
    return rows.select("page_id", "id", "kind", "heading", F.md5("text").alias("digest"), "suspects", F.size("clean").alias("blocks"))


@query("""WITH p AS (SELECT DISTINCT page_id, ordinal, raw, display, text_version FROM passages WHERE raw IS NOT NULL), v AS (SELECT max(text_version) AS v FROM p),
n AS (SELECT DISTINCT page_id, ordinal, raw FROM p, v WHERE text_version = v), o AS (SELECT page_id, raw, min(display) AS display FROM p, v WHERE text_version < v AND display IS NOT NULL GROUP BY page_id, raw)
SELECT n.page_id AS page_id, ordinal, md5(n.raw) AS raw, o.display IS NOT NULL AS reused FROM n LEFT JOIN o ON n.page_id = o.page_id AND n.raw = o.raw""")
def reused_displays(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the newest version, and whether an earlier one of the page with the same characters lends its display."""
    p = table(spark, d, "passages").where("raw IS NOT NULL").select("page_id", "ordinal", "raw", "display", "text_version").distinct()
    newest = p.agg(F.max("text_version").alias("v")).scalar()
    new = p.where(F.col("text_version") == newest).select("page_id", "ordinal", "raw").distinct()
    rows = build.with_former_display(new, p.where(F.col("text_version") < newest))
    return rows.select("page_id", "ordinal", F.md5("raw").alias("raw"), F.col("display").isNotNull().alias("reused"))


@query("""WITH t AS (SELECT id, min(text) AS text FROM pages WHERE text IS NOT NULL GROUP BY id), l AS (SELECT DISTINCT id, sha256(text) AS digest FROM t WHERE id % 3 <> 0 UNION SELECT id, sha256(text || 'x') FROM t WHERE id % 3 = 0)
SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = t.id AND l.digest = sha256(t.text))""")
def changed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose text is not the one that the ledger of the last build knows; here every third page has changed since."""
    pages = table(spark, d, "pages").where("text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    ledger = pages.select("id", F.sha2(F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    return build.changed(pages, ledger, "id", "text").select("id")
