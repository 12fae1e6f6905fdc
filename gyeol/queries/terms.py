"""Index entries, labels, catalogue, definitions and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.functions.text import split_sentences
from gyeol.operators import terms
from gyeol.plans import question
from gyeol.queries.registry import Registry
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_RUN = r"[0-9ZzlIOo]{1,4}(?:\s*[-–~]\s*[0-9ZzlIOo]{1,4})?"
_ENTRY = rf"^\s*(\S.*?\S|\S)\s{{2,}}({_RUN}(?:\s*[,，]\s*{_RUN})*)\s*$"
_ENTRIES = rf"""l AS (SELECT DISTINCT id, page_id, raw FROM passages WHERE raw IS NOT NULL),
s AS (SELECT id, page_id, unnest(string_split(raw, chr(10))) AS line, unnest(generate_series(0, len(string_split(raw, chr(10))) - 1)) AS line_no FROM l),
e AS (SELECT id, page_id, line_no, regexp_extract(line, '{_ENTRY}', 1) AS t, regexp_extract(line, '{_ENTRY}', 2) AS p FROM s),
r AS (SELECT id, page_id, line_no, regexp_replace(t, '[\s.·…]+$', '') AS term, regexp_extract(unnest(regexp_split_to_array(p, '\s*[,，]\s*')), '^[0-9ZzlIOo]+') AS run FROM e WHERE t <> ''),
entries AS (SELECT id, page_id, line_no, term, CAST(translate(run, 'ZzlIOo', '221100') AS INTEGER) AS page FROM r WHERE regexp_matches(run, '[0-9]'))"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").where("raw IS NOT NULL").select("id", "page_id", "raw").distinct()
    return terms.index_entries(p, "raw", "id", "page_id")


@query(f"WITH {_ENTRIES} SELECT id, line_no, term, page FROM entries")
def index_entries(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("id", "line_no", "term", "page")


@query(f"WITH {_ENTRIES} SELECT id, count(*) AS entries, count(DISTINCT term) AS terms FROM entries GROUP BY id HAVING count(*) >= 8")
def index_passages(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("term").alias("terms")).where("entries >= 8")


@query(f"""WITH {_ENTRIES}, b AS (SELECT DISTINCT e.term, g.book_id, k.category, e.page FROM entries e JOIN (SELECT DISTINCT id, book_id FROM pages) g ON e.page_id = g.id JOIN books k ON g.book_id = k.id)
SELECT term, bit_or(CASE category WHEN '문법' THEN 1 WHEN '문학' THEN 2 WHEN '문식성' THEN 4 ELSE 0 END) AS areas, count(DISTINCT book_id) AS books, bit_or(CASE WHEN page > 200 THEN 2 ELSE 1 END) AS flags FROM b GROUP BY term""")
def catalog_rollup(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "book_id").distinct()
    books = table(spark, d, "books").select(F.col("id").alias("book_id"), "category")
    c = F.col("category")
    area = F.when(c == "문법", 1).when(c == "문학", 2).when(c == "문식성", 4).otherwise(0)
    sources = _entries(spark, d).select("page_id", "term", "page").join(pages, "page_id").join(books, "book_id").select("term", "book_id", area.alias("area"), F.when(F.col("page") > 200, 2).otherwise(1).alias("flag")).distinct()
    return terms.catalog(sources)


@query(f"""WITH {_ENTRIES}, o AS (SELECT book_id, pdf_page - printed_page AS o FROM pages WHERE printed_page IS NOT NULL GROUP BY book_id, pdf_page - printed_page QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY count(*) DESC, pdf_page - printed_page) = 1),
w AS (SELECT DISTINCT g.book_id, e.term, e.page + o.o AS target FROM entries e JOIN (SELECT DISTINCT id, book_id FROM pages) g ON e.page_id = g.id JOIN o USING (book_id)),
h AS (SELECT w.*, p.pdf_page, p.id, CASE p.pdf_page - w.target WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS pref FROM w JOIN (SELECT DISTINCT id, book_id, pdf_page, compact FROM pages) p ON p.book_id = w.book_id AND abs(p.pdf_page - w.target) <= 1 WHERE contains(p.compact, lower(replace(w.term, ' ', ''))))
SELECT book_id, term, target, pdf_page FROM h QUALIFY row_number() OVER (PARTITION BY book_id, term, target ORDER BY pref, id) = 1""")
def offset_probe(spark: SparkSession, d: str) -> DataFrame:
    """The page that an index entry means: its number plus the book's offset, then the page after, then the one before,
    if the term stands there."""
    pages = table(spark, d, "pages")
    known = pages.where("printed_page IS NOT NULL").groupBy("book_id", (F.col("pdf_page") - F.col("printed_page")).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    offsets = known.withColumn("r", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "o"))).where("r = 1").select("book_id", "o")
    owners = pages.select(F.col("id").alias("page_id"), "book_id").distinct()
    wanted = _entries(spark, d).join(owners, "page_id").join(offsets, "book_id").select("book_id", "term", (F.col("page") + F.col("o")).alias("target")).distinct()
    probes = wanted.withColumn("pref", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("pdf_page", F.col("target") + F.when(F.col("pref") == 2, -1).otherwise(F.col("pref")))
    texts = pages.select("id", "book_id", "pdf_page", "compact").distinct()
    hits = probes.join(texts, ["book_id", "pdf_page"]).where(F.contains("compact", F.lower(F.replace("term", F.lit(" "), F.lit("")))))
    w = Window.partitionBy("book_id", "term", "target").orderBy("pref", "id")
    return hits.withColumn("r", F.row_number().over(w)).where("r = 1").select("book_id", "term", "target", "pdf_page")


@query("""WITH c AS (SELECT lower(lang) AS key, lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT key, (list(label ORDER BY n DESC, label))[1] AS label, array_to_string(list(label ORDER BY label), ',') AS variants FROM c GROUP BY key""")
def label_variants(spark: SparkSession, d: str) -> DataFrame:
    out = terms.labels(table(spark, d, "documents"), F.lower("lang"), "lang")
    return out.select("key", "label", F.array_join("variants", ",").alias("variants"))


@query()
def best_definitions(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each book that defines a word of its topics most plainly."""
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "book_id", "pdf_page").distinct()
    p = table(spark, d, "passages").where("display IS NOT NULL").select("id", "page_id", "display").distinct()
    s = p.select("id", "page_id", F.posexplode(split_sentences(F.col("display"))).alias("at", "sentence"))
    words = s.withColumn("key", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit("([가-힣]{2,})(?:은|는|이란|란)"), F.lit(1)))))
    scored = words.withColumn("score", terms.definition_score("sentence", "key", F.array().cast("array<string>"))).join(pages, "page_id")
    best = terms.definitions(scored, ["book_id", "key"], "score", ["pdf_page", "id", "at"], terms.THRESHOLD)
    return best.select("book_id", "key", "score", "pdf_page", "id", "at")


@query("SELECT id, title, year // 10 * 10 AS decade FROM (SELECT doc_id AS id, regexp_extract(text, '『([^』]+)』', 1) AS title, TRY_CAST(regexp_extract(text, '[(]((?:19|20)[0-9]{2})[)]', 1) AS INTEGER) AS year FROM documents) WHERE title <> '' AND year IS NOT NULL")
def reading_list_titles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", "『([^』]+)』", 1).alias("title"), F.regexp_extract("text", "[(]((?:19|20)[0-9]{2})[)]", 1).alias("y"))
    return t.where("title <> '' AND y <> ''").select("id", "title", (F.floor(F.col("y").cast("int") / 10) * 10).cast("int").alias("decade"))


@query(f"""WITH {_ENTRIES}, m(wrong, "right") AS (VALUES ('모움', '모음'), ('자움', '자음')) SELECT coalesce("right", term) AS term, count(*) AS n FROM entries LEFT JOIN m ON wrong = term GROUP BY ALL""")
def rekeyed_entries(spark: SparkSession, d: str) -> DataFrame:
    fixes = spark.createDataFrame([("모움", "모음"), ("자움", "자음")], "wrong string, right string")
    return terms.rekeyed(_entries(spark, d), "term", fixes).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ENTRIES}, src AS (SELECT e.term, b.title, e.page, c.quote FROM entries e JOIN (SELECT DISTINCT id, book_id FROM pages) g ON e.page_id = g.id JOIN books b ON g.book_id = b.id LEFT JOIN (SELECT page_id, min(excerpt) AS quote FROM chunks GROUP BY page_id) c ON c.page_id = e.page_id)
SELECT DISTINCT term, title, page, row_number() OVER (PARTITION BY term ORDER BY quote IS NULL, title, page) AS place FROM (SELECT DISTINCT term, title, page, quote FROM src)""")
def card_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources of each index term in the order a card shows them."""
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "book_id").distinct()
    books = table(spark, d, "books").select(F.col("id").alias("book_id"), "title")
    quotes = table(spark, d, "chunks").groupBy("page_id").agg(F.min("excerpt").alias("quote"))
    s = _entries(spark, d).select("page_id", "term", "page").join(pages, "page_id").join(books, "book_id").join(quotes, "page_id", "left").select("term", "title", "page", "quote").distinct()
    order = terms.card_order(F.col("quote"), F.lit(True), F.lit(False), F.col("title"), F.col("page"))
    return s.select("term", "title", "page", F.row_number().over(Window.partitionBy("term").orderBy(*order)).alias("place"))


@query("""WITH p AS (SELECT DISTINCT id, display FROM passages WHERE display IS NOT NULL),
l AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(display, '([다요까][.!?。][”’'']?)(\\s|$)', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM p),
s AS (SELECT DISTINCT id, i, length(l[i + 1]) BETWEEN 15 AND 80 AS ok FROM (SELECT id, l, unnest(range(0, len(l))) AS i FROM l))
SELECT x.id AS id, x.i AS first, y.i AS last FROM s x JOIN s y ON x.id = y.id AND y.i BETWEEN x.i AND x.i + 5 WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.id = x.id AND z.i BETWEEN x.i AND y.i AND NOT z.ok)""")
def sentence_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of up to six neighbouring sentences of middling length in every passage."""
    p = table(spark, d, "passages").where("display IS NOT NULL").select("id", "display").distinct()
    s = p.select("id", F.posexplode(split_sentences(F.col("display"))).alias("i", "s")).select("id", "i", F.length("s").between(15, 80).alias("ok")).distinct()
    return terms.sentence_runs(s, "id", "i", F.col("ok"))
