"""Concept items, their pages, paragraphs and packets of evidence over the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.functions.text import compact, split_sentences
from gyeol.operators import concepts, evidence
from gyeol.plans import question
from gyeol.queries.registry import Registry
from gyeol.queries.registry import compact as sql_compact
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

ASKED = question.asked("모음과 대명사의 종류는?", question.groups("모음과 대명사의 종류는?"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a written entry: a section for each kind, whose first item is a string and the others objects with a reference."""
    p = table(spark, d, "passages").where("display IS NOT NULL AND kind IS NOT NULL AND display NOT LIKE '{%'").select("page_id", "kind", "id", "display").distinct()
    n = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("id", "display"))
    obj = F.to_json(F.struct(F.concat(F.lit("N"), F.col("n")).alias("label"), F.col("display").alias("text"), F.array(F.lit("보기")).alias("examples"), F.array(F.lit(0), F.lit(5)).alias("refs")))
    text = F.when(F.col("n") == 1, F.to_json(F.struct(F.col("display").alias("v"))))
    quoted = F.regexp_extract(text, r'^\{"v":(.*)\}$', 1)
    rows = p.withColumn("n", n).withColumn("j", F.when(F.col("n") == 1, quoted).otherwise(obj))
    sections = rows.groupBy("page_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "j"))), lambda x: x["j"]), ",").alias("items"))
    section = F.concat(F.lit('{"heading":"'), F.col("kind"), F.lit('","items":['), F.col("items"), F.lit("]}"))
    pages = sections.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(section)), ",").alias("s"))
    return pages.select(F.concat(F.lit('{"id":"'), F.col("page_id"), F.lit('","label":"p'), F.col("page_id"), F.lit('","sections":['), F.col("s"), F.lit('],"sources":[{"id":'), F.col("page_id"), F.lit("}]}")).alias("j"))


_ITEMS = """SELECT page_id, kind, display, row_number() OVER (PARTITION BY page_id, kind ORDER BY id, display) AS n FROM (SELECT DISTINCT page_id, kind, id, display FROM passages WHERE display IS NOT NULL AND kind IS NOT NULL AND display NOT LIKE '{%')"""


@query(f"""SELECT CAST(page_id AS VARCHAR) AS id, n - 1 AS item, kind AS heading, CASE WHEN n = 1 THEN '' ELSE 'N' || n END AS label,
  md5(CASE WHEN n = 1 THEN display WHEN display = '' THEN '예: 보기' ELSE display || ' 예: 보기' END) AS digest, CASE WHEN n = 1 THEN '' ELSE CAST(page_id AS VARCHAR) END AS pages FROM ({_ITEMS})""")
def concept_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of nested entries of two generations, with sub-items, examples and references folded in."""
    items = concepts.concept_items(_entries(spark, d), "j")
    return items.select("id", "item", "heading", "label", F.md5("text").alias("digest"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query(f"""WITH i AS (SELECT page_id, n, dense_rank() OVER (PARTITION BY page_id ORDER BY kind) - 1 AS section, {sql_compact("kind || CASE WHEN n = 1 THEN '' ELSE 'N' || n END || display")} AS c FROM ({_ITEMS})),
h AS (SELECT page_id, section, n, CAST(contains(c, '모음') AS INTEGER) + CAST(contains(c, '대명사') AS INTEGER) AS hits FROM i WHERE n > 1),
f AS (SELECT page_id, min((-hits, page_id, section, n)) AS o FROM h WHERE hits > 0 GROUP BY page_id)
SELECT page_id AS page, row_number() OVER (ORDER BY o, page_id) AS place FROM f QUALIFY place <= 12""")
def concept_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages on which the entries that hold a question's words rest."""
    items = concepts.concept_items(_entries(spark, d), "j")
    matched = items.select("id").distinct().select("id", F.col("id").cast("bigint").alias("rank"), F.lit("related").alias("match"))
    return concepts.concept_pages(items, matched, ASKED)


@query(r"""SELECT doc_id, CASE WHEN p AND NOT n THEN 'poem' WHEN n AND NOT p THEN 'novel' END AS genre FROM (SELECT doc_id,
  regexp_matches(text, '(?:^|[^가-힣])(?:현대|서정)?시(?:인|어|적|집|조|가)?(?:은|는|이|가|을|를|의|에|와|과|도|에서|으로)?(?:$|[^가-힣])') AS p, contains(text, '소설') AS n FROM documents)""")
def asked_genres(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", concepts.asked_genre(F.col("text")).alias("genre"))


@query(r"""WITH p AS (SELECT DISTINCT page_id, id, ordinal, kind, display FROM passages WHERE coalesce(kind, '') NOT IN ('margin', 'index', 'catalog', 'exercise') AND len(regexp_extract_all(display, '[가-힣A-Za-z]')) >= 3),
s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(display, '([다요까][.!?。][”’'']?)(\s|$)', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 500) AS q FROM p)
SELECT page_id, id, kind, len(q) AS quotes FROM s""")
def evidence_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Passages that may be cited, and how many of their sentences may be quoted."""
    p = table(spark, d, "passages").select("page_id", "id", "ordinal", "kind", "display").distinct()
    return concepts.paragraphs(p, split_sentences(F.col("display"))).select("page_id", "id", "kind", F.size("quotes").alias("quotes"))


@query(r"""WITH p AS (SELECT DISTINCT page_id, id, ordinal, kind, display FROM passages WHERE coalesce(kind, '') NOT IN ('margin', 'index', 'catalog', 'exercise') AND len(regexp_extract_all(display, '[가-힣A-Za-z]')) >= 3),
s AS (SELECT page_id, len(list_filter(list_transform(string_split(regexp_replace(display, '([다요까][.!?。][”’'']?)(\s|$)', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 500)) AS q FROM p)
SELECT page_id, count(*) AS paragraphs, sum(q) AS quotes FROM s WHERE page_id IN (SELECT g.id FROM pages g JOIN books b ON g.book_id = b.id) GROUP BY page_id""")
def evidence_packets(spark: SparkSession, d: str) -> DataFrame:
    """What a model reads of every page, with the registry that its evidence ids resolve through."""
    p = table(spark, d, "passages").select("page_id", "id", "ordinal", "kind", "display").distinct()
    books = table(spark, d, "books").select(F.col("id").alias("book_id"), F.col("title").alias("book"))
    label = concepts.page_label(F.col("printed_page"), F.col("number_status"), F.col("pdf_page"))
    labels = table(spark, d, "pages").groupBy(F.col("id").alias("page_id")).agg(F.min(F.struct("book_id", label.alias("page"))).alias("x")).select("page_id", "x.book_id", "x.page").join(F.broadcast(books), "book_id").drop("book_id")
    packets = concepts.packet(concepts.paragraphs(p, split_sentences(F.col("display"))), labels)
    quotes = F.aggregate(F.map_values("registry"), F.lit(0), lambda n, q: n + F.size(q))
    return packets.select("page_id", F.size("registry").alias("paragraphs"), quotes.alias("quotes"))


@query("""SELECT DISTINCT id, CASE WHEN number_status IN ('sequence', 'manual', 'offset') AND coalesce(printed_page, 0) > 0 THEN printed_page || '쪽' WHEN pdf_page IS NOT NULL THEN 'PDF ' || pdf_page || '쪽' END AS label FROM pages""")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("id", concepts.page_label(F.col("printed_page"), F.col("number_status"), F.col("pdf_page")).alias("label")).distinct()


_TERMS = ("안긴문장", "모음", "대명사", "운율")


@query("WITH p AS (SELECT DISTINCT id, compact, quality FROM pages WHERE compact IS NOT NULL), t(term) AS (VALUES " + ", ".join(f"('{t}')" for t in _TERMS) + """)
SELECT id, round(sum((length(compact) - length(replace(compact, term, ''))) / length(term) * pow(length(term), 1.5) * CASE WHEN quality = 'review' THEN 0.6 ELSE 1.0 END), 6) AS weight FROM p JOIN t ON contains(compact, term) GROUP BY id""")
def related_pages(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    pages = table(spark, d, "pages").select("id", "compact", "quality").distinct()
    return concepts.related_pages(pages, "compact", terms, ["id"]).select("id", F.round("weight", 6).alias("weight"))


@query("""WITH p AS (SELECT DISTINCT id, compact FROM pages WHERE compact IS NOT NULL), c AS (SELECT DISTINCT page_id AS id, list_distinct(regexp_extract_all(compact, '안긴문장|모음|대명사|운율|방언')) AS terms FROM passages WHERE compact IS NOT NULL)
SELECT DISTINCT id, array_to_string(list_sort(terms), ',') AS terms, len(list_filter(terms, lambda t: contains(compact, t))) AS found FROM c JOIN p USING (id) WHERE len(list_filter(terms, lambda t: contains(compact, t))) >= greatest(2, len(terms) / 2)""")
def rechecked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold enough of the terms that their passages were chosen for."""
    chosen = table(spark, d, "passages").where("compact IS NOT NULL").select(F.col("page_id").alias("id"), F.array_sort(F.array_distinct(F.regexp_extract_all("compact", F.lit("안긴문장|모음|대명사|운율|방언"), F.lit(0)))).alias("terms")).distinct()
    pages = table(spark, d, "pages").where("compact IS NOT NULL").select("id", "compact").distinct()
    return concepts.rechecked(chosen, pages, "id").select("id", F.array_join("terms", ",").alias("terms"), "found").distinct()


@query(f"""WITH c AS (SELECT DISTINCT id, page_id, excerpt FROM chunks WHERE excerpt IS NOT NULL), p AS (SELECT id, min({sql_compact('text')}) AS t FROM pages WHERE text IS NOT NULL GROUP BY id)
SELECT c.id AS id, coalesce(length(excerpt) BETWEEN 20 AND 500 AND contains(t, {sql_compact('excerpt')}), false) AS valid FROM c LEFT JOIN p ON p.id = c.page_id""")
def citation_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as a claim that quotes its page: valid if the quote has the right size and stands on the page."""
    c = table(spark, d, "chunks").where("excerpt IS NOT NULL").select(F.col("id").cast("string").alias("id"), "page_id", "excerpt").distinct()
    claims = c.select("id", F.xxhash64("page_id", "excerpt").alias("section"), F.lit(0).alias("point"), F.lit("").alias("text"), F.array(F.struct(F.col("page_id").cast("string").alias("source"), F.col("excerpt").alias("quote"))).alias("citations"))
    sources = table(spark, d, "pages").where("text IS NOT NULL").groupBy(F.col("id").cast("string").alias("source")).agg(F.min(compact(F.col("text"))).alias("text"))
    return evidence.validated(claims, sources).select(F.col("id").cast("bigint").alias("id"), "valid")


@query(r"""WITH t AS (SELECT DISTINCT title FROM books), n AS (SELECT regexp_extract(title, '^(.*\S)\s*([0-9])$', 1) AS stem, regexp_extract(title, '^(.*\S)\s*([0-9])$', 2) AS v FROM t UNION
SELECT regexp_extract(o, '^(.*\S)\s*([0-9])$', 1), regexp_extract(o, '^(.*\S)\s*([0-9])$', 2) FROM (SELECT title || ' ' || pages % 3 AS o FROM books WHERE pages IS NOT NULL))
SELECT stem, array_to_string(list_sort(list(DISTINCT CAST(v AS INTEGER))), ',') AS volumes FROM n WHERE length(stem) >= 4 AND v <> '' GROUP BY stem""")
def stem_volumes(spark: SparkSession, d: str) -> DataFrame:
    """The volumes of numbered titles; the titles of the library stand for series of up to three."""
    from gyeol.operators import terms

    books = table(spark, d, "books")
    titles = books.select("title").unionByName(books.where("pages IS NOT NULL").select(F.concat("title", F.lit(" "), (F.col("pages") % 3).cast("string")).alias("title")))
    return terms.volumes(titles, "title").select("stem", F.array_join(F.transform("volumes", lambda v: v.cast("string")), ",").alias("volumes"))


@query("""WITH w AS (SELECT category, list(DISTINCT title) AS titles FROM books WHERE title IS NOT NULL GROUP BY category)
SELECT category, array_to_string(list_transform(list_sort(list_transform(titles, lambda t: {'n': -length(t), 't': t})), lambda s: s.t), '|') AS titles FROM w""")
def longest_titles(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "books").where("title IS NOT NULL").groupBy("category").agg(F.collect_set("title").alias("t"))
    return w.select("category", F.array_join(concepts.longest_first(F.col("t")), "|").alias("titles"))


@query(f"""SELECT CAST(page_id AS VARCHAR) AS id, count(*) AS items, sum(length(display)) AS chars FROM ({_ITEMS}) GROUP BY page_id""")
def entry_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Items and characters of each entry, without the examples that were added to all but the first of a section."""
    items = concepts.concept_items(_entries(spark, d), "j")
    own = F.length(F.regexp_replace("text", " ?예: 보기$", ""))
    return items.groupBy("id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.when(F.col("item") == 0, F.length("text")).otherwise(own)).alias("chars"))


@query(f"""SELECT CAST(page_id AS VARCHAR) AS id, md5(string_agg(CASE WHEN n = 1 THEN kind || CASE WHEN display = '' THEN '' ELSE ' ' || display END ELSE 'N' || n || CASE WHEN display = '' THEN '' ELSE ' ' || display END || ' 예: 보기' END, ' ' ORDER BY kind, n)) AS digest
FROM ({_ITEMS}) GROUP BY page_id""")
def entry_prose(spark: SparkSession, d: str) -> DataFrame:
    return concepts.entry_prose(_entries(spark, d), "j").select("id", F.md5("prose").alias("digest"))
