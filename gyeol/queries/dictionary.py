"""The term dictionary over the library: definitions, misread terms, topics, catalogue and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.functions import hangul
from gyeol.functions.text import compact, term_key
from gyeol.operators import concepts, dictionary, lexicon
from gyeol.plans import question
from gyeol.queries.registry import Registry
from gyeol.queries.terms import _ENTRIES, _entries
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_KEY_WS = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f\-‘’''\"·]+"


def _key(column: str) -> str:
    return f"lower(regexp_replace({column}, '{_KEY_WS}', '', 'g'))"


_SOURCES = f"""{_ENTRIES}, q AS (SELECT page_id, min(excerpt) AS quote FROM chunks GROUP BY page_id),
src AS (SELECT DISTINCT {_key('e.term')} AS key, e.term AS label, b.title AS book, b.category, e.page AS pdf_page, q.quote FROM entries e
  JOIN (SELECT DISTINCT id, book_id FROM pages) g ON e.page_id = g.id JOIN books b ON g.book_id = b.id LEFT JOIN q ON q.page_id = e.page_id)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """key, label, book, category, pdf_page, quote of every index entry."""
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "book_id").distinct()
    books = table(spark, d, "books").select(F.col("id").alias("book_id"), F.col("title").alias("book"), "category")
    quotes = table(spark, d, "chunks").groupBy("page_id").agg(F.min("excerpt").alias("quote"))
    rows = _entries(spark, d).join(pages, "page_id").join(books, "book_id").join(quotes, "page_id", "left")
    return rows.select(term_key(F.col("term")).alias("key"), F.col("term").alias("label"), "book", "category", F.col("page").alias("pdf_page"), "quote").distinct()


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sentences = dictionary.page_sentences(table(spark, d, "passages"))
    keys = _entries(spark, d).select(term_key(F.col("term")).alias("key")).distinct().where(F.col("key").rlike("[가-힣]") & F.length("key").between(2, dictionary.LONGEST_TERM))
    return sentences, dictionary.scored_definitions(sentences, keys)


@query()
def term_definitions(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each page that defines an index term, with what it points back to and what follows on the term."""
    sentences, scored = _scored(spark, d)
    return dictionary.with_context(sentences, dictionary.page_definitions(scored)).select("page_id", "key", "score", "id", "at", "quote", "more")


@query()
def definitions_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Definitions in a book away from the pages that its index names."""
    _, scored = _scored(spark, d)
    pages = table(spark, d, "pages")
    owners = pages.select(F.col("id").alias("page_id"), "book_id", "pdf_page").distinct()
    best = dictionary.page_definitions(scored).join(owners, "page_id").select("book_id", "key", "pdf_page", "score")
    named = _entries(spark, d).join(owners.select("page_id", "book_id"), "page_id").select("book_id", term_key(F.col("term")).alias("key"), F.col("page").alias("pdf_page")).distinct()
    indexed = named.join(best, ["book_id", "key", "pdf_page"], "left")
    return dictionary.away_definitions(scored, pages, indexed).select("book_id", "key", "pdf_page", "score", "id", "at")


_CONFUSED = " OR ".join(
    f"({' AND '.join(f'{p}1 = {p}2' for j, p in enumerate('cvf') if j != i)} AND list_contains([{', '.join(str(min(x) * 100 + max(x)) for x in pairs)}], least({'cvf'[i]}1, {'cvf'[i]}2) * 100 + greatest({'cvf'[i]}1, {'cvf'[i]}2)))"
    for i, pairs in enumerate(dictionary.CONFUSED)
)


@query(f"""WITH {_ENTRIES}, w AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(display, '[가-힣]{{2,}}')) AS w FROM passages) WHERE length(w) BETWEEN 3 AND 8 GROUP BY w),
k AS (SELECT k.key, coalesce(w.n, 0) AS exact FROM (SELECT DISTINCT {_key('term')} AS key FROM entries) k LEFT JOIN w ON w.word = k.key WHERE regexp_matches(k.key, '^[가-힣]{{3,8}}$')),
pr AS (SELECT w.word, w.n, k.key, k.exact, list_filter(range(1, length(word) + 1), lambda i: word[i] <> key[i]) AS d FROM w JOIN k ON length(w.word) = length(k.key) AND w.word <> k.key AND (w.word[1] = k.key[1] OR w.word[2:] = k.key[2:])),
apart AS (SELECT *, unicode(word[d[1]]) - 44032 AS x, unicode(key[d[1]]) - 44032 AS y FROM pr WHERE len(d) = 1 AND d[1] < length(word)),
j AS (SELECT *, x // 588 AS c1, y // 588 AS c2, x % 588 // 28 AS v1, y % 588 // 28 AS v2, x % 28 AS f1, y % 28 AS f2 FROM apart)
SELECT word, key, n, exact FROM j WHERE ({_CONFUSED}) AND word NOT IN (SELECT key FROM k) AND exact >= 10 AND n * 20 <= exact QUALIFY row_number() OVER (PARTITION BY word ORDER BY exact DESC, key) = 1""")
def misread_index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words that are an index term but for one letter that scans confuse, and far rarer."""
    counts = lexicon.words(table(spark, d, "passages"), "display").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keys = _entries(spark, d).select(term_key(F.col("term")).alias("key"), F.lit(False).alias("curated")).distinct()
    return dictionary.misread_terms(counts, keys)


#: Syllables that scans put for others.
_SUSPECT = (("히", "하"), ("둥", "등"), ("볍", "법"), ("틀", "들"), ("영", "명"), ("슴", "습"), ("머", "어"), ("믐", "음"), ("자", "사"), ("수", "주"))


@query(f"""WITH v AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(display, '[가-힣]{{2,}}')) AS w FROM passages) GROUP BY w),
s(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _SUSPECT)}),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), t AS (SELECT word AS wrong, n, word[1:i - 1] || b || word[i + 1:] AS "right" FROM i JOIN s ON word[i] = a)
SELECT wrong, "right", max(t.n) AS n, max(v.n) AS m FROM t JOIN v ON v.word = t."right" WHERE v.n >= 3 AND v.n > t.n GROUP BY ALL""")
def correction_candidates(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = lexicon.vocabulary(table(spark, d, "passages"), "display", 1)
    return dictionary.correction_candidates(vocabulary, spark.createDataFrame(_SUSPECT, "a string, b string"))


_STRIP = r"^[ .·­\-—•|lI]+|[ .·­\-—•|lI]+$"
_NUM = r"^(?:제\s*\d+\s*[장절편부]|\d+(?:\.\d+)*\.?|\(\d+\)|[가-하]\.|[①-⑳])\s*(.+)$"


@query(rf"""WITH l AS (SELECT DISTINCT id, book_id, unnest(string_split(text, chr(10))) AS line FROM pages WHERE text IS NOT NULL),
t AS (SELECT l.id, b.category AS area, regexp_replace(coalesce(b.title, ''), '\s', '', 'g') AS book, regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '{_STRIP}', '', 'g') AS s FROM l JOIN books b ON l.book_id = b.id),
f AS (SELECT *, regexp_replace(s, '\s', '', 'g') AS flat, regexp_matches(s, '{_NUM}') AS numbered, trim(CASE WHEN regexp_matches(s, '{_NUM}') THEN regexp_extract(s, '{_NUM}', 1) ELSE s END) AS body FROM t),
g AS (SELECT *, NOT regexp_matches(s, '^[\d\s.\-–]+$') AND NOT regexp_matches(s, '/|[「」『』〈〉]|[가-힣]\s*\d{{1,3}}\s+\d') AND NOT regexp_matches(s, '[_.]\s*\d{{1,3}}\s*$|\d{{2,3}}\s*$|\|') AND NOT regexp_matches(s, '지음|옮김|엮음|편저|일동|편역|해제했다|개정판')
  AND NOT (book <> '' AND length(flat) >= 4 AND (contains(book, flat) OR contains(flat, book))) AND length(body) BETWEEN 3 AND 40
  AND len(regexp_extract_all(body, '[가-힣]')) >= 0.5 * length(regexp_replace(body, '\s', '', 'g')) AND flat NOT IN ({', '.join(f"'{x}'" for x in dictionary.SKIPPED)})
  AND (numbered OR (NOT regexp_matches(body, '[다요][.!?。]|다$') AND length(body) <= 26 AND NOT regexp_matches(body, '[가-힣](?:고|며|서|면|은|는|을|를|의|에|와|과|도|만|나|랑)$'))) AS good FROM f)
SELECT area, body AS topic, count(*) AS n FROM (SELECT DISTINCT id, area, body FROM g WHERE good) GROUP BY ALL HAVING count(*) >= 2""")
def heading_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics that headings of pages name at least twice in an area."""
    books = table(spark, d, "books").select(F.col("id").alias("book_id"), "title", F.col("category").alias("area"))
    lines = table(spark, d, "pages").where("text IS NOT NULL").select("id", "book_id", F.explode(F.split("text", "\n")).alias("line")).distinct().join(books, "book_id")
    topics = lines.select("id", "area", dictionary.topic_of(F.col("line"), F.col("title")).alias("topic")).where("topic IS NOT NULL").distinct()
    return dictionary.heading_coverage(topics, topics.limit(0).selectExpr("topic AS name", "topic AS concept"), 2).select("area", "topic", "n")


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    """The library's word forms printed as one word stand in for written concepts: label, area, books."""
    return table(spark, d, "source_words").where("word IS NOT NULL AND n >= 50").select(F.col("word").alias("label"), F.lit(None).cast("string").alias("area"), F.lit(0).cast("bigint").alias("books")).distinct()


@query(f"""WITH {_SOURCES},
h AS (SELECT title AS book FROM books ORDER BY title LIMIT 2), real AS (SELECT key FROM src GROUP BY key HAVING NOT bool_and(book IN (SELECT book FROM h))),
kept AS (SELECT *, {_key('label')} AS shown FROM src WHERE key IN (SELECT key FROM real) AND {_key('label')} <> '찾아보기'),
c AS (SELECT DISTINCT {_key('word')} AS shown, word AS label FROM source_words WHERE word IS NOT NULL AND n >= 50),
rolled AS (SELECT shown, bit_or(CASE category WHEN '문식성' THEN 1 WHEN '문법' THEN 2 WHEN '문학' THEN 4 ELSE 0 END) AS areas, count(DISTINCT book) AS books, max(CASE WHEN quote IS NOT NULL THEN 1 ELSE 0 END) AS q,
  (list(label ORDER BY length(label) - length(replace(label, ' ', '')) DESC, label))[1] AS name FROM kept GROUP BY shown)
SELECT name, areas, books, q + CASE WHEN shown IN (SELECT shown FROM c) THEN 2 ELSE 0 END AS flags FROM rolled
UNION ALL SELECT min(label), 0, 0, 2 FROM c WHERE shown NOT IN (SELECT shown FROM rolled) GROUP BY shown""")
def catalogue_items(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of terms: index headings by their shown label, and concepts that no index names."""
    none = spark.createDataFrame([], "key string")
    headings = table(spark, d, "books").orderBy("title").limit(2).select(F.col("title").alias("book"))
    items = dictionary.catalogue(_sources(spark, d), _concepts(spark, d), none, headings, spark.createDataFrame([("찾아보기",)], "key string"))
    return items.select("name", "areas", "books", "flags")


@query()
def term_cards(spark: SparkSession, d: str) -> DataFrame:
    """The cards of the terms that the titles of the books name: their sources in order."""
    titles = [r.title for r in table(spark, d, "books").select("title").distinct().orderBy("title").collect()]  # 26 titles
    grams = spark.createDataFrame([(t, g) for t in titles for g in question.ngrams(t)], "question string, gram string")
    aliases = spark.createDataFrame([(i, n) for i, g in enumerate(question.ALIASES) for n in g], "grp int, name string")
    sources = _sources(spark, d).withColumns({"score": F.lit(0), "indexed": F.lit(True), "damaged": F.lit(False)})
    terms = sources.select("key", term_key(F.col("label")).alias("shown")).distinct()
    return dictionary.cards(dictionary.found_terms(grams, terms, aliases), sources).select("question", "gram", "place", "nth", "book", "pdf_page")


@query("""WITH p AS (SELECT DISTINCT regexp_extract_all(trim(regexp_replace(string_split(title, ':')[1], '\\(.*?\\)', '')), '[가-힣]+') AS parts, trim(regexp_replace(string_split(title, ':')[1], '\\(.*?\\)', '')) AS plain FROM books),
k AS (SELECT unnest(parts) AS key FROM p UNION SELECT unnest(list_transform(parts, lambda x: CASE WHEN length(x) > 2 THEN regexp_replace(x, '^(..+?)(?:으로|의|은|는|이|가|을|를|에|와|과|로)$', '\\1') ELSE x END)) FROM p UNION SELECT regexp_replace(plain, '\\s', '', 'g') FROM p WHERE contains(plain, ' '))
SELECT DISTINCT key FROM k WHERE regexp_matches(key, '^[가-힣]{3,8}$')""".replace("\\\\", "\\"))
def curated_names(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.curated_terms(table(spark, d, "books"), "title")


@query()
def pronunciation_examples(spark: SparkSession, d: str) -> DataFrame:
    """Words that passages give with their pronunciation, and the sound changes this shows."""
    return hangul.named_changes(table(spark, d, "passages").select("id", "display").distinct(), "display", "id").select("id", "spelling", "said", F.array_join("changes", ",").alias("changes"))


@query(f"""WITH {_SOURCES}, n AS (SELECT key, count(DISTINCT book) AS books, count(*) AS sources FROM src GROUP BY key)
SELECT key, books, sources FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE length(o.key) > length(n.key) AND contains(o.key, n.key))""")
def outermost_terms(spark: SparkSession, d: str) -> DataFrame:
    """Index terms that stand in no longer one."""
    n = _sources(spark, d).groupBy("key").agg(F.count_distinct("book").alias("books"), F.count(F.lit(1)).alias("sources"))
    inside = lexicon.superstrings(n, "key").select(F.col("short").alias("key")).distinct()
    return n.join(inside, "key", "left_anti")


@query(f"""WITH {_SOURCES}, lab AS (SELECT key, label, count(*) AS n FROM src GROUP BY ALL)
SELECT key, (list(label ORDER BY n DESC, label))[1] AS label, array_to_string(list(label ORDER BY label), ',') AS variants FROM lab GROUP BY key""")
def index_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label of each index term, the most common spelling, and its variants."""
    counts = _sources(spark, d).groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "label")
    first = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("key", "label")
    variants = counts.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("variants"))
    return first.join(variants, "key")


@query(f"""WITH m AS (SELECT word AS wrong, key AS "right" FROM ({ORACLE['misread_index_terms']})) SELECT "right", array_to_string(list(wrong ORDER BY wrong), ',') AS spellings FROM m GROUP BY "right\"""")
def damaged_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The damaged spellings of each index term."""
    wrong = misread_index_terms(spark, d).select(F.col("word").alias("wrong"), F.col("key").alias("right"))
    return lexicon.by_correct(wrong).select("right", F.array_join("spellings", ",").alias("spellings"))


@query()
def concept_match(spark: SparkSession, d: str) -> DataFrame:
    """Index terms that the titles of the books name, and those that are a part of a longer word of them."""
    titles = [r.title for r in table(spark, d, "books").select("title").distinct().orderBy("title").collect()]  # 26 titles
    grams = spark.createDataFrame([(t, g) for t in titles for g in question.ngrams(t)], "question string, gram string")
    labels = _sources(spark, d).groupBy("key").agg(F.min("label").alias("label"))
    return concepts.matched(grams, labels.select(F.col("key").alias("concept"), F.col("key").alias("name"), compact(F.col("label")).alias("body")))


@query(f"""WITH {_SOURCES}, h AS (SELECT DISTINCT book, key FROM src) SELECT book, key FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.book = h.book AND length(o.key) > length(h.key) AND contains(o.key, h.key))""")
def containment_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each book's index without those inside a longer one of the same book: every part of a term is a key."""
    h = _sources(spark, d).select("book", "key").distinct()
    parts = F.expr("array_distinct(flatten(transform(sequence(1, length(key)), n -> transform(sequence(1, length(key) - n + 1), i -> substring(key, i, n)))))")
    inside = h.where(F.length("key") > 1).select("book", F.col("key").alias("long"), F.explode(parts).alias("key")).where("long <> key").select("book", "key").distinct()
    return h.join(inside, ["book", "key"], "left_anti")
