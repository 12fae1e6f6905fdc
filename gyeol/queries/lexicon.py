"""Vocabularies, spellings, censuses and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.operators import evaluate, lexicon
from gyeol.queries.registry import Registry, compact
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_W = "w AS (SELECT id, unnest(regexp_extract_all(display, '[가-힣]{2,}')) AS word FROM passages)"


@query(f"WITH {_W} SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 3")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.vocabulary(table(spark, d, "passages"), "display")


@query(f"""WITH {_W}, v AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 3)
SELECT p.id, round(coalesce(avg(CASE WHEN w.word IS NULL THEN NULL WHEN v.word IS NULL THEN 1.0 ELSE 0.0 END), 0), 6) AS strange
FROM (SELECT DISTINCT id FROM passages) p LEFT JOIN w USING (id) LEFT JOIN v ON v.word = w.word GROUP BY p.id""")
def strange_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages")
    return lexicon.strange_ratio(p, "id", "display", lexicon.vocabulary(p, "display")).select("id", F.round("strange", 6).alias("strange"))


@query(r"""WITH t AS (SELECT regexp_split_to_array(trim(line, ' '), '\s+') AS t FROM (SELECT unnest(string_split(display, chr(10))) AS line FROM passages)), i AS (SELECT t[2:len(t) - 1] AS t FROM t WHERE len(t) > 2),
w AS (SELECT unnest(t) AS word FROM i), j AS (SELECT word, count(*) AS joined FROM w WHERE regexp_full_match(word, '[가-힣]{2,}') GROUP BY word),
p AS (SELECT unnest(list_transform(generate_series(1, len(t) - 1), lambda k: t[k] || t[k + 1])) AS word FROM i WHERE len(t) > 1), s AS (SELECT word, count(*) AS split FROM p GROUP BY word),
c AS (SELECT word, joined, coalesce(split, 0) AS split FROM j LEFT JOIN s USING (word) WHERE joined >= 3)
SELECT word, joined, split, CASE WHEN split / (joined + split) <= 0.03 THEN 'solid' WHEN split / (joined + split) > 0.5 THEN 'often_split' ELSE 'mixed' END AS state FROM c""")
def printed_words(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.printed_words(table(spark, d, "passages"), "display")


_SYMBOL = "[^가-힣A-Za-z0-9\\s]"


@query(f"""WITH s AS (SELECT p.book_id, c.id, unnest(regexp_extract_all(c.excerpt, '[^가-힣A-Za-z0-9 \n\t\r]')) AS symbol FROM chunks c JOIN (SELECT DISTINCT id, book_id FROM pages) p ON c.page_id = p.id),
f AS (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY id) AS r FROM (SELECT DISTINCT symbol, id FROM s))
SELECT symbol, n, groups, samples FROM (SELECT symbol, count(*) AS n, count(DISTINCT book_id) AS groups FROM s GROUP BY symbol) JOIN (SELECT symbol, array_to_string(list(id ORDER BY id), ',') AS samples FROM f WHERE r <= 4 GROUP BY symbol) USING (symbol)""")
def symbol_census(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "book_id").distinct()
    chunks = table(spark, d, "chunks").select("id", "page_id", "excerpt").join(pages, "page_id")
    out = lexicon.symbol_census(chunks, "book_id", "id", "excerpt", "[^가-힣A-Za-z0-9 \n\t\r]")
    return out.select("symbol", "n", "groups", F.array_join("samples", ",").alias("samples"))


@query("""WITH w AS (SELECT DISTINCT word FROM source_words WHERE length(word) >= 2), m AS (SELECT word, unnest(list_transform(generate_series(1, length(word) - 1), lambda i: word[1:i - 1] || '_' || word[i + 1:])) AS m FROM w)
SELECT DISTINCT a.word AS a, b.word AS b FROM m a JOIN m b USING (m) WHERE a.word < b.word""")
def one_apart(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.one_apart(table(spark, d, "source_words"), "word")


@query("""WITH w AS (SELECT DISTINCT word FROM source_words) SELECT a.word AS short, b.word AS long FROM w a JOIN w b ON contains(b.word, a.word) AND a.word <> b.word""")
def superstrings(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.superstrings(table(spark, d, "source_words"), "word")


@query("""WITH w AS (SELECT DISTINCT word FROM source_words WHERE regexp_full_match(word, '[가-힣]{2,}')), m AS (SELECT word, unnest(list_transform(generate_series(1, length(word) - 1), lambda i: {'i': i, 'm': word[1:i - 1] || '_' || word[i + 1:]})) AS x FROM w),
p AS (SELECT DISTINCT a.word AS a, b.word AS b, a.x.i AS i FROM m a JOIN m b ON a.x.m = b.x.m WHERE a.word < b.word), u AS (SELECT a, b, unicode(a[i]) - 44032 AS x, unicode(b[i]) - 44032 AS y FROM p)
SELECT a, b, concat_ws(',', CASE WHEN x // 588 <> y // 588 THEN 'onset' END, CASE WHEN x % 588 // 28 <> y % 588 // 28 THEN 'nucleus' END, CASE WHEN x % 28 <> y % 28 THEN 'coda' END) AS letters FROM u""")
def letters_apart(spark: SparkSession, d: str) -> DataFrame:
    """Which letters differ between words one syllable apart."""
    from gyeol.functions.hangul import differing_letters

    pairs = lexicon.one_apart(table(spark, d, "source_words").where(F.col("word").rlike("^[가-힣]{2,}$")), "word")
    at = F.expr("filter(sequence(1, length(a)), i -> substring(a, i, 1) <> substring(b, i, 1))[0]")
    pairs = pairs.withColumn("i", at)
    letter = lambda c: F.expr(f"substring({c}, i, 1)")
    return pairs.select("a", "b", F.concat_ws(",", differing_letters(letter("a"), letter("b"))).alias("letters"))


_ALIASES = [(0, "작문"), (0, "쓰기"), (0, "글쓰기"), (1, "독서"), (1, "읽기"), (2, "안긴문장"), (2, "내포절"), (3, "이어진문장"), (3, "접속문")]
_ALIAS_SQL = "aliases(grp, name) AS (VALUES " + ", ".join(f"({g}, '{n}')" for g, n in _ALIASES) + ")"


@query(f"""WITH {_ALIAS_SQL}, t AS (SELECT DISTINCT word AS token FROM source_words), g AS (SELECT token, min(grp) AS grp FROM t LEFT JOIN aliases ON name = token GROUP BY token)
SELECT token, coalesce(name, token) AS name FROM g LEFT JOIN aliases USING (grp)""")
def synonym_expansion(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "source_words").select(F.col("word").alias("token")).distinct()
    return lexicon.expand(tokens, spark.createDataFrame(_ALIASES, "grp int, name string"))


@query("""WITH l AS (SELECT g.book_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM (SELECT DISTINCT id, book_id, text FROM pages) g),
h AS (SELECT line FROM l GROUP BY book_id, line HAVING count(*) >= 8) SELECT line, count(*) AS n FROM l WHERE line NOT IN (SELECT line FROM h) AND line <> '' GROUP BY line""")
def running_head_removal(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "pages").select("id", "book_id", "text").distinct().select("book_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    kept = lexicon.running_heads(lines, "book_id", "line").where("line <> ''")
    return kept.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT category, source, doc_id FROM (SELECT category, source, doc_id, row_number() OVER (PARTITION BY category, source ORDER BY doc_id) AS a FROM documents) WHERE a = 1
QUALIFY row_number() OVER (PARTITION BY category ORDER BY source NULLS FIRST, doc_id) <= 5""")
def sample_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    one = F.row_number().over(Window.partitionBy("category", "source").orderBy("doc_id"))
    few = F.row_number().over(Window.partitionBy("category").orderBy(F.col("source").asc_nulls_first(), "doc_id"))
    docs = table(spark, d, "documents").select("category", "source", "doc_id", one.alias("a")).where("a = 1")
    return docs.withColumn("b", few).where("b <= 5").select("category", "source", "doc_id")


@query()
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """The same three documents of each category in every run: ordered by a seeded hash."""
    w = Window.partitionBy("category").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id")
    return table(spark, d, "documents").select("category", "doc_id", F.row_number().over(w).alias("place")).where("place <= 3")


@query("""WITH b AS (SELECT doc_id, coalesce(length(text), 0) AS n, CASE WHEN coalesce(length(text), 0) <= 128 THEN 128 WHEN length(text) <= 512 THEN 512 WHEN length(text) <= 2048 THEN 2048 ELSE 0 END AS bucket FROM documents)
SELECT bucket, count(*) AS n, CASE WHEN bucket = 0 THEN sum(n) ELSE bucket * count(*) END AS padded, sum(n) AS used FROM b GROUP BY bucket""")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The smallest bucket that each text fits into, and what padding costs."""
    n = F.coalesce(F.length("text"), F.lit(0))
    bucket = F.when(n <= 128, 128).when(n <= 512, 512).when(n <= 2048, 2048).otherwise(0)
    g = table(spark, d, "documents").select(n.alias("n"), bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("used"))
    return g.select("bucket", F.col("c").alias("n"), F.when(F.col("bucket") == 0, F.col("used")).otherwise(F.col("bucket") * F.col("c")).alias("padded"), "used")


_SHARES = f"""c AS (SELECT DISTINCT id, page_id, {compact('text')} AS n FROM chunks WHERE text IS NOT NULL), p AS (SELECT DISTINCT id AS page_id, {compact('text')} AS s FROM pages WHERE text IS NOT NULL),
a AS (SELECT id, page_id, n, unnest(range(1, length(n) - 18)) AS pos FROM c WHERE length(n) >= 20), h AS (SELECT DISTINCT a.id, a.pos FROM a JOIN p USING (page_id) WHERE contains(p.s, a.n[a.pos:a.pos + 19])),
o AS (SELECT id, pos, least(20, pos - lag(pos, 1, -20) OVER (PARTITION BY id ORDER BY pos)) AS fresh FROM h), k AS (SELECT id, sum(fresh) AS covered FROM o GROUP BY id),
share AS (SELECT c.id, round(coalesce(covered / nullif(max(length(n)), 0), 0), 6) AS share FROM c LEFT JOIN k USING (id) GROUP BY c.id, covered)"""


@query(f"WITH {_SHARES} SELECT id, share FROM share")
def copy_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of every chunk's characters that stand in runs of 20 that its page has."""
    pages = table(spark, d, "pages").where("text IS NOT NULL").select(F.col("id").alias("page_id"), "text").distinct()
    chunks = table(spark, d, "chunks").where("text IS NOT NULL").select("id", "page_id", F.col("text").alias("note")).distinct()
    return evaluate.copied_share(chunks, pages, "id", "page_id", "note", "text").select("id", F.round("share", 6).alias("share"))


@query(f"WITH {_SHARES} SELECT CASE WHEN share >= 0.6 THEN '0.6' WHEN share >= 0.3 THEN '0.3' WHEN share >= 0.2 THEN '0.2' ELSE '0' END AS band, count(*) AS n FROM share GROUP BY band")
def copy_bands(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bands(copy_share(spark, d), "share")


@query("SELECT quality, method, count(*) AS n, count(*) FILTER (WHERE printed_page IS NOT NULL) AS numbered FROM pages GROUP BY ALL")
def count_by_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy("quality", "method").agg(F.count(F.lit(1)).alias("n"), F.count("printed_page").alias("numbered"))


@query("""SELECT g.book_id, count(*) FILTER (WHERE kind = 'body') AS body, count(*) FILTER (WHERE kind = 'table') AS tables, count(*) FILTER (WHERE kind = 'exercise') AS exercises, count(*) FILTER (WHERE kind IS NULL) AS unknown
FROM passages p JOIN (SELECT DISTINCT id, book_id FROM pages) g ON p.page_id = g.id GROUP BY g.book_id""")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "book_id").distinct()
    k = F.col("kind")
    return table(spark, d, "passages").select("page_id", "kind").join(pages, "page_id").groupBy("book_id").agg(
        F.count_if(k == "body").alias("body"), F.count_if(k == "table").alias("tables"), F.count_if(k == "exercise").alias("exercises"), F.count_if(k.isNull()).alias("unknown"),
    )


@query("""WITH q AS (SELECT page_id, score, ocr_score FROM (SELECT DISTINCT * FROM page_quality) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY checked_at DESC NULLS LAST, score DESC NULLS LAST, ocr_score DESC NULLS LAST) = 1)
SELECT page_id, CASE WHEN score IS NULL THEN 'short' WHEN score >= -3.05 THEN 'good' WHEN ocr_score IS NOT NULL AND ocr_score >= score + 0.12 AND ocr_score >= -3.4 THEN 'adopt' WHEN score < -3.4 THEN 'review' ELSE 'keep' END AS verdict FROM q""")
def ocr_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether the second reading of a page is taken, from the latest scores."""
    order = [F.desc_nulls_last(c) for c in ("checked_at", "score", "ocr_score")]
    q = table(spark, d, "page_quality").distinct().withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).where("r = 1")
    s, o = F.col("score"), F.col("ocr_score")
    verdict = F.when(s.isNull(), "short").when(s >= -3.05, "good").when((o >= s + 0.12) & (o >= -3.4), "adopt").when(s < -3.4, "review").otherwise("keep")
    return q.select("page_id", verdict.alias("verdict"))


@query(r"""WITH w AS (SELECT DISTINCT word, unnest(range(2, length(word) - 1)) AS i FROM source_words WHERE length(word) >= 4), k AS (SELECT DISTINCT word, word[1:i] AS l, word[i + 1:] AS r FROM w),
t AS (SELECT list_filter(regexp_split_to_array(trim(display, ' '), '\s+'), lambda x: true) AS t FROM passages WHERE display IS NOT NULL), s AS (SELECT word, count(*) AS joined FROM (SELECT unnest(t) AS word FROM t) GROUP BY word),
p AS (SELECT unnest(list_transform(generate_series(1, len(t) - 1), lambda i: {'l': t[i], 'r': t[i + 1]})) AS p FROM t WHERE len(t) > 1), q AS (SELECT p.l AS l, p.r AS r, count(*) AS spaced FROM p GROUP BY ALL),
c AS (SELECT k.word, max(coalesce(joined, 0)) AS joined, sum(coalesce(spaced, 0)) AS spaced FROM k LEFT JOIN s USING (word) LEFT JOIN q ON q.l = k.l AND q.r = k.r GROUP BY k.word)
SELECT word, joined, CAST(spaced AS BIGINT) AS spaced, (joined >= 3 AND (spaced <= 0.03 * (joined + spaced) OR (length(word) >= 3 AND spaced <= 1 AND joined >= 8))) OR (length(word) >= 4 AND joined >= 1 AND spaced = 0) AS accepted FROM c""")
def joined_spellings(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "source_words").select("word").distinct().where("length(word) >= 4").withColumn("i", F.expr("explode(sequence(2, length(word) - 2))"))
    keys = w.select(F.expr("substring(word, 1, i)").alias("left_part"), F.expr("substring(word, i + 1)").alias("right_part"))
    return lexicon.spacing(table(spark, d, "passages").where("display IS NOT NULL"), "display", keys)
