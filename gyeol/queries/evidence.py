"""Evidence, answers, metrics and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.functions.text import split_sentences
from gyeol.operators import evaluate, evidence
from gyeol.queries.registry import Registry, compact
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_WORDS = ("운율", "방언", "모음", "문해력")
_RANKS = "r AS (" + " UNION ALL ".join(
    f"SELECT 'q' AS question, {i} AS grp, g.book_id, p.id, length(p.raw) AS chars, (length(compact) - length(replace(compact, '{w}', ''))) // {len(w)} AS hits FROM (SELECT DISTINCT id, page_id, raw, compact FROM passages) p JOIN (SELECT DISTINCT id, book_id FROM pages) g ON p.page_id = g.id WHERE contains(compact, '{w}')"
    for i, w in enumerate(_WORDS)
) + "), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY hits DESC, id) - 1 AS rank FROM r)"


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """Results of four searches for one question: question, grp, book_id, id, chars, rank; the forty best of each."""
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "book_id").distinct()
    p = table(spark, d, "passages").select("id", "page_id", "raw", "compact").distinct()
    p = p.withColumn("g", F.explode(F.array(*(F.when(F.contains("compact", F.lit(w)), F.struct(F.lit(i).alias("grp"), F.lit(w).alias("w"))) for i, w in enumerate(_WORDS))))).where("g IS NOT NULL")
    hits = ((F.length("compact") - F.length(F.replace("compact", F.col("g.w"), F.lit("")))) / F.length("g.w")).cast("int")
    rows = p.select("id", "page_id", F.length("raw").alias("chars"), "g.grp", hits.alias("hits"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("hits"), "id")) - 1
    top = rows.withColumn("rank", rank).where("rank < 40")
    return top.join(pages, "page_id").select(F.lit("q").alias("question"), "grp", "book_id", "id", "chars", "rank")


@query(f"""WITH {_RANKS}, o AS (SELECT *, row_number() OVER (PARTITION BY question, book_id ORDER BY rank >= 8, rank, grp, id) AS b FROM k WHERE rank < 40)
SELECT id, grp, rank, row_number() OVER (PARTITION BY question ORDER BY b > 11, rank >= 8, rank, grp, id) AS place FROM o QUALIFY place <= 24""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return evidence.round_robin(_searches(spark, d), "question", "book_id", "rank", "grp").select("id", "grp", "rank", "place")


@query(f"WITH {_RANKS} SELECT id, row_number() OVER (ORDER BY min((rank, grp))) AS rank FROM k WHERE rank < 40 GROUP BY id")
def interleave_lists(spark: SparkSession, d: str) -> DataFrame:
    return evidence.interleaved(_searches(spark, d), "grp", "rank", "id", ["question"]).select("id", "rank")


@query()
def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    """Round robin, then greedily what fits under pages and characters."""
    chosen = evidence.round_robin(_searches(spark, d), "question", "book_id", "rank", "grp")
    return evidence.within_budget(chosen, "question", "place", "chars", pages=16, most=3000).select("id", "place", "chars")


@query(f"WITH {_RANKS} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY rank, grp, id) AS nth, id FROM k WHERE rank < 40")
def position_within_book(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy("rank", "grp", "id"))
    return _searches(spark, d).select("book_id", nth.alias("nth"), "id")


@query(f"""WITH {_RANKS}, m AS (SELECT book_id AS mode, grp AS q, CASE WHEN chars > 200 THEN rank + 1 END AS rank FROM k WHERE rank < 40),
f AS (SELECT mode, q, min(rank) AS r FROM m GROUP BY ALL)
SELECT mode, round(avg(CASE WHEN coalesce(r, 99) <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN coalesce(r, 99) <= 3 THEN 1.0 ELSE 0 END), 6) AS hit3, round(avg(CASE WHEN coalesce(r, 99) <= 8 THEN 1.0 ELSE 0 END), 6) AS hit8, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, count(*) AS queries FROM f GROUP BY mode""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates and mean reciprocal rank of four searches in each book, where long passages are the right ones."""
    r = _searches(spark, d).select(F.col("book_id").alias("mode"), F.col("grp").alias("query"), F.when(F.col("chars") > 200, F.col("rank") + 1).alias("rank"))
    m = evaluate.retrieval_metrics(r, "mode", "query", "rank")
    return m.select("mode", *(F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit8", "mrr")), "queries")


def _pairs(column: str) -> str:
    k = compact(column)
    return f"list_distinct(list_transform(range(1, length({k})), lambda i: ({k})[i:i + 1]))"


@query(rf"""WITH c AS (SELECT DISTINCT passage_id, id AS claim_id, {_pairs('excerpt')} AS b FROM chunks WHERE excerpt IS NOT NULL), p AS (SELECT DISTINCT id AS passage_id, display FROM passages WHERE display IS NOT NULL),
s AS (SELECT passage_id, trim(unnest(string_split(regexp_replace(display, '([다요까][.!?。][”’'']?)(\s|$)', '\1' || chr(1), 'g'), chr(1)))) AS quote FROM p),
q AS (SELECT passage_id, quote, {_pairs('quote')} AS b FROM s WHERE quote <> ''),
j AS (SELECT c.passage_id, claim_id, quote, len(list_intersect(c.b, q.b)) / (sqrt(len(q.b)) + 1) AS score FROM c JOIN q USING (passage_id))
SELECT passage_id, claim_id, md5(quote) AS quote, round(score, 4) AS score FROM j QUALIFY row_number() OVER (PARTITION BY passage_id, claim_id ORDER BY score DESC, abs(length(quote) - 260), quote) = 1""")
def best_quotes(spark: SparkSession, d: str) -> DataFrame:
    """For each chunk the sentence of its passage that shares most with the chunk's excerpt."""
    claims = table(spark, d, "chunks").where("excerpt IS NOT NULL").select("passage_id", F.col("id").alias("claim_id"), F.col("excerpt").alias("claim")).distinct()
    p = table(spark, d, "passages").where("display IS NOT NULL").select(F.col("id").alias("passage_id"), "display").distinct()
    quotes = p.select("passage_id", F.explode(split_sentences(F.col("display"))).alias("quote"))
    return evidence.best_quote(claims, quotes, "passage_id").select("passage_id", "claim_id", F.md5("quote").alias("quote"), F.round("score", 4).alias("score"))


@query("SELECT doc_id, source, category, n_chars FROM documents WHERE category IS NOT NULL")
def closed_projection(spark: SparkSession, d: str) -> DataFrame:
    """What a reader without rights sees: an allow list of fields, the text dropped from the nested row."""
    row = F.struct("doc_id", "source", "category", "n_chars", "text", "lang")
    return table(spark, d, "documents").where("category IS NOT NULL").select(row.alias("r")).select(F.col("r").dropFields("text", "lang").alias("r")).select("r.*")
