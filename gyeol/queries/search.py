"""Passage search over the library: predicates, weights, ranking, diversity, dense and hybrid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions.text import contains_all
from gyeol.operators import dense, search
from gyeol.plans import question
from gyeol.queries.registry import WS, Registry
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

QUESTION = "안긴문장과 모음은 무엇인가요?"
GROUPS = question.groups(QUESTION)
LIMIT = 8


def _all(g) -> str:
    return " AND ".join("(" + " OR ".join(f"contains(compact, '{t}')" for t in x) + ")" for x in g)


def _count(g) -> str:
    return " + ".join(f"(length(compact) - length(replace(compact, '{t}', ''))) // {len(t)}" for t in g)


_SCOPE = """scope AS (SELECT p.*, b.book_id, b.title, b.category, g.pdf_page, g.quality FROM passages p
  JOIN (SELECT DISTINCT id AS page_id, book_id, pdf_page, printed_page, quality FROM pages) g USING (page_id)
  JOIN (SELECT id AS book_id, title, category FROM books WHERE category <> '참고자료') b USING (book_id))"""
_WEIGHTS = "w AS (SELECT " + ", ".join(f"ln(2 + count(*) / (1.0 + count(*) FILTER (WHERE {_all([g])}))) AS w{i}" for i, g in enumerate(GROUPS)) + " FROM scope)"
_SCORE = "(" + " + ".join(f"w{i} * (1 + ln(1 + least(6, {_count(g)})))" for i, g in enumerate(GROUPS)) + ") / (0.8 + 0.2 * length(compact) / 400)"
_RANKED = f"""WITH {_SCOPE}, {_WEIGHTS},
hits AS (SELECT scope.*, {_SCORE} AS score FROM scope, w WHERE {_all(GROUPS)}),
one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ordinal, id) = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, page_id, id) AS nb FROM one),
c AS (SELECT * FROM b ORDER BY nb > 1, score DESC, page_id, id LIMIT {LIMIT})
SELECT id, page_id, book_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, page_id, id) AS rank FROM c"""


def _scope(spark: SparkSession, d: str, category: str = search.EVERYTHING) -> DataFrame:
    return search.scoped(table(spark, d, "passages"), table(spark, d, "pages"), table(spark, d, "books"), category)


@query(_RANKED)
def lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: passages that hold every word group, by weighted damped frequency, one a page, diverse across books."""
    return search.search(_scope(spark, d), GROUPS, LIMIT).select("id", "page_id", "book_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_SCOPE} SELECT id, page_id, book_id, kind FROM scope WHERE {_all(GROUPS)}")
def cnf_filter(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d).where(contains_all(F.col("compact"), GROUPS)).select("id", "page_id", "book_id", "kind")


@query(f"WITH {_SCOPE} " + " UNION ALL ".join(f"SELECT '{g[0]}' AS head, count(*) FILTER (WHERE {_all([g])}) AS df, round(ln(2 + count(*) / (1.0 + count(*) FILTER (WHERE {_all([g])}))), 6) AS weight FROM scope" for g in GROUPS))
def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    n, found = search.document_frequencies(_scope(spark, d), "compact", GROUPS)
    return spark.createDataFrame([(g[0], f, round(w, 6)) for g, f, w in zip(GROUPS, found, search.weights(n, found), strict=True)], "head string, df bigint, weight double")


_PHRASE = ("대조문해력", "한국어운율", "심화방언")


@query(f"WITH {_SCOPE} SELECT phrase, df FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER (WHERE contains(compact, '{p}')) AS df, count(*) AS n FROM scope" for p in _PHRASE) + ") WHERE df > 0 AND df < greatest(3, n * 0.02) ORDER BY df, phrase LIMIT 1")
def rare_phrase_focus(spark: SparkSession, d: str) -> DataFrame:
    halves = [(p[:2] if p[:2] in ("대조", "심화") else p[:3], p[2:] if p[:2] in ("대조", "심화") else p[3:]) for p in _PHRASE]
    groups = [(w,) for h in halves for w in h]
    rare = search.rare_phrase(_scope(spark, d), "compact", " ".join(_PHRASE), groups)
    return spark.createDataFrame([(rare[1], rare[0])] if rare else [], "phrase string, df bigint")


@query(f"WITH {_SCOPE} SELECT category, count(*) AS passages, count(DISTINCT page_id) AS pages FROM scope GROUP BY category")
def scope_counts(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("page_id").alias("pages"))


@query(f"""WITH {_SCOPE} SELECT id FROM scope WHERE coalesce(kind, '') NOT IN ('margin', 'fragment', 'index', 'exercise', 'table', 'catalog') AND raw IS NOT NULL
  AND NOT (len(regexp_extract_all(raw, '[·•]')) >= 8 AND len(regexp_extract_all(raw, '다[.!?。]')) < len(regexp_extract_all(raw, '[·•]')) / 2.0)""")
def kind_gates(spark: SparkSession, d: str) -> DataFrame:
    return _scope(spark, d).where(search.kind_admissible(F.col("kind"), F.col("raw"))).select("id")


ASKED = question.asked("독서의 과정과 종류는?", question.groups("독서의 과정과 종류는?"))
_IN = "(contains({0}, '독서') OR contains({0}, '읽기')) AND contains({0}, '과정')"
_TIMES = lambda column, *words: " + ".join(f"(length({column}) - length(replace({column}, '{w}', ''))) // {len(w)}" for w in words)
_FOUND = lambda column, pattern: f"len(regexp_extract_all({column}, '{pattern}'))"
_C = f"lower(regexp_replace(display, '{WS}', '', 'g'))"


@query(f"""WITH {_SCOPE},
w AS (SELECT ln(2 + count(*) / (1.0 + count(*) FILTER (WHERE contains(compact, '독서') OR contains(compact, '읽기')))) AS w0, ln(2 + count(*) / (1.0 + count(*) FILTER (WHERE contains(compact, '과정')))) AS w1 FROM scope),
t AS (SELECT DISTINCT page_id FROM scope WHERE kind = 'table' AND {_IN.format('compact')}),
h AS (SELECT id, page_id, kind, title, quality, display, {_C} AS c FROM scope WHERE {_IN.format('compact')} AND display IS NOT NULL
  AND coalesce(kind, '') NOT IN ('margin', 'fragment', 'index', 'exercise', 'table', 'catalog')
  AND NOT ({_FOUND('raw', '[·•]')} >= 8 AND {_FOUND('raw', '다[.!?。]')} < {_FOUND('raw', '[·•]')} / 2.0)
  AND NOT (starts_with(title, '쓰기') OR starts_with(title, '작문') OR starts_with(title, '말하기') OR starts_with(title, '화법') OR starts_with(title, '듣기'))
  AND {_FOUND('compact', '교과서|출판사|천재교육|비상|지학사|신사고')} < 3),
k AS (SELECT * FROM h WHERE length(c) >= 65 AND regexp_matches(display, '[가-힣]다(?:[.!?。]|$|[\\s\\p{{Z}}]|[（(])') AND {_FOUND('c', '성취기준|교육과정|교과서|단원')} < 2),
s1 AS (SELECT *, (w0 * (1 + ln(1 + least(6, {_TIMES('c', '독서', '읽기')}))) + w1 * (1 + ln(1 + least(6, {_TIMES('c', '과정')})))) / (0.8 + 0.2 * length(c) / 400)
  + 0.7 * least(8, {_FOUND('c', '한다|된다|이다|있다|없다|뜻하|의미하|가리키|말한다|이라|해야|통해|때문|과정|전략|구분|나뉘|예를')}) AS s FROM k, w),
s2 AS (SELECT *, CASE WHEN {_IN.format('c')} THEN s ELSE s * 0.6 END
  + CASE WHEN regexp_matches(c[1:220], '(?:독서|읽기)(?:의)?과정(?:은|는|이란|란)') THEN 18 ELSE 0 END
  + CASE WHEN regexp_matches(c, '단계|구분|나누|나뉘|과정은') THEN 12 ELSE 0 END + 4 * least(5, {_FOUND('c', '[가-힣]{2,8}하기')})
  + CASE WHEN regexp_matches(c, '나누|나뉘|분류|대별|구분') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(display[1:180], '(?:^|[^가-힣])(?:독[\\s\\p{{Z}}]*서|읽[\\s\\p{{Z}}]*기)[\\s\\p{{Z}}]*(?:은|는|란|이란|의[\\s\\p{{Z}}]*(?:종류|분류|개념))') THEN 8 ELSE 0 END
  + CASE WHEN regexp_matches(display[1:180], '(?:^|[^가-힣])과[\\s\\p{{Z}}]*정[\\s\\p{{Z}}]*(?:은|는|란|이란|의[\\s\\p{{Z}}]*(?:종류|분류|개념))') THEN 8 ELSE 0 END
  + CASE WHEN regexp_matches(c, '가리킨다|일컫는다|뜻한다|의미한다|규정될수있다|정의할수있다') THEN 6 ELSE 0 END
  + CASE WHEN regexp_matches(c[1:400], '(?:독서|읽기|과정)(?:\\([^)]{{0,40}}\\))?(?:으로|로|이라고|라고|이라|라)(?:도)?(?:불리|불린|부르|부른|일컫|한다|칭한)') THEN 8 ELSE 0 END AS s_ FROM s1),
s3 AS (SELECT *, (CASE WHEN regexp_matches(c, '교과서|성취기준|이책지은이|용어를쓰|이책에서는') THEN s_ * 0.65 ELSE s_ END)
  + CASE WHEN regexp_matches(c, '(?:독서|읽기)(?:의|인|으로|적인|적으로)?과정') THEN 5 ELSE 0 END AS a,
  greatest({_TIMES('c', '쓰기', '작문')}, {_TIMES('c', '말하기', '화법')}, {_TIMES('c', '듣기', '화법')}) > 1.5 * ({_TIMES('c', '독서', '읽기')}) AS other FROM s2),
s4 AS (SELECT *, a * (CASE WHEN other THEN 0.35 ELSE 1 END) * (CASE WHEN contains(title, '읽기') OR contains(title, '독서') THEN 1.25 ELSE 1 END) * (CASE WHEN kind = 'note' THEN 0.75 ELSE 1 END)
  + (CASE WHEN page_id IN (SELECT page_id FROM t) THEN 6 ELSE 0 END) AS b FROM s3)
SELECT id, round(b * (CASE WHEN quality = 'review' THEN 0.5 ELSE 1 END) * (CASE WHEN contains(title, '국어사') THEN 0.6 ELSE 1 END)
  * (CASE WHEN {_FOUND('c', '[가-힣][A-Za-z%&@][가-힣]|[A-Za-z][가-힣][A-Za-z]')} > greatest(4, length(c) * 0.012) THEN 0.35 ELSE 1 END), 6) AS score FROM s4""")
def explanation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every step of the score, for whole passages in the place of windows."""
    scope = _scope(spark, d)
    rows = search.candidates(scope, ASKED).where("display IS NOT NULL").withColumn("window", F.col("display"))
    rows = rows.join(search.pages_with_table(scope, ASKED), "page_id", "left")
    scores = search.scored(rows, ASKED, search.weight_columns(scope, "compact", ASKED.groups), F.coalesce("has_table", F.lit(False)))
    return scores.select("id", F.round("score", 6).alias("score"))


@query()
def explanations(spark: SparkSession, d: str) -> DataFrame:
    """The best windows that explain what a question asks, one a page, diverse across books."""
    asked = question.asked(QUESTION, GROUPS)
    return search.answers(_scope(spark, d), asked, LIMIT).select("id", "page_id", "book_id", "excerpt", "window", F.round("score", 3).alias("score"), "rank")


# --- dense ---------------------------------------------------------------------------------------------------------
_USABLE = "SELECT digest, CAST(vector AS DOUBLE[]) AS v FROM vectors WHERE len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_Q = "SELECT vector FROM (SELECT digest, CAST(vector AS DOUBLE[]) AS vector FROM vectors WHERE len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0) ORDER BY digest LIMIT 1"
_SIM = f"sim AS (SELECT digest, list_cosine_similarity(v, ({_Q})) AS cosine FROM ({_USABLE}))"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    good = "size(vector) = 128 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x)) AND exists(vector, x -> x <> 0)"
    return table(spark, d, "vectors").where(good).orderBy("digest").select("vector").first()[0]


@query(f"WITH {_SIM} SELECT digest, round(cosine, 5) AS cosine FROM (SELECT DISTINCT digest, cosine FROM sim) ORDER BY cosine DESC, digest LIMIT 60")
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").dropDuplicates(["digest"])
    return dense.top_k(v, "digest", "vector", _query_vector(spark, d)).select("digest", F.round("cosine", 5).alias("cosine"))


@query(f"WITH {_SIM} SELECT c.passage_id, round(max(cosine), 5) AS cosine FROM (SELECT DISTINCT passage_id, digest FROM chunks) c JOIN sim USING (digest) GROUP BY c.passage_id")
def passage_similarity(spark: SparkSession, d: str) -> DataFrame:
    similar = dense.similarity(table(spark, d, "vectors"), "digest", "vector", _query_vector(spark, d))
    best = dense.best_of_group(similar, table(spark, d, "chunks").select("passage_id", "digest").distinct(), "digest", "passage_id")
    return best.select("passage_id", F.round("cosine", 5).alias("cosine"))


@query(f"""WITH {_SCOPE}, {_WEIGHTS}, {_SIM},
dense AS (SELECT c.passage_id AS id, max(cosine) AS cosine FROM (SELECT DISTINCT passage_id, digest FROM chunks) c JOIN sim USING (digest) GROUP BY c.passage_id),
lex AS (SELECT id, max({_SCORE}) AS score FROM scope, w WHERE {_all(GROUPS)} GROUP BY id ORDER BY score DESC, id LIMIT 40)
SELECT id, round(100 * coalesce(cosine, 0) + 0.45 * score, 4) AS score, 'lexical' AS match FROM lex LEFT JOIN dense USING (id)
UNION ALL SELECT id, round(100 * cosine, 4), 'semantic' FROM dense WHERE cosine >= 0.55 AND id NOT IN (SELECT id FROM lex)""")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    scope = _scope(spark, d)
    score = search.lexical_score(F.col("compact"), GROUPS, search.weight_columns(scope, "compact", GROUPS))
    lexical = scope.where(contains_all(F.col("compact"), GROUPS)).withColumn("score", score).groupBy("id").agg(F.max("score").alias("score"))
    similar = dense.similarity(table(spark, d, "vectors"), "digest", "vector", _query_vector(spark, d))
    per_passage = dense.best_of_group(similar, table(spark, d, "chunks").select("passage_id", "digest").distinct(), "digest", "passage_id").withColumnRenamed("passage_id", "id")
    return search.fused(lexical, per_passage).select("id", F.round("score", 4).alias("score"), "match")


@query()
def hybrid_answers(spark: SparkSession, d: str) -> DataFrame:
    """Explanations by words and by meaning, with the demotions, margins and gates of both."""
    similar = dense.similarity(table(spark, d, "vectors"), "digest", "vector", _query_vector(spark, d))
    chunks = table(spark, d, "chunks").select(F.col("passage_id").alias("id"), "digest", "excerpt", F.col("text").alias("chunk")).distinct()
    near = chunks.join(similar, "digest").drop("digest")
    return search.hybrid(_scope(spark, d), question.asked(QUESTION, GROUPS), near, LIMIT).select("id", "page_id", "book_id", F.round("score", 3).alias("score"), "match", "rank")


@query("SELECT vec_id, label, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(norm, 5).alias("norm"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT label, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS cosine FROM embeddings, q)
SELECT label, round(max(cosine), 5) AS cosine, count(*) AS n FROM s GROUP BY label""")
def label_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    similar = dense.similarity(e, "vec_id", "embedding", q)
    return e.select("vec_id", "label").join(similar, "vec_id").groupBy("label").agg(F.round(F.max("cosine"), 5).alias("cosine"), F.count(F.lit(1)).alias("n"))


@query()
def relaxed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to a question whose quoted sentence no passage has: its shorter form is answered."""
    q = "'두 사람이 손을 잡고 걷는다.'는 안긴문장인가?"
    return search.retrieve(_scope(spark, d), q, ["안긴문장", "모음"], LIMIT).select("id", "page_id", F.round("score", 3).alias("score"), "rank")


@query()
def planned_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Pages of evidence for a question that was planned as three searches."""
    from gyeol.operators import evidence

    scope = _scope(spark, d)
    plans = [question.asked(q, question.groups(q)) for q in ("안긴문장의 종류", "모음의 뜻", "대명사의 기능")]
    pages = table(spark, d, "pages").groupBy("id").agg(F.min(F.struct("book_id", "pdf_page", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))).alias("p")).select("id", "p.*")
    return evidence.collected([search.answers(scope, a, 24) for a in plans], pages, budget=(32, 20_000))
