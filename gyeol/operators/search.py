"""Passage search: containment, frequency weights, the score of an explanation, dense neighbours, one passage a page, diverse
books."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.functions.text import compact, contains_all, count_of, occurrences
from gyeol.operators.reading import with_window
from gyeol.plans.question import FAMILIES, Asked

Groups = Sequence[Sequence[str]]
#: Books of this category are reference material and no evidence.
REFERENCE = "참고자료"
EVERYTHING = "전체"
#: Weight of the lexical score beside the cosine, the cosine that a passage found by meaning needs (alone
#: and beside others), dense candidates, lexical candidates, and how far below the best one may lie.
LEXICAL_WEIGHT, DENSE_FLOOR, DENSE_FLOOR_ALONE, DENSE_CANDIDATES, LEXICAL_CANDIDATES = 0.45, 0.55, 0.58, 60, 40
CORE_MARGIN, WIDE_MARGIN, LEXICAL_FLOOR = 8, 15, 0.45


def scoped(passages: DataFrame, pages: DataFrame, books: DataFrame, category: str = EVERYTHING, book_id: str | None = None, version: str | None = None) -> DataFrame:
    """Passages of the books in scope. An unknown category gives no rows; null categories are out of every scope."""
    inside = F.col("category") != REFERENCE
    if category != EVERYTHING:
        inside &= F.col("category") == category
    b = books.where(inside).select(F.col("id").alias("book_id"), "title", "category")
    if book_id:
        b = b.where(F.col("book_id") == book_id)
    p = pages.select(F.col("id").alias("page_id"), "book_id", "pdf_page", "printed_page", "quality").distinct()
    rows = passages.where(F.col("text_version") == version) if version else passages
    # 26 books have a fixed size: the join with pages runs first on what they leave
    return rows.join(p.join(b, "book_id"), "page_id")


# --- weights -------------------------------------------------------------------------------------------------------
def document_frequencies(df: DataFrame, text: str, groups: Groups) -> tuple[int, list[int]]:
    """Rows in scope, and rows of each group: one pass, one row to the driver."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(contains_all(F.col(text), [g])).alias(f"d{i}") for i, g in enumerate(groups))).first()
    return row["n"], [row[f"d{i}"] for i in range(len(groups))]


def weights(n: int, frequencies: Sequence[int]) -> list[float]:
    return [log(2 + n / (1 + d)) for d in frequencies]


def weight_columns(df: DataFrame, text: str, groups: Groups) -> list[Column]:
    """The weights of the groups in a scope: fields of one scalar subquery, so that the scope is read once more in the same job."""
    n = F.count(F.lit(1)).cast("double")
    w = df.agg(F.struct(*(F.log(2 + n / (1 + F.count_if(contains_all(F.col(text), [g])))).alias(f"w{i}") for i, g in enumerate(groups))).alias("w")).scalar()
    return [w[f"w{i}"] for i in range(len(groups))]


def lexical_score(text: Column, groups: Groups, w: Sequence[float | Column]) -> Column:
    """Damped term frequencies by weight, divided by a length norm."""
    def one(g: Sequence[str], weight: float | Column) -> Column:
        n = reduce(lambda a, b: a + b, [occurrences(text, t) for t in g])
        return (weight if isinstance(weight, Column) else F.lit(weight)) * (1 + F.log1p(F.least(F.lit(6), n).cast("double")))

    return reduce(lambda a, b: a + b, [one(g, x) for g, x in zip(groups, w, strict=True)]) / (0.8 + 0.2 * F.length(text) / 400)


def rare_phrase(df: DataFrame, text: str, question: str, groups: Groups) -> tuple[int, str] | None:
    """The rarest pair of neighbouring heads that the question joins and that few rows have, if any."""
    asked = "".join(question.split()).lower()
    phrases = [p for p in dict.fromkeys(a[0] + b[0] for a, b in zip(groups, groups[1:], strict=False) if len(a[0]) >= 2) if p in asked]
    if not phrases:
        return None
    n, found = document_frequencies(df, text, [[p] for p in phrases])
    rare = [(d, p) for d, p in zip(found, phrases, strict=True) if 0 < d < max(3, n * 0.02)]
    return min(rare, default=None)


# --- gates ---------------------------------------------------------------------------------------------------------
#: What names publishers, the curriculum, and the book itself.
PUBLISHERS = "교과서|출판사|천재교육|비상|지학사|신사고"
CURRICULUM = "성취기준|교육과정|교과서|단원"
SELF_REFERENCE = "교과서|성취기준|이책지은이|용어를쓰|이책에서는"


def _foreign(asked: Asked) -> list[str]:
    """Names of the fields that the question doesn't ask about, in the order of the fields."""
    return [t for f in FAMILIES if f != asked.family for t in f]


def kind_admissible(kind: Column, raw: Column, asked: Asked | None = None) -> Column:
    """Kinds that may answer: furniture never, exercises, tables and catalogues only if asked for; no list of bullets
    with fewer sentences than half its bullets. An unknown kind is no reason against a passage."""
    k = F.coalesce(kind, F.lit(""))
    out = ~k.isin("margin", "fragment", "index")
    for name, wanted in (("exercise", asked and asked.exercises), ("table", asked and asked.tables), ("catalog", asked and asked.catalogue)):
        if not wanted:
            out &= k != name
    bullets = count_of(raw, "[·•]")
    return out & ~((bullets >= 8) & (count_of(raw, "다[.!?。]") < bullets / 2))


def book_admissible(title: Column, asked: Asked) -> Column:
    """No book of another field where the question names exactly one."""
    if not (asked.family and asked.single_family):
        return F.lit(True)
    return ~reduce(lambda a, b: a | b, [F.coalesce(title, F.lit("")).startswith(t) for t in _foreign(asked)])


def no_catalogue(text: Column, asked: Asked) -> Column:
    """Neither a list of publishers nor talk about the curriculum, unless asked for."""
    return F.lit(True) if asked.catalogue else (count_of(text, PUBLISHERS) < 3) & (count_of(text, CURRICULUM) < 2)


# --- the score of an explanation -----------------------------------------------------------------------------------
def _literal(term: str, between: str = "") -> str:
    return between.join(rf"\Q{c}\E" for c in ([term] if not between else term))


def _any(column: Column, patterns: Sequence[str]) -> Column:
    return column.rlike("|".join(f"(?:{p})" for p in patterns))


def steps(asked: Asked, tables: Column) -> list[tuple[str, Column, float | Column]]:
    """(operation, condition, value) in the order in which they change the score; columns as in `explained`."""
    c, shown = F.col("c"), F.col("window")
    g, family = asked.groups, asked.family
    yes = F.lit(True)
    out: list[tuple[str, Column, float | Column]] = [
        ("+", yes, 0.7 * F.least(F.lit(8), count_of(c, "한다|된다|이다|있다|없다|뜻하|의미하|가리키|말한다|이라|해야|통해|때문|과정|전략|구분|나뉘|예를"))),
        ("*", ~contains_all(c, asked.exact), 0.6),
    ]
    if 1 < len(g) <= 3:
        phrases = ["(?:의)?".join(map(_literal, parts)) + "(?:은|는|이란|란)" for parts in itertools.product(*g)]
        out.append(("+", _any(F.substring(c, 1, 220), phrases), 18))
    if asked.process:
        out.append(("+", c.rlike("단계|구분|나누|나뉘|과정은"), 12))
        out.append(("+", yes, 4 * F.least(F.lit(5), count_of(c, "[가-힣]{2,8}하기"))))
    if asked.kinds:
        out.append(("+", c.rlike("나누|나뉘|분류|대별|구분"), 10))
    for names in g:
        topic = [rf"(?<![가-힣]){_literal(t, r'[\s\p{Z}]*')}[\s\p{{Z}}]*(?:은|는|란|이란|의[\s\p{{Z}}]*(?:종류|분류|개념))" for t in names]
        out.append(("+", _any(F.substring(shown, 1, 180), topic), 8))
    out.append(("+", c.rlike("가리킨다|일컫는다|뜻한다|의미한다|규정될수있다|정의할수있다"), 6))
    named = [rf"{_literal(t)}(?:\([^)]{{0,40}}\))?(?:으로|로|이라고|라고|이라|라)(?:도)?(?:불리|불린|부르|부른|일컫|한다|칭한)" for names in g for t in names]
    out.append(("+", _any(F.substring(c, 1, 400), named), 8))
    if not asked.catalogue:
        out.append(("*", c.rlike(SELF_REFERENCE), 0.65))
    for a, b in zip(g, g[1:], strict=False):
        out.append(("+", _any(c, [f"{_literal(x)}(?:의|인|으로|적인|적으로)?{_literal(y)}" for x in a for y in b]), 5))
    if family:
        inside = reduce(lambda x, y: x + y, [occurrences(c, t) for t in family])
        others = [reduce(lambda x, y: x + y, [occurrences(c, t) for t in f]) for f in FAMILIES if f != family]
        out.append(("*", F.greatest(*others) > inside * 1.5, 0.35))
        out.append(("*", reduce(lambda x, y: x | y, [F.contains("title", F.lit(t)) for t in family]), 1.25))
    out += [("*", F.col("kind") == "table", 0.5), ("*", F.col("kind") == "note", 0.75), ("+", tables, 6), ("*", F.col("quality") == "review", 0.5)]
    if not asked.history:
        out.append(("*", F.contains("title", F.lit("국어사")), 0.6))
    noisy = count_of(c, "[가-힣][A-Za-z%&@][가-힣]|[A-Za-z][가-힣][A-Za-z]")
    out.append(("*", noisy > F.greatest(F.lit(4.0), F.length(c) * 0.012), 0.35))
    return out


def scored(df: DataFrame, asked: Asked, w: Sequence[float | Column], tables: Column) -> DataFrame:
    """df (window, kind, title, quality) with c, the compact window, and its score; windows that explain nothing are left out."""
    df = df.withColumn("c", compact(F.col("window")))
    df = df.where((F.length("c") >= 65) & F.col("window").rlike(r"[가-힣]다(?=[.!?。]|$|[\s\p{Z}]|[（(])"))
    if not asked.catalogue:
        df = df.where(count_of(F.col("c"), CURRICULUM) < 2)
    score = lexical_score(F.col("c"), asked.groups, w)
    for operation, condition, value in steps(asked, tables):
        value = value if isinstance(value, Column) else F.lit(float(value))
        # the score stands once in each step, so that the expression grows with their number only
        holds = F.coalesce(condition, F.lit(False))
        score = score + F.when(holds, value).otherwise(0.0) if operation == "+" else score * F.when(holds, value).otherwise(1.0)
    return df.withColumn("score", score)


def candidates(scope: DataFrame, asked: Asked, text: str = "compact") -> DataFrame:
    """Rows of a scope that hold every group and pass the gates: what the windows are cut from."""
    gates = kind_admissible(F.col("kind"), F.col("raw"), asked) & book_admissible(F.col("title"), asked)
    hits = scope.where(contains_all(F.col(text), asked.groups)).where(F.coalesce(gates, F.lit(False)))
    return hits if asked.catalogue else hits.where(count_of(F.col(text), PUBLISHERS) < 3)


def pages_with_table(scope: DataFrame, asked: Asked, text: str = "compact") -> DataFrame:
    """Pages with a table that holds every group."""
    return scope.where((F.col("kind") == "table") & contains_all(F.col(text), asked.groups)).select("page_id", F.lit(True).alias("has_table")).distinct()


def explained(scope: DataFrame, asked: Asked, text: str = "compact") -> DataFrame:
    """Lexical candidates of a scope with excerpt, window and score: the best window of each passage, by its explanation.

    No groups and empty scopes give no rows; null texts match nothing.
    """
    if not asked.groups:
        return scope.limit(0).withColumns({"excerpt": F.lit(""), "window": F.lit(""), "c": F.lit(""), "score": F.lit(0.0)})
    rows = with_window(candidates(scope, asked, text), "raw", "display", asked.groups).join(pages_with_table(scope, asked, text), "page_id", "left")
    return scored(rows, asked, weight_columns(scope, text, asked.groups), F.coalesce("has_table", F.lit(False))).drop("has_table")


# --- choice --------------------------------------------------------------------------------------------------------
def first_per_page(df: DataFrame, score: str = "score") -> DataFrame:
    order = [F.desc(score), F.asc("ordinal"), F.asc("id")]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).where("_r = 1").drop("_r")


def diverse(df: DataFrame, limit: int, score: str = "score", by: str = "book_id", share: float | None = None) -> DataFrame:
    """The best row of each book first, in order of score, then the rest, up to a limit; a rank for the result's order.

    With a share, rows below that share of the best score are left out first.
    """
    order = [F.desc(score), F.asc("page_id"), F.asc("id")]
    per_book = df.withColumn("_b", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_b") <= limit)
    if share is not None:
        # at most `limit` rows of each of the books, of which there are a fixed number, reach this window
        per_book = per_book.withColumn("_best", F.max(score).over(Window.partitionBy(F.lit(0)))).where(F.col(score) >= F.col("_best") * share).drop("_best")
    chosen = per_book.orderBy((F.col("_b") > 1).asc(), *order).limit(limit).drop("_b")
    # limit rows at most reach this window
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def answers(scope: DataFrame, asked: Asked, limit: int = 8) -> DataFrame:
    """Ranked explanations by words alone: not far below the best, one a page, diverse across books."""
    return diverse(first_per_page(explained(scope, asked)), limit, share=LEXICAL_FLOOR)


def penalty(asked: Asked) -> Column:
    """Points off a passage found by meaning, for what lowers the score of one found by words."""
    c = F.col("c")
    points = F.when(F.col("kind") == "note", 2).otherwise(0) + F.when(F.col("quality") == "review", 8).otherwise(0)
    if not asked.catalogue:
        points += F.when(c.rlike(SELF_REFERENCE), 4).otherwise(0)
    if asked.family:
        inside = reduce(lambda x, y: x + y, [occurrences(c, t) for t in asked.family])
        others = [reduce(lambda x, y: x + y, [occurrences(c, t) for t in f]) for f in FAMILIES if f != asked.family]
        points += F.when(F.greatest(*others) > inside * 1.5, 8).otherwise(0)
    if not asked.history:
        points += F.when(F.contains("title", F.lit("국어사")), 4).otherwise(0)
    return points


def hybrid(scope: DataFrame, asked: Asked, dense: DataFrame, limit: int = 8) -> DataFrame:
    """Explanations found by words, with their cosine, and by meaning alone; dense has id, cosine, excerpt, chunk.

    The best lexical rows get 100 times their cosine plus a share of their score. Of the nearest chunks those count that
    reach the floor (a higher one where nothing was found by words), still stand in their passage, show no damage and
    pass the gates; penalties mirror the demotions of the score. They must come near the best, and nearer where words found any.
    """
    from gyeol.functions.text import noise_count

    lexical = explained(scope, asked).orderBy(F.desc("score"), "page_id", "ordinal", "id").limit(LEXICAL_CANDIDATES)
    per_passage = dense.groupBy("id").agg(F.max("cosine").alias("cosine"))
    words = lexical.join(per_passage, "id", "left")
    words = words.select("id", "page_id", "book_id", "ordinal", (100 * F.coalesce("cosine", F.lit(0.0)) + LEXICAL_WEIGHT * F.col("score")).alias("score"), F.lit("lexical").alias("match"))
    near = dense.orderBy(F.desc("cosine"), "id", "chunk").limit(DENSE_CANDIDATES)
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "chunk"))).where("_r = 1").drop("_r")
    rows = scope.join(F.broadcast(best), "id").join(F.broadcast(words.select("id")), "id", "left_anti")  # 60 and 40 rows at most
    rows = rows.where(F.col("cosine") >= DENSE_FLOOR)
    rows = rows.withColumn("c", compact(F.col("chunk"))).where(F.contains("raw", "excerpt") & (noise_count(F.col("chunk")) == 0))
    bullets = count_of(F.col("excerpt"), "[·•]")
    gates = book_admissible(F.col("title"), asked) & no_catalogue(F.col("c"), asked) & ~((bullets >= 8) & (count_of(F.col("excerpt"), "다[.!?。]") < bullets / 2))
    meant = rows.where(gates).select("id", "page_id", "book_id", "ordinal", (100 * F.col("cosine") - penalty(asked)).alias("score"), F.lit("semantic").alias("match"), "cosine")
    # 100 rows at most reach these windows
    every, semantic = Window.partitionBy(F.lit(0)), F.col("match") == "semantic"
    both = words.withColumn("cosine", F.lit(1.0)).unionByName(meant).withColumn("found", F.max(~semantic).over(every))
    both = both.where(F.col("found") | (F.col("cosine") >= DENSE_FLOOR_ALONE)).withColumn("best", F.max("score").over(every))
    both = both.where(F.col("score") >= F.col("best") - F.when(semantic & F.col("found"), CORE_MARGIN).otherwise(WIDE_MARGIN))
    return diverse(first_per_page(both), limit).drop("found", "best", "cosine")


def search(df: DataFrame, groups: Groups, limit: int = 8, text: str = "compact") -> DataFrame:
    """Ranked passages that hold every group, by damped frequencies alone. No groups and empty scopes give no rows."""
    if not groups:
        return df.limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    hits = df.where(contains_all(F.col(text), groups)).withColumn("score", lexical_score(F.col(text), groups, weight_columns(df, text, groups)))
    return diverse(first_per_page(hits), limit)


def fused(lexical: DataFrame, dense: DataFrame, key: str = "id", keep: int = LEXICAL_CANDIDATES, floor: float = DENSE_FLOOR) -> DataFrame:
    """Lexical rows (key, score) and dense rows (key, cosine) as one ranking; a key on both sides stays lexical.

    The best `keep` lexical rows get 100 times their cosine plus a share of their score; a dense row needs the floor.
    """
    best = lexical.orderBy(F.desc("score"), F.asc(key)).limit(keep)
    known = best.join(dense, key, "left").select(key, (100 * F.coalesce("cosine", F.lit(0.0)) + LEXICAL_WEIGHT * F.col("score")).alias("score"), F.lit("lexical").alias("match"))
    new = dense.where(F.col("cosine") >= floor).join(best.select(key), key, "left_anti").select(key, (100 * F.col("cosine")).alias("score"), F.lit("semantic").alias("match"))
    return known.unionByName(new)


def retrieve(scope: DataFrame, question: str, known: Sequence[str] = (), limit: int = 8) -> DataFrame:
    """Answers to a question, or to the first of its shorter forms that has any: each is probed for one row."""
    from gyeol.plans.question import asked, groups, relaxed

    tried = None
    for q in [question, *relaxed(question, known)]:
        tried = answers(scope, asked(q, groups(q, known)), limit)
        if tried.take(1):
            break
    return tried
