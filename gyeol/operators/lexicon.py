"""Vocabularies and dictionaries derived from the corpus: counts, splits, fuzzy pairs, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[가-힣]{2,}"
#: Names in an alias dictionary beyond which it is shuffled instead of broadcast.
MOST_ALIASES = 10_000


def words(df: DataFrame, text: str, *keys: str, pattern: str = WORD) -> DataFrame:
    return df.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("word"))


def vocabulary(df: DataFrame, text: str, least: int = 3) -> DataFrame:
    """Words of two or more syllables seen often enough, with their counts: counted on the map side first."""
    return words(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def strange_ratio(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """Share of the words of each row that the vocabulary doesn't have; 0 without words."""
    marked = words(df, text, key).join(known.select("word", F.lit(1).alias("k")), "word", "left")
    share = marked.groupBy(key).agg(F.avg(F.when(F.col("k").isNull(), 1.0).otherwise(0.0)).alias("strange"))
    return df.select(key).distinct().join(share, key, "left").select(key, F.coalesce("strange", F.lit(0.0)).alias("strange"))


def printed_words(df: DataFrame, text: str, least: int = 3) -> DataFrame:
    """word, joined, split: how often a word stands whole inside a line, and how often as two neighbours in one.

    The first and last token of a line don't count: a break may have cut them.
    """
    lines = df.select(F.explode(F.split(text, "\n")).alias("line"))
    tokens = lines.select(F.split(F.trim("line"), r"\s+").alias("t")).where(F.size("t") > 2)
    inner = tokens.select(F.expr("slice(t, 2, size(t) - 2)").alias("t"))
    whole = inner.select(F.explode("t").alias("word")).where(F.col("word").rlike("^[가-힣]{2,}$")).groupBy("word").agg(F.count(F.lit(1)).alias("joined"))
    pairs = inner.where(F.size("t") > 1).select(F.explode(F.expr("transform(sequence(1, size(t) - 1), i -> concat(t[i - 1], t[i]))")).alias("word"))
    split = pairs.where(F.col("word").rlike("^[가-힣]{2,}$")).groupBy("word").agg(F.count(F.lit(1)).alias("split"))
    counts = whole.where(F.col("joined") >= least).join(split, "word", "left").withColumn("split", F.coalesce("split", F.lit(0)))
    share = F.col("split") / (F.col("joined") + F.col("split"))
    return counts.withColumn("state", F.when(share <= 0.03, "solid").when(share > 0.5, "often_split").otherwise("mixed"))


def symbol_census(df: DataFrame, group: str, key: str, text: str, pattern: str, samples: int = 4) -> DataFrame:
    """symbol, n, groups, sample keys: counts of single characters, with the keys of the first rows that have them."""
    found = df.select(group, key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("symbol"))
    per_row = found.groupBy("symbol", group, key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("symbol").orderBy(key)
    first = per_row.select("symbol", key).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    listed = first.groupBy("symbol").agg(F.array_sort(F.collect_list(key)).alias("samples"))
    return per_row.groupBy("symbol").agg(F.sum("n").alias("n"), F.count_distinct(group).alias("groups")).join(listed, "symbol")


def masked(column: str) -> Column:
    """A word with each character but the last masked in turn: words one apart share one of them."""
    return F.expr(f"transform(sequence(1, length({column}) - 1), i -> concat(substring({column}, 1, i - 1), '_', substring({column}, i + 1)))")


def one_apart(df: DataFrame, word: str) -> DataFrame:
    """a < b: words of one length that differ in one character, not the last: an equi join on the masked words."""
    m = df.select(F.col(word).alias("w")).distinct().where(F.length("w") >= 2).select("w", F.explode(masked("w")).alias("m"))
    return m.select(F.col("w").alias("a"), "m").join(m.select(F.col("w").alias("b"), "m"), "m").where("a < b").select("a", "b").distinct()


def superstrings(df: DataFrame, word: str) -> DataFrame:
    """short, long: words inside longer ones. Every substring of a word is a key, so that the join is an equi join."""
    w = df.select(F.col(word).alias("long")).distinct()
    parts = F.expr("flatten(transform(sequence(1, length(long)), i -> transform(sequence(1, length(long) - i + 1), n -> substring(long, i, n))))")
    inside = w.select("long", F.explode(F.array_distinct(parts)).alias("short")).where("short <> long")
    return inside.join(w.select(F.col("long").alias("short")), "short").select("short", "long")


def accepted(ratio: Column, gain: Column, allowed: Column) -> Column:
    """Whether a correction is safe: a clear gain at a clear ratio, a smaller one at a large ratio, unless it is a word."""
    return (((ratio >= 4) & (gain >= 6)) | ((ratio >= 15) & (gain >= 4))) & ~allowed


def by_correct(corrections: DataFrame) -> DataFrame:
    """The damaged spellings of each correct term."""
    return corrections.groupBy("right").agg(F.array_sort(F.collect_set("wrong")).alias("spellings"))


def expand(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """token, name: every name of a token's alias group, or the token itself; of several groups the first counts.

    aliases: grp, name; a dictionary of fixed size.
    """
    # broadcast only while it is as small as such a dictionary is
    a = F.broadcast(aliases) if len(aliases.take(MOST_ALIASES + 1)) <= MOST_ALIASES else aliases
    grp = tokens.join(a.withColumnRenamed("name", "token"), "token", "left").groupBy("token").agg(F.min("grp").alias("grp"))
    return grp.join(a, "grp", "left").select("token", F.coalesce("name", "token").alias("name"))


def running_heads(df: DataFrame, by: str, line: str, least: int = 8) -> DataFrame:
    """Lines that one book repeats so often that they are no headings: left out for all books."""
    often = df.groupBy(by, line).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(line).distinct()
    return df.join(often, line, "left_anti")


def spacing(df: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """word, joined, spaced: how often a compound of the list stands as one word and as two neighbours.

    keys: left_part, right_part. A compound is accepted as one word if it is hardly ever spaced.
    """
    tokens = df.select(F.split(F.trim(text), r"\s+").alias("t")).where(F.size("t") > 0)
    compounds = keys.select(F.concat("left_part", "right_part").alias("word"), "left_part", "right_part").distinct()
    single = tokens.select(F.explode("t").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("joined"))
    pairs = tokens.where(F.size("t") > 1).select(F.explode(F.expr("transform(sequence(1, size(t) - 1), i -> struct(t[i - 1] AS left_part, t[i] AS right_part))")).alias("p")).select("p.*")
    spaced = pairs.groupBy("left_part", "right_part").agg(F.count(F.lit(1)).alias("spaced"))
    out = compounds.join(single, "word", "left").join(spaced, ["left_part", "right_part"], "left")
    out = out.groupBy("word").agg(F.max(F.coalesce("joined", F.lit(0))).alias("joined"), F.sum(F.coalesce("spaced", F.lit(0))).alias("spaced"))
    j, s, n = F.col("joined"), F.col("spaced"), F.length("word")
    accepted_ = ((j >= 3) & ((s <= 0.03 * (j + s)) | ((n >= 3) & (s <= 1) & (j >= 8)))) | ((n >= 4) & (j >= 1) & (s == 0))
    return out.withColumn("accepted", accepted_)
