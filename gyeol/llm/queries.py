"""Queries of the training-data operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.llm import encoding, frequency, neighbours, packing, quality, scan_noise, sentences, spam, splitting, visual
from gyeol.llm.textio import materialised, sized_join, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _passages_and_chunks(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    passages = table(spark, sf_dir, "passages").select(F.lit("passages").alias("src"), F.col("id").alias("item_id"), F.col(column).alias("text"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("src"), F.col("id").alias("item_id"), F.col("text"))
    return passages.unionByName(chunks)


@query
def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of every passage and chunk, short ones included."""
    items = _passages_and_chunks(spark, sf_dir, "raw").where(F.col("text").isNotNull())
    return splitting.split_items(items, "text", ["src", "item_id"])


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _passages_and_chunks(spark, sf_dir, "raw").where(F.length("text") > splitting.LIMIT)
    pieces = splitting.split_items(items, "text", ["src", "item_id"], only_long=True)
    longest = splitting.longest_runs(pieces, ["src", "item_id"])
    return longest.select("src", "item_id", F.when(F.col("longest_run") > splitting.LIMIT, "forced").otherwise("boundary").alias("cut"))


#: White space and end marks as problem 1 counts them.
_BREAK = r"[\s\x{1c}-\x{1f}\x{85}\x{0b}\p{Z}.!?。！？]"
ORACLE["p1_found"] = rf"""
WITH items AS (SELECT 'passages' AS src, id AS item_id, raw AS text FROM passages UNION SELECT 'chunks', id, text FROM chunks)
SELECT DISTINCT src, item_id,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '{_BREAK}'), lambda x: length(x))) > 640 THEN 'forced' ELSE 'boundary' END AS cut
FROM items WHERE length(text) > 640"""


@query
def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every passage beside the latest scores of its page."""
    passages = table(spark, sf_dir, "passages")
    stats = quality.text_statistics(passages, "id", "raw").withColumnRenamed("id", "passage_id")
    pages = passages.groupBy(F.col("id").alias("passage_id")).agg(F.min("page_id").alias("page_id"))
    scores = table(spark, sf_dir, "page_quality").groupBy("page_id").agg(F.max_by(F.struct("score", "ocr_score"), F.struct("checked_at", "score", "ocr_score")).alias("q"))
    scores = scores.select("page_id", F.col("q.score").alias("score"), F.col("q.ocr_score").alias("ocr_score"))
    return stats.join(pages, "passage_id").join(scores, "page_id", "left")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.text_statistics(table(spark, sf_dir, "passages"), "id", "raw")
    return stats.where(F.col("form").isin("list", "table", "junk")).select(F.col("id").alias("passage_id"), "form")


RARE_BELOW, COMMON_SHARE, VALUE_COMMON = 3, 0.05, 5


def _entry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "passages")
    terms = frequency.term_containers(passages, "id", "display", "display")
    values = passages.where(F.length("compact") > 0).select("id", frequency.value_key("compact").alias("value"))
    return materialised(frequency.entry_statistics(terms.unionByName(frequency.term_containers(values, "id", "value", "compact", lambda t: [t]))))


def _marked(spark: SparkSession, sf_dir: str, only_marked: bool) -> DataFrame:
    stats = _entry_statistics(spark, sf_dir)
    terms = frequency.marked(stats, "display", RARE_BELOW, lambda n: int(n * COMMON_SHARE) + 1)
    values = frequency.marked(stats, "compact", None, lambda n: VALUE_COMMON)
    if only_marked:
        terms, values = terms.where("mark IS NOT NULL"), materialised(values.where("mark IS NOT NULL"))
    # the value itself comes from the first record that has it
    text = table(spark, sf_dir, "passages").where(F.length("compact") > 0).select(F.col("id").alias("first_id"), F.col("compact"))
    if only_marked:
        text = sized_join(text, values.select("first_id").distinct(), ["first_id"], "left_semi", values.count())
    text = text.groupBy("first_id").agg(F.min("compact").alias("compact"))
    values = values.join(text, "first_id").select("field", F.col("compact").alias("entry"), "occurrences", "records", "mark")
    return terms.select("field", "entry", "occurrences", "records", "mark").unionByName(values)


@query
def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of display and every whole compact value, with its occurrences and passages."""
    return _marked(spark, sf_dir, False)


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir, True).select("field", "entry", "mark")


ORACLE["p3_statistics"] = r"""
WITH p AS (SELECT DISTINCT id, display, compact FROM passages),
n AS (SELECT count(DISTINCT id) AS n FROM p WHERE display IS NOT NULL),
t AS (SELECT id, unnest(regexp_extract_all(display, '[가-힣]{2,}')) AS entry FROM p),
d AS (SELECT entry, count(*) AS occurrences, count(DISTINCT id) AS records FROM t GROUP BY entry),
v AS (SELECT compact AS entry, count(DISTINCT id) AS records FROM p WHERE length(compact) > 0 GROUP BY compact)
SELECT 'display' AS field, entry, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * n THEN 'common' END AS mark FROM d, n
UNION ALL SELECT 'compact', entry, records, records, CASE WHEN records >= 5 THEN 'common' END FROM v"""
ORACLE["p3_found"] = f"SELECT field, entry, mark FROM ({ORACLE['p3_statistics']}) WHERE mark IS NOT NULL"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, id, stored, form (digests of 16 bytes) of every passage and page with something to see, one row for each id."""
    passages = table(spark, sf_dir, "passages").select(F.lit("passages").alias("src"), "id", F.col("raw").alias("text"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), "id", "text")
    items = passages.unionByName(pages).where("text IS NOT NULL").withColumn("stored", F.unhex(F.md5("text")))
    forms = visual.consistent_form(items, "text", ["src", "id", "stored"]).where("form <> ''")
    return materialised(forms.select("src", "id", "stored", F.unhex(F.md5("form")).alias("form")).distinct())


@query
def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every passage."""
    return visual.consistent_form(table(spark, sf_dir, "passages"), "raw", ["id"])


@query
def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every passage and page with something to see: the smallest id of those that look like it, how many
    stored forms the class has, and its links: ids of the class that are stored in other characters."""
    forms = _forms(spark, sf_dir)
    stored = forms.groupBy("src", "form", "stored").agg(F.count_distinct("id").alias("same"), F.min("id").alias("least"))
    classes = stored.groupBy("src", "form").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("variants"), F.sum("same").alias("members"))
    rows = forms.join(stored.drop("least"), ["src", "form", "stored"]).join(classes, ["src", "form"])
    return rows.select("src", "id", "class_id", "variants", (F.col("members") - F.col("same")).alias("links"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids whose texts share a form but not the stored characters.

    Only forms with two or more stored variants enter the join, and it joins variants, whose ids follow at the end.
    """
    forms = _forms(spark, sf_dir)
    several = forms.groupBy("src", "form").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("src", "form")
    members = materialised(forms.join(several, ["src", "form"]))
    variants = members.select("src", "form", "stored").distinct()
    other = variants.select("src", "form", F.col("stored").alias("stored_b"))
    pairs = variants.join(other, ["src", "form"]).where("stored < stored_b").drop("form")
    a = members.select("src", "stored", F.col("id").alias("a"))
    b = members.select("src", F.col("stored").alias("stored_b"), F.col("id").alias("b"))
    both = pairs.join(a, ["src", "stored"]).join(b, ["src", "stored_b"]).where("a <> b")
    return both.select("src", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query
def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(_passages_and_chunks(spark, sf_dir, "display"), "text", ["src", "item_id"])


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_sentences(spark, sf_dir).select("src", "item_id", "end_pos").distinct()


@query
def p10_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.coherence(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.stuffed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar digests of each digest, however similar."""
    return neighbours.neighbours(table(spark, sf_dir, "vectors"), "digest", "vector", at_least=-2.0)


@query
def p6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar embeddings of each, however similar."""
    near = neighbours.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", at_least=-2.0, width=64)
    return near.withColumnsRenamed({"digest": "vec_id", "neighbour": "near_id"})


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.neighbours(table(spark, sf_dir, "vectors"), "digest", "vector")
    return near.select(F.least("digest", "neighbour").alias("digest_a"), F.greatest("digest", "neighbour").alias("digest_b")).distinct()


@query
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumnRenamed("item", "doc_id")


@query
def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    bins = p9_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    capacity = F.lit(packing.CAPACITY)
    return bins.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("share_used"))


def _scanned_texts(spark: SparkSession, sf_dir: str, display: bool = False) -> DataFrame:
    books = table(spark, sf_dir, "books").groupBy(F.col("id").alias("book_id")).agg(F.min("title").alias("title"))
    pages = table(spark, sf_dir, "pages").select("book_id", F.lit("pages").alias("src"), F.col("id").alias("item_id"), "text", F.lit(True).alias("page"))
    pages = sized_join(pages, books, ["book_id"], "left").select("src", "item_id", "text", "title", "page")
    passages = table(spark, sf_dir, "passages")
    none = F.lit(None).cast("string").alias("title")
    raw = passages.select(F.lit("passages").alias("src"), F.col("id").alias("item_id"), F.col("raw").alias("text"), none, F.lit(False).alias("page"))
    texts = pages.unionByName(raw)
    if display:
        texts = texts.unionByName(passages.select(F.lit("display").alias("src"), F.col("id").alias("item_id"), F.col("display").alias("text"), none, F.lit(False).alias("page")))
    return texts


@query
def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired paragraphs of every page and of raw and display of every passage."""
    return scan_noise.repaired_texts(_scanned_texts(spark, sf_dir, display=True), ["src", "item_id"], "text", "title", "page")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.noise(_scanned_texts(spark, sf_dir), ["src", "item_id"], "text", "title", "page")[0]
