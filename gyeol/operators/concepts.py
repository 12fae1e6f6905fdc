"""Written concepts, their items and pages, and the packet of evidence that a model reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.functions.text import compact, contains_all
from gyeol.plans.question import Asked

#: An entry of either generation: items are strings or objects, so they are read as text and parsed one by one.
ENTRY = "id string, label string, parent string, summary string, sections array<struct<heading:string,intro:string,items:array<string>>>, sources array<struct<id:bigint,book:string,pdf_page:int>>"
ITEM = "label string, text string, examples array<string>, refs array<int>, sub array<struct<label:string,text:string,examples:array<string>,refs:array<int>>>"


def _nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _sub_text(s: Column) -> Column:
    """"label: text" of a sub-item with its examples, or whichever of both it has."""
    text = F.concat_ws(" ", F.array_compact(F.array(s["text"], F.when(F.size(s["examples"]) > 0, F.concat(F.lit("예: "), F.array_join(s["examples"], " / "))))))
    return F.when((F.coalesce(s["label"], F.lit("")) != "") & (text != ""), F.concat_ws(": ", s["label"], text)).when(text == "", F.coalesce(s["label"], F.lit(""))).otherwise(text)


def concept_items(entries: DataFrame, json: str) -> DataFrame:
    """id, entry, section, item, heading, label, text, pages: every top-level item of an entry, with its sub-items and examples
    folded into its text and its references resolved to the pages of the entry's sources, each once.

    Entries that can't be read give no row; references to sources that don't exist are left out.
    """
    e = entries.select(F.from_json(json, ENTRY).alias("e")).select("e.*").where("id IS NOT NULL")
    s = e.select("id", F.col("label").alias("entry"), "sources", F.posexplode("sections").alias("section", "s"))
    i = s.select("id", "entry", "sources", "section", F.col("s.heading").alias("heading"), F.posexplode("s.items").alias("item", "x"))
    is_object = F.col("x").startswith("{")
    o = F.from_json("x", ITEM)
    i = i.withColumn("o", F.when(is_object, o))
    subs = F.coalesce(F.transform("o.sub", _sub_text), _nothing("string"))
    examples = F.when(F.size("o.examples") > 0, F.concat(F.lit("예: "), F.array_join("o.examples", " / ")))
    parts = F.concat(F.array(F.coalesce("o.text", F.lit(""))), subs, F.array(F.coalesce(examples, F.lit(""))))
    text = F.when(is_object, F.array_join(F.filter(parts, lambda p: p != ""), " ")).otherwise(F.col("x"))
    refs = F.array_distinct(F.concat(F.coalesce("o.refs", _nothing("int")), F.flatten(F.coalesce(F.transform("o.sub", lambda b: F.coalesce(b["refs"], _nothing("int"))), _nothing("array<int>")))))
    pages = F.filter(F.transform(refs, lambda r: F.when(r >= 0, F.get("sources", r)["id"])), lambda p: p.isNotNull())
    return i.select("id", "entry", "section", "item", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("o.label", F.lit("")).alias("label"), text.alias("text"), pages.alias("pages"))


# --- what a question asks of concepts ------------------------------------------------------------------------------
#: How a question names poems and novels.
POEM = r"(?:^|[^가-힣])(?:현대|서정)?시(?:인|어|적|집|조|가)?(?:은|는|이|가|을|를|의|에|와|과|도|에서|으로)?(?:$|[^가-힣])"
GENRES = {"시": "poem", "고전시가": "poem", "소설": "novel", "고전소설": "novel"}


def asked_genre(question: Column) -> Column:
    """poem or novel where a text names exactly one of them; else null."""
    poem, novel = question.rlike(POEM), question.contains("소설")
    return F.when(poem & ~novel, "poem").when(novel & ~poem, "novel")


def topic_hits(text: Column, groups: Asked | list) -> Column:
    """How many of the groups an item's text has."""
    return reduce(lambda a, b: a + b, [contains_all(text, [g]).cast("int") for g in groups], F.lit(0))


def concept_pages(items: DataFrame, matched: DataFrame, asked: Asked, limit: int = 12) -> DataFrame:
    """page, place: pages on which matched concepts rest, the items with most of the question's words first.

    matched: id, rank, match; an entry that the question names counts with every item, others with items that hit.
    """
    hits = topic_hits(compact(F.concat("heading", "label", "text")), list(asked.groups))
    rows = items.join(matched, "id").withColumn("hits", hits).where((F.col("hits") > 0) | (F.col("match") == "exact"))
    pages = rows.select(F.posexplode("pages").alias("nth", "page"), "hits", "rank", "section", "item")
    first = pages.groupBy("page").agg(F.min(F.struct(-F.col("hits"), "rank", "section", "item", "nth")).alias("o"))
    chosen = first.orderBy("o", "page").limit(limit)
    return chosen.select("page", F.row_number().over(Window.orderBy("o", "page")).alias("place"))  # `limit` rows


def example_pages(pages: DataFrame, examples: DataFrame) -> DataFrame:
    """id, spelling, said: pages that print a word with its pronunciation beside it. pages: id, compact; examples: spelling,
    said, as many as a question gives (broadcast)."""
    e = F.broadcast(examples.select(compact(F.col("spelling")).alias("a"), compact(F.col("said")).alias("b"), "spelling", "said").where("a <> b"))
    near = F.concat(F.lit(r"\Q"), "a", F.lit(r"\E[가-힣]{0,2}[^\p{L}\p{N}_]{1,4}\Q"), "b", F.lit(r"\E"))
    return pages.join(e, F.contains("compact", "a") & F.contains("compact", "b")).where(F.regexp_like("compact", near)).select("id", "spelling", "said").distinct()


def related_pages(pages: DataFrame, text: str, terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, weight: pages by the terms that stand in them: their number times the length to the power 1.5, less on pages to review.

    terms: term, a list of fixed size (broadcast).
    """
    t = F.broadcast(terms.select("term").distinct().where(F.length("term") > 0))
    n = (F.length(text) - F.length(F.replace(text, F.col("term"), F.lit("")))) / F.length("term")
    rows = pages.join(t, F.contains(text, F.col("term"))).select(*keys, (n * F.pow(F.length("term").cast("double"), F.lit(1.5)) * F.when(F.col("quality") == "review", 0.6).otherwise(1.0)).alias("w"))
    return rows.groupBy(*keys).agg(F.sum("w").alias("weight"))


def rechecked(candidates: DataFrame, pages: DataFrame, on: str, terms: str = "terms", text: str = "compact") -> DataFrame:
    """Candidate pages on which at least two, and at least half, of their terms stand."""
    found = F.size(F.filter(terms, lambda t: F.contains(F.col(text), t)))
    return candidates.join(pages, on).withColumn("found", found).where(F.col("found") >= F.greatest(F.lit(2.0), F.size(terms) / 2))


# --- evidence ------------------------------------------------------------------------------------------------------
#: Kinds that are no evidence, and the size of a quote.
NO_EVIDENCE = ("margin", "index", "catalog", "exercise")
QUOTE = (20, 500)


def paragraphs(passages: DataFrame, sentences: Column) -> DataFrame:
    """page_id, id, ordinal, kind, text, quotes: passages that may be cited, with the sentences that may be quoted.

    Passages of other kinds or with fewer than three letters give no row; a passage without a fitting sentence has no quote.
    """
    rows = passages.where(~F.coalesce("kind", F.lit("")).isin(*NO_EVIDENCE) & (F.regexp_count("display", F.lit("[가-힣A-Za-z]")) >= 3))
    fits = F.filter(sentences, lambda s: F.length(s).between(*QUOTE))
    return rows.select("page_id", "id", "ordinal", "kind", F.col("display").alias("text"), fits.alias("quotes"))


def packet(paragraph_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, packet, and the registry evidence_id -> quotes as a map: what a model reads of a page, as JSON.

    labels: page_id, book, page. Paragraphs are numbered in the order of the page.
    """
    w = Window.partitionBy("page_id").orderBy("ordinal", "id")
    numbered = paragraph_rows.withColumn("n", F.row_number().over(w)).withColumn("evidence_id", F.concat(F.lit("S"), F.col("page_id"), F.lit("P"), F.col("n")))
    item = F.struct(F.col("evidence_id").alias("id"), "text", "kind")
    rows = numbered.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("n", item.alias("i")))).alias("items"), F.map_from_entries(F.collect_list(F.struct("evidence_id", "quotes"))).alias("registry")
    )
    rows = rows.join(labels, "page_id")
    return rows.select("page_id", F.to_json(F.struct("book", "page", F.transform("items", lambda x: x["i"]).alias("paragraphs"))).alias("packet"), "registry")


def page_label(printed: Column, status: Column, pdf: Column) -> Column:
    """How a page is named: its printed number where that is confirmed, else its place in the file."""
    confirmed = status.isin("sequence", "manual", "offset") & (F.coalesce(printed, F.lit(0)) > 0)
    return F.when(confirmed, F.format_string("%d쪽", printed.cast("int"))).when(pdf.isNotNull(), F.format_string("PDF %d쪽", pdf.cast("int")))


def preferred_paragraphs(candidates: DataFrame, by: str, most: int = 4) -> DataFrame:
    """The best paragraphs of each term: the best of each book first, then the others; by score, openings, length.

    candidates: by, book, score, opens, text.
    """
    order = [F.desc("score"), F.desc("opens"), F.desc(F.length("text")), F.asc("text")]
    nth = F.row_number().over(Window.partitionBy(by, "book").orderBy(*order))
    rows = candidates.withColumn("_n", nth)
    place = F.row_number().over(Window.partitionBy(by).orderBy((F.col("_n") > 1).asc(), *order))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("_n")


def checked_notes(notes: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, status, quotes, examples: of a written note only what stands in its evidence.

    notes: key, definition, quotes (array), examples (array); evidence: key, text. A note without a definition is
    insufficient, one none of whose quotes is found unsupported; without evidence it failed.
    """
    texts = evidence.groupBy(key).agg(F.collect_set(compact(F.col("text"))).alias("_e"))
    n = notes.join(texts, key, "left")
    held = lambda of: F.filter(F.coalesce(of, _nothing("string")), lambda q: (q != "") & F.exists("_e", lambda e: F.contains(e, compact(q))))
    quotes, examples = held(F.col("quotes")), held(F.col("examples"))
    status = F.when(F.col("_e").isNull(), "failed").when(F.coalesce(F.trim("definition"), F.lit("")) == "", "insufficient").when(F.size(quotes) == 0, "unsupported").otherwise("ok")
    return n.select(key, status.alias("status"), F.coalesce(quotes, _nothing("string")).alias("quotes"), F.coalesce(examples, _nothing("string")).alias("examples"))


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of several lists, one after the other; a key keeps its first place."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(key).orderBy("_part", order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pruned(claims: DataFrame) -> DataFrame:
    """Validated claims that may be shown: valid ones, with their invalid neighbours gone; id, section, points left and dropped."""
    return claims.groupBy("id", "section").agg(F.count_if("valid").alias("kept"), F.count_if(~F.col("valid")).alias("dropped"))


def longest_first(words: Column) -> Column:
    """Words by length, the longest first, equal ones in order."""
    return F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])




# --- names ---------------------------------------------------------------------------------------------------------
def matched(grams: DataFrame, names: DataFrame) -> DataFrame:
    """question, concept, match, term: concepts that a question names (exact), and those whose name is a part of a longer word
    of it and stands in their text (related). An exact name inside the longest exact one of its question is related.

    grams: question, gram; names: concept, name, body, all compact. Every part of a gram is a key of the join.
    """
    exact = grams.join(names, grams.gram == names.name).select("question", "concept", F.lit("exact").alias("match"), F.col("name").alias("term"))
    parts = F.expr("array_distinct(flatten(transform(sequence(1, length(gram)), i -> transform(sequence(1, length(gram) - i + 1), n -> substring(gram, i, n)))))")
    inside = grams.select("question", "gram", F.explode(parts).alias("name")).where("name <> gram")
    related = inside.join(names, "name").where(F.contains("body", "name")).select("question", "concept", F.lit("related").alias("match"), F.col("name").alias("term")).distinct()
    longest = exact.groupBy("question").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("top"))
    both = exact.unionByName(related).withColumn("o", F.when(F.col("match") == "exact", 0).otherwise(1))
    w = Window.partitionBy("question", "concept").orderBy("o", F.desc(F.length("term")), "term")
    one = both.withColumn("r", F.row_number().over(w)).where("r = 1").join(longest, "question", "left")
    demoted = (F.col("match") == "exact") & (F.col("top") != F.col("term")) & F.contains("top", "term")
    return one.select("question", "concept", F.when(demoted, "related").otherwise(F.col("match")).alias("match"), "term")


def entry_prose(entries: DataFrame, json: str) -> DataFrame:
    """id, prose: headings and items of an entry as running text, each heading before its first item."""
    items = concept_items(entries, json)
    piece = F.concat_ws(" ", F.when(F.col("item") == 0, F.nullif("heading", F.lit(""))), F.nullif("label", F.lit("")), F.nullif("text", F.lit("")))
    rows = items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("section", "item", piece.alias("p")))).alias("ps"))
    return rows.select("id", F.array_join(F.filter(F.transform("ps", lambda x: x["p"]), lambda p: p != ""), " ").alias("prose"))
