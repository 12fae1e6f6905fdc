"""The term dictionary: sentences of pages, what they define, misread terms, headings as topics, the catalogue and its cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.functions.hangul import sort_key
from gyeol.functions.text import noise_count, split_sentences, term_key
from gyeol.operators.lexicon import masked
from gyeol.operators.terms import THRESHOLD, definition_score

#: Bits of the areas and of what the catalogue knows about a term.
AREAS = {"문식성": 1, "문법": 2, "문학": 4}
DEFINED, CONCEPT, NOTE = 1, 2, 4

# --- sentences -----------------------------------------------------------------------------------------------------
#: Example lines, sentences that lost their beginning, sentences that point back, that lead elsewhere, that go on.
EXAMPLE = r"^\(?\s*[\d\s]{1,6}[′]?\s*\)?\s*[가-하]\s*\.|^[가-하]\s*\.\s"
FRAGMENT = r"^(?:의|을|를|은|는|에|에서|으로|로|와|과|도|만|하여|하고|하며|되어|되며|이며|이고|으며|며|고|서|는데|지만|다|요)\s"
POINTS_BACK = r"^(?:이를|이것을|이러한|이런|이와\s*같은|이처럼|이\s*같은|그것을|그러한)\s"
ASIDE = r"다음과\s*같|아래와\s*같|다음\s*예|다음\s*[몇두세네]|살펴보|알아보|보기로\s*하|논의하기로|다루기로|참조|참고|[:：]$|^\(\s*\d"
GOES_ON = r"^(?:이|이는|이것은|이것이|이들은|이러한|이런|이와|이때|이때의|이곳의|여기서|여기에서|즉|곧|다시\s*말해|따라서|그러므로|그래서|또한|또|특히|다만|예를\s*들어|가령|그런데|그러나|하지만|그리고|결국|요컨대|이처럼|이렇게|이렇듯)[\s,，]"
SHORTEST, LONGEST, BACK_MOST, WHOLE_MOST = 10, 400, 320, 420


def page_sentences(passages: DataFrame) -> DataFrame:
    """page_id, id, kind, at, text, skip, previous: sentences of running text and notes in order.

    Example lines, cut, damaged, very short and very long sentences are kept with skip, so that what follows a
    sentence is known to be next to it; `previous` is the sentence before in the same passage, null after a skipped one.
    """
    rows = passages.where("display IS NOT NULL").select("page_id", "id", "kind", "display").distinct()
    s = rows.select("page_id", "id", "kind", F.posexplode(split_sentences(F.col("display"))).alias("at", "text"))
    ended = F.col("text").rlike(r"[다요까][.!?。][”’']?$") | F.col("text").rlike("[가-힣]다$")
    size = F.length(F.regexp_replace("text", r"\s", ""))
    skip = ~ended | F.col("text").rlike(FRAGMENT) | F.col("text").rlike(EXAMPLE) | (size < SHORTEST) | (F.length("text") > LONGEST) | (noise_count(F.col("text")) > 0)
    s = s.withColumn("skip", skip)
    w = Window.partitionBy("id").orderBy("at")
    previous = F.lag(F.when(~F.col("skip"), F.col("text"))).over(w)
    return s.withColumn("previous", F.when(~F.col("skip"), previous))


def with_context(sentences: DataFrame, chosen: DataFrame, key: str = "key") -> DataFrame:
    """chosen (id, at, key, ...) with quote and more: the sentence, with the one it points back to, and up to two that follow
    it in its passage and stay on the term, while the whole stays short enough."""
    w = Window.partitionBy("id").orderBy("at")
    follows = sentences.select("id", "at", "text", "previous", *(F.lead(F.when(~F.col("skip"), F.col("text")), i).over(w).alias(f"next{i}") for i in (1, 2)))
    s = chosen.join(follows, ["id", "at"])
    back = F.col("text").rlike(POINTS_BACK) & (F.length("previous") + F.length("text") < BACK_MOST)
    s = s.withColumn("quote", F.when(F.coalesce(back, F.lit(False)), F.concat_ws(" ", "previous", "text")).otherwise(F.col("text")))

    def stays(c: Column) -> Column:
        return F.coalesce(~c.rlike(ASIDE) & ~c.rlike(FRAGMENT) & ~c.rlike(r"\(\s*\d{1,3}\s*[가-하]?(?:\s*[~,，-]\s*[가-하])?\s*['′]?\)") & (F.contains(term_key(c), F.col(key)) | c.rlike(GOES_ON)), F.lit(False))

    one, two = F.col("next1"), F.col("next2")
    fits1 = stays(one) & (F.length("quote") + F.length(one) <= WHOLE_MOST)
    fits2 = fits1 & stays(two) & (F.length("quote") + F.length(one) + F.length(two) <= WHOLE_MOST)
    more = F.concat_ws(" ", F.when(fits1, one), F.when(fits2, two))
    return s.withColumn("more", more).drop("text", "previous", "next1", "next2")


# --- definitions ---------------------------------------------------------------------------------------------------
_IGNORED = r"[\s\p{Z}‘’“”'\"「」『』〈〉<>《》·\-]"
_NAMING = r"(?:\([^)]{0,40}\))?(?:이란|란(?!무엇|어떤)|이라고|라고|이라|라(?=도|는|를|하|한|부|불|일|칭|명|정|이|말)|으로도?(?=불리|불린|부르|부른|일컫|칭하|칭한|명명)|로도?(?=불리|불린|부르|부른|일컫|칭하|칭한|명명))"
_SUBJECT = r"^(?:\([^)]{0,40}\))?(?:은|는|이란|란|이라는것은|라는것은|이라함은|라함은|의개념은|의정의는)"
LONGEST_TERM, OPENING_PLACES = 14, 13


def defined_keys(sentences: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """by, key: terms that a sentence may define, the longest before each naming marker and at each of its first places.

    keys: key. What stands before a marker and every short opening are exploded into their ends and beginnings of up
    to 14 characters, so that the join with the terms is an equi join.
    """
    c = F.lower(F.regexp_replace("text", _IGNORED, ""))
    rows = sentences.select(*by, c.alias("_c"))
    sizes = F.sequence(F.lit(2), F.lit(LONGEST_TERM))
    pieces = F.split("_c", _NAMING)
    before = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    # of a piece the end, with its length: (place, candidate)
    named = F.flatten(F.transform(before, lambda p, i: F.transform(F.filter(sizes, lambda n: n <= F.length(p)), lambda n: F.struct(F.concat(F.lit("n"), i.cast("string")).alias("place"), F.substr(p, F.length(p) - n + 1, n).alias("key")))))
    places = F.filter(F.sequence(F.lit(1), F.lit(OPENING_PLACES)), lambda i: i < F.length("_c"))
    opening = F.flatten(
        F.transform(places, lambda i: F.transform(F.filter(sizes, lambda n: F.substr("_c", i + n, F.lit(60)).rlike(_SUBJECT)), lambda n: F.struct(F.concat(F.lit("o"), i.cast("string")).alias("place"), F.substr(F.col("_c"), i, n).alias("key"))))
    )
    found = rows.select(*by, F.explode(F.concat(named, opening)).alias("x")).select(*by, "x.place", "x.key").join(keys.select("key").distinct(), "key")
    longest = Window.partitionBy(*by, "place").orderBy(F.desc(F.length("key")), "key")
    return found.withColumn("_r", F.row_number().over(longest)).where("_r = 1").select(*by, "key").distinct()


def longer_terms(keys: DataFrame) -> DataFrame:
    """key, longer: terms that contain another, as a list for it; every part of a term is a key of the join."""
    k = keys.select("key").distinct().where(F.length("key") <= LONGEST_TERM)
    parts = F.expr("array_distinct(flatten(transform(sequence(2, length(key)), n -> transform(sequence(1, length(key) - n + 1), i -> substring(key, i, n)))))")
    inside = k.where(F.length("key") > 2).select(F.col("key").alias("long"), F.explode(parts).alias("key")).where("long <> key")
    return inside.join(k, "key").groupBy("key").agg(F.array_sort(F.collect_set("long")).alias("longer"))


def scored_definitions(sentences: DataFrame, keys: DataFrame) -> DataFrame:
    """page_id, id, at, key, score: clean sentences by how plainly they define a term; a note counts three less."""
    clean = sentences.where("NOT skip").select("page_id", "id", "kind", "at", "text")
    found = clean.join(defined_keys(clean, keys, "id", "at"), ["id", "at"]).join(longer_terms(keys), "key", "left")
    scored = found.withColumn("score", definition_score("text", "key", F.coalesce("longer", F.array().cast("array<string>"))))
    return scored.select("page_id", "id", "at", "key", (F.col("score") - F.when(F.col("kind") == "note", 3).otherwise(0)).alias("score"))


def page_definitions(scored: DataFrame) -> DataFrame:
    """The best sentence of each page and term that defines it, the first among equals."""
    w = Window.partitionBy("page_id", "key").orderBy(F.desc("score"), "id", "at")
    return scored.where(F.col("score") >= THRESHOLD).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def away_definitions(scored: DataFrame, pages: DataFrame, indexed: DataFrame, least: int = 9) -> DataFrame:
    """book_id, key, pdf_page, page_id, id, at, score: the plainest definition in a book of terms of three or more letters,
    where the pages that its index names (indexed: book_id, key, pdf_page, score) neither define the term nor lie next to it."""
    rows = scored.where((F.col("score") >= least) & (F.length("key") >= 3)).join(pages.select(F.col("id").alias("page_id"), "book_id", "pdf_page").distinct(), "page_id")
    w = Window.partitionBy("book_id", "key").orderBy(F.desc("score"), "pdf_page", "id", "at")
    best = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    known = indexed.select("book_id", "key", F.col("pdf_page").alias("_p"), F.col("score").alias("_s"))
    covered = best.join(known, ["book_id", "key"]).where((F.col("_s") >= THRESHOLD) | (F.abs(F.col("pdf_page") - F.col("_p")) <= 1)).select("book_id", "key").distinct()
    return best.join(covered, ["book_id", "key"], "left_anti")


# --- misread terms -------------------------------------------------------------------------------------------------
#: Pairs of letters that scans confuse, as numbers in a syllable's code: initial, medial, final.
CONFUSED = (((11, 6), (16, 3), (5, 16), (0, 3)), ((20, 0), (20, 4), (0, 4), (6, 4), (13, 18), (2, 4), (11, 9), (14, 9), (5, 1), (20, 6), (8, 13), (18, 8)), ((16, 17),))
OFTEN, TIMES = 10, 20


def _code(word: str, at: str) -> list[Column]:
    n = F.expr(f"ascii(substring({word}, {at}, 1)) - 44032")
    return [F.floor(n / 588).cast("int"), F.floor(n % 588 / 28).cast("int"), (n % 28).cast("int")]


def confusable(a: str, b: str, at: str) -> Column:
    """Whether the syllables of two words at a place differ in one letter that scans confuse."""
    x, y = _code(a, at), _code(b, at)
    same = [p == q for p, q in zip(x, y, strict=True)]
    out = F.lit(False)
    for i, pairs in enumerate(CONFUSED):
        others = reduce(lambda p, q: p & q, [same[j] for j in range(3) if j != i])
        out |= others & ~same[i] & F.struct(F.least(x[i], y[i]), F.greatest(x[i], y[i])).isin(*(F.struct(F.lit(min(p)), F.lit(max(p))) for p in pairs))
    return out


def misread_terms(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """word, key: words one confusable letter from a term of three to eight syllables, the last syllable apart.

    counts: word, n; keys: key, curated. A term of an index must itself be frequent and so many times as frequent as the
    word; a term that a person wrote vouches for itself where the word is seen twice. A word with several terms takes
    the most frequent, then the first.
    """
    hangul = "^[가-힣]{3,8}$"
    c = counts.where(F.col("word").rlike(hangul)).select("word", "n")
    k = keys.where(F.col("key").rlike(hangul)).groupBy("key").agg(F.bool_or("curated").alias("curated"))
    k = k.join(c.select(F.col("word").alias("key"), F.col("n").alias("exact")), "key", "left").withColumn("exact", F.coalesce("exact", F.lit(0)))
    masks = c.withColumn("m", F.explode(masked("word"))).join(k.withColumn("m", F.explode(masked("key"))), "m").where("word <> key")
    near = masks.withColumn("at", F.instr("m", "_")).where(confusable("word", "key", "at"))
    terms = k.select(F.col("key").alias("word"), F.col("curated").alias("own"))
    near = near.join(terms, "word", "left")
    by_corpus = F.col("own").isNull() & (F.col("exact") >= OFTEN) & (F.col("n") * TIMES <= F.col("exact"))
    by_hand = F.col("curated") & ~F.coalesce("own", F.lit(False)) & (F.col("n") >= 2)
    w = Window.partitionBy("word").orderBy(F.desc("exact"), "key")
    return near.where(by_corpus | by_hand).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("word", "key", "n", "exact")


def correction_candidates(vocabulary: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """wrong, right, n, m: words in which one suspect syllable, replaced by its likely source, gives a more frequent word.

    vocabulary: word, n; pairs: a (seen), b (meant), a dictionary of fixed size.
    """
    places = vocabulary.select("word", "n", F.expr("explode(sequence(1, length(word)))").alias("i")).withColumn("a", F.expr("substring(word, i, 1)"))
    tried = places.join(F.broadcast(pairs.select("a", "b").distinct()), "a").select(F.col("word").alias("wrong"), "n", F.expr("concat(substring(word, 1, i - 1), b, substring(word, i + 1))").alias("right"))
    meant = vocabulary.select(F.col("word").alias("right"), F.col("n").alias("m")).where(F.col("m") >= least)
    return tried.join(meant, "right").where("m > n").groupBy("wrong", "right").agg(F.max("n").alias("n"), F.max("m").alias("m"))


def curated_terms(labels: DataFrame, name: str) -> DataFrame:
    """key: names of three to eight syllables that people wrote, whole, in parts, and parts without a particle."""
    plain = F.trim(F.regexp_replace(F.element_at(F.split(name, ":"), 1), r"\(.*?\)", ""))
    parts = F.regexp_extract_all(plain, F.lit("[가-힣]+"), F.lit(0))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, "(?<=[가-힣]{2})(?:의|은|는|이|가|을|를|에|와|과|로|으로)$", ""))
    whole = F.when(plain.contains(" "), F.array(F.regexp_replace(plain, r"\s", ""))).otherwise(F.array().cast("array<string>"))
    return labels.select(F.explode(F.concat(whole, parts, bare)).alias("key")).where(F.col("key").rlike("^[가-힣]{3,8}$")).distinct()


# --- headings as topics --------------------------------------------------------------------------------------------
#: Lines that are no topic: numbers alone, quotations and slashes, contents, makers of the book.
_NO_TOPIC = (r"^[\d\s.\-–]+$", r"/|[「」『』〈〉]|[가-힣]\s*\d{1,3}\s+\d", r"[_.]\s*\d{1,3}\s*$|\d{2,3}\s*$|\|", "지음|옮김|엮음|편저|일동|편역|해제했다|개정판")
_TOPIC_NUMBER = r"^(?:제\s*\d+\s*[장절편부]|\d+(?:\.\d+)*\.?|\(\d+\)|[가-하]\.|[①-⑳])\s*(.+)$"
SKIPPED = ("들어가며", "나가며", "맺음말", "요약", "정리하기", "생각해보기", "더읽을거리", "작품읽기", "핵심정리")


def topic_of(line: Column, title: Column) -> Column:
    """The topic that a heading names; null for lines that are no heading."""
    s = F.regexp_replace(F.regexp_replace(line, r"\s+", " "), "^[ .·­\\-—•|lI]+|[ .·­\\-—•|lI]+$", "")
    flat, book = F.regexp_replace(s, r"\s", ""), F.regexp_replace(F.coalesce(title, F.lit("")), r"\s", "")
    numbered = s.rlike(_TOPIC_NUMBER)
    body = F.trim(F.when(numbered, F.regexp_extract(s, _TOPIC_NUMBER, 1)).otherwise(s))
    head = (book != "") & (F.length(flat) >= 4) & (F.contains(book, flat) | F.contains(flat, book))
    hangul = F.regexp_count(body, F.lit("[가-힣]")) >= 0.5 * F.length(F.regexp_replace(body, r"\s", ""))
    plain = ~body.rlike("[다요][.!?。]|다$") & (F.length(body) <= 26) & ~body.rlike("[가-힣](?:고|며|서|면|은|는|을|를|의|에|와|과|도|만|나|랑)$")
    good = ~reduce(lambda a, b: a | b, [s.rlike(p) for p in _NO_TOPIC]) & ~head & F.length(body).between(3, 40) & hangul & (numbered | plain) & ~flat.isin(*SKIPPED)
    return F.when(good, body)


def heading_coverage(topics: DataFrame, concepts: DataFrame, least: int = 1) -> DataFrame:
    """area, topic, n, concept: how often each topic is a heading, and the concept of that name, if there is one."""
    counts = topics.groupBy("area", "topic").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    names = concepts.select(term_key(F.col("name")).alias("_k"), "concept").groupBy("_k").agg(F.min("concept").alias("concept"))
    return counts.withColumn("_k", term_key(F.col("topic"))).join(names, "_k", "left").drop("_k")


# --- catalogue and cards -------------------------------------------------------------------------------------------
def shown_names(terms: DataFrame) -> DataFrame:
    """shown, name: for each key of a shown label the spelling with most spaces, then the smallest."""
    w = Window.partitionBy("shown").orderBy(F.desc(F.length("label") - F.length(F.replace("label", F.lit(" "), F.lit("")))), "label")
    return terms.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("shown", F.col("label").alias("name"))


def catalogue(sources: DataFrame, concepts: DataFrame, notes: DataFrame, heading_books: DataFrame, junk: DataFrame) -> DataFrame:
    """name, areas, books, flags: every term of the indexes and every concept, in dictionary order.

    sources: key, label, book, category, quote; concepts: label, area, books; notes: key; heading_books: book, whose
    terms come from headings only; junk: key. A term that only such books give, or that is junk, is left out; concepts
    that no index names are added.
    """
    kept = sources.join(F.broadcast(heading_books.select("book", F.lit(True).alias("_h"))), "book", "left").withColumn("shown", term_key(F.col("label")))
    real = kept.groupBy("key").agg(F.bool_and(F.coalesce("_h", F.lit(False))).alias("only")).where("NOT only").select("key")
    kept = kept.join(real, "key", "left_semi").join(junk.select(F.col("key").alias("shown")).distinct(), "shown", "left_anti")
    named = concepts.select(term_key(F.col("label")).alias("shown"), F.lit(CONCEPT).alias("concept_bit")).distinct()
    written = notes.select(F.col("key").alias("shown"), F.lit(NOTE).alias("note_bit")).distinct()
    area = F.coalesce(*(F.when(F.col("category") == k, v) for k, v in AREAS.items()), F.lit(0))
    rolled = kept.groupBy("shown").agg(F.bit_or(area).alias("areas"), F.count_distinct("book").alias("books"), F.max(F.when(F.col("quote").isNotNull(), DEFINED).otherwise(0)).alias("defined"))
    rolled = rolled.join(named, "shown", "left").join(written, "shown", "left")
    flags = F.col("defined") + F.coalesce("concept_bit", F.lit(0)) + F.coalesce("note_bit", F.lit(0))
    terms = rolled.join(shown_names(kept.select("shown", "label").distinct()), "shown").select("shown", "name", "areas", "books", flags.alias("flags"))
    alone = concepts.withColumn("shown", term_key(F.col("label"))).join(terms.select("shown"), "shown", "left_anti")
    c_area = F.coalesce(*(F.when(F.col("area") == k, v) for k, v in AREAS.items()), F.lit(0))
    extra = alone.groupBy("shown").agg(F.min("label").alias("name"), F.bit_or(c_area).alias("areas"), F.max("books").alias("books"), F.lit(CONCEPT).alias("flags"))
    return terms.unionByName(extra).withColumn("order", sort_key(F.col("name")))


def found_terms(grams: DataFrame, terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """question, gram, key: indexed keys that a question's word reads: itself, spellings shown alike, and names of its alias group.

    grams: question, gram; terms: key, shown; aliases: grp, name, a dictionary of fixed size.
    """
    a = F.broadcast(aliases)
    mates = a.select(F.col("name").alias("gram"), "grp").join(a.select("grp", F.col("name").alias("other")), "grp").select("gram", "other")
    wider = grams.select("question", "gram", F.col("gram").alias("name")).unionByName(grams.join(mates, "gram").select("question", "gram", F.col("other").alias("name"))).distinct()
    spelled = terms.select(F.col("shown").alias("name"), "key").unionByName(terms.select(F.col("key").alias("name"), "key")).distinct()
    return wider.join(spelled, "name").select("question", "gram", "key").distinct()


def cards(found: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """question, gram, place, and the sources of its card in order: for each question the longest words, those of most
    books first, without words inside a longer hit; of a page's sources the better scored stays."""
    rows = found.join(sources, "key")
    weight = rows.groupBy("question", "gram").agg(F.count_distinct("book").alias("books"))
    inside = weight.select("question", F.col("gram").alias("_long"))
    free = weight.join(inside, (weight.question == inside.question) & (F.length("_long") > F.length("gram")) & F.contains("_long", "gram"), "left_anti")
    w = Window.partitionBy("question").orderBy(F.desc(F.length("gram")), F.desc("books"), "gram")
    top = free.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("question", "gram", "place")
    page = Window.partitionBy("question", "gram", "book", "pdf_page").orderBy(F.desc_nulls_last("score"), "key")
    one = rows.join(top, ["question", "gram"]).withColumn("_r", F.row_number().over(page)).where("_r = 1")
    order = Window.partitionBy("question", "gram").orderBy(F.col("quote").isNull().asc(), F.coalesce("indexed", F.lit(True)).desc(), F.coalesce("damaged", F.lit(False)).asc(), "book", "pdf_page")
    return one.withColumn("nth", F.row_number().over(order)).drop("_r")
