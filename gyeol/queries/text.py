"""Keys, quality, kinds, numbers and damage of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import hangul, text
from gyeol.operators import evidence
from gyeol.queries.registry import Registry, compact, matches
from gyeol.sources import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_TERM_WS = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f\-‘’''\"·]+"


@query(f"SELECT id, {compact('raw')} AS compact_key, lower(regexp_replace(raw, '{_TERM_WS}', '', 'g')) AS term_key FROM passages")
def compact_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("id", text.compact(F.col("raw")).alias("compact_key"), text.term_key(F.col("raw")).alias("term_key"))


@query(rf"""SELECT id, CASE WHEN text IS NULL THEN NULL WHEN {matches('text', '[가-힣A-Za-z0-9]')} < 30 THEN 'sparse'
  WHEN length(text) - length(replace(text, chr(65533), '')) > greatest(3, length(text) * 0.01) THEN 'review' ELSE 'extracted' END AS quality FROM pages""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("id", text.text_quality(F.col("text")).alias("quality"))


@query(rf"""WITH p AS (SELECT id, raw, {compact('raw')} AS k FROM passages)
SELECT id, CASE WHEN raw IS NULL THEN NULL
  WHEN regexp_matches(k[1:40], '차례|찾아보기|참고문헌') THEN 'index'
  WHEN regexp_matches(k, '{text.EXERCISE_HEADING}') OR regexp_matches(k, '{text.EXERCISE}') THEN 'exercise'
  WHEN {matches('k', text.PUBLISHERS)} >= 3 THEN 'catalog'
  WHEN {matches('k', r'\p{Nd}')} > greatest(30, length(k) * 0.22) THEN 'table'
  WHEN {matches('k', '[가-힣A-Za-z]')} < 20 THEN 'fragment' ELSE 'body' END AS kind FROM p""")
def passage_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("id", text.passage_kind(F.col("raw")).alias("kind"))


@query(f"""SELECT id, {compact('raw')} = {compact('display')} AS same FROM passages WHERE {compact('raw')} IS DISTINCT FROM {compact('display')}""")
def display_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose display differs from raw by more than white space."""
    p = table(spark, d, "passages").select("id", text.compact(F.col("raw")).alias("a"), text.compact(F.col("display")).alias("b"))
    return p.where(~F.col("a").eqNullSafe(F.col("b"))).select("id", (F.col("a") == F.col("b")).alias("same"))


_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda s: regexp_replace(s, '^[\s\p{Z}\x{85}\x0b\x1c-\x1f]+|[\s\p{Z}\x{85}\x0b\x1c-\x1f]+$', '', 'g')), lambda s: s <> '')"


def _number(s: str) -> str:
    first = rf"regexp_extract({s}, '^(\d{{1,4}})(?:\s+[^\d].*)?$', 1)"
    n = rf"TRY_CAST(CASE WHEN {first} <> '' THEN {first} ELSE regexp_extract({s}, '^.*[가-힣]\s+(\d{{1,4}})$', 1) END AS INTEGER)"
    return f"CASE WHEN {n} > 0 AND {n} < 3000 THEN {n} END"


@query(f"WITH l AS (SELECT id, {_LINES} AS l FROM pages WHERE text IS NOT NULL) SELECT id, coalesce({_number('l[-1]')}, {_number('l[-2]')}) AS number FROM l")
def footer_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("text IS NOT NULL").select("id", text.footer_number(F.col("text")).alias("number"))


#: Written for an engine without look-around: the character before or after is matched instead.
_LONE = text._SYLLABLE
_NOISE = (
    r"[가-힣][A-Za-z%&@]{1,3}[가-힣]|[가-힣][0-9][}\-]|[가-힣][0-9]{3,}|[가-힣][λ}]|[0-9]π|[a-zA-Z]\)''|[-~]{4,}"
    rf"|\((?:[a-hjkm-z]|[a-z]{{2,3}}){text._GLOSSED}|[a-z]:[a-z0-9]|[~^]{{2,}}"
)
_BETWEEN = rf"[A-Za-z]{{2,}}[ \t]+(?:[가-힣]{{2}}|{_LONE})[ \t]+[A-Za-z]{{2,}}|(?:^|[^가-힣]){_LONE}[ \t]+[A-Za-z]{{3,}}[ \t]+{_LONE}(?:$|[^가-힣])"


@query(rf"""WITH p AS (SELECT id, display, {compact('display')} AS k FROM passages WHERE display IS NOT NULL)
SELECT id, {matches('k', _NOISE)} + {matches('k', r'[À-ɏͰ-ϿЀ-ӿ￠-￦¢©«®»™\\]')} + {matches('display', _BETWEEN)} + CASE WHEN regexp_matches(k, '^[;:，]') THEN 1 ELSE 0 END AS noise FROM p""")
def noise_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").where("display IS NOT NULL").select("id", text.noise_count(F.col("display")).alias("noise"))


_ALONE_TAIL = text._without("가힣", "의이가을를은는에와과도만로으라하한들인시형적론설편권장절기서부년대체류어음자문학법성화식제")


@query(rf"""WITH p AS (SELECT id, display, regexp_replace(regexp_replace(display, '\([^)]*[A-Za-z]{{2,}}[^)]*\)', '', 'g'), '[‘''"“]\s*[A-Za-z]\s*[’''"”]', '', 'g') AS plain FROM passages WHERE display IS NOT NULL)
SELECT id, concat_ws(',', CASE WHEN regexp_matches(plain, '(^|[^A-Za-z\-/])[A-Z]($|[^A-Za-z])') THEN 'letter' END,
  CASE WHEN len(list_filter(regexp_extract_all(plain, '[가-힣]\s\d{{1,2}}\s([가-힣]+)', 1), lambda w: NOT regexp_full_match(w, '{text._COUNTED}'))) > 0 THEN 'digit' END,
  CASE WHEN (regexp_matches(display, '^[%$#@&*|]') AND NOT regexp_matches(display, '^[@*%·•]\s')) OR regexp_matches(display, '[가-힣][%&@|][가-힣]') THEN 'symbol' END,
  CASE WHEN regexp_matches(display, '[가-힣]{{18,}}') THEN 'unspaced' END,
  CASE WHEN regexp_matches(display, '[一-鿿](?:[가-힣]{{2}}|{_ALONE_TAIL})') THEN 'hanja' END) AS kinds FROM p""")
def damage_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").where("display IS NOT NULL").select("id", F.concat_ws(",", text.damage_kinds(F.col("display"))).alias("kinds"))


@query(r"""SELECT word, chr(CAST(unicode(word) AS INTEGER)) AS syllable, (unicode(word) - 44032) // 588 AS onset, (unicode(word) - 44032) % 588 // 28 AS nucleus, (unicode(word) - 44032) % 28 AS coda
FROM (SELECT DISTINCT word FROM source_words WHERE regexp_matches(word, '^[가-힣]'))""")
def hangul_letters(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "source_words").select("word").distinct().where(F.col("word").rlike("^[가-힣]"))
    s = F.substring("word", 1, 1)
    parts = hangul.letters(s)
    at = lambda table_, x: F.array_position(F.array(*map(F.lit, table_)), x) - 1
    return w.select("word", s.alias("syllable"), at(hangul.ONSETS, parts["onset"]).alias("onset"), at(hangul.NUCLEI, parts["nucleus"]).alias("nucleus"), at(hangul.CODAS, parts["coda"]).alias("coda"))


_KEY = "lower(regexp_replace(label, '^[^가-힣ㄱ-ㅎA-Za-z0-9]+', ''))"


@query(rf"""WITH l AS (SELECT DISTINCT label FROM (SELECT word AS label FROM source_words UNION ALL SELECT title FROM books UNION ALL SELECT unnest(regexp_extract_all(display, '[A-Za-z]+')) FROM passages) WHERE label IS NOT NULL),
k AS (SELECT label, {_KEY} AS s FROM l)
SELECT label, CASE WHEN regexp_matches(s, '^[가-힣ㄱ-ㅎ]') THEN 0 WHEN regexp_matches(s, '^[a-z]') THEN 1 ELSE 2 END AS rank,
  CASE WHEN regexp_matches(s, '^[가-힣]') THEN (unicode(s) - 44032) // 588 ELSE 0 END AS initial FROM k""")
def dictionary_order(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "source_words").select(F.col("word").alias("label")).unionByName(table(spark, d, "books").select(F.col("title").alias("label")))
    latin = table(spark, d, "passages").select(F.explode(F.regexp_extract_all("display", F.lit("[A-Za-z]+"), F.lit(0))).alias("label"))
    key = hangul.sort_key(F.col("label"))
    return words.unionByName(latin).where("label IS NOT NULL").distinct().select("label", key["rank"].alias("rank"), key["initial"].alias("initial"))


@query("SELECT id, regexp_replace(sentence, '(은|는|이|가|을|를|의|과|와|에)$', '') AS stem FROM (SELECT id, unnest(regexp_extract_all(display, '[가-힣]{5}(은|는|을|를|의|과|와)( |$)')) AS s0, trim(s0) AS sentence FROM passages)")
def stripped_particles(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "passages").select("id", F.explode(F.regexp_extract_all("display", F.lit("[가-힣]{5}(?:은|는|을|를|의|과|와)(?: |$)"), F.lit(0))).alias("w"))
    return w.select("id", text.strip_particle(F.trim("w")).alias("stem"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x), lambda x: NOT regexp_matches(x, '제공된 (자료|근거)|근거 자료|검색 결과|주어진 (자료|문서)')) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(l, ' ')) AS digest FROM s""")
def scrubbed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(evidence.without_meta(F.col("text"))).alias("digest"))


@query("SELECT id, sha256(coalesce(text, '')) AS digest, substr(sha1(coalesce(text, '')), 1, 16) AS card FROM chunks")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "chunks").select("id", F.sha2(t, 256).alias("digest"), F.substring(F.sha1(t), 1, 16).alias("card"))
