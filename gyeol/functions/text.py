"""Text keys and predicates as Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts and controls; plain \s of Java knows only ASCII.
WS = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]+"
#: Also hyphens, quotation marks and the middle dot, for the keys of terms.
TERM_WS = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f\-‘’'\"·]+"

#: What shows an exercise, an index or a publisher's catalogue in compact text.
EXERCISE = (
    r"(하|보|쓰|고르|구분|논의|정리|계획|말해|답하|찾아|비교|설명|제시|서술|토의|발표|작성|분석|평가)(해)?보?시오"
    r"|참\(t\)|거짓\(f\)|다음물음에답|다음진술|아래용어|^학습활동|^탐구활동|^연습문제|생각해볼문제|토의해봅시다|생각해봅시다"
)
EXERCISE_HEADING = r"^[^\p{L}\p{N}_]*(학습|탐구|연습|심화|적용)(활동|문제|과제)[^\p{L}\p{N}_]*$"
PUBLISHERS = r"교과서|천재교육|천재교과서|지학사|비상교과서|신사고|동아출판"


def compact(c: Column) -> Column:
    """Lower case without white space; null for null."""
    return F.lower(F.regexp_replace(c, WS, ""))


def term_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, TERM_WS, ""))


def count_of(c: Column, pattern: str) -> Column:
    """Matches of a pattern, 0 for an empty text."""
    return F.regexp_count(c, F.lit(pattern))


def occurrences(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def text_quality(c: Column) -> Column:
    """sparse under 30 letters and digits, review with many replacement characters, else extracted; null for null."""
    letters = count_of(c, "[가-힣A-Za-z0-9]")
    return F.when(c.isNull(), None).when(letters < 30, "sparse").when(occurrences(c, "�") > F.greatest(F.lit(3.0), F.length(c) * 0.01), "review").otherwise("extracted")


def passage_kind(c: Column) -> Column:
    """index, exercise, catalog, table, fragment or body, by the first rule that holds; null for null."""
    k = compact(c)
    return (
        F.when(c.isNull(), None)
        .when(F.substring(k, 1, 40).rlike("차례|찾아보기|참고문헌"), "index")
        .when(k.rlike(EXERCISE_HEADING) | k.rlike(EXERCISE), "exercise")
        .when(count_of(k, PUBLISHERS) >= 3, "catalog")
        .when(count_of(k, r"\p{Nd}") > F.greatest(F.lit(30.0), F.length(k) * 0.22), "table")
        .when(count_of(k, "[가-힣A-Za-z]") < 20, "fragment")
        .otherwise("body")
    )


def contains_all(c: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Conjunction over groups of the disjunction over their synonyms of containment; no groups hold for every text."""
    any_of = lambda g: reduce(lambda a, b: a | b, [c.contains(t) for t in g])
    return reduce(lambda a, b: a & b, [any_of(g) for g in groups], F.lit(True))


def strip_particle(c: Column) -> Column:
    """A token without its last particle, if it is longer than two characters."""
    return F.when(F.length(c) > 2, F.regexp_replace(c, "(에대해서|에관해서|에서는|인가요|인가|에게|에서|으로|이란|이랑|에는|에도|은|는|을|를|의|과|와|에)$", "")).otherwise(c)


def declarative(c: Column) -> Column:
    """Whether a text closes on a declarative ending."""
    return c.rlike("[다요][.!?。][”’']?$")


def _without(alphabet: str, out: str) -> str:
    """A character class of a range of Hangul without some of its syllables, in a form that every engine reads."""
    first, last = map(ord, alphabet)
    stops = sorted(map(ord, out))
    pieces = [(a, b) for a, b in zip([first, *(x + 1 for x in stops)], [*(x - 1 for x in stops), last], strict=True) if a <= b]
    return "[" + "".join(chr(a) + (f"-{chr(b)}" if b > a else "") for a, b in pieces) + "]"


#: Shapes that damaged scans leave. The first are looked for in compact text: symbols and digits among
#: syllables, a syllable inside a Latin gloss, a colon or carets in place of a stroke; then characters of no Korean
#: text; then a syllable that is no particle between two Latin words, or a Latin word between two, in spaced text.
_SYLLABLE = _without("가힣", "의은는이가을를과와도에로나만및즉등")
_GLOSSED = _without("가힣", "형류군급계열")
NOISE_SHAPES = (
    rf"[가-힣][A-Za-z%&@]{{1,3}}[가-힣]|[가-힣][0-9][}}\-]|[가-힣][0-9]{{3,}}|[가-힣][λ}}]|[0-9]π|[a-zA-Z]\)'|[-~]{{4,}}"
    rf"|\((?:[a-hjkm-z]|[a-z]{{2,3}}){_GLOSSED}|[a-z]:[a-z0-9]|[~^]{{2,}}"
)
NOISE_FOREIGN = r"[À-ɏͰ-ϿЀ-ӿ￠-￦¢©«®»™\\]"
NOISE_STRANDED = rf"[A-Za-z]{{2,}}[ \t]+(?:[가-힣]{{2}}|{_SYLLABLE})[ \t]+[A-Za-z]{{2,}}|(?<![가-힣]){_SYLLABLE}[ \t]+[A-Za-z]{{3,}}[ \t]+{_SYLLABLE}(?![가-힣])"
NOISE_OPENING = "^[;:，]"


def noise_count(c: Column) -> Column:
    """Shapes that damaged scans leave in a text."""
    k = F.lower(F.regexp_replace(c, WS, ""))
    return count_of(k, NOISE_SHAPES) + count_of(k, NOISE_FOREIGN) + count_of(c, NOISE_STRANDED) + k.rlike(NOISE_OPENING).cast("int")


#: What a number counts, and what follows a character of a printed gloss.
_COUNTED = (
    "(?:부터|까지|내지|또는|및|이상|이하|미만|이내|년대|세기|번째|차시|개국|년|월|일|시|분|초|개|명|사람|권|쪽|면|장|절|항|조|편|부|차|회|번|등급|단계|가지|종류|음절|음보|자|글자|행|연|대|세|학년|학기|인칭|모음|자음|품사|퍼센트|배|점|마리|곳|줄|칸|단원|과|원)"
    "(?:이|가|은|는|을|를|의|에|에서|과|와|도|만|로|으로|부터|까지|씩|째|간|쯤|이나|나|이다|이며|이고|처럼|같이|만큼|에서는|에는|으로는|로는|에서도|에도|이라는|라는|이란)?"
)
_GLOSS_TAIL = "(?:의|이|가|을|를|은|는|에|와|과|도|만|로|으|라|하|한|들|인|시|형|적|론|설|편|권|장|절|기|서|부|년|대|체|류|어|음|자|문|학|법|성|화|식|제)"


def damage_kinds(c: Column) -> Column:
    """Which kinds of damage show, in this order: letter (a lone capital outside quotes and glosses), digit (a number
    between words that counts nothing), symbol, unspaced (18 syllables in a row), hanja (a syllable inside a gloss)."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\([^)]*[A-Za-z]{2,}[^)]*\)", ""), r"[‘'\"“]\s*[A-Za-z]\s*[’'\"”]", "")
    numbers = F.regexp_extract_all(plain, F.lit(r"[가-힣]\s\d{1,2}\s([가-힣]+)"), F.lit(1))
    kinds = F.array(
        F.when(plain.rlike(r"(?<![A-Za-z\-/])[A-Z](?![A-Za-z])"), "letter"),
        F.when(F.exists(numbers, lambda w: ~w.rlike(f"^{_COUNTED}$")), "digit"),
        F.when((c.rlike("^[%$#@&*|]") & ~c.rlike(r"^[@*%·•]\s")) | c.rlike("[가-힣][%&@|][가-힣]"), "symbol"),
        F.when(c.rlike("[가-힣]{18,}"), "unspaced"),
        F.when(c.rlike(f"[一-鿿](?!{_GLOSS_TAIL}(?![가-힣]))[가-힣]"), "hanja"),
    )
    return F.array_compact(kinds)


def footer_number(c: Column) -> Column:
    """The printed number in the last line, else the last but one, that has one between 1 and 2999."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda s: F.regexp_replace(s, f"^{WS}|{WS}$", "")), lambda s: s != "")

    def of(s: Column) -> Column:
        first = F.regexp_extract(s, r"^(\d{1,4})(?:\s+[^\d].*)?$", 1)
        n = F.when(first != "", first).otherwise(F.regexp_extract(s, r"^.*[가-힣]\s+(\d{1,4})$", 1))
        n = F.try_to_number(F.when(n != "", n), F.lit("9999")).cast("int")
        return F.when((n > 0) & (n < 3000), n)

    return F.coalesce(of(F.get(lines, F.size(lines) - 1)), of(F.get(lines, F.size(lines) - 2)))


def split_sentences(c: Column) -> Column:
    """Sentences of Korean reading text: cut after a declarative or interrogative ending and its mark."""
    marked = F.regexp_replace(c, r"([다요까][.!?。][”’']?)(\s|$)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters of the compact text, in order."""
    k = compact(c)
    return F.when(F.length(k) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(k) - 1), lambda i: F.substr(k, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
