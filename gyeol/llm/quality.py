"""Problem 2: text statistics of every document, and whether it is prose, a list, a table or junk.

Huge texts are split into chunks. Each chunk gives associative partial counts together with its boundary state (the
words and lines that its edges cut), partial counts merge in a tree, and ratios and rules come from the merged counts.
"""

from __future__ import annotations

import pickle
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.textio import arrow_map, batch_of, slices

CHUNK = 32_768
#: States merged by one task; LEVELS of the tree are enough for the longest string there can be.
FAN_IN, LEVELS = 64, 3
#: An address at the end of a record has no more code points than this.
ADDRESS = 2000

#: Frequent function words of the languages in the books.
COMMON_WORDS = frozenset(
    "그리고 그러나 그런데 그래서 따라서 또한 다시 먼저 서로 함께 더욱 가장 매우 한편 특히 이러한 그러한 어떤 모든 여러 다른 같은 이 그 것이다 있다 한다 보면 수 것은 때 위해 통하여 대로 말하면 "
    "the of and to in a is that it for on with as by an this at from or be are not his her".split()
)
_SENTENCE_END = re.compile(r"[.!?…。．！？][\"”’」』)）\]〕》〉]*\s*$")
_INNER_END = re.compile(r"[.!?。．！？][\"”’」』)）\]]*(?=\s|$|[가-힣])|[。！？]")
_BULLET = re.compile(r"\s*(?:[•·▪○●■□◆◇▶▷※∙‣◦*]|[-–—－](?=\s))\s*\S")
_NUMBERED = re.compile(r"\s*(?:[(（]?(?:\d{1,3}|[가-하ㄱ-ㅎ]|[a-zA-Z])[)）]|\d{1,3}[.．](?=\s)|[①-⑳㉠-㉻])\s*\S")
_ENTRY = re.compile(r"^\S.{0,60}?(?:\s{2,}|[.·…]{3,}\s*|\t)\d[\d,、，\s\-–－~]*$")
_RECORD_END = re.compile(r"[,，]\s*(?:\d{4}|[^,，]{1,12}출판)[.．]?\s*(?:\S+://\S+)?$")
_RECORD = re.compile(r"[(（]\d{4}[)）][,，].*[,，]")
_PREDICATE = re.compile(r"(?:\S다|까|요|시오)[\"”’」』)）]*\s*$")
_HANGUL = re.compile(r"[가-힣ᄀ-ᄒ]")
_HANJA = re.compile(r"[㐀-鿿豈-﫿]")
_LATIN = re.compile(r"[A-Za-zａ-ｚＡ-Ｚ]")
_DIGIT = re.compile(r"\d")
_SYMBOL = re.compile(r"[^\w\s.,!?;:'\"()\[\]“”‘’「」『』。、，．！？：；（）·…\-–—‐‑~〜/○△×+•▪%­​-‍⁠﻿]")
_STROKE = re.compile(r"[|¦ㅣㅡㅓ`^~=_;!:＝～；！：]")
_BYTES_READ_WRONG = re.compile(r"[À-ÿ°±´º¼½¾¿]")
_GAP = re.compile(r"\S[^\S\n\t]{2,}(?=\S)")

COUNTS = ["chars", "visible", "hangul", "rare_hangul", "letters", "hanja", "latin", "digits", "symbols", "strokes", "mojibake"]
WORDS = ["words", "word_chars", "common_words", "single_letter_words", "noisy_words"]
LINES = ["lines", "ended_lines", "list_lines", "table_lines", "comma_items", "sentence_ends"]


def is_rare_hangul(ch: str) -> bool:
    """Outside the 2,350 syllables of the national character set, which hold all that running Korean text needs."""
    try:
        return len(ch.encode("euc_kr")) != 2
    except UnicodeEncodeError:
        return "가" <= ch <= "힣"


def char_class(c: str) -> tuple[int, ...]:
    """Which of COUNTS a character counts for."""
    tests = (_HANGUL, _HANJA, _LATIN, _DIGIT, _SYMBOL, _STROKE, _BYTES_READ_WRONG)
    hangul, hanja, latin, digit, symbol, stroke, wrong = (p.match(c) is not None for p in tests)
    flags = [True, not c.isspace(), hangul, hangul and is_rare_hangul(c), c.isalpha(), hanja, latin, digit, symbol, stroke, wrong]
    return tuple(i for i, f in enumerate(flags) if f)


_flags = np.full(0x110000, -1, dtype=np.int16)


def char_counts(texts: list[str]) -> list[list[int]]:
    """COUNTS of each text: code points of many texts at once, looked up in a table that grows with what it meets."""
    return [n for part in slices(texts) for n in _char_counts(part)]


def _char_counts(texts: list[str]) -> list[list[int]]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for o in np.unique(points[_flags[points] < 0]).tolist():
        _flags[o] = sum(1 << i for i in char_class(chr(o)))
    flags = _flags[points]
    ends = np.cumsum([len(t) for t in texts])
    totals = [np.concatenate([[0], np.cumsum(flags >> i & 1)]) for i in range(len(COUNTS))]
    return np.stack([c[ends] - c[ends - [len(t) for t in texts]] for c in totals], axis=1).tolist()


def word_counts(words: list[str]) -> list[int]:
    strange = _SYMBOL.search(" ".join(words)) is not None
    return [
        len(words), sum(map(len, words)), sum(w.strip(".,!?“”\"'").lower() in COMMON_WORDS for w in words),
        sum(len(w) == 1 and w.isascii() and w.isalpha() for w in words), sum(_SYMBOL.search(w) is not None for w in words) if strange else 0,
    ]


#: The parts of a line that chunks have cut, in order: they are put together when the line is complete.
Fragment = tuple
NO_LINE: Fragment = ()


def line_counts(line: str) -> list[int]:
    """[lines, ended, list, table, comma items, sentence ends] of one complete line."""
    if not line.strip():
        return [0] * 6
    inner = len(_INNER_END.findall(line))
    commas = line.count(",") + line.count("，") + line.count("、")
    tabs, bars, gaps = line.count("\t"), line.count("|"), len(_GAP.findall(line))
    whole = (line if line.isascii() else unicodedata.normalize("NFC", line)).rstrip()
    ended = _SENTENCE_END.search(whole, max(0, len(whole) - ADDRESS)) is not None
    table = tabs >= 1 or bars >= 2 or (gaps >= 2 and not ended)
    record = _RECORD_END.search(whole, max(0, len(whole) - ADDRESS)) is not None or _RECORD.search(whole) is not None
    entry = not table and not ended and (record or _ENTRY.search(whole) is not None)
    bullet = _BULLET.match(whole) is not None or _NUMBERED.match(whole) is not None
    listed = not table and (entry or (bullet and not ended and not _PREDICATE.search(whole, max(0, len(whole) - ADDRESS))) or (bars == 0 and record))
    return [1, ended, listed, table, commas, inner]


def partial(s: str, first: bool, last: bool, chars: list[int] | None = None) -> tuple:
    """(counts, words, lines, one word only, word at the left edge, at the right edge, one line only, line left, line right)."""
    words = s.split()
    left = words.pop(0) if words and not first and not s[0].isspace() else ""
    whole_word = bool(left) and not words and not s[-1:].isspace() and len(left) == len(s)
    right = words.pop() if words and not last and not s[-1].isspace() else ""
    if left and not whole_word and not right and not words and not last and not s[-1].isspace():
        whole_word = True
    lines = s.split("\n")
    line_right = (lines.pop(),) if not last else NO_LINE
    one_line = not lines and not last
    line_left = NO_LINE
    if not first and lines:
        line_left = (lines.pop(0),)
    elif not first and last:
        pass
    n = [0] * 6
    for x in lines:
        n = [a + b for a, b in zip(n, line_counts(x), strict=True)]
    edge = lambda w: (w,) if w else ()
    return chars or char_counts([s])[0], word_counts(words), n, whole_word, edge(left), edge(right), one_line, line_left, line_right


def merge(a: tuple, b: tuple) -> tuple:
    """The partial counts of two neighbouring chunks: associative, and right for words and lines cut by the edge."""
    plus = lambda x, y: [i + j for i, j in zip(x, y, strict=True)]
    chars, words, lines = plus(a[0], b[0]), plus(a[1], b[1]), plus(a[2], b[2])
    # words
    if a[3] and b[3]:
        one_word, left, right = True, a[4] + b[4], ()
    elif a[3]:
        one_word, left, right = False, a[4] + b[4], b[5]
    elif b[3]:
        one_word, left, right = False, a[4], a[5] + b[4]
    else:
        one_word, left, right = False, a[4], b[5]
        if middle := "".join(a[5] + b[4]):
            words = plus(words, word_counts([middle]))
    # lines: a chunk without line feed is one fragment, kept at its right
    if a[6] and b[6]:
        one, l_left, l_right = True, NO_LINE, a[8] + b[8]
    elif a[6]:
        one, l_left, l_right = False, a[8] + b[7], b[8]
    elif b[6]:
        one, l_left, l_right = False, a[7], a[8] + b[8]
    else:
        one, l_left, l_right = False, a[7], b[8]
        lines = plus(lines, line_counts("".join(a[8] + b[7])))
    return chars, words, lines, one_word, left, right, one, l_left, l_right


def closed(p: tuple) -> list[int]:
    """All counts of a whole text, the words and lines at its outer edges included."""
    words, lines = p[1], p[2]
    for w in (p[4], p[5]):
        if word := "".join(w):
            words = [a + b for a, b in zip(words, word_counts([word]), strict=True)]
    for f in (p[7], p[8]):
        lines = [a + b for a, b in zip(lines, line_counts("".join(f)), strict=True)]
    return [*p[0], *words, *lines]


def text_counts(s: str, chunk: int = CHUNK, chars: list[int] | None = None) -> list[int]:
    """The counts of one text, by the same chunks and merges as the distributed plan."""
    if chars and len(s) <= chunk:
        return closed(partial(s, False, False, chars))
    parts = [partial(s[i : i + chunk], False, False) for i in range(0, max(1, len(s)), chunk)]
    whole = parts[0]
    for p in parts[1:]:
        whole = merge(whole, p)
    return closed(whole)


FIELDS = [*COUNTS, *WORDS, *LINES]


def _counted(df: DataFrame, key: str, kind: str, text: str, chunk: int) -> DataFrame:
    schema = f"`{key}` {kind}, " + ", ".join(f"{f} bigint" for f in FIELDS)

    def columns(keys: pa.Array, rows: list[list[int]]) -> pa.RecordBatch:
        by = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
        return batch_of(**{key: keys}, **{f: (list(map(int, c)), pa.int64()) for f, c in zip(FIELDS, by, strict=True)})

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        return columns(b.column(0), [text_counts(t, chunk, n) for t, n in zip(texts, char_counts(texts), strict=True)])

    short = arrow_map(df.where(F.length(text) <= chunk), whole, schema)

    def parts(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(2).to_pylist()
        made = [pickle.dumps(partial(t, False, False, n)) for t, n in zip(texts, char_counts(texts), strict=True)]
        return batch_of(**{key: b.column(0)}, doc=b.column(3), no=b.column(1), part=(made, pa.binary()))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [(i, no, t[no * chunk : (no + 1) * chunk]) for i, t in enumerate(b.column(1).to_pylist()) for no in range(-(-len(t) // chunk))]
        rows, no, text = zip(*made, strict=True)
        return batch_of(**{key: b.column(0).take(pa.array(rows, pa.int64()))}, doc=b.column(2).take(pa.array(rows, pa.int64())), no=(list(no), pa.int32()), _t=(list(text), pa.string()))

    # copies of a key are texts of their own; the chunks of one huge text are spread over the tasks
    long_texts = df.where(F.length(text) > chunk).select(key, F.col(text).alias("_t"), F.xxhash64(text).alias("doc"))
    pieces = arrow_map(long_texts.dropDuplicates([key, "doc"]), cut, f"`{key}` {kind}, doc bigint, no int, _t string").repartition("doc", "no")
    states = arrow_map(pieces.select(key, "no", "_t", "doc"), parts, f"`{key}` {kind}, doc bigint, no int, part binary")

    def fold(pdf: pd.DataFrame) -> tuple:
        whole = None
        for raw in pdf.sort_values("no")["part"]:
            p = pickle.loads(raw)
            whole = p if whole is None else merge(whole, p)
        return whole

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "doc": [pdf["doc"].iloc[0]], "no": [int(pdf["no"].min()) // FAN_IN], "part": [pickle.dumps(fold(pdf))]})

    for _ in range(LEVELS - 1):
        states = states.groupBy(key, "doc", F.floor(F.col("no") / FAN_IN).alias("_g")).applyInPandas(folded, f"`{key}` {kind}, doc bigint, no int, part binary")
    long = states.groupBy(key, "doc").applyInPandas(lambda pdf: pd.DataFrame([[pdf[key].iloc[0], *map(int, closed(fold(pdf)))]], columns=[key, *FIELDS]), schema)
    return short.unionByName(long)


def junk_rule(c):
    """Whether there is nothing to read in a text, from its counts: c gives a count by name, as a column or as an array."""
    return (
        (c("mojibake") > 0.3 * c("visible"))
        | (c("strokes") > 0.35 * c("visible"))
        | ((c("rare_hangul") > 0.3 * c("hangul")) & (c("hangul") > 0.2 * c("visible")) & (c("hangul") > 3))
        | ((c("symbols") + c("noisy_words") > 0.12 * c("visible")) & (c("latin") > 0.4 * c("visible")) & (c("single_letter_words") + c("noisy_words") > 0.35 * c("words")))
        | ((c("letters") + c("digits") < 0.3 * c("visible")) & (c("table_lines") == 0))
    )


def junk_texts(texts: list[str]) -> list[bool]:
    """junk_rule of whole texts: words and lines are counted only where characters alone don't decide."""
    n = np.array(char_counts(texts), dtype=np.int64).reshape(len(texts), len(COUNTS))
    c = {name: n[:, i] for i, name in enumerate(COUNTS)} | {f: np.zeros(len(texts), dtype=np.int64) for f in (*WORDS, *LINES)}
    by_words = (c["symbols"] > 0) & (c["latin"] > 0.4 * c["visible"])
    by_lines = c["letters"] + c["digits"] < 0.3 * c["visible"]
    for i in np.flatnonzero(by_words | by_lines).tolist():
        for name, value in zip(FIELDS, text_counts(texts[i], max(1, len(texts[i]))), strict=True):
            c[name][i] = value
    return junk_rule(c.__getitem__).tolist()


def text_statistics(df: DataFrame, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """One row for every distinct key: counts, ratios and `form` (prose, list, table, junk, or null for a blank text).

    Rows that share a key are copies and give one row. A null text has null counts and form, an empty or blank one
    zero counts, null ratios and form. Further columns of df are left aside.
    """
    df = df.select(F.col(key), F.col(text).alias("_text"))
    kind = df.schema[key].dataType.simpleString()
    counts = _counted(df.where(F.col("_text").isNotNull()), key, kind, "_text", chunk)
    nothing = df.where(F.col("_text").isNull()).select(key, *(F.lit(None).cast("bigint").alias(f) for f in FIELDS))
    counts = counts.unionByName(nothing).groupBy(key).agg(*(F.max(f).alias(f) for f in FIELDS))
    c, ratio = F.col, lambda a, b: F.try_divide(F.col(a), F.col(b))
    counts = counts.select(
        "*",
        ratio("word_chars", "words").alias("mean_word_length"), ratio("symbols", "visible").alias("symbol_ratio"), ratio("ended_lines", "lines").alias("ended_line_share"),
        ratio("common_words", "words").alias("common_word_share"), ratio("rare_hangul", "hangul").alias("rare_hangul_share"), ratio("digits", "visible").alias("digit_ratio"),
    )
    junk = junk_rule(c)
    form = (
        F.when(c("visible").isNull() | (c("visible") == 0), None)
        .when(junk, "junk")
        .when(c("table_lines") > 0.5 * c("lines"), "table")
        .when(c("list_lines") > 0.5 * c("lines"), "list")
        .when((c("list_lines") + c("table_lines") > 0.6 * c("lines")), "list")
        .when((c("sentence_ends") <= 0) & (c("comma_items") >= 3) & (c("comma_items") >= 0.4 * c("words")), "list")
        .otherwise("prose")
    )
    return counts.withColumn("form", form)
