"""Problem 4: the marks of the scanner and of the printed page, and continuous paragraphs without them.

Page furniture and broken words are found line by line. Misrecognised characters inside words show by a symbol, digit
or letter that no word has there, or by the corpus: a frequency lexicon of word forms, stems and word beginnings is
built over all texts; words that neither it nor two of its entries together explain are looked up in a
symmetric-delete index of its frequent entries, where both sides leave out one character. Pairs are
kept that differ in one letter of one syllable, weighted by how usual it is for the scanner to take that letter for the
other: these weights are learned from long words, where a pair is no chance. A stem that is itself a usual misreading of
a far more frequent one explains nothing. Latin words are looked up by known confusions, each in each of its places.
Corpus bigrams with the words beside it choose between several repairs.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.quality import COUNTS, char_counts
from gyeol.llm.textio import arrow_map, batch_of, materialised, sized_join
from gyeol.llm.visual import canonical

#: A repair must be so many times as frequent as the word it replaces; parts must be so many times as frequent to explain it.
RATIO, EXPLAINS = 20, 4
#: Confusions of letters are learned from words of so many syllables, where a pair is no chance. One is usual if the
#: scanner makes at least this share of a letter's misreadings by it; a letter that is seldom misread is judged by what others
#: become, as if PRIOR[0] more cases said so, and what none becomes is ruled out the later the higher PRIOR[1] is.
LONG, USUAL, PRIOR = 4, 0.1, (2, 40)
#: Longer runs without a space are looked up in windows of so many characters, each half over the one before.
LONGEST = 40
HYPHENS = "-‐‑¬­－"
#: What may stand between syllables of a scanned word only by mistake.
SYMBOLS = "�&}{@\\\\§¥«»¢®™€†λ°¤^_£©¶±×=<>|#*+;"
_SYMBOL_IN_WORD = re.compile(rf"(?<=[가-힣])[{SYMBOLS}%](?=[가-힣])|(?<=[가-힣])[�&}}@\\§¥«¢®™€†λ%](?=[\s.,)”’\]]|$)|(?<![\w%])[�&}}@\\§¥«¢®™€†λ%](?=[가-힣])")
_ALIEN_IN_WORD = re.compile(r"(?<=[가-힣])(?<!제)[0-9](?=[가-힣])|(?<=[가-힣])[A-Za-z](?=[가-힣])")
_ALIEN_BEFORE = re.compile(r"(?:^|(?<=\s))[7lE0](?=[가-힣]{2})(?!쪽|장|절|개|월|일|년|명|번|권|차)")
_ALIEN_AFTER = re.compile(r"(?<=[가-힣])[7lE0](?=[\s.,)]|$)")
_SYMBOL_IN_LATIN = re.compile(r"(?<=[A-Za-z])[€†¢®™§«¥�&}@\\0135|](?=[a-z])|(?<![\w€])[€†¢®™§«¥�}|](?=[a-z]{2})|(?<=[a-z])[€†¢®™§«¥�}|](?=[\s.,;!?)]|$)")
_NUMBER_WITH_LETTER = re.compile(r"(?<![A-Za-z0-9])(?=[0-9lIOoZzSB]*\d)(?=[0-9]*[lIOoZzSB])[0-9lIOoZzSB]{2,5}(?![A-Za-z0-9])")
_NUMERAL = r"[0-9lIOoZzSB]{1,4}"
_ONLY_NUMBER = re.compile(rf"^[\s\-–—|〔\[(.·]*(?:[pP]\.?\s*)?({_NUMERAL})\s*(?:쪽)?[\s\-–—|〕\]).·]*$")
_NUMBER_FIRST = re.compile(rf"^[\s\-–—|〔\[(]*(?:[pP]\.?\s*)?({_NUMERAL})\s*(?:쪽)?(?:\s*[\-–—|〕\])]\s*|\s+)(?=\S)")
_NUMBER_LAST = re.compile(rf"(?:\s*[\-–—|〔\[(]\s*|\s+)(?:[pP]\.?\s*)?({_NUMERAL})\s*(?:쪽)?[\s\-–—|〕\])]*$")
_CHAPTER = re.compile(rf"^(?:제|[{SYMBOLS}%])\s?[0-9lIOoZzSB]{{1,3}}\s?(?:장|[^\s가-힣0-9])\s*·?\s*\S")
_ENDED = re.compile(r"[.!?。！？][”’」』)\]\"]*$")
_HANGUL_WORD = re.compile(r"(?=[*]?[가-힣])[가-힣*]{2,}|[A-Za-z]{3,}")
#: A character inside a word that can't be right; * stands for it when the word is looked up.
_ALIENS = re.compile("|".join(p.pattern for p in (_SYMBOL_IN_WORD, _ALIEN_IN_WORD, _ALIEN_BEFORE, _ALIEN_AFTER)))
#: Particles and endings that stems take.
PARTICLES = "은 는 이 가 을 를 의 에 로 와 과 도 만 에서 에게 으로 이나 부터 까지 처럼 보다 이다 하다 한다 된다 들 니 면 고 며".split()
#: Latin letters that scanners take for one another.
LATIN_CONFUSIONS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ii", "u"), ("i", "l"), ("c", "e"), ("t", "f"))


def edge_lines(lines: list[str]) -> list[int]:
    """Places of the first and the last line with something in it."""
    there = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({there[0], there[-1]}) if there else []


def close(a: str, b: str) -> int:
    """Characters in which two strings of one length differ; many if the lengths differ."""
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99


def furniture(line: str, title: str | None) -> tuple[bool, bool, bool]:
    """(running head, page number, misread) of a line at a page's edge, of canonical characters."""
    s = line.strip()
    if not s or len(s) > 60:
        return False, False, False
    if m := _ONLY_NUMBER.match(s):
        n = m.group(1)
        return (False, True, not n.isdigit()) if any(c.isdigit() for c in n) or len(n) < 3 else (False, False, False)
    if _ENDED.search(s):
        return False, False, False
    number, rest = None, s
    for p, cut in ((_NUMBER_FIRST, True), (_NUMBER_LAST, False)):
        if m := p.search(s):
            n = m.group(1)
            if any(c.isdigit() for c in n) or (len(n) < 3 and not cut):
                number, rest = n, (s[m.end() :] if cut else s[: m.start()])
                break
    key = re.sub(r"[\s·]+", "", rest)
    wrong = number is not None and not number.isdigit()
    if title:
        t = re.sub(r"[\s·]+", "", title)
        d = close(key, t)
        if d <= max(1, len(t) // 4):
            return True, number is not None, wrong or d > 0
    if _CHAPTER.match(rest) and len(rest) <= 40:
        prefix = re.match(r"^제\s?\d+\s?장", rest)
        name = rest[prefix.end() :] if prefix else rest
        odd = prefix is None or _SYMBOL_IN_WORD.search(name) or _ALIEN_IN_WORD.search(name) or _ALIEN_AFTER.search(name)
        return True, number is not None, wrong or bool(odd)
    return False, False, False


def visible_misread(line: str) -> bool:
    """A wrong character that shows without a lexicon."""
    return bool(
        _SYMBOL_IN_WORD.search(line) or _ALIEN_IN_WORD.search(line) or _ALIEN_BEFORE.search(line) or _ALIEN_AFTER.search(line) or _SYMBOL_IN_LATIN.search(line) or _NUMBER_WITH_LETTER.search(line)
    )


def junk_lines(lines: list[str]) -> list[bool]:
    """Lines in which there is nothing to read."""
    n = np.array(char_counts(lines))
    c = lambda name: n[:, COUNTS.index(name)]
    junk = (c("mojibake") > 0.3 * c("visible")) | (c("strokes") > 0.3 * c("visible")) | ((c("rare_hangul") > 0.3 * c("hangul")) & (c("hangul") > 5)) | ((c("letters") + c("digits") < 0.4 * c("visible")) & (c("visible") > 8))
    return (junk | ((c("symbols") > 0.1 * c("visible")) & (c("latin") > 0.4 * c("visible")) & (c("hangul") == 0) & (c("visible") > 8))).tolist()


def windows(word: str, most: int = LONGEST) -> list[tuple[int, str]]:
    """The word, or of a run longer than any word its overlapping parts, each with its start."""
    return [(0, word)] if len(word) <= most else [(i, word[i : i + most]) for i in range(0, len(word) - most // 2, most // 2)]


def read_lines(text: str, title: str | None, page: bool) -> tuple[list[tuple[int, str]], list[tuple[int, str, int]]]:
    """(line_no, noise) seen without a lexicon, and (line_no, word, cut) of the words to look up; text is canonical.

    A word broken across lines belongs to the line it begins in, which holds its first `cut` characters; 0 for other words.
    """
    lines = text.split("\n")
    junk = junk_lines(lines)
    if sum(len(x) for x, j in zip(lines, junk, strict=True) if j) > 0.9 * len(text):
        junk = [True] * len(lines)
    noise, words = [], []
    edge = edge_lines(lines) if page else []
    carried = ""  # the first part of a broken word
    for i, line in enumerate(lines):
        no = i + 1
        if i in edge:
            head, number, wrong = furniture(line, title)
            noise += [(no, k) for k, f in (("running_head", head), ("page_number", number), ("misread", wrong)) if f]
            if head or number:
                carried = ""
                continue
        if junk[i]:
            carried = ""
            continue
        if visible_misread(line):
            noise.append((no, "misread"))
            line = _ALIENS.sub("*", line)
        body = line.rstrip()
        broken = len(body) > 1 and body[-1] in HYPHENS and body[-2].isalpha() and i + 1 < len(lines) and lines[i + 1][:1].isalpha()
        if broken:
            noise.append((no, "broken_word"))
            body = body[:-1]
        found = [(m.start(), m.group()) for m in _HANGUL_WORD.finditer(carried + body)]
        for k, (at, w) in enumerate(found):
            if broken and k == len(found) - 1 and at + len(w) == len(carried + body):
                continue
            over = len(carried) if at == 0 else 0
            words += [(no - 1 if over > start else no, x, max(0, over - start)) for start, x in windows(w)]
        tail = re.search(r"[가-힣]+$|[A-Za-z]+$", carried + body) if broken else None
        carried = tail.group() if tail else ""
    return noise, words


def _mark_soft_hyphens(t: str) -> str:
    """Soft hyphens have no glyph and would vanish from the canonical form; at a line's end they are hyphens."""
    return re.sub(r"[­¬‐‑－][​-‍⁠﻿]*(?=[^\S\n]*\n)", "-", t) if ("­" in t or "¬" in t or "‐" in t or "－" in t) else t


def scanned(df: DataFrame, keys: list[str], text: str, title: str, page: str) -> DataFrame:
    """keys, noise (array of line_no, noise), words (array of line_no, word, cut), digest (of the canonical text) of every
    row's non-null text."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = len(keys)
        texts = canonical_lines(batch.column(k).to_pylist())
        out = [read_lines(t, title, page) for t, title, page in zip(texts, batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist(), strict=True)]
        arrays = []
        for part, names in ((0, ("line_no", "noise")), (1, ("line_no", "word", "cut"))):
            flat = [x for o in out for x in o[part]]
            items = pa.StructArray.from_arrays([pa.array([x[j] for x in flat], pa.string() if j == 1 else pa.int32()) for j in range(len(names))], names=names)
            arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(o[part]) for o in out])], pa.int32()), items))
        digests = [xxhash.xxh128_digest(" ".join(t.split())) for t in texts]
        return batch_of(**{c: batch.column(i) for i, c in enumerate(keys)}, noise=arrays[0], words=arrays[1], digest=(digests, pa.binary()))

    rows = df.select(*keys, F.col(text).alias("_t"), F.col(title).alias("_b"), F.col(page).alias("_p")).where(F.col("_t").isNotNull())
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "noise array<struct<line_no:int,noise:string>>, words array<struct<line_no:int,word:string,cut:int>>, digest binary"])
    return arrow_map(rows, run, schema)


def canonical_lines(texts: list[str]) -> list[str]:
    """Canonical texts whose lines are those of the stored text."""
    return canonical([_mark_soft_hyphens(t) for t in texts])


def one_of_each(items: DataFrame) -> DataFrame:
    """Of scanned items (materialised, numbered by _row) one for each text, with the number of its copies.

    Only the digests of texts that have copies are joined, so that words aren't shuffled for the others.
    """
    copied = materialised(items.groupBy("digest").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    return sized_join(items, copied, ["digest"], "left").where("_first IS NULL OR _row = _first").withColumn("copies", F.coalesce("copies", F.lit(1))).drop("_first")


def lexicon(items: DataFrame) -> DataFrame:
    """word, n, m of every word form: n counts each text once, however many copies or reprints it has.

    m counts a text up to RATIO times: what is printed over and over is surely a word, but the hottest text has no more
    weight than that. A word is as rare as its n, and a repair as frequent as its m.
    """
    words = one_of_each(items).select(F.explode("words.word").alias("word"), F.least("copies", F.lit(RATIO)).alias("c"))
    return materialised(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("m")))


def _stems(forms: DataFrame) -> DataFrame:
    ending = f"(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))})$"
    stem = F.regexp_replace("word", ending, "")
    return forms.where(stem != F.col("word")).select(stem.alias("word"), "n", "m").where(F.length("word") >= 2).groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _cuts(df: DataFrame, word: str = "word") -> DataFrame:
    """Every cut of a word into a left part of two or more characters and a right part."""
    inner = df.where(F.length(word) >= 3).withColumn("_i", F.explode(F.expr(f"sequence(2, length({word}) - 1)")))
    return inner.withColumn("left_part", F.expr(f"substring({word}, 1, _i)")).withColumn("right_part", F.expr(f"substring({word}, _i + 1)")).drop("_i")


def _wild(column: str):
    """Keys of a word with each of its characters left out in turn, the place kept."""
    return F.expr(f"transform(sequence(1, length({column})), i -> concat(substring({column}, 1, i - 1), '*', substring({column}, i + 1)))")


def confusion(a: str, b: str, at: str):
    """The one letter in which the syllables at a place of two words of Hangul differ (kind * 10000 + b's * 100 + a's); else null."""
    x, y = (F.expr(f"ascii(substring({w}, {at}, 1)) - 44032") for w in (a, b))
    letters = [(F.floor(v / 588), F.floor(v % 588 / 28), v % 28) for v in (x, y)]
    same = [p == q for p, q in zip(*letters, strict=True)]
    of = [F.lit(k * 10000) + q * 100 + p for k, (p, q) in enumerate(zip(*letters, strict=True))]
    hangul = x.between(0, 11171) & y.between(0, 11171)
    return F.when(hangul & ~same[0] & same[1] & same[2], of[0]).when(hangul & same[0] & ~same[1] & same[2], of[1]).when(hangul & same[0] & same[1] & ~same[2], of[2])


def _apart(parts: DataFrame, index: DataFrame) -> DataFrame:
    """parts (x, key) with entries v, m of the index that have the same place left out; `swap` is their one different letter."""
    pairs = parts.join(index, "key").where(F.col("x") != F.col("v")).withColumn("at", F.instr("key", "*"))
    return pairs.withColumn("swap", F.when(~F.col("x").contains("*"), confusion("x", "v", "at")))


def usual(pairs: DataFrame) -> list[int]:
    """The usual confusions, from pairs (x, v, swap) of long words, each counted once; there are some 1,500 kinds at most."""
    counts = pairs.where((F.length("x") >= LONG) & F.col("swap").isNotNull()).select("x", "v", "swap").distinct().groupBy("swap").count().collect()
    of, right, wrong, total = {r.swap: r["count"] for r in counts}, Counter(), Counter(), Counter()
    for s, n in of.items():
        right[s // 100] += n
        wrong[s // 10_000, s % 100] += n
        total[s // 10_000] += n
    out = []
    for kind, letters in enumerate((19, 21, 28)):
        for r, w in itertools.permutations(range(letters), 2):
            s = kind * 10_000 + r * 100 + w
            become = (wrong[kind, w] + PRIOR[1]) / (total[kind] + PRIOR[1])
            if (of.get(s, 0) + PRIOR[0] * become) / (right[s // 100] + PRIOR[0]) >= USUAL:
                out.append(s)
    return out


def repairs(forms: DataFrame) -> DataFrame:
    """word, repair, m, n: words that the lexicon doesn't explain, with entries one letter away.

    A repair must be RATIO times as frequent as the word and as the part it replaces, however frequent these are.
    """
    forms = forms if "m" in forms.columns else forms.withColumn("m", F.col("n"))
    hangul = forms.where(F.col("word").rlike("^[가-힣]+$"))
    e = hangul.select("word", "n", "m")
    frequent = e.where(F.col("n") >= RATIO)
    stems = _stems(e).where(F.col("m") >= EXPLAINS)
    # beginnings of compounds: what stands before a frequent form
    starts = _cuts(e).join(frequent.select(F.col("word").alias("right_part")).where(F.length("right_part") >= 2), "right_part", "left_semi")
    starts = starts.groupBy(F.col("left_part").alias("word")).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("m") >= EXPLAINS)
    known = materialised(e.where(F.col("m") >= EXPLAINS).unionByName(stems).unionByName(starts).groupBy("word").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("n").alias("total")))
    index = materialised(known.where((F.col("m") >= RATIO) & (F.length("word") >= 2)).select(F.col("word").alias("v"), "m").withColumn("key", F.explode(_wild("v"))))
    ending = f"^(?:{'|'.join(PARTICLES)})$"
    last = F.expr("at = length(x)") & F.expr("substring(x, length(x), 1)").isin(*(p for p in PARTICLES if len(p) == 1))
    # what the scanner takes for what shows in long words; a known stem that it makes out of a far more frequent one is doubtful
    seen = e.select("word", F.col("n").alias("total")).unionByName(known.select("word", "total")).where(F.length("word") >= 2).groupBy("word").agg(F.max("total").alias("total"))
    again = _apart(seen.select(F.col("word").alias("x"), "total").withColumn("key", F.explode(_wild("x"))), index)
    again = materialised(again.where((F.col("m") >= RATIO * F.col("total")) & ~last).select("x", "v", "swap"))
    is_usual = F.col("swap").isin(usual(again))
    doubtful = materialised(again.where(F.col("swap").isNotNull() & is_usual).select(F.col("x").alias("word")).distinct())
    known = materialised(known.join(doubtful, "word", "left_anti"))
    size = known.count()
    # explained: a stem with a particle, or two known parts, each far more frequent than the word
    left, right = (known.select(F.col("word").alias(p), F.col("n").alias(f"{p}_n")) for p in ("left_part", "right_part"))
    cuts = sized_join(sized_join(_cuts(e), left, ["left_part"], "left", size), right, ["right_part"], "left", size)
    cuts = materialised(cuts)
    left_known = F.coalesce(F.col("left_part_n") >= EXPLAINS * F.col("n"), F.lit(False))
    right_known = F.coalesce((F.col("right_part_n") >= EXPLAINS * F.col("n")) & (F.length("right_part") >= 2), F.lit(False))
    explained = cuts.where(left_known & (right_known | F.col("right_part").rlike(ending))).select("word").distinct()
    odd = materialised(e.join(explained, "word", "left_anti"))
    cuts = cuts.join(odd.select("word"), "word", "left_semi")
    parts = odd.select("word", "n", F.lit("").alias("before"), F.col("word").alias("x"), F.lit("").alias("after"))
    parts = parts.unionByName(cuts.where(left_known & (F.length("right_part") >= 2)).select("word", "n", F.col("left_part").alias("before"), F.col("right_part").alias("x"), F.lit("").alias("after")))
    parts = parts.unionByName(cuts.where(right_known | F.col("right_part").rlike(ending)).select("word", "n", F.lit("").alias("before"), F.col("left_part").alias("x"), F.col("right_part").alias("after")))
    # a part, or its stem, has its own weight in the corpus, by which its repair must outweigh it
    total = known.select(F.col("word").alias("x"), F.col("total").alias("x_n"))
    parts = sized_join(parts.withColumn("stem", F.regexp_replace("x", f"(?<=..){ending[1:]}", "")), total, ["x"], "left", size)
    parts = sized_join(parts, total.select(F.col("x").alias("stem"), F.col("x_n").alias("stem_n")), ["stem"], "left", size)
    parts = parts.select("word", "n", "before", "x", "after", F.greatest("n", "x_n", "stem_n").alias("own")).withColumn("key", F.explode(_wild("x")))
    # damaged words of which the wrong place shows already stand for their own key
    starred = forms.where(F.col("word").rlike("^[가-힣]*[*][가-힣]*$") & (F.length("word") >= 2))
    star_cuts = sized_join(sized_join(_cuts(starred), left, ["left_part"], "left", size), right, ["right_part"], "left", size)
    from_left = star_cuts.where(F.col("right_part").contains("*") & F.col("left_part_n").isNotNull() & (F.length("right_part") >= 2))
    from_right = star_cuts.where(F.col("left_part").contains("*") & (F.col("right_part_n").isNotNull() | F.col("right_part").rlike(ending)))
    parts = parts.unionByName(starred.select("word", "n", F.lit("").alias("before"), F.col("word").alias("x"), F.lit("").alias("after"), F.col("n").alias("own"), F.col("word").alias("key")))
    parts = parts.unionByName(from_left.select("word", "n", F.col("left_part").alias("before"), F.col("right_part").alias("x"), F.lit("").alias("after"), F.col("n").alias("own"), F.col("right_part").alias("key")))
    parts = parts.unionByName(from_right.select("word", "n", F.lit("").alias("before"), F.col("left_part").alias("x"), F.col("right_part").alias("after"), F.col("n").alias("own"), F.col("left_part").alias("key")))
    pairs = _apart(parts, index).where(F.col("x").contains("*") | (F.col("swap").isNotNull() & (F.col("m") >= RATIO * F.col("own"))))
    pairs = pairs.where(F.col("x").contains("*") | is_usual | (F.length("word") > LONG))
    # a last syllable that is a particle on both sides is inflection, not damage
    hangul_pairs = pairs.where(F.col("x").contains("*") | ~(last & (F.col("after") == ""))).select("word", "n", F.concat("before", "v", "after").alias("repair"), "m")
    latin = forms.where(F.col("word").rlike("^[A-Za-z]+$")).select(F.lower("word").alias("word"), "n", "m").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    swap = "transform(filter(sequence(1, length(word)), i -> substring(word, i, {n}) = '{a}'), i -> concat(substring(word, 1, i - 1), '{b}', substring(word, i + {n})))"
    swaps = [F.expr(swap.format(a=a, b=b, n=len(a))) for a, b in LATIN_CONFUSIONS] + [F.array(F.regexp_replace("word", a, b)) for a, b in LATIN_CONFUSIONS]
    tried = latin.drop("m").withColumn("repair", F.explode(F.array_distinct(F.concat(*swaps)))).where(F.col("repair") != F.col("word"))
    latin_pairs = tried.join(latin.select(F.col("word").alias("repair"), "m"), "repair").where((F.col("m") >= RATIO * F.col("n")) & (F.col("m") >= RATIO)).select("word", "n", "repair", "m")
    return materialised(hangul_pairs.unionByName(latin_pairs).groupBy("word", "repair").agg(F.max("m").alias("m"), F.max("n").alias("n")))


def chosen(found: DataFrame, words: DataFrame) -> DataFrame:
    """word, before, after, repair: for each context of a damaged word the repair that bigrams of the corpus speak for."""
    count = found.select("word").distinct().count()
    places = sized_join(words, found.select("word").distinct(), ["word"], "left_semi", count)
    contexts = places.select("word", "before", "after").distinct().join(found, "word")
    wanted = contexts.select(F.col("before").alias("a"), F.col("repair").alias("b")).unionByName(contexts.select(F.col("repair").alias("a"), F.col("after").alias("b"))).distinct()
    wanted = materialised(wanted)
    grams = sized_join(words.select(F.col("before").alias("a"), F.col("word").alias("b")), wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    grams = materialised(grams)
    n = grams.count()
    one = sized_join(contexts, grams.select(F.col("a").alias("before"), F.col("b").alias("repair"), F.col("c").alias("c1")), ["before", "repair"], "left", n)
    two = sized_join(one, grams.select(F.col("a").alias("repair"), F.col("b").alias("after"), F.col("c").alias("c2")), ["repair", "after"], "left", n)
    score = F.struct(F.coalesce("c1", F.lit(0)) + F.coalesce("c2", F.lit(0)), "m", "repair")
    return two.groupBy("word", "before", "after").agg(F.max_by("repair", score).alias("repair"))


def with_context(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, word, before, after: every word with its neighbours in the text."""
    pairs = F.expr("transform(words, (x, i) -> struct(x.line_no AS line_no, x.word AS word, coalesce(get(words, i - 1).word, '') AS before, coalesce(get(words, i + 1).word, '') AS after))")
    return items.select(*keys, F.explode(pairs).alias("w")).select(*keys, "w.line_no", "w.word", "w.before", "w.after")


def noise(df: DataFrame, keys: list[str], text: str, title: str, page: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, line_no, noise), (word, repair, m, n) and the scanned items of all texts.

    Null texts give nothing; rows that share their keys are copies, the case of one is listed once. Words are counted by
    distinct texts and found in all copies.
    """
    items = materialised(scanned(df, keys, text, title, page).withColumn("_row", F.monotonically_increasing_id()))
    plain = items.select(*keys, F.explode("noise").alias("x")).select(*keys, "x.line_no", "x.noise")
    found = repairs(lexicon(items))
    # the place of the wrong character tells which line of a broken word has it
    place = "filter(sequence(1, length(word)), i -> substring(word, i, 1) <> substring(repair, i, 1))"
    places = materialised(found.groupBy("word").agg(F.max_by("repair", F.struct("m", "repair")).alias("repair")).select("word", F.coalesce(F.expr(f"get({place}, 0)"), F.lit(1)).alias("at")))
    flat = items.select(*keys, F.explode("words").alias("w")).select(*keys, "w.line_no", "w.word", "w.cut")
    lower = F.when(F.col("word").rlike("^[A-Za-z]"), F.lower("word")).otherwise(F.col("word"))
    wrong = sized_join(flat.withColumn("word", lower), places, ["word"])
    line = F.when((F.col("cut") > 0) & (F.col("at") > F.col("cut")), F.col("line_no") + 1).otherwise(F.col("line_no"))
    wrong = wrong.select(*keys, line.alias("line_no"), F.lit("misread").alias("noise"))
    return plain.unionByName(wrong).distinct(), found, items


def paragraphs_of(text: str, title: str | None, page: bool, noise_lines: dict[int, set[str]], repaired: dict[tuple[int, str], str]) -> str:
    """The repaired text: no furniture, broken words joined, damaged words replaced, lines flowed into paragraphs."""
    out: list[str] = []
    lines = text.split("\n")
    junk = junk_lines(lines)
    pending = ""
    previous_open = False
    for i, line in enumerate(lines):
        kinds = noise_lines.get(i + 1, set())
        if kinds & {"running_head", "page_number"}:
            continue
        if not line.strip():
            previous_open = False
            continue
        body = line.rstrip()
        broken = "broken_word" in kinds
        if broken:
            body = body[:-1]
        whole = pending + body
        no = i if pending else i + 1
        if not junk[i]:
            starred = _ALIENS.sub("*", whole)

            def swap(m: re.Match, no: int = no, i: int = i, whole: str = whole) -> str:
                w = m.group()
                r = repaired.get((i + 1, w)) or repaired.get((no, w))
                return r if r else whole[m.start() : m.end()]

            whole = _HANGUL_WORD.sub(swap, starred) if any(k[0] in (i + 1, no) for k in repaired) else whole
            whole = "".join(whole[k] if c == "*" and len(whole) == len(starred) and k < len(whole) else c for k, c in enumerate(whole))
        if broken:
            head, _, pending = whole.rpartition(" ")
        else:
            head, pending = whole, ""
        if head:
            if previous_open and out and "\t" not in head:
                out[-1] += " " + head.strip()
            else:
                out.append(head.strip())
        previous_open = broken or not (_ENDED.search(whole) or "\t" in whole or junk[i] or len(whole) < 12)
    if pending:
        out.append(pending)
    return "\n\n".join(out)


def repaired_texts(df: DataFrame, keys: list[str], text: str, title: str, page: str) -> DataFrame:
    """keys and `repaired`: continuous paragraphs of every distinct keys' non-null text.

    Where several repairs fit a damaged word, the bigrams with the words beside it and then frequency decide.
    """
    lines, found, items = noise(df, keys, text, title, page)
    context = with_context(items, keys)
    lower = F.when(F.col("word").rlike("^[A-Za-z]"), F.lower("word")).otherwise(F.col("word"))
    context = context.withColumn("shown", F.col("word")).withColumn("word", lower)
    # bigrams are looked up only for words that have several repairs
    sole = materialised(found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("repair").alias("repair")).where("n = 1").select("word", "repair"))
    several = materialised(found.join(sole.select("word"), "word", "left_anti"))
    best = materialised(chosen(several, context))
    swaps = sized_join(context, sole, ["word"]).unionByName(sized_join(context, best, ["word", "before", "after"]))
    swaps = swaps.groupBy(*keys).agg(F.collect_list(F.struct("line_no", "shown", "repair")).alias("swaps"))
    marks = lines.groupBy(*keys).agg(F.collect_list(F.struct("line_no", "noise")).alias("marks"))
    first = df.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.col(text).alias("t"), F.col(title).alias("b"), F.col(page).alias("p"))).alias("x"))
    rows = first.join(marks, keys, "left").join(swaps, keys, "left").select(*keys, "x.t", "x.b", "x.p", "marks", "swaps")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = len(keys)
        texts, titles, pages, marked, swapped = (batch.column(k + j).to_pylist() for j in range(5))
        out = []
        for t, b, p, m, s in zip(canonical_lines(texts), titles, pages, marked, swapped, strict=True):
            at: dict[int, set[str]] = {}
            for x in m or []:
                at.setdefault(x["line_no"], set()).add(x["noise"])
            out.append(paragraphs_of(t, b, p, at, {(x["line_no"], x["shown"]): x["repair"] for x in s or []}))
        return batch_of(**{c: batch.column(i) for i, c in enumerate(keys)}, repaired=(out, pa.string()))

    return arrow_map(rows, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "repaired string"]))
