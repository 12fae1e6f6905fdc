"""Problem 5: sentence boundaries in all languages and scripts.

The character-property rules of sentence breaking (Unicode Annex 29: ATerm, STerm, Close, Sp, Lower) decide; on top of
them stand abbreviation suppression for each language, quotation closing, and sentences that lack their end mark.
Lines that are list entries, table rows or junk give no sentence.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.quality import junk_texts, line_counts
from gyeol.llm.textio import arrow_map, batch_of
from gyeol.llm.visual import LOOK_ALIKE

#: Abbreviations whose full stop doesn't end a sentence before more text.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st jr sr vs cf e.g i.e eg ie al no nos vol vols pp p ed eds ch chs sec secs fig figs ca approx op cit ibid trans rev gen col capt lt sgt rep sen hon mt dept univ inc ltd co corp "
    "jan feb mar apr jun jul aug sep sept oct nov dec z.b d.h u.a bzw usw nr bd s.o vgl m mme mlle art av".split()
)
#: Those that often stand at the very end, so that a capital after them opens a sentence.
_OPEN_ENDED = frozenset("a.m p.m etc u.s u.k al inc ltd co corp".split())
#: Words that go on after a quotation in Korean.
_AFTER_QUOTE = re.compile(r"\s*(?:이?라(?:고|는|며|면서|던)|하(?:고|는|며|면서|였|던)|고(?:\s|는)|며\s|등|와|과|이|가|은|는|을|를|의|에|로|도|란|처럼)")
_PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "(": ")", "[": "]", "《": "》", "〈": "〉", "（": "）", "［": "］", "«": "»", "【": "】", "〔": "〕"}
_CLOSERS = {c: o for o, c in _PAIRS.items()}
_BRACKET = re.compile("[" + re.escape("".join({**_PAIRS, **_CLOSERS}) + '"') + "]")
_TERM = regex.compile(r"[\p{SB=ATerm}\p{SB=STerm}…]+")
_CLOSE = regex.compile(r"[\p{SB=Close}--\p{Ps}--[“‘「『«]]*", flags=regex.V1)
_FULL = frozenset("。！？｡")
_NORMAL = str.maketrans({**{chr(o): chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F) if chr(o) not in "！？，：；（）"}, **LOOK_ALIKE, "：": ":", "（": "(", "）": ")", "，": ",", "；": ";"})
_UNSTABLE = re.compile(r"[ᄀ-ᇿ­​-‏⁠﻿]")
_CLUSTER = re.compile(r"([ᄀ-ᅟ][ᅠ-ᆧ]?[ᆨ-ᇿ]?|[^­​-‏⁠﻿])|([­​-‏⁠﻿])", re.S)
_ENUMERATOR = re.compile(r"[\s(\[（]*(?:\d{1,3}|[가-하ㄱ-ㅎa-zA-Z]|[①-⑳㉠-㉻Ⅰ-ⅻ]|[ivxIVX]{1,4})?[\s)\]）]*$")
_NUMBERS_ONLY = re.compile(r"[\s\d.()\-–/]*$")
_DATE = re.compile(r"(?<!\d)(?:1[5-9]|20)\d\d\.\s?(?:\d{1,2}\.\s?)?\d{1,2}$")
_LAST_WORD = re.compile(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.]*$")
#: The syllable before a final 다 shows a predicate by its coda (ㄴ ㅆ ㅂ ㄶ ㅄ ㅀ ㄹ) or is 이, 하, 르.
_CODAS = {4, 20, 17, 6, 18, 15}
_MISSING_MARK = re.compile(r"([가-힣])(다)\s+(?=[“‘「『(]?[가-힣A-Z0-9①-⑳])")
_KOREAN_END = re.compile(r"(?:다|까|라|오|요|자|네|나|지|구나|가|냐|니)$")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿“\"'(])")
_LETTER = re.compile(r"[^\W\d_]")


def is_predicate(before: str) -> bool:
    """Whether a word of `before` and 다 can close a sentence."""
    return before in "이하르" or (ord(before) - 0xAC00) % 28 in _CODAS


def spans(line: str) -> list[tuple[int, int]]:
    """Outermost pairs of quotes and brackets, (opening, closing); marks without a partner count for nothing."""
    found, stack, straight = [], [], -1
    for m in _BRACKET.finditer(line):
        c, i = m.group(), m.start()
        if c == '"':
            if straight < 0:
                straight = i
            else:
                found.append((straight, i))
                straight = -1
        elif c in _PAIRS:
            stack.append((c, i))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == _CLOSERS[c]:
                    found.append((stack[k][1], i))
                    del stack[k:]
                    break
    outer, end = [], -1
    for a, b in sorted(found):
        if a > end:
            outer.append((a, b))
            end = b
    return outer


def goes_on(line: str, start: int, opening: int, after: int) -> bool:
    """Whether the sentence goes on after a quotation or bracket that closes before `after` on an end mark."""
    rest = line[after:]
    if not rest.strip():
        return False
    following = rest.lstrip()[0]
    if rest[0].isspace():
        if _AFTER_QUOTE.match(rest) or following.islower() or following in ",;:)—–-":
            return True
        if not line[start:opening].strip():
            return False
        return not following.isupper()
    return True


def full_stop_ends(line: str, start: int, at: int, after: int) -> bool:
    """Whether the single full stop at `at`, closers up to `after`, ends the sentence begun at `start`."""
    rest = line[after:]
    nothing_after = not rest.strip()
    before = line[start:at]
    last, following = before[-1:], rest[:1]
    if last.isdigit() and following.isdigit():
        return False
    if _ENUMERATOR.match(before) and not nothing_after:
        return False
    if nothing_after:
        return True
    if _NUMBERS_ONLY.match(before):
        return False
    upcoming = rest.lstrip()[0]
    if last.isdigit() and (upcoming.isdigit() and following.isspace() and re.search(r"(?:1[5-9]|20)\d\d\.?$|\d\.\s?\d{1,2}$", before) or _DATE.search(before)):
        return False
    word = _LAST_WORD.search(before)
    if word:
        w = word.group().lower()
        if len(w) == 1 and word.group().isupper():
            return False
        if w in ABBREVIATIONS or w in _OPEN_ENDED:
            if w not in _OPEN_ENDED or not (following.isspace() and upcoming.isupper()):
                return False
    if not following.isspace():
        return "가" <= last <= "힣" and _KOREAN_END.search(before[-2:]) is not None and ("가" <= following <= "힣" or following in "“‘「『")
    return not upcoming.islower()


def line_sentences(line: str) -> list[int]:
    """Ends of the sentences of one line of normalised characters."""
    pairs = spans(line) if _BRACKET.search(line) else []
    ends, start, p = [], 0, 0
    for m in _TERM.finditer(line):
        at, run = m.start(), m.group()
        if at < start:
            continue
        while p < len(pairs) and pairs[p][1] < at:
            p += 1
        if p < len(pairs) and pairs[p][0] < at:
            opening, closing = pairs[p]
            if line[m.end() : closing].strip("”’」』)]\"'》〉 ") or goes_on(line, start, opening, closing + 1):
                continue
            after = closing + 1
            if line[closing] in ")]）" and line[start:opening].strip():
                continue
        else:
            after = _CLOSE.match(line, m.end()).end()
            while after > m.end() and line[after - 1] in _PAIRS:
                after -= 1
            if set(run) & _FULL:
                pass
            elif set(run) <= {"…"} or (set(run) <= {".", "…"} and len(run) > 2):
                before = line[start:at]
                if line[after:].strip() and not (before[-1:] == "다" and len(before) > 1 and is_predicate(before[-2])):
                    continue
            elif run == ".":
                if not full_stop_ends(line, start, at, after):
                    continue
            else:
                rest = line[after:]
                if rest.strip() and ((not rest[0].isspace() and _AFTER_QUOTE.match(rest)) or rest.lstrip()[0].islower() or (rest[0] in ",;")):
                    continue
        ends.append(after)
        start = after
    if line[start:].strip():
        ends.append(len(line.rstrip()))
    return ends


def without_mark(line: str, a: int, b: int, pairs: list[tuple[int, int]]) -> list[int]:
    """Ends inside line[a:b] of sentences that lack their end mark."""
    out = []
    for m in _MISSING_MARK.finditer(line, a, b):
        i = m.end(2)
        if is_predicate(m.group(1)) and not any(x < i <= y for x, y in pairs):
            out.append(i)
    return out


def is_sentence(s: str) -> bool:
    """Whether a stretch of running text is a sentence: it closes on an end mark or on a predicate, or is foreign prose."""
    s = s.strip()
    if not _LETTER.search(s):
        return False
    tail = s.rstrip("”’」』)]\"'》〉 ")
    if tail[-1:] in ".!?。！？…" or s[-1:] in ".!?。！？…":
        return len(_LETTER.findall(s)) > 1
    if re.search("[가-힣]", s):
        return tail[-1:] == "다" or (len(s.split()) > 2 and _KOREAN_END.search(tail) is not None and tail[-1:] not in "자지나가니라오")
    if re.search("[฀-๿]{4}", s):
        return True
    return len(s.split()) > 3 and not re.search(r"\d$|\t", s)


def text_sentences(text: str) -> list[int]:
    """end_pos of each sentence of one text that isn't junk, in code points of the stored text."""
    place = None
    flat = text
    if _UNSTABLE.search(text):
        chars, place = [], []
        for m in _CLUSTER.finditer(text):
            if m.group(1) is not None:
                c = m.group(1)
                if len(c) > 1:
                    v = (ord(c[0]) - 0x1100) * 21 + (ord(c[1]) - 0x1161)
                    c = chr(0xAC00 + v * 28 + (ord(c[2]) - 0x11A7 if len(c) > 2 else 0)) if 0 <= v < 399 else c[0]
                chars.append(c)
                place.append(m.end())
        flat = "".join(chars)
    flat = flat.translate(_NORMAL)
    out, base = [], 0
    for line in flat.split("\n"):
        if line.strip():
            n = line_counts(line)
            if not n[2] and not n[3]:
                pairs = spans(line)
                a = 0
                for b in line_sentences(line):
                    cuts = without_mark(line, a, b, pairs)
                    if "฀" <= max(line[a:b], default=" ") <= "๿" or re.search("[฀-๿]", line[a:b]):
                        cuts = sorted({*cuts, *(m.start() for m in _THAI_GAP.finditer(line, a, b))})
                    for e in [*cuts, b]:
                        if is_sentence(line[a:e]):
                            e2 = a + len(line[a:e].rstrip())
                            out.append(base + e2)
                        a = e
        base += len(line) + 1
    return [place[e - 1] for e in out] if place else out


def sentences(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, sentence_no, start_pos, end_pos, sentence: one row for each sentence, in order.

    Null, empty and blank texts, junk, list entries and table rows give no row; repeated rows repeat their sentences.
    """
    df = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "sentence_no int, start_pos int, end_pos int, sentence string"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(keys)).to_pylist()
        junk = junk_texts(texts)
        rows, number, begin, end, piece = [], [], [], [], []
        for i, t in enumerate(texts):
            if junk[i]:
                continue
            last = 0
            for n, e in enumerate(text_sentences(t)):
                s = t[last:e]
                rows.append(i), number.append(n), begin.append(e - len(s.lstrip())), end.append(e), piece.append(s.lstrip())
                last = e
        return batch_of(
            **{k: batch.column(j).take(pa.array(rows, pa.int64())) for j, k in enumerate(keys)}, sentence_no=(number, pa.int32()), start_pos=(begin, pa.int32()), end_pos=(end, pa.int32()), sentence=(piece, pa.string())
        )

    return arrow_map(df, run, schema)
