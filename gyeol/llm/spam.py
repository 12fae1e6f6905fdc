"""Problem 10: keyword-stuffed pages, link lists and product tags.

Corpus counts of neighbouring words give the pointwise mutual information of each pair; its mean over a page falls
below that of running text where the page is word salad. A pair speaks for stuffing where the page repeats it, or both
of its words, or the separator or link in it, far more than the rest of the corpus does. The characters of
a page's lines are shared out among their pairs, lines of sentences, records, index entries and drills left aside, and a page
is reported if the pairs that speak for stuffing hold most of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.textio import arrow_map, batch_of, materialised, sized_join
from gyeol.llm.visual import canonical

#: A word longer than this is text without spaces; its neighbouring pairs of characters count as words.
LONG_WORD = 14
#: Below this normalised mean mutual information a page is word salad.
LOW = 0.12
#: Times that a page must say a pair or a word before it can be repeated too often, and how many times as often as the
#: rest of the corpus, by the share of its words.
AT_LEAST, PAIR_EXCESS, WORD_EXCESS = 3, 5, 8
#: Share of the characters from which a page is stuffed: a line of repeated words has pairs between the repetitions too.
STUFFED = 0.45

_WORD = re.compile(r"https?://\S+|www\.\S+|\w+|[#>»|·/★]")
_URL = re.compile(r"(?:https?://|www\.)\S+|\b[a-z0-9-]+\.(?:com|net|org|info|biz|kr|io|test|example|invalid|shop|site)\b(?:/\S*)?", re.I)
_TAG = re.compile(r"(?:^|\s)#\w[\w]*")
_RECORD = re.compile(r"[(（](?:1[5-9]|20)\d\d[)）]|[『《〈]")
_SENTENCE = re.compile(r"(?:다|까|라|요|오|네|나|자)[.!?…]|[a-z]{2,}[.!?](?:\s|$)|[。！？]")
_INDEX = re.compile(r"^\D+[\s.…·]\d{1,4}(?:\s?[,、~-]\s?\d{1,4})*$")
_MARKUP = re.compile(r"<[^<>\n]{1,200}>")
_SEPARATORS = frozenset("#>»|·/★")
#: English words that running text can't do without (but for a, which stands in product codes too).
_FUNCTION = frozenset("the of and to in is that it for on with as by an this at from or be are not".split())


NUMBER, URL = "<number>", "<url>"


def plain(texts: list[str]) -> list[str]:
    """Texts without markup and entities, in one consistent form, in lower case."""
    return [t.lower() for t in canonical([_MARKUP.sub(" ", html.unescape(t)) if "<" in t or "&" in t else t for t in texts])]


def _named(token: str) -> tuple[str, ...]:
    if token[0] in "hw" and _URL.match(token):
        return (URL,)
    if token.isdigit():
        return (NUMBER,)
    return tuple(token[i : i + 2] for i in range(len(token) - 1)) if len(token) > LONG_WORD else (token,)


def words_of(text: str, seen: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Words of a line; `seen` keeps what tokens stand for."""
    seen = {} if seen is None else seen
    out: list[str] = []
    for token in _WORD.findall(text):
        if token not in seen:
            seen[token] = _named(token)
        out += seen[token]
    return out




def hashed(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


#: Marks that hold lists together: too many of them speak for stuffing by themselves. Numbers never do.
_MARKS = [hashed(w) for w in (*sorted(_SEPARATORS), URL)]


def set_aside(line: str, words: list[str]) -> bool:
    """Whether a line of plain text is a sentence, a record, an index entry or a drill, which may repeat what they like."""
    named = [w for w in words if w not in _SEPARATORS]
    if not named:
        return True
    urls = named.count(URL)
    if _SENTENCE.search(line.replace("!", " ").replace("?", " ")) and not (urls and len(_URL.sub("", line).strip()) <= 12 + 14 * urls):
        return True
    if _RECORD.search(line) or _INDEX.match(line) or _FUNCTION.intersection(named):
        return True
    first = Counter(w[0] for w in named).most_common(1)[0][1]
    return len(named) >= 3 and first >= 0.7 * len(named) and ("," in line or ":" in line)


def weighed_pairs(texts: list[str]) -> tuple[list[int], list[int], list[int], dict[str, np.ndarray]]:
    """Visible characters, words, and number of different pairs of each plain text, and columns of all pairs, text by text.

    Of a pair of neighbouring words: its hash, those of its words (a, b), how often it occurs (n), how often its words
    stand first (na) and second (nb), 0 below AT_LEAST and for numbers, and the characters that it stands for (weight). A line's characters are
    shared out among its pairs; the one word of a line stands for a pair with itself that doesn't occur.
    """
    index: dict[str, int] = {}
    seen: dict[str, tuple[str, ...]] = {}
    words, per_line, per_text, sizes, aside, visible = [], [], [], [], [], []
    for text in texts:
        before = len(words)
        shown = 0
        for line in text.split("\n"):
            size = sum(map(len, line.split()))
            if not size:
                continue
            shown += size
            here = words_of(line, seen)
            if here:
                words += [index.setdefault(w, len(index)) for w in here]
                per_line.append(len(here)), sizes.append(size), aside.append(set_aside(line, here))
        total = len(words) - before
        visible.append(shown), per_text.append(total)
    w, lengths = np.array(words, dtype=np.int64), np.array(per_line, dtype=np.int64)
    line, text_of = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(len(texts)), per_text)
    open_, size = ~np.array(aside, dtype=bool), np.array(sizes, dtype=np.float64)
    i = np.flatnonzero(text_of[1:] == text_of[:-1])
    inside = (line[i] == line[i + 1]) & open_[line[i]]
    weight = np.where(inside, size[line[i]] / np.maximum(lengths[line[i]] - 1, 1), 0.0)
    alone = np.flatnonzero((lengths[line] == 1) & open_[line]) if len(w) else i
    # entries: every occurrence of a pair, and the lone words
    doc = np.r_[text_of[i], text_of[alone]]
    a, b = np.r_[w[i], w[alone]], np.r_[w[i + 1], w[alone]]
    n, weight = np.r_[np.ones(len(i)), np.zeros(len(alone))], np.r_[weight, size[line[alone]]]
    v = max(1, len(index))
    key, inverse = np.unique((doc * v + a) * v + b, return_inverse=True)
    n, weight = np.bincount(inverse, n, len(key)), np.bincount(inverse, weight, len(key))
    doc, a, b = key // (v * v), key // v % v, key % v

    def times(side: np.ndarray) -> np.ndarray:
        _, at = np.unique(doc * v + side, return_inverse=True)
        c = np.bincount(at, n)[at] if len(at) else n
        return np.where((c < AT_LEAST) | (side == index.get(NUMBER, -1)), 0, c)

    hashes = np.array([hashed(x) for x in index] or [0], dtype=np.int64)
    marks = np.isin(hashes, _MARKS)
    with np.errstate(over="ignore"):
        pair = hashes[a] * np.int64(-7046029254386353131) + (hashes[b] ^ (hashes[b] >> 29))
    columns = {"pair": pair, "a": hashes[a], "b": hashes[b], "n": n.astype(np.int32), "na": times(a).astype(np.int32), "nb": times(b).astype(np.int32), "weight": weight.astype(np.float32), "ma": marks[a], "mb": marks[b]}
    return visible, per_text, np.bincount(doc, minlength=len(texts)).tolist(), columns


def _pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, visible, words, pairs (see weighed_pairs; ma and mb say whether a word is a mark)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        visible, count, size, columns = weighed_pairs(plain(batch.column(1).to_pylist()))
        items = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
        pairs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), items)
        return batch_of(**{key: batch.column(0)}, visible=(visible, pa.int64()), words=(count, pa.int64()), pairs=pairs)

    rows = df.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    return arrow_map(rows, run, f"`{key}` {kind}, visible bigint, words bigint, pairs array<struct<pair:bigint,a:bigint,b:bigint,n:int,na:int,nb:int,weight:float,ma:boolean,mb:boolean>>")


def pair_information(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(pair, c, ca, cb, npmi) of every pair of the corpus, from counts over all documents, and the number of all pairs."""
    counts = materialised(pairs.groupBy("pair").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.sum("n").alias("c")))
    total = counts.agg(F.sum("c")).first()[0] or 1
    sides = [materialised(counts.groupBy(w).agg(F.sum("c").alias(f"c{w}"))) for w in ("a", "b")]
    for w, side in zip(("a", "b"), sides, strict=True):
        counts = sized_join(counts, side, [w])
    p = F.col("c") / total
    pmi = F.log(F.col("c") * F.lit(float(total)) / (F.col("ca") * F.col("cb").cast("double")))
    npmi = F.when(F.col("c") <= 0, None).when(p >= 1, 1.0).otherwise(pmi / -F.log(p))
    return counts.select("pair", "c", "ca", "cb", npmi.cast("float").alias("npmi")), total


def coherence(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, words, npmi (mean over the neighbouring pairs), repeated_pairs (share of pairs that say an earlier one
    again), stuffing (share of the visible characters that pairs repeated in excess stand for), suspicious.

    Null texts give no row; texts of fewer than two words have a null npmi, those without anything to see no stuffing, and
    neither is suspicious. Each row counts as a document; repeated keys give repeated rows.
    """
    docs = materialised(_pairs(df, key, text).withColumn("_row", F.monotonically_increasing_id()))
    exploded = docs.select("_row", F.explode("pairs").alias("p"), F.greatest(F.col("words") - 1, F.lit(1)).cast("int").alias("size")).select("_row", "size", "p.*")
    information, total = pair_information(exploded)
    scored = exploded.drop("a", "b").join(information, "pair")
    # what a page has of a pair or word, against the rest of the corpus
    rest = lambda here, all_of: F.col("size") * (F.col(all_of) - F.col(here) + 0.5) / total
    pair = (F.col("n") >= AT_LEAST) & (F.col("n") >= PAIR_EXCESS * F.col("size") * (F.col("c") - F.col("n")) / total)
    left, right = ((F.col(here) >= AT_LEAST) & (F.col(here) >= WORD_EXCESS * rest(here, all_of)) for here, all_of in (("na", "ca"), ("nb", "cb")))
    excess = pair | (left & right) | (left & F.col("ma")) | (right & F.col("mb"))
    n = F.sum("n")
    means = scored.groupBy("_row").agg(
        F.try_divide(F.sum(F.col("n") * F.col("npmi")), n).alias("npmi"),
        (1 - F.try_divide(F.count_if(F.col("n") > 0), n)).alias("repeated_pairs"),
        F.sum(F.when(excess, F.col("weight").cast("double")).otherwise(0.0)).alias("held"),
    )
    joined = docs.drop("pairs").join(means, "_row", "left").withColumn("stuffing", F.coalesce(F.try_divide("held", "visible"), F.lit(0.0)))
    suspicious = F.coalesce(F.col("npmi") < LOW, F.lit(False)) | (F.col("stuffing") > STUFFED)
    return joined.select(key, "words", "npmi", "repeated_pairs", "stuffing", suspicious.alias("suspicious"))


def stuffed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the suspicious documents: word salad, and pages most of which is repeated in excess."""
    return coherence(df, key, text).where("suspicious").select(key).distinct()
