"""Problem 8: token ids of a whole corpus by a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash resolves whole pre-tokens that are in the vocabulary; the others are merged by a heap
over linked bytes. Pre-tokens of a batch are resolved once each and scattered to their documents.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.textio import arrow_map, batch_of

#: Where the vocabulary files are; they are never copied.
TOKENIZERS = os.environ.get("GYEOL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pre-tokens whose merges a task remembers; beyond it, it starts again.
REMEMBERED = 400_000


def mixed(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (seed.astype(np.uint64) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class MinimalPerfectHash:
    """Hash and displace: keys fall into buckets, each bucket gets the first seed that sends its keys to free slots.

    n keys fill exactly the slots 0..n-1, so that a lookup is two array reads and one comparison of 64-bit hashes.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(h)) < n:
            raise ValueError("two keys share a 64-bit hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.seed = np.zeros(self.buckets, dtype=np.uint32)
        self.slot_hash = np.zeros(n, dtype=np.uint64)
        self.slot_value = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        for b in np.argsort(cuts[:-1] - cuts[1:], kind="stable").tolist():
            rows = order[cuts[b] : cuts[b + 1]]
            if not len(rows):
                break
            seed = 1
            while True:
                trial = np.arange(seed, seed + 256, dtype=np.uint64)
                slots = (mixed(h[rows][None, :], trial[:, None]) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(axis=1)
                if len(rows) > 1:
                    s = np.sort(slots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.flatnonzero(good)[0])
                    break
                seed += 256
            self.seed[b] = seed + k
            free[slots[k]] = False
            self.slot_hash[slots[k]], self.slot_value[slots[k]] = h[rows], rows

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the key with each 64-bit hash, -1 for strangers."""
        slot = (mixed(h, self.seed[(h % np.uint64(self.buckets)).astype(np.int64)]) % np.uint64(self.n)).astype(np.int64)
        return np.where(self.slot_hash[slot] == h, self.slot_value[slot], -1)


class Encoder:
    """Encoding by a rank file: base64 token and rank on each line."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file.read().splitlines() if line]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.split = regex.compile(pattern).findall
        # only tokens that their own merges lead to may be resolved whole
        whole = [t for t in self.ranks if len(t) == 1 or self.merge(t) == [self.ranks[t]]]
        self.tokens = whole
        self.ids = np.array([self.ranks[t] for t in whole], dtype=np.int64)
        self.hash = MinimalPerfectHash(whole)
        self.memory: dict[str, list[int]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Merges of the lowest rank first, leftmost among equals: a heap over linked byte positions."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # of the part that begins at each place
        left = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop or not alive[j] or ranks.get(raw[i:stop]) != r:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
                r = ranks.get(raw[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := left[i]) >= 0:
                r = ranks.get(raw[k:stop])
                if r is not None:
                    heapq.heappush(heap, (r, k, stop))
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        at = self.hash.find(np.fromiter(map(xxhash.xxh64_intdigest, raw), dtype=np.uint64, count=len(raw))).tolist()
        out = []
        for p, b, k in zip(pieces, raw, at, strict=True):
            if k >= 0 and self.tokens[k] == b:
                out.append([int(self.ids[k])])
                continue
            ids = self.memory.get(p)
            if ids is None:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                ids = self.memory[p] = self.merge(b)
            out.append(ids)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        found = [self.split(t) for t in texts]
        codes, pieces = pd.factorize(np.array([p for f in found for p in f], dtype=object))
        if not len(codes):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        ids = self.encode_pieces(list(pieces))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(size.sum()))
        start = np.cumsum(size) - size
        n = size[codes]
        at = np.repeat(start[codes], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        return flat[at], np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def encode(df: DataFrame, text: str, keys: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, sizes_only: bool = False) -> DataFrame:
    """keys and `ids` (array of int), or `n_tokens` with sizes_only. A null or empty text has the empty list, 0 tokens.

    Special tokens' strings are ordinary text. One row out for each row in, repeated rows included.
    """
    path = f"{folder}/{vocabulary}.tiktoken"
    df = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_tokens int" if sizes_only else "ids array<int>"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = encoder(path).encode_batch(batch.column(len(keys)).to_pylist())
        if sizes_only:
            out = {"n_tokens": pa.array(n, pa.int32())}
        else:
            out = {"ids": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))}
        return batch_of(**{k: batch.column(i) for i, k in enumerate(keys)}, **out)

    return arrow_map(df, run, schema)
