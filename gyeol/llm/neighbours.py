"""Problem 6: the most similar vectors of every vector, by multi-index hashing.

Vectors are turned into binary codes by learned rotations: the principal axes of a bounded sample that vary more than
the average axis, rotated by iterative quantisation towards the corners of a cube. The code is cut into substrings, each
of which indexes all vectors by itself. Vectors that share a substring meet in its bucket: by the pigeonhole principle
every code whose Hamming distance is smaller than the number of substrings is found. Their length follows the
logarithm of the number of vectors, so that buckets keep their size; how many are needed for the wanted recall is
measured on sampled queries against all vectors. A bucket that is too full is split by further bits of its code. In
a bucket floats of half precision rank the candidates, and the best of all buckets are reranked in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.llm.textio import ROWS, arrow_map, batch_of, materialised, sized_join

DIMENSIONS = 128
#: The rotations are learned on at most so many vectors, taken by the hash of their class; every vector is indexed.
SAMPLE = 20_000
#: Of the sample so many are searched exactly, to measure what a number of substrings finds, and what they must find.
QUERIES, RECALL = 512, 0.98
#: Vectors that a bucket should hold on average; with more than BLOCK it is split by so many further bits at a time.
BUCKET, BLOCK, DEEPER = 256, 4096, 3
MOST_TABLES = 32
#: Bits of a code that can be used for one bucket.
CODE = 62
#: From this cosine on one pass over the buckets is enough; below it, vectors with fewer than k neighbours are searched further.
SURE = 0.9
#: Places kept beyond k, and the error allowed for, because candidates are ranked in half precision.
SLACK, HALF_ERROR = 2, 2e-3


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 8) -> np.ndarray:
    """Orthogonal rotation of centred rows that brings them close to the corners of a cube."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds if len(x) >= x.shape[1] else 0):
        z = x @ r
        u, _, vt = np.linalg.svd(np.where(z >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


class Codes:
    """Binary codes of unit vectors: table t reads `CODE` bits at most, beginning with a substring that is its own."""

    def __init__(self, sample: np.ndarray, length: int) -> None:
        width = sample.shape[1]
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(width)
        self.axes = np.eye(width)
        if len(sample) > width:
            values, vectors = np.linalg.eigh(np.cov(sample.T))
            self.axes = vectors[:, ::-1][:, : max(8, int((values > values.mean()).sum()))]
        self.bits = self.axes.shape[1]
        self.length = min(length, self.bits)
        self._centred = (sample - self.mean) @ self.axes
        self._rotations: list[np.ndarray] = []

    def rotation(self, i: int) -> np.ndarray:
        while len(self._rotations) <= i:
            self._rotations.append(self.axes @ learn_rotation(self._centred, len(self._rotations)))
        return self._rotations[i]

    def fixed(self, tables: int) -> Codes:
        """What these tables need, without the sample."""
        self.rotation((tables - 1) // self.each + 1)
        self._centred = self._centred[:0]
        return self

    @property
    def each(self) -> int:
        """Substrings that one rotation gives."""
        return max(1, self.bits // max(1, self.length))

    def of(self, x: np.ndarray, tables: int) -> np.ndarray:
        """int64 rows, a column for each table: the first bit is the highest of CODE.

        A table reads all bits of its rotation, beginning with its own substring, and then those of the next one.
        """
        out = np.zeros((len(x), tables), dtype=np.int64)
        last = (tables - 1) // self.each + 1
        signs = [((x - self.mean) @ self.rotation(r) >= 0).astype(np.int64) for r in range(last + 1)]
        for t in range(tables):
            first, start = divmod(t, self.each)
            for place in range(min(CODE, 2 * self.bits)):
                r, column = (first, (start * self.length + place) % self.bits) if place < self.bits else (first + 1, place - self.bits)
                out[:, t] |= signs[r][:, column] << (CODE - 1 - place)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def matrix(column: pa.Array, width: int = DIMENSIONS) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def usable(df: DataFrame, key: str, vector: str, width: int = DIMENSIONS) -> DataFrame:
    """digest, vec, cls of every digest with a usable vector, once each; cls is equal for equal directions.

    Vectors that are null, of another length, all zero or hold a null, NaN or infinity don't count. Of rows that share
    a digest the smallest vector stays.
    """
    good = (F.size(vector) == width) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = df.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).alias("digest"), F.col(vector).cast("array<float>").alias("vec"))
    rows = rows.groupBy("digest").agg(F.min("vec").alias("vec"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(matrix(batch.column(1), width))
        cls = [xxhash.xxh128_digest(r.tobytes()) for r in np.rint(x * 1e6).astype(np.int32)]
        return batch_of(digest=batch.column(0), vec=batch.column(1), cls=(cls, pa.binary()))

    return arrow_map(rows, run, f"digest {df.schema[key].dataType.simpleString()}, vec array<float>, cls binary")


def best_of_each(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `most` highest finite scores of each row."""
    most = min(most, scores.shape[1])
    top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    i = np.repeat(np.arange(len(scores)), most)
    j = top.ravel()
    there = scores[i, j] > -np.inf
    return i[there], j[there]


def nearest_of_sample(reps: DataFrame, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and vectors: a row for each of the k nearest vectors of each of a bounded number of queries.

    The queries are compared with every vector, batch by batch, and a task keeps the k best of each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, found = np.full((len(queries), 0), -np.inf), np.zeros((len(queries), 0, width))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = unit(matrix(batch.column(0).slice(at, ROWS), width))
                scores = queries @ x.T
                scores[scores > 1 - 1e-9] = -np.inf  # itself
                top = np.argsort(-scores, axis=1)[:, :k]
                best = np.concatenate([best, np.take_along_axis(scores, top, 1)], axis=1)
                found = np.concatenate([found, x[top]], axis=1)
                top = np.argsort(-best, axis=1)[:, :k]
                best, found = np.take_along_axis(best, top, 1), np.take_along_axis(found, top[:, :, None], 1)
        i, j = np.nonzero(best > -np.inf)
        if len(i):
            yield batch_of(q=pa.array(i.astype(np.int32)), score=pa.array(best[i, j]), near=(found[i, j].tolist(), pa.list_(pa.float64())))

    rows = reps.select("vec").mapInArrow(scan, "q int, score double, near array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    truth = rows.withColumn("r", rank).where(F.col("r") <= k).select("q", "near").toArrow().combine_chunks()  # at most QUERIES * k
    if not truth.num_rows:
        return np.zeros((0, width)), np.zeros((0, width))
    return queries[truth.column("q").to_numpy()], np.array(truth.column("near").to_pylist())


def tables_needed(codes: Codes, one: np.ndarray, other: np.ndarray) -> int:
    """How many tables find RECALL of the pairs; shortens the substrings where none does."""
    while codes.length and len(one):
        mine, theirs = codes.of(one, MOST_TABLES), codes.of(other, MOST_TABLES)
        shared = np.logical_or.accumulate((mine ^ theirs) >> (CODE - codes.length) == 0, axis=1).mean(axis=0)
        if shared[-1] >= RECALL:
            return int(np.argmax(shared >= RECALL)) + 1
        codes.length -= 1
    return 1


def prefix(depth) -> Column:
    return F.expr(f"shiftright(code, {CODE} - {depth})")


class Buckets:
    """Which bucket of a table a code belongs to: that of its substring, or of a longer one where that is too full."""

    def __init__(self, reps: DataFrame, codes: Codes, tables: int, split: int, width: int) -> None:
        self.codes, self.tables, self.width = codes, tables, width

        def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
            c = codes.of(unit(matrix(batch.column(0), width)), tables)
            return batch_of(t=pa.array(np.tile(np.arange(tables, dtype=np.int32), len(c))), code=pa.array(c.ravel()))

        rows = narrow = arrow_map(reps.select("vec"), coded, "t int, code bigint")
        self.levels: list[tuple[int, DataFrame, int]] = []
        self.blocks: tuple[DataFrame, int] | None = None
        depth, deepest = codes.length, min(CODE, 2 * codes.bits)
        while True:
            hot = materialised(narrow.groupBy("t", prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(split, BLOCK)))
            full = hot.where(F.col("n") > split)
            n = full.count()
            if not n or depth + DEEPER > deepest:
                break
            self.levels.append((depth, full.select("t", "prefix"), n))
            narrow = sized_join(narrow.withColumn("prefix", prefix(depth)), full.select("t", "prefix"), ["t", "prefix"], "left_semi", n).drop("prefix")
            depth += DEEPER
        if self.levels or hot.count():
            big = self.assigned(rows).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
            big = materialised(big.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
            self.blocks = (big, big.count())

    def assigned(self, rows: DataFrame) -> DataFrame:
        """rows (t, code and others) with `bucket` in the place of t and code."""
        rows = rows.withColumn("depth", F.lit(self.codes.length))
        for depth, full, n in self.levels:
            rows = sized_join(rows.withColumn("prefix", prefix(depth)), full.withColumn("next", F.lit(depth + DEEPER)), ["t", "prefix"], "left", n)
            rows = rows.withColumn("depth", F.greatest("depth", F.coalesce("next", F.lit(0)))).drop("prefix", "next")
        return rows.withColumn("bucket", F.xxhash64("t", "depth", prefix("depth"))).drop("t", "code", "depth")

    def share_of(self, spark: SparkSession, one: np.ndarray, other: np.ndarray) -> float:
        """The share of pairs that meet in a bucket."""
        if not self.levels or not len(one):
            return 1.0
        rows = [(p, t, int(c)) for side in (one, other) for p, codes in enumerate(self.codes.of(side, self.tables).tolist()) for t, c in enumerate(codes)]
        met = self.assigned(spark.createDataFrame(rows, "p int, t int, code bigint")).groupBy("p", "bucket").count().where("count > 1")
        return met.select("p").distinct().count() / len(one)

    def filled(self, reps: DataFrame) -> DataFrame:
        """bucket, own, x, y, rid, half: every vector of reps in one bucket of each table.

        A bucket of more than BLOCK vectors is compared block by block: own block, and the pair x <= y that meets.
        """
        codes, tables, width = self.codes, self.tables, self.width

        def indexed(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = unit(matrix(batch.column(1), width))
            c = codes.of(x, tables)
            half = [r.tobytes() for r in x.astype(np.float16)]
            take = pa.array(np.repeat(np.arange(len(x)), tables))
            return batch_of(t=pa.array(np.tile(np.arange(tables, dtype=np.int32), len(c))), code=pa.array(c.ravel()), rid=batch.column(0).take(take), half=pa.array(half, pa.binary()).take(take))

        rows = self.assigned(arrow_map(reps.select("rid", "vec"), indexed, "t int, code bigint, rid bigint, half binary"))
        zero = F.lit(0)
        if not self.blocks or not self.blocks[1]:
            return rows.select("bucket", zero.alias("own"), zero.alias("x"), zero.alias("y"), "rid", "half")
        rows = sized_join(rows, self.blocks[0], ["bucket"], "left", self.blocks[1]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.select("bucket", "rid", "half", F.pmod(F.xxhash64("rid"), "blocks").cast("int").alias("own"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other"))
        return rows.select("bucket", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rid", "half")


def index(reps: DataFrame, sample: np.ndarray, n: int, k: int, width: int) -> Buckets:
    """Buckets by which RECALL of the k nearest of the sampled queries is found.

    Splitting full buckets can cost neighbours: there are more tables then, and in the end fuller buckets.
    """
    codes = Codes(sample, max(0, round(np.log2(max(1, n) / BUCKET))))
    one, other = nearest_of_sample(reps, sample[:QUERIES], k, width) if codes.length else (sample[:0], sample[:0])
    tables = tables_needed(codes, one, other)
    codes.fixed(MOST_TABLES)
    split = BLOCK if codes.length else max(n, BLOCK)
    while True:
        buckets = Buckets(reps, codes, tables, split, width)
        if buckets.share_of(reps.sparkSession, one, other) >= RECALL:
            return buckets
        tables, split = (min(MOST_TABLES, tables * 2), split) if tables < MOST_TABLES else (tables, split * 4)


def candidates(reps: DataFrame, buckets: Buckets, most: int, at_least: float, width: int = DIMENSIONS) -> DataFrame:
    """rid, near: for each row of reps (rid, vec) the `most` best of those it shares a bucket with, by half precision."""

    def compare(group: pa.Table) -> pa.Table:
        rid = group.column("rid").to_numpy()
        x = np.frombuffer(b"".join(group.column("half").to_pylist()), dtype=np.float16).reshape(len(rid), width).astype(np.float32)
        own, a, b = (group.column(c).to_numpy() for c in ("own", "x", "y"))
        sides = [np.arange(len(rid))] * 2 if a[0] == b[0] else [np.flatnonzero(own == a[0]), np.flatnonzero(own == b[0])]
        out: list[tuple] = []
        for one, other in ((sides[0], sides[1]),) if a[0] == b[0] else ((sides[0], sides[1]), (sides[1], sides[0])):
            for s in range(0, len(one) if len(other) else 0, 1024):
                rows = one[s : s + 1024]
                scores = x[rows] @ x[other].T
                scores[rid[rows][:, None] == rid[other][None, :]] = -np.inf
                scores[scores < at_least - HALF_ERROR] = -np.inf
                i, j = best_of_each(scores, most)
                out.append((rid[rows[i]], rid[other[j]], scores[i, j]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        return pa.table(dict(zip(("rid", "near", "score"), map(pa.array, columns), strict=True)))

    found = buckets.filled(reps).groupBy("bucket", "x", "y").applyInArrow(compare, "rid bigint, near bigint, score float")
    found = found.groupBy("rid", "near").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "near"))
    return found.withColumn("r", rank).where(F.col("r") <= most).select("rid", "near")


def exact(some: DataFrame, reps: DataFrame, most: int, at_least: float, width: int = DIMENSIONS) -> DataFrame:
    """cls, near, cosine: the `most` best of reps for each of some (both cls, vec), by comparison with every one.

    reps is materialised; each task reads its files from the shared folder block by block, so that nothing is shuffled
    or broadcast and a block of scores is all that is held.
    """
    files = sorted(reps.inputFiles())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(matrix(batch.column(1), width))
        own = np.array(batch.column(0).to_pylist(), dtype=object)
        best = np.full((len(x), most), -np.inf)
        near = np.full((len(x), most), None, dtype=object)
        for name in files:
            system, path = fs.FileSystem.from_uri(name)
            with system.open_input_file(path) as f:
                for block in pq.ParquetFile(f).iter_batches(BLOCK, columns=["cls", "vec"]):
                    y = unit(matrix(block.column("vec"), width))
                    ids = np.array(block.column("cls").to_pylist(), dtype=object)
                    scores = x @ y.T
                    i, j = np.nonzero((scores >= at_least) & (scores > best[:, -1:]))
                    keep = own[i] != ids[j]
                    i, j = i[keep], j[keep]
                    s = scores[i, j]
                    order = np.lexsort((-s, i))
                    i, j, s = i[order], j[order], s[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, s, rank = (v[rank < most] for v in (i, j, s, rank))
                    fresh, fresh_ids = np.full_like(best, -np.inf), np.full_like(near, None)
                    fresh[i, rank], fresh_ids[i, rank] = s, ids[j]
                    both, names = np.concatenate([best, fresh], axis=1), np.concatenate([near, fresh_ids], axis=1)
                    top = np.argsort(-both, axis=1, kind="stable")[:, :most]
                    best, near = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        i, j = np.nonzero(best > -np.inf)
        return batch_of(cls=(own[i].tolist(), pa.binary()), near=(near[i, j].tolist(), pa.binary()), cosine=(best[i, j], pa.float64()))

    return arrow_map(some.select("cls", "vec"), run, "cls binary, near binary, cosine double")


def neighbours(df: DataFrame, key: str, vector: str, k: int = 5, at_least: float = 0.9, width: int = DIMENSIONS) -> DataFrame:
    """digest, neighbour, cosine, rank: the k most similar other digests of each, down to a similarity.

    Digests of equal direction form a class that is searched once; each member then meets the first k + 1 members of
    its own class and of the classes near it, so that no group of copies is expanded into its pairs. Ties go to the
    smaller digest. Classes whose buckets hold fewer than k others are compared with every class, so that each
    digest gets its k neighbours wherever there are so many. A table without usable vectors gives no row.
    """
    rows = materialised(usable(df, key, vector, width))
    reps = rows.groupBy("cls").agg(F.min_by("vec", "digest").alias("vec"))
    reps = materialised(reps.withColumn("rid", F.monotonically_increasing_id()))
    n = reps.count()
    step = max(1, -(-n // SAMPLE))
    sample = reps.where(F.pmod(F.xxhash64("cls"), F.lit(step)) == 0).orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("vec").toArrow().combine_chunks()
    x = unit(matrix(sample.column("vec").combine_chunks(), width)) if sample.num_rows else np.zeros((0, width))
    best = materialised(candidates(reps, index(reps, x, n, k, width), k + 1 + SLACK, at_least, width))
    pairs = best.select(F.least("rid", "near").alias("a"), F.greatest("rid", "near").alias("b")).distinct()
    both = pairs.join(reps.select(F.col("rid").alias("a"), F.col("cls").alias("cls_a"), F.col("vec").alias("u")), "a")
    both = both.join(reps.select(F.col("rid").alias("b"), F.col("cls").alias("cls_b"), F.col("vec").alias("v")), "b").select("cls_a", "cls_b", "u", "v")

    def rerank(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, v = matrix(batch.column(2), width), matrix(batch.column(3), width)
        cos = np.einsum("ij,ij->i", u, v) / np.linalg.norm(u, axis=1) / np.linalg.norm(v, axis=1)
        good = pa.array(np.flatnonzero(cos >= at_least))
        return batch_of(cls=batch.column(0).take(good), near=batch.column(1).take(good), cosine=pa.array(cos).take(good))

    near = materialised(arrow_map(both, rerank, "cls binary, near binary, cosine double"))
    near = near.unionByName(near.select(F.col("near").alias("cls"), F.col("cls").alias("near"), "cosine"))
    if at_least < SURE and n > 1:
        full = best.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1)).select("rid")
        short = materialised(reps.join(full, "rid", "left_anti"))
        lonely = short.count()
        if lonely:
            near = near.join(short.select("cls"), "cls", "left_anti")
            near = near.unionByName(exact(short.repartition(max(1, min(lonely // ROWS, 1000))), reps, k + 1, at_least, width))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("cosine"), "near"))).where(F.col("r") <= k + 1).drop("r")
    own = rows.select("cls").distinct().select("cls", F.col("cls").alias("near"), F.lit(1.0).alias("cosine"))
    firsts = rows.select(F.col("cls").alias("near"), F.col("digest").alias("neighbour"))
    firsts = firsts.withColumn("r", F.row_number().over(Window.partitionBy("near").orderBy("neighbour"))).where(F.col("r") <= k + 1).drop("r")
    around = best.unionByName(own).join(firsts, "near").select("cls", "neighbour", "cosine")
    found = rows.select("cls", "digest").join(around, "cls").where(F.col("digest") != F.col("neighbour"))
    rank = F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("cosine"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("digest", "neighbour", "cosine", "rank")
