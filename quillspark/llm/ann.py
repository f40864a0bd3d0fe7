"""Nearest neighbours by inner product: inverted lists scanned with adaptive numbers of dimensions.

Index. Vectors are scaled by a power of two, so that the largest component lies
between a half and one. Equal vectors are stored once, with their smallest ids
(as many as a result can name). A further coordinate sqrt(M^2 - |x|^2), M the
largest norm, turns the largest inner product into the least Euclidean
distance; queries are scaled to the norm M. k-means on at most ``SAMPLE``
vectors gives the centres, half the square root of the number of vectors;
every vector, whether in the sample or not, goes to its nearest one.

Search. A query scans its nearest list first; the k-th distance found there is
its threshold from then on. Of the other lists it probes those that hold the
share ``RECALL`` of the neighbours nearer than that which it may expect: in a
list of m vectors with mean square radius r^2 and D^2 from query to centre, a
squared distance is about normal around D^2 + r^2, with deviation 2 D r / sqrt
d. Lists of structured data drop out early; vectors without structure make
nearly all lists worth a look.

In a list, vectors are held rotated by a random orthogonal matrix in blocks of
columns, so that a partial distance over t of d dimensions estimates the whole
one: a candidate is abandoned when partial * d / t exceeds the k-th distance so
far times (1 + EPSILON / sqrt t)^2 - the hypothesis that it is nearer is then
rejected. The survivors' scores are inner products of the original vectors in
double precision. ``exact`` probes every list that the triangle inequality
doesn't exclude and abandons a candidate only when its partial distance alone
exceeds the k-th one.

Lists are cut into blocks of bounded size and their queries into as many at a
time, so a list that holds a third of all vectors is many tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of several lengths are searched among their
own length; products beyond double precision are infinite, and rank so; a
repeated id counts with each of its vectors, and never as its own neighbour;
fewer candidates than k give fewer rows; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import stored, table

NEIGHBOURS, SAMPLE, RECALL, EPSILON, STEP = 20, 20_000, 0.9, 2.1, 16
#: Components of the vectors of a block, queries of a block, candidates and queries that are compared at once.
BLOCK, QUERIES, CHUNK, ABREAST, SALTS = 1 << 21, 4_096, 256, 256, 64
#: Distances that differ by less are equal, whatever their rounding.
NEAR = 1 + 1e-9


class Index:
    """Centres, rotation and what is known of each list; small and of bounded size."""

    def __init__(self, sample: np.ndarray, exponent: int, largest: float, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.exponent, self.largest = exponent, largest
        lifted = self.lift(sample)
        self.dims = lifted.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(self.dims, self.dims)))[0]
        edges = [*range(0, self.dims - STEP // 2, STEP), self.dims] if self.dims > STEP else [0, self.dims]
        self.blocks = list(zip(edges, edges[1:], strict=False))
        lists = max(1, min(lists, len(sample)))
        centres = lifted[rng.choice(len(lifted), lists, replace=False)]
        for _ in range(8):
            nearest = self._nearest(lifted, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, lifted)
            counts = np.bincount(nearest, minlength=lists)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        self.centres = centres
        self.counts = self.squares = self.radius = np.zeros(lists)

    def know(self, lists: np.ndarray, counts: np.ndarray, squares: np.ndarray, radius: np.ndarray) -> None:
        """Each list's number of vectors, mean square radius and largest radius."""
        self.counts, self.squares, self.radius = np.zeros((3, len(self.centres)))
        self.counts[lists], self.squares[lists], self.radius[lists] = counts, squares, radius

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = np.ldexp(x, -self.exponent)
        return np.hstack([x, np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))[:, None]])

    def lift_queries(self, x: np.ndarray) -> np.ndarray:
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        return np.hstack([x * (self.largest / np.sqrt((x * x).sum(axis=1)))[:, None], np.zeros((len(x), 1))])

    @staticmethod
    def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)

    def _nearest(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmin(self._distances(x[i : i + 1024], centres), axis=1) for i in range(0, len(x), 1024)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its squared distance from the centre."""
        lifted = self.lift(x)
        lists = self._nearest(lifted, self.centres)
        gap = lifted - self.centres[lists]
        return lists, (gap * gap).sum(axis=1)

    def first(self, x: np.ndarray) -> np.ndarray:
        """The list that each query scans first: the nearest that holds vectors."""
        far = self._distances(self.lift_queries(x), self.centres)
        far[:, self.counts == 0] = np.inf
        return far.argmin(axis=1)

    def probes(self, x: np.ndarray, limit: np.ndarray, recall: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, list) to scan after the first list, given each query's threshold; without ``recall`` all that may hold something nearer."""
        far = self._distances(self.lift_queries(x), self.centres)
        first = self.first(x)
        if recall is None:
            keep = np.maximum(np.sqrt(far) - self.radius * NEAR, 0) ** 2 <= limit[:, None] * NEAR
        else:
            spread = 2 * np.sqrt(far * self.squares / max(1, self.dims - 1)) + 1e-300
            hits = self.counts * _tail(np.clip((far + self.squares - np.minimum(limit, 1e300)[:, None]) / spread, -30, 30))
            order = np.argsort(-hits, axis=1, kind="stable")
            hits = np.take_along_axis(hits, order, axis=1)
            before = np.cumsum(hits, axis=1) - hits
            keep = np.zeros(far.shape, bool)
            np.put_along_axis(keep, order, before < recall * hits.sum(axis=1)[:, None], axis=1)
            keep[np.isinf(limit)] = True  # no threshold yet
        keep[:, self.counts == 0] = False
        keep[np.arange(len(x)), first] = False
        return np.nonzero(keep)

    def scan(self, queries: np.ndarray, vectors: np.ndarray, k: int, limit: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Pairs (query, vector) that no hypothesis test abandoned, given each query's threshold; the number of pairs abandoned before their last dimension, and of all."""
        c = self.lift(vectors) @ self.rotation
        q = self.lift_queries(queries) @ self.rotation
        rows, columns, abandoned = [], [], 0
        for begin in range(0, len(q), ABREAST):
            i, j, lost = self._scan(q[begin : begin + ABREAST], c, k, limit[begin : begin + ABREAST], exact)
            rows.append(i + begin)
            columns.append(j)
            abandoned += lost
        return np.concatenate(rows), np.concatenate(columns), abandoned, len(q) * len(c)

    def _scan(self, q: np.ndarray, c: np.ndarray, k: int, limit: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, int]:
        best = np.full((len(q), k), np.inf)  # the k least distances so far
        rows, columns, abandoned = [], [], 0
        begin, size = 0, max(32, 2 * k)
        while begin < len(c):
            part = c[begin : begin + size]
            kth = np.minimum(best.max(axis=1), limit)
            # The first block of columns for all pairs by one matrix product; then the pairs that are left.
            edge = self.blocks[0][1]
            partial = self._distances(q[:, :edge], part[:, :edge])
            i, j = np.nonzero(partial <= self._bound(kth, edge, exact)[:, None])
            partial = partial[i, j]
            for a, b in self.blocks[1:]:
                gap = q[i, a:b] - part[j, a:b]
                partial = partial + np.einsum("ij,ij->i", gap, gap)
                abandoned += 0 if b < self.dims else len(q) * len(part) - len(i)
                keep = partial <= self._bound(kth, b, exact)[i]
                i, j, partial = i[keep], j[keep], partial[keep]
            grid = np.full((len(q), len(part)), np.inf)
            grid[i, j] = partial
            rows.append(i)
            columns.append(j + begin)
            best = np.partition(np.hstack([best, grid]), k - 1, axis=1)[:, :k]
            begin, size = begin + size, CHUNK
        return np.concatenate(rows), np.concatenate(columns), abandoned

    def _bound(self, kth: np.ndarray, t: int, exact: bool) -> np.ndarray:
        """The largest partial distance over t dimensions at which a candidate isn't abandoned."""
        slack = NEAR if exact or t == self.dims else (1 + EPSILON / np.sqrt(t)) ** 2 * t / self.dims
        return kth * min(slack, NEAR)

    def distance(self, scores: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The squared distance that an inner product stands for."""
        scaled, power = np.frexp(np.abs(queries).max(axis=1))
        norms = np.sqrt((np.ldexp(queries, -power[:, None]) ** 2).sum(axis=1))
        small = np.ldexp(np.ldexp(scores, -power), -self.exponent) * (self.largest / norms)
        return np.maximum(2 * self.largest**2 - 2 * small, 0)


def _tail(z: np.ndarray) -> np.ndarray:
    """The normal distribution's upper tail (a rational approximation, to 1e-7)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, p, 1 - p)


def _valid(x: Column) -> Column:
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def nearest(embeddings: DataFrame, is_query: Column, k: int = NEIGHBOURS, recall: float = RECALL, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """The ``k`` nearest vectors found for each row where ``is_query`` (over vec_id) holds: query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & _valid(F.col("x")))
    top = F.array_max(F.transform("x", F.abs))
    # One row a length of vectors.
    sizes = vectors.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"), F.max(top).alias("top")).orderBy("dims").collect()
    found = [_of_length(vectors.where(F.size("x") == s["dims"]), is_query, k, recall, sample, exact, s["dims"], s["n"], s["top"]) for s in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_length(vectors: DataFrame, is_query: Column, k: int, recall: float, sample: int, exact: bool, dims: int, n: int, top: float) -> DataFrame:
    exponent = int(np.frexp(top)[1])
    square = F.aggregate(F.transform("x", lambda v: v / F.lit(2.0) ** (exponent // 2) / F.lit(2.0) ** (exponent - exponent // 2)), F.lit(0.0), lambda s, v: s + v * v)
    largest = float(np.sqrt(vectors.agg(F.max(square)).first()[0])) * (1 + 1e-12)
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()["x"].combine_chunks()
    index = Index(np.asarray(drawn.values).reshape(-1, dims), exponent, largest, max(1, round(np.sqrt(n) / 2)))
    block = max(1024, BLOCK // dims)

    # Equal vectors once, with their k + 1 smallest ids: first within a share of the ids, then over the shares.
    within = Window.partitionBy("x", "salt").orderBy("vec_id")
    few = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= k + 1)
    distinct = few.groupBy("x").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")).withColumn("key", F.col("ids")[0])

    def to_list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lists, square = index.assign(np.stack(batch["x"].to_numpy()))
                yield batch.assign(list=lists, square=square)

    held = stored(distinct.select("x", "ids", "key").mapInPandas(to_list, "x array<double>, ids array<long>, key long, list long, square double"), "lists")
    known = held.groupBy("list").agg(F.count("*").alias("n"), F.avg("square").alias("square"), F.max("square").alias("widest")).toPandas()  # a row a list
    index.know(known["list"].to_numpy(), known["n"].to_numpy(), known["square"].to_numpy(), np.sqrt(known["widest"].to_numpy()))
    asked = stored(vectors.where(is_query).groupBy("x").agg(F.min("vec_id").alias("key")), "asked")

    def to_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                some = batch.iloc[begin : begin + 1024]
                yield some.assign(limit=np.inf, list=index.first(np.stack(some["x"].to_numpy())))

    def to_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                some = batch.iloc[begin : begin + 1024]
                x = np.stack(some["x"].to_numpy())
                kth = some["kth"].to_numpy(dtype=float)
                limit = np.where(np.isfinite(kth), index.distance(np.where(np.isfinite(kth), kth, 0), x), np.inf)
                i, lists = index.probes(x, limit, None if exact else recall)
                for part in range(0, len(i), 8192):
                    at = i[part : part + 8192]
                    yield pd.DataFrame({"key": some["key"].to_numpy()[at], "x": some["x"].to_numpy()[at], "limit": limit[at], "list": lists[part : part + 8192]})

    def scan(_: tuple, vectors: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(sought):
            return pd.DataFrame({"key": [], "vec_id": [], "score": []})
        c, q = np.stack(vectors["x"].to_numpy()), np.stack(sought["x"].to_numpy())
        i, j, _lost, _all = index.scan(q, c, k + 1, sought["limit"].to_numpy(dtype=float), exact)
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.nan_to_num(np.einsum("ij,ij->i", q[i], c[j]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        ids, keys = vectors["ids"].to_numpy(), sought["key"].to_numpy()
        first = np.array([x[0] for x in ids])
        order = np.lexsort((first[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score = i[nth <= k], j[nth <= k], score[nth <= k]
        repeats = np.array([len(x) for x in ids], dtype=np.int64)[j]
        return pd.DataFrame({"key": keys[i].repeat(repeats), "vec_id": np.concatenate([ids[x] for x in j]) if len(j) else [], "score": score.repeat(repeats)})

    def scanned(sought: DataFrame, name: str) -> DataFrame:
        """Hits of queries (key, x, limit, list) in blocks of their lists."""
        # The counts are one row a list.
        blocks = held.groupBy("list").agg(F.ceil(F.count("*") / block).alias("held")).join(sought.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("sought")), "list")
        left = held.join(F.broadcast(blocks), "list").select("list", "ids", "x", F.pmod(F.xxhash64("key"), "held").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sought") - 1)).alias("b"))
        right = sought.join(F.broadcast(blocks), "list").select("list", "key", "x", "limit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1)).alias("a"), F.pmod(F.xxhash64("key"), "sought").alias("b"))
        return stored(left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInPandas(scan, "key long, vec_id long, score double"), name)

    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    near = scanned(asked.mapInPandas(to_first, "key long, x array<double>, limit double, list long"), "near")
    # The nearest list's k-th score but one, as the query's own vector may be among them.
    kth = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k + 1).select("key", F.col("score").alias("kth"))
    others = scanned(asked.join(kth, "key", "left").mapInPandas(to_others, "key long, x array<double>, limit double, list long"), "far")
    top_hits = near.unionByName(others).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("hits"))
    # Each query row takes its vector's hits, without itself.
    rows = vectors.where(is_query).join(asked, "x").select(F.col("vec_id").alias("query_id"), "key").join(top_hits, "key")
    hits = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(hits).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
