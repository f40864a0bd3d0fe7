"""Centroid clustering of integer vectors: Lloyd's rounds that do and add up only what changed.

Kept between rounds are every vector's centroid and distance (a table in the
shared folder) and, per centroid, the integer sum and the number of its vectors
(at the driver: k rows of fixed length). In a round a vector whose centroid
stayed where it was is compared with the centroids that moved, its stored
distance standing for all others; only a vector whose own centroid moved is
compared with all. What changes its owner is a signed transfer: its components
are added to the new owner's sum and taken from the old one's, aggregated by
owner before anything is shuffled. Where no centroid moves the rounds end: the
ones left would change nothing. All arithmetic is in integers, so sums by
transfers equal sums over all vectors.

A lost executor costs the rows of its tasks: each round begins at a table.

Defined results: vectors that are null, of another length, or hold null or
non-finite components take no part; with fewer vectors than centroids there are
as many centroids as vectors; equal vectors and repeated ids are rows of their
own, and where an id is repeated the least vector is first among them; a vector
without an id is assigned but never a first centroid; an empty table gives no
rows; other columns are ignored, whatever their names. A component beyond
``LARGEST`` can't be squared and added in 64 bits: it is an error, not a wrong
distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import delete, stored, table, written

DIMS, SCALE, CENTROIDS, ROUNDS, LARGEST = 64, 64, 16, 3, 1 << 26


def quantised(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the floors of the scaled components, of the vectors that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform("v", lambda c: F.floor(c * float(scale)))
    large = F.exists("v", lambda c: F.abs(c * float(scale)) > float(LARGEST - 1))
    x = F.when(large, F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}"))).otherwise(scaled)
    return rows.where((F.size("v") == dims) & sound).select("vec_id", x.cast("array<int>").alias("x"))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, in 64-bit integers."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]


def nearest(x: np.ndarray, centroids: np.ndarray, moved: np.ndarray, own: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids in ``moved`` changed; ``own`` (-1: none yet) and ``far`` are those of before."""
    own, far = own.copy(), far.copy()
    again = (own < 0) | moved[own]
    if again.any():
        d = distances(x[again], centroids)
        own[again] = d.argmin(axis=1)  # the first of equals
        far[again] = d.min(axis=1)
    at = np.flatnonzero(moved)
    rest = np.flatnonzero(~again)
    if len(at) and len(rest):
        d = distances(x[rest], centroids[at])
        best = d.argmin(axis=1)
        near, number = d[np.arange(len(rest)), best], at[best]
        wins = (near < far[rest]) | (near == far[rest]) & (number < own[rest])
        own[rest[wins]], far[rest[wins]] = number[wins], near[wins]
    return own, far


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after one comparison: vec_id, x, cluster, distance and the owner of before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            was = batch.column("cluster").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            far = batch.column("distance").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own, far = nearest(x, centroids, moved, was, far)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(own, pa.int32()), pa.array(far, pa.int64()), pa.array(was, pa.int32(), mask=was < 0)],
                ["vec_id", "x", "cluster", "distance", "was"],
            )

    return state.mapInArrow(work, "vec_id long, x array<int>, cluster int, distance long, was int")


def transfers(state: DataFrame, dims: int) -> list[tuple[int, int, list[int]]]:
    """Per centroid the change of its count and of its sum, from the vectors whose owner changed: a row a centroid."""
    moved = state.where(~F.col("cluster").eqNullSafe(F.col("was")))
    gains = F.struct(F.col("cluster").alias("owner"), F.lit(1).cast("long").alias("sign"))
    loss = F.struct(F.col("was").alias("owner"), F.lit(-1).cast("long").alias("sign"))
    signed = moved.select("x", F.explode(F.array(gains, loss)).alias("t")).where("t.owner IS NOT NULL").select("x", "t.owner", "t.sign")
    sums = [F.sum(F.get("x", F.lit(i)) * F.col("sign")).alias(f"s{i}") for i in range(dims)]
    return [(r["owner"], r["n"], [r[f"s{i}"] for i in range(dims)]) for r in signed.groupBy("owner").agg(F.sum("sign").alias("n"), *sums).collect()]


class Clusters:
    """Every vector's owner and distance, and the centroids they were compared with last."""

    def __init__(self, state: DataFrame, centroids: list[list[int]]):
        self.state, self.centroids = state, centroids


def cluster(vectors: DataFrame, first: Column, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> Clusters:
    """``rounds`` of assigning and moving, and one assignment more. ``vectors``: vec_id and x; the first centroids are the ``k`` least by ``first``."""
    spark, before = vectors.sparkSession, written()
    state = stored(vectors.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")}), "lloyd")
    chosen = state.orderBy(F.asc_nulls_last(first), "x").limit(k).select("x").collect()  # k rows
    centroids = [list(r["x"]) for r in chosen]
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    moved = [True] * len(centroids)
    if not centroids:
        return Clusters(state, [])
    for turn in range(rounds + 1):
        state = stored(_assigned(state, np.array(centroids, np.int64), np.array(moved)), "lloyd")
        delete(spark, [p for p in written() if p not in before][:-1])
        if turn == rounds:
            break
        for owner, n, s in transfers(state, dims):
            counts[owner] += n
            sums[owner] = [a + b for a, b in zip(sums[owner], s, strict=True)]
        # // rounds towards minus infinity: the exact floor.
        after = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]
        moved = [a != b for a, b in zip(after, centroids, strict=True)]
        centroids = after
        if not any(moved):
            break
    return Clusters(state, centroids)


def seed_order(vec_id: str = "vec_id", seed: int = 1) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")).cast("binary"), 256)


def report(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, the sums of distances over the cluster and over all, and a digest of the final centroid."""
    inertia = {r["cluster"]: r["d"] for r in found.state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    per = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)) if values else F.array().cast(f"array<{kind}>"), F.col("cluster"))
    return found.state.select(
        "vec_id",
        "cluster",
        "distance",
        per([inertia.get(i) for i in range(len(digests))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values()) if digests else None).cast("long").alias("inertia"),
        per(digests, "string").alias("centroid_sha256"),
    )


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of embeddings with its cluster after three rounds."""
    return report(cluster(quantised(table(spark, sf_dir, "embeddings")), seed_order()))


def _sql() -> str:
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        "k0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INT) AS c, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c,
            CAST(list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, k{r} k) GROUP BY vec_id)""")
        if r < ROUNDS:
            steps.append(f"""k{r + 1} AS MATERIALIZED (SELECT k.c, COALESCE(m.x, k.x) AS x FROM k{r} k LEFT JOIN (SELECT c, list(f ORDER BY i) AS x FROM (
                SELECT c, i, CAST((s - ((s % n) + n) % n) / n AS BIGINT) AS f FROM (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (
                SELECT a.c, unnest(v.x) AS e, unnest(range(64)) AS i FROM a{r} a JOIN v USING (vec_id)) GROUP BY c, i)) GROUP BY c) m ON m.c = k.c)""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN k{ROUNDS} USING (c)"""


OP12_SQL = _sql()
