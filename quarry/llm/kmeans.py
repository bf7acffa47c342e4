"""Centroid clustering by Ball k-means: clusters as balls, whose annuli meet the neighbours that can reach them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, materialize, release
from quarry.llm.vectors import whole

#: Centroids, rounds of moving them, and length of the vectors. The driver holds CENTROIDS x LENGTH numbers.
CENTROIDS, ROUNDS, LENGTH = 16, 3, 64


def gaps(centroids: np.ndarray) -> np.ndarray:
    """Squared distances between all centroids."""
    return ((centroids[:, None] - centroids[None]) ** 2).sum(2)


def neighbours(between: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
    """For every ball the centroids that can be as near to a member as its own one, nearest first.

    A member within r of its centroid can be as near to another only if the two centroids are at most 2 r apart.
    """
    near = []
    for i, row in enumerate(between):
        order = np.argsort(row, kind="stable")
        near.append(order[(order != i) & (np.sqrt(row[order]) <= 2 * radii[i] * (1 + 1e-9) + 1e-9)])
    return near


def assign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, between: np.ndarray, near: list[np.ndarray]) -> tuple:
    """(cluster, squared distance) of each row of x, whose former clusters are ``own``.

    A member at squared distance D of its centroid meets the neighbours at a squared gap of up to 4 D only: those nearer
    than half the gap to the nearest neighbour are the stable core and meet none, each further annulus one neighbour more.
    All comparisons are between whole numbers; ties go to the smaller number.
    """
    at = ((x - centroids[own]) ** 2).sum(1)
    best, who = at.copy(), own.copy()
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        for j in near[i]:
            members = members[4 * at[members] >= between[i, j]]
            if not len(members):
                break
            d = ((x[members] - centroids[j]) ** 2).sum(1)
            win = (d < best[members]) | (d == best[members]) & (j < who[members])
            best[members[win]], who[members[win]] = d[win], j
    return who, best


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, d)


def _assigned(state: DataFrame, centroids: np.ndarray, radii: np.ndarray) -> DataFrame:
    between, d = gaps(centroids), centroids.shape[1]
    near = neighbours(between, radii)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("cluster").to_numpy().astype(np.int64)
            who, best = assign(_matrix(b.column("v"), d), own, centroids, between, near)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(who, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "v", "cluster", "distance"]
            )

    return state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id bigint, v array<int>, cluster int, distance bigint")


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids of the members and a bound on the members' distance from them, from one sum per task and cluster.

    A ball moves by no more than its centroid, so the old radius plus the move bounds the new one without another pass.
    """
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, most = np.zeros((k, d), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            who = b.column("cluster").to_numpy()
            x = _matrix(b.column("v"), d)
            np.maximum.at(most, who, b.column("distance").to_numpy())
            n += np.bincount(who, minlength=k)
            for i in np.unique(who):
                sums[i] += x[who == i].sum(0)
        on = np.flatnonzero(n)
        arrays = [pa.array(on, pa.int32()), pa.array(n[on], pa.int64()), pa.array(most[on], pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums[on]), pa.list_(pa.int64()))], names=["cluster", "n", "most", "sums"])

    parts = state.select("cluster", "distance", "v").mapInArrow(run, "cluster int, n bigint, most bigint, sums array<bigint>")
    total = F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    rows = (
        parts.select("cluster", "n", "most", F.posexplode("sums").alias("at", "x"))
        .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.max("most").alias("most"), total)
    )
    new, radii = centroids.copy(), np.zeros(k)
    for r in rows.collect():
        new[r.cluster, r["at"]] = int(r.x) // r.n
        radii[r.cluster] = r.most**0.5
    return new, radii + np.sqrt(((new - centroids) ** 2).sum(1))


def starts(rows: DataFrame, k: int = CENTROIDS, seed: str = "1") -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; null ids come last, repeated ids in order of components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(key.asc_nulls_last(), "v").select("v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable row of vectors(vec_id, embedding).

    Components become whole numbers floor(64 * x); distances are squared and exact. Each round assigns every vector to the
    nearest centroid (ties: the smaller number), then puts each centroid at the floor of its vectors' mean; one without
    vectors stays. A last assignment follows. Vectors that are null, of another length or hold null or non-finite
    components are left out, rows repeat as they come, null ids stay null, and other columns are not read. Fewer usable
    rows than k make as many centroids; none make an empty result. Equal centroids: the smaller number has all vectors.
    """
    spark = vectors.sparkSession
    rows = whole(vectors, length)
    centroids = starts(rows, k, seed)
    if not len(centroids):
        kind = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], kind)
    # at first, one ball without bounds holds all vectors
    state, radii, old = rows.withColumn("cluster", F.lit(0)), np.full(len(centroids), np.inf), None
    with arrow_rows(spark, max(16, (1 << 20) // length)):
        for at in range(rounds + 1):
            state = materialize(_assigned(state, centroids, radii))
            release(old)
            old = state
            if at < rounds:
                centroids, radii = _moved(state, centroids)
    sums = {r.cluster: int(r.x) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    balls = spark.createDataFrame([(i, s, digest[i]) for i, s in sums.items()], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    made = state.join(F.broadcast(balls), "cluster").withColumn("inertia", F.lit(sum(sums.values())).cast("bigint"))
    return made.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
