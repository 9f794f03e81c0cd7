"""k-means: oversampled seeding in a few rounds, then steps of assigning and averaging.

Only centers come to the driver: a step returns one row per cluster, and a
seeding round about `OVERSAMPLE` times as many points as there are clusters.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticode.functions import kernels as k

ROUNDS = 5
OVERSAMPLE = 2.0
#: Squared distances are compared at this precision; the first of equals wins.
DECIMALS = 9


def nearest(vector: Column, centers: np.ndarray) -> Column:
    """struct(cluster, cost): the nearest center and its squared distance."""
    centers = np.asarray(centers, dtype=float)
    half = np.square(centers).sum(axis=1)

    @F.arrow_udf("struct<cluster: int, cost: double>")
    def find(col: pa.Array) -> pa.Array:
        def apply(c: pa.Array) -> pa.Array:
            rows = k.list_matrix(c, centers.shape[1])
            cost = np.round(np.maximum(np.square(rows).sum(axis=1)[:, None] - 2 * rows @ centers.T + half, 0), DECIMALS)
            best = cost.argmin(axis=1)
            return pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(cost[np.arange(len(rows)), best])],
                                              ["cluster", "cost"])

        return k.over_valid(col, lambda c: k.in_chunks(c, max(centers.shape), apply))

    return find(vector)


def lloyd_step(points: DataFrame, centers: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """(cluster, n, center, cost): members, their mean and their squared distance
    from the old center. Clusters without members have no row. Means are summed
    up before they are shuffled, so a cluster of any size is a row per task."""
    rows = points.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v"), nearest(F.col(vector_col), centers).alias("at"))
    vector = array_to_vector(F.col("v").cast("array<double>"))
    return (rows.groupBy(F.col("at.cluster").alias("cluster"))
            .agg(F.count("*").alias("n"), Summarizer.mean(vector).alias("m"), F.sum("at.cost").alias("cost"))
            .select("cluster", "n", vector_to_array("m").alias("center"), "cost"))


def _chosen(rate: Column, key: str, seed: int, number: int) -> Column:
    """Whether a draw that seed, round and key decide falls below the rate."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(number), F.col(key)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    return draw < rate


def seed_centers(points: DataFrame, clusters: int, *, key: str = "id", vector_col: str = "embedding", seed: int = 11,
                 rounds: int = ROUNDS, oversample: float = OVERSAMPLE) -> np.ndarray:
    """At most `clusters` different centers. In each round a point is chosen with
    a chance of `oversample` * clusters times its share of the cost so far; the
    chosen points, weighted by how many points are nearest to them, are then
    thinned out on the driver. Fewer different points give fewer centers."""
    rows = points.where(F.col(vector_col).isNotNull()).select(F.col(key).alias("key"), F.col(vector_col).cast("array<double>").alias("v"))
    first = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(1).collect()
    if not first:
        raise ValueError("k-means of an empty table")
    centers = np.array([first[0].v])
    for number in range(rounds):
        costed = rows.withColumn("cost", nearest(F.col("v"), centers)["cost"])
        total = costed.agg(F.sum("cost")).first()[0]
        if not total:
            break
        picked = costed.where(_chosen(F.lit(oversample * clusters / total) * F.col("cost"), "key", seed, number))
        more = [r.v for r in picked.select("v").distinct().collect()]  # about oversample * clusters
        centers = np.unique(np.concatenate([centers, np.array(more).reshape(len(more), centers.shape[1])]), axis=0)
    weight = np.zeros(len(centers))
    for r in rows.groupBy(nearest(F.col("v"), centers)["cluster"].alias("c")).agg(F.count("*").alias("n")).collect():
        weight[r.c] = r.n
    return _thinned(centers, weight, clusters, np.random.default_rng(seed))


def _thinned(points: np.ndarray, weight: np.ndarray, clusters: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ over few points."""
    chosen = [int(weight.argmax())]
    cost = np.square(points - points[chosen[0]]).sum(axis=1)
    while len(chosen) < clusters and (weight * cost).sum() > 0:
        chosen.append(int(rng.choice(len(points), p=weight * cost / (weight * cost).sum())))
        cost = np.minimum(cost, np.square(points - points[chosen[-1]]).sum(axis=1))
    return points[chosen]


def fit(points: DataFrame, clusters: int, *, key: str = "id", vector_col: str = "embedding", seed: int = 11, steps: int = 10,
        tolerance: float = 1e-6, **seeding) -> np.ndarray:
    """Centers after seeding and at most `steps` steps, or until none moves by
    more than `tolerance`; a cluster without members keeps its center."""
    centers = seed_centers(points, clusters, key=key, vector_col=vector_col, seed=seed, **seeding)
    for _ in range(steps):
        moved = centers.copy()
        for r in lloyd_step(points, centers, vector_col).collect():  # one row per cluster
            moved[r.cluster] = r.center
        shift = np.abs(moved - centers).max()
        centers = moved
        if shift <= tolerance:
            break
    return centers
