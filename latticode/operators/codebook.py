"""Codebooks: the centroids every coordinate is rounded to.

A codebook depends on the dimension only. It is the weighted 1-D k-means of
the Beta((d-1)/2, (d-1)/2) law on [-1, 1], which a coordinate of a random unit
vector follows, evaluated on a grid instead of drawn at random, so that every
fit gives the same numbers.
"""

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "dim int, bits int, idx int, centroid double"
BITS = (1, 2, 3, 4)
BINS = 1 << 16
MAX_STEPS = 100_000


def coordinate_grid(spark: SparkSession, dim: int, points: int = BINS) -> DataFrame:
    """Grid (x, w) of the coordinate law of a random unit vector."""
    if dim < 2:
        raise ValueError("a coordinate law needs at least two dimensions")
    x = (F.col("id") + 0.5) * (2.0 / points) - 1.0
    return spark.range(points).select(x.alias("x")).withColumn(
        "w", F.pow(1.0 - F.col("x") * F.col("x"), F.lit((dim - 3) / 2)))


def cell(x: Column, centroids: Sequence[float]) -> Column:
    """Index of the nearest centroid: the number of borders below x."""
    borders = [(a + b) / 2 for a, b in zip(centroids, centroids[1:])]
    return reduce(lambda n, border: n + (x > border).cast("int"), borders, F.lit(0))


def value(code: Column, centroids: Sequence[float]) -> Column:
    """Centroid of a code, by array position."""
    return F.element_at(F.array(*[F.lit(float(c)) for c in centroids]), code + 1)


def lloyd_step(points: DataFrame, tables: dict[int, Sequence[float]]) -> DataFrame:
    """One k-means step for several tables over the same points (x, w).

    Returns (bits, idx, weight, centroid, spread), `spread` being the weighted
    squared distance to the old centroid. Points meet in at most
    sum(2**bits) groups after a map-side sum.
    """
    assigned = points.select(F.inline(F.array(*[
        F.struct(F.lit(bits).alias("bits"), cell(F.col("x"), c).alias("idx"),
                 value(cell(F.col("x"), c), c).alias("old"), F.col("x"), F.col("w"))
        for bits, c in tables.items()])))
    return assigned.groupBy("bits", "idx").agg(
        F.sum("w").alias("weight"),
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("centroid"),
        F.sum(F.col("w") * F.pow(F.col("x") - F.col("old"), 2)).alias("spread"))


def _kmeans(width: tuple, bins: pd.DataFrame) -> pd.DataFrame:
    """1-D k-means of one histogram (x, w) into 2**bits cells."""
    bits, bins = int(width[0]), bins.sort_values("x")
    x, w = bins["x"].to_numpy(), bins["w"].to_numpy()
    mass = np.concatenate([[0.0], np.cumsum(w)])
    moment = np.concatenate([[0.0], np.cumsum(w * x)])
    # A good quantizer spaces its centroids by the cube root of the density.
    spacing = np.cumsum(np.cbrt(w))
    wanted = (np.arange(2 ** bits) + 0.5) / 2 ** bits * spacing[-1]
    centers = x[np.searchsorted(spacing, wanted)]
    for _ in range(MAX_STEPS):
        borders = np.searchsorted(x, (centers[1:] + centers[:-1]) / 2, side="right")
        edges = np.concatenate([[0], borders, [len(x)]])
        if (np.diff(edges) == 0).any():
            raise ValueError(f"{bits} bits: the points do not support {2 ** bits} centroids")
        moved = np.diff(moment[edges]) / np.diff(mass[edges])
        done = np.abs(moved - centers).max() < 1e-12
        centers = moved
        if done:
            break
    return pd.DataFrame({"bits": bits, "idx": np.arange(2 ** bits), "centroid": centers})


def fit(points: DataFrame, dim: int, bits: Sequence[int] = BITS, bins: int = BINS) -> DataFrame:
    """Weighted 1-D k-means of any number of points (x, w), x in [-1, 1].

    The points are summed into at most `bins` cells; then every bit width is
    one group of that many rows, whatever the number of points was.
    """
    bin_of = F.floor((F.col("x") + 1.0) * (bins / 2))
    histogram = (points.where(F.col("w") > 0)
                 .groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), bin_of)).alias("bin"))
                 .agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))
                 .select((F.col("wx") / F.col("w")).alias("x"), "w"))
    widths = F.explode(F.array(*[F.lit(int(b)) for b in bits])).alias("bits")
    fitted = histogram.select("x", "w", widths).groupBy("bits").applyInPandas(
        _kmeans, "bits int, idx int, centroid double")
    return fitted.select(F.lit(dim).alias("dim"), "bits", "idx", "centroid")


def fit_codebook(spark: SparkSession, dim: int, bits: Sequence[int] = BITS, points: int = BINS) -> DataFrame:
    """Codebook table (dim, bits, idx, centroid) for rotated vectors of `dim`.

    The fit is run once here; the result is a table of a few dozen literals.
    """
    fitted = fit(coordinate_grid(spark, dim, points), dim, bits, points).orderBy("bits", "idx")
    return spark.createDataFrame(fitted.collect(), SCHEMA)


def centroids(codebook: DataFrame | Sequence[float], dim: int, bits: int) -> tuple[float, ...]:
    """The sorted centroids of one width: at most 2**bits rows are fetched."""
    if isinstance(codebook, DataFrame):
        rows = (codebook.where((F.col("dim") == dim) & (F.col("bits") == bits))
                .orderBy("idx").select("centroid").limit(2 ** bits + 1).collect())
        codebook = [r.centroid for r in rows]
    table = tuple(float(c) for c in codebook)
    if len(table) != 2 ** bits or list(table) != sorted(set(table)):
        raise ValueError(f"codebook for dimension {dim}: expected {2 ** bits} sorted "
                         f"centroids for {bits} bits, found {len(table)}")
    return table
