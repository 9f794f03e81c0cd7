"""PCA and clustering of a vector table with pyspark.ml."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticode.operators.index import vector_dim

THRESHOLDS = (0.7, 0.8, 0.9)


@dataclass(frozen=True)
class CenteredPca:
    """A PCA model, and per component the sign and offset that center its output.

    `pyspark.ml`'s model does not subtract the mean when it transforms. Signs
    make the largest loading of a component positive, so fits are comparable.
    """

    model: PCAModel
    signs: tuple[float, ...]
    offsets: tuple[float, ...]

    @property
    def ratios(self) -> list[float]:
        return [float(r) for r in self.model.explainedVariance]


def fit_pca(df: DataFrame, components: int = 200, vector_col: str = "embedding") -> CenteredPca:
    """PCA with at most `components` components (no more than coordinates)."""
    dim = vector_dim(df, vector_col)
    if dim is None:
        raise ValueError("PCA of an empty table")
    points = df.where(F.col(vector_col).isNotNull()).select(
        array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    model = PCA(k=min(components, dim), inputCol="features", outputCol="projected").fit(points)
    mean = points.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    return CenteredPca(model, tuple(map(float, signs)), tuple(map(float, loadings.T @ mean)))


def explained_variance(df: DataFrame, pca: CenteredPca) -> DataFrame:
    """(component, ratio, cumulative), components from 1."""
    ratios = df.sparkSession.createDataFrame(list(enumerate(pca.ratios, 1)), "component int, ratio double")
    # One row per component, so one window partition is enough.
    return ratios.withColumn("cumulative", F.sum("ratio").over(Window.partitionBy().orderBy("component")))


def components_for(variance: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(threshold, components): the count whose cumulative ratio is nearest."""
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return (variance.select("component", "cumulative", wanted)
            .groupBy("threshold")
            .agg(F.min_by("component", F.struct(F.abs(F.col("cumulative") - F.col("threshold")), "component"))
                 .alias("components")))


def project(df: DataFrame, pca: CenteredPca, components: int, vector_col: str = "embedding",
            output_col: str = "projected") -> DataFrame:
    """`output_col array<double>`: the first `components` centered coordinates."""
    features = df.where(F.col(vector_col).isNotNull()).withColumn(
        "features", array_to_vector(F.col(vector_col).cast("array<double>")))
    raw = pca.model.setOutputCol("_raw").transform(features)
    centered = F.zip_with(F.slice(vector_to_array("_raw"), 1, components),
                          F.lit(list(pca.offsets[:components])), lambda x, m: x - m)
    signed = F.zip_with(centered, F.lit(list(pca.signs[:components])), lambda x, s: x * s)
    return raw.withColumn(output_col, signed).drop("_raw", "features")


def cluster(df: DataFrame, vector_col: str, k: int = 10, seed: int = 4321) -> DataFrame:
    """`df` with a `cluster` column from k-means."""
    points = df.withColumn("features", array_to_vector(F.col(vector_col))).persist()
    try:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    finally:
        points.unpersist()
    return model.transform(df.withColumn("features", array_to_vector(F.col(vector_col)))).drop("features")
