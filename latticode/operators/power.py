"""PCA of long vectors by passes with a block of directions.

The covariance of d coordinates is a d x d matrix; here only d x r matrices
exist, r being the components asked for and a few more. A random block of
directions is sharpened in passes: each multiplies it by the covariance, task
by task, and the driver makes the block orthonormal again. The covariance
within the last block is r x r, and its eigenvectors give the components.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticode.functions import kernels as k
from latticode.operators.index import vector_dim

#: Directions beyond those asked for, and passes that sharpen them.
OVERSAMPLE, PASSES = 10, 6


@dataclass(frozen=True)
class BlockPca:
    """Mean, orthonormal columns of loadings, and the variance along each."""

    mean: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def ratios(self) -> list[float]:
        return [float(v / self.total) if self.total else 0.0 for v in self.variances]


def moments(points: DataFrame, vector_col: str = "embedding") -> tuple[int, np.ndarray, float]:
    """(vectors, mean, sum of the variances of all coordinates), null vectors left out."""
    vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    summary = Summarizer.metrics("count", "mean", "variance").summary(vector)
    row = points.where(F.col(vector_col).isNotNull()).agg(summary.alias("s")).first()["s"]
    return int(row["count"]), row["mean"].toArray(), float(row["variance"].toArray().sum())


def covariance_times(points: DataFrame, mean: np.ndarray, block: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """(coordinate, image): the rows of X'X times the block, X being the vectors
    without their mean.

    A task adds up its vectors and sends one row per coordinate, so that the
    shuffle grows with the tasks and not with the vectors. The block goes to
    every task: d x r numbers, whatever the table holds.
    """
    dim = len(mean)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, step = np.zeros(block.shape), max(64, k.CHUNK_CELLS // max(1, dim))
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), step):
                rows = k.list_matrix(column.slice(at, step), dim) - mean
                total += rows.T @ (rows @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), k.matrix_list(total, pa.float64())],
                                         ["coordinate", "image"])

    sums = (points.where(F.col(vector_col).isNotNull()).select(vector_col)
            .mapInArrow(partial, "coordinate int, image array<double>"))
    return sums.groupBy("coordinate").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("image")))).alias("image"))


def _image(points: DataFrame, mean: np.ndarray, block: np.ndarray, vector_col: str) -> np.ndarray:
    rows = covariance_times(points, mean, block, vector_col).collect()  # one row per coordinate
    return np.array([r.image for r in sorted(rows, key=lambda r: r.coordinate)])


def fit_block_pca(points: DataFrame, components: int = 200, vector_col: str = "embedding", oversample: int = OVERSAMPLE,
                  passes: int = PASSES, seed: int = 17) -> BlockPca:
    """The first components; no more than there are coordinates.

    Exact where components and `oversample` reach the number of coordinates.
    Otherwise what is missing shrinks with every pass by the ratio of the
    variances around the end of the block. The largest loading of a component is
    positive. The table is read `passes` + 2 times.
    """
    dim = vector_dim(points, vector_col)
    if dim is None:
        raise ValueError("PCA of an empty table")
    count, mean, total = moments(points, vector_col)
    width = min(dim, components + oversample)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    for _ in range(passes if width < dim else 0):
        block = np.linalg.qr(_image(points, mean, block, vector_col))[0]
    within = block.T @ _image(points, mean, block, vector_col)
    values, turn = np.linalg.eigh((within + within.T) / 2)
    first = np.argsort(-values, kind="stable")[:components]
    loadings = block @ turn[:, first]
    loadings *= np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    return BlockPca(mean, loadings, np.maximum(values[first], 0) / max(1, count - 1), total)


def project(df: DataFrame, pca: BlockPca, components: int, vector_col: str = "embedding",
            output_col: str = "projected") -> DataFrame:
    """`output_col array<double>`: the first components of every vector, null for null."""
    mean, loadings = pca.mean, pca.loadings[:, :components]

    @F.arrow_udf("array<double>")
    def apply(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.in_chunks(
            c, len(mean), lambda part: k.matrix_list((k.list_matrix(part, len(mean)) - mean) @ loadings, pa.float64())))

    return df.withColumn(output_col, apply(F.col(vector_col)))
