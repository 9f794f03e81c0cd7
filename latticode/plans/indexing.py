"""Index jobs: build one from an embeddings table, and verify one."""

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticode.functions import kernels as k
from latticode.operators import index as ix
from latticode.operators.codebook import centroids
from latticode.operators.rows import cap_rows
from latticode.sources import tables


def create_index(spark: SparkSession, source: str, base: str, codebook: DataFrame, n_bits: int = 4, *,
                 mse_seed: int = ix.MSE_SEED, qjl_seed: int = ix.QJL_SEED, with_qjl: bool = False,
                 full_data: bool = False, max_rows: int | None = None, mode: str = "errorifexists",
                 rows_per_file: int | None = None, files: str | int = "as_is", normalize: bool = True,
                 residual_sign: str = "unbiased", codebook_dim: int | None = None, id_col: str = "id",
                 vector_col: str = "embedding", skip_non_finite: bool = False) -> str:
    """Embeddings Parquet to index Parquet; returns the path, which is named
    after the parameters. An index is several times smaller than its input, so
    for a large one `files` should be a number of full-sized output files."""
    embeddings = cap_rows(tables.read_table(spark, source, [id_col, vector_col]), max_rows, id_col)
    index = ix.build_index(embeddings, codebook, n_bits, id_col=id_col, vector_col=vector_col, mse_seed=mse_seed,
                           qjl_seed=qjl_seed, with_qjl=with_qjl, full_data=full_data, normalize=normalize,
                           residual_sign=residual_sign, codebook_dim=codebook_dim, skip_non_finite=skip_non_finite)
    path = tables.index_path(base, n_bits, mse_seed, qjl_seed if with_qjl else None, full_data)
    tables.write_table(index, path, mode=mode, rows_per_file=rows_per_file, files=files)
    return path


def verify_index(index: DataFrame, codebook: DataFrame | Sequence[float], n_bits: int, dim: int,
                 tolerance: float = 1e-5, codebook_dim: int | None = None) -> DataFrame:
    """Checks over the `n_bits` rows of a full-data index, one row per seed:
    largest error of undoing the rotation, whether it is within `tolerance`, rows
    whose packed bytes do not unpack to their codes, and the mean squared error
    of the stored vectors. The seeds of the table are read first, a small job."""
    wide = k.next_power_of_two(dim)
    table = centroids(codebook, codebook_dim or wide, n_bits)
    own = index.where(F.col("n_bits") == n_bits)
    seeds = sorted(r.mse_seed for r in own.select("mse_seed").distinct().collect()) or [ix.MSE_SEED]
    return reduce(DataFrame.unionByName, [
        _verify(own.where(F.col("mse_seed") == seed), seed, table, n_bits, dim, tolerance) for seed in seeds])


def _verify(index: DataFrame, seed: int, table: Sequence[float], n_bits: int, dim: int,
            tolerance: float) -> DataFrame:
    table = tuple(table)

    @F.arrow_udf("struct<error: double, wrong: int, squared: double>")
    def checked(embedding: pa.Array, rotated: pa.Array, codes: pa.Array, packed: pa.Array) -> pa.Array:
        rows = k.list_matrix(embedding, dim)
        undone = k.unrotate(k.list_matrix(rotated), seed, dim)
        unpacked = k.unpack(k.byte_matrix(packed, k.check_packable(k.next_power_of_two(dim), n_bits)), n_bits)
        rest = rows - k.unrotate(np.asarray(table)[unpacked], seed, dim)
        wrong = pc.not_equal(codes, k.matrix_bytes(unpacked)).cast(pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(np.abs(undone - rows).max(axis=1, initial=0)), wrong,
             pa.array(np.einsum("ij,ij->i", rest, rest))], names=["error", "wrong", "squared"])

    rows = index.select(checked("embedding", "rotated", "codes", "packed").alias("row"))
    return rows.agg(
        F.lit(seed).alias("mse_seed"), F.count("*").alias("rows"), F.max("row.error").alias("max_error"),
        F.sum("row.wrong").alias("wrong_codes"), F.avg("row.squared").alias("mean_squared_error"),
    ).withColumn("invertible", F.col("max_error") <= tolerance)
