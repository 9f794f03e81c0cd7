"""Quantized index: rotate, round, pack and sketch every vector of a table."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticode.functions import kernels as k
from latticode.operators.codebook import centroids

MSE_SEED = 42
QJL_SEED = 24


def vector_dim(df: DataFrame, vector_col: str = "embedding") -> int | None:
    """Dimension of the first vector; None for an empty table. Every batch is
    checked against it later, so this reads one row and not the table."""
    row = df.where(F.col(vector_col).isNotNull()).select(F.size(vector_col)).first()
    return None if row is None else row[0]


def check_dimensions(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Number of vectors per dimension: a sound table has one row."""
    return df.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("vectors"))


def index_columns(with_qjl: bool, full_data: bool) -> list[tuple[str, str]]:
    """Column names and types the encoder fills, by flags."""
    columns = [("packed", "binary")]
    if with_qjl:
        columns += [("gamma", "float"), ("qjl_bits", "binary")]
    if full_data:
        columns += [("embedding", "array<float>"), ("rotated", "array<float>"), ("codes", "binary")]
        if with_qjl:
            columns += [("residual", "array<float>"), ("recovered", "array<float>")]
    return columns


def encode_vectors(vector: Column, table: Sequence[float], n_bits: int, dim: int, *,
                   mse_seed: int = MSE_SEED, qjl_seed: int = QJL_SEED, with_qjl: bool = True,
                   full_data: bool = False, normalize: bool = True,
                   residual_sign: str = "unbiased") -> Column:
    """All index columns of a vector as one struct: a row goes to Python once."""
    if residual_sign not in ("unbiased", "reference"):
        raise ValueError("residual_sign must be 'unbiased' or 'reference'")
    k.check_packable(k.next_power_of_two(dim), n_bits)
    if with_qjl:
        k.check_packable(k.next_power_of_two(dim), 1)
    table = tuple(table)
    columns = index_columns(with_qjl, full_data)

    def fields(rows: np.ndarray) -> dict[str, pa.Array]:
        rows = k.normalize(rows) if normalize else rows
        rotated = k.rotate(rows, mse_seed)
        codes = k.nearest(rotated, table)
        out = {"packed": k.matrix_bytes(k.pack(codes, n_bits))}
        if with_qjl:
            recovered = k.unrotate(np.asarray(table)[codes], mse_seed, dim)
            residual = rows - recovered if residual_sign == "unbiased" else recovered - rows
            out["gamma"] = pa.array(np.sqrt(np.einsum("ij,ij->i", residual, residual)).astype(np.float32))
            out["qjl_bits"] = k.matrix_bytes(k.pack(k.nearest(k.rotate(residual, qjl_seed), k.SIGNS), 1))
        if full_data:
            out["embedding"] = k.matrix_list(rows, pa.float32())
            out["rotated"] = k.matrix_list(rotated, pa.float32())
            out["codes"] = k.matrix_bytes(codes)
            if with_qjl:
                out["residual"] = k.matrix_list(residual, pa.float32())
                out["recovered"] = k.matrix_list(recovered, pa.float32())
        return out

    @F.arrow_udf("struct<" + ", ".join(f"{name}: {kind}" for name, kind in columns) + ">")
    def encoded(col: pa.Array) -> pa.Array:
        def apply(vectors: pa.Array) -> pa.Array:
            rows = k.list_matrix(vectors, dim)
            if not np.isfinite(rows).all():
                raise ValueError("a vector holds a coordinate that is not finite")
            out = fields(rows)
            return pa.StructArray.from_arrays([out[name] for name, _ in columns],
                                              names=[name for name, _ in columns])

        return k.over_valid(col, lambda c: k.in_chunks(c, dim, apply))

    return encoded(vector)


def build_index(df: DataFrame, codebook: DataFrame | Sequence[float], n_bits: int = 4, *,
                id_col: str = "id", vector_col: str = "embedding",
                mse_seed: int = MSE_SEED, qjl_seed: int = QJL_SEED, with_qjl: bool = True,
                full_data: bool = False, normalize: bool = True,
                residual_sign: str = "unbiased", dim: int | None = None,
                codebook_dim: int | None = None, skip_non_finite: bool = False) -> DataFrame:
    """Index (id, packed[, gamma, qjl_bits][, full data], n_bits, mse_seed, qjl_seed).

    A map over the rows: no shuffle, and rows of `df` without a vector are left
    out. A coordinate that is not finite is an error, or with `skip_non_finite`
    leaves its row out. The codebook is taken for the rotated dimension, or for
    `codebook_dim`.
    """
    dim = dim or vector_dim(df, vector_col)
    if dim is None:  # an empty table has an empty index, whatever its dimension
        dim = codebook_dim or (codebook.first().dim if isinstance(codebook, DataFrame) else 8)
    table = centroids(codebook, codebook_dim or k.next_power_of_two(dim), n_bits)
    encoded = encode_vectors(
        F.col(vector_col), table, n_bits, dim, mse_seed=mse_seed, qjl_seed=qjl_seed,
        with_qjl=with_qjl, full_data=full_data, normalize=normalize, residual_sign=residual_sign)
    if skip_non_finite:
        df = df.where(F.forall(vector_col, lambda x: F.abs(x) < float("inf")))  # NaN is larger than all
    return (
        df.where(F.col(vector_col).isNotNull())
        .select(F.col(id_col).alias("id"), encoded.alias("code"))
        .select("id", "code.*", F.lit(n_bits).alias("n_bits"), F.lit(mse_seed).alias("mse_seed"),
                F.lit(qjl_seed if with_qjl else None).cast("int").alias("qjl_seed")))
