"""Vector columns (`array<float>` or `array<double>`), computed in double."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from latticode.functions import kernels as k

VECTOR = ArrayType(DoubleType())


# Arrow functions rather than lambdas over arrays: lambdas are interpreted per
# element, and cannot take the result of another Arrow function.


@F.arrow_udf(VECTOR)
def _unit(v: pa.Array) -> pa.Array:
    return k.over_valid(v, lambda c: k.matrix_list(k.normalize(k.list_matrix(c)), pa.float64()))


@F.arrow_udf(DoubleType())
def _length(v: pa.Array) -> pa.Array:
    def apply(c):
        rows = k.list_matrix(c)
        return pa.array(np.sqrt(np.einsum("ij,ij->i", rows, rows)))

    return k.over_valid(v, apply)


def _pairwise(a: pa.Array, b: pa.Array, apply) -> pa.Array:
    """`apply` to the two matrices; a row is null where either vector is."""
    both = pa.StructArray.from_arrays([a, b], ["a", "b"], mask=pc.or_(a.is_null(), b.is_null()))
    return k.over_valid(both, lambda c: apply(k.list_matrix(c.field("a")), k.list_matrix(c.field("b"))))


@F.arrow_udf(VECTOR)
def _difference(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(a, b, lambda x, y: k.matrix_list(x - y, pa.float64()))


@F.arrow_udf(DoubleType())
def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(a, b, lambda x, y: pa.array(np.einsum("ij,ij->i", x, y)))


@F.arrow_udf(DoubleType())
def _farthest(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(a, b, lambda x, y: pa.array(np.abs(x - y).max(axis=1, initial=0.0)))


def l2_normalize(v: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    return _unit(v)


def norm(v: Column) -> Column:
    return _length(v)


def subtract(a: Column, b: Column) -> Column:
    return _difference(a, b)


def dot(a: Column, b: Column) -> Column:
    return _dot(a, b)


def max_abs_difference(a: Column, b: Column) -> Column:
    return _farthest(a, b)


def pad_zeros(v: Column, dim: int) -> Column:
    """Zeros appended up to `dim` coordinates; a longer vector is an error."""
    v = v.cast("array<double>")
    longer = F.concat(F.lit(f"vector is longer than {dim}: "), F.size(v).cast("string"))
    return F.when(F.size(v) > dim, F.raise_error(longer).cast("array<double>")).otherwise(
        F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(v))))


def rotate(v: Column, seed: int, dim: int | None = None) -> Column:
    """Zero-pad vectors (of `dim`, if given) to a power of two, flip signs,
    transform."""

    @F.arrow_udf(VECTOR)
    def rotated(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.matrix_list(
            k.rotate(k.list_matrix(c, dim), seed), pa.float64()))

    return rotated(v)


def unrotate(v: Column, seed: int, dim: int) -> Column:
    """Inverse of `rotate`; the result has `dim` coordinates again."""
    wide = k.next_power_of_two(dim)

    @F.arrow_udf(VECTOR)
    def restored(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.matrix_list(
            k.unrotate(k.list_matrix(c, wide), seed, dim), pa.float64()))

    return restored(v)
