"""Code columns: one byte per code, or codes packed into bytes (`binary`)."""

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from latticode.functions import kernels as k


def quantize(v: Column, centroids: Sequence[float], dim: int) -> Column:
    """Nearest centroid of every coordinate, one byte per code."""
    table = tuple(centroids)

    @F.arrow_udf("binary")
    def codes(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.matrix_bytes(k.nearest(k.list_matrix(c, dim), table)))

    return codes(v)


def pack(codes: Column, bits: int, dim: int) -> Column:
    """`dim` codes to dim * bits / 8 bytes, first code in the high bits."""
    k.check_packable(dim, bits)

    @F.arrow_udf("binary")
    def packed(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.matrix_bytes(k.pack(k.byte_matrix(c, dim), bits)))

    return packed(codes)


def unpack(packed: Column, bits: int, dim: int) -> Column:
    """Packed bytes back to one byte per code."""
    width = k.check_packable(dim, bits)

    @F.arrow_udf("binary")
    def codes(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.matrix_bytes(k.unpack(k.byte_matrix(c, width), bits)))

    return codes(packed)


def centroid_values(packed: Column, centroids: Sequence[float], bits: int, dim: int) -> Column:
    """Packed bytes to centroid coordinates (still rotated)."""
    width, table = k.check_packable(dim, bits), tuple(centroids)

    @F.arrow_udf("array<double>")
    def values(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.matrix_list(
            k.unpack(k.byte_matrix(c, width), bits, table), pa.float64()))

    return values(packed)


def dequantize(packed: Column, centroids: Sequence[float], bits: int, seed: int, dim: int) -> Column:
    """Packed bytes to the approximate vector of `dim` coordinates."""
    width, table = k.check_packable(k.next_power_of_two(dim), bits), tuple(centroids)

    @F.arrow_udf("array<double>")
    def vectors(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.matrix_list(
            k.unrotate(k.unpack(k.byte_matrix(c, width), bits, table), seed, dim), pa.float64()))

    return vectors(packed)


def squared_errors(v: Column, tables: Mapping[int, Sequence[float]], seed: int, dim: int) -> Column:
    """Squared distance of a vector, at length one, from what is stored of it:
    a struct with a field `bits_<n>` per table. One function does it all, since
    every task has a Python process for each of several that it needs."""
    tables = {bits: tuple(table) for bits, table in tables.items()}
    for bits in tables:
        k.check_packable(k.next_power_of_two(dim), bits)
    names = [f"bits_{bits}" for bits in tables]

    def apply(vectors: pa.Array) -> pa.Array:
        unit = k.normalize(k.list_matrix(vectors, dim))
        rotated, errors = k.rotate(unit, seed), []
        for bits, table in tables.items():
            stored = k.pack(k.nearest(rotated, table), bits)
            rest = unit - k.unrotate(k.unpack(stored, bits, table), seed, dim)
            errors.append(pa.array(np.einsum("ij,ij->i", rest, rest)))
        return pa.StructArray.from_arrays(errors, names=names)

    @F.arrow_udf("struct<" + ", ".join(f"{name}: double" for name in names) + ">")
    def squared(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.in_chunks(c, dim, apply))

    return squared(v)


def sign_sketch(v: Column, seed: int, dim: int) -> Column:
    """Sign bits (1 if > 0) of the rotated vector, most significant bit first."""
    k.check_packable(k.next_power_of_two(dim), 1)

    @F.arrow_udf("binary")
    def bits(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: k.matrix_bytes(k.pack(
            k.nearest(k.rotate(k.list_matrix(c, dim), seed), k.SIGNS), 1)))

    return bits(v)


def byte_values(data: Column) -> Column:
    """Unsigned bytes of a binary column as `array<int>`."""

    @F.arrow_udf("array<int>")
    def values(col: pa.Array) -> pa.Array:
        return k.over_valid(col, k.byte_lists)

    return values(data)
