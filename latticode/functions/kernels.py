"""NumPy helpers for one Arrow batch: what a task does with the rows it holds.

Vectors are rows of a double matrix. A code table is a sorted list of 2**bits
centroids; a sign sketch is the one-bit code with centroids -1 and +1, so
packing, unpacking and table scoring serve both.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIGNS = (-1.0, 1.0)
COORDINATE_DECIMALS = 12
CHUNK_CELLS = 1 << 17


def next_power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def sign_flips(seed: int, dim: int) -> np.ndarray:
    """The +1/-1 vector of a seed."""
    return 1.0 - 2.0 * np.random.default_rng(seed).integers(0, 2, size=dim)


def hadamard(order: int) -> np.ndarray:
    """Dense Hadamard matrix in natural order: (-1) ** popcount(i & j)."""
    i = np.arange(order)
    return 1.0 - 2.0 * (np.bitwise_count(i[:, None] & i[None, :]) & 1)


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal transform of every row, as small matrix products.

    The big matrix is a Kronecker product of blocks of at most 64 x 64. Each
    pass multiplies the last axis by one block and moves it to the front, so
    after all passes the coordinates are back in their order.
    """
    n, dim = rows.shape
    left = dim
    while left > 1:
        block = min(left, 64)
        rows = rows.reshape(-1, block) @ hadamard(block)
        rows = np.swapaxes(rows.reshape(n, dim // block, block), 1, 2).reshape(n, dim)
        left //= block
    return rows / np.sqrt(dim)


def pad(rows: np.ndarray, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    out[:, : rows.shape[1]] = rows
    return out


def rotate(rows: np.ndarray, seed: int) -> np.ndarray:
    dim = next_power_of_two(rows.shape[1])
    return walsh_hadamard(pad(rows, dim) * sign_flips(seed, dim))


def unrotate(rows: np.ndarray, seed: int, dim: int) -> np.ndarray:
    return (walsh_hadamard(rows) * sign_flips(seed, rows.shape[1]))[:, :dim]


def normalize(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def nearest(rows: np.ndarray, centroids) -> np.ndarray:
    """Index of the nearest centroid; a value on a border takes the lower one.

    Values are compared at COORDINATE_DECIMALS, so that one that is a border
    up to rounding (often exactly 0) is on it in whatever order sums ran.
    """
    c = np.asarray(centroids)
    rows = np.round(rows, COORDINATE_DECIMALS)
    codes = np.zeros(rows.shape, dtype=np.uint8)
    for border in (c[1:] + c[:-1]) / 2:
        codes += rows > border
    return codes


def slots_per_byte(bits: int) -> int:
    if bits not in (1, 2, 4):
        raise ValueError(f"codes of {bits} bits cannot be packed; use 1, 2 or 4")
    return 8 // bits


def check_packable(dim: int, bits: int) -> int:
    """Bytes per vector, or an error if the codes do not fill whole bytes."""
    slots = slots_per_byte(bits)
    if dim % slots:
        raise ValueError(f"{dim} codes of {bits} bits do not fill whole bytes")
    return dim // slots


def _shifts(bits: int) -> np.ndarray:
    return np.arange(8 - bits, -1, -bits, dtype=np.uint8)


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes to bytes, first code in the high bits."""
    width = check_packable(codes.shape[1], bits)
    packed = np.zeros((len(codes), width), dtype=np.uint8)
    for slot, shift in enumerate(_shifts(bits)):
        packed |= codes[:, slot :: 8 // bits] << shift
    return packed


def byte_codes(bits: int) -> np.ndarray:
    """The codes held by each of the 256 byte values."""
    slots_per_byte(bits)
    values = np.arange(256, dtype=np.uint8)[:, None]
    return (values >> _shifts(bits)) & np.uint8((1 << bits) - 1)


def unpack(packed: np.ndarray, bits: int, values=None) -> np.ndarray:
    """Bytes to codes, or to `values[code]` if a table is given."""
    table = byte_codes(bits)
    if values is not None:
        table = np.asarray(values)[table]
    return table[packed].reshape(len(packed), packed.shape[1] * table.shape[1])


def partial_products(rotated_query: np.ndarray, bits: int, values) -> np.ndarray:
    """Query lookup table, one row per byte position and 256 columns."""
    by_byte = np.asarray(values)[byte_codes(bits)]
    return rotated_query.reshape(-1, by_byte.shape[1]) @ by_byte.T


def table_scores(packed: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum over positions of table[position, byte]."""
    total = np.zeros(len(packed))
    for products, column in zip(table, np.ascontiguousarray(packed.T)):
        total += products.take(column)
    return total


# Arrow arrays to matrices and back.


def in_chunks(array: pa.Array, dim: int, apply):
    """`apply` to slices whose matrices of `dim` doubles fit a processor cache."""
    step = max(64, CHUNK_CELLS // max(1, dim))
    parts = [apply(array.slice(at, step)) for at in range(0, max(1, len(array)), step)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def over_valid(array: pa.Array, apply):
    """`apply` to the non-null rows; null rows stay null."""
    if array.null_count == 0:
        return apply(array)
    valid = array.is_valid().to_numpy(zero_copy_only=False)
    position = pa.array(np.cumsum(valid) - 1, mask=~valid)
    return apply(array.drop_null()).take(position)


def list_matrix(array: pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors as matrix rows; all must have `dim` coordinates, or as many as
    the first one has."""
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(lengths[0]) if lengths.size else 0
    wrong = lengths[lengths != dim]
    if wrong.size:
        raise ValueError(f"expected vectors of dimension {dim}, found {wrong[0]}")
    values = array.flatten()
    if values.null_count:
        raise ValueError("a vector holds a null coordinate")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), dim)


def matrix_list(rows: np.ndarray, value_type: pa.DataType) -> pa.Array:
    n, dim = rows.shape
    offsets = np.arange(0, n * dim + 1, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32)
    values = pa.array(np.ascontiguousarray(rows).reshape(-1)).cast(value_type)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def byte_matrix(array: pa.Array, width: int) -> np.ndarray:
    fixed = array.cast(pa.binary(width))
    data = np.frombuffer(fixed.buffers()[1] or b"", dtype=np.uint8)
    start = fixed.offset * width
    return data[start : start + len(fixed) * width].reshape(len(fixed), width)


def matrix_bytes(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    data = pa.py_buffer(np.ascontiguousarray(rows, dtype=np.uint8))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, data]).cast(pa.binary())


def byte_lists(array: pa.Array) -> pa.Array:
    """Bytes as lists of numbers, from the buffers as they are; no nulls."""
    array = array.cast(pa.large_binary())
    ends = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].astype(np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends - ends[0]), pa.array(data)).cast(pa.list_(pa.int32()))
