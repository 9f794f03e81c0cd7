"""Properties of the batch helpers."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from checks.fixed import CODEBOOK
from latticode.functions import kernels as k

VALUES = st.floats(-1, 1, width=32)


def matrices(dim=st.integers(1, 200)):
    return st.tuples(st.integers(1, 5), dim).flatmap(lambda s: hnp.arrays(np.float64, s, elements=VALUES))


@settings(max_examples=50, deadline=None)
@given(matrices(), st.integers(0, 1000))
def test_rotation_keeps_length_and_inverts(rows, seed):
    turned = k.rotate(rows, seed)
    assert turned.shape[1] == k.next_power_of_two(rows.shape[1])
    np.testing.assert_allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(rows, axis=1), atol=1e-9)
    np.testing.assert_allclose(k.unrotate(turned, seed, rows.shape[1]), rows, atol=1e-9)


@pytest.mark.parametrize("dim", [1, 2, 64, 128, 512, 8192])
def test_transform_is_the_sign_matrix(dim):
    rows = np.random.default_rng(1).normal(size=(3, dim))
    i = np.arange(dim)[:, None]
    j = np.arange(min(dim, 40))
    matrix = np.where(np.bitwise_count(i & j) % 2, -1.0, 1.0)
    np.testing.assert_allclose(k.walsh_hadamard(rows)[:, : len(j)], rows @ matrix / np.sqrt(dim), atol=1e-9)


def test_signs_are_the_seeded_draw():
    drawn = np.random.default_rng(42).choice([1.0, -1.0], size=512)
    assert (k.sign_flips(42, 512) == drawn).all()


@settings(max_examples=50, deadline=None)
@given(st.sampled_from([1, 2, 4]), st.integers(1, 20), st.integers(0, 99))
def test_pack_inverts(bits, width, seed):
    codes = np.random.default_rng(seed).integers(0, 2 ** bits, (4, width * (8 // bits)), dtype=np.uint8)
    packed = k.pack(codes, bits)
    assert packed.shape == (4, width)
    assert (k.unpack(packed, bits) == codes).all()


def test_pack_order():
    assert k.pack(np.array([[15, 15, 1, 2]], np.uint8), 4).tolist() == [[0xFF, 0x12]]
    assert k.pack(np.array([[1, 0, 0, 0, 0, 0, 0, 1]], np.uint8), 1).tolist() == [[0x81]]
    bits = np.random.default_rng(0).integers(0, 2, (5, 64), dtype=np.uint8)
    assert (k.pack(bits, 1) == np.packbits(bits, axis=1)).all()


@pytest.mark.parametrize("bits", [0, 3, 5, 6, 7, 8])
def test_widths_that_do_not_pack(bits):
    with pytest.raises(ValueError, match="cannot be packed"):
        k.pack(np.zeros((1, 8), np.uint8), bits)
    with pytest.raises(ValueError, match="whole bytes"):
        k.check_packable(7, 4)


def test_border_takes_the_lower_code():
    table = [-0.5, 0.0, 1.0]
    assert k.nearest(np.array([[-0.25, 0.5, -0.2499, 0.5001, 9.0, -9.0]]), table).tolist() == [[0, 1, 1, 2, 2, 0]]
    assert k.nearest(np.array([[0.0, 1e-17, -1e-17, 0.1]]), k.SIGNS).tolist() == [[0, 0, 0, 1]]


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_codes_are_nearest(bits):
    rows = np.random.default_rng(2).normal(size=(50, 64)) / 8
    table = np.array(CODEBOOK[bits])
    assert (k.nearest(rows, table) == np.abs(rows[:, :, None] - table).argmin(axis=2)).all()


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_table_score_is_the_dot_product(bits):
    rng = np.random.default_rng(3)
    rows, query = rng.normal(size=(20, 48)) / 7, rng.normal(size=(1, 48))
    table = CODEBOOK[bits]
    packed = k.pack(k.nearest(k.rotate(rows, 42), table), bits)
    recovered = k.unrotate(k.unpack(packed, bits, table), 42, 64)
    products = k.partial_products(k.rotate(query, 42)[0], bits, table)
    expected = recovered @ k.pad(query, 64)[0]
    np.testing.assert_allclose(k.table_scores(packed, products), expected, atol=1e-12)


def test_arrow_round_trips():
    rows = np.arange(12.0).reshape(3, 4)
    lists = k.matrix_list(rows, pa.float32())
    assert (k.list_matrix(lists, 4) == rows).all()
    assert (k.list_matrix(lists.slice(1, 2), 4) == rows[1:]).all()
    data = rows.astype(np.uint8)
    binary = k.matrix_bytes(data)
    assert (k.byte_matrix(binary, 4) == data).all()
    assert (k.byte_matrix(binary.slice(2), 4) == data[2:]).all()
    assert k.byte_lists(binary.slice(1)).to_pylist() == data[1:].tolist()
    assert k.list_matrix(lists.slice(0, 0), 4).shape == (0, 4)


def test_null_rows_stay_null():
    lists = pa.array([[1.0, 2.0], None, [3.0, 4.0]])
    doubled = k.over_valid(lists, lambda c: k.matrix_list(k.list_matrix(c, 2) * 2, pa.float64()))
    assert doubled.to_pylist() == [[2.0, 4.0], None, [6.0, 8.0]]


def test_bad_vectors():
    with pytest.raises(ValueError, match="dimension 2, found 1"):
        k.list_matrix(pa.array([[1.0, 2.0], [1.0]]), 2)
    with pytest.raises(ValueError, match="null coordinate"):
        k.list_matrix(pa.array([[1.0, None]]), 2)
