import pytest
from pyspark.sql import functions as F

from checks.fixed import CODEBOOK, DIM
from latticode.operators import codebook as cb


@pytest.fixture(scope="module")
def book(spark):
    return cb.fit_codebook(spark, DIM)


def test_fit_gives_the_fixed_values(book):
    for bits, table in CODEBOOK.items():
        assert cb.centroids(book, DIM, bits) == pytest.approx(table, abs=1e-9)


def test_fit_is_a_fixed_point(spark, book):
    tables = {bits: cb.centroids(book, DIM, bits) for bits in cb.BITS}
    step = cb.lloyd_step(cb.coordinate_grid(spark, DIM), tables).collect()
    assert len(step) == 30
    for row in step:
        assert row.centroid == pytest.approx(tables[row.bits][row.idx], abs=1e-9)


def test_error_falls_with_bits_and_steps_never_raise_it(spark):
    points = cb.coordinate_grid(spark, 16, 1 << 12)
    tables = {b: [(2 * i + 1) / 2 ** b - 1 for i in range(2 ** b)] for b in (1, 2, 3)}
    last = None
    for _ in range(4):
        step = cb.lloyd_step(points, tables).collect()
        errors = {b: sum(r.spread for r in step if r.bits == b) for b in tables}
        if last:
            assert all(errors[b] <= last[b] + 1e-12 for b in tables)
        last = errors
        for r in step:
            tables[r.bits][r.idx] = r.centroid
    assert last[1] > last[2] > last[3]


def test_wider_dimensions_have_narrower_books(spark):
    wide = cb.fit_codebook(spark, 512, bits=(4,))
    assert cb.centroids(wide, 512, 4)[-1] < CODEBOOK[4][-1]
    assert [r.bits for r in wide.select("bits").distinct().collect()] == [4]


def test_bad_books(spark, book):
    with pytest.raises(ValueError, match="expected 16 sorted"):
        cb.centroids(book, 128, 4)
    with pytest.raises(ValueError, match="expected 2 sorted"):
        cb.centroids([0.1, -0.1], DIM, 1)
    with pytest.raises(ValueError, match="two dimensions"):
        cb.coordinate_grid(spark, 1)


def test_too_few_points(spark):
    points = spark.createDataFrame([(0.1, 1.0), (0.2, 1.0)], "x double, w double")
    with pytest.raises(Exception, match="do not support 16 centroids"):
        cb.fit(points, 8, bits=(4,)).collect()


def test_value_of_code(spark):
    table = CODEBOOK[2]
    row = spark.range(1).select(*[cb.value(F.lit(i), table).alias(f"c{i}") for i in range(4)]).first()
    assert list(row) == table
