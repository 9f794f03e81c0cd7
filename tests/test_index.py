import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.fixed import CODEBOOK, DIM
from conftest import plan
from latticode.functions import codes, vectors
from latticode.functions import kernels as k
from latticode.operators import index as ix
from latticode.plans import indexing


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>")


def random_rows(n, dim, seed=0):
    rows = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(str(i), [float(x) for x in r]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("with_qjl,full", [(False, False), (True, False), (False, True), (True, True)])
def test_columns_follow_flags(vectors_df, with_qjl, full):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4, with_qjl=with_qjl, full_data=full)
    expected = ["id"] + [c for c, _ in ix.index_columns(with_qjl, full)] + ["n_bits", "mse_seed", "qjl_seed"]
    assert index.columns == expected
    row = index.where("id = 3").first()
    assert len(row.packed) == 32 and (not with_qjl or len(row.qjl_bits) == 8)
    assert row.qjl_seed == (24 if with_qjl else None)


def test_padded_dimension(spark):
    rows = random_rows(20, 48)
    df = table(spark, rows)
    full = ix.build_index(df, CODEBOOK[4], 4, full_data=True).orderBy(F.col("id").cast("int")).collect()
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(full[0].rotated) == 64 and len(full[0].residual) == 48 and len(full[0].codes) == 64
    back = k.unrotate(np.array([r.rotated for r in full]), 42, 48)
    np.testing.assert_allclose(back, unit, atol=1e-6)
    for row, x in zip(full, unit):
        assert row.gamma == pytest.approx(np.linalg.norm(x - np.array(row.recovered)), abs=1e-6)
        assert row.gamma == pytest.approx(np.linalg.norm(row.residual), abs=1e-6)


def test_reference_sign_flips_the_residual(vectors_df):
    ours = ix.build_index(vectors_df, CODEBOOK[2], 2, full_data=True).where("id = 7").first()
    theirs = ix.build_index(vectors_df, CODEBOOK[2], 2, full_data=True, residual_sign="reference").where("id = 7").first()
    assert ours.residual == [-x for x in theirs.residual] and ours.gamma == theirs.gamma
    assert bytes(~b & 255 for b in ours.qjl_bits) == bytes(theirs.qjl_bits)


def test_normalization_is_optional(spark):
    df = table(spark, [("a", [3.0] + [0.0] * 7)])
    assert ix.build_index(df, CODEBOOK[4], full_data=True).first().embedding[0] == 1.0
    assert ix.build_index(df, CODEBOOK[4], full_data=True, normalize=False).first().embedding[0] == 3.0


def test_zero_vector(spark):
    row = ix.build_index(table(spark, [("z", [0.0] * 8)]), CODEBOOK[4], full_data=True).first()
    assert row.embedding == [0.0] * 8 and row.rotated == [0.0] * 8
    assert list(row.codes) == [7] * 8


def test_null_vectors_are_left_out(spark):
    df = table(spark, random_rows(3, 8) + [("n", None)])
    assert sorted(r.id for r in ix.build_index(df, CODEBOOK[4]).collect()) == ["0", "1", "2"]


def test_empty_table(spark):
    assert ix.build_index(table(spark, []), CODEBOOK[4]).count() == 0


def test_mixed_dimensions(spark):
    df = table(spark, random_rows(3, 8) + random_rows(3, 16)).coalesce(1)
    with pytest.raises(Exception, match="expected vectors of dimension"):
        ix.build_index(df, CODEBOOK[4]).collect()
    assert {(r.dim, r.vectors) for r in ix.check_dimensions(df).collect()} == {(8, 3), (16, 3)}


@pytest.mark.parametrize("bits", [3, 5, 8])
def test_unusable_widths(vectors_df, bits):
    with pytest.raises(ValueError, match="cannot be packed"):
        ix.build_index(vectors_df, list(range(2 ** bits)), bits)


def test_padding_of_columns(spark):
    df = table(spark, [("a", [1.0, 2.0, 3.0])])
    assert df.select(vectors.pad_zeros(F.col("embedding"), 4)).first()[0] == [1.0, 2.0, 3.0, 0.0]
    with pytest.raises(Exception, match="longer than 2"):
        df.select(vectors.pad_zeros(F.col("embedding"), 2)).collect()


def test_vector_columns_and_nulls(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    out = df.select(vectors.norm(a), vectors.dot(a, b), vectors.subtract(a, b), vectors.l2_normalize(a),
                    vectors.max_abs_difference(a, b)).collect()
    assert list(out[0]) == [5.0, 7.0, [2.0, 3.0], [0.6, 0.8], 3.0]
    assert list(out[1]) == [None] * 5


def test_unsigned_bytes(spark):
    df = spark.createDataFrame([(bytearray([15, 15, 0, 8]),)], "codes binary")
    packed = df.select(codes.pack(F.col("codes"), 4, 4).alias("p"))
    assert packed.select(F.hex("p")).first()[0] == "FF08"
    assert packed.select(codes.byte_values(F.col("p"))).first()[0] == [255, 8]
    values = packed.select(codes.centroid_values(F.col("p"), CODEBOOK[4], 4, 4)).first()[0]
    assert values == [CODEBOOK[4][i] for i in (15, 15, 0, 8)]


def test_build_is_one_map_over_the_scan(vectors_df):
    text = plan(ix.build_index(vectors_df, CODEBOOK[4], 4, dim=DIM))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1
    assert "IsNotNull(embedding)" in text and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_id_filter_reaches_the_scan(vectors_df):
    text = plan(ix.build_index(vectors_df, CODEBOOK[4], 4, dim=DIM).where("id = 5"))
    assert "EqualTo(vec_id,5)" in text


def test_verify_finds_a_damaged_index(vectors_df):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4, full_data=True)
    good = indexing.verify_index(index, CODEBOOK[4], 4, DIM).first()
    assert good.invertible and good.wrong_codes == 0 and good.rows == 500
    assert good.mean_squared_error == pytest.approx(0.0092, abs=0.0005)
    bad = indexing.verify_index(index.withColumn("codes", F.reverse(F.hex("codes")).cast("binary")), CODEBOOK[4], 4, DIM)
    assert bad.first().wrong_codes == 500


@pytest.mark.parametrize("bits,error", [(1, 0.358), (2, 0.114), (4, 0.0092)])
def test_reconstruction_error(vectors_df, bits, error):
    full = ix.build_index(vectors_df, CODEBOOK[bits], bits, full_data=True)
    rest = F.col("residual")
    mse = full.select(vectors.dot(rest, rest).alias("e")).agg(F.avg("e")).first()[0]
    assert mse == pytest.approx(error, rel=0.05)


def test_reconstruction_error_takes_one_python_process_a_task(spark, tmp_path):
    rows = [(n, None if n % 7 == 0 else [float((n * j) % 11 - 5) for j in range(DIM)], 0) for n in range(5, 60)]
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.reconstruction_error(spark, str(tmp_path))
    assert plan(got).count("ArrowEvalPython") == 1
    x = k.normalize(np.array([v for _, v, _ in rows if v]))
    for r in got.collect():
        table = np.array(CODEBOOK[r.bits])
        rest = x - k.unrotate(table[k.nearest(k.rotate(x, 42), table)], 42, DIM)
        assert r.mse == pytest.approx(np.square(rest).sum(axis=1).mean(), abs=1e-6)
    no_vectors = spark.createDataFrame([(1, None, 0)], schema)
    no_vectors.write.mode("overwrite").parquet(str(tmp_path / "nulls" / "embeddings.parquet"))
    got = queries.reconstruction_error(spark, str(tmp_path / "nulls")).collect()
    assert {(r.bits, r.mse) for r in got} == {(1, None), (2, None), (4, None)}
