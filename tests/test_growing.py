"""Layouts that join without a shuffle, PCA by passes, statistics kept per file, caps by division."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan
from latticode.operators import power, sketches
from latticode.operators import rows as rw
from latticode.sources import colocated, tables


@pytest.fixture(scope="module")
def pair(spark):
    """Two tables laid out alike, one with ids that the other lacks."""
    left, right = (tables.new_shared_path(spark, n) for n in ("left", "right"))
    ids = spark.range(0, 2000, numPartitions=5)
    colocated.write_colocated(ids.withColumn("title", F.concat(F.lit("t"), "id")), left, "id", 8)
    colocated.write_colocated(ids.where("id % 3 = 0").withColumn("code", F.col("id") * 2), right, "id", 8)
    return left, right


def moves(df) -> list[str]:
    return [line for line in plan(df).splitlines() if "Exchange" in line]


def test_tables_laid_out_alike_join_without_a_shuffle(spark, pair):
    both = colocated.read_colocated(spark, pair[0]).hint("merge").join(colocated.read_colocated(spark, pair[1]), "id")
    assert moves(both) == []
    assert both.where("code = id * 2 and title = concat('t', id)").count() == 667


def test_hits_travel_and_documents_stay(spark, pair):
    hits = spark.range(1990, 2010).union(spark.range(1990, 1995)).withColumn("score", F.rand(3))
    attached = colocated.attach_colocated(hits, pair[0])
    assert len(moves(attached)) == 1
    assert sorted(r.id for r in attached.collect()) == sorted([*range(1990, 2000), *range(1990, 1995)])
    assert colocated.attach_colocated(hits, pair[0], "left").where("title is null").count() == 10


def test_another_session_reads_the_layout(spark, pair):
    spark.sql(f"DROP TABLE {colocated._name(pair[0])}")
    again = colocated.read_colocated(spark, pair[0])
    assert again.count() == 2000 and colocated.layout_of(spark, pair[0]) == ("id", 8)
    assert moves(again.hint("merge").join(colocated.read_colocated(spark, pair[1]), "id")) == []


def test_layouts_of_odd_tables(spark):
    path = tables.new_shared_path(spark, "odd")
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "d")]
    colocated.write_colocated(spark.createDataFrame(rows, "id long, x string"), path, "id", 4)
    assert sorted(r.x for r in colocated.read_colocated(spark, path).collect()) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        colocated.write_colocated(spark.range(1), path + "2", "id", 0)
    assert [colocated.buckets_for(b, 100) for b in (0, 1, 100, 101, 300, 900)] == [1, 1, 1, 2, 4, 16]


def spread_vectors(spark, n: int = 600, dim: int = 40):
    """Vectors whose variance falls off by coordinates of a turned basis, and a mean."""
    rng = np.random.default_rng(3)
    turned = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    x = rng.standard_normal((n, dim)) * 0.7 ** np.arange(dim) @ turned.T + rng.standard_normal(dim)
    return x, spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(n, None)], "id long, embedding array<double>")


@pytest.mark.parametrize("oversample", [5, 40])
def test_passes_find_the_components(spark, oversample):
    x, df = spread_vectors(spark)
    pca = power.fit_block_pca(df.repartition(5), 6, oversample=oversample)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(pca.mean, x.mean(axis=0))
    assert np.allclose(pca.ratios, s[:6] ** 2 / (s ** 2).sum(), rtol=1e-6)
    assert np.allclose(np.abs((pca.loadings * vt[:6].T).sum(axis=0)), 1, atol=1e-5)
    got = power.project(df, pca, 3).orderBy("id").collect()
    assert got[-1].projected is None
    assert np.allclose([r.projected for r in got[:-1]], (x - x.mean(axis=0)) @ pca.loadings[:, :3])


def test_passes_over_odd_tables(spark):
    with pytest.raises(ValueError):
        power.fit_block_pca(spark.createDataFrame([], "embedding array<double>"))
    same = spark.createDataFrame([([1.0, 2.0],)] * 5, "embedding array<double>")
    assert power.fit_block_pca(same, 2).ratios == [0.0, 0.0]


def test_file_statistics_merge(spark):
    path = tables.new_shared_path(spark, "values")
    data = spark.range(0, 20000, numPartitions=6).select((F.col("id") * 7919 % 20000).alias("x"))
    data.union(spark.createDataFrame([(None,)] * 30, "x long")).write.parquet(path)
    stored = tables.stored(sketches.file_statistics(spark.read.parquet(path), "x"), "statistics")
    first = {r.statistic: r.value for r in sketches.merged_statistics(stored).collect()}
    assert (first["count"], first["null_count"], first["min"], first["max"]) == (20000, 30, 0, 19999)
    assert first["mean"] == pytest.approx(9999.5)
    for name, q in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
        assert abs(first[name] / 20000 - q) < 3 * sketches.rank_error()

    spark.range(20000, 30000, numPartitions=2).select(F.col("id").alias("x")).write.mode("append").parquet(path)
    fresh = sketches.new_file_statistics(spark.read.parquet(path), stored, "x")
    assert fresh.count() == 2
    grown = {r.statistic: r.value for r in sketches.merged_statistics(stored.unionByName(fresh)).collect()}
    assert grown["count"] == 30000 and grown["max"] == 29999 and abs(grown["50%"] / 30000 - 0.5) < 3 * sketches.rank_error()


def test_statistics_of_nothing(spark):
    path = tables.new_shared_path(spark, "nulls")
    spark.createDataFrame([(None,)] * 3, "x int").coalesce(1).write.parquet(path)
    files = sketches.file_statistics(spark.read.parquet(path), "x")
    got = {r.statistic: r.value for r in sketches.merged_statistics(files).collect()}
    assert got["count"] == 0 and got["null_count"] == 3 and got["50%"] is None and got["mean"] is None
    none = {r.statistic: r.value for r in sketches.merged_statistics(files.where("false")).collect()}
    assert none["count"] == 0 and none["max"] is None


@pytest.mark.parametrize("limit", [0, 1, 2, 37, 499, 500, 999, 1000, 1001, 5000])
def test_caps_by_division(spark, limit):
    df = spark.range(0, 3000, 3).union(spark.sql("select cast(null as bigint)")).withColumnRenamed("id", "k").repartition(4)
    got = {r.k for r in rw.cap_rows(df, limit, "k", ranges=3, most=20).collect()}
    assert got == set([None, *range(0, 3000, 3)][:limit])


def test_caps_of_equal_keys_end(spark):
    df = spark.createDataFrame([(5,)] * 200, "k int")
    assert rw.cap_rows(df, 10, "k", ranges=3, most=20).count() == 200
