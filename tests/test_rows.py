import pytest
from pyspark.sql import functions as F

from conftest import plan
from latticode.operators import rows as rw


@pytest.fixture(scope="module")
def shuffled(spark):
    return spark.range(0, 3000, 3).select(F.col("id").alias("k"), F.hash("id").alias("v")).repartition(7)


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_numbers_follow_the_key(shuffled, ranges):
    numbered = rw.number_rows(shuffled, "k", ranges=ranges).collect()
    assert len(numbered) == 1000 and all(r.row_index * 3 == r.k for r in numbered)
    assert numbered[0].v is not None


def test_string_keys_and_nulls(spark):
    df = spark.createDataFrame([(c,) for c in "zebra"] + [(None,), ("é",), ("𝛼",)], "k string").dropDuplicates()
    got = {r.k: r.row_index for r in rw.number_rows(df, "k", ranges=3).collect()}
    assert got[None] == 0
    keys = sorted((k for k in got if k is not None), key=lambda s: s.encode())
    assert [got[k] for k in keys] == list(range(1, len(got)))


def test_sample_starts_at_the_first_row(shuffled):
    assert sorted(r.k for r in rw.sample_every(shuffled, 100, "k").collect()) == list(range(0, 3000, 300))
    assert rw.sample_every(shuffled, 1, "k").count() == 1000
    assert rw.sample_every(shuffled, 5000, "k").collect()[0].k == 0
    with pytest.raises(ValueError):
        rw.sample_every(shuffled, 0, "k")


def test_empty(spark):
    assert rw.sample_every(spark.range(0), 10, "id").count() == 0


def test_numbering_is_not_one_partition(shuffled):
    text = plan(rw.number_rows(shuffled, "k"))
    assert "SinglePartition" not in text and "hashpartitioning(_range" in text


def test_caps(spark, tmp_path, shuffled):
    assert rw.cap_rows(shuffled, None, "k") is shuffled
    shuffled.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for limit in (0, 1, 10, 125, 126, 999, 1000, 5000):
        for ranges in (1, 8):
            assert sorted(r.k for r in rw.cap_rows(table, limit, "k", ranges=ranges).collect()) == list(range(0, 3000, 3))[:limit]
    text = plan(rw.cap_rows(table, 10, "k", ranges=8))
    assert "LessThanOrEqual(k,27)" in text and "Exchange" not in text and "TakeOrdered" not in text


def test_caps_of_strings_and_a_null(spark):
    df = spark.createDataFrame([(c,) for c in "zebra"] + [(None,)], "k string")
    assert [r.k for r in rw.cap_rows(df, 1, "k", ranges=2).collect()] == [None]
    assert {r.k for r in rw.cap_rows(df, 3, "k", ranges=2).collect()} == {None, "a", "b"}
    assert rw.cap_rows(df.where("false"), 3, "k").count() == 0


def test_sample_moves_keys_only(shuffled):
    text = plan(rw.sample_every(shuffled.withColumn("wide", F.lit("x")), 10, "k"))
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning(_range" in line]
    below = text[text.index("Exchange hashpartitioning(_range"):]
    assert moved and "wide" not in below and "v#" not in below.split("Project", 1)[1].split("\n", 1)[0]


def test_file_order_sample_is_a_map(spark, tmp_path, shuffled):
    path = str(tmp_path / "t")
    shuffled.write.parquet(path)
    spark.range(0).select(F.col("id").alias("k"), F.lit(1).alias("v")).coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    ordered = [r.k for r in df.select("k", "_metadata.file_path", "_metadata.row_index")
               .orderBy("file_path", "row_index").collect()]
    sample = rw.sample_file_rows(df, 7)
    assert sample.columns == ["k", "v"]
    assert sorted(r.k for r in sample.collect()) == sorted(ordered[::7])
    assert sorted(r.k for r in rw.sample_file_rows(df, 10 ** 6).collect()) == [ordered[0]]
    assert "BroadcastHashJoin" in plan(sample) and "SortMergeJoin" not in plan(sample)
