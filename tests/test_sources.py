import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks import queries
from checks.fixed import CODEBOOK, DIM
from conftest import plan
from latticode.functions.encoders import hashed_encoder, model_encoder
from latticode.operators import codebook as cb
from latticode.operators import index as ix
from latticode.plans import indexing, papers
from latticode.sources import tables
from latticode.streaming import index_stream


def test_index_paths():
    assert tables.index_path("/d/", 4, 42) == "/d/quantized_embeddings_4bits_seed=42.parquet"
    assert tables.index_path("/d", 2, 1, 24) == "/d/quantized_embeddings_2bits_seed=1_qjl_seed=24.parquet"
    assert tables.index_path("/d", 4, 42, 24, True).endswith("_seed=42_qjl_seed=24_full_data.parquet")


def test_ndjson_with_fixed_schema(spark, tmp_path):
    lines = [{"id": "0704.1", "title": "T", "abstract": "A", "authors": "B", "versions": [1]}, {"id": "0704.2", "title": None}]
    (tmp_path / "in.json").write_text("\n".join(json.dumps(x) for x in lines))
    out = papers.ingest_json(spark, str(tmp_path / "in.json"), str(tmp_path / "out"))
    assert out.columns == ["id", "title", "abstract", "authors"]
    assert sorted(tuple(r) for r in out.collect()) == [("0704.1", "T", "A", "B"), ("0704.2", None, None, None)]


def test_missing_paths(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.read_table(spark, str(tmp_path / "none"))


def test_columns_are_pruned(spark, tmp_path):
    spark.range(3).select("id", F.lit("x").alias("wide"), F.lit(1).alias("n")).write.parquet(str(tmp_path / "t"))
    assert "ReadSchema: struct<id:bigint>" in plan(tables.read_table(spark, str(tmp_path / "t"), ["id"]))


def test_fixed_schema_and_file_sizes(spark, tmp_path):
    df = spark.range(100).select(F.lit(1).alias("extra"), "id").coalesce(1)
    tables.write_table(df, str(tmp_path / "t"), schema="id string", rows_per_file=30)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.schema.simpleString() == "struct<id:string>" and len(back.inputFiles()) == 4
    with pytest.raises(AnalysisException):
        tables.write_table(df, str(tmp_path / "t"))
    tables.write_table(df.repartition(20), str(tmp_path / "r"), files="rebalance")
    assert len(spark.read.parquet(str(tmp_path / "r")).inputFiles()) < 20
    tables.write_table(df.repartition(20), str(tmp_path / "c"), files=3)
    assert len(spark.read.parquet(str(tmp_path / "c")).inputFiles()) == 3
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "x"), files="many")


def test_empty_table_is_written(spark, tmp_path):
    empty = papers.embed(spark.createDataFrame([], tables.PAPERS_SCHEMA), hashed_encoder(8))
    papers.write_embeddings(empty, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.count() == 0 and back.columns == ["id", "content", "embedding"]
    path = indexing.create_index(spark, str(tmp_path / "e"), str(tmp_path), CODEBOOK[4])
    assert spark.read.parquet(path).count() == 0


def test_codebook_table(spark, tmp_path):
    rows = [(DIM, b, i, c) for b, t in CODEBOOK.items() for i, c in enumerate(t)]
    path = str(tmp_path / "book")
    tables.write_codebook(spark.createDataFrame(rows, cb.SCHEMA), path)
    tables.write_codebook(spark.createDataFrame([(8, 1, 0, -0.5), (8, 1, 1, 0.5)], cb.SCHEMA), path)
    assert cb.centroids(tables.read_codebook(spark, path, DIM), DIM, 4) == tuple(CODEBOOK[4])
    assert cb.centroids(tables.read_codebook(spark, path, 8), 8, 1) == (-0.5, 0.5)


def test_shared_index_path_is_pruned(spark, tmp_path, vectors_df):
    path = str(tmp_path / "ix")
    tables.write_index(ix.build_index(vectors_df, CODEBOOK[2], 2, with_qjl=False), path)
    tables.write_index(ix.build_index(vectors_df, CODEBOOK[2], 2).drop("gamma", "qjl_bits"), path, mode="append")
    one = tables.read_index(spark, path, 2, 42, 24)
    assert one.count() == 500 and tables.read_index(spark, path, 2, 42).count() == 500
    assert tables.read_index(spark, path, 4, 42).count() == 0
    assert "PartitionFilters: [isnotnull(n_bits" in plan(one)


def test_index_job(spark, tmp_path, vectors_df):
    source = str(tmp_path / "e")
    vectors_df.select("id", "embedding").write.parquet(source)
    path = indexing.create_index(spark, source, str(tmp_path), CODEBOOK[4], 4, max_rows=50, with_qjl=True, full_data=True)
    assert path.endswith("quantized_embeddings_4bits_seed=42_qjl_seed=24_full_data.parquet")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(50))


def test_profile(spark):
    got = tables.profile(spark.range(7).withColumn("s", F.lit("x"))).collect()
    assert [tuple(r) for r in got] == [(0, "id", "bigint", 7), (1, "s", "string", 7)]


def test_model_encoder_loads_once_per_task(spark, tmp_path):
    log = tmp_path / "loads"
    log.mkdir()

    def load():
        import os
        import uuid

        (log / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def encode(texts):
            assert len(texts) <= 16
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])

        return encode

    texts = spark.range(300).select("id", F.when(F.col("id") != 7, F.concat(F.lit("a"), "id")).alias("t")).coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = texts.select("id", model_encoder(load, 3, batch_size=16)(F.col("t")).alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list(log.iterdir())) == 2
    got = {r.id: r.v for r in got}
    assert got[7] is None and got[123] == [4.0, 1.0, 1.0]


def test_encoder_runs_once_per_row(spark):
    df = papers.embed(spark.createDataFrame([("1", "t", "word " * 50, "")], tables.PAPERS_SCHEMA), hashed_encoder(8))
    assert plan(ix.build_index(df, CODEBOOK[4], 4, dim=8)).count("bag(") == plan(df).count("bag(")


def test_hashed_encoder(spark):
    df = spark.createDataFrame([("One two two",), ("two, ONE; two",), ("",), (None,), ("...",)], "t string")
    a, b, empty, null, marks = [r[0] for r in df.select(hashed_encoder(16)(F.col("t"))).collect()]
    assert a == b and np.linalg.norm(a) == pytest.approx(1.0, abs=1e-6)
    assert empty == [0.0] * 16 == marks and null is None


def test_stream_appends_what_a_batch_builds(spark, tmp_path, vectors_df):
    source, target, log = (str(tmp_path / n) for n in ("in", "ix", "log"))
    rows = vectors_df.select("id", "embedding")
    rows.where("id < 200").repartition(2).write.parquet(source)

    def run():
        stream = index_stream.read_embeddings_stream(spark, source, rows.schema, files_per_batch=1)
        index_stream.append_index(stream, CODEBOOK[4], target, log, DIM).awaitTermination()
        return tables.read_index(spark, target, 4, 42, 24)

    assert run().count() == 200
    assert run().count() == 200  # a restart adds nothing
    rows.where("id >= 200").write.mode("append").parquet(source)
    whole = ix.build_index(rows, CODEBOOK[4], 4, dim=DIM)
    columns = ["id", "packed", "gamma", "qjl_bits"]
    assert sorted(map(tuple, run().select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_table_in_a_folder_or_one_file(spark, tmp_path, files):
    rows = [(n, [float((n * k) % 7 - 3) for k in range(DIM)], n % 3) for n in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.repartition(files).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.index_stream_append(spark, str(tmp_path)).count() == 40
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    one, = (tmp_path / "one").glob("*.parquet")
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "embeddings.parquet").write_bytes(one.read_bytes())
    assert queries.index_stream_append(spark, str(tmp_path / "file")).count() == 40
