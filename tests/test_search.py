import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.fixed import CODEBOOK, DIM
from conftest import plan
from latticode.functions.encoders import hashed_encoder
from latticode.operators import index as ix
from latticode.operators import search as sr
from latticode.plans import papers, retrieval
from latticode.sources import tables


def brute_force(index, queries, bits, top_n, scale):
    """Hits from the definition: dot product with the recovered vector plus the
    scaled dot product with the signs, in plain NumPy."""
    rows = index.collect()
    found = {}
    for q in queries.collect():
        rng = {s: np.random.default_rng(s).choice([1.0, -1.0], size=DIM) for s in (42, 24)}
        i = np.arange(DIM)
        matrix = np.where(np.bitwise_count(i[:, None] & i) % 2, -1.0, 1.0) / np.sqrt(DIM)
        x = np.zeros(DIM)
        x[: len(q.embedding)] = q.embedding
        main, other = matrix @ (x * rng[42]), matrix @ (x * rng[24])
        scores = []
        for r in rows:
            flat = "".join(f"{b:08b}" for b in r.packed)
            code = [int(flat[p : p + bits], 2) for p in range(0, len(flat), bits)]
            sign = np.array([1 if b == "1" else -1 for b in "".join(f"{b:08b}" for b in r.qjl_bits)])
            score = main @ np.array(CODEBOOK[bits])[code] + scale * r.gamma * (other @ sign)
            scores.append((-round(score, 9), r.id))
        found[q.qid] = [(id_, -s) for s, id_ in sorted(scores)[:top_n]]
    return found


def collected(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.score))
    return out


def assert_same(found, expected):
    assert found.keys() == expected.keys()
    for qid in expected:
        assert [i for i, _ in found[qid]] == [i for i, _ in expected[qid]]
        assert [s for _, s in found[qid]] == pytest.approx([s for _, s in expected[qid]], abs=2e-9)


@pytest.fixture(scope="module")
def queries(vectors_df):
    return vectors_df.where("id < 6").select(F.col("id").alias("qid"), "embedding")


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("method", ["table", "product"])
def test_equals_brute_force(vectors_df, queries, bits, method):
    index = ix.build_index(vectors_df, CODEBOOK[bits], bits)
    found = collected(sr.search(index.repartition(5), queries, CODEBOOK[bits], 7, n_bits=bits, method=method))
    assert_same(found, brute_force(index, queries, bits, 7, math.sqrt(math.pi / 2) / 8))


def test_reference_scale(vectors_df, queries):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4, residual_sign="reference")
    found = collected(sr.search(index, queries, CODEBOOK[4], 5, alpha="reference"))
    assert_same(found, brute_force(index, queries, 4, 5, math.sqrt(math.pi / 2) / 64))


def test_scores_of_one_query_rank_like_search(vectors_df, queries):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4)
    query = queries.where("qid = 4").first().embedding
    for options in ({}, {"with_qjl": False}, {"alpha": "reference"}):
        scored = sr.score_rows(index, query, CODEBOOK[4], **options)
        best = scored.orderBy(F.round("score", 9).desc(), "id").limit(8).collect()
        found = collected(sr.search(index, queries.where("qid = 4"), CODEBOOK[4], 8, **options))[4]
        assert [r.id for r in best] == [i for i, _ in found]
        assert [r.score for r in best] == pytest.approx([s for _, s in found], abs=1e-9)


def test_padded_vectors(spark, vectors_df):
    short = vectors_df.select("id", F.slice("embedding", 1, 48).alias("embedding"))
    index = ix.build_index(short, CODEBOOK[4], 4)
    queries = short.where("id < 3").select(F.col("id").alias("qid"), "embedding")
    found = collected(sr.search(index, queries, CODEBOOK[4], 5))
    assert_same(found, brute_force(index, queries, 4, 5, math.sqrt(math.pi / 2) / 8))


def test_groups_of_queries(vectors_df, queries, tmp_path, monkeypatch):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4)
    whole = collected(sr.search(index, queries, CODEBOOK[4], 6))
    assert collected(sr.search(index, queries, CODEBOOK[4], 6, group_rows=1)) == whole
    path = str(tmp_path / "hits")
    assert collected(sr.search(index, queries.repartition(3), CODEBOOK[4], 6, group_rows=4, work_dir=path)) == whole
    monkeypatch.setattr(sr, "PIECE_BYTES", 1)
    monkeypatch.setattr(sr, "GROUP_HITS", 12)
    assert collected(sr.search(index, queries, CODEBOOK[4], 6)) == whole


def test_a_task_sends_top_n_per_query(vectors_df, queries):
    index = ix.build_index(vectors_df.repartition(40), CODEBOOK[4], 4)
    group = next(sr._query_groups(sr.rotate_queries(queries), 5, None))
    for tasks in (1, 3, 8):
        sent = sr._score_group(index, *group, CODEBOOK[4], 4, 0.1, 5, queries.schema["qid"], "product", tasks)
        assert sent.count() == tasks * 6 * 5


def test_short_queries_rank_alike(vectors_df, queries):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4)
    whole = collected(sr.search(index, queries, CODEBOOK[4], 6))
    for factor in (1e-11, 1e-200, 1e9):
        scaled = queries.select("qid", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * factor).alias("embedding"))
        for method in ("table", "product"):
            got = collected(sr.search(index, scaled, CODEBOOK[4], 6, method=method))
            assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in whole.items()}
            assert [s / factor for _, s in got[2]] == pytest.approx([s for _, s in whole[2]])
    zero = queries.select("qid", F.transform("embedding", lambda x: x * 0).alias("embedding"))
    assert collected(sr.search(index, zero, CODEBOOK[4], 3)) == {q: [(0, 0.0), (1, 0.0), (2, 0.0)] for q in whole}
    assert sr.search(index, queries.select("qid", F.transform("embedding", lambda x: x * float("nan")).alias("embedding")),
                     CODEBOOK[4], 3).count() == 0


def test_rows_that_are_not_finite_take_no_place(spark, vectors_df, queries):
    bad = spark.createDataFrame([(9000 + i, [v] + [0.5] * 63) for i, v in enumerate((math.inf, -math.inf, math.nan))],
                                "id bigint, embedding array<float>")
    both = vectors_df.select("id", "embedding").unionByName(bad)
    with pytest.raises(Exception, match="not finite"):
        ix.build_index(both, CODEBOOK[4], 4).collect()
    index = ix.build_index(vectors_df, CODEBOOK[4], 4)
    whole = collected(sr.search(index, queries, CODEBOOK[4], 10))
    skipped = ix.build_index(both, CODEBOOK[4], 4, skip_non_finite=True)
    assert collected(sr.search(skipped, queries, CODEBOOK[4], 10)) == whole
    one = index.where("id = 0")
    holes = index
    for i, gamma in enumerate((None, math.nan, math.inf)):
        lost = one.select(F.lit(9000 + i).cast("bigint").alias("id"), "packed", F.lit(gamma).cast("float").alias("gamma"),
                          *index.columns[3:])
        holes = holes.unionByName(lost)
    assert collected(sr.search(holes.coalesce(1), queries, CODEBOOK[4], 10)) == whole
    best = sr.BestRows(1, 10, pa.int64())
    best.add(np.r_[np.full(12, np.nan), np.arange(38.0)][:, None], pa.array(range(50)))
    assert best.finish()["id"].to_pylist() == list(range(49, 39, -1))


def test_small_chunks_keep_the_best(vectors_df, queries, monkeypatch):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4)
    whole = collected(sr.search(index, queries, CODEBOOK[4], 40))
    monkeypatch.setattr(sr, "CELLS", 64 * 256)
    assert collected(sr.search(index.coalesce(1), queries, CODEBOOK[4], 40, dim=DIM)) == whole
    assert collected(sr.search(index.repartition(16), queries, CODEBOOK[4], 40)) == whole


def test_hot_copies_tie_by_id(spark, vectors_df, queries):
    """A third of the rows are copies of one vector."""
    hot = vectors_df.where("id = 0").select("embedding").crossJoin(spark.range(1000, 1250).select("id"))
    both = vectors_df.select("id", "embedding").unionByName(hot.select("id", "embedding"))
    index = ix.build_index(both.repartition(7), CODEBOOK[4], 4)
    for method in ("table", "product"):
        found = collected(sr.search(index, queries.where("qid = 0"), CODEBOOK[4], 100, method=method))
        assert [i for i, _ in found[0]] == [0, *range(1000, 1099)]
        assert len({s for _, s in found[0]}) == 1


def test_string_ids_and_short_tables(spark, vectors_df, queries):
    few = vectors_df.where("id < 4").select(F.concat(F.lit("d"), "id").alias("id"), "embedding")
    asked = queries.select(F.concat(F.lit("q"), "qid").alias("qid"), "embedding")
    found = collected(sr.search(ix.build_index(few, CODEBOOK[4], 4), asked, CODEBOOK[4], 10))
    assert set(found) == {f"q{i}" for i in range(6)}
    assert all(len(h) == 4 for h in found.values()) and found["q2"][0][0] == "d2"


def test_null_and_missing_queries(spark, vectors_df):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4)
    asked = spark.createDataFrame([(1, None)], "qid bigint, embedding array<float>")
    empty = sr.search(index, asked, CODEBOOK[4], 3)
    assert empty.count() == 0 and empty.columns == ["qid", "id", "score", "rank"]
    nothing = ix.build_index(vectors_df.where("id < 0"), CODEBOOK[4], 4)
    asked = vectors_df.limit(2).select(F.col("id").alias("qid"), "embedding")
    assert sr.search(nothing, asked, CODEBOOK[4], 3).count() == 0


def test_rows_without_codes_are_skipped(spark, vectors_df, queries):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4)
    holes = index.withColumn("packed", F.when(F.col("id") != 3, F.col("packed")))
    found = collected(sr.search(holes, queries, CODEBOOK[4], 3, dim=DIM))
    assert found[3][0][0] != 3 and found[2][0][0] == 2


def recall(vectors_df, bits, **options):
    asked = vectors_df.where("id < 50").select(F.col("id").alias("qid"), "embedding")
    build = {"residual_sign": options.pop("residual_sign", "unbiased")}
    hits = sr.search(ix.build_index(vectors_df, CODEBOOK[bits], bits, **build), asked, CODEBOOK[bits], 10,
                     n_bits=bits, **options).collect()
    x = np.array([r.embedding for r in vectors_df.orderBy("id").collect()])
    best = {q: set(np.argsort(-(x @ x[q]))[:10]) for q in range(50)}
    return sum(r.id in best[r.qid] for r in hits) / 500


# Floors for recall at 10 on this table: without correction and corrected.
@pytest.mark.parametrize("bits,plain_floor,corrected_floor", [(1, 0.386, 0.562), (2, 0.610, 0.728), (4, 0.876, 0.914)])
def test_recall(vectors_df, bits, plain_floor, corrected_floor):
    plain, corrected = recall(vectors_df, bits, with_qjl=False), recall(vectors_df, bits)
    assert plain >= plain_floor and corrected >= corrected_floor and corrected > plain
    # The reference's sign and scale make the correction a loss.
    assert recall(vectors_df, bits, residual_sign="reference", alpha="reference") < plain


def test_plan_keeps_hits_local(vectors_df, queries):
    index = ix.build_index(vectors_df, CODEBOOK[4], 4)
    text = plan(sr.search(index, queries, CODEBOOK[4], 5))
    below = text[text.index("MapInArrow"):]
    assert "Exchange" not in below and "WindowGroupLimit" in text and "Coalesce" in below
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert below.count("ArrowEvalPython") == 1


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame([(0, 5, 0.9, 1), (0, 2, 0.8, 2), (0, 99, 0.7, 3), (1, 5, 0.6, 1)],
                                 "qid bigint, id bigint, score double, rank int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(10).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("title"))


def test_attach(found, docs):
    ranked = sr.attach_documents(found, docs, "doc_id").orderBy("qid", "rank").collect()
    assert [(r.qid, r.rank, r.id, r.title) for r in ranked] == [(0, 1, 5, "t5"), (0, 2, 2, "t2"), (1, 1, 5, "t5")]
    assert sorted(r.id for r in sr.attach_documents(found, docs, "doc_id", how="semi").collect()) == [2, 5]
    with pytest.raises(ValueError, match="ranked"):
        sr.attach_documents(found, docs, "doc_id", how="outer")


def test_attach_broadcasts_only_proven_hits(found, docs):
    assert "BroadcastExchange" in plan(sr.attach_documents(found, docs, "doc_id", max_hits=4))
    spark = found.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(sr.attach_documents(found, docs, "doc_id"))
        assert "BroadcastHashJoin" not in plan(sr.attach_documents(found, docs, "doc_id", max_hits=10 ** 9))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_pushes_ids_to_sorted_files(spark, found, docs, monkeypatch):
    path = tables.new_shared_path(spark, "docs")
    tables.write_sorted(docs, path, "doc_id", partitions=3)
    stored = spark.read.parquet(path)
    looked = sr.lookup_documents(found, stored, "doc_id")
    assert "In(doc_id, [2,5,99])" in plan(looked)
    rows = sorted((r.qid, r.rank, r.title) for r in looked.collect())
    assert rows == [(0, 1, "t5"), (0, 2, "t2"), (1, 1, "t5")]
    many = spark.range(25).select(F.lit(0).cast("bigint").alias("qid"), "id", F.lit(0.5).alias("score"), F.lit(1).alias("rank"))
    text = plan(sr.lookup_documents(many, stored, "doc_id"))
    assert "PushedFilters: [Or(Or(In(doc_id, [0,1,2,3,4,5,6,7,8,9]),In(doc_id, [10," in text
    monkeypatch.setattr(sr, "LOOKUP_HITS", 2)
    with pytest.raises(ValueError, match="attach_documents"):
        sr.lookup_documents(found, stored, "doc_id")
    assert sr.lookup_documents(found.where("qid > 5"), stored, "doc_id").count() == 0


def test_document_search(spark):
    encoder = hashed_encoder(64)
    docs = spark.createDataFrame([
        ("a", "Peace", "war and peace and war " * 10, "X"), ("b", "Bread", "flour water salt yeast " * 10, "Y"),
        ("c", "Short", "war", "Z")], "id string, title string, abstract string, authors string")
    index = ix.build_index(papers.embed(docs, encoder), CODEBOOK[4], 4)
    engine = retrieval.DocumentSearch(docs, index, CODEBOOK[4], encoder)
    top = engine.query("war peace", 2).collect()
    assert [(r.id, r["rank"]) for r in top] == [("a", 1), ("b", 2)] and top[0].score > top[1].score
    assert engine.cards("salt and yeast").first().link == "https://arxiv.org/abs/b"
    assert engine.searched().first()["rows"] == 2
    asked = spark.createDataFrame([(0, ""), (1, None), (2, "flour")], "qid bigint, text string")
    assert {r.qid for r in engine.query_many(asked, 1).collect()} == {2}
    assert engine.query("").count() == 0
