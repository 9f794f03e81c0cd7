import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from latticode.operators import index as ix
from latticode.operators import reduction as rd
from latticode.operators import stats as st
from latticode.plans import exploration
from checks.fixed import CODEBOOK


def values(df):
    return {r.statistic: r.value for r in df.collect()}


@pytest.mark.parametrize("data", [[5], [1, 2], [3, 3, 3, 9], list(range(11)), [7, None, 1, None, 4]])
def test_describe(spark, data):
    df = spark.createDataFrame([(x,) for x in data], "x int")
    known = pd.Series([x for x in data if x is not None])
    linear = values(st.describe(df, "x", "linear"))
    nearest = values(st.describe(df, "x"))
    for q, name in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%")):
        assert linear[name] == pytest.approx(known.quantile(q))
        assert nearest[name] == sorted(known)[int(np.floor((len(known) - 1) * q + 0.5))]
    assert linear["count"] == len(known) and linear["null_count"] == len(data) - len(known)
    assert linear["mean"] == pytest.approx(known.mean())
    assert (linear["min"], linear["max"]) == (known.min(), known.max())
    assert linear["std"] == (pytest.approx(known.std()) if len(known) > 1 else None)


def test_describe_empty(spark):
    got = values(st.describe(spark.createDataFrame([], "x int"), "x"))
    assert got["count"] == 0 and got["mean"] is None and got["50%"] is None
    with pytest.raises(ValueError):
        st.describe(spark.range(1), "id", "spline")


def test_counts(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("b", "c")], "x string, y string")
    assert {r.column: r.non_null for r in st.non_null_counts(df).collect()} == {"x": 2, "y": 1}
    assert exploration.valid_count(df, "x", 0).first()["rows"] == 2


def test_storage(vectors_df):
    plain = st.storage_report(ix.build_index(vectors_df, CODEBOOK[4], 4, with_qjl=False)).collect()
    assert [(r.representation, r.bytes) for r in plain] == [("packed", 500 * 32)]
    full = {r.representation: r.bytes for r in st.storage_report(
        ix.build_index(vectors_df, CODEBOOK[4], 4, full_data=True)).collect()}
    assert full == {"embedding": 128000, "rotated": 128000, "codes": 32000, "packed": 16000, "gamma": 2000, "qjl_bits": 4000}


@pytest.fixture(scope="module")
def matrix(vectors_df):
    return np.array([r.embedding for r in vectors_df.orderBy("id").collect()], dtype=float)


def test_pca_equals_svd(vectors_df, matrix):
    pca = rd.fit_pca(vectors_df)
    centered = matrix - matrix.mean(axis=0)
    _, s, vt = np.linalg.svd(centered, full_matrices=False)
    np.testing.assert_allclose(pca.ratios, s ** 2 / (s ** 2).sum(), atol=1e-9)
    rows = rd.project(vectors_df, pca, 5).orderBy("id").collect()
    got = np.array([r.projected for r in rows])
    signs = np.sign(vt[np.arange(5), np.abs(vt[:5]).argmax(axis=1)])
    np.testing.assert_allclose(got, centered @ vt[:5].T * signs, atol=1e-8)


def test_components_for_thresholds(vectors_df):
    pca = rd.fit_pca(vectors_df)
    cumulative = np.cumsum(pca.ratios)
    got = {r.threshold: r.components for r in rd.components_for(rd.explained_variance(vectors_df, pca)).collect()}
    assert got == {t: int(np.abs(cumulative - t).argmin()) + 1 for t in (0.7, 0.8, 0.9)}
    assert len(rd.fit_pca(vectors_df, 12).ratios) == 12


def test_clusters(spark, vectors_df):
    every = exploration.cluster_vectors(vectors_df, "id", every=5)
    rows = every.collect()
    assert sorted(r.id for r in rows) == list(range(0, 500, 5))
    assert {r.cluster for r in rows} <= set(range(10)) and len({r.cluster for r in rows}) > 5
    # Three clear groups are found whatever the projection is.
    centers = np.eye(8)[:3] * 10
    points = [(i, [float(x) for x in centers[i % 3] + np.random.default_rng(i).normal(size=8) * 0.1]) for i in range(90)]
    df = spark.createDataFrame(points, "id bigint, embedding array<double>")
    got = {r.id: r.cluster for r in exploration.cluster_vectors(df, "id", every=1, variance=0.9, clusters=3).collect()}
    assert all(len({got[i] for i in range(g, 90, 3)}) == 1 for g in range(3)) and len(set(got.values())) == 3


def test_profile_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = values(exploration.profile_texts(docs, "text"))
    assert got["count"] == 1000 and got["max"] == docs.agg(F.max("n_chars")).first()[0]
