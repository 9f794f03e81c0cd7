"""Searches of laid out indexes and query tables, packed tables, broken input."""

import json
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from checks import queries as registered
from checks.fixed import CELLS, CODEBOOK, DIM, TOP_N
from conftest import DATA, plan
from latticode.functions import kernels as k
from latticode.operators import cascade, cells, grid, kmeans
from latticode.operators import index as ix
from latticode.operators import search as sr
from latticode.sources import checked, tables, versions
from latticode.streaming import standing

SF = f"{DATA}/sf0.01"


def files_read(df):
    """Files that the scan of a plain projection opened."""
    rows = df.select("id")
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numFiles").get().value()


def found(df):
    return sorted((r.qid, r.rank, r.id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark):
    return tables.stored(registered.index(spark, SF), "index")


@pytest.fixture(scope="module")
def asked(spark):
    return tables.stored(registered.label_queries(spark, SF), "queries")


@pytest.fixture(scope="module")
def exact(built, asked):
    return found(sr.search(built, asked, CODEBOOK[4], TOP_N, dim=DIM))


@pytest.fixture(scope="module")
def grouped(spark):
    """An index of vectors that form groups, in cells, and queries near them."""
    vectors = registered.grouped_embeddings(spark, SF)
    rows = tables.stored(ix.build_index(vectors, CODEBOOK[4], 4, dim=DIM), "index")
    return rows, *cells.in_cells(rows, CODEBOOK[4], CELLS, dim=DIM), registered.label_queries(spark, SF, registered.grouped_embeddings)


# blocks of queries against blocks of the index

@pytest.mark.parametrize("options", [{"chunk_rows": 37, "piece_bytes": 2000}, {"chunk_rows": 1}, {}])
def test_blocks_of_any_size_find_the_same(built, asked, exact, options):
    assert found(grid.search_grid(built, asked, CODEBOOK[4], TOP_N, dim=DIM, **options)) == exact


def test_queries_never_reach_the_driver(built, asked, monkeypatch):
    """Nothing but counts and plans is collected, and nothing is broadcast."""
    def refuse(*_, **__):
        raise AssertionError("rows of a table came to the driver")

    for name in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(asked), name, refuse)
    hits = grid.search_grid(built, asked, CODEBOOK[4], TOP_N, dim=DIM)
    text = plan(hits)
    assert "CartesianProduct" in text and "Broadcast" not in text and "WindowGroupLimit" in text


def test_odd_queries_and_ids(spark, built):
    rows = built.limit(40).withColumn("id", F.concat(F.lit("k"), "id"))
    odd = spark.createDataFrame([("a", [1.0] * DIM), ("b", None), ("c", [float("nan")] * DIM), ("d", [0.0] * DIM),
                                 ("e", [1e-200] * DIM)], "qid string, embedding array<double>")
    want = found(sr.search(rows, odd, CODEBOOK[4], 5, dim=DIM))
    assert found(grid.search_grid(rows, odd, CODEBOOK[4], 5, dim=DIM)) == want
    assert {q for q, *_ in want} == {"a", "d", "e"}
    none = odd.where("false")
    assert grid.search_grid(rows, none, CODEBOOK[4], 5, dim=DIM).count() == 0
    assert grid.search_grid(rows.where("false"), odd, CODEBOOK[4], 5, dim=DIM).count() == 0


def test_without_a_sketch(spark, asked):
    rows = tables.stored(registered.index(spark, SF, 2, with_qjl=False), "index")
    want = found(sr.search(rows, asked, CODEBOOK[2], 7, n_bits=2, dim=DIM, with_qjl=False))
    options = {"n_bits": 2, "dim": DIM, "with_qjl": False}
    assert found(grid.search_grid(rows, asked, CODEBOOK[2], 7, **options)) == want
    parts = cells.in_cells(rows, CODEBOOK[2], 5, n_bits=2, dim=DIM)
    assert found(cells.search_cells(*parts, asked, CODEBOOK[2], 7, **options)) == want
    sketch = cascade.code_sketch(rows, CODEBOOK[2], n_bits=2, dim=DIM)
    assert found(cascade.search_cascade(rows, sketch, asked, CODEBOOK[2], 7, **options)) == want


# cells

def test_most_cells_of_grouped_vectors_are_not_read(spark, grouped):
    rows, parts, kept, asked = grouped
    log: list = []
    want = found(sr.search(rows, asked, CODEBOOK[4], TOP_N, dim=DIM))
    one = asked.where("qid = 3")
    assert found(cells.search_cells(parts, kept, one, CODEBOOK[4], TOP_N, dim=DIM, log=log)) == [h for h in want if h[0] == 3]
    read = {c for cells_of_round in log for c in cells_of_round}
    assert len(read) <= CELLS // 3
    pruned = parts.where(F.col("cell").isin(sorted(read)))
    assert "cell#" in plan(pruned).split("PartitionFilters: ")[1].split("]")[0]
    assert files_read(pruned) == len(read) < files_read(parts) / 2
    log.clear()
    assert found(cells.search_cells(parts, kept, asked, CODEBOOK[4], TOP_N, dim=DIM, log=log)) == want


def test_no_row_scores_above_its_cell(built, asked):
    parts, kept = cells.in_cells(built, CODEBOOK[4], 6, dim=DIM)
    bounds = cells.Bounds(kept.collect(), CODEBOOK[4], sr.sketch_scale(DIM), True)
    queries = grid.unit_queries(asked, DIM).collect()
    rotated, other = (np.array([r[c] for r in queries]) for c in ("rotated", "qjl_rotated"))
    limit = dict(zip(bounds.cell.tolist(), bounds.of(rotated, other).T))
    rows = parts.collect()
    packed, bits = (np.array([list(r[c]) for r in rows], np.uint8) for c in ("packed", "qjl_bits"))
    gamma = np.array([r.gamma for r in rows])[:, None]
    scores = k.unpack(packed, 4, CODEBOOK[4]) @ rotated.T + sr.sketch_scale(DIM) * gamma * (k.unpack(bits, 1, k.SIGNS) @ other.T)
    assert (scores <= np.array([limit[r.cell] for r in rows])).all()
    assert kept.agg(F.sum("n")).first()[0] == len(rows) == built.count()


def test_nearest_cells_find_most(spark, built, asked, exact):
    parts, kept = cells.in_cells(built, CODEBOOK[4], CELLS, dim=DIM)
    truth = sr.search(built, asked, CODEBOOK[4], TOP_N, dim=DIM)
    near = cells.search_cells(parts, kept, asked, CODEBOOK[4], TOP_N, dim=DIM, probes=12)
    r = cells.cell_recall(near, truth).first()
    assert r.queries == 10 and r.recall >= 0.9
    whole = cells.search_cells(parts, kept, asked, CODEBOOK[4], TOP_N, dim=DIM, probes=99)
    assert found(whole) == exact and cells.cell_recall(whole, truth).first().recall == 1


def test_cells_of_few_rows_ties_and_nothing(spark, built, asked):
    same = built.limit(1).drop("id").crossJoin(spark.range(30)).select(*built.columns)
    few = built.limit(3).unionByName(same)
    for rows in (few, same):
        parts, kept = cells.in_cells(rows, CODEBOOK[4], 4, dim=DIM)
        assert found(cells.search_cells(parts, kept, asked, CODEBOOK[4], 5, dim=DIM)) == found(sr.search(rows, asked, CODEBOOK[4], 5, dim=DIM))
    parts, kept = cells.in_cells(built.where("false"), CODEBOOK[4], 4, dim=DIM)
    assert cells.search_cells(parts, kept, asked, CODEBOOK[4], 5, dim=DIM).count() == 0
    with pytest.raises(ValueError, match="cells"):
        cells.fit_centers(built, CODEBOOK[4], cells.MAX_CELLS + 1, dim=DIM)


# the cascade

def test_cascade_scores_few_rows_of_groups(grouped):
    rows, _, _, asked = grouped
    log: list = []
    sketch = cascade.code_sketch(rows, CODEBOOK[4], dim=DIM, prefix_bits=2)
    one = asked.where("qid = 3")
    got = cascade.search_cascade(rows, sketch, one, CODEBOOK[4], TOP_N, dim=DIM, prefix_bits=2, log=log)
    assert found(got) == found(sr.search(rows, one, CODEBOOK[4], TOP_N, dim=DIM))
    assert TOP_N <= log[0] < rows.count() / 3


@pytest.mark.parametrize("bits", [1, 2])
def test_sketch_bounds_hold(built, asked, bits):
    queries = grid.unit_queries(asked, DIM).collect()
    rotated, other = (np.array([r[c] for r in queries]) for c in ("rotated", "qjl_rotated"))
    values = cascade.prefix_values(CODEBOOK[4], 4, bits)
    sketch = cascade.code_sketch(built, CODEBOOK[4], dim=DIM, prefix_bits=bits)
    rows = built.join(sketch.drop("gamma"), "id")
    low, high = cascade._bounded(rows.select("prefix", "factor", "rest", F.col("gamma").cast("double")).toArrow(), rotated,
                                 np.abs(other).sum(axis=1), values, bits, sr.sketch_scale(DIM))
    table = rows.toArrow()
    packed, signs = (k.byte_matrix(table[c].combine_chunks(), w) for c, w in (("packed", DIM // 2), ("qjl_bits", DIM // 8)))
    gamma = table["gamma"].to_numpy().astype(float)[:, None]
    true = k.unpack(packed, 4, CODEBOOK[4]) @ rotated.T + sr.sketch_scale(DIM) * gamma * (k.unpack(signs, 1, k.SIGNS) @ other.T)
    order, again = np.argsort(table["id"].to_numpy()), np.argsort(rows.select("id").toArrow()["id"].to_numpy())
    assert (low[again] <= true[order]).all() and (true[order] <= high[again]).all()


def test_cascade_of_nothing(built, asked):
    sketch = cascade.code_sketch(built, CODEBOOK[4], dim=DIM)
    for rows, ask in ((built.where("false"), asked), (built, asked.where("false"))):
        assert cascade.search_cascade(rows, sketch.join(rows, "id", "left_semi"), ask, CODEBOOK[4], 5, dim=DIM).count() == 0
    with pytest.raises(ValueError):
        cascade.code_sketch(built, CODEBOOK[4], dim=DIM, prefix_bits=3)


# standing queries

def test_a_killed_batch_changes_nothing(spark, asked, tmp_path, monkeypatch):
    vectors, path = registered.embeddings(spark, SF), str(tmp_path)
    parts = [vectors.where(F.col("id") % 3 == n) for n in range(3)]

    def run(n):
        standing.apply_batch(parts[n], n, asked, CODEBOOK[4], path, TOP_N, DIM)

    assert standing.current_hits(spark, path).count() == 0 and standing.current_index(spark, path) is None
    run(0)
    first = found(standing.current_hits(spark, path))
    with monkeypatch.context() as broken:
        broken.setattr(standing, "rank_hits", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            run(1)
    assert found(standing.current_hits(spark, path)) == first
    assert standing.current_index(spark, path).count() == parts[0].count()
    run(1)
    second = found(standing.current_hits(spark, path))
    run(1), run(0)  # what is logged already is left alone
    assert found(standing.current_hits(spark, path)) == second
    run(2)
    whole = ix.build_index(vectors, CODEBOOK[4], 4, dim=DIM)
    assert found(standing.current_hits(spark, path)) == found(sr.search(whole, asked, CODEBOOK[4], TOP_N, dim=DIM))
    assert standing.current_index(spark, path).count() == whole.count()


# versions

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=40))
def test_bins_hold_small_files_once_and_never_overflow(sizes):
    files = [(f"f{n}", s) for n, s in enumerate(sizes)]
    bins = versions.pack_files(files, 100)
    names = [n for b in bins for n in b]
    assert len(names) == len(set(names)) and all(2 * dict(files)[n] < 100 for n in names)
    assert all(sum(dict(files)[n] for n in b) <= 100 and len(b) > 1 for b in bins)
    left = [s for n, s in files if 2 * s < 100 and n not in names]
    assert len(left) <= 1  # two small files always fit together


def test_readers_see_one_version(spark, built, tmp_path):
    path = str(tmp_path / "ix")
    tables.write_index(built.repartition(9), path)
    tables.write_index(registered.index(spark, SF, 2).repartition(5), path, mode="append")
    rows = sorted(map(repr, spark.read.parquet(path).drop(*tables.INDEX_KEYS).collect()))
    versions.start_versions(spark, path)
    before = versions.read_version(spark, path)
    assert versions.compact(spark, path, 64 << 20) == 1
    after = versions.read_version(spark, path)
    assert len(before.inputFiles()) == 14 and len(after.inputFiles()) == 2
    for df in (before, after, versions.read_version(spark, path, 0)):  # the old list still works
        assert sorted(map(repr, df.drop(*tables.INDEX_KEYS).collect())) == rows
        assert {r.n_bits: r["count"] for r in df.groupBy("n_bits").count().collect()} == {4: 500, 2: 500}
    assert versions.compact(spark, path, 64 << 20) == 1  # nothing left to pack
    assert versions.unlisted(spark, path).count() == 14
    with pytest.raises(Exception, match="exist"):
        versions.publish(spark, path, versions.files_of(after), 1)
    with pytest.raises(ValueError):
        versions.read_version(spark, path, 7)


# broken lines

def test_broken_lines_have_a_place_and_a_reason(spark, tmp_path):
    good = {"id": "1", "title": "T", "abstract": None, "year": 2001, "nested": {"a": [1]}}
    lines = [json.dumps(good), "", "{\"id\": \"2\"", "[1]", "7", "null", '{"id": 3, "title": "number"}', '{"title": "no id"}', '{"id": null}',
             '{"id": "4", "title": {"x": 1}}', '  {"id": "5"}  ', '{"id": "6"} trailing', '{"id": "7"}, {"id": "7"}', '{"id": "é\\u00e9漢"}', "   "]
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json").write_text("{}\n" + json.dumps({"id": "8", "year": 1}))
    rows, rejected = checked.check_lines(checked.read_lines(spark, str(tmp_path)))
    assert rows.columns == ["id", "title", "abstract", "authors", "extra"]
    assert sorted(r.id for r in rows.collect()) == ["1", "5", "8", "éé漢"]
    places = {(r.file.rsplit("/", 1)[1], r.line): r.reason for r in rejected.collect()}
    assert places == {("a.json", 3): checked.BROKEN, ("a.json", 4): checked.BROKEN, ("a.json", 5): checked.BROKEN,
                      ("a.json", 6): checked.BROKEN, ("a.json", 7): checked.WRONG_TYPE, ("a.json", 8): checked.NO_KEY,
                      ("a.json", 9): checked.NO_KEY, ("a.json", 10): checked.WRONG_TYPE, ("a.json", 12): checked.BROKEN, ("a.json", 13): checked.BROKEN,
                      ("b.json", 1): checked.NO_KEY}
    assert {(r.field, r.rows) for r in checked.schema_drift(rows).collect()} == {("year", 2), ("nested", 1)}
    typed, _ = checked.check_lines(checked.read_lines(spark, str(tmp_path)), "id string, year int")
    assert {(r.id, r.year) for r in typed.collect()} >= {("1", 2001), ("8", 1), ("5", None)}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.json").write_text("\n".join(json.dumps({"id": str(n), "n": n}) for n in range(1, 5001)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = checked.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(r.line for r in lines) == list(range(1, 5001))
    assert all(json.loads(r.text)["n"] == r.line for r in lines)


def test_texts_of_good_lines_are_not_kept_beside_their_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "title": "T"}\n[1]\n{"title": "no id"}')
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    _, rejected = checked.check_lines(checked.read_lines(spark, str(tmp_path)))
    judged, = (p for p in set(shared.iterdir()) - before if p.name.startswith("judged"))
    assert {(r.line, r.text) for r in spark.read.parquet(str(judged)).collect()} == {(1, None), (2, "[1]"), (3, '{"title": "no id"}')}
    assert {(r.line, r.text) for r in rejected.collect()} == {(2, "[1]"), (3, '{"title": "no id"}')}


def test_lines_stay_where_they_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"id": str(n)}) for n in range(50)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of a table that is not small
    try:
        text = plan(checked.read_lines(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert [x for x in text.splitlines() if "Exchange hashpartitioning(file" in x and "text" in x] == []


def test_spoiled_lines_have_a_file_per_part_of_the_input(spark, tmp_path):
    rows = [(n, f"text {n}", "en", "web") for n in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task per file
    try:
        lines = registered.spoiled_lines(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert lines.select("file").distinct().count() == 7 and lines.count() == 70
    reasons = {r.reason: r.rows for r in registered.json_rejected(spark, str(tmp_path)).collect()}
    assert reasons == {checked.BROKEN: 7, checked.WRONG_TYPE: 7, checked.NO_KEY: 7}
    assert registered.json_checked(spark, str(tmp_path)).count() == 49


# k-means

def test_kmeans_of_clear_groups_ties_and_few_points(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8)) * 20
    rows = [(n, (middles[n % 6] + rng.normal(size=8)).tolist()) for n in range(300)] + [(n, None) for n in range(300, 305)]
    points = spark.createDataFrame(rows, "id long, embedding array<double>")
    centers = kmeans.fit(points, 6)
    gap = np.sqrt(np.square(centers[:, None] - middles[None]).sum(axis=2))
    assert sorted(gap.argmin(axis=1).tolist()) == list(range(6)) and gap.min(axis=1).max() < 1
    assert np.array_equal(centers, kmeans.fit(points.repartition(5), 6)) or np.allclose(np.sort(centers, axis=0), np.sort(kmeans.fit(points.repartition(5), 6), axis=0))
    same = spark.createDataFrame([(n, [1.0, float(n % 2)]) for n in range(40)], "id long, embedding array<double>")
    assert sorted(kmeans.fit(same, 5).tolist()) == [[1.0, 0.0], [1.0, 1.0]]
    with pytest.raises(ValueError, match="empty"):
        kmeans.fit(points.where("id > 299"), 3)


def test_kmeans_step_is_a_mean_per_nearest_center(spark):
    points = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").limit(200)
    x = np.array([r.embedding for r in points.orderBy("id").collect()], float)
    centers = x[:7]
    near = np.square(x[:, None] - centers[None]).sum(axis=2).argmin(axis=1)
    for r in kmeans.lloyd_step(points, centers).collect():
        assert r.n == (near == r.cluster).sum()
        assert np.allclose(r.center, x[near == r.cluster].mean(axis=0))
