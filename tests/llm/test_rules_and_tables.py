"""Sharding, quality rules, mixing and exact duplicates."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from latticode.llm import exact_dedup, mixing, quality_rules, sharding
from latticode.llm.queries import op1_sharding, op2_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_matrix_has_the_given_sums():
    have, want = np.array([5, 0, 17, 8]), np.array([10, 10, 10])
    m = sharding.communication_matrix(have, want, 3)
    assert (m.sum(axis=1) == have).all() and (m.sum(axis=0) == want).all() and (m >= 0).all()


def test_matrix_follows_the_hypergeometric_law():
    have, want = np.array([6, 14]), np.array([10, 10])
    first = [sharding.communication_matrix(have, want, seed)[0, 0] for seed in range(3000)]
    # mean 3, variance 6 * 0.5 * 0.5 * 14 / 19
    assert abs(np.mean(first) - 3) < 0.1 and abs(np.var(first) - 6 * 0.25 * 14 / 19) < 0.12


@pytest.mark.parametrize("slice_rows", [7, 1_000_000])
def test_shards_are_exact_and_slots_have_no_gaps(spark, awkward, slice_rows):
    for docs in (documents(spark), awkward):
        rows = sharding.shard_documents(docs.repartition(5), 24, slice_rows=slice_rows).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        n = docs.count()
        assert len(rows) == n
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        sizes = [len(slots[k]) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                        for r in docs.collect())
        assert Counter((r["id"], r["size"], r["text_crc32"]) for r in rows) == texts


def test_shuffle_depends_on_the_seed_only(spark, none):
    docs = documents(spark)
    a, b, c = (sorted(map(tuple, sharding.shard_documents(docs, 24, seed=s).collect())) for s in (1, 1, 2))
    assert a == b != c
    assert sharding.shard_documents(none).count() == 0
    assert op1_sharding(spark, SF).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def rules(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_rules(spark, awkward):
    for docs in (documents(spark), awkward):
        got = quality_rules.base_rules(docs.select("doc_id", "text")).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                    r["base_failed"]) == rules(r["text"])


def test_ratio_is_that_of_the_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c c"), (3, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    n = 64
    got = {r["id"]: r for r in quality_rules.quality_rules(docs, trusted, n=n, threshold=0.0).collect()}
    hashes = {r["doc_id"]: r["b"] for r in docs.select("doc_id", quality_rules.buckets(
        quality_rules.F.transform(quality_rules.words_of("text"), lambda w: quality_rules.F.xxhash64(w)), n).alias("b")).collect()}
    raw, target = Counter(sum(hashes.values(), [])), Counter(hashes[1])
    for i, b in hashes.items():
        each = [np.log((target[x] + 1) / (sum(target.values()) + n)) - np.log((raw[x] + 1) / (sum(raw.values()) + n))
                for x in b]
        assert got[i]["ratio"] == pytest.approx(np.mean(each) if b else 0.0, abs=1e-6)
    assert got[1]["ratio"] > got[2]["ratio"] and not got[1]["kept"]  # too short for the base rules


def test_rules_on_awkward_rows(spark, awkward, none):
    trusted = spark.createDataFrame([], "id long")
    assert quality_rules.quality_rules(awkward, trusted).count() == awkward.count()
    assert quality_rules.quality_rules(none, trusted).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = op2_quality_rules(spark, SF).toPandas().set_index("doc_id")
    long = kept[~kept.base_failed].join(labels, how="inner")
    assert long[long.quality == 1].kept.mean() > 0.9


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The contract, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_follow_the_contract(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {(f"s{k}" if k else None): int(rng.integers(0, 10 ** rng.integers(1, 6))) for k in range(rng.integers(2, 9))}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r for r in mixing.source_rates(rows).collect()}
    for s, t in targets(sizes).items():
        assert got[s]["target"] == pytest.approx(t, rel=1e-9)
        assert got[s]["rate"] <= 2


def test_mix_is_near_its_targets_and_repeatable(spark, awkward, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    a = mixing.mixed_sizes(docs).toPandas()
    assert a.equals(mixing.mixed_sizes(docs).toPandas())
    by = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() / by.target).max() < 0.15
    assert (a.taken <= 2 * a["size"]).all()
    assert mixing.mixed_sizes(awkward).count() == awkward.count()
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mix(none).count() == 0
    out = mixing.mix(awkward)
    taken = Counter(r["id"] for r in mixing.mixed_sizes(awkward).collect() for _ in range(r["taken"] // r["size"] if r["size"] else 0))
    assert Counter(r["doc_id"] for r in out.where("length(trim(text)) > 0").collect() if WORD.search(r["text"])) == taken
    assert out.columns == awkward.columns


def test_runs_stay_with_their_nodes(spark, awkward):
    table = exact_dedup.written(exact_dedup.digests(awkward), "digests")
    for fan_in in (2, 4):
        rounds, runs = exact_dedup.tree_rounds(table, fan_in), exact_dedup.merge_runs(table, fan_in)
        plan = runs._jdf.queryExecution().executedPlan().toString()
        assert rounds > 1 and runs.rdd.getNumPartitions() == fan_in ** rounds
        assert plan.count("Exchange shufflepartitionidpassthrough") == plan.count("Exchange ") == rounds
        node = exact_dedup.F.pmod(exact_dedup.F.xxhash64(*exact_dedup.KEY), exact_dedup.F.lit(fan_in ** rounds))
        assert runs.where(node != exact_dedup.F.spark_partition_id()).count() == 0
        assert sum(r["size"] for r in runs.collect()) == awkward.count()


def test_exact_groups(spark, awkward, none):
    rows = awkward.select("doc_id", "text").collect()
    even = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[even(r["text"])].append(r["doc_id"])
    order = lambda i: (i is None, i)
    for fan_in in (2, 8):
        got = exact_dedup.duplicate_groups(awkward, fan_in=fan_in).collect()
        by_sha = {hashlib.sha256(k.encode()).hexdigest(): sorted(v, key=order) for k, v in groups.items()}
        assert len(got) == len(rows)
        for r in got:
            ids = by_sha[r["text_sha256"]]
            assert (r["keep_id"], r["group_size"]) == (ids[0], len(ids))
        assert sum(r["kept"] for r in got) == len(groups)
    stay = exact_dedup.deduplicate(awkward)
    assert stay.columns == awkward.columns
    assert sorted((r["doc_id"] for r in stay.collect()), key=order) == sorted(
        (sorted(v, key=order)[0] for v in groups.values()), key=order)
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("have, want", [([3 * 10 ** 9] * 2 + [7, 0], [1 * 10 ** 9] * 6 + [7]), ([10 ** 12], [10 ** 12 // 8] * 8),
                                        ([5 * 10 ** 8] * 8, [2 * 10 ** 9] * 2)])
def test_matrices_of_more_rows_than_the_library_draws_from(have, want):
    have, want = np.array(have, np.int64), np.array(want, np.int64)
    matrix = sharding.communication_matrix(have, want, 3)
    assert (matrix >= 0).all() and (matrix.sum(axis=0) == want).all() and (matrix.sum(axis=1) == have).all()
    mean = have[:, None] * (want / want.sum())[None, :]
    assert (np.abs(matrix - mean) <= 6 * np.sqrt(mean) + 1).all()


def test_the_two_ways_to_draw_follow_one_law():
    rng = np.random.default_rng(8)
    for first, rest, n in ((30, 50, 20), (5, 3, 6), (0, 9, 4), (400, 2, 300), (7, 0, 3)):
        ours = np.bincount([sharding.draw_first(rng, first, rest, n, 1) for _ in range(20_000)], minlength=n + 1)
        law = np.array([math.comb(first, k) * math.comb(rest, n - k) / math.comb(first + rest, n) if n - k <= rest else 0.0
                        for k in range(n + 1)])
        assert (np.abs(ours / 20_000 - law) <= 5 * np.sqrt(law / 20_000) + 1e-4).all()
    parts = np.array([sharding.draw_slices(rng, np.array([4, 1, 7, 3]), 9, 1) for _ in range(4_000)])
    assert (parts.sum(axis=1) == 9).all() and (parts <= [4, 1, 7, 3]).all()
    assert np.abs(parts.mean(axis=0) - 9 * np.array([4, 1, 7, 3]) / 15).max() < 0.06
