"""Operators that run on blocks of texts, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import plan
from latticode.llm import backoff_lm, blocks, components, jaccard_join, pieces, quality_crf, substring_dedup, suffix_dedup
from latticode.llm.queries import field_of, model_path, op3_quality_crf
from latticode.llm.words import Words, windows, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SMALL = 3000  # bytes of a block, so that small tables have many


def split(text):
    return WORD.findall((text or "").encode())


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


@pytest.fixture(scope="session")
def shared_rows(spark, awkward):
    """Rows that share passages and near copies, and the awkward ones."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "Mi", "né", "zu") for b in ("r", "st", "ll", "x", "no", "pe")]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages, base = [line(n) for n in (20, 36, 60, 90)], [line(70) for _ in range(3)]
    rows = []
    for k in range(90):
        parts = [line(rng.randint(0, 40))]
        if k % 3 == 0:
            parts.append(rng.choice(passages))
        if k % 4 == 0:
            w = rng.choice(base).split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            parts = [" ".join(w)]
        rows.append((100 + k, rng.choice([" ", "\n", "  "]).join(parts)))
    rng.shuffle(rows)
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    return awkward.select("doc_id", "text").union(extra).repartition(5)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def counted(rows, columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def test_words_and_windows():
    texts = ["a b  a", None, "", "b\na b", " a", "é a", "a\x0bb\x0cc\rd\te"]
    w = words(pa.array(texts))
    assert [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)] == [x for t in texts for x in split(t)]
    assert np.diff(w.first).tolist() == [len(split(t)) for t in texts]
    same = {}
    for h, a, b in zip(w.hashes, w.starts, w.ends):
        assert same.setdefault(bytes(w.data[a:b]), h) == h
    assert len(set(same.values())) == len(same)
    starts, _ = windows(w, 2)
    assert len(starts) == sum(max(0, len(split(t)) - 1) for t in texts)
    assert isinstance(words(pa.array([], pa.string())), Words)


def test_packed_arrays_come_back():
    arrays = [np.array([1, 2 ** 63], np.uint64), np.zeros(0, np.int32), np.arange(9, dtype=np.int64), np.array([7], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, blocks.unpack(blocks.pack(*arrays))))


@pytest.mark.parametrize("period", sorted(substring_dedup.COVERS))
def test_covers_have_every_difference(period):
    cover = substring_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("size, period", [(35, 21), (12, 7), (35, 31)])
def test_repeated_words(shared_rows, none, size, period):
    rows = pairs(shared_rows)
    seen = Counter(tuple(w[i:i + size]) for w in (split(t) for _, t in rows) for i in range(len(w) - size + 1))
    want = Counter()
    for i, t in rows:
        w = split(t)
        gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k:k + size])] > 1 for j in range(k, k + size)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.remove_repeats(shared_rows, size=size, period=period, block_bytes=SMALL).collect()
    assert counted(got, ["id", "n_words", "n_removed", "kept_sha256"]) == want
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("letters, depth", [(1, 50), (2, 9), (3, 50), (200, 50)])
def test_suffix_array(letters, depth):
    rng = np.random.default_rng(letters)
    for n in range(1, 60):
        s = rng.integers(1, letters + 1, n)
        order = suffix_dedup.suffix_array(s, depth)
        assert sorted(order) == list(range(n))
        heads = [tuple(s[i:i + depth]) for i in order]
        assert heads == sorted(heads)


@pytest.mark.parametrize("letters, depth", [(1, 50), (2, 9), (200, 50), (1 << 31, 50)])
def test_suffix_array_of_wanted(letters, depth):
    rng = np.random.default_rng(letters)
    for n in range(1, 60):
        s, wanted = rng.integers(1, letters + 1, n), rng.random(n) < rng.random()
        order = suffix_dedup.suffix_array(s, depth, wanted=wanted)
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        heads = [tuple(s[i:i + depth]) for i in order]
        assert heads == sorted(heads)


@pytest.mark.parametrize("kept", [64, 3])
def test_items_stand_in_one_order(monkeypatch, kept):
    """However texts lie, and with hashes of few bits that differ: blocks are read twice, in any order."""
    whole = suffix_dedup.byte_hashes
    monkeypatch.setattr(suffix_dedup, "byte_hashes", lambda *a: whole(*a) & np.uint64((1 << kept) - 1))
    rng, orders = np.random.default_rng(6), []
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    start, key = rng.integers(0, 3900, 300), rng.integers(0, 5, 300).astype(np.uint64)
    count = 1 + start % 7
    for _ in range(3):
        by = rng.permutation(300)
        items = suffix_dedup._items(data, suffix_dedup.Stretches(start[by], count[by], key[by]), 50)
        place = [(int(k), int(count[by][f]), int(whole(data, start[by][f:f + 1], (start + count)[by][f:f + 1] + 49)[0])
                  & ((1 << kept) - 1)) for k, f in zip(items.keys, items.firsts)]
        assert len(set(place)) == len(place) and [p[0] for p in place] == sorted(p[0] for p in place)
        assert all(place[n] == place[items.number[f]] for n, f in enumerate(items.firsts))
        orders.append(place)
    assert orders[0] == orders[1] == orders[2]


def test_stretches_alone_are_not_sorted(monkeypatch):
    """Copies meet before the sort; only stretches that share a tag with others are sorted, and only their strings."""
    seen, whole = [], suffix_dedup.equal_strings
    monkeypatch.setattr(suffix_dedup, "equal_strings",
                        lambda data, starts, size: seen.append((bytes(data), len(starts))) or whole(data, starts, size))
    rng = np.random.default_rng(4)
    alone, left, right = (rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (60, 55, 57))
    right = left[:50] + right[50:]                          # its first string is another's first
    rows = [(alone, 7, 1), (left, 9, 2), (alone, 3, 1), (right, 5, 2), (alone, 7, 1)]
    for tags, want in ((slice(0, 5), [(left + right, 6 + 8)]), (slice(0, 1), []), (slice(0, 3, 2), [])):
        some = rows[tags]
        got = suffix_dedup._sorted_range(
            np.array([len(t) for t, _, _ in some]), np.array([d for _, d, _ in some]),
            np.array([t for _, _, t in some], np.uint16), np.frombuffer(b"".join(t for t, _, _ in some), np.uint8), 50)
        docs = {}
        for t, d, _ in some:
            for k in range(len(t) - 49):
                docs[t[k:k + 50]] = min(docs.get(t[k:k + 50], d), d)
        assert got.tolist() == [docs[t[k:k + 50]] for t, _, _ in some for k in range(len(t) - 49)]
        assert seen == want
        seen.clear()


@pytest.mark.parametrize("size, short, hot", [(50, 16, 1 << 18), (20, 9, 1 << 18), (50, 16, 120), (20, 8, 0)])
def test_earlier_bytes(shared_rows, none, size, short, hot):
    rows, first = pairs(shared_rows), {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            name = b[k:k + size]
            first[name] = min(first.get(name, math.inf), math.inf if i is None else i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if first[b[k:k + size]] < (math.inf if i is None else i):
                gone[k:k + size] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.remove_earlier_repeats(shared_rows, size=size, short=short, block_bytes=SMALL,
                                              hot_bytes=hot).collect()
    assert counted(got, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want
    assert suffix_dedup.remove_earlier_repeats(none).count() == 0


def test_texts_are_shuffled_once(spark, shared_rows):
    """One query makes all of it: nothing is written before, and one exchange of texts is used three times."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = plan(suffix_dedup.remove_earlier_repeats(shared_rows, block_bytes=SMALL)).splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert set(shared.iterdir()) == before
    assert len([x for x in lines if "- Exchange hashpartitioning(block" in x]) == 1
    assert len([x for x in lines if "ReusedExchange" in x]) == 3  # texts twice, questions once


@pytest.mark.parametrize("order, mu", [(1, 5.0), (2, 300.0), (3, 4.0)])
def test_language_model(spark, shared_rows, none, order, mu):
    rows = [(i, split(lower(t).decode()) + ["END"]) for i, t in pairs(shared_rows)]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    count = Counter()
    for i, t in rows:
        s = ["START", *t]
        for m in range(1, order + 1):
            count.update(tuple(s[k:k + m]) for k in range(len(s) - m + 1) if learn(i))
    words_ = {g[0]: c for g, c in count.items() if len(g) == 1 and g != ("START",)}
    total = sum(words_.values())

    def p(history, w):
        if not history:
            return (words_.get(w, 0) + 0.5) / (total + 0.5 * (len(words_) + 1))
        return (count[(*history, w)] + mu * p(history[1:], w)) / (count[history] + mu)

    train = (substring_dedup.blocks.F.crc32(substring_dedup.blocks.F.col("doc_id").cast("string").cast("binary")) % 5) != 1
    got = backoff_lm.score_documents(shared_rows, train, order=order, mu=mu, block_bytes=SMALL).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        s = ("START", *t)
        want[i, len(t), sum(w in words_ for w in t)].append((
            sum(math.log10(p((), w)) for w in t),
            sum(math.log10(p(tuple(s[max(0, k - order + 1):k]), s[k])) for k in range(1, len(s)))))
    for r in got:
        assert r["train_tokens"] == total
        ours = r["base_score"], r["score"]
        assert any(ours == pytest.approx(w, rel=1e-9) for w in want[r["id"], r["n_tokens"], r["n_known"]])
    assert backoff_lm.score_documents(none, train).count() == 0
    nothing = backoff_lm.score_documents(shared_rows.where("doc_id < 9"), substring_dedup.blocks.F.lit(False)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and {r["n_known"] for r in nothing} == {0}


def test_probabilities_of_a_state_add_up(shared_rows):
    texts = [t for _, t in pairs(shared_rows)][:40]
    table = pa.table({"text": pa.array(texts, pa.string())})
    t = backoff_lm.tokens(table)
    g = backoff_lm.grams(t, np.ones(len(texts), bool), 2)
    first = (g.level == 1) & (g.keys != backoff_lm.START)
    total, distinct = int(g.count[first].sum()), int(first.sum())
    a = backoff_lm.automaton(g, g.count.astype(np.int64), total, distinct, 2, 7.0)
    k, unseen = len(a.vocabulary), 0.5 / (total + 0.5 * (distinct + 1))
    root = {int(x % k): 10 ** w for x, w in zip(a.arcs, a.weight) if x < k and a.vocabulary[x % k] != backoff_lm.START}
    assert sum(root.values()) + unseen == pytest.approx(1)
    for state in range(1, len(a.fail_weight)):
        own = {int(x % k): 10 ** w for x, w in zip(a.arcs, a.weight) if x // k == state}
        back = 10 ** a.fail_weight[state]
        rest = sum(p for w, p in root.items() if w not in own) + unseen
        assert sum(own.values()) + back * rest == pytest.approx(1)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert got == {n: r for n, r in root.items() if n in got} and set(root) - set(got) <= alone


def groups_of(rows, n, percent):
    sets = []
    for _, t in rows:
        w = split(lower(t).decode())
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return Counter((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


@pytest.mark.parametrize("n, percent, piece, counters", [(4, 85, 2048, 5), (5, 80, 3, 0.001), (2, 60, 2, 0.01)])
def test_near_groups(shared_rows, none, n, percent, piece, counters):
    got = jaccard_join.near_duplicates(shared_rows, n=n, percent=percent, piece=piece, counters_per_byte=counters,
                                       block_bytes=SMALL)
    assert counted(got.collect(), ["id", "n_shingles", "component_id"]) == groups_of(pairs(shared_rows), n, percent)
    assert jaccard_join.near_duplicates(none).count() == 0


def test_trie_finds_what_comparison_finds():
    rng = np.random.default_rng(3)
    for trial in range(60):
        base = np.unique(rng.integers(0, 40, 14))
        sets = {tuple(np.unique(np.where(rng.random(len(base)) < 0.2, rng.integers(0, 60, len(base)), base)))
                for _ in range(25)}
        sets = [np.array(s, np.int64) for s in sorted(sets)]
        trie = jaccard_join.build_trie(sets)
        for x in sets:
            inside = np.zeros(60, bool)
            inside[x] = True
            got = jaccard_join.probe(trie, x, inside, 70, np.zeros(len(sets) + 1, np.int64))
            want = [k for k, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 70 * len(np.union1d(x, y))]
            assert sorted(got) == want


def test_one_of_each(shared_rows, none):
    left = jaccard_join.one_of_each(shared_rows, n=4, percent=85, block_bytes=SMALL)
    assert left.columns == shared_rows.columns
    want = Counter(i for i, _, root in groups_of(pairs(shared_rows), 4, 85).elements() if root in (None, i))
    assert Counter(r["doc_id"] for r in left.collect()) == want
    assert jaccard_join.one_of_each(none).count() == 0


def test_pieces_agree_with_the_library(shared_rows, none):
    with open(model_path(), "rb") as f:
        own = pieces.Pieces(f.read())
    rng = random.Random(4)
    odd = ["", " ", "  a", "a  ", "▁", "▁▁x▁", "<s></s><unk><0x41>", "\x00", "\n\n", "é漢😀�́", "a" * 500, "ab" * 60 + " x"]
    odd += ["".join(rng.choice(" ▁abcthein\t\n漢é😀<>0x4s�") for _ in range(rng.randint(0, 70))) for _ in range(3000)]
    for t in odd:
        ids = own.encode(t)
        assert ids == own.library.encode(t, add_eos=True)
        assert own.decode(ids) == own.library.decode(ids)
    assert [own.encode(t) for t in odd] == [own.library.encode(t, add_eos=True) for t in odd]
    words = sorted({w for t in odd for w in ("▁" + t.replace(" ", "▁"), t[:40], t[:2])})
    ids, ends = own.merge_words(words)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [own.merge(w) for w in words]
    ids, ends, back = own.encode_texts(odd)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == own.library.encode(odd, add_eos=True)
    assert back == own.library.decode(own.library.encode(odd, add_eos=True))
    pieces.check(own, odd, ids, ends, back)
    with pytest.raises(ValueError, match="encoder"):
        pieces.check(own, odd, np.where(np.arange(len(ids)) == 7, 99, ids), ends, back)
    with pytest.raises(ValueError, match="decoder"):
        pieces.check(own, odd, ids, ends, [*back[:-1], "x"])
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == own.library.decode(ids)
    got = pieces.encode_documents(shared_rows, model_path(), with_ids=True).collect()
    texts = Counter((i, t or "") for i, t in pairs(shared_rows))
    assert all(r["agreed"] for r in got) and Counter((r["id"], own.decode(r["ids"])) for r in got) == texts
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"]) == (
            len(r["ids"]), hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest())
    assert pieces.encode_documents(none, model_path()).count() == 0


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(2)
    first, score, a = np.array([0, 1, 5, 8]), rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected = quality_crf.marginals(first, score, a)
    want, pairs_ = np.zeros(8), np.zeros((2, 2))
    for low, high in zip(first, first[1:]):
        total, each, steps = 0.0, np.zeros(high - low), np.zeros((2, 2))
        for number in range(2 ** (high - low)):
            y = [(number >> k) & 1 for k in range(high - low)]
            weight = math.exp(sum(score[low + k] * v for k, v in enumerate(y)) + sum(a[u, v] for u, v in zip(y, y[1:])))
            total += weight
            each += weight * np.array(y)
            for u, v in zip(y, y[1:]):
                steps[u, v] += weight
        want[low:high] = each / total
        pairs_ += steps / total
    assert good == pytest.approx(want) and expected == pytest.approx(pairs_)


def test_lines_of_texts():
    texts = pa.array(["a b\n\n c c!\nA #b", None, "", " \n ", "x", "a b\nx\na b"])
    lines = quality_crf.line_features(texts)
    assert np.diff(lines.first).tolist() == [3, 1, 1, 1, 1, 3]
    assert lines.length.tolist() == [3, 5, 4, 0, 0, 0, 1, 3, 1, 3]
    symbols, again, repeated = (lines.features[:, k] for k in (0, 6, 8))
    assert symbols[2] == 0.25 and again[1] == 0.0 and repeated.tolist()[-3:] == [1, 0, 1]


def test_held_out_quality(spark, shared_rows, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op3_quality_crf(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = (rows[rows.quality == k].score.to_numpy() for k in (1, 0))
    auc = np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])
    assert auc > 0.98 and (rows.predicted == rows.quality).mean() > 0.97
    field = field_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001")
    scored = quality_crf.with_quality(shared_rows, field).collect()
    assert len(scored) == shared_rows.count() and all(0 <= r["quality"] <= 1 for r in scored)
    assert quality_crf.with_quality(none, field, name="size").count() == 0
    nothing = quality_crf.train(none, spark.createDataFrame([], "id long, good boolean"))
    assert {r["quality"] for r in quality_crf.with_quality(shared_rows, nothing).collect()} == {0.5}


@pytest.fixture(scope="module")
def twins():
    """Two words of 1,024 letters that sums of powers modulo 2^64 cannot tell apart."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_twin_words_have_hashes_of_their_own(spark, twins):
    w = words(pa.array([*twins, twins[0], "", twins[0] + "a", "x" * 8, "x" * 9, "x" * 16, "x" * 7]))
    assert w.hashes[0] == w.hashes[2] and len(set(w.hashes.tolist())) == 7
    one = spark.createDataFrame([(1, twins[0]), (2, twins[1])], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in jaccard_join.near_duplicates(one).collect()}
    assert got == {1: 1, 2: 2}
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{twins[0]} {rest}"), (2, f"{twins[1]} {rest}")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {0}
    scored = backoff_lm.score_documents(docs, F.col("doc_id") == 1).collect()
    assert {r["id"]: (r["n_tokens"], r["n_known"]) for r in scored} == {1: (36, 36), 2: (36, 35)}


def test_words_hash_alike_wherever_they_stand():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cé漢\n") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    w = words(pa.array(texts))
    seen = {}
    for a, b, h in zip(w.starts, w.ends, w.hashes.tolist()):
        seen.setdefault(w.data[a:b].tobytes(), set()).add(h)
    assert all(len(v) == 1 for v in seen.values()) and len({h for v in seen.values() for h in v}) == len(seen)


def test_replies_go_to_the_blocks_that_asked():
    keys = {0: [3, 5, 9], 1: [5, 7], 2: [2], 4: [3, 9, 11]}
    rows = [(0, b, blocks.pack(np.array(k, np.uint64), np.array([x == 9 and b == 4 for x in k], np.uint8))) for b, k in keys.items()]
    got = {to: blocks.unpack(body)[0].tolist() for to, _, body in blocks.repeated_elsewhere(0, blocks.letters(rows[::-1]))}
    assert got == {0: [3, 5, 9], 1: [5], 4: [3]}


def test_null_texts_count_for_blocks(spark):
    nulls = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert blocks.blocked(nulls, block_bytes=1600)[1] == 20
