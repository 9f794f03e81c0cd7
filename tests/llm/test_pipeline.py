"""The pipeline: every stage against a plain version on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from latticode.llm import mixing, quality_crf
from latticode.llm.queries import field_of

from .test_rules_and_tables import WORD
from .test_texts import groups_of

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs, (docs := stage(spark, docs, SF).cache())
        if name != "SentencePiece":
            assert docs.columns == columns
    field = field_of(seen["quality classifier"][0], SF)
    before, after = seen["quality classifier"]
    scored = quality_crf.with_quality(before, field).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scored if r["quality"] >= 0.3}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    assert all((i in kept) == (q == 1) for i, q in labels.items() if i in {r["doc_id"] for r in scored})

    before, after = seen["exact dedup"]
    first = {}
    for r in sorted(before.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(" ".join(WORD.findall(f"x{r['text']}x")), r["doc_id"])
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(first.values())

    before, after = seen["n-gram Jaccard join"]
    groups = groups_of([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(i for i, _, root in groups.elements() if i == root)

    before, after = seen["mixing"]
    taken = {r["id"]: r["taken"] // r["size"] for r in mixing.mixed_sizes(before).collect() if r["size"]}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({i: n for i, n in taken.items() if n})

    before, after = seen["SentencePiece"]
    assert after.where("agreed").count() == before.count()
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, after.collect()))


def test_stages_on_awkward_rows(spark, awkward, none):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        docs = stage(spark, docs, SF).cache()
    counts = defaultdict(int)
    for r in docs.collect():
        counts[r["doc_id"]] += 1
    assert counts[13] in (0, 1, 2)
