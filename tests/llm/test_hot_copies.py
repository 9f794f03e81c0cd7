"""Near duplicates where a third of all rows are copies of one text and a third are blank."""

from pyspark.sql import functions as F

from latticode.llm import jaccard_join


def test_copies_and_blanks_of_a_third_each(spark):
    n = 6000
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(9)])
    text = (F.when(F.col("id") % 3 == 0, F.lit("the same nine words stand in all of these"))
            .when(F.col("id") % 3 == 1, F.when(F.col("id") % 2 == 0, F.lit(" \n "))).otherwise(words))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = {r["id"]: r for r in jaccard_join.near_duplicates(docs, block_bytes=1 << 15).collect()}
    assert len(got) == n
    assert all(got[i]["component_id"] == (0 if i % 3 == 0 else i) for i in got)
    assert all(got[i]["n_shingles"] == (0 if i % 3 == 1 else 5) for i in got)


def test_rows_without_ids_share_a_class(spark):
    rows = [(None, "one two three four five six")] * 40 + [(7, "One two three four five six"), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(None, 2, 7)] * 40 + [(7, 2, 7), (None, 0, None), (8, 0, 8)], key=repr)
    assert jaccard_join.one_of_each(docs).count() == len(rows)
