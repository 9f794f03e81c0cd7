"""Edge cases of the text columns."""

import pytest
from pyspark.sql import functions as F

from latticode.functions import text
from latticode.plans import papers


def one(spark, value, build):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(build(F.col("t")).alias("out")).first().out


def rows(spark, *values):
    return spark.createDataFrame([(str(i), *v) for i, v in enumerate(values)],
                                 "id string, title string, abstract string, authors string")


def test_length_filter(spark):
    df = rows(spark, ("a", "x" * 150, ""), ("b", "x" * 151, ""), ("c", "", ""), ("d", None, ""), (None, "x" * 200, ""))
    kept = papers.contents(df).collect()
    assert [(r.id, r.content) for r in kept] == [("1", "Title: b | Abstract: " + "x" * 151)]


def test_length_counts_characters_not_bytes(spark):
    assert one(spark, "é" * 151, text.is_long_enough) is True
    assert one(spark, "𝛼" * 150, text.is_long_enough) is False


def test_content_is_null_with_a_null_part(spark):
    df = rows(spark, (None, "a", ""), ("t", None, ""))
    assert [r.c for r in df.select(text.content(F.col("title"), F.col("abstract")).alias("c")).collect()] == [None, None]


def test_split_keeps_later_bars(spark):
    df = spark.createDataFrame([("1", "Title:  A | B | Abstract: left | Abstract: right | more ")], "id string, content string")
    row = papers.split_contents(df).first()
    assert (row.title_part, row.abstract_part) == ("Title:  A | B", "left | Abstract: right | more")


def python_snippet(value):
    line = (value or "").strip().replace("\n", " ")
    return line[:280].rsplit(" ", 1)[0] + "…" if len(line) > 280 else line


@pytest.mark.parametrize("value", [
    None, "", "   ", "word " * 56, "x" * 280, "x" * 281, "ab " * 94, "\n a\nb 　", "é" * 279 + " tail",
    "\x1c\x85 lead " + "word\n" * 80, "a" * 279 + "\nbc", " " * 300 + "x" * 290, "one\r\ntwo " * 60, "𝛼" * 300,
])
def test_snippet(spark, value):
    assert one(spark, value, text.snippet) == python_snippet(value)


def test_strip_is_unicode_strip(spark):
    import sys

    spaces = "".join(chr(c) for c in range(sys.maxunicode) if chr(c).isspace())
    assert one(spark, spaces + "a" + spaces + "b" + spaces, text.strip) == "a" + spaces + "b"
    assert one(spark, "​x​", text.strip) == "​x​"


def test_card(spark):
    row = papers.result_cards(rows(spark, (" T\n", " some text ", "A. Author"))).first()
    assert row.asDict() == {"id": "0", "title": "T", "snippet": "some text", "authors": "A. Author",
                            "abstract": "some text", "link": "https://arxiv.org/abs/0"}


def test_one_line(spark):
    row = papers.one_line_texts(rows(spark, (" a\nb ", " c\nd ", ""))).first()
    assert (row.title, row.abstract) == ("ab", "c d")
