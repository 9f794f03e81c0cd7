"""Fill-in-middle, web page text and source divergence against plain versions."""

import hashlib
import html
import re
from collections import Counter, defaultdict
from functools import partial

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import DATA
from latticode.llm import divergence, fill_middle, html_text, queries
from latticode.llm.oracles import OP11, OP13


# fill-in-middle

@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a\nédß漢😀", max_size=300), st.integers(1, 900))
def test_boundaries_are_those_of_the_string(text, times):
    text = (text * times)[:90_000]
    edges = fill_middle.Boundaries(np.frombuffer(text.encode(), np.uint8))
    assert edges.size == len(text)
    for k in {0, len(text) // 3, len(text) // 2, max(0, len(text) - 1), len(text)}:
        assert edges.select(k) == len(text[:k].encode())


def test_every_kind_of_container_is_used():
    def kinds(text):
        return [type(c) for c in fill_middle.Boundaries(np.frombuffer(text.encode(), np.uint8)).containers]

    assert kinds("a" * 200_000) == [fill_middle.Runs] * 4
    assert kinds("漢" * 30_000) == [fill_middle.Bitmap] * 2
    assert kinds("漢é" * 300) == [fill_middle.Positions]
    assert kinds("a" * 65_536 + "漢" * 21_845) == [fill_middle.Runs, fill_middle.Bitmap]


def plain_cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_awkward_rows_are_cut_and_restored(spark, awkward):
    more = spark.createDataFrame([(k, t) for k, t in enumerate(
        ["<P>", "x<S>y", "a <M", "P> < S> <<", "漢字" * 50_000 + "a" * 70_000, "é" * 3, "\U0001f600"] * 9, 100)], "doc_id long, text string")
    for docs in (awkward, more):
        out = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored("output", "form"))
        rows = sorted((tuple(r) for r in out.select("id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()), key=repr)
        given_rows = docs.select("doc_id", "text").collect()
        assert rows == sorted(((i, *plain_cut(i, t), t or "") for i, t in given_rows), key=repr)


def test_no_rows_in_no_rows_out(none):
    assert fill_middle.fill_in_middle(none).count() == 0
    assert divergence.audit_sources(none).count() == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x")])
def test_marks_that_could_be_mistaken_are_refused(none, marks):
    if marks == ("aa", "b", "c"):
        marks = ("aba", "c", "d")
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(none, marks=marks)


# source divergence

def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in here for t in set(w))
        kept = sorted((t for t in df if df[t] >= min_docs), key=str.encode)
        count = defaultdict(Counter)
        for _, source, w in here:
            count[source].update(t for t in w if df[t] >= min_docs)
        whole = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10 ** 9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        for a in count:
            pairs = sorted(((-sum(gap(share(count[a], t), share(count[b], t)) for t in kept), b.encode(), b) for b in count if b != a))
            out += [(lang, a, "pair", b, -v, k) for k, (v, _, b) in enumerate(pairs, 1)]
            far = sorted((-gap(share(count[a], t), share(whole, t)), t.encode(), t) for t in kept
                         if count[a][t] and share(count[a], t) > share(whole, t))
            out += [(lang, a, "term", t, -v, k) for k, (v, _, t) in enumerate(far[:top], 1)]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(5)
    terms = ["Alpha", "beta", "γάμμα", "delta's", "É", "漢字", "zeta9eta", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))]
    rows = [(["en", "fr", None][int(rng.integers(3))], [None, "s1", "s2", "S3", "ü"][int(rng.integers(5)) if rng.random() > 0.3 else 1],
             " ".join(rng.choice(terms, int(rng.integers(0, 60)), p=np.arange(1, len(terms) + 1)[::-1] / sum(range(len(terms) + 1)))))
            for _ in range(240)]
    return rows + [("xx", "only", "alone here"), ("xx", "two", None), ("yy", "one", ""), (None, None, None), ("en", "s1", rows[0][2])] + rows[:3]


@pytest.mark.parametrize("limits", [{"min_docs": 10, "top": 10}, {"min_docs": 1, "top": 2}])
def test_divergence_is_that_of_a_plain_version(spark, limits):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, term string, rank int").repartition(7)
    got = sorted(tuple(r) for r in divergence.audit_sources(docs, **limits).collect())
    assert got == plain_audit(rows, **limits)


def test_small_tiles_and_tables_give_the_same_audit(spark, monkeypatch):
    docs = spark.createDataFrame(audit_rows(), "lang string, source string, text string")
    whole = sorted(tuple(r) for r in divergence.audit_sources(docs, min_docs=3).collect())
    monkeypatch.setattr(divergence, "source_distances", partial(divergence.source_distances, tile_sources=2, tile_terms=7))
    monkeypatch.setattr(divergence, "group_skybands", partial(divergence.group_skybands, held=5))
    monkeypatch.setattr(divergence, "term_counts", partial(divergence.term_counts, held=20))
    assert sorted(tuple(r) for r in divergence.audit_sources(docs, min_docs=3).collect()) == whole


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_skyband_is_that_of_all_pairs(rows, k, step):
    c, b = (np.array([r[i] for r in rows], np.int64) for i in range(2))
    want = [sum(c[j] >= c[i] and b[j] <= b[i] for j in range(i)) < k for i in range(len(rows))]
    assert divergence.skyband(c, b, k, step).tolist() == want


@pytest.mark.parametrize("name, sql", [("op11_fill_middle", OP11), ("op13_divergence", OP13)])
def test_queries_equal_their_sql(spark, name, sql):
    sf = f"{DATA}/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.sql(sql)
    got = getattr(queries, name)(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


# web pages

def one(page):
    parsed = html_text.parse(page)
    best = html_text.best_container(parsed)
    return ("", None) if best is None else (parsed.text([best]), parsed.path(best))


LONG = "Some words of running text, which go on for a while and then stop. " * 3
CLEAN = " ".join(LONG.split())
PAGES = {
    "article": f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{LONG}</article><footer>&copy; me</footer>",
    "classes": f"<div class='top nav'>Menu here</div><div id=wrap><h1>T</h1><div class='post-42 content'><p>{LONG}</p></div></div>"
               f"<div class=sidebar><p>{LONG * 3}</p></div><div class=comments><p>{LONG * 5}</p></div>",
    "forms": f"<main><header><h1>T</h1><p>by someone</p></header><form><p>{LONG}</p><input></form><p>{LONG}</p><aside>{LONG}</aside>"
             f"<div class=cookie-notice>We use {LONG}</div><div hidden>{LONG}</div><p style='display: none'>x</p></main>",
    "tables": f"<table><tr><td><a href=1>one</a> <a href=2>two</a></td><td><h1>T</h1><p>{LONG}</td></tr></table>",
    "scripts": f"<script>var a = '<p>no</p>';</script><style>p{{}}</style><!-- <p>{LONG}</p> --><article><h1>T</h1>"
               f"<p>{LONG}<script>if (a</p>) b</script></p></article><noscript>{LONG}</noscript>",
    "unclosed": f"<body><ul class=menu><li><a href=1>a<li><a href=2>b</ul><article><h1>T</h1><p><b>{LONG}</article><div class=ad>Buy <b>now",
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    assert one(PAGES[name])[0] == f"T\n{CLEAN}"


def test_references_space_and_blocks():
    page = (f"<article><p>a&amp;b&nbsp;&lt;c&gt; &#233;&#x6f22; &am <i>in</i>line<br>next\n\t line<ul><li>one<li>two</ul>x < y"
            f"<blockquote>{LONG}</blockquote><p title='a > b' data-x=\"<p>\">end</p></article>")
    assert one(page)[0].split("\n") == ["a&b <c> é漢 &am inline next line", "one", "two", "x < y", CLEAN, "end"]


def test_pages_of_nothing():
    for page in ("", "   ", "<html><nav><a href=/>x</a></nav></html>", "<script>x", "<!-- ", "<", "<p", "</", "<div class='"):
        assert one(page)[0] in ("", "<")
    assert one("just words")[0] == "just words"


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + LONG + "</b>" * 20_000
    assert one(deep)[0] == CLEAN
    wide = "<article>" + f"<p>{LONG}" * 5_000 + "</article>"
    assert one(wide)[0] == "\n".join([CLEAN] * 5_000)
    assert one("<ul><li>" * 5_000 + LONG)[0] == CLEAN


def test_hosts_agree_on_a_path(spark):
    """Where comments are longer than the article, the other pages tell."""
    body = "<div class='x1'><h1>T{k}</h1><p>{article}</p></div><div class='x2'><p>{rest}</p></div>"
    rows = [(k, f"http://Host.example/{k}", body.format(k=k, article=LONG * 4, rest="fine")) for k in range(6)]
    rows += [(6, "https://user@host.example:80/6", body.format(k=6, article="short", rest=LONG * 9)),
             (7, "http://host.example/7", f"<article><p>{LONG}</article>"), (8, None, body.format(k=8, article="short", rest=LONG)),
             (9, "not a url", None), (10, "http://alone.example", body.format(k=10, article="short", rest=LONG)), (None, None, ""),
             (6, "https://user@host.example:80/6", body.format(k=6, article="short", rest=LONG * 9))]
    pages = spark.createDataFrame([(*r, "a", 3) for r in rows], "page_id long, url string, html string, path string, host int").repartition(3)
    text = defaultdict(list)
    for r in html_text.extract_text(pages).collect():
        text[r.id].append((r.text, r.path, r.agreed))
    article = " ".join((LONG * 4).split())
    assert all(text[k] == [(f"T{k}\n{article}", "body>div.x#", True)] or text[k][0][0].startswith(f"T{k}\n{article}") for k in range(6))
    assert len(text[6]) == 2 and text[6][0] == text[6][1]
    assert text[7] == [(CLEAN, "body>article", False)]
    assert text[8] == [(CLEAN, "body>div.x#", False)] and text[10] == [(CLEAN, "body>div.x#", False)]
    assert text[9] == [("", None, False)] and text[None] == [("", None, False)]
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_cold_hosts_are_joined_alike(spark, monkeypatch):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    whole = sorted(map(tuple, html_text.extract_text(pages).collect()))
    monkeypatch.setattr(html_text, "HOT_ONE_IN", 1)
    assert sorted(map(tuple, html_text.extract_text(pages).collect())) == whole


def test_pages_of_the_tables(spark):
    """The template of the tables, taken apart by patterns."""
    for r in queries.op12_html_text(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/pages.parquet"), ["page_id", "url"]).collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_clashing_ids(spark):
    pages = spark.createDataFrame([("a", "http://h/1", "<p>x"), ("a", "http://h/1", "<p>x")], "page_id string, url string, html string")
    assert [tuple(r) for r in html_text.extract_text(pages.withColumn("paths", F.lit(1))).select("id", "text", "agreed").collect()] \
        == [("a", "x", True)] * 2
