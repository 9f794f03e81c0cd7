"""How far the sources of a language differ, and in which terms.

A term's weight in a group is its smoothed share in billionths. The terms that
set a group apart from its language are found by a dominance skyband: a term
that `top` others beat in group count, language count and byte order at once
cannot rank, so partitions keep only terms that fewer others beat, skybands of
partitions merge to skybands of groups, and what is left is ranked exactly.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticode.llm.tables import text_or_empty, written

#: Runs of ASCII letters and of everything beyond ASCII, over UTF-8 bytes.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of its language that a kept term has; ranks of the part `term`.
MIN_DOCS = 10
TOP = 10
#: Terms that a task counts before it hands on what it has.
HELD_TERMS = 250_000
#: Sources and terms of a tile: one block of sources against another.
TILE_SOURCES = 128
TILE_TERMS = 512
#: Rows of skybands that a task keeps, and parts a group's skybands merge in first.
HELD_ROWS = 200_000
MERGE_PARTS = 16


def term_counts(docs: DataFrame, text_col: str = "text", held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, docs) with occurrences and documents of each term.

    A task counts its documents in one table per group, and hands on and
    empties the tables when they hold `held` terms; Spark adds up the rest. A
    group of a third of all rows so arrives as one row per term and task.
    """
    def count(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (total, found) in groups.items():
                names = list(total)
                for at in range(0, len(names), 50_000):
                    part = names[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                         pa.array(part, pa.binary()).cast(pa.string()), pa.array([total[t] for t in part], pa.int64()),
                         pa.array([found[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts):
                total, found = groups.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.as_buffer().to_pybytes().lower())
                size -= len(total)
                total.update(terms)
                found.update(set(terms))
                size += len(total)
                if size > held:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select("lang", "source", text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that are not negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact in 64 bits: three
    decimal digits at a time, so that counts up to 10^15 do not overflow."""
    rest, below = count + F.lit(2), F.greatest(total + F.lit(2) * terms, F.lit(1))
    out = F.lit(1).cast("long")
    for unit in (1_000_000, 1_000, 1):
        rest = rest * F.lit(1_000)
        out = out + _div(rest, below) * F.lit(unit)
        rest = F.pmod(rest, below)
    return out


def _apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def skyband(count: np.ndarray, below: np.ndarray, k: int, step: int = 256) -> np.ndarray:
    """True for the rows that fewer than k earlier rows dominate, by a count as
    high or higher and a second number as low or lower. Rows that are left out
    need not be asked again: whoever they dominate, their own k dominate too."""
    keep = np.zeros(len(count), bool)
    high, low = count[:0], below[:0]
    for a in range(0, len(count), step):
        c, b = count[a:a + step], below[a:a + step]
        beaten = ((high >= c[:, None]) & (low <= b[:, None])).sum(axis=1)
        beaten += np.tril((c >= c[:, None]) & (b <= b[:, None]), -1).sum(axis=1)
        keep[a:a + step] = stay = beaten < k
        high, low = np.concatenate([high, c[stay]]), np.concatenate([low, b[stay]])
    return keep


def _skyband_of(table: pa.Table, k: int) -> pa.Table:
    table = table.take(pa.compute.sort_indices(table["term"]))
    return table.filter(pa.array(skyband(table["n"].to_numpy(), table["lang_n"].to_numpy(), k)))


def group_skybands(rows: DataFrame, k: int = TOP, held: int = HELD_ROWS) -> DataFrame:
    """Of rows (lang, source, term, n, lang_n, value), those that may be among
    the k first of their group: the skyband of each partition, then of parts of
    each group, then of groups. A partition keeps skybands only; should those
    of many groups exceed `held` rows, they are handed on early."""
    def partition(batches):
        kept: dict[tuple[str, str], pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table["lang"].to_pylist(), table["source"].to_pylist()))
            places: dict[tuple[str, str], list[int]] = {}
            for at, key in enumerate(keys):
                places.setdefault(key, []).append(at)
            for key, at in places.items():
                part = table.take(pa.array(at))
                kept[key] = _skyband_of(pa.concat_tables([kept[key], part]) if key in kept else part, k)
            if sum(t.num_rows for t in kept.values()) > held:
                for t in kept.values():
                    yield from t.to_batches()
                kept.clear()
        for t in kept.values():
            yield from t.to_batches()

    found = rows.mapInArrow(partition, rows.schema)
    part = F.pmod(F.xxhash64("term"), F.lit(MERGE_PARTS))
    merged = found.groupBy("lang", "source", part).applyInArrow(lambda t: _skyband_of(t, k), rows.schema)
    return merged.groupBy("lang", "source").applyInArrow(lambda t: _skyband_of(t, k), rows.schema)


def source_distances(kept: DataFrame, groups: DataFrame, tile_sources: int = TILE_SOURCES,
                     tile_terms: int = TILE_TERMS) -> DataFrame:
    """(lang, source, item, value): how far each source is from each other one.

    Sources and terms of a language are dealt to blocks; a tile is a block of
    sources against another over a block of terms, as a small matrix. Only sums
    per tile and pair leave it. Terms that no source of a tile has differ by the
    shares of a count of 0, whose number is known.
    """
    sources = F.greatest(F.ceil(F.col("sources") / F.lit(tile_sources)), F.lit(1))
    terms = F.greatest(F.ceil(F.col("terms") / F.lit(tile_terms)), F.lit(1))
    block = F.pmod(F.xxhash64("source"), sources)
    columns = ["lang", "source", "none", "block"]
    rows = kept.select(*columns[:3], block.alias("block"), sources.alias("blocks"), "term", "p",
                       F.pmod(F.xxhash64("term"), terms).alias("at"))
    present = groups.select(*columns[:3], block.alias("block"), sources.alias("blocks"), F.lit(None).cast("string").alias("term"),
                            F.lit(None).cast("long").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), terms - 1)).alias("at"))
    tiles = rows.unionByName(present).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select(*columns, "term", "p", "at", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        lang, i, j = (key[at].as_py() for at in range(3))
        name = table["source"].combine_chunks().dictionary_encode()
        which, names = name.indices.to_numpy(), name.dictionary.to_pylist()
        first = np.zeros(len(names), np.int64)
        first[which] = np.arange(len(which))
        none, home = table["none"].to_numpy()[first], table["block"].to_numpy()[first]
        known = table["term"].combine_chunks().dictionary_encode()
        real = np.asarray(known.is_valid())
        column = known.indices.fill_null(0).to_numpy(zero_copy_only=False)[real]
        p = np.repeat(none[:, None], len(known.dictionary), axis=1)
        p[which[real], column] = table["p"].filter(pa.array(real)).to_numpy()
        out = [[], [], []]
        after = np.argsort(np.argsort(np.array(names, object)))  # tiles must agree on who comes first
        for a in range(len(names)):
            others = np.flatnonzero(after > after[a]) if i == j else np.flatnonzero(home == j) if home[a] == i else []
            if len(others):
                gap = p[others] - p[a]
                out[0] += [names[a]] * len(others)
                out[1] += [names[b] for b in others]
                out[2] += (gap * gap // (p[others] + p[a])).sum(axis=1).tolist()
        return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()),
                         "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64()),
                         "seen": pa.array([len(known.dictionary)] * len(out[0]), pa.int64())})

    parts = tiles.groupBy("lang", "i", "j", "at").applyInArrow(
        sums, "lang string, source string, item string, value long, seen long")
    total = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    mine = groups.select("lang", "source", "terms", F.col("none").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("b"))
    value = F.col("value") + (F.col("terms") - F.col("seen")) * _apart(F.col("a"), F.col("b"))
    pairs = total.join(mine, ["lang", "source"]).join(other, ["lang", "item"]).withColumn("value", value)
    swapped = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return pairs.select("lang", F.inline(F.array(F.struct("source", "item", "value"), swapped)))


def audit_sources(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text",
                  lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, every other source
    of the language by distance; part `term`, the `top` terms by which a source
    differs most from its language.

    Terms are runs of ASCII letters, lower-cased, and characters beyond ASCII;
    a language keeps those that at least `min_docs` of its documents have. Null
    text, language or source count as empty; repeated rows count as documents of
    their own. A group without terms, or a language that keeps none, has its
    pairs (of value 0 in the latter case) and no terms. Equal values rank by the
    bytes of the item. An empty table gives no rows; other columns are not read.
    Sums are exact integers.
    """
    named = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"),
                        text_or_empty(text_col).alias("text"))
    everywhere = Window.partitionBy("lang", "term")  # one row per source
    kept = written(term_counts(named).select("*", F.sum("n").over(everywhere).alias("lang_n"), F.sum("docs").over(everywhere).alias("in"))
                   .where(F.col("in") >= min_docs).drop("docs", "in"), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    words = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    present = named.select("lang", "source").distinct()
    many = present.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = present.join(many, "lang").join(words, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = written(groups.fillna(0, ["terms", "lang_total", "total"])
                     .withColumn("none", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    weighed = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    apart = weighed.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("p > q").select(
        "lang", "source", "term", "n", "lang_n", _apart(F.col("p"), F.col("q")).alias("value"))

    def ranked(rows: DataFrame, part: str, item: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc(item))
        return rows.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value",
                           F.row_number().over(order).alias("rank"))

    terms = ranked(group_skybands(apart, top), "term", "term").where(F.col("rank") <= top)
    return ranked(source_distances(weighed, groups), "pair", "item").unionByName(terms)
