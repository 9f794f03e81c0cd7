"""Mixing sources to target weights: repetition rates per source, copies per document."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticode.llm.tables import word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                 most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources in code point order, null last, take the weights in turn. Together
    they aim at `share` times all sizes; a source gets `most` times its size at
    the outside, and what is over goes to the others by weight until none is
    above. That has a closed form: in order of size per weight the capped
    sources come first, and the first source that stays below its cap at the
    level its predecessors leave sets the level of all after it. `share` is to
    be at most `most`. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.isnull("source"), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = totals.withColumn("weight", turn.cast("long"))
    fullness = F.try_divide("source_size", "weight")
    order = Window.orderBy(fullness, F.isnull("source"), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.lit(share) * F.sum("source_size").over(every)
              - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    leveled = ranked.withColumn("level", level)
    below = F.when(F.col("level") * F.col("weight") < F.lit(most) * F.col("source_size"), F.struct(fullness, "level"))
    final = F.min(below).over(every)["level"]
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(cap, F.coalesce(final * F.col("weight"), cap)))
    return leveled.withColumn("target", target).select(
        "source", "source_size", "target",
        F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that seed and id decide: 48 bits of an MD5."""
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(rate: Column, id_col: Column, seed: int) -> Column:
    """floor(rate) copies, and one more with probability of the fraction."""
    return (F.floor(rate) + (draw(id_col, seed) < rate - F.floor(rate)).cast("int")).cast("long")


def mixed_sizes(docs: DataFrame, *, seed: int = 11, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", **plan) -> DataFrame:
    """(id, size, source, source_size, target, taken), one row per document.

    Size is the number of words, none for null. A null source is a source of
    its own. Rows with equal ids get the same draw. An empty table gives no
    rows; sources without words have target 0. The rates are a written table,
    so Spark sends them to all executors only while they are small.
    """
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                word_count(text_col).alias("size")), "sizes")
    rates = written(source_rates(sizes, **plan).withColumnRenamed("source", "of"), "rates")
    return sizes.join(rates, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "size", "source", "source_size", "target",
        (F.col("size") * copies(F.col("rate"), F.col("id"), seed)).alias("taken"))


def mix(docs: DataFrame, *, seed: int = 11, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", **plan) -> DataFrame:
    """The mixed documents: each row as often as it is taken, all columns kept."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rates = written(source_rates(sizes, **plan).select(F.col("source").alias("__of"), F.col("rate").alias("__rate")),
                    "rates")
    times = F.array_repeat(F.lit(True), copies(F.col("__rate"), F.col(f"`{id_col}`"), seed).cast("int"))
    return (docs.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col("__of")))
            .withColumn("__copy", F.explode(times)).drop("__of", "__rate", "__copy"))
