"""Corpus and index statistics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)
# Ranges of values that are counted before a quantile's own range is ordered.
RANGES = 4096


def non_null_counts(df: DataFrame) -> DataFrame:
    """(column, non_null): one pass over the table."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in df.columns])))


def row_count(df: DataFrame) -> DataFrame:
    """(rows): the table height; of an index, the number of searched documents."""
    return df.agg(F.count("*").alias("rows"))


def describe(df: DataFrame, value: str, interpolation: str = "nearest",
             quantiles: Sequence[float] = QUARTILES) -> DataFrame:
    """(statistic, value) of an integer column: count, null_count, mean, std,
    min, quantiles, max.

    The column is reduced to a histogram first (one row per distinct value,
    combined before the shuffle). A quantile is looked up in two steps: counts
    of `RANGES` ranges of values tell in which range it lies, and only that
    range's values are put in order. So an ordered pass sees at most `RANGES`
    rows, or the distinct values of one range.
    """
    if interpolation not in ("nearest", "linear"):
        raise ValueError("interpolation must be 'nearest' or 'linear'")
    histogram = (df.groupBy(F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("n")))
    known = histogram.where(F.col("v").isNotNull())
    basic = histogram.agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.min("v").alias("least"), F.max("v").alias("most"),
        F.sum(F.col("v") * F.col("n").cast("double")).alias("sum"))
    once = basic.select(F.struct(*basic.columns)).scalar()
    total, least, most, added = (once[c] for c in ("total", "least", "most", "sum"))
    mean = added / total
    spread = known.agg(F.sum(F.col("n") * F.pow(F.col("v") - mean, 2)).alias("squares"))

    place = {q: (total - 1) * F.lit(float(q)) for q in quantiles}
    nearest = interpolation == "nearest"
    wanted = {f"low{i}": F.floor(place[q] + 0.5 if nearest else place[q]) for i, q in enumerate(quantiles)}
    wanted |= {} if nearest else {f"high{i}": F.ceil(place[q]) for i, q in enumerate(quantiles)}
    found = _at_places(known, least, most, wanted)
    values = found.agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("v").cast("double"))))).scalar()
    value_of = {name: F.element_at(values, F.lit(name)) for name in wanted}

    def quantile(i: int, q: float):
        if nearest:
            return value_of[f"low{i}"]
        return value_of[f"low{i}"] + (value_of[f"high{i}"] - value_of[f"low{i}"]) * (place[q] - F.floor(place[q]))

    stats = {
        "count": F.col("total").cast("double"), "null_count": F.col("nulls").cast("double"), "mean": mean,
        "std": F.sqrt(spread.scalar() / F.nullif(total - 1, F.lit(0))), "min": F.col("least").cast("double"),
        **{f"{q:.0%}": quantile(i, q) for i, q in enumerate(quantiles)}, "max": F.col("most").cast("double"),
    }
    row = basic.select(*[c.alias(n) for n, c in stats.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in stats])))


def _at_places(known: DataFrame, least: Column, most: Column, wanted: dict[str, Column]) -> DataFrame:
    """(name, v): the values at the wanted places (from 0) of the ordered rows
    that the histogram (v, n) stands for."""
    width = F.greatest(F.lit(1.0), F.ceil((most - least + 1) / F.lit(float(RANGES))).cast("double"))
    part = F.floor((F.col("v") - least) / width)
    ranged = known.withColumn("part", part)
    counts = ranged.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = F.array(*[F.struct(F.lit(n).alias("name"), p.alias("place")) for n, p in wanted.items()])
    parts = (counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
             .select("part", "rows", "before", F.inline(places))
             .where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("rows"))))
    seen = F.col("before") + F.sum("n").over(Window.partitionBy("name").orderBy("v"))
    return (ranged.join(parts, "part").withColumn("seen", seen).where(F.col("seen") > F.col("place"))
            .groupBy("name").agg(F.min("v").alias("v")))


def storage_report(index: DataFrame) -> DataFrame:
    """(representation, bytes, megabytes) of the vector columns an index has:
    four bytes per float, one per code or packed byte."""
    sizes = {
        "embedding": F.size("embedding") * 4, "rotated": F.size("rotated") * 4,
        "codes": F.length("codes"), "packed": F.length("packed"), "gamma": F.lit(4),
        "qjl_bits": F.length("qjl_bits"),
    }
    sizes = {name: size for name, size in sizes.items() if name in index.columns}
    sums = index.agg(*[F.coalesce(F.sum(F.when(F.col(name).isNotNull(), size)), F.lit(0)).alias(name)
                       for name, size in sizes.items()])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("representation"), F.col(name).alias("bytes"),
                 (F.col(name) / (1 << 20)).alias("megabytes")) for name in sizes])))
