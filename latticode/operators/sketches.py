"""Statistics of an integer column that are kept per file and merged.

A file's row holds its counts, bounds, sum and a quantile sketch, and never
changes, because a file does not. A table that grows by files is profiled by
reading the new ones only. Counts, bounds and sums are exact; the rank of a
quantile is off by at most about `rank_error(k)` of the rows.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticode.operators.stats import QUARTILES

#: Size of a sketch: some 16 bytes per entry and about three times as many entries.
SKETCH_K = 2000


def rank_error(k: int = SKETCH_K) -> float:
    """Share of rows by which a quantile's rank is off, at 99% confidence; a
    fixed property of these sketches, whatever they were merged from."""
    return 2.296 / k ** 0.9723


def file_statistics(df: DataFrame, value: str, k: int = SKETCH_K) -> DataFrame:
    """(file, rows, nulls, least, most, added, sketch), one row per file of a
    Parquet scan. A file is summed up where it is read; what is shuffled is a
    row per task and file. A file without rows has none here."""
    number = F.col(value).cast("bigint")
    return (df.select(F.col("_metadata.file_path").alias("file"), number.alias("v"))
            .groupBy("file").agg(
                F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"),
                F.min("v").alias("least"), F.max("v").alias("most"),
                F.sum(F.col("v").cast("decimal(38,0)")).alias("added"),
                F.kll_sketch_agg_bigint("v", F.lit(k)).alias("sketch")))


def new_file_statistics(df: DataFrame, known: DataFrame, value: str, k: int = SKETCH_K) -> DataFrame:
    """The rows of `file_statistics` that `known` lacks; only their files are read.

    The names of files pass through the driver, as they do to plan any scan.
    """
    seen = known.select("file").distinct()
    names = df.select(F.col("_metadata.file_path").alias("file")).distinct().join(seen, "file", "left_anti")
    fresh = [r.file for r in names.collect()]
    return file_statistics(df.where(F.col("_metadata.file_path").isin(fresh)), value, k)


def merged_statistics(files: DataFrame, quantiles: Sequence[float] = QUARTILES) -> DataFrame:
    """(statistic, value): count, null_count, mean, min, quantiles and max of all
    files together, from their rows alone. Without values all but the counts are null."""
    known = F.sum("rows") - F.sum("nulls")
    merged = files.agg(
        F.coalesce(known, F.lit(0)).alias("total"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("added").alias("added"),
        F.kll_merge_agg_bigint(F.when(F.col("rows") > F.col("nulls"), F.col("sketch"))).alias("sketch"))
    some = F.col("total") > 0
    stats = {
        "count": F.col("total"), "null_count": F.col("nulls"),
        "mean": F.when(some, F.col("added").cast("double") / F.col("total")), "min": F.col("least"),
        **{f"{q:.0%}": F.when(some, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q)))) for q in quantiles},
        "max": F.col("most"),
    }
    return merged.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("statistic"), c.cast("double").alias("value")) for name, c in stats.items()])))
