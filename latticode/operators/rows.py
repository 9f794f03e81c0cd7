"""Row order: numbering, caps and every-nth samples without a single task."""

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticode.functions import kernels as k

#: Keys that a top-k puts in order, and files whose row counts are sent to all tasks.
TOP_ROWS = 100_000
BROADCAST_FILES = 100_000


def _range_of(key: Column, bounds: list) -> Column:
    """Number of bounds at or below the key (numbers or strings); 0 for null."""
    cuts = np.array(bounds, dtype=object if bounds and isinstance(bounds[0], str) else None)

    @F.arrow_udf("int")
    def find(col: pa.Array) -> pa.Array:
        return k.over_valid(col, lambda c: pa.array(
            np.searchsorted(cuts, c.to_numpy(zero_copy_only=False), side="right").astype(np.int32)))

    return F.coalesce(find(key), F.lit(0))


def _range_bounds(df: DataFrame, key: str, ranges: int, seed: int = 7) -> list:
    """Keys that cut the table into about equal ranges, from a small sample.

    The sample only places the cuts; the numbering is exact for any cuts.
    """
    keyed = df.where(F.col(key).isNotNull()).select(key)
    total = keyed.count()
    share = min(1.0, 40.0 * ranges / total) if total else 1.0
    keys = sorted(r[0] for r in keyed.sample(share, seed).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _ranged(df: DataFrame, key: str, ranges: int | None) -> tuple[DataFrame, list, list]:
    """The table with a `_range` column, the bounds of the ranges, and per range
    (number, rows): a sum per range, for which no row moves."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bounds = _range_bounds(df, key, ranges)
    ranged = df.withColumn("_range", _range_of(F.col(key), bounds))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
    return ranged, bounds, [(r["_range"], r.n) for r in counts]


def number_rows(df: DataFrame, order_by: str, name: str = "row_index",
                ranges: int | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of a unique key (nulls first).

    Ranges of the key are counted first, then each range is numbered on its own
    from the count of the ranges before it.
    """
    ranged, _, counts = _ranged(df, order_by, ranges)
    starts = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(r, s) for (r, _), s in zip(counts, starts)],
                                              "_range int, _start bigint")
    window = Window.partitionBy("_range").orderBy(order_by)
    # One row per range, so the broadcast is bounded by `ranges`.
    return (ranged.join(F.broadcast(offsets), "_range")
            .withColumn(name, F.col("_start") + F.row_number().over(window) - 1)
            .drop("_range", "_start"))


def sample_file_rows(df: DataFrame, every: int) -> DataFrame:
    """Rows 0, every, 2 * every, ... of a Parquet scan in file order.

    A row's number is its position in its file plus the rows of the files
    before it by path. Only the counts per file are gathered, so this is a map
    over the table: no row is shuffled, however wide it is. The counts are sent
    to all tasks, up to `BROADCAST_FILES` of them; beyond that Spark chooses.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_position": F.col("_metadata.row_index")})
    files = placed.groupBy("_file").agg(F.count("*").alias("_rows"))
    # One row per file: a small table next to the data, and one window partition.
    before = Window.partitionBy().orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    if len(df.inputFiles()) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return (placed.join(starts, "_file")
            .where((F.col("_start") + F.col("_position")) % every == 0)
            .select(*df.columns))


def sample_every(df: DataFrame, every: int, order_by: str) -> DataFrame:
    """Rows 0, every, 2 * every, ... in the order of a unique key (null first).

    Only keys are numbered and shuffled; the keys of the sample are then joined
    to the table. For a Parquet scan, `sample_file_rows` does without either.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    numbered = number_rows(df.select(F.col(order_by).alias("_key")), "_key", "_row")
    chosen = numbered.where(F.col("_row") % every == 0).select("_key")
    return df.join(chosen, F.col(order_by).eqNullSafe(F.col("_key")), "left_semi")


def cap_rows(df: DataFrame, limit: int | None, order_by: str, ranges: int | None = None, most: int = TOP_ROWS) -> DataFrame:
    """First `limit` rows in the order of a unique key (null first); None keeps all.

    Keys are counted by ranges, and the range in which the limit falls is
    divided again until it holds at most `most` keys; a top-k of those gives
    the last key that is kept. What is left is a filter on the key, which
    reaches the scan: no row is numbered or moved. The jobs that find the last
    key run while the plan is built and read the key and what `df` filters on.
    Rows that share the last key all stay.
    """
    if limit is None:
        return df
    if limit == 0:
        return df.where(F.lit(False))
    inside, left, rows = df.select(F.col(order_by).alias("_key")), limit, None
    while rows is None or rows > most:
        _, bounds, counts = _ranged(inside, "_key", ranges)
        before = rows
        for number, rows in counts:
            if rows >= left:
                break
            left -= rows
        else:
            return df
        low = F.lit(True) if number == 0 else F.col("_key") >= bounds[number - 1]
        high = F.lit(True) if number == len(bounds) else F.col("_key") < bounds[number]
        inside = inside.where((low & high) | (F.col("_key").isNull() & F.lit(number == 0)))
        if rows == before:  # equal keys cannot be divided
            break
    last = inside.orderBy("_key").limit(left).agg(F.max("_key").alias("key")).first()["key"]
    below = F.lit(False) if last is None else F.col(order_by) <= last
    return df.where(below | F.col(order_by).isNull())
