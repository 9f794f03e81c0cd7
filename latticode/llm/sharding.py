"""A uniform shuffle into shards of exact sizes.

How many rows each partition sends to each shard is drawn first, from the
multivariate hypergeometric law that a uniform permutation of all rows would
follow. Then every partition permutes its rows, hands out that many, and what
arrives is permuted again. All three steps together are a uniform shuffle, and
shard sizes are exact.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticode.llm.tables import text_or_empty, written

#: Bounds of the matrix that the driver draws: partitions and slices of shards.
MAX_PARTS = 2048
MAX_SLICES = 2048
SLICE_ROWS = 1_000_000
#: The library draws from fewer rows than this.
LIBRARY_LIMIT = 1_000_000_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart, the larger ones first."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def draw_first(rng: np.random.Generator, first: int, rest: int, n: int, limit: int = LIBRARY_LIMIT) -> int:
    """How many of n rows, drawn without replacement, are among the `first` of
    `first` + `rest`. Beyond the library's limit the law is summed up from its
    middle, by the ratios of neighbouring counts, as far as doubles tell it
    from 0 (12 standard deviations)."""
    if first + rest < limit:
        return int(rng.hypergeometric(first, rest, n))
    share = first / (first + rest)
    reach = int(12 * (n * share * (1 - share)) ** 0.5) + 40
    middle = min(max((n + 1) * (first + 1) // (first + rest + 2), n - rest, 0), n, first)
    low, high = max(0, n - rest, middle - reach), min(n, first, middle + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = (first - k) * (n - k) / ((k + 1) * (float(rest - n) + k + 1))
    up, down = np.cumprod(ratio[middle - low:]), np.cumprod(1 / ratio[:middle - low][::-1])
    total = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def draw_slices(rng: np.random.Generator, left: np.ndarray, n: int, limit: int = LIBRARY_LIMIT) -> np.ndarray:
    """n rows drawn without replacement from slices with `left` places: how many
    from each. Too many places for the library are drawn by halves."""
    places = int(left.sum())
    if places < limit:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    if len(left) == 1:
        return np.array([n], np.int64)
    half = len(left) // 2
    first = int(left[:half].sum())
    k = draw_first(rng, first, places - first, n, limit)
    return np.concatenate([draw_slices(rng, left[:half], k, limit), draw_slices(rng, left[half:], n - k, limit)])


def communication_matrix(have: np.ndarray, want: np.ndarray, seed: int) -> np.ndarray:
    """Rows from each partition to each slice: sums are `have` and `want`.

    Partition by partition, the counts are drawn without replacement from the
    room that is left in the slices.
    """
    rng, left = np.random.default_rng(seed), want.astype(np.int64).copy()
    out = np.zeros((len(have), len(want)), np.int64)
    for i, n in enumerate(have):
        out[i] = draw_slices(rng, left, int(n))
        left -= out[i]
    return out


def assign_shards(rows: DataFrame, shards: int, seed: int = 17, slice_rows: int = SLICE_ROWS,
                  parts: int = MAX_PARTS) -> DataFrame:
    """The rows with `shard` (0 to shards - 1) and `slot` (from 0, without gaps).

    Counts of the shards are at most one apart. A shard is split into slices of
    about `slice_rows` slots, at most 2,048 in all, so that a task permutes a
    slice and not a shard. Partitions of the input, joined to at most `parts`
    by number, are written down first: both jobs have to see the same ones. An
    empty table gives an empty result.
    """
    source = written(rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part"),
        F.monotonically_increasing_id().alias("place")), "parts")
    counts = sorted((r["part"], r["n"]) for r in source.groupBy("part").agg(F.count("*").alias("n")).collect())
    sizes = shard_sizes(sum(n for _, n in counts), shards)
    cuts = int(min(max(1, -(-int(sizes[0]) // slice_rows)), max(1, MAX_SLICES // shards)))
    want = np.concatenate([shard_sizes(int(s), cuts) for s in sizes])
    matrix = communication_matrix(np.array([n for _, n in counts], np.int64), want, seed)
    ends = np.zeros((parts, len(want)), np.int64)
    ends[[p for p, _ in counts]] = np.cumsum(matrix, axis=1)
    shared = rows.sparkSession.sparkContext.broadcast(ends)  # bounded: parts times slices
    starts = np.concatenate([np.cumsum(w) - w for w in want.reshape(shards, cuts)])
    begin = rows.sparkSession.createDataFrame([(i, i // cuts, int(s)) for i, s in enumerate(starts)],
                                              "at int, shard int, start long")

    @F.pandas_udf("int")
    def slice_of(part: pd.Series, turn: pd.Series) -> pd.Series:
        out = np.zeros(len(part), np.int32)
        for p in part.unique():
            here = (part == p).to_numpy()
            out[here] = np.searchsorted(shared.value[p], turn[here], side="right")
        return pd.Series(out)

    def order(step: int):
        return F.xxhash64(F.lit(seed), F.lit(step), "place"), "place"

    dealt = source.withColumn("turn", F.row_number().over(Window.partitionBy("part").orderBy(*order(1))) - 1)
    dealt = dealt.withColumn("slice", slice_of("part", "turn"))
    placed = dealt.withColumn("turn", F.row_number().over(Window.partitionBy("slice").orderBy(*order(2))) - 1)
    return placed.join(F.broadcast(begin), F.col("slice") == F.col("at")).select(
        "row.*", "shard", (F.col("start") + F.col("turn")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id",
                    text_col: str = "text", **limits) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of all documents.

    Size is the UTF-8 length plus 8; a null text counts as empty. Rows with
    equal ids or texts are rows of their own. Other columns are not read.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return assign_shards(rows, shards, seed, **limits)
