"""An index laid out in cells of near vectors, and searches that read few of them.

A cell is a partition of the stored index. What is kept of it (its center, the
radius around it, the range of codes and sign bits per coordinate, the largest
residual) bounds the score of any of its rows for any query. The exact search
reads cells in the order of that bound until none is left whose bound reaches
the k-th best score found; the approximate one reads a number of cells.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latticode.functions import codes, kernels as k
from latticode.operators import kmeans
from latticode.operators.codebook import centroids
from latticode.operators.grid import PIECE_BYTES, query_pieces, row_chunks, score_pairs, unit_queries
from latticode.operators.index import MSE_SEED, QJL_SEED
from latticode.operators.search import rank_hits, sketch_scale
from latticode.sources.tables import new_shared_path, stored

#: Cells of an index at most: what is kept of them is sent to every task.
MAX_CELLS = 4096
SAMPLE_ROWS = 100_000
#: Room for the order in which sums run.
MARGIN = 1e-7
STATS = ("cell int, n long, gamma double, radius double, center array<double>, low binary, high binary, "
         "all_bits binary, any_bits binary")


def fit_centers(index: DataFrame, codebook: DataFrame | Sequence[float], cells: int, *, n_bits: int = 4, dim: int,
                codebook_dim: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> np.ndarray:
    """Centers of at most `cells` cells, by k-means on the stored vectors of
    about `sample_rows` rows, which hashes of ids choose. They decide how well
    the layout prunes, not what is found. Fewer rows than cells give fewer."""
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"between 1 and {MAX_CELLS} cells")
    wide = k.next_power_of_two(dim)
    table = centroids(codebook, codebook_dim or wide, n_bits)
    valid = index.where(F.col("packed").isNotNull())
    step = max(1, valid.count() // sample_rows)
    points = stored(valid.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select(
        "id", codes.centroid_values(F.col("packed"), table, n_bits, wide).alias("v")), "sample")
    if cells == 1 or points.isEmpty():
        return np.zeros((1, wide))
    return kmeans.fit(points, cells, vector_col="v", seed=seed, rounds=3, steps=5)


def nearest_cell(packed: Column, centers: np.ndarray, table: Sequence[float], n_bits: int) -> Column:
    """The cell with the nearest center, the first of equals."""
    table, half = tuple(table), np.square(centers).sum(axis=1) / 2
    width = k.check_packable(centers.shape[1], n_bits)

    @F.arrow_udf("int")
    def cell(col: pa.Array) -> pa.Array:
        def apply(c: pa.Array) -> pa.Array:
            near = np.round(k.unpack(k.byte_matrix(c, width), n_bits, table) @ centers.T - half, 9)
            return pa.array(near.argmax(axis=1).astype(np.int32))

        return k.over_valid(col, lambda c: k.in_chunks(c, max(centers.shape), apply))

    return cell(packed)


def cell_stats(index: DataFrame, centers: np.ndarray, table: Sequence[float], n_bits: int) -> DataFrame:
    """What bounds the scores of each cell's rows (`STATS`). Every task sends
    one row per cell, whatever the size of a cell."""
    table, wide = np.asarray(table), centers.shape[1]
    width, sketch = k.check_packable(wide, n_bits), wide // 8

    def merge(parts: list[tuple]) -> tuple:
        cell, n, gamma, radius, low, high, every, some = zip(*parts)
        return (cell[0], sum(n), max(gamma), max(radius), np.minimum.reduce(low), np.maximum.reduce(high),
                np.bitwise_and.reduce(every), np.bitwise_or.reduce(some))

    def row(part: tuple) -> dict[str, list]:
        cell, n, gamma, radius, low, high, every, some = part
        return {"cell": [cell], "n": [n], "gamma": [gamma], "radius": [radius], "center": [centers[cell].tolist()],
                "low": [low.tobytes()], "high": [high.tobytes()], "all_bits": [every.tobytes()], "any_bits": [some.tobytes()]}

    kinds = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("gamma", pa.float64()), ("radius", pa.float64()),
                       ("center", pa.list_(pa.float64())), ("low", pa.binary()), ("high", pa.binary()),
                       ("all_bits", pa.binary()), ("any_bits", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            cell = batch["cell"].to_numpy()
            code = k.unpack(k.byte_matrix(batch["packed"], width), n_bits)
            bits = k.byte_matrix(batch["qjl_bits"], sketch)
            gamma = batch["gamma"].to_numpy(zero_copy_only=False).astype(np.float64)
            for c in np.unique(cell):
                here = cell == c
                off = table[code[here]] - centers[c]
                part = (int(c), int(here.sum()), float(gamma[here].max()), float(np.sqrt(np.square(off).sum(axis=1)).max()),
                        code[here].min(axis=0), code[here].max(axis=0), np.bitwise_and.reduce(bits[here]),
                        np.bitwise_or.reduce(bits[here]))
                found[int(c)] = merge([found[int(c)], part]) if int(c) in found else part
        for part in found.values():
            yield from pa.table(row(part), schema=kinds).to_batches()

    def whole(parts: pa.Table) -> pa.Table:
        rows = [(r["cell"], r["n"], r["gamma"], r["radius"], *(np.frombuffer(r[c], np.uint8) for c in ("low", "high", "all_bits", "any_bits")))
                for r in parts.to_pylist()]
        return pa.table(row(merge(rows)), schema=kinds)

    no_bits = F.unhex(F.lit("00" * sketch))
    with_qjl = "qjl_bits" in index.columns
    rows = index.select("cell", "packed", F.coalesce(F.col("qjl_bits"), no_bits).alias("qjl_bits") if with_qjl else no_bits.alias("qjl_bits"),
                        F.coalesce("gamma", F.lit(0.0)).alias("gamma") if with_qjl else F.lit(0.0).alias("gamma"))
    return rows.mapInArrow(partial, STATS).groupBy("cell").applyInArrow(whole, STATS)


def write_cells(index: DataFrame, path: str, codebook: DataFrame | Sequence[float], centers: np.ndarray, *, n_bits: int = 4,
                codebook_dim: int | None = None, mode: str = "errorifexists") -> None:
    """`path`/rows: the index partitioned by cell; `path`/cells: what is kept of
    each. Spark evens out the files: a large cell becomes several, and no task
    holds a whole one. Rows without a code are left out."""
    table = centroids(codebook, codebook_dim or centers.shape[1], n_bits)
    placed = index.where(F.col("packed").isNotNull()).withColumn("cell", nearest_cell(F.col("packed"), centers, table, n_bits))
    placed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")
    spark = index.sparkSession
    rows = spark.read.schema(StructType([*index.schema.fields, *StructType.fromDDL("cell int").fields])).parquet(f"{path}/rows")
    cell_stats(rows, centers, table, n_bits).coalesce(1).write.mode(mode).parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, cells) of an index that `write_cells` wrote."""
    cells = spark.read.schema(STATS).parquet(f"{path}/cells")
    try:
        return spark.read.parquet(f"{path}/rows"), cells
    except Exception as error:  # a table without rows has no files to take a schema from
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], "id long, packed binary, gamma float, qjl_bits binary, cell int"), cells


class Bounds:
    """Upper bounds of the unit scores of every cell, best cells first."""

    def __init__(self, stats: list, table: Sequence[float], scale: float, with_qjl: bool):
        table = np.asarray(table)
        self.cell = np.array([r.cell for r in stats], np.int32)
        self.center = np.array([r.center for r in stats])
        self.radius = np.array([r.radius for r in stats])
        self.low, self.high = (table[np.array([list(r[c]) for r in stats], np.uint8)] for c in ("low", "high"))
        self.size = np.array([r.n for r in stats], np.int64)
        self.residual = scale * np.array([r.gamma for r in stats]) if with_qjl else np.zeros(len(stats))
        bits = [k.unpack(np.array([list(r[c]) for r in stats], np.uint8), 1, k.SIGNS) for c in ("all_bits", "any_bits")]
        self.sign_low, self.sign_high = bits

    @staticmethod
    def _range(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def of(self, rotated: np.ndarray, qjl_rotated: np.ndarray) -> np.ndarray:
        """(queries, cells): no row of the cell scores higher."""
        ball = rotated @ self.center.T + np.sqrt(np.square(rotated).sum(axis=1))[:, None] * self.radius
        code = np.minimum(ball, self._range(rotated, self.low, self.high))
        sign = np.maximum(self._range(qjl_rotated, self.sign_low, self.sign_high), 0)
        return code + self.residual * sign + MARGIN

    def near(self, rotated: np.ndarray) -> np.ndarray:
        """(queries, cells): how near the centers are."""
        return rotated @ self.center.T


def visits(queries: DataFrame, bounds: Bounds, by: str) -> DataFrame:
    """The queries with `cells`, the order to read them in, `bounds` and `rows`
    (how many the cells hold) to match."""
    names = queries.columns

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rotated, other = (k.list_matrix(batch[c]) for c in ("rotated", "qjl_rotated"))
                bound = bounds.of(rotated, other)
                first = np.argsort(-(bound if by == "bound" else bounds.near(rotated)), axis=1, kind="stable")
                lists = [k.matrix_list(bounds.cell[first], pa.int32()), k.matrix_list(np.take_along_axis(bound, first, 1), pa.float64()),
                         k.matrix_list(bounds.size[first], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], *lists], [*names, "cells", "bounds", "rows"])

    added = StructType.fromDDL("cells array<int>, bounds array<double>, rows array<bigint>").fields
    return queries.mapInArrow(order, StructType([*queries.schema.fields, *added]))


def search_cells(rows: DataFrame, cells: DataFrame, queries: DataFrame, codebook: DataFrame | Sequence[float], top_n: int = 10, *,
                 probes: int | None = None, n_bits: int = 4, dim: int, mse_seed: int = MSE_SEED, qjl_seed: int = QJL_SEED,
                 with_qjl: bool = True, alpha: str = "unbiased", codebook_dim: int | None = None,
                 piece_bytes: int = PIECE_BYTES, log: list | None = None) -> DataFrame:
    """Hits (qid, id, score, rank) as `search.search` finds them.

    Without `probes` they are the same hits: a query first reads the cells with
    the highest bounds, then, in rounds that double, those whose bound reaches
    its `top_n`-th best score so far. With `probes` a query reads the cells of
    so many nearest centers and no more.

    A round joins queries and rows by cell, and only partitions that some query
    asks for are scanned; the driver sees their numbers, at most `MAX_CELLS`.
    `log` receives the cells that each round read.
    """
    spark, wide = rows.sparkSession, k.next_power_of_two(dim)
    table = centroids(codebook, codebook_dim or wide, n_bits)
    stats = cells.orderBy("cell").limit(MAX_CELLS + 1).collect()
    if len(stats) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    kinds = {"id_type": rows.schema["id"].dataType, "qid_type": queries.schema["qid"].dataType}
    empty = spark.createDataFrame([], StructType([queries.schema["qid"], rows.schema["id"],
                                                  *StructType.fromDDL("score double, unit double").fields]))
    if not stats:
        return rank_hits(empty, top_n).drop("unit")
    bounds = Bounds(stats, table, sketch_scale(wide, alpha), with_qjl)
    asked = stored(visits(unit_queries(queries, dim, mse_seed, qjl_seed), bounds, "near" if probes else "bound"), "visits")
    total, found, start = asked.count(), empty, 0
    size = probes or max(1, math.isqrt(len(stats)) // 2)
    limit = min(probes or len(stats), len(stats))
    while start < limit:
        round_ = asked.withColumn("floor", F.lit(None).cast("double"))
        if not probes:
            ranked = rank_hits(found, top_n).where(F.col("rank") == top_n)
            round_ = asked.join(ranked.select("qid", F.col("unit").alias("floor")), "qid", "left")
        part = F.slice(F.arrays_zip("cells", "bounds"), start + 1, size)
        pairs = round_.select("qid", "length", "rotated", "qjl_rotated", "floor", F.explode(part).alias("at")).where(
            F.col("floor").isNull() | (F.col("at.bounds") >= F.col("floor"))).withColumn("cell", F.col("at.cells")).drop("at")
        pairs = stored(pairs, "asked")
        wanted = sorted(r.cell for r in pairs.select("cell").distinct().collect())
        if not wanted:
            break
        if log is not None:
            log.append(wanted)
        pieces = query_pieces(pairs, ["cell"], piece_bytes, total, wide)
        chunks = row_chunks(rows.where(F.col("cell").isin(wanted)), with_qjl, cells=True)
        hits = score_pairs(chunks.join(pieces, "cell"), table, n_bits, top_n, with_qjl=with_qjl, alpha=alpha, **kinds)
        found = stored(rank_hits(found.unionByName(hits), top_n).drop("rank"), "hits")
        start, size = start + size, 2 * size
    return rank_hits(found, top_n).drop("unit")


def cell_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of exact hits that were found."""
    both = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1.0).alias("hit")), ["qid", "id"], "left")
    return both.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r")).agg(
        F.count("*").alias("queries"), F.avg("r").alias("recall"))


def in_cells(index: DataFrame, codebook: DataFrame | Sequence[float], cells: int, *, n_bits: int = 4, dim: int,
             codebook_dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """An index fitted to cells, written to the shared folder and read back."""
    path = new_shared_path(index.sparkSession, "cells")
    kept = stored(index, "index")
    centers = fit_centers(kept, codebook, cells, n_bits=n_bits, dim=dim, codebook_dim=codebook_dim)
    write_cells(kept, path, codebook, centers, n_bits=n_bits, codebook_dim=codebook_dim)
    return read_cells(index.sparkSession, path)
