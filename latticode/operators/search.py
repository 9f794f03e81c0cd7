"""Search: score compressed vectors against queries and keep the best per query."""

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from latticode.functions import kernels as k
from latticode.functions import vectors
from latticode.operators.codebook import centroids
from latticode.operators.index import MSE_SEED, QJL_SEED

# Scores of a query of length one are compared at this precision, so that equal
# codes tie (and then go by id) whatever order a matrix product adds in.
SCORE_DECIMALS = 9
# Queries of one scan: bytes of their rotated matrices, and hits a task keeps.
GROUP_BYTES = 64 << 20
GROUP_HITS = 2_000_000
# Queries travel to the driver in pieces of this size.
PIECE_BYTES = 4 << 20
# Tasks of a scan per core: each keeps one table of best rows for all its files.
TASKS_PER_CORE = 2
# Hits that `lookup_documents` turns into literals, and proven counts below
# which hits are broadcast.
LOOKUP_HITS = 1_000
BROADCAST_HITS = 1_000_000
# Score cells computed at a time in a task.
CELLS = 1 << 20


def sketch_scale(dim: int, alpha: str = "unbiased") -> float:
    """Factor of the sign-sketch term for rotated vectors of `dim`.

    The rotation is orthonormal, so the unbiased factor is sqrt(pi/2)/sqrt(dim);
    "reference" is the factor of an unscaled Gaussian matrix, sqrt(pi/2)/dim.
    """
    if alpha not in ("unbiased", "reference"):
        raise ValueError("alpha must be 'unbiased' or 'reference'")
    return math.sqrt(math.pi / 2) / (math.sqrt(dim) if alpha == "unbiased" else dim)


def rotate_queries(queries: DataFrame, dim: int | None = None, mse_seed: int = MSE_SEED,
                   qjl_seed: int = QJL_SEED) -> DataFrame:
    """(qid, rotated, qjl_rotated): queries under both rotations."""
    query = F.col("embedding")
    return queries.where(query.isNotNull()).select(
        "qid", vectors.rotate(query, mse_seed, dim).alias("rotated"),
        vectors.rotate(query, qjl_seed, dim).alias("qjl_rotated"))


def query_tables(queries: DataFrame, table: Sequence[float], n_bits: int, dim: int,
                 seed: int = MSE_SEED) -> DataFrame:
    """(qid, position, products): per byte position the partial dot product of
    each of the 256 byte values with the rotated query."""
    table = tuple(table)
    width = k.check_packable(k.next_power_of_two(dim), n_bits)

    @F.arrow_udf("array<array<double>>")
    def products(col: pa.Array) -> pa.Array:
        def apply(c: pa.Array) -> pa.Array:
            parts = k.partial_products(k.rotate(k.list_matrix(c, dim), seed), n_bits, table)
            rows = k.matrix_list(parts, pa.float64())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * width), rows)

        return k.over_valid(col, apply)

    return queries.where(F.col("embedding").isNotNull()).select(
        "qid", F.posexplode_outer(products("embedding")).alias("position", "products"))


def score_rows(index: DataFrame, query: Sequence[float], codebook: DataFrame | Sequence[float], *,
               n_bits: int = 4, mse_seed: int = MSE_SEED, qjl_seed: int = QJL_SEED, with_qjl: bool = True,
               alpha: str = "unbiased", codebook_dim: int | None = None) -> DataFrame:
    """The index with its scores for one query: `mse_score`, with the sketch also
    `qjl_dot` and `qjl_score`, and their sum `score`. A map over the rows."""
    rows = np.asarray(query, dtype=float)[None, :]
    wide = k.next_power_of_two(rows.shape[1])
    table = centroids(codebook, codebook_dim or wide, n_bits)
    width, sketch_width = k.check_packable(wide, n_bits), k.check_packable(wide, 1)
    products = k.partial_products(k.rotate(rows, mse_seed)[0], n_bits, table)
    signs = k.partial_products(k.rotate(rows, qjl_seed)[0], 1, k.SIGNS)

    @F.arrow_udf("double")
    def mse_score(packed: pa.Array) -> pa.Array:
        return k.over_valid(packed, lambda c: pa.array(k.table_scores(k.byte_matrix(c, width), products)))

    @F.arrow_udf("double")
    def qjl_dot(bits: pa.Array) -> pa.Array:
        return k.over_valid(bits, lambda c: pa.array(k.table_scores(k.byte_matrix(c, sketch_width), signs)))

    if not with_qjl:
        return index.withColumn("mse_score", mse_score("packed")).withColumn("score", F.col("mse_score"))
    scale = F.lit(sketch_scale(wide, alpha))
    return (index.withColumns({"mse_score": mse_score("packed"), "qjl_dot": qjl_dot("qjl_bits")})
            .withColumn("qjl_score", scale * F.col("gamma").cast("double") * F.col("qjl_dot"))
            .withColumn("score", F.col("mse_score") + F.col("qjl_score")))


class BestRows:
    """The best `n` rows per query seen so far in a task, ties by id.

    New rows wait until there are as many as kept ones, so a sort of all of
    them is paid once per doubling.
    """

    def __init__(self, queries: int, n: int, id_type: pa.DataType):
        self.n, self.waiting, self.waits = n, [], 0
        self.room = max(1 << 16, queries * n)
        self.floor = np.full(queries, -np.inf)
        self.table = pa.table({"query": pa.array([], pa.int64()), "score": pa.array([], pa.float64()),
                               "id": pa.array([], id_type)})

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """`scores` is (rows, queries). Rows below a query's floor cannot win,
        and scores that are not finite never do."""
        scores = np.where(np.isfinite(scores), np.round(scores, SCORE_DECIMALS), -np.inf)
        floor = self.floor
        if len(scores) > self.n and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.n, axis=0)[len(scores) - self.n])
        row, query = np.nonzero((scores >= floor) & (scores > -np.inf))
        if row.size:
            self.waiting.append(pa.table({"query": pa.array(query.astype(np.int64)),
                                          "score": pa.array(scores[row, query]), "id": ids.take(pa.array(row))}))
            self.waits += row.size
            if self.waits >= self.room:
                self._trim()

    def finish(self) -> pa.Table:
        self._trim()
        return self.table

    def _trim(self) -> None:
        merged = pa.concat_tables([self.table, *self.waiting]).combine_chunks()
        order = pc.sort_indices(merged, [("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        ranked = merged.take(order)
        query = ranked["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        self.table, self.waiting, self.waits = ranked.filter(pa.array(place < self.n)).combine_chunks(), [], 0
        last = place == self.n - 1
        self.floor[query[last]] = ranked["score"].to_numpy()[last]


def _score_group(index: DataFrame, qids: pa.Array, rotated: np.ndarray, qjl_rotated: np.ndarray | None,
                 table: Sequence[float], n_bits: int, scale: float, top_n: int,
                 qid_field: StructField, method: str, tasks: int) -> DataFrame:
    """Best `top_n` per query within every task. Queries are scored at length
    one and the scores scaled back, so that a short query ranks like a long one."""
    dim, with_qjl = rotated.shape[1], qjl_rotated is not None
    id_type = to_arrow_type(index.schema["id"].dataType)
    width, sketch_width = k.check_packable(dim, n_bits), dim // 8
    step = max(16, CELLS // max(len(qids), dim))
    largest = np.abs(rotated).max(axis=1, initial=0)
    largest = np.where(largest == 0, 1.0, largest)  # squares of tiny numbers would vanish
    length = largest * np.sqrt(np.square(rotated / largest[:, None]).sum(axis=1))
    length = np.where(length == 0, 1.0, length)
    matrices = [rotated / length[:, None]] + ([qjl_rotated / length[:, None]] if with_qjl else [])
    shared = index.sparkSession.sparkContext.broadcast((qids, length, matrices))  # at most GROUP_BYTES

    def scores_by_table(packed, gamma, signs, tables):
        columns = []
        for code_products, sign_products in tables:
            score = k.table_scores(packed, code_products)
            if with_qjl:
                score += scale * gamma * k.table_scores(signs, sign_products)
            columns.append(score)
        return np.stack(columns, axis=1)

    def scores_by_product(packed, gamma, signs, queries):
        rows = k.unpack(packed, n_bits, table)
        if with_qjl:
            rows = np.hstack([rows, (scale * gamma)[:, None] * k.unpack(signs, 1, k.SIGNS)])
        return rows @ queries

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid_values, lengths, parts = shared.value
        if method == "table":
            scores = scores_by_table
            queries = [(k.partial_products(parts[0][i], n_bits, table),
                        k.partial_products(parts[1][i], 1, k.SIGNS) if with_qjl else None)
                       for i in range(len(qid_values))]
        else:
            scores, queries = scores_by_product, np.hstack(parts).T
        found = BestRows(len(qid_values), top_n, id_type)
        for batch in batches:
            batch = batch.filter(batch["packed"].is_valid())
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                packed = k.byte_matrix(part["packed"], width)
                gamma = signs = None
                if with_qjl:
                    gamma = part["gamma"].to_numpy(zero_copy_only=False).astype(np.float64)
                    signs = k.byte_matrix(part["qjl_bits"], sketch_width)
                found.add(scores(packed, gamma, signs, queries), part["id"])
        hits = found.finish()
        query = hits["query"].combine_chunks()
        yield from pa.table({"qid": qid_values.take(query), "id": hits["id"],
                             "score": hits["score"].to_numpy() * lengths[query.to_numpy()]}).to_batches()

    columns = ["id", "packed"] + (["gamma", "qjl_bits"] if with_qjl else [])
    schema = StructType([StructField("qid", qid_field.dataType), StructField("id", index.schema["id"].dataType),
                         StructField("score", DoubleType())])
    return index.select(*columns).coalesce(tasks).mapInArrow(best, schema)


def rank_hits(hits: DataFrame, top_n: int) -> DataFrame:
    """Best `top_n` of (qid, id, score) per qid, ranked by score, then id. A
    query has `top_n` rows per task of the scan at the most."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def search(index: DataFrame, queries: DataFrame, codebook: DataFrame | Sequence[float],
           top_n: int = 10, *, n_bits: int = 4, dim: int | None = None,
           mse_seed: int = MSE_SEED, qjl_seed: int = QJL_SEED, with_qjl: bool = True,
           alpha: str = "unbiased", codebook_dim: int | None = None, method: str = "product",
           group_rows: int | None = None, tasks: int | None = None, work_dir: str | None = None) -> DataFrame:
    """Hits (qid, id, score, rank): the best `top_n` rows of the index per query.

    `queries` is (qid, embedding) with distinct qids; null queries have no hits,
    nor has a query with a coordinate that is not finite, and with `dim` any
    other dimension is an error. Scores that are not finite are left out.

    The queries are rotated by Spark and come to the driver in groups of at most
    `GROUP_BYTES` and `GROUP_HITS` hits (or `group_rows` queries). Every group
    is one scan of the index, read by `tasks` tasks (`TASKS_PER_CORE` by
    default); a task keeps one table of best rows for all it reads, so a shuffle
    sees tasks * queries * top_n rows. A task needs about three times the group
    besides its batch. With `work_dir` the hits of each group are written there
    as they are found, for query tables of many groups; else all groups are one
    lazy plan. The folder is the caller's to remove.
    """
    if method not in ("product", "table"):
        raise ValueError("method must be 'product' or 'table'")
    rotated = rotate_queries(queries, dim, mse_seed, qjl_seed)
    if not with_qjl:
        rotated = rotated.drop("qjl_rotated")
    tasks = tasks or TASKS_PER_CORE * index.sparkSession.sparkContext.defaultParallelism
    hits, table = [], None
    for qids, main, other in _query_groups(rotated, top_n, group_rows):
        table = table or centroids(codebook, codebook_dim or main.shape[1], n_bits)
        found = rank_hits(_score_group(index, qids, main, other, table, n_bits, sketch_scale(main.shape[1], alpha),
                                       top_n, queries.schema["qid"], method, tasks), top_n)
        if work_dir:
            found.write.mode("append").parquet(work_dir)
        hits.append(found)
    if not hits:
        return _no_hits(index, queries)
    return index.sparkSession.read.parquet(work_dir) if work_dir else reduce(DataFrame.unionByName, hits)


def _query_groups(rotated: DataFrame, top_n: int,
                  group_rows: int | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray | None]]:
    """Rotated queries in groups; they are fetched as Arrow bytes, partition by
    partition."""
    names = rotated.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([c for c in batch.slice(at, step).columns], names))
                yield pa.RecordBatch.from_pydict({"body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def group(parts: list[pa.Table]):
        rows = pa.concat_tables(parts).combine_chunks()
        matrices = [k.list_matrix(rows[c].combine_chunks()) for c in names[1:]]
        return rows["qid"].combine_chunks(), matrices[0], matrices[1] if len(matrices) > 1 else None

    held, count, size = [], 0, group_rows
    for row in rotated.mapInArrow(pack, "body binary").toLocalIterator(prefetchPartitions=True):
        piece = pa.ipc.open_stream(row["body"]).read_all()
        size = size or max(1, min(GROUP_BYTES * piece.num_rows // max(1, piece.nbytes), GROUP_HITS // max(1, top_n)))
        while piece.num_rows:
            take = piece.slice(0, size - count)
            held.append(take)
            count += take.num_rows
            piece = piece.slice(take.num_rows)
            if count == size:
                yield group(held)
                held, count = [], 0
    if held:
        yield group(held)


def _no_hits(index: DataFrame, queries: DataFrame) -> DataFrame:
    schema = StructType([queries.schema["qid"], index.schema["id"], StructField("score", DoubleType()),
                         StructField("rank", IntegerType())])
    return index.sparkSession.createDataFrame([], schema)


def attach_documents(hits: DataFrame, docs: DataFrame, id_col: str = "id", *,
                     how: str = "ranked", max_hits: int | None = None) -> DataFrame:
    """Documents of the hits. Hits without a document are left out.

    "ranked" keeps qid, score and rank next to the document columns; "semi"
    returns each document once. `max_hits` is the proven number of hits (queries
    times top_n): below `BROADCAST_HITS` they are broadcast and the documents
    are not shuffled, otherwise Spark chooses the join.
    """
    side = hits if how == "ranked" else hits.select("id")
    if max_hits is not None and max_hits <= BROADCAST_HITS:
        side = F.broadcast(side)
    docs = docs.withColumnRenamed(id_col, "id")
    if how == "semi":
        return docs.join(side, "id", "left_semi")
    if how != "ranked":
        raise ValueError("how must be 'ranked' or 'semi'")
    return docs.join(side, "id")


def lookup_documents(hits: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """`attach_documents` for at most `LOOKUP_HITS` hits, by id; more are an error.

    The hits become literals, so that the ids reach the document files as a
    pushed filter: with files sorted by id, only the row groups that hold a hit
    are read, instead of every text of the corpus.
    """
    rows = hits.limit(LOOKUP_HITS + 1).collect()
    if len(rows) > LOOKUP_HITS:
        raise ValueError(f"more than {LOOKUP_HITS} hits: use attach_documents")
    ids = sorted({r.id for r in rows})
    # Parquet takes lists of up to ten values as they are; a longer one becomes
    # the range from its least to its largest, which prunes nothing.
    lists = [F.col(id_col).isin(*part) for part in batched(ids, 10)]
    found = docs.where(reduce(Column.__or__, lists) if lists else F.lit(False))
    local = hits.sparkSession.createDataFrame(rows, hits.schema)
    return attach_documents(local, found, id_col, max_hits=len(rows))
