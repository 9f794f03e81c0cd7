"""Search in two stages: a sketch of each code bounds its score, and only rows
whose bound reaches a query's k-th best are scored in full.

The sketch keeps the high bits of each coordinate's code (one bit is its sign),
the factor that fits them best to the stored vector, and what is then left over.
With a query of length one, the score lies within that rest times the part of
the query that the sketch does not span, and the residual's largest share.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from latticode.functions import kernels as k
from latticode.operators.codebook import centroids
from latticode.operators.grid import (CHUNK_ROWS, PIECE_BYTES, chunk_table, query_pieces, row_chunks, score_pairs,
                                      unit_queries)
from latticode.operators.index import MSE_SEED, QJL_SEED
from latticode.operators.search import CELLS, BestRows, rank_hits, sketch_scale
from latticode.sources.tables import stored

#: Room for the order in which sums run.
MARGIN = 1e-7


def prefix_values(table: Sequence[float], n_bits: int, prefix_bits: int) -> np.ndarray:
    """Mean centroid of the codes that begin with each prefix."""
    return np.asarray(table).reshape(1 << prefix_bits, -1).mean(axis=1)


def code_sketch(index: DataFrame, codebook: DataFrame | Sequence[float], *, n_bits: int = 4, dim: int,
                prefix_bits: int = 1, codebook_dim: int | None = None) -> DataFrame:
    """(id, prefix, factor, rest, gamma): a map over the index, to be stored next
    to it. With one bit a row is a quarter of an index row of four bits."""
    if prefix_bits not in (1, 2) or prefix_bits >= n_bits:
        raise ValueError("prefixes have one or two bits, fewer than the codes")
    wide = k.next_power_of_two(dim)
    table = np.asarray(centroids(codebook, codebook_dim or wide, n_bits))
    values, width = prefix_values(table, n_bits, prefix_bits), k.check_packable(wide, n_bits)

    @F.arrow_udf("struct<prefix: binary, factor: double, rest: double>")
    def sketch(packed: pa.Array) -> pa.Array:
        def apply(c: pa.Array) -> pa.Array:
            code = k.unpack(k.byte_matrix(c, width), n_bits)
            prefix, whole = code >> np.uint8(n_bits - prefix_bits), table[code]
            coarse = values[prefix]
            factor = np.einsum("ij,ij->i", whole, coarse) / np.maximum(np.einsum("ij,ij->i", coarse, coarse), 1e-300)
            off = whole - factor[:, None] * coarse
            rest = np.sqrt(np.einsum("ij,ij->i", off, off))
            return pa.StructArray.from_arrays([k.matrix_bytes(k.pack(prefix, prefix_bits)), pa.array(factor), pa.array(rest)],
                                              ["prefix", "factor", "rest"])

        return k.over_valid(packed, lambda c: k.in_chunks(c, wide, apply))

    gamma = F.coalesce(F.col("gamma").cast("double"), F.lit(0.0)) if "gamma" in index.columns else F.lit(0.0)
    rows = index.where(F.col("packed").isNotNull())
    return rows.select("id", sketch("packed").alias("s"), gamma.alias("gamma")).select("id", "s.*", "gamma")


def _bounded(chunk: pa.Table, rotated: np.ndarray, sign_room: np.ndarray, values: np.ndarray, bits: int,
             scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries): lowest and highest unit score of each row."""
    coarse = k.unpack(k.byte_matrix(chunk["prefix"].combine_chunks(), rotated.shape[1] * bits // 8), bits, values)
    along = coarse @ rotated.T
    squares = np.maximum(np.einsum("ij,ij->i", coarse, coarse), 1e-300)[:, None]
    across = np.sqrt(np.maximum(1 - along * along / squares, 0))
    factor, rest, gamma = (chunk[c].to_numpy()[:, None] for c in ("factor", "rest", "gamma"))
    room = rest * across + scale * gamma * sign_room[None, :] + MARGIN
    return factor * along - room, factor * along + room


def search_cascade(index: DataFrame, sketch: DataFrame, queries: DataFrame, codebook: DataFrame | Sequence[float],
                   top_n: int = 10, *, n_bits: int = 4, dim: int, prefix_bits: int = 1, mse_seed: int = MSE_SEED,
                   qjl_seed: int = QJL_SEED, with_qjl: bool = True, alpha: str = "unbiased", codebook_dim: int | None = None,
                   chunk_rows: int = CHUNK_ROWS, piece_bytes: int = PIECE_BYTES, log: list | None = None) -> DataFrame:
    """Hits (qid, id, score, rank), the same as `search.search`.

    The sketch is read twice: for the k-th best lower bound of every query, and
    for the rows whose upper bound reaches it for some query. Of the index only
    those rows are scored; Spark picks the join by their written size. `sketch`
    is `code_sketch` of the same index. Ids must be unique. `log` receives the
    number of rows that were scored.
    """
    wide = k.next_power_of_two(dim)
    table = centroids(codebook, codebook_dim or wide, n_bits)
    values, scale = prefix_values(table, n_bits, prefix_bits), sketch_scale(wide, alpha) if with_qjl else 0.0
    id_type, qid_type = index.schema["id"].dataType, queries.schema["qid"].dataType
    arrow_id = to_arrow_type(id_type)
    asked = stored(unit_queries(queries, dim, mse_seed, qjl_seed), "queries")
    total = asked.count()
    chunks = chunk_table(sketch, chunk_rows)

    def blocks(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, piece in zip(batch["rows"], batch["piece"]):
                chunk, ask = (pa.ipc.open_stream(m.as_py()).read_all() for m in (rows, piece))
                rotated, other = (k.list_matrix(ask[c].combine_chunks()) for c in ("rotated", "qjl_rotated"))
                step = max(16, CELLS // max(ask.num_rows, wide))
                parts = (chunk.slice(at, step).combine_chunks() for at in range(0, chunk.num_rows, step))
                yield from use(ask, ((p, *_bounded(p, rotated, np.abs(other).sum(axis=1), values, prefix_bits, scale)) for p in parts))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def use(ask, parts):
            best = BestRows(ask.num_rows, top_n, arrow_id)
            for part, low, _ in parts:
                best.add(low, part["id"].combine_chunks())
            hits = best.finish()
            yield from pa.table({"qid": ask["qid"].combine_chunks().take(hits["query"].combine_chunks()), "id": hits["id"],
                                 "score": hits["score"]}).to_batches()

        return blocks(batches, use)

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def use(ask, parts):
            floor = ask["floor"].fill_null(-np.inf).to_numpy()
            for part, _, high in parts:
                reach = (np.round(high, 9) >= floor).any(axis=1)
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks().filter(pa.array(reach))], ["id"])

        return blocks(batches, use)

    def pieces(rows: DataFrame) -> DataFrame:
        return stored(query_pieces(rows, piece_bytes=piece_bytes, total=total, width=wide), "pieces").hint("shuffle_replicate_nl")

    id_field, qid_field = StructField("id", id_type), StructField("qid", qid_type)
    lows = chunks.crossJoin(pieces(asked)).mapInArrow(
        lowest, StructType([qid_field, id_field, *StructType.fromDDL("score double").fields]))
    floors = rank_hits(lows, top_n).where(F.col("rank") == top_n).select("qid", (F.col("score") - MARGIN).alias("floor"))
    bounded = pieces(stored(asked.join(floors, "qid", "left"), "floors"))
    kept = stored(chunks.crossJoin(bounded).mapInArrow(reaching, StructType([id_field])).distinct(), "reached")
    if log is not None:
        log.append(kept.count())
    rows = row_chunks(index.join(kept, "id", "left_semi"), with_qjl, chunk_rows=chunk_rows)
    hits = score_pairs(rows.crossJoin(bounded), table, n_bits, top_n, id_type=id_type, qid_type=qid_type, with_qjl=with_qjl, alpha=alpha)
    return rank_hits(hits, top_n).drop("unit")
