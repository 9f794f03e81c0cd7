"""Search as a join of blocks: index rows in chunks, queries in pieces.

A chunk and a piece are one row each, so that Spark pairs, places and repeats
blocks, and a task scores a block against a block with one matrix product. No
query and no hit passes through the driver.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from latticode.functions import kernels as k
from latticode.operators.codebook import centroids
from latticode.operators.index import MSE_SEED, QJL_SEED
from latticode.operators.search import CELLS, BestRows, rank_hits, rotate_queries, sketch_scale
from latticode.sources.tables import stored

#: Index rows of a chunk, and bytes of the queries of a piece.
CHUNK_ROWS = 1 << 15
PIECE_BYTES = 2 << 20


def _message(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(message: bytes) -> pa.Table:
    return pa.ipc.open_stream(message).read_all()


def row_chunks(index: DataFrame, with_qjl: bool = True, cells: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """([cell,] rows): index rows with a code, at most `chunk_rows` in a chunk,
    of one cell each. A map over the scan."""
    columns = ["id", "packed"] + (["gamma", "qjl_bits"] if with_qjl else [])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}

        def out(cell: int) -> pa.RecordBatch:
            table = pa.concat_tables(held.pop(cell)).combine_chunks()
            body = pa.array([_message(table)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), body], ["cell", "rows"])

        for batch in batches:
            batch = batch.filter(batch["packed"].is_valid())
            cell = batch["cell"].to_numpy()
            for c in np.unique(cell):
                table = pa.Table.from_batches([batch.filter(pa.array(cell == c))]).select(columns)
                for at in range(0, table.num_rows, chunk_rows):
                    part = table.slice(at, chunk_rows)
                    if sum(t.num_rows for t in held.get(int(c), [])) + part.num_rows > chunk_rows:
                        yield out(int(c))
                    held.setdefault(int(c), []).append(part)
        for c in list(held):
            yield out(c)

    rows = index.select(*columns, (F.col("cell").cast("int") if cells else F.lit(0)).alias("cell"))
    found = rows.mapInArrow(chunks, "cell int, rows binary")
    return found if cells else found.drop("cell")


def chunk_table(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(rows): any table in chunks. A map over the scan."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                body = _message(pa.Table.from_batches([batch.slice(at, chunk_rows)]))
                yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["rows"])

    return df.mapInArrow(chunks, "rows binary")


def unit_queries(queries: DataFrame, dim: int | None = None, mse_seed: int = MSE_SEED, qjl_seed: int = QJL_SEED) -> DataFrame:
    """(qid, length, rotated, qjl_rotated): rotated queries of length one, and
    what they were; queries with a coordinate that is not finite are left out."""
    rotated = rotate_queries(queries, dim, mse_seed, qjl_seed)
    qid = queries.schema["qid"].dataType

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [k.list_matrix(batch[c]) for c in ("rotated", "qjl_rotated")]
            good = np.isfinite(parts[0]).all(axis=1)
            main, other = (p[good] for p in parts)
            largest = np.abs(main).max(axis=1, initial=0)
            largest = np.where(largest == 0, 1.0, largest)
            length = largest * np.sqrt(np.square(main / largest[:, None]).sum(axis=1))
            length = np.where(length == 0, 1.0, length)
            lists = [k.matrix_list(m / length[:, None], pa.float64()) for m in (main, other)]
            yield pa.RecordBatch.from_arrays([batch["qid"].filter(pa.array(good)), pa.array(length), *lists],
                                             ["qid", "length", "rotated", "qjl_rotated"])

    double = "array<double>"
    return rotated.mapInArrow(scaled, f"qid {qid.simpleString()}, length double, rotated {double}, qjl_rotated {double}")


def query_pieces(queries: DataFrame, by: Sequence[str] = (), piece_bytes: int = PIECE_BYTES,
                 total: int | None = None, width: int = 64) -> DataFrame:
    """([by...,] piece): queries as blocks of about `piece_bytes`, of one value of
    `by` each. `total` and `width` (number and dimension) decide how many parts
    the queries are dealt to."""
    total = queries.count() if total is None else total
    parts = max(1, -(-total * 16 * width // piece_bytes))
    names = queries.columns

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        body = pa.array([_message(table.drop(list(by)).combine_chunks())], pa.binary())
        return pa.table([*[pa.array([v.as_py()], v.type) for v in key[:len(by)]], body], names=[*by, "piece"])

    fields = [queries.schema[c] for c in by] + [StructField("piece", StructType.fromDDL("b binary")["b"].dataType)]
    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).alias("part")
    return queries.select(*names, part).groupBy(*by, "part").applyInArrow(
        lambda key, table: pack(key, table.drop(["part"])), StructType(fields))


def score_pairs(pairs: DataFrame, table: Sequence[float], n_bits: int, top_n: int, *, id_type: DataType, qid_type: DataType,
                with_qjl: bool = True, alpha: str = "unbiased") -> DataFrame:
    """(qid, id, score, unit): the best `top_n` rows per query of every pair of a
    chunk `rows` and a `piece`; `unit` is the score of the query at length one.
    Pieces may have a `floor` per query: rows whose unit score is lower are left
    out. What one pair yields is bounded by its queries times `top_n`."""
    arrow_id, table = to_arrow_type(id_type), tuple(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[bytes, object]] = {}

        def read(kind: str, message: bytes, prepare):
            if kind not in last or last[kind][0] != message:
                last[kind] = message, prepare(_table(message))
            return last[kind][1]

        def queries_of(piece: pa.Table):
            parts = [k.list_matrix(piece["rotated"].combine_chunks())]
            dim = parts[0].shape[1]
            if with_qjl:
                parts.append(k.list_matrix(piece["qjl_rotated"].combine_chunks()))
            return piece, dim, np.hstack(parts).T

        for batch in batches:
            for rows, piece in zip(batch["rows"], batch["piece"]):
                asked, dim, matrix = read("piece", piece.as_py(), queries_of)
                chunk = read("rows", rows.as_py(), lambda t: t)
                best = BestRows(asked.num_rows, top_n, arrow_id)
                if "floor" in asked.column_names:
                    best.floor = np.maximum(best.floor, asked["floor"].fill_null(-np.inf).to_numpy())
                width, scale = k.check_packable(dim, n_bits), sketch_scale(dim, alpha)
                step = max(16, CELLS // max(asked.num_rows, dim))
                for at in range(0, chunk.num_rows, step):
                    part = chunk.slice(at, step).combine_chunks()
                    found = k.unpack(k.byte_matrix(part["packed"].combine_chunks(), width), n_bits, table)
                    if with_qjl:
                        gamma = part["gamma"].to_numpy().astype(np.float64)
                        signs = k.unpack(k.byte_matrix(part["qjl_bits"].combine_chunks(), dim // 8), 1, k.SIGNS)
                        found = np.hstack([found, (scale * gamma)[:, None] * signs])
                    best.add(found @ matrix, part["id"].combine_chunks())
                hits = best.finish()
                query = hits["query"].combine_chunks()
                length = asked["length"].to_numpy()[query.to_numpy()]
                unit = hits["score"].to_numpy()
                yield from pa.table({"qid": asked["qid"].combine_chunks().take(query), "id": hits["id"],
                                     "score": unit * length, "unit": hits["score"]}).to_batches()

    schema = StructType([StructField("qid", qid_type), StructField("id", id_type),
                         StructField("score", DoubleType()), StructField("unit", DoubleType())])
    return pairs.select("rows", "piece").mapInArrow(score, schema)


def search_grid(index: DataFrame, queries: DataFrame, codebook: DataFrame | Sequence[float], top_n: int = 10, *,
                n_bits: int = 4, dim: int, mse_seed: int = MSE_SEED, qjl_seed: int = QJL_SEED, with_qjl: bool = True,
                alpha: str = "unbiased", codebook_dim: int | None = None, chunk_rows: int = CHUNK_ROWS,
                piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Hits (qid, id, score, rank), as `search.search` finds them, for query
    tables of any size: pieces of queries are written to the shared folder, and a
    grid of tasks reads every piece against every split of the index. The
    driver sees the number of queries and nothing of them.

    Null queries and those that are not finite have no hits; empty tables give
    none. A lost task repeats one split against one part of the pieces.
    """
    wide = k.next_power_of_two(dim)
    table = centroids(codebook, codebook_dim or wide, n_bits)
    asked = stored(unit_queries(queries, dim, mse_seed, qjl_seed), "queries")
    pieces = stored(query_pieces(asked, piece_bytes=piece_bytes, width=wide), "pieces")
    # Every piece against every chunk: the query set against all rows, in blocks.
    pairs = row_chunks(index, with_qjl, chunk_rows=chunk_rows).crossJoin(pieces.hint("shuffle_replicate_nl"))
    hits = score_pairs(pairs, table, n_bits, top_n, id_type=index.schema["id"].dataType,
                       qid_type=queries.schema["qid"].dataType, with_qjl=with_qjl, alpha=alpha)
    return rank_hits(hits, top_n).drop("unit")
