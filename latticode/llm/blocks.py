"""Questions that blocks of documents ask about hashes, answered by shards.

Documents are dealt to blocks of a bounded number of bytes. A block sends its
distinct hashes, sorted, to the shards that own their ranges; a shard sees
every block's copy of a hash and sends answers back. A hash that fills a third
of all documents thus reaches its shard once per block, and nothing but the
texts and distinct hashes is ever moved. Arrays travel as binary columns.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
MAIL = "to long, sender long, body binary"
MAIL_ARROW = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("body", pa.binary())])


def blocked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            block_bytes: int = BLOCK_BYTES, **also: Column) -> tuple[DataFrame, int]:
    """((block, id, text, also...), number of blocks); one pass over text lengths.

    Id and text decide the block, so copies of a text spread unless their ids
    are equal too. A text longer than a block is a block's main part.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).alias("block")
    return docs.select(block, F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       *[c.alias(name) for name, c in also.items()]), n


def mail(keys: np.ndarray, shards: int, sender: int, *payload: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows that carry sorted keys, and a value for each, to the keys' shards."""
    cuts = owner_cuts(keys, shards)
    for s in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[s], cuts[s + 1]
        yield int(s), sender, pack(keys[a:b], *[p[a:b] for p in payload])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; all but hashes (unsigned 64-bit) are compressed."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        body = raw if a.dtype == np.uint64 else pa.compress(raw, "zstd", asbytes=True)
        parts += [a.dtype.str.ljust(8).encode(), np.array([len(a), len(body)], np.int64).tobytes(), body]
    return b"".join(parts)


def unpack(body: bytes) -> list[np.ndarray]:
    """The arrays of `pack`."""
    out, at = [], 8
    for _ in range(int(np.frombuffer(body, np.int64, 1)[0])):
        dtype = np.dtype(body[at:at + 8].decode().strip())
        length, size = np.frombuffer(body, np.int64, 2, at + 8).tolist()
        raw = body[at + 24:at + 24 + size]
        if dtype != np.uint64:
            raw = pa.decompress(raw, length * dtype.itemsize, "zstd", asbytes=True)
        out.append(np.frombuffer(raw, dtype))
        at += 24 + size
    return out


def owner_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted keys change their shard: shard s has cuts[s]:cuts[s + 1]."""
    owner = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(shards + 1, dtype=np.uint64))


def letters(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, MAIL_ARROW)], schema=MAIL_ARROW)


def bodies(table: pa.Table) -> list[list[np.ndarray]]:
    """Unpacked bodies in the order of their senders."""
    order = np.argsort(table["sender"].to_numpy(), kind="stable")
    body = table["body"]
    return [unpack(body[int(i)].as_py()) for i in order]


def ask(texts: DataFrame, question: Callable[[int, pa.Table], list], replies: DataFrame | None = None) -> DataFrame:
    """Mail from every block. `question(block, texts[, replies])` gives its rows."""
    if replies is None:
        def alone(key: tuple, table: pa.Table) -> pa.Table:
            return letters(list(question(key[0].as_py(), table)))

        return texts.groupBy("block").applyInArrow(alone, MAIL)

    def both(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return letters(list(question(key[0].as_py(), table, answers)) if table.num_rows else [])

    return texts.groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(both, MAIL)


def answer(questions: DataFrame, reply: Callable[[int, pa.Table], list]) -> DataFrame:
    """Mail back from every shard. `reply(shard, mail)` gives its rows."""
    def shard(key: tuple, table: pa.Table) -> pa.Table:
        return letters(list(reply(key[0].as_py(), table)))

    return questions.groupBy("to").applyInArrow(shard, MAIL)


def finish(texts: DataFrame, replies: DataFrame, result: Callable[[int, pa.Table, pa.Table], pa.Table],
           schema: str) -> DataFrame:
    """Rows that each block makes of its texts and the answers it got."""
    def both(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return result(key[0].as_py(), table, answers)

    return texts.groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(both, schema)


def repeated_elsewhere(shard: int, table: pa.Table) -> list[tuple[int, int, bytes]]:
    """The reply to mail of (keys, 1 where the block has a key twice or more):
    to each block those of its single keys that other blocks have too. Keys stay
    in the order of their senders, so that a reply is a slice."""
    sender = np.sort(table["sender"].to_numpy(), kind="stable")
    parts = bodies(table)
    keys = np.concatenate([p[0] for p in parts])
    single = np.concatenate([p[1] for p in parts]) == 0
    block = np.repeat(sender, [len(p[0]) for p in parts])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    tell = np.flatnonzero(shared & single)
    to, first = np.unique(block[tell], return_index=True)
    return [(int(b), shard, pack(part)) for b, part in zip(to, np.split(keys[tell], first[1:]))]
