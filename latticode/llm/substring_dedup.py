"""Repeated passages by difference-cover anchors.

Only windows that start at word positions in a difference cover modulo a
period are hashed and compared first. For any two places the cover has a
common offset, so passages of `size` equal words share an anchor of
`size - period + 1` words at the same offset, wherever they begin. Around the
anchors that occur twice every window is then hashed in full and compared.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latticode.llm import blocks
from latticode.llm.words import Words, chunks, run_hashes, text_bytes, windows, words

#: Perfect difference sets, every residue is a difference.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}
SIZE = 35
PERIOD = 21


def anchors(w: Words, size: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the anchors at cover positions of each text."""
    place = np.arange(len(w.starts)) - np.repeat(w.first[:-1], np.diff(w.first))
    last = np.repeat(w.first[1:], np.diff(w.first))
    length = size - period + 1
    at = np.flatnonzero(np.isin(place % period, COVERS[period])
                        & (np.arange(len(last)) + length <= last))
    return at, run_hashes(w.hashes, at, at + length)


def candidates(w: Words, at: np.ndarray, size: int, period: int) -> np.ndarray:
    """First words of the windows that contain one of the anchors `at`."""
    n = len(w.starts)
    text = np.searchsorted(w.first, at, side="right") - 1
    low = np.maximum(at - (period - 1), w.first[text])
    high = np.minimum(at, w.first[text + 1] - size)
    ok = low <= high
    level = np.zeros(n + 1, np.int64)
    np.add.at(level, low[ok], 1)
    np.add.at(level, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(level[:-1]) > 0)


def covered(w: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Words inside a window that starts at one of `at`."""
    level = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(level, at, 1)
    np.add.at(level, at + size, -1)
    return np.cumsum(level[:-1]) > 0


def _parts(table: pa.Table):
    texts = table["text"].combine_chunks()
    for i, j in chunks(text_bytes(texts)[1]):
        yield i, j, words(texts[i:j])


def _single(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
    return values, (counts > 1).astype(np.uint8)


def _known(values: np.ndarray, twice: np.ndarray, replies: pa.Table) -> np.ndarray:
    """Sorted keys that occur twice: in the block itself, or by the answers."""
    parts = [values[twice == 1], *[p[0] for p in blocks.bodies(replies)]]
    return np.sort(np.concatenate(parts))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, keys)
    return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == keys) if len(known) else np.zeros(len(keys), bool)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                   period: int = PERIOD, block_bytes: int = blocks.BLOCK_BYTES,
                   keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]), one row per row.

    Every word is removed that lies in a window of `size` words whose words
    also start anywhere else, in another row or the same. All windows are
    judged on the input. A null or empty text has no words, a text shorter
    than a window loses none, equal rows remove each other, an empty table
    gives no rows. Texts are moved to their blocks once and read there three
    times; other columns are not read.
    """
    texts, n = blocks.blocked(docs, id_col, text_col, block_bytes)

    def send(block: int, found: tuple[np.ndarray, np.ndarray]) -> list:
        return list(blocks.mail(found[0], n, block, found[1]))

    def first(block: int, table: pa.Table) -> list:
        return send(block, _single([anchors(w, size, period)[1] for _, _, w in _parts(table)]))

    def second(block: int, table: pa.Table, replies: pa.Table) -> list:
        found = [(w, *anchors(w, size, period)) for _, _, w in _parts(table)]
        known = _known(*_single([h for _, _, h in found]), replies)
        keys = []
        for w, at, h in found:
            starts = candidates(w, at[_among(h, known)], size, period)
            keys.append(run_hashes(w.hashes, starts, starts + size))
        return send(block, _single(keys))

    def last(block: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        values, twice = _single([windows(w, size)[1] for _, _, w in _parts(table)])
        known = _known(values, twice, replies)
        rows = []
        for i, j, w in _parts(table):
            starts, h = windows(w, size)
            gone = covered(w, starts[_among(h, known)], size)
            raw = table["text"].combine_chunks()[i:j].cast(pa.large_binary()).to_pylist()
            for d, text in enumerate(raw):
                a, b = w.first[d], w.first[d + 1]
                kept = (text or b"").split()
                if gone[a:b].any():
                    kept = [kept[k] for k in np.flatnonzero(~gone[a:b])]
                joined = b" ".join(kept)
                rows.append((int(b - a), int(b - a) - len(kept), hashlib.sha256(joined).hexdigest(),
                             joined.decode() if keep_text else None))
        cols = list(zip(*rows)) or [(), (), (), ()]
        out = {"id": table["id"], "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
               "kept_sha256": pa.array(cols[2], pa.string())}
        return pa.table(out | ({"kept_text": pa.array(cols[3], pa.string())} if keep_text else {}))

    asked = blocks.answer(blocks.ask(texts, first), blocks.repeated_elsewhere)
    sure = blocks.answer(blocks.ask(texts, second, asked), blocks.repeated_elsewhere)
    return blocks.finish(texts, sure, last, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
                         + (", kept_text string" if keep_text else ""))

