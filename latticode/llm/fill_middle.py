"""Fill-in-middle: a text cut at two places and put together in another order.

Cuts are given in code points and made in bytes. The first bytes of a text's
code points form a compressed set of positions: containers of 2^16 positions,
each an array, a bitmap or runs, whichever is smallest, and how many members
come before every container. Where code point k starts is then a search among
the containers and a selection inside one.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticode.llm.tables import text_or_empty
from latticode.llm.words import chunks, text_bytes

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
#: Positions per container, and bytes of a bitmap of that many.
SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8


class Positions(NamedTuple):
    """Members as sorted 16-bit numbers: two bytes each."""

    at: np.ndarray

    def select(self, k: int) -> int:
        return int(self.at[k])


class Bitmap(NamedTuple):
    """A bit per position, and how many are set before every 64 of them."""

    bits: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bits[8 * word:8 * word + 8], bitorder="little"))
        return 64 * word + int(inside[k - int(self.before[word])])


class Runs(NamedTuple):
    """First members of runs without gaps, and how many members come before each."""

    first: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def container(member: np.ndarray) -> tuple[Positions | Bitmap | Runs, int]:
    """The smallest container of the true places of a mask, and how many there are."""
    size = int(np.count_nonzero(member))
    if size == len(member):
        return Runs(np.zeros(1, np.int64), np.zeros(1, np.int64)), size
    edge = np.flatnonzero(np.diff(member, prepend=False, append=False))
    runs = len(edge) // 2
    if 4 * runs <= min(2 * size, BITMAP_BYTES):
        return Runs(edge[::2], _before(edge[1::2] - edge[::2])), size
    if 2 * size <= BITMAP_BYTES:
        return Positions(np.flatnonzero(member).astype(np.uint16)), size
    bits = np.packbits(np.pad(member, (0, -len(member) % 64)), bitorder="little")
    return Bitmap(bits, _before(np.bitwise_count(bits.view(np.uint64)).astype(np.int64))), size


class Boundaries:
    """Where the code points of a UTF-8 text begin. `size` is their number."""

    def __init__(self, data: np.ndarray):
        self.end, self.keys, self.containers, sizes = len(data), [], [], []
        for key in range(-(-len(data) // SPAN)):
            part = data[key * SPAN:(key + 1) * SPAN]
            box, n = container((part & 0xC0) != 0x80)
            if n:
                self.keys.append(key)
                self.containers.append(box)
                sizes.append(n)
        self.before = _before(np.array(sizes, np.int64))
        self.size = sum(sizes)

    def select(self, k: int) -> int:
        """Byte offset of code point k; the end of the text for k = size."""
        if k == self.size:
            return self.end
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.keys[at] * SPAN + self.containers[at].select(k - int(self.before[at]))


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks that, beside a text without any of them, are found nowhere else:
    no end of one begins another, and none is part of another."""
    for a in marks:
        for b in marks:
            inside = a != b and a in b
            if not a or inside or any(a.endswith(b[:k]) for k in range(1, len(b) if a == b else len(b) + 1)):
                raise ValueError(f"marks {a!r} and {b!r} cannot be told apart")
    if len(set(marks)) < 3:
        raise ValueError("marks must differ")


def fill_in_middle(docs: DataFrame, *, seed: int = 1, marks: tuple[str, str, str] = MARKS,
                   cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per row.

    Four numbers come from the SHA-256 of seed and id: two cuts among the n + 1
    places of a text of n code points, whether it is cut at all, and the order:
    "psm" is prefix, suffix, middle, "spm" suffix, prefix, middle, each behind
    its mark. Texts that are empty or hold a mark stay as they are ("plain", no
    lengths), so that `restored` gives every text back.

    A null text is empty, a null id counts as the empty id; rows with equal ids
    get the same numbers. An empty table gives no rows; other columns are not
    read. A map over the scan: no shuffle, one batch of texts at a time.
    """
    check_marks(marks)
    p, s, m = (mark.encode() for mark in marks)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            draws = [batch[f"h{k}"].to_numpy() for k in range(1, 5)]
            for i, j in chunks(offsets):
                rows = []
                for d in range(i, j):
                    part = data[offsets[d]:offsets[d + 1]]
                    edges, raw = Boundaries(part), part.tobytes()
                    n = edges.size
                    if not n or draws[2][d] % 100 >= cut_percent or p in raw or s in raw or m in raw:
                        rows.append((n, "plain", None, None, raw))
                        continue
                    low, high = sorted((int(draws[0][d]) % (n + 1), int(draws[1][d]) % (n + 1)))
                    a, b = edges.select(low), edges.select(high)
                    if draws[3][d] % 100 < suffix_first_percent:
                        form, out = "spm", b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
                    else:
                        form, out = "psm", b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))
                    rows.append((n, form, low, high - low, out))
                n, form, low, middle, out = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(low, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names)

    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(F.encode(name, "UTF-8"), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *numbers).mapInArrow(
        run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that `fill_in_middle` made the output of."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks

    def between(start: str, end: str | None) -> Column:
        rest = F.split_part(out, F.lit(start), F.lit(2))
        return rest if end is None else F.split_part(rest, F.lit(end), F.lit(1))

    return (F.when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m)))
            .when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p)))
            .otherwise(out))
