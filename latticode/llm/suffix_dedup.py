"""Repeated byte strings by suffix arrays of the difference-cover kind.

Strings of `size` bytes are dealt by the smallest hash of the short strings
inside them, so equal ones meet in one shard, as stretches of text and not one
by one; stretches whose smallest hash no other place has cannot repeat and stay
at home. A smallest hash with more than `HOT_BYTES` of stretches is split: its
strings go each by a hash of their own. A shard makes equal stretches one and
sorts the suffixes of those that then share their hash with another: the triples
at two of three positions are sorted and named, the string of names is treated
the same way until names tell enough bytes, the remaining suffixes are sorted by
their first byte and the rank behind it and merged. Then neighbours that agree
in `size` bytes are the repeats.
"""

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latticode.llm import blocks
from latticode.llm.words import byte_hashes, chunks, mix, run_hashes, text_bytes

SIZE = 50
SHORT = 16
#: Bytes of texts whose hashes are made at a time; a few arrays of them fit a core's cache.
CHUNK = 1 << 16
#: Bytes of stretches with one smallest hash, beyond which it is split.
HOT_BYTES = 1 << 18
#: Bytes of a block: half of the usual, as every place of a text has a hash.
BLOCK_BYTES = blocks.BLOCK_BYTES // 2
#: Ranges of hashes that a shard sorts one after the other.
RANGES = 16
#: Tags that tell most of the hashes of a range apart.
TAGS = 1 << 16
LAST = np.iinfo(np.int64).max


def _names(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 1) of rows of numbers; equal rows share a rank. Rows
    that fit are sorted as one number each."""
    top = int(max(c.max(initial=0) for c in columns)) + 1
    if top ** len(columns) < 1 << 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * top + c
        columns = (key,)
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def suffix_array(s: np.ndarray, depth: int, told: int = 1, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of positive numbers in order, at least by their first `depth`
    bytes; a number tells `told` bytes. Zeros follow the end. All suffixes, or
    those where `wanted` is true: the others are named, but not merged."""
    n = len(s)
    here = np.zeros(n + 3, bool)
    here[:n] = True if wanted is None else wanted
    if n < 3:
        order = _names(*[np.append(s, [0] * 3)[k:k + n] for k in range(3)])[0]
        return order[here[order]]
    end = np.zeros(n + 5, np.int64)
    end[:n] = s
    # the cover: positions 1 and 2 modulo 3, with one behind the end if needed
    ones, twos = (n + 2) // 3, n // 3
    order, name = _names(*[np.concatenate([end[1 + k::3][:ones], end[2 + k::3][:twos]]) for k in range(3)])
    if 3 * told < depth and name.max() < len(name):
        order = suffix_array(name, depth, 3 * told)
        name = np.empty(len(order), np.int64)
        name[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 5, np.int64)
    rank[1::3][:ones], rank[2::3][:twos] = name[:ones], name[ones:]
    order = order[np.concatenate([here[1::3][:ones], here[2::3][:twos]])[order]]
    of_one = order < ones
    sample = 3 * order + np.where(of_one, 1, 2 - 3 * ones)
    top = rank.max() + 1
    # suffixes by a number or two and the rank behind: of each kind, in order
    kept = np.flatnonzero(here[0::3][:ones])
    rest = (end[0::3][:ones] * top + rank[1::3][:ones])[kept]
    by_rest = np.argsort(rest)
    a = end[1::3][:ones] * top + rank[2::3][:ones]
    below = np.searchsorted(a[order[of_one]], rest[by_rest])
    kept = kept[by_rest]
    wide = int(end.max()) + 1
    two_b, two_rest = end[2::3][:twos] * wide + end[3::3][:twos], end[0::3][:ones] * wide + end[1::3][:ones]
    if wide * wide * int(top) >= 1 << 63:
        pair = np.sort(np.concatenate([two_b, two_rest]))
        two_b, two_rest = np.searchsorted(pair, two_b), np.searchsorted(pair, two_rest)
    b, rest = two_b * top + rank[4::3][:twos], two_rest * top + rank[2::3][:ones]
    # suffixes alike beyond `depth` may stand in any order, but not cross
    below = np.maximum.accumulate(below + np.searchsorted(b[order[~of_one] - ones], rest[kept]))
    out = np.empty(len(order) + len(kept), np.int64)
    place = np.arange(len(kept)) + below
    free = np.ones(len(out), bool)
    free[place] = False
    out[place], out[free] = 3 * kept, sample
    return out


def equal_strings(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, class): the starts ordered by their suffixes, and a number that
    those whose first `size` bytes agree share."""
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    array = suffix_array(data.astype(np.int64) + 1, size, wanted=wanted)
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,)).copy()
    alike = np.arange(1, len(array))    # the last bytes tell most neighbours apart
    for k in [size - 8, *range(0, size - 8, 8)]:
        alike = alike[word[array[alike] + k] == word[array[alike - 1] + k]]
    apart = np.ones(len(array), bool)
    apart[alike] = False
    return array, np.cumsum(apart) - 1


def _slide(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    out, done = h, 1
    while done < width:
        step = min(done, width - done)
        out, done = np.minimum(out[:-step], out[step:]), done + step
    return out


def _least_hashes(data: np.ndarray, size: int, short: int) -> np.ndarray:
    """The smallest hash of the short strings inside each string of `size` bytes."""
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    n = len(data) - short + 1
    h = np.zeros(n, np.uint64)
    for k in [*range(0, short - 8, 8), short - 8]:
        h ^= eight[k:k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return _slide(h, size - short + 1)


class Stretches(NamedTuple):
    start: np.ndarray   # first string, in the bytes of the texts together
    count: np.ndarray   # strings that begin here and at the next places
    key: np.ndarray     # their smallest hash, mixed: small ones are common


def _stretches(data: np.ndarray, offsets: np.ndarray, size: int, short: int) -> Stretches:
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return Stretches(none, none, none.astype(np.uint64))
    least = _least_hashes(data, size, short)
    inside = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= size
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - size + 1] -= 1
    valid = np.cumsum(inside[:len(least)]) > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    new[offsets[:-1][offsets[:-1] < len(least)]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(least)))
    here = valid[start]
    return Stretches(start[here], count[here], mix(least[start[here]]))


def stretches(data: np.ndarray, offsets: np.ndarray, size: int, short: int) -> Stretches:
    """Runs of strings of `size` bytes, at least `short` >= 8, that have their
    smallest hash in common; made for some texts at a time."""
    parts = []
    for i, j in chunks(offsets, CHUNK):
        a, b = offsets[i], offsets[j]
        part = _stretches(data[a:b], offsets[i:j + 1] - a, size, short)
        parts.append(part._replace(start=part.start + a))
    if not parts:
        return _stretches(data, offsets, size, short)
    return Stretches(*[np.concatenate(c) for c in zip(*parts)])


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run of `count` places."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Items(NamedTuple):
    """Places of a block that are sent, and the different stretches there."""

    start: np.ndarray   # of every place
    count: np.ndarray
    number: np.ndarray  # which stretch it is
    keys: np.ndarray    # of the stretches, ascending
    firsts: np.ndarray  # a place of each


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where each different key begins in it, how often it occurs)."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(keys)))


def _of_keys(found: Stretches, order: np.ndarray, times: np.ndarray, some: np.ndarray) -> Stretches:
    """The stretches of some of the keys, in their places' order."""
    here = np.empty(len(order), bool)
    here[order] = np.repeat(some, times)
    return Stretches(*[c[here] for c in found])


def _items(data: np.ndarray, found: Stretches, size: int) -> Items:
    """The places by stretch: key, length and a hash of all bytes agree, 128 bits.
    Stretches stand in an order of their own, however the texts lie."""
    content = byte_hashes(data, found.start, found.start + found.count + size - 1)
    by_key, at, times = _runs(found.key)
    # key's number and first bits of the content as one number to sort by
    bits = max(1, len(at).bit_length())
    both = content >> np.uint64(bits)
    both[by_key] |= np.repeat(np.arange(len(at), dtype=np.uint64), times) << np.uint64(64 - bits)
    order = np.argsort(both)
    new = np.ones(len(order), bool)
    new[1:] = both[order][1:] != both[order][:-1]
    apart = new.copy()
    for column in (content, found.count):
        apart[1:] |= column[order][1:] != column[order][:-1]
    if (apart & ~new).any():    # different ones with the same first bits: all of the columns
        order = np.lexsort((found.count, content, found.key))
        new[1:] = False
        for column in (found.key, content, found.count):
            new[1:] |= column[order][1:] != column[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    firsts = order[new]
    return Items(found.start, found.count, number, found.key[firsts], firsts)


def _single(data: np.ndarray, found: Stretches, size: int) -> Stretches:
    """The strings of the stretches one by one, each with a hash of its own."""
    start = _places(found.start, found.count)
    order = np.argsort(start)
    start = start[order]
    return Stretches(start, np.ones(len(start), np.int64), run_hashes(data, start, start + size))


def _questions(data: np.ndarray, offsets: np.ndarray, size: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, bytes of their different stretches, 1 where a key has several places)."""
    found = stretches(data, offsets, size, short)
    order, at, times = _runs(found.key)
    several = times > 1
    key, volume = found.key[order[at]], found.count[order[at]] + size - 1
    items = _items(data, _of_keys(found, order, times, several), size)
    if several.any():
        volume[several] = np.add.reduceat(items.count[items.firsts] + size - 1,
                                          np.flatnonzero(np.append(True, items.keys[1:] != items.keys[:-1])))
    return key, volume, several.astype(np.uint8)


def _reply(shard: int, table: pa.Table, hot_bytes: int) -> list[tuple[int, int, bytes]]:
    """To each block: those of its keys with one place that other blocks have
    too, and those that are split."""
    sender, parts = np.sort(table["sender"].to_numpy(), kind="stable"), blocks.bodies(table)
    keys, volume, several = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order, at, times = _runs(keys)
    shared, hot = np.empty(len(keys), bool), np.empty(len(keys), bool)
    shared[order] = np.repeat(times > 1, times)
    hot[order] = np.repeat(np.add.reduceat(volume[order], at) > hot_bytes, times)
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    shared &= several == 0
    return [(int(b), shard, blocks.pack(k[s], k[h])) for b, k, s, h in zip(
        sender, np.split(keys, cuts), np.split(shared, cuts), np.split(hot, cuts)) if s.any() or h.any()]


def _sent(data: np.ndarray, offsets: np.ndarray, answers: pa.Table, size: int, short: int) -> Items:
    """What a block sends to be sorted, after the answers to its questions."""
    found, told = stretches(data, offsets, size, short), blocks.bodies(answers)
    order, at, times = _runs(found.key)
    keys, known, hot = found.key[order[at]], times > 1, np.zeros(len(at), bool)
    for flag, k in ((known, 0), (hot, 1)):      # told of the block's own keys only
        flag[np.searchsorted(keys, np.concatenate([keys[:0], *[t[k] for t in told]]))] = True
    cool, alone = (_of_keys(found, order, times, some) for some in (known & ~hot, known & hot))
    return _items(data, Stretches(*[np.concatenate(c) for c in zip(cool, _single(data, alone, size))]), size)


def _same(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For every stretch the first one with the same bytes."""
    content = byte_hashes(data, start, start + length)
    order = np.lexsort((np.arange(len(start)), length, content))
    new = np.ones(len(order), bool)
    new[1:] = (content[order][1:] != content[order][:-1]) | (length[order][1:] != length[order][:-1])
    first = np.empty(len(order), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    copy = np.flatnonzero(first != np.arange(len(first)))
    if len(copy):
        differs = data[_places(start[copy], length[copy])] != data[_places(start[first[copy]], length[copy])]
        wrong = copy[np.add.reduceat(differs, np.cumsum(length[copy]) - length[copy]) > 0]
        first[wrong] = wrong
    return first


def _sorted_shard(parts: list[list[np.ndarray]], size: int) -> list[np.ndarray]:
    """For each sender the smallest document of every string it sent, range by
    range of the hashes, as equal strings lie in one."""
    items = np.stack([np.concatenate([[0], np.cumsum(p[3])]) for p in parts])
    chars = np.stack([np.concatenate([[0], np.cumsum(p[0], dtype=np.int64)])[i] for p, i in zip(parts, items)])
    told = [[] for _ in parts]
    for r in range(items.shape[1] - 1):
        some = np.flatnonzero(items[:, r + 1] > items[:, r])
        if not len(some):
            continue
        length, doc, tag = (np.concatenate([parts[k][c][items[k, r]:items[k, r + 1]] for k in some]) for c in (0, 1, 4))
        data = np.concatenate([parts[k][2][chars[k, r]:chars[k, r + 1]] for k in some])
        answer = _sorted_range(length.astype(np.int64), doc, tag, data, size)
        ends = (chars[some, r + 1] - chars[some, r] - (items[some, r + 1] - items[some, r]) * (size - 1)).cumsum()
        for k, part in zip(some, np.split(answer, ends[:-1])):
            told[k].append(part)
    return [np.concatenate(t) for t in told]


def _sorted_range(length: np.ndarray, doc: np.ndarray, tag: np.ndarray, data: np.ndarray, size: int) -> np.ndarray:
    """The smallest document of every string of the stretches in `data`. A
    stretch without another of its tag, but for copies, has no string that
    another has; the others are sorted."""
    start, count = np.cumsum(length) - length, length - size + 1
    first = _same(data, start, length)
    least = np.full(len(first), LAST)
    np.minimum.at(least, first, doc)
    different = np.flatnonzero(first == np.arange(len(first)))
    shared = np.bincount(tag[different], minlength=TAGS)[tag] > 1
    answer, different = np.repeat(least[first], count), different[shared[different]]
    if not len(different):
        return answer
    size_of = length[different]
    text = data[_places(start[different], size_of)]
    begins = np.cumsum(size_of) - size_of
    array, kind = equal_strings(text, _places(begins, count[different]), size)
    document = np.repeat(least[different], size_of)
    best = np.full(kind[-1] + 1, LAST)
    np.minimum.at(best, kind, document[array])
    told = np.empty(len(text), np.int64)
    told[array] = best[kind]
    at = np.empty(len(first), np.int64)
    at[different] = begins
    answer[np.repeat(shared, count)] = told[_places(at[first[shared]], count[shared])]
    return answer


def _ids(table: pa.Table) -> np.ndarray:
    return table["id"].cast(pa.int64()).fill_null(LAST).to_numpy()


def remove_earlier_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                           short: int = SHORT, block_bytes: int = BLOCK_BYTES,
                           keep_bytes: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per row.

    A byte goes if a string of `size` bytes covers it that also starts in a row
    with a smaller id. Strings lie inside one text and are judged on the input.
    Ids are whole numbers; a null id is larger than all others, and rows with
    equal ids leave each other alone. A null or short text loses nothing. An
    empty table gives no rows; other columns are not read. `short` is 8 or more.
    A smallest hash with more than `hot_bytes` of stretches is split.
    """
    texts, n = blocks.blocked(docs, id_col, text_col, block_bytes)

    def first(block: int, table: pa.Table) -> list:
        keys, volume, several = _questions(*text_bytes(table["text"]), size, short)
        return list(blocks.mail(keys, n, block, volume, several))

    def answers_of(shard: int, table: pa.Table) -> list:
        return _reply(shard, table, hot_bytes)

    def second(block: int, table: pa.Table, answers: pa.Table) -> list:
        data, offsets = text_bytes(table["text"])
        items, doc = _sent(data, offsets, answers, size, short), _ids(table)
        least = np.full(len(items.keys), LAST)
        np.minimum.at(least, items.number, doc[np.searchsorted(offsets, items.start, side="right") - 1])
        start, length = items.start[items.firsts], items.count[items.firsts] + size - 1
        ranges, out = blocks.owner_cuts(items.keys, n * RANGES), []
        cuts, tags = ranges[::RANGES], (items.keys % np.uint64(TAGS)).astype(np.uint16)
        for s in np.flatnonzero(np.diff(cuts)):
            mine = slice(cuts[s], cuts[s + 1])
            out.append((int(s), block, blocks.pack(
                length[mine].astype(np.int32), least[mine], data[_places(start[mine], length[mine])],
                np.diff(ranges[s * RANGES:(s + 1) * RANGES + 1]).astype(np.int32), tags[mine])))
        return out

    def sort(shard: int, table: pa.Table) -> list:
        sender = np.sort(table["sender"].to_numpy(), kind="stable")
        return [(int(b), -1 - shard, blocks.pack(a)) for b, a in zip(sender, _sorted_shard(blocks.bodies(table), size))]

    def last(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        sender, doc = answers["sender"].to_numpy(), _ids(table)
        data, offsets = text_bytes(table["text"])
        items = _sent(data, offsets, answers.filter(pa.array(sender >= 0)), size, short)
        # answers of the shards, in the order of their numbers
        told = blocks.bodies(answers.filter(pa.array(sender < 0)))[::-1]
        least = np.concatenate([np.zeros(0, np.int64), *[t[0] for t in told]])
        count = items.count[items.firsts]
        at = (np.cumsum(count) - count)[items.number]
        own = doc[np.searchsorted(offsets, items.start, side="right") - 1]
        gone = least[_places(at, items.count)] < np.repeat(own, items.count)
        begun = np.zeros(len(data) + 1, np.int32)
        begun[_places(items.start, items.count)[gone] + 1] = 1
        begun = np.cumsum(begun, dtype=np.int32)     # strings that go and begin before a byte
        removed = begun[1:] > np.concatenate([np.zeros(size - 1, np.int32), begun])[:len(data)]
        raw, rows = data.tobytes(), []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            mask = removed[a:b]
            kept = data[a:b][~mask].tobytes() if mask.any() else raw[a:b]
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            rows.append((b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(),
                         kept if keep_bytes else None))
        cols = list(zip(*rows)) or [()] * 5
        out = {"id": table["id"], "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
               "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())}
        return pa.table(out | ({"kept": pa.array(cols[4], pa.binary())} if keep_bytes else {}))

    # answered twice from the same mail: written, it would be a query of its own,
    # and the texts would be shuffled, and lie on disk, twice
    repeated = blocks.answer(blocks.ask(texts, first), answers_of)
    sorted_ = blocks.answer(blocks.ask(texts, second, repeated), sort)
    return blocks.finish(texts, repeated.union(sorted_), last, f"id {docs.schema[id_col].dataType.simpleString()}, "
                         "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                         + (", kept binary" if keep_bytes else ""))
