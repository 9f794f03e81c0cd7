"""Encoding with a SentencePiece vocabulary of the merge type, and decoding.

A word starts as its characters. An agenda holds the rank of every adjacent pair
that is a piece, the best score first and the leftmost of equals; the pair on
top is merged, and the pairs with its neighbours are ranked anew. The different
words of a batch have their agendas side by side, a row each, and are merged in
the same steps; long words have a heap of their own. Characters the vocabulary
lacks become their bytes.
"""

import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the mark of a space.
SPACE_MARK = "▁"
#: Widths of the agendas that lie side by side; longer words use a heap.
WIDTHS = (5, 7, 9, 12, 16, 24, 40)
BATCH_CHARS = 4 << 20
#: What is not a symbol: beyond the end of a word, and an unknown character.
ABSENT, UNKNOWN = -1, -2
#: The rank of what is no pair; slots of the table of pairs.
NEVER = np.int32(2 ** 31 - 1)
SLOTS = 1 << 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary with its own encoder and decoder.

    It takes models whose normalisation only puts a space in front and marks
    spaces, and whose pieces have marks nowhere but in front: then a text can
    be cut before every mark that follows something else.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.vocab_size()
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special}
        self.rank = {p: -lib.get_score(i) for p, i in self.id.items()}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id):
            raise ValueError("a piece has a space inside")
        # what an id decodes to by itself: all but bytes inside longer characters
        self.alone = ["" if i in self.silent else " ⁇ " if i == self.unknown else
                      chr(self.byte[i]) if self.byte.get(i, 128) < 128 else p for i, p in enumerate(self.piece)]
        self.high = {i for i, b in self.byte.items() if b >= 128}
        self.is_high = np.zeros(n, bool)
        self.is_high[list(self.high)] = True
        self.number, self.shown = pa.array([str(i) for i in range(n)]), pa.array(self.alone)
        self._pairs(n)

    def _pairs(self, n: int) -> None:
        """Symbols are pieces and characters of pieces; every cut of a piece into
        two symbols is a pair that merges."""
        symbol = dict(self.id)
        for c in sorted({c for p in self.id for c in p} - symbol.keys()):
            symbol[c] = n + len(symbol) - len(self.id)
        self.extra = {s: c for c, s in symbol.items() if s >= n}
        self.size, self.of_char = n + len(self.extra), np.full(0x110000, UNKNOWN, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        found = {symbol[p[:k]] * self.size + symbol[p[k:]]: i for p, i in self.id.items()
                 for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        order = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        slots = max(SLOTS, 1 << (4 * len(found)).bit_length())
        self.shift, self.probes = np.uint64(64 - slots.bit_length() + 1), 1
        self.key, self.key_rank = np.full(slots, -1, np.int64), np.full(slots, NEVER, np.int32)
        self.key_piece = np.full(slots, ABSENT, np.int32)
        homes = self._home(np.fromiter(found, np.int64, len(found))).tolist()
        for (key, piece), at in zip(found.items(), homes):
            probes = 1
            while self.key[at] >= 0:
                at, probes = (at + 1) % slots, probes + 1
            self.key[at], self.key_rank[at], self.key_piece[at] = key, order[self.rank[self.piece[piece]]], piece
            self.probes = max(self.probes, probes)
        self.byte_table = np.array([self.byte_id.get(b, self.unknown) for b in range(256)], np.int32)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; what is no pair has rank `NEVER`."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = self._home(key)
        off = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        for _ in range(self.probes):  # the few whose place was taken
            if not len(off):
                break
            at[off] = (at[off] + 1) % len(self.key)
            off = off[(self.key[at[off]] != key[off]) & (self.key[at[off]] >= 0)]
        real = self.key[at] == key
        return np.where(real, self.key_rank[at], NEVER), np.where(real, self.key_piece[at], ABSENT)

    def merge_side_by_side(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, each merged by its own agenda; shorter rows end with
        ABSENT, and so do symbols that went into the one before them."""
        n, width = symbols.shape
        wide = width + 1  # a column of nothing behind the last symbol
        sym = np.full((n, wide), ABSENT, np.int32)
        sym[:, :width] = symbols
        rank, merged = np.full((n, wide), NEVER, np.int32), np.full((n, wide), ABSENT, np.int32)
        pairs = self._ranked(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank[:, :-1], merged[:, :-1] = (x.reshape(n, width) for x in pairs)
        after = np.broadcast_to(np.minimum(np.arange(wide) + 1, width), (n, wide)).astype(np.int64).ravel()
        before = np.broadcast_to(np.arange(wide) - 1, (n, wide)).astype(np.int64).ravel()
        flat, ranks, into = sym.ravel(), rank.ravel(), merged.ravel()
        line = np.arange(n)
        while len(line):
            agenda = rank[line]
            top = agenda.argmin(axis=1)
            live = agenda[np.arange(len(line)), top] < NEVER
            line, top = line[live], top[live]
            base = line * wide
            here = base + top
            gone = base + after[here]
            follow = after[gone]
            flat[here] = into[here]
            flat[gone], ranks[gone] = ABSENT, NEVER
            after[here] = follow
            before[base + follow] = top
            ranks[here], into[here] = self._ranked(flat[here], flat[base + follow])
            some = before[here] >= 0
            back = base[some] + before[here[some]]
            ranks[back], into[back] = self._ranked(flat[back], flat[here[some]])
        return sym[:, :width]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words, one after the other, and where
        each word's end. A word's characters include its mark."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts, order, sizes = [], [], []
        low = 0
        for width in WIDTHS:
            at = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for a in range(0, len(at), 1 << 16):
                some = at[a:a + (1 << 16)]
                chars = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32)
                inside = np.arange(width) < lengths[some][:, None]
                symbols = np.full(inside.shape, ABSENT, np.int32)
                symbols[inside] = self.of_char[chars]
                unknown = chars[self.of_char[chars] == UNKNOWN]
                merged = self.merge_side_by_side(symbols)
                ids, size = self._as_ids(merged, unknown)
                parts.append(ids)
                sizes.append(size)
                order.append(some)
        for i in np.flatnonzero((lengths == 0) | (lengths > WIDTHS[-1])):
            ids = self.merge(words[i])
            parts.append(np.array(ids, np.int32))
            sizes.append([len(ids)])
            order.append([i])
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order, size = np.concatenate(order), np.concatenate(sizes).astype(np.int64)
        flat, starts = np.concatenate(parts), np.cumsum(size) - size
        back = np.argsort(order)
        return gathered(flat, starts[back], size[back]), np.cumsum(size[back])

    def _as_ids(self, merged: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of symbols, and how many each row has. `unknown` are the
        unknown characters in the order of the rows, which merge with nothing."""
        real = merged != ABSENT
        row, flat = np.nonzero(real)[0], merged[real]
        odd = (flat < 0) | (flat >= len(self.piece))
        if not odd.any():
            return flat, real.sum(axis=1)
        char = np.zeros(len(flat), np.uint32)
        char[flat == UNKNOWN] = unknown
        for s, c in self.extra.items():
            char[flat == s] = ord(c)
        raw = [chr(c).encode("utf-8", "surrogatepass") if self.byte_id else b"?" for c in char[odd]]
        width = np.ones(len(flat), np.int64)
        width[odd] = [len(r) for r in raw]
        ids, starts = np.repeat(flat, width), np.cumsum(width) - width
        spelled = self.byte_table[np.frombuffer(b"".join(raw), np.uint8)] if self.byte_id else np.full(len(raw), self.unknown, np.int32)
        ids[np.repeat(odd, width)] = spelled
        return ids, np.bincount(row, width, len(merged)).astype(np.int64)

    def merge(self, word: str) -> list[int]:
        """Ids of one word, its agenda a heap."""
        ids = []
        for p in self._long(word):
            if p in self.id:
                ids.append(self.id[p])
            else:
                ids += [self.byte_id[b] for b in p.encode()] if self.byte_id else [self.unknown]
        return ids

    def _long(self, word: str) -> list[str]:
        """The agenda as a heap of (rank, left, right, size); an entry whose
        size is no longer that of its halves is passed over."""
        rank, n = self.rank.get, len(word)
        part, left, right = list(word), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            one, two = part[i], part[j]
            if not one or not two or len(one) + len(two) != size:
                continue
            one += two
            part[i], part[j] = one, ""
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (r := rank(one + part[after])) is not None:
                    heappush(agenda, (r, i, after, size + len(part[after])))
            before = left[i]
            if before >= 0 and (r := rank(part[before] + one)) is not None:
                heappush(agenda, (r, before, i, size + len(part[before])))
        return [p for p in part if p]

    def words(self, text: str) -> list[str]:
        """The text cut before every first mark of a run of spaces, without
        that mark; the whole has one more space in front."""
        if not text:
            return []
        parts = text.replace(SPACE_MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, marks = [], ""
        for part in parts:
            if part:
                out.append(marks + part)
                marks = ""
            else:
                marks += SPACE_MARK
        return out + [marks[1:]] if marks else out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids, ends, decoded) of texts: each different word is merged and
        decoded once."""
        split = [self.words(t) for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        words = [SPACE_MARK + w for w in coded.dictionary.to_pylist()]
        ids, ends = self.merge_words(words)
        # one more "word" per text, the end
        which = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(count), len(words))
        flat, size = np.append(ids, np.int32(self.end)), np.append(np.diff(ends, prepend=0), 1)
        starts, sizes = np.cumsum(size) - size, size[which]
        total = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(count + 1))]
        ids = gathered(flat, starts[which], sizes)
        return ids, total[1:], self._decoded(ids, total)

    def _decoded(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """What the ids of each text decode to."""
        shown = pa.LargeListArray.from_arrays(pa.array(offsets), self.shown.take(pa.array(ids)))
        joined = pc.binary_join(shown, "")
        out = [t.removeprefix(" ") for t in pc.replace_substring(joined, SPACE_MARK, " ").to_pylist()]
        high = np.append(0, np.cumsum(self.is_high[ids]))[offsets]
        for d in np.flatnonzero(np.diff(high)):  # bytes of longer characters
            out[d] = self.decode(ids[offsets[d]:offsets[d + 1]].tolist())
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes read as UTF-8 (each wrong byte a U+FFFD), marks
        made spaces, the one put in front taken off."""
        if self.high.isdisjoint(ids):
            text = "".join([self.alone[i] for i in ids])
            return (text[1:] if text.startswith(SPACE_MARK) else text).replace(SPACE_MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.piece[i])
        out.append(_utf8(raw))
        text = "".join(out)
        return (text[1:] if text.startswith(SPACE_MARK) else text).replace(SPACE_MARK, " ")


def _utf8(raw: bytearray) -> str:
    """UTF-8 with U+FFFD for each byte that is part of no character."""
    out, i = [], 0
    while i < len(raw):
        lead = raw[i]
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            out.append(bytes(raw[i:i + size]).decode() if size else "�")
            i += size or 1
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """One per worker process, so that words stay known between tasks."""
    return Pieces(model)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of every pair, one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(len(shift))]


def check(own: Pieces, texts: list[str], ids: np.ndarray, ends: np.ndarray, decoded: list[str]) -> None:
    """An error if the sentencepiece library gives anything else."""
    true = own.library.encode(texts, add_eos=True, num_threads=1)
    size = np.fromiter(map(len, true), np.int64, len(true))
    flat = np.fromiter(chain.from_iterable(true), np.int32, int(size.sum()))
    if not np.array_equal(np.cumsum(size), ends) or not np.array_equal(flat, ids):
        raise ValueError("the encoder and the sentencepiece library differ")
    if own.library.decode(true, num_threads=1) != decoded:
        raise ValueError("the decoder and the sentencepiece library differ")


def batches_of(lengths: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of texts of about `limit` characters together, or of one text."""
    total, out, i = np.append(0, np.cumsum(lengths + 1)), [], 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, agreed[, ids]), one row per row.

    `model` is the path of a vocabulary file on the driver; it is sent to the
    executors. Every text is encoded whole, with an end id, and decoded again,
    by this module; the sentencepiece library does the same to every batch, and
    a difference is an error (`agreed` is true in every row there is). A null
    text is empty: one id, the end. Equal rows give equal results, an empty
    table no rows; other columns are not read. A batch holds the words of some
    four million characters, or of one longer text.
    """
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches):
        own = pieces(shared.value)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in batches_of(lengths, BATCH_CHARS):
                texts = [t or "" for t in batch["text"].slice(i, j - i).to_pylist()]
                ids, ends, decoded = own.encode_texts(texts)
                check(own, texts, ids, ends, decoded)
                offsets = pa.array(np.append(0, ends), pa.int64())
                shown = pc.binary_join(pa.LargeListArray.from_arrays(offsets, own.number.take(pa.array(ids))), " ")
                out = [batch["id"].slice(i, j - i), pa.array(np.diff(ends, prepend=0), pa.int64()),
                       pa.array([digest(t) for t in shown.to_pylist()]), pa.array([digest(t) for t in decoded]),
                       pa.array([True] * len(texts))]
                out += [pa.ListArray.from_arrays(offsets.cast(pa.int32()), pa.array(ids))] if with_ids else []
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "agreed", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean"
        + (", ids array<int>" if with_ids else ""))
