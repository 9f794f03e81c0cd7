"""Near duplicates by a prefix-tree join of shingle sets.

All documents order their shingles alike, rare ones first by counts over the
corpus. Sets that reach the threshold share one of their first shingles, so
those first shingles that two sets have join documents to groups that hold
every link. Inside a group the sets, in one order again, are stored in a trie.
A document goes down the trie level by level: the overlap with a common
beginning is counted once for all sets below, and a subtree is left when what
remains of either set cannot reach the threshold, or when all of it is linked
with the document already. Large groups are cut into pieces, and every pair of
pieces is joined on its own.
"""

from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticode.llm import blocks
from latticode.llm.components import components
from latticode.llm.tables import written
from latticode.llm.words import Words, chunks, mix, run_hashes, text_bytes, words

#: Counters per byte of text behind the common order: many more than shingles,
#: so few share one. Results do not depend on them, only the groups' sizes do.
COUNTERS_PER_BYTE = 5
#: Levels of a trie on which subtrees are left out before the rest is counted.
LEVELS = 6
#: Most sets of a group that one task compares; larger groups are cut.
PIECE = 2048
#: Parts of a block's rows that get their classes on their own.
SHARES = 32


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words; a text with
    fewer words has its whole sequence, one without words nothing."""
    count = np.diff(w.first)
    size = np.where(count >= n, n, count)
    runs = np.where(count > 0, count - size + 1, 0)
    ends_before = np.cumsum(runs) - runs
    starts = np.repeat(w.first[:-1] - ends_before, runs) + np.arange(int(runs.sum()))
    hashes = run_hashes(w.hashes, starts, starts + np.repeat(size, runs))
    return [np.unique(hashes[a:a + k]) for a, k in zip(ends_before, runs)]


def _sets(table, n: int):
    texts = table["text"]
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    for i, j in chunks(text_bytes(texts)[1]):
        yield from shingle_sets(words(texts[i:j], lower=True), n)


def digest(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def needed(x, y, percent: int):
    """Least intersection of sets of sizes x and y that are linked."""
    return -(-percent * (x + y) // (100 + percent))


def first_shingles(n: int, percent: int) -> int:
    """How many of n ordered shingles a linked set must meet one of."""
    return n - -(-percent * n // 100) + 1


class Trie(NamedTuple):
    """Compressed trie of sorted sequences. Edges are numbered so that those
    below an edge follow it; their labels and the sets below are ranges too."""
    tokens: np.ndarray   # the labels of all edges, one after another
    begin: np.ndarray    # label of edge e: tokens[begin[e]:begin[e + 1]]
    depth: np.ndarray    # tokens from the root to the end of e
    end: np.ndarray      # edges below e: e + 1 to end[e]
    low: np.ndarray      # sets below e: low[e]:high[e], in the order of the trie
    high: np.ndarray
    least: np.ndarray    # smallest and largest set below
    most: np.ndarray
    top: list[tuple[np.ndarray, np.ndarray]]  # edges of the first levels, and the place of each one's parent


def _branches(sets: list[np.ndarray], low: int, high: int, depth: int) -> list[tuple[int, int, int, int]]:
    """Edges (low, high, depth, end of the label) of sets that share `depth` tokens."""
    out = []
    if len(sets[low]) == depth:                      # it ends here: an edge without a label
        out.append((low, low + 1, depth, depth))
        low += 1
    heads = np.array([sets[k][depth] for k in range(low, high)])
    cuts = [low, *(low + 1 + np.flatnonzero(heads[1:] != heads[:-1])).tolist(), high] if low < high else []
    for a, b in zip(cuts, cuts[1:]):
        one, two = sets[a][depth:], sets[b - 1][depth:]
        most = min(len(one), len(two))
        apart = np.flatnonzero(one[:most] != two[:most])
        out.append((a, b, depth, depth + (int(apart[0]) if len(apart) else most)))
    return out


def build_trie(sets: list[np.ndarray]) -> Trie:
    """The trie of distinct sets that are sorted as sequences."""
    size = np.array([len(s) for s in sets])
    rows, parent, stack = [], [], [(edge, -1) for edge in reversed(_branches(sets, 0, len(sets), 0))]
    while stack:
        edge, above = stack.pop()
        low, high, _, stop = edge
        rows.append(edge)
        parent.append(above)
        if high - low > 1:
            stack += [(e, len(rows) - 1) for e in reversed(_branches(sets, low, high, stop))]
    low, high, start, depth = (np.array(c, np.int64) for c in zip(*rows))
    below, level = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for e in range(len(rows) - 1, -1, -1):
        if parent[e] >= 0:
            below[parent[e]] += below[e]
    for e, above in enumerate(parent):
        level[e] = level[above] + 1 if above >= 0 else 0
    top, place = [], np.zeros(len(rows), np.int64)
    for k in range(LEVELS):
        edges = np.flatnonzero(level == k)
        top.append((edges, place[np.array(parent)[edges]]))
        place[edges] = np.arange(len(edges))
    return Trie(np.concatenate([sets[a][b:c] for a, b, c in zip(low, start, depth)]),
                np.concatenate([[0], np.cumsum(depth - start)]), depth, np.arange(len(rows)) + below, low, high,
                np.array([size[a:b].min() for a, b in zip(low, high)]),
                np.array([size[a:b].max() for a, b in zip(low, high)]), top)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start, `size` numbers each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _overlaps(trie: Trie, edges: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Tokens of each edge's label that are inside."""
    size = trie.begin[edges + 1] - trie.begin[edges]
    hits = np.concatenate([[0], np.cumsum(inside[trie.tokens[_ranges(trie.begin[edges], size)]])])
    ends = np.cumsum(size)
    return hits[ends] - hits[ends - size]


def probe(trie: Trie, x: np.ndarray, inside: np.ndarray, percent: int, done: np.ndarray) -> np.ndarray:
    """Sets of the trie linked with x, in trie order.

    `inside` marks the tokens of x; `done` counts, up to each set, how many
    need no look. On the first levels subtrees are left by what remains of x
    and of the sets below. What is left is counted at once: the overlap of a
    path is the sum over edges begun before its end without those closed.
    """
    found, alive, carried = [], np.ones(1, bool), np.zeros(1, np.int64)
    for k, (edges, above) in enumerate(trie.top):
        go = alive[above] if k else np.ones(len(edges), bool)
        go &= done[trie.high[edges]] - done[trie.low[edges]] < trie.high[edges] - trie.low[edges]
        at = np.flatnonzero(go)
        edges_, overlap = edges[at], _overlaps(trie, edges[at], inside) + (carried[above[at]] if k else 0)
        last = trie.tokens[np.maximum(trie.begin[edges_ + 1] - 1, 0)]
        label = trie.begin[edges_ + 1] > trie.begin[edges_]
        rest = np.where(label, len(x) - np.searchsorted(x, last, side="right"), len(x))
        bound = overlap + np.minimum(rest, trie.most[edges_] - trie.depth[edges_])
        keep = bound >= needed(len(x), trie.least[edges_], percent)
        leaf = trie.end[edges_] == edges_ + 1
        found.append(trie.low[edges_[leaf & (overlap >= needed(len(x), trie.most[edges_], percent))]])
        alive, carried = np.zeros(len(edges), bool), np.zeros(len(edges), np.int64)
        alive[at] = keep & ~leaf
        carried[at] = overlap
        if not alive.any():
            return np.concatenate(found)
    first = trie.top[-1][0][alive]
    below = trie.end[first] - first - 1
    edges = _ranges(first + 1, below)
    own, n = _overlaps(trie, edges, inside), len(edges)
    closed = np.bincount(np.arange(n) + trie.end[edges] - edges, own, n + 1)[:n]
    overlap = np.cumsum(own) - np.cumsum(closed).astype(np.int64) + np.repeat(carried[alive], below)
    leaf = trie.end[edges] == edges + 1
    found.append(trie.low[edges[leaf & (overlap >= needed(len(x), trie.most[edges], percent))]])
    return np.concatenate(found)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join all linked sets, as pairs of numbers (left sets first).

    With `right` None the left sets are compared with each other, else with the
    right ones. Shingles that many of these sets have come first, so that the
    trie holds common parts once. A pair that earlier links connect already is
    not looked at.
    """
    raw = [*left, *(right or [])]
    every, count = np.unique(np.concatenate(raw), return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -count))] = np.arange(len(every))
    sets = [np.sort(rank[np.searchsorted(every, s)]) for s in raw]
    stored = range(len(left), len(sets)) if right is not None else range(len(sets))
    order = np.array(sorted(stored, key=lambda k: sets[k].tolist()))
    trie = build_trie([sets[k] for k in order])
    label, inside, pairs = np.arange(len(sets)), np.zeros(len(every), bool), []
    for k in range(len(left)):
        done = np.concatenate([[0], np.cumsum(label[order] == label[k])])
        if done[-1] == len(order):
            continue
        inside[sets[k]] = True
        for y in order[probe(trie, sets[k], inside, percent, done)]:
            if label[y] != label[k]:
                pairs.append((k, int(y)))
                label[label == label[y]] = label[k]
        inside[sets[k]] = False
    return pairs


class _Forest:
    """Union-find of small numbers; keeps the pairs that joined something."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _joined(token: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the nodes that share a token."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    same = np.flatnonzero((token[1:] == token[:-1]) & (node[1:] != node[:-1]))
    nodes, at = np.unique(node, return_inverse=True)
    pairs, forest = np.unique(np.stack([at[same], at[same + 1]]), axis=1), _Forest(len(nodes))
    for a, b in pairs.T.tolist():
        forest.join(a, b)
    roots = np.array([forest.find(k) for k in range(len(nodes))], np.int64)
    away = np.flatnonzero(roots != np.arange(len(nodes)))
    return list(zip(nodes[roots[away]].tolist(), nodes[away].tolist()))


EDGES = "u long, v long"
#: Senders of letters that are no shards.
SETS, ORDERS = -1, -2


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def signatures(texts: DataFrame, n: int) -> DataFrame:
    """(block, id, mark, size, digest) of every row."""
    def run(batches):
        for batch in batches:
            sets = [(len(s), digest(s)) for s in _sets(batch, n)]
            yield pa.RecordBatch.from_arrays(
                [batch["block"], batch["id"], batch["mark"], pa.array([k for k, _ in sets], pa.int64()),
                 pa.array([d for _, d in sets], pa.binary())], ["block", "id", "mark", "size", "digest"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"block long, id {kind}, mark long, size long, digest binary")


def _small(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type but 64 bits that holds it."""
    kinds = (k for k in (np.uint8, np.uint16, np.uint32) if a.max(initial=0) <= np.iinfo(k).max)
    return a.astype(next(kinds, np.int64))


def _counters(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted counters of the sets' shingles, how often each is met)."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - bits), return_counts=True)


def _cuts(counters: np.ndarray, bits: int, shards: int) -> np.ndarray:
    return blocks.owner_cuts(counters << np.uint64(64 - bits), shards)


def add_counts(shard: int, table: pa.Table) -> list[tuple[int, int, bytes]]:
    """To each block the places of its counters that others have too, with the
    counts of all blocks."""
    sender, parts = np.sort(table["sender"].to_numpy(), kind="stable"), blocks.bodies(table)
    keys = [np.cumsum(p[0].astype(np.int64)) for p in parts]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate([p[1] for p in parts]).astype(np.int64)
    total = np.bincount(at, own, len(every)).astype(np.int64)[at]
    out, begin = [], 0
    for b, k in zip(sender, keys):
        here = slice(begin, begin + len(k))
        more = np.flatnonzero(total[here] > own[here])
        if len(more):
            out.append((int(b), shard, blocks.pack(_small(np.diff(more, prepend=0)), _small(total[here][more]))))
        begin += len(k)
    return out


def _own(table: pa.Table, letters: pa.Table, n: int) -> dict[bytes, np.ndarray]:
    """The sets that the block keeps, in the order of their digests."""
    bodies = [b for b, sender in zip(letters["body"].to_pylist(), letters["sender"].to_pylist()) if sender == SETS]
    wanted = {body[i:i + 16] for body in bodies for i in range(0, len(body), 16)}
    found = {}
    for s in _sets(table, n):
        d = digest(s)
        if d in wanted:
            found[d] = s
    return dict(sorted(found.items()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
                    counters_per_byte: float = COUNTERS_PER_BYTE, piece: int = PIECE,
                    block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, text_hash), one row per row.

    A row's set holds the distinct runs of n words, A-Z lower-cased; a shorter
    text has its whole sequence, and a null or blank text has none and is
    linked with nothing. Rows are linked if 100 * intersection >= percent *
    union; `component_id` is the smallest id that links reach, null only if no
    id among them is known. Rows with equal sets count as one from the start,
    so copies and equal rows cost little. An empty table gives no rows; other
    columns are not read. Shingles are told apart by 64-bit hashes, sets by
    128 bits.
    """
    texts, n_blocks = blocks.blocked(docs, id_col, text_col, block_bytes, mark=F.xxhash64(text_col))
    bits = max(1, int(n_blocks * block_bytes * counters_per_byte).bit_length())
    rows = written(signatures(texts, n), "signatures")
    best = rows.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct(F.isnull("id").alias("no_id"), "id", "block")).alias("best"))
    sets = written(best.select("digest", "best.block", "best.id"), "sets")
    mine = sets.groupBy("block").agg(F.array_join(F.sort_array(F.collect_list(F.hex("digest"))), "").alias("all"))
    letters = written(mine.select(F.col("block").alias("to"), F.lit(SETS).cast("long").alias("sender"),
                                  F.unhex("all").alias("body")), "representatives")

    def count(block: int, table: pa.Table, wanted: pa.Table) -> list:
        keys, local = _counters(list(_own(table, wanted, n).values()), bits)
        cuts = _cuts(keys, bits, n_blocks)
        return [(int(s), block, blocks.pack(_small(np.diff(keys[cuts[s]:cuts[s + 1]].astype(np.int64), prepend=0)),
                                            _small(local[cuts[s]:cuts[s + 1]]))) for s in np.flatnonzero(np.diff(cuts))]

    counted = letters.union(blocks.answer(blocks.ask(texts, count, letters), add_counts))

    def question(block: int, table: pa.Table, mail: pa.Table) -> list:
        own = list(_own(table, mail, n).values())
        keys, total = _counters(own, bits)
        cuts, total = _cuts(keys, bits, n_blocks), total.copy()
        for sender, body in zip(mail["sender"].to_pylist(), mail["body"].to_pylist()):
            if sender >= 0:
                place, counts = blocks.unpack(body)
                total[cuts[sender] + np.cumsum(place.astype(np.int64))] = counts
        token, node = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, s in enumerate(own):
            often = total[np.searchsorted(keys, s >> np.uint64(64 - bits))]
            head = np.lexsort((s, often))[:first_shingles(len(s), percent)]
            head = s[head[often[head] > 1]]  # one that is met once links nothing
            token.append(head)
            node.append(np.full(len(head), (block << 24) + k))
        token, node = np.concatenate(token), np.concatenate(node)
        edges = _joined(token, node)
        heads, at = np.unique(token, return_index=True)
        inside = [(-1, block, blocks.pack(np.array(edges, np.int64).reshape(-1)))] if edges else []
        return [*inside, *blocks.mail(heads, n_blocks, block, node[at])]

    asked = blocks.ask(texts, question, counted)

    def share(key: tuple, table: pa.Table) -> pa.Table:
        parts = blocks.bodies(table)
        if key[0].as_py() < 0:
            pairs = np.concatenate([p[0] for p in parts]).reshape(-1, 2).tolist()
        else:
            pairs = _joined(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return _table(pairs, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    # edges inside blocks are dealt by block, those of shards by shard
    dealt = asked.withColumn("turn", F.when(F.col("to") < 0, F.col("sender")))
    groups = components(dealt.groupBy("to", "turn").applyInArrow(share, EDGES))

    # members of a group and the pairs of pieces of it that they are compared in
    size = groups.groupBy("root").agg(F.count("*").alias("members"))
    cut = F.ceil(F.col("members") / piece).cast("int")
    member = groups.join(size, "root").select(
        "node", "root", cut.alias("cut"), F.pmod(F.xxhash64("node"), cut).cast("int").alias("part"))
    job = F.when(F.col("cut") == 1, F.pmod(F.xxhash64("root"), F.lit(n_blocks))).otherwise(
        F.xxhash64("root", "low", "high"))
    sent = member.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).select(
        F.shiftright("node", 24).alias("to"), "node", "root", F.least("part", "with").alias("low"),
        F.greatest("part", "with").alias("high"), "part", "cut").withColumn("job", job)
    columns = ["node", "root", "low", "high", "part", "job"]

    def order(key: tuple, table: pa.Table) -> pa.Table:
        return blocks.letters([(key[0].as_py(), ORDERS, blocks.pack(*[table[c].to_numpy() for c in columns]))])

    mailbox = letters.union(sent.select("to", *columns).groupBy("to").applyInArrow(order, blocks.MAIL))

    def ship(key: tuple, table: pa.Table, mail: pa.Table) -> pa.Table:
        orders = [b for b, sender in zip(mail["body"].to_pylist(), mail["sender"].to_pylist()) if sender == ORDERS]
        own = list(_own(table, mail, n).items()) if orders else []
        node, root, low, high, part, job = blocks.unpack(orders[0]) if orders else [np.zeros(0, np.int64)] * 6
        at = (node & ((1 << 24) - 1)).tolist()
        return _table(list(zip(job.tolist(), root.tolist(), low.tolist(), high.tolist(), part.tolist(),
                               [own[k][0] for k in at], [own[k][1].tobytes() for k in at])), shipped)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        kept = {c: table[c].to_numpy() for c in ("root", "low", "high", "part")}
        names, found = table["digest"].to_pylist(), []
        order = np.lexsort((kept["high"], kept["low"], kept["root"]))
        where = np.stack([kept[c][order] for c in ("root", "low", "high")])
        cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:]):
            rows_of, own = order[a:b], where[1, a] == where[2, a]
            left = rows_of if own else rows_of[kept["part"][rows_of] == where[1, a]]
            right = rows_of[:0] if own else rows_of[kept["part"][rows_of] == where[2, a]]
            sets_of = lambda at: [np.frombuffer(table["shingles"][int(k)].as_py(), np.uint64) for k in at]
            both = [names[k] for k in [*left, *right]]
            if len(left) and (own or len(right)):
                pairs = linked_pairs(sets_of(left), None if own else sets_of(right), percent)
                found += [(both[x], both[y]) for x, y in pairs]
        return _table(found, pa.schema([("u", pa.binary()), ("v", pa.binary())]))

    shipped = pa.schema([("job", pa.int64()), ("root", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                         ("part", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary())])
    sent_sets = texts.groupBy("block").cogroup(mailbox.groupBy("to")).applyInArrow(
        ship, "job long, root long, low long, high long, part long, digest binary, shingles binary")
    links = components(sent_sets.groupBy("job").applyInArrow(compare, "u binary, v binary"))

    # the smallest id of every class of sets, and of their rows
    smallest = F.min(F.struct(F.isnull("id").alias("no_id"), "id"))["id"]
    classed = sets.join(links.withColumnRenamed("node", "digest"), "digest")
    lowest = classed.groupBy("root").agg(smallest.alias("component_id"))
    linked = classed.join(lowest, "root").select("digest", F.col("component_id").alias("linked_id"))
    every = sets.join(linked, "digest", "left").select(
        "digest", F.when(F.col("linked_id").isNotNull(), F.col("linked_id")).otherwise(F.col("id")).alias("class_id"))
    # rows of one set are many in places: each block asks once per set and share
    share_of = F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")
    known = rows.where("digest is not null").withColumn("share", share_of)
    asking = known.select("block", "share", "digest").distinct().join(every, "digest")
    return known.join(asking, ["block", "share", "digest"]).select(
        "id", F.col("size").alias("n_shingles"), F.col("class_id").alias("component_id"),
        F.col("mark").alias("text_hash")).union(rows.where("digest is null").select(
            "id", F.col("size"), F.col("id"), F.col("mark")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that are the smallest of their group, with all their columns.

    Rows without shingles and rows without an id stay. Rows that share the id
    and the words of the one that stays stay with it.
    """
    groups = near_duplicates(docs, id_col, text_col, **options)
    gone = written(groups.where("component_id <> id").select(
        F.col("id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct(), "near-copies")
    same = (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__hash"])
    return docs.join(gone, same, "left_anti")
