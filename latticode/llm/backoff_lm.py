"""Scoring by a weighted backoff automaton learned from the corpus.

Counts of all n-grams of the training documents are added up in shards. Every
block of documents gets back the counts of the n-grams it contains and builds
its part of the automaton: an n-gram that training has is a state, an arc on a
word leads to the longest known history, and a failure arc to the shorter one.
Each document is then read once from left to right; its state is carried along
and the weights of the arcs are added.

Smoothing: p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu), where h' is h
without its first word. The shortest level is (c(w) + 0.5) / (N + 0.5 (V + 1)).
Written as arcs, the weight of a seen n-gram is p, and that of a failure arc is
mu / (c(h) + mu), so the probabilities of a state add up to one.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticode.llm import blocks
from latticode.llm.tables import written
from latticode.llm.words import chunks, mix, text_bytes, words

ORDER = 2
MU = 300.0
START, END = mix(np.array([0x53544152, 0x454E44], np.uint64))


class Grams(NamedTuple):
    keys: np.ndarray    # sorted distinct hashes
    level: np.ndarray   # number of tokens
    count: np.ndarray   # occurrences in training documents of the block
    last: np.ndarray    # hash of the last token
    suffix: np.ndarray  # hash without the first token; 0 for one token
    history: np.ndarray  # hash without the last token; 0 for one token


class Tokens(NamedTuple):
    hashes: np.ndarray
    first: np.ndarray  # tokens of document d are first[d]:first[d + 1], a start and an end among them
    place: np.ndarray  # place of each token in its document


def tokens(table: pa.Table) -> Tokens:
    """A start, the lower-cased words of the text and an end, for every text."""
    texts, parts, sizes = table["text"].combine_chunks(), [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in chunks(text_bytes(texts)[1]):
        w = words(texts[i:j], lower=True)
        size = np.diff(w.first) + 2
        first = np.cumsum(size) - size
        row = np.full(int(size.sum()), END)
        row[first] = START
        text = np.repeat(np.arange(j - i), np.diff(w.first))
        row[np.arange(len(w.hashes)) + 2 * text + 1] = w.hashes
        parts.append(row)
        sizes.append(size)
    first = np.cumsum(np.concatenate(sizes))
    hashes = np.concatenate(parts)
    return Tokens(hashes, first, np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first)))


def grams(t: Tokens, train: np.ndarray, order: int) -> Grams:
    """Distinct n-grams of up to `order` tokens inside the documents."""
    learn = np.repeat(train.astype(np.uint32), np.diff(t.first))
    gram, none = t.hashes, np.zeros(len(t.hashes), np.uint64)
    found = [(gram, np.ones(len(gram), np.uint8), learn, t.hashes, none, none)]
    for level in range(2, order + 1):
        at = np.flatnonzero(t.place >= level - 1)
        longer = np.zeros(len(gram), np.uint64)
        longer[at] = mix(gram[at - 1] * np.uint64(0x9E3779B97F4A7C15) + t.hashes[at] + np.uint64(level))
        found.append((longer[at], np.full(len(at), level, np.uint8), learn[at], t.hashes[at], gram[at], gram[at - 1]))
        gram = longer
    columns = [np.concatenate(c) for c in zip(*found)]
    keys, at, inverse = np.unique(columns[0], return_index=True, return_inverse=True)
    count = np.bincount(inverse, columns[2], len(keys)).astype(np.uint32)
    return Grams(keys, columns[1][at], count, *[c[at] for c in columns[3:]])


class Automaton(NamedTuple):
    """Arcs sorted by (state, token); state 0 has no history."""
    vocabulary: np.ndarray   # sorted token hashes
    arcs: np.ndarray         # state * len(vocabulary) + token
    weight: np.ndarray
    target: np.ndarray
    fail_weight: np.ndarray  # per state
    fail_target: np.ndarray
    start: int


def automaton(g: Grams, count: np.ndarray, total: int, distinct: int, order: int, mu: float) -> Automaton:
    """The part of the model that the block's n-grams reach, in log10."""
    where = lambda keys: np.minimum(np.searchsorted(g.keys, keys), len(g.keys) - 1)
    suffix, history = where(g.suffix), where(g.history)
    p = (count + 0.5) / (total + 0.5 * (distinct + 1))
    for level in range(2, order + 1):
        at = np.flatnonzero(g.level == level)
        p[at] = (count[at] + mu * p[suffix[at]]) / (count[history[at]] + mu)
    known = (count > 0) & (g.level < order) & (g.last != END)
    state = np.zeros(len(g.keys), np.int64)
    state[known] = np.arange(1, known.sum() + 1)
    vocabulary = np.unique(g.last)
    token = np.searchsorted(vocabulary, g.last)
    arc = np.flatnonzero((g.level == 1) | (count > 0))
    before = np.where(g.level[arc] == 1, 0, state[history[arc]])
    after = np.where(g.level[arc] < order, state[arc], state[suffix[arc]])
    key = before * len(vocabulary) + token[arc]
    by_key = np.argsort(key)
    fail_weight, fail_target = np.zeros(known.sum() + 1), np.zeros(known.sum() + 1, np.int64)
    fail_weight[1:] = np.log10(mu / (count[known] + mu))
    fail_target[1:] = np.where(g.level[known] == 1, 0, state[suffix[known]])
    return Automaton(vocabulary, key[by_key], np.log10(p[arc])[by_key], after[by_key], fail_weight, fail_target,
                     int(state[where(START)]))


def traverse(a: Automaton, t: Tokens) -> np.ndarray:
    """Log10 probability of every document: all are read at once, a token each
    step, and those that have ended drop out. A document carries its state;
    where it has no arc on the token, failure arcs are followed to one that has."""
    size = np.diff(t.first) - 1                      # without the start
    score, order = np.zeros(len(size)), np.argsort(-size, kind="stable")
    state, k = np.full(len(size), a.start), len(a.vocabulary)
    token = np.searchsorted(a.vocabulary, t.hashes)
    alive = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    for step, n in enumerate(alive):
        docs = order[:n]
        seen, now, gained = token[t.first[docs] + 1 + step], state[docs], np.zeros(n)
        left = np.arange(n)
        while len(left):
            key = now[left] * k + seen[left]
            at = np.minimum(np.searchsorted(a.arcs, key), len(a.arcs) - 1)
            hit = a.arcs[at] == key
            gained[left[hit]] += a.weight[at[hit]]
            now[left[hit]] = a.target[at[hit]]
            left = left[~hit]
            gained[left] += a.fail_weight[now[left]]
            now[left] = a.fail_target[now[left]]
        score[docs] += gained
        state[docs] = now
    return score


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                    order: int = ORDER, mu: float = MU, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score), a row per row.

    `train` says which rows the model learns from; null means no. Scores are
    log10 probabilities of whole documents, their end included; `base_score`
    is that of the shortest level alone, and `n_known` counts tokens that
    training has. A null text is empty: one token, its end. Equal rows count
    each. Without training documents every token is unknown. An empty table
    gives no rows; other columns are not read.
    """
    texts, n = blocks.blocked(docs, id_col, text_col, block_bytes, train=F.coalesce(train, F.lit(False)))

    def block_grams(table: pa.Table) -> tuple[Tokens, Grams]:
        t = tokens(table)
        return t, grams(t, table["train"].to_numpy(), order)

    def question(block: int, table: pa.Table) -> list:
        g = block_grams(table)[1]
        return list(blocks.mail(g.keys, n, block, g.count, ((g.level == 1) & (g.keys != START)).astype(np.uint8)))

    def add_up(shard: int, table: pa.Table) -> list:
        parts, sender = blocks.bodies(table), np.sort(table["sender"].to_numpy(), kind="stable")
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys))
        word = np.zeros(len(keys), bool)
        word[inverse] = np.concatenate([p[2] for p in parts]) == 1
        summary = np.array([count[word].sum(), (count[word] > 0).sum()], np.int64)
        ends = np.cumsum([len(p[0]) for p in parts])
        replies = [(int(b), shard, blocks.pack(count[inverse[e - len(p[0]):e]].astype(np.uint32)))
                   for b, p, e in zip(sender, parts, ends)]
        return [(-1, shard, blocks.pack(summary)), *replies]

    replies = written(blocks.answer(blocks.ask(texts, question), add_up), "ngram-counts")

    def summaries(batches):
        for batch in batches:
            total = sum((blocks.unpack(b)[0] for b in batch["body"].to_pylist()), np.zeros(2, np.int64))
            yield pa.RecordBatch.from_pydict({"tokens": [int(total[0])], "words": [int(total[1])]})

    total, distinct = replies.where("to = -1").mapInArrow(summaries, "tokens long, words long").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def result(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        t, g = block_grams(table)
        count = np.concatenate([np.zeros(0, np.uint32), *[p[0] for p in blocks.bodies(answers)]]).astype(np.int64)
        size = np.diff(t.first) - 1
        score, base, known = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), np.int64)
        if len(size):
            a = automaton(g, count, total, distinct, order, mu)
            score = traverse(a, t)
            each = count[np.searchsorted(g.keys, t.hashes)]
            starts = t.place == 0
            logs = np.where(starts, 0, np.log10(each + 0.5) - np.log10(total + 0.5 * (distinct + 1)))
            base = np.add.reduceat(logs, t.first[:-1])
            known = np.add.reduceat(((each > 0) & ~starts).astype(np.int64), t.first[:-1])
        return pa.table({"id": table["id"], "train": table["train"], "n_tokens": size, "n_known": known,
                         "train_tokens": np.full(len(size), total, np.int64), "base_score": base, "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    return blocks.finish(texts, replies, result, f"id {kind}, train boolean, n_tokens long, n_known long, "
                         "train_tokens long, base_score double, score double")
