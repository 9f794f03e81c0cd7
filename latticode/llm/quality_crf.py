"""Quality of documents by a linear-chain conditional random field over lines.

Each line is good or bad. What speaks for either are features of the line and
of its two neighbours, and the label of the line before. The field is fitted on
a bounded sample of labelled documents whose lines take the document's label.
A document's quality is the mean probability of its lines to be good, weighted
by their lengths; the probabilities are forward-backward marginals.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticode.llm.words import byte_hashes, chunks, mix, text_bytes, words

#: Bounds of the sample that the field is fitted on.
SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 400
STEPS = 150
RATE = 0.1
PENALTY = 1e-3
THRESHOLD = 0.3


def _class(characters: str | list[int]) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) if isinstance(c, str) else c for c in characters]] = 1
    return table


_SYMBOL, _SHOUT = _class("#*$%&|<>"), _class("!?")
_UPPER, _LOWER = _class(list(range(65, 91))), _class(list(range(97, 123)))
_DIGIT, _STOP = _class("0123456789"), _class(".,;:")
_TAIL = _class(list(range(128, 192)))  # bytes inside a character
FEATURES = 12


class Lines(NamedTuple):
    first: np.ndarray     # lines of text d are first[d]:first[d + 1], at least one each
    length: np.ndarray    # characters
    features: np.ndarray  # a row per line


def line_features(texts: pa.Array) -> Lines:
    """Features of all lines that hold a word; a text without any has one
    empty line."""
    w = words(texts)
    offsets = text_bytes(texts)[1]
    breaks = np.flatnonzero(w.data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(w.data)]
    line_of = np.searchsorted(begin, w.starts, side="right") - 1
    used, per = np.unique(line_of, return_counts=True)
    low = begin[used]
    high = np.minimum(np.append(begin, len(w.data))[used + 1], len(w.data))
    # lines end before their break; a text's last line at the text's end
    high = high - (w.data[np.maximum(high, 1) - 1] == 10)
    doc = np.searchsorted(offsets, low, side="right") - 1

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[w.data])])
        return (sums[high] - sums[low]).astype(float)

    length = (high - low) - count(_TAIL)
    row = np.repeat(np.arange(len(used)), per)
    again = np.zeros(len(w.hashes))
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    distinct = np.zeros(len(used))
    _, at = np.unique(mix(w.hashes + row.astype(np.uint64)), return_index=True)
    np.add.at(distinct, row[at], 1)
    body = byte_hashes(w.data, low, high)
    _, inverse, times = np.unique(mix(body + doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    letters, upper = count(_UPPER) + count(_LOWER), count(_UPPER)
    long, n = np.maximum(length, 1), np.maximum(per, 1).astype(float)
    features = np.stack([
        count(_SYMBOL) / long, upper / np.maximum(letters, 1), count(_SHOUT) / n, count(_DIGIT) / long,
        count(_STOP) / n, (high - low) / n / 10, np.add.reduceat(again, np.cumsum(per) - per) / n if len(per) else n,
        distinct / n, (times[inverse] > 1).astype(float), np.log1p(length), np.log1p(n), count(_TAIL) / long], axis=1)
    # one empty line for texts that have none
    k = len(offsets) - 1
    lines = np.bincount(doc, minlength=k)
    empty = np.flatnonzero(lines == 0)
    place = np.searchsorted(doc, empty)
    features = np.insert(features.reshape(-1, FEATURES), place, 0, axis=0)
    length = np.insert(length, place, 0)
    return Lines(np.concatenate([[0], np.cumsum(np.maximum(lines, 1))]), length, features)


class Field(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray      # of the inputs, for a good line against a bad one
    transition: np.ndarray   # [before, now], bad is 0 and good is 1


def inputs(lines: Lines, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features of each line and its neighbours, and a constant; beyond
    the ends of a text there are zeros."""
    x = (lines.features - mean) / scale
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[lines.first[:-1]] = 0
    after[lines.first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def marginals(first: np.ndarray, score: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good per line, expected transitions), for all texts at
    once: a step takes one line of every text that still has one."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    node = np.stack([np.zeros(len(score)), score], axis=1)
    alive = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    forward, backward = np.zeros_like(node), np.zeros_like(node)
    for t, n in enumerate(alive):
        at = first[order[:n]] + t
        forward[at] = node[at]
        if t:
            before = forward[at - 1]
            forward[at] += np.logaddexp(before[:, :1] + transition[0], before[:, 1:] + transition[1])
    for t in range(len(alive) - 2, -1, -1):
        at = first[order[:alive[t + 1]]] + t
        after = backward[at + 1] + node[at + 1]
        backward[at] = np.logaddexp(transition[:, 0] + after[:, :1], transition[:, 1] + after[:, 1:])
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(score), bool)
    inner[first[:-1]] = False
    inner = np.flatnonzero(inner)
    pair = (forward[inner - 1][:, :, None] + transition + (node + backward)[inner][:, None, :]
            - np.logaddexp(both[inner][:, 0], both[inner][:, 1])[:, None, None])
    return good, np.exp(np.minimum(pair, 0)).sum(axis=0)


def fit(lines: Lines, label: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """The field that makes the labels of the lines likely, by gradient steps
    with momentum and scaling (Adam) on the mean log-likelihood per line."""
    mean, scale = lines.features.mean(axis=0), lines.features.std(axis=0) + 1e-6
    x, first = inputs(lines, mean, scale), lines.first
    y = np.repeat(label, np.diff(first)).astype(float)
    seen = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
    p = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        good, expected = marginals(first, x @ p[:-4], p[-4:].reshape(2, 2))
        gradient = np.concatenate([x.T @ (y - good), (seen - expected).reshape(-1)]) / max(len(y), 1) - penalty * p
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        p = p + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Field(mean, scale, p[:-4], p[-4:].reshape(2, 2))


def quality(lines: Lines, field: Field) -> np.ndarray:
    """Mean probability of good lines of each text, weighted by length."""
    if len(lines.first) < 2:
        return np.zeros(0)
    good, _ = marginals(lines.first, inputs(lines, field.mean, field.scale) @ field.weights, field.transition)
    weight = lines.length + 1
    return np.add.reduceat(good * weight, lines.first[:-1]) / np.add.reduceat(weight, lines.first[:-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          documents: int = SAMPLE_DOCUMENTS, most_lines: int = SAMPLE_LINES, **options) -> Field:
    """The field for `labels` (id, good): fitted on at most `documents` labelled
    rows of at most `most_lines` lines, chosen by a hash of the id, one row per id.

    Features are made by the tasks; what the driver collects and fits has that
    bound. Rows without text or label are left out. Without any label every
    document has quality 0.5.
    """
    chosen = labels.where("id is not null and good is not null").select(
        F.col("id").alias("__id"), F.col("good").cast("int").alias("good")).orderBy(
        F.xxhash64("__id"), "__id").limit(documents)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(
        F.broadcast(chosen), F.col("id") == F.col("__id")).select("__id", "text", "good").dropDuplicates(["__id"])

    def features(batches):
        for batch in batches:
            lines = line_features(batch["text"])
            ok = np.flatnonzero(np.diff(lines.first) <= most_lines)
            rows = [(lines.features[a:b].astype(np.float32).tobytes(), lines.length[a:b].astype(np.int64).tobytes())
                    for a, b in zip(lines.first[ok], lines.first[ok + 1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                 batch["good"].take(pa.array(ok)), batch["__id"].take(pa.array(ok))],
                ["features", "length", "good", "id"])

    kind = chosen.schema["__id"].dataType.simpleString()
    got = sample.mapInArrow(features, f"features binary, length binary, good int, id {kind}").toArrow().sort_by("id")
    each = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["features"].to_pylist()]
    if not each:
        return Field(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(3 * FEATURES + 1), np.zeros((2, 2)))
    length = np.concatenate([np.frombuffer(b, np.int64) for b in got["length"].to_pylist()])
    first = np.concatenate([[0], np.cumsum([len(e) for e in each])])
    return fit(Lines(first, length, np.concatenate(each).astype(float)), got["good"].to_numpy(), **options)


def with_quality(docs: DataFrame, field: Field, text_col: str = "text", name: str = "quality") -> DataFrame:
    """The documents with one more column, their quality from 0 to 1.

    Whole texts are read. A null or blank text is one empty line; equal texts
    get equal values; an empty table stays empty. A column that has the name
    already is replaced.
    """
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(name, F.lit(0.0)).schema

    def score(batches):
        for batch in batches:
            texts = batch[text_col]
            parts = [quality(line_features(texts[i:j]), field) for i, j in chunks(text_bytes(texts)[1])]
            value = pa.array(np.concatenate([np.zeros(0), *parts]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], value], [*kept, name])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(score, schema)
