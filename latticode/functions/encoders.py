"""Text encoders. An encoder maps a text column to an `array<float>` column.

Encoders are costly, so they are declared nondeterministic: Spark then never
computes one twice, which it may do to filter on its result early.
"""

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from latticode.functions import kernels as k

Encoder = Callable[[Column], Column]


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int,
                  batch_size: int = 128) -> Encoder:
    """Encoder around a model: `load()` runs once per task and returns a
    function from a list of texts to an (n, dim) matrix. Null texts stay null.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()

        def vectors(texts: pa.Array) -> pa.Array:
            parts = [np.asarray(model(texts.slice(at, batch_size).to_pylist()), dtype=np.float32)
                     for at in range(0, len(texts), batch_size)]
            rows = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)
            if rows.shape != (len(texts), dim):
                raise ValueError(f"the model returned {rows.shape}, expected {(len(texts), dim)}")
            return k.matrix_list(rows, pa.float32())

        for texts in batches:
            yield k.over_valid(texts, vectors)

    return F.arrow_udf(encode, ArrayType(FloatType())).asNondeterministic()


def _token_hash(token: str) -> int:
    """The first 20 bits of the md5: 16 for the bucket, the last one for the sign."""
    return int(md5(token.encode()).hexdigest()[:5], 16)


def hashed_encoder(dim: int = 64) -> Encoder:
    """Signed hashed bag of words of length one. A stand-in for a model: it
    needs no weights and gives the same vectors everywhere.

    Words are split by Arrow; only the distinct words of a batch are hashed.
    """

    @F.arrow_udf(ArrayType(FloatType()))
    def bag(col: pa.Array) -> pa.Array:
        def vectors(texts: pa.Array) -> pa.Array:
            words = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+")
            row = pc.list_parent_indices(words).to_numpy()
            coded = words.flatten().dictionary_encode()
            vocabulary = coded.dictionary.to_pylist()
            hashes = np.array([_token_hash(w) for w in vocabulary], dtype=np.int64)
            weights = np.where(hashes & 1, -1.0, 1.0) * np.array([w != "" for w in vocabulary], dtype=float)
            word = coded.indices.to_numpy()
            cell = row * dim + (hashes >> 4)[word] % dim
            bags = np.bincount(cell, weights=weights[word], minlength=len(texts) * dim).astype(np.float64)
            return k.matrix_list(k.normalize(bags.reshape(-1, dim)), pa.float32())

        return k.over_valid(col, vectors)

    return bag.asNondeterministic()
