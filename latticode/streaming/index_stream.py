"""Appending to an index from a stream of embeddings."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from latticode.operators.index import build_index
from latticode.sources.tables import INDEX_KEYS


def read_embeddings_stream(spark: SparkSession, folder: str, schema: str | StructType, *,
                           pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive; a cap on files keeps a first
    batch small."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_pattern(path: str) -> str:
    """A pattern that matches `path` alone. Spark streams the files of a plain
    path only if it is a folder, those of a pattern also if it is one file."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return f"{folder}{slash}{{{name}}}"


def append_index(stream: DataFrame, codebook: DataFrame | Sequence[float], path: str, checkpoint: str,
                 dim: int, n_bits: int = 4, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start a query that adds the index rows of every new embedding to `path`.

    A row's code depends on the row and the codebook only, so there is no state
    and no watermark, and appending is the same as building at once. `dim` is
    given because a stream cannot be peeked at. The file sink's log makes every
    batch count once after a restart.
    """
    index = build_index(stream, codebook, n_bits, dim=dim, **options)
    return (index.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy(*INDEX_KEYS).trigger(**(trigger or {"availableNow": True})).start())
