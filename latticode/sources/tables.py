"""Parquet tables: fixed schemas, file layout, names and profiles."""

import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAPERS_SCHEMA = "id string, title string, abstract string, authors string"
EMBEDDINGS_SCHEMA = "id string, content string, embedding array<float>"


@lru_cache(maxsize=None)
def _local_folder(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="latticode-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the folder all executors share (`spark.checkpoint.dir`).

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}"


def new_shared_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to a new shared folder and read back: this cuts the
    lineage, survives lost executors, and tells Spark the table's size."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_papers(spark: SparkSession, path: str, schema: str = PAPERS_SCHEMA) -> DataFrame:
    """NDJSON papers with a fixed schema, so no pass is spent on inferring it."""
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; a missing path is Spark's own PATH_NOT_FOUND error."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def conform(df: DataFrame, schema: str | StructType) -> DataFrame:
    """Columns of the schema in its order, cast to its types."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def write_table(df: DataFrame, path: str, *, schema: str | StructType | None = None,
                mode: str = "errorifexists", partition_by: list[str] | None = None,
                rows_per_file: int | None = None, files: str | int = "as_is") -> None:
    """Parquet sink.

    `files` "as_is" writes a file per task. A number joins input splits to that
    many tasks without a shuffle, for jobs whose output is much smaller than
    their input. "rebalance" evens out small or skewed output with one shuffle
    whose sizes Spark picks at run time. `rows_per_file` bounds files from above.
    """
    if schema is not None:
        df = conform(df, schema)
    if isinstance(files, int):
        df = df.coalesce(files)
    elif files == "rebalance":
        df = df.hint("rebalance")
    elif files != "as_is":
        raise ValueError("files must be 'as_is', 'rebalance' or a number")
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_sorted(df: DataFrame, path: str, key: str, mode: str = "errorifexists",
                 partitions: int | None = None) -> None:
    """Parquet laid out in key order with a bloom filter on the key, so that a
    lookup of a few keys skips the row groups that cannot hold them."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    (ranged.sortWithinPartitions(key).write.mode(mode)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path))


def profile(df: DataFrame) -> DataFrame:
    """(position, column, type, rows): the schema next to the row count."""
    fields = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                       F.lit(f.dataType.simpleString()).alias("type"))
              for i, f in enumerate(df.schema.fields)]
    return (df.agg(F.count("*").alias("rows"))
            .select("rows", F.inline(F.array(*fields)))
            .select("position", "column", "type", "rows"))


def index_path(base: str, n_bits: int, mse_seed: int, qjl_seed: int | None = None,
               full_data: bool = False) -> str:
    """Folder name of an index, from its parameters."""
    sketch = "" if qjl_seed is None else f"_qjl_seed={qjl_seed}"
    extra = "_full_data" if full_data else ""
    return f"{base.rstrip('/')}/quantized_embeddings_{n_bits}bits_seed={mse_seed}{sketch}{extra}.parquet"


INDEX_KEYS = ["n_bits", "mse_seed", "qjl_seed"]


def write_index(index: DataFrame, path: str, mode: str = "errorifexists",
                rows_per_file: int | None = None, files: str | int = "as_is") -> None:
    """Index partitioned by its parameters, so that several can share a path."""
    write_table(index, path, mode=mode, partition_by=INDEX_KEYS, rows_per_file=rows_per_file, files=files)


def read_index(spark: SparkSession, path: str, n_bits: int, mse_seed: int,
               qjl_seed: int | None = None) -> DataFrame:
    """One index of a shared path; the other partitions are not read."""
    return spark.read.parquet(path).where(
        (F.col("n_bits") == n_bits) & (F.col("mse_seed") == mse_seed)
        & F.col("qjl_seed").eqNullSafe(F.lit(qjl_seed)))


def write_codebook(codebook: DataFrame, path: str, mode: str = "append") -> None:
    codebook.coalesce(1).write.mode(mode).partitionBy("dim").parquet(path)


def read_codebook(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("dim") == dim)
