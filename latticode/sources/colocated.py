"""Tables laid out alike by a hash of their key, so that joining them moves nothing.

Documents and an index are cut into the same number of buckets by id. A bucket
is one sorted file, and one task of a join; rows of other tables travel to the
buckets, never the other way round. How a folder is laid out is written next to
it when it is complete, and every session reads it from there.
"""

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a bucket should hold: what one task reads at a time.
BUCKET_BYTES = 128 << 20


def buckets_for(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two, so that layouts of different sizes still fit each other."""
    return 1 << max(0, -(-int(total_bytes) // bucket_bytes) - 1).bit_length()


def _name(path: str) -> str:
    """The catalog's name of a folder."""
    return "colocated_" + sha256(path.rstrip("/").encode()).hexdigest()[:24]


def _layout_path(path: str) -> str:
    return f"{path.rstrip('/')}.layout"


def write_colocated(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """The table in a new folder, one sorted file per bucket that has rows.

    One shuffle, by the key. Rows with a null key share a bucket. The folder
    must not exist; it counts as written once its layout is.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    placed = df.repartition(buckets, key).sortWithinPartitions(key)
    (placed.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", path).saveAsTable(_name(path)))
    layout = df.sparkSession.range(1, numPartitions=1).select(F.lit(key).alias("key"), F.lit(buckets).alias("buckets"))
    layout.write.json(_layout_path(path))


def layout_of(spark: SparkSession, path: str) -> tuple[str, int]:
    """(key, buckets) of a folder; one that was not finished is Spark's PATH_NOT_FOUND."""
    row = spark.read.schema("key string, buckets int").json(_layout_path(path)).first()
    return row["key"], row["buckets"]


def read_colocated(spark: SparkSession, path: str) -> DataFrame:
    """The table of a folder, with its buckets known to Spark.

    A session that has not seen the folder enters it in its catalog first, as an
    external table: nothing is copied.
    """
    key, buckets = layout_of(spark, path)
    name = _name(path)
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def attach_colocated(hits: DataFrame, documents_path: str, how: str = "inner") -> DataFrame:
    """Hits with the columns of their documents, for any number of hits.

    The hits carry the key that the documents are laid out by. They are sent to
    the buckets, and the documents are read where they are: no broadcast, and no
    shuffle of a document. A hit without a document goes, unless `how` is "left".
    """
    spark = hits.sparkSession
    key, buckets = layout_of(spark, documents_path)
    return hits.repartition(buckets, key).join(read_colocated(spark, documents_path).hint("merge"), key, how)
