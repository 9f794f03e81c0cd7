"""Standing queries over a stream of vectors: the best hits so far, batch by batch.

Every batch writes folders named by its number: the index rows of its vectors,
the hits after it, and last its line in the log. Its hits are made of the hits
of the logged batch before it and its own rows, so a batch that is run again
writes the same again, and one that was killed before its line counts for nothing.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from latticode.operators.grid import search_grid
from latticode.operators.index import build_index
from latticode.operators.search import rank_hits

LOG = "batch long, hits string, index string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(batch, hits, index): what each finished batch wrote; no rows before the
    first one has."""
    try:
        return spark.read.schema(LOG).json(f"{path}/log/*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LOG)


def _last(spark: SparkSession, path: str, before: int | None = None):
    log = read_log(spark, path)
    log = log if before is None else log.where(F.col("batch") < before)
    return log.orderBy(F.desc("batch")).first()


def current_hits(spark: SparkSession, path: str, qid_type: str = "bigint", id_type: str = "bigint") -> DataFrame:
    """(qid, id, score, rank) after the last finished batch."""
    last, schema = _last(spark, path), f"qid {qid_type}, id {id_type}, score double, rank int"
    return spark.read.schema(schema).parquet(last.hits) if last else spark.createDataFrame([], schema)


def current_index(spark: SparkSession, path: str) -> DataFrame | None:
    """Index rows of all finished batches; None before the first."""
    folders = [r["index"] for r in read_log(spark, path).select("index").distinct().collect()]
    return spark.read.parquet(*folders) if folders else None


def apply_batch(batch: DataFrame, number: int, queries: DataFrame, codebook: DataFrame | Sequence[float], path: str, top_n: int,
                dim: int, n_bits: int = 4, id_col: str = "id", **search) -> None:
    """One batch: encode, score against the standing queries, merge, log.

    A batch that is in the log already is left alone. An id that comes again in
    a later batch replaces its hit if it scores higher, and is not listed twice.
    """
    spark = batch.sparkSession
    if read_log(spark, path).where(F.col("batch") == number).first():
        return
    rows_path, hits_path = f"{path}/index/batch-{number}", f"{path}/hits/batch-{number}"
    build_index(batch, codebook, n_bits, dim=dim, id_col=id_col).write.mode("overwrite").parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    hits = search_grid(rows, queries, codebook, top_n, n_bits=n_bits, dim=dim, **search).drop("rank")
    if last := _last(spark, path, number):
        schema = StructType([*hits.schema.fields, *StructType.fromDDL("rank int").fields])
        hits = hits.unionByName(spark.read.schema(schema).parquet(last.hits).drop("rank"))
        hits = hits.groupBy("qid", "id").agg(F.max("score").alias("score"))
    rank_hits(hits, top_n).write.mode("overwrite").parquet(hits_path)
    line = spark.createDataFrame([(number, hits_path, rows_path)], LOG)
    line.coalesce(1).write.mode("overwrite").json(f"{path}/log/batch-{number}")


def watch(stream: DataFrame, queries: DataFrame, codebook: DataFrame | Sequence[float], path: str, checkpoint: str, top_n: int,
          dim: int, n_bits: int = 4, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start scoring every new vector of the stream against the queries.

    `path` receives index, hits and log; read them with `current_index` and
    `current_hits`. `queries` is (qid, embedding) and is read again for every
    batch: a stored table, whose rows should not change while the query runs.
    """
    def run(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, queries, codebook, path, top_n, dim, n_bits, **options)

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
