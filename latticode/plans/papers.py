"""Papers: ingest, text preparation, result cards and embedding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticode.functions import text
from latticode.functions.encoders import Encoder
from latticode.operators.rows import cap_rows
from latticode.sources import tables


def ingest_json(spark: SparkSession, source: str, target: str, *, mode: str = "errorifexists",
                sort_by: str | None = None) -> DataFrame:
    """NDJSON papers to Parquet. With `sort_by` the files are laid out for
    lookups by that key, at the price of one shuffle."""
    papers = tables.read_papers(spark, source)
    if sort_by:
        tables.write_sorted(papers, target, sort_by, mode)
    else:
        tables.write_table(papers, target, mode=mode)
    return spark.read.parquet(target)


def contents(papers: DataFrame, num_rows: int | None = None,
             min_length: int = text.MIN_LENGTH) -> DataFrame:
    """(id, content) of papers whose abstract is long enough, at most `num_rows`
    of them. Rows with a null title have no content and are left out."""
    kept = papers.where(text.is_long_enough(F.col("abstract"), min_length) & F.col("title").isNotNull())
    kept = cap_rows(kept.select("id", "title", "abstract"), num_rows, "id")
    return kept.select("id", text.content(F.col("title"), F.col("abstract")).alias("content"))


def embed(papers: DataFrame, encoder: Encoder, num_rows: int | None = None,
          min_length: int = text.MIN_LENGTH, partitions: int | None = None) -> DataFrame:
    """Embeddings table (id, content, embedding): filter, content, encoder.

    The filter runs before the encoder. With `partitions` the texts are dealt to
    that many tasks first, for a source of fewer row groups than cores.
    """
    texts = contents(papers.repartition(partitions, "id") if partitions else papers, num_rows, min_length)
    return texts.withColumn("embedding", encoder(F.col("content")))


def create_embeddings(spark: SparkSession, source: str, target: str, encoder: Encoder, *,
                      num_rows: int | None = None, min_length: int = text.MIN_LENGTH,
                      partitions: int | None = None, mode: str = "errorifexists",
                      rows_per_file: int | None = None) -> DataFrame:
    """Papers Parquet to embeddings Parquet, at most `num_rows` of them."""
    papers = tables.read_table(spark, source, ["id", "title", "abstract"])
    write_embeddings(embed(papers, encoder, num_rows, min_length, partitions), target, mode=mode,
                     rows_per_file=rows_per_file)
    return tables.read_table(spark, target)


def write_embeddings(embeddings: DataFrame, path: str, *, mode: str = "errorifexists",
                     rows_per_file: int | None = None) -> None:
    tables.write_table(embeddings, path, mode=mode, rows_per_file=rows_per_file,
                       schema=tables.EMBEDDINGS_SCHEMA)


def split_contents(embeddings: DataFrame) -> DataFrame:
    """(id, title_part, abstract_part) of a content column."""
    return embeddings.select("id", text.content_title(F.col("content")).alias("title_part"),
                             text.content_abstract(F.col("content")).alias("abstract_part"))


def result_cards(papers: DataFrame) -> DataFrame:
    """What a result page shows; columns search adds (qid, score, rank) stay."""
    shown = [c for c in ("qid", "rank", "score") if c in papers.columns]
    return papers.select(
        *shown, "id", text.strip(F.col("title")).alias("title"),
        text.snippet(F.col("abstract")).alias("snippet"), "authors",
        text.strip(F.col("abstract")).alias("abstract"), text.link(F.col("id")).alias("link"))


def one_line_texts(papers: DataFrame) -> DataFrame:
    """(id, title, abstract) for plain display: newlines go from the title and
    become spaces in the abstract."""
    return papers.select("id", text.one_line(F.col("title"), "").alias("title"),
                         text.one_line(F.col("abstract"), " ").alias("abstract"))
