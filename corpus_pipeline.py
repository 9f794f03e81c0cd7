"""From raw documents to encoded training text, in five stages.

Every stage is a function of (spark, docs, sf_dir); what it returns is written
as Parquet and read again as the documents of the next one.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticode.llm import exact_dedup, jaccard_join, mixing, pieces, quality_crf
from latticode.llm.queries import field_of, model_path
from latticode.llm.tables import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on the labels, does not reject."""
    scored = quality_crf.with_quality(docs, field_of(docs, sf_dir), name="__quality")
    return scored.where(F.col("__quality") >= quality_crf.THRESHOLD).drop("__quality")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those whose texts are equal."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80% of their five-word shingles."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, as a digest, and the digest of what they decode to."""
    return pieces.encode_documents(docs, model_path()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
    ("mixing", mixture), ("SentencePiece", encoding)]

#: SQL cannot express the line field or the encoding; tests/llm checks the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
