"""The queries of the text operators over whole tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticode.llm import backoff_lm, divergence, exact_dedup, fill_middle, html_text, jaccard_join, mixing, pieces, quality_crf, quality_rules, sharding, substring_dedup, suffix_dedup


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in 24 shards by a hypergeometric communication matrix."""
    return sharding.shard_documents(_documents(spark, sf), 24).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base rules, and the n-gram ratio between good labelled and all documents."""
    trusted = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    return quality_rules.quality_rules(_documents(spark, sf), trusted).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "ratio")


def _fold(spark_id: str = "doc_id") -> Column:
    """The fold of a document: the CRC-32 of its id as text, modulo 5."""
    return F.crc32(F.encode(F.coalesce(F.col(spark_id).cast("string"), F.lit("")), "UTF-8")) % 5


def field_of(docs: DataFrame, sf: str) -> quality_crf.Field:
    """The field learned from labelled documents outside fold 0."""
    labels = docs.sparkSession.read.parquet(f"{sf}/labels.parquet").where(_fold() != 0)
    return quality_crf.train(docs, labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good")))


def op3_quality_crf(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of all documents by a field over their lines."""
    docs = _documents(spark, sf).select("doc_id", "text")
    return quality_crf.with_quality(docs, field_of(docs, sf), name="score").select(
        "doc_id", (_fold() == 0).alias("held_out"), "score",
        (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without strings of 50 bytes that an earlier document has."""
    return suffix_dedup.remove_earlier_repeats(_documents(spark, sf)).withColumnRenamed("id", "doc_id")


def op5_backoff_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Log probabilities of all documents, learned from four folds of five."""
    return backoff_lm.score_documents(_documents(spark, sf), _fold() != 1).select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without passages of 35 words that occur elsewhere."""
    return substring_dedup.remove_repeats(_documents(spark, sf)).withColumnRenamed("id", "doc_id")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and decoded text of every document."""
    return pieces.encode_documents(_documents(spark, sf), model_path()).withColumnRenamed("id", "doc_id")


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mix at 150% takes from each document."""
    return mixing.mixed_sizes(_documents(spark, sf)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The document that stays for every text, after white space is made even."""
    return exact_dedup.duplicate_groups(_documents(spark, sf)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents whose 4-word shingles agree to 85% or more."""
    return jaccard_join.near_duplicates(_documents(spark, sf), n=4, percent=85).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op11_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document cut and put together in another order, and back."""
    return fill_middle.fill_in_middle(_documents(spark, sf)).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(fill_middle.restored("output", "form"), "UTF-8"), 256).alias("restored_sha256"))


def op12_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page, from the paths its host agrees on."""
    return html_text.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each apart."""
    return divergence.audit_sources(_documents(spark, sf))


QUERIES = [op1_sharding, op2_quality_rules, op3_quality_crf, op4_suffix_dedup, op5_backoff_lm, op6_substring_dedup, op7_pieces, op8_mixing, op9_exact_dedup, op10_jaccard_join, op11_fill_middle, op12_html_text, op13_divergence]
