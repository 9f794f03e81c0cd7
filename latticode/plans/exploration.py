"""Exploration of a corpus and of its vectors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticode.functions import text
from latticode.operators import reduction as rd
from latticode.operators import stats
from latticode.operators.rows import sample_file_rows


def profile_texts(df: DataFrame, text_col: str, interpolation: str = "nearest") -> DataFrame:
    """(statistic, value) of the text lengths."""
    return stats.describe(df.select(F.length(text_col).alias("length")), "length", interpolation)


def valid_count(df: DataFrame, text_col: str, minimum: int = text.MIN_LENGTH) -> DataFrame:
    """(rows): how many texts are long enough."""
    return stats.row_count(df.where(text.is_long_enough(F.col(text_col), minimum)))


def cluster_vectors(df: DataFrame, id_col: str, every: int = 100, variance: float = 0.7,
                    clusters: int = 10, components: int = 200, seed: int = 4321,
                    vector_col: str = "embedding") -> DataFrame:
    """(id, projected, cluster): every-nth row of a Parquet scan in file order,
    PCA cut to the component count nearest to `variance`, k-means."""
    sample = (sample_file_rows(df, every) if every > 1 else df).select(id_col, vector_col).persist()
    try:
        pca = rd.fit_pca(sample, components, vector_col)
        kept = rd.components_for(rd.explained_variance(df, pca), [variance]).first().components
        projected = rd.project(sample, pca, kept, vector_col).select(F.col(id_col).alias("id"), "projected")
        return rd.cluster(projected, "projected", clusters, seed)
    finally:
        sample.unpersist()
