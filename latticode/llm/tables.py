"""Small helpers of the text operators: word pattern, tables in the shared folder."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticode.sources.tables import new_shared_path

#: ASCII white space; a word is a run of anything else.
SPACE = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the folder all executors share, and read back.

    This cuts the lineage, survives lost executors, fixes what a later job
    would otherwise compute again, and gives Spark the table's size.
    """
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
