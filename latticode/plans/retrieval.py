"""Text search: queries in, ranked documents out."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticode.functions.encoders import Encoder
from latticode.operators import search as sr
from latticode.operators.stats import row_count
from latticode.plans.papers import result_cards


def encode_queries(queries: DataFrame, encoder: Encoder) -> DataFrame:
    """(qid, embedding) of (qid, text); null and empty texts ask nothing."""
    return (queries.where(F.length("text") > 0)
            .select("qid", encoder(F.col("text")).alias("embedding")))


class DocumentSearch:
    """A document table, its index and an encoder, to be asked questions.

    Nothing is loaded ahead: a question scans the index columns it needs and
    reads the documents of its hits.
    """

    def __init__(self, docs: DataFrame, index: DataFrame, codebook: DataFrame | Sequence[float],
                 encoder: Encoder, **options):
        self.docs, self.index, self.codebook, self.encoder = docs, index, codebook, encoder
        self.options = options

    def hits(self, queries: DataFrame, top_n: int = 10) -> DataFrame:
        """(qid, id, score, rank) for a table of (qid, text)."""
        return sr.search(self.index, encode_queries(queries, self.encoder), self.codebook, top_n, **self.options)

    def query_many(self, queries: DataFrame, top_n: int = 10, max_queries: int | None = None) -> DataFrame:
        """Documents with qid, score and rank for a table of (qid, text); with
        `max_queries`, a bound on its rows, few hits are sent to the documents."""
        asked = None if max_queries is None else max_queries * top_n
        return sr.attach_documents(self.hits(queries, top_n), self.docs, max_hits=asked)

    def query(self, text: str, top_n: int = 10) -> DataFrame:
        """Documents with score and rank for one question; up to `LOOKUP_HITS`
        of them are read by id."""
        one = self.index.sparkSession.createDataFrame([(0, text)], "qid bigint, text string")
        hits = self.hits(one, top_n)
        found = (sr.lookup_documents(hits, self.docs) if top_n <= sr.LOOKUP_HITS
                 else sr.attach_documents(hits, self.docs, max_hits=top_n))
        return found.drop("qid").orderBy("rank")

    def cards(self, text: str, top_n: int = 12) -> DataFrame:
        """Result cards of one question."""
        return result_cards(self.query(text, top_n)).orderBy("rank")

    def searched(self) -> DataFrame:
        """(rows): how many documents a question is compared with."""
        return row_count(self.index)
