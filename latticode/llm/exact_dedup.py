"""Exact duplicates by a tree merge of sorted digest runs.

Every node of the tree is one partition and starts with the digests of the
partitions that were dealt to it. In round r the nodes whose numbers differ in
digit r exchange parts of their runs: a digest goes where its own digit r says.
A node sorts what it gets and merges it to one run, an entry per digest with
the smallest row and the count. After the last round a node holds one range of
digests, merged over all inputs. A node only hears from `fan_in` nodes a round,
so that a text that fills a third of the table is one row per run after the
first round, and no task ever holds the rows of all.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticode.llm.tables import SPACE, text_or_empty, written

KEY = ["digest", "n_bytes"]


def normalised(text: str) -> Column:
    """Every run of white space becomes one space; null is the empty text."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, digest, n_bytes): SHA-256 and length of the normalised text.

    `row` numbers the rows, so that rows with equal ids stay apart.
    """
    clean = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("clean"))
    return clean.select("id", F.monotonically_increasing_id().alias("row"),
                        F.unhex(F.sha2("clean", 256)).alias("digest"), F.octet_length("clean").alias("n_bytes"))


def _digit(number: Column, level: int, fan_in: int) -> Column:
    return F.pmod(F.floor(number / F.lit(fan_in ** level)), F.lit(fan_in))


def _merge(runs: DataFrame, nodes: int) -> DataFrame:
    """One run per node: an entry per digest, sizes added, the smallest row kept.

    Digest and length have both to be equal for entries to merge. A node's
    entries are placed in its partition and sorted there, which the aggregate
    takes as they are: it adds up neighbours and moves nothing.
    """
    placed = runs.repartitionById(nodes, F.col("node")).sortWithinPartitions("node", *KEY)
    return placed.groupBy("node", *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def tree_rounds(table: DataFrame, fan_in: int) -> int:
    """Digits of the nodes' numbers: as many nodes as the table has partitions
    and the cluster has cores, at least `fan_in`."""
    wanted = max(table.rdd.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism)
    rounds = 1
    while fan_in ** rounds < wanted:
        rounds += 1
    return rounds


def merge_runs(table: DataFrame, fan_in: int = 2) -> DataFrame:
    """(digest, n_bytes, best, size) of all rows of `digests`.

    `best` is the row with the smallest id; a null id comes last, and of rows
    with equal ids the first counts. In round r a node's r-th digit gives way to
    that of the digest, so its run goes to at most `fan_in` nodes; with two,
    nodes exchange in pairs, in binomial rounds.
    """
    rounds = tree_rounds(table, fan_in)
    nodes = fan_in ** rounds
    best = F.struct(F.isnull("id").alias("no_id"), "id", "row")
    runs = table.select((F.spark_partition_id() % nodes).alias("node"), *KEY, best.alias("best"),
                        F.lit(1).cast("long").alias("size"))
    route = F.pmod(F.xxhash64(*KEY), F.lit(nodes))
    for level in range(rounds):
        step = F.lit(fan_in ** level)
        shift = _digit(route, level, fan_in) - _digit(F.col("node"), level, fan_in)
        runs = _merge(runs.withColumn("node", (F.col("node") + shift * step).cast("int")), nodes)
    return runs.drop("node")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per input row.

    A null text is the empty text, and equal to it. Of equal texts one row
    stays: the smallest id, null last, the first of rows with equal ids. An
    empty table gives an empty result; other columns are not read. The hot
    group of the join is split by Spark's skew handling.
    """
    table = written(digests(docs, id_col, text_col), "digests")
    groups = merge_runs(table, fan_in)
    return table.join(groups, KEY).select(
        "id", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2) -> DataFrame:
    """The rows that stay, with all their columns (as `kept` above).

    Rows are told apart by id and digest; rows that have both in common are
    made one at the end, if there are any.
    """
    table = written(digests(docs, id_col, text_col), "digests")
    member = table.join(merge_runs(table, fan_in), KEY)
    same_id = F.col("id").eqNullSafe(F.col("best.id"))
    marks = written(member.where((F.col("size") > 1) & (~same_id | (F.col("row") != F.col("best.row"))))
                    .groupBy(F.col("id").alias("__id"), F.hex("digest").alias("__sha"))
                    .agg(F.first(same_id).alias("__again")), "copies")
    tagged = docs.withColumn("__sha", F.upper(F.sha2(normalised(text_col), 256)))
    here = (F.col(id_col).eqNullSafe(F.col("__id"))) & (tagged["__sha"] == marks["__sha"])
    stay = tagged.join(marks, here, "left_anti")
    again = marks.where("__again")
    if not again.isEmpty():
        once = tagged.join(again, (F.col(id_col).eqNullSafe(again["__id"])) & (tagged["__sha"] == again["__sha"]),
                           "left_semi").dropDuplicates([id_col, "__sha"])
        stay = stay.unionByName(once)
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
