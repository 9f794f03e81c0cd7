"""Quality rules: text statistics and a log-likelihood ratio of hashed n-grams.

Everything is a Spark expression; no Python runs in a task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticode.llm.tables import SPACE, WORD, text_or_empty

#: Fixed values of the rules.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Hash buckets, uni- and bigrams together; and the least ratio a document needs.
BUCKETS = 16_384
THRESHOLD = -0.08


def words_of(text: str) -> Column:
    return F.array_remove(F.split(text_or_empty(text), SPACE), "")


def _next(array: Column, by: int) -> Column:
    """The array without its first elements; `zip_with` pads it with nulls."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _longer(grams: Column, hashes: Column, by: int) -> Column:
    """Hashes of each n-gram of `by` entries with the entry behind it."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(grams, 1, n), F.slice(hashes, by + 1, n), lambda a, b: F.xxhash64(a, b))


def with_repeats(docs: DataFrame, hashes: str, pairs: str) -> DataFrame:
    """The documents with `__repeated`: words inside three-word windows that
    the text has twice or more, from its words and pairs of words.

    Only texts whose windows differ less than they are many go on. Sorting the
    windows shows which occur twice. Their places are looked up in that list
    while it is short, and else found by sorting windows with places; each place
    covers three words. Every step is a column of its own, as an array that a
    lambda refers to would be made again for every element.
    """
    few, name = 24, F.col
    made = docs.withColumn("__all", _longer(name(pairs), name(hashes), 2))
    repeats = F.size(F.array_distinct("__all")) < F.size("__all")
    sorted_ = made.withColumn("__windows", F.when(repeats, name("__all")).otherwise(F.array().cast("array<bigint>")))
    sorted_ = sorted_.withColumn("__sorted", F.sort_array("__windows"))
    twice = F.zip_with("__sorted", _next(name("__sorted"), 1), lambda a, b: F.when(a == b, a))
    listed = sorted_.withColumn("__twice", F.array_distinct(F.array_compact(twice)))
    looked = F.array_compact(F.transform("__windows", lambda w, i: F.when(F.array_contains("__twice", w), i)))
    placed = F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    both = F.zip_with(placed, _next(placed, 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    places = (F.when(F.size("__twice") == 0, F.array().cast("array<int>")).when(F.size("__twice") <= few, looked)
              .otherwise(F.flatten(F.array_compact(both))))
    covered = F.flatten(F.transform("__places", lambda i: F.array(i, i + 1, i + 2)))
    return listed.withColumn("__places", places).withColumn(
        "__repeated", F.size(F.array_distinct(covered)).cast("long")).drop(
        "__all", "__windows", "__sorted", "__twice", "__places")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, and the hashes `__hashes` of their words and
    `__pairs` of neighbouring words.

    A null text has no words and fails.
    """
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    split = docs.withColumn("__words", words_of(text_col))
    hashed = split.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    hashes = F.col("__hashes")
    paired = hashed.withColumn("__pairs", _longer(hashes, hashes, 1)).withColumn("__lines", lines)
    ruled = with_repeats(paired, "__hashes", "__pairs").select(
        "*", F.size(hashes).cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.col("__repeated").alias("n_repeat_words")).drop("__repeated", "__words", "__lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return ruled.withColumn("base_failed", failed)


def _bucket(h: Column, n: int) -> Column:
    return F.pmod(h, F.lit(n)).cast("int")


def buckets(hashes: Column, n: int = BUCKETS) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    return F.transform(F.concat(hashes, _longer(hashes, hashes, 1)), lambda h: _bucket(h, n))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               n: int = BUCKETS) -> DataFrame:
    """One row, `ratios`: per bucket log(p_target / p_raw), both counts plus 1.

    The raw corpus is all documents, the target those whose id `trusted`
    (column `id`) has; nothing is sampled. Ids and texts are joined by a merge
    join at every size, as both grow with the corpus. Counts are added up
    before they are exchanged, so that shuffle sees a row per bucket and task.
    """
    ids = trusted.where(F.col("id").isNotNull()).select(F.col("id").alias("__id")).distinct()
    marked = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(
        ids.hint("merge"), F.col("__doc") == F.col("__id"), "left")
    hashed = marked.select(F.col("__id").isNotNull().alias("good"),
                           F.transform(words_of("__text"), lambda w: F.xxhash64(w)).alias("hashes"))
    every_gram = F.concat("hashes", _longer(F.col("hashes"), F.col("hashes"), 1))
    grams = hashed.select("good", F.explode(every_gram).alias("gram")).select("good", _bucket(F.col("gram"), n).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").na.fill(0)
    table = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"),
                     F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    ratio = lambda r, raws, targets: (F.log((r["target"] + 1) / (targets + n)) - F.log((r["raw"] + 1) / (raws + n)))
    return table.select(F.transform("rows", lambda r: ratio(r, F.col("raws"), F.col("targets")).cast("float"))
                        .alias("ratios"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  n: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The base rules, `ratio` (mean log-likelihood ratio per n-gram) and `kept`.

    Every document gets a verdict: one that fails the base rules is not kept,
    nor is one whose ratio is below the threshold. A text without words has
    ratio 0. Without trusted documents all ratios follow the raw counts alone.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col, n).scalar()
    ruled = base_rules(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), "__text")
    given = ruled.withColumn("__ratios", ratios)
    add = lambda acc, h: acc + F.get("__ratios", _bucket(h, n))
    total = F.aggregate("__pairs", F.aggregate("__hashes", F.lit(0.0), add), add)
    grams = F.size("__hashes") + F.size("__pairs")
    scored = given.withColumn("ratio", F.when(grams > 0, total / grams).otherwise(0.0))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold)).drop(
        "__text", "__hashes", "__pairs", "__ratios")
