"""NDJSON that may be broken: good rows, and every rejected line with its place."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from latticode.sources.tables import PAPERS_SCHEMA, stored

#: Why a line is rejected.
BROKEN, WRONG_TYPE, NO_KEY = "not JSON", "wrong type", "no key"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text), lines from 1. Files are cut into splits; lines are
    counted per split and a split's first line is the sum of those before it, so
    no file passes through one task; lines stay where they are read."""
    part = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("start"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            places = []
            for key in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                seen[key] = seen.get(key, 0) + 1
                places.append(seen[key])
            yield pa.RecordBatch.from_arrays([batch["file"], batch["start"], pa.array(places, pa.int64()), batch["text"]],
                                             ["file", "start", "place", "text"])

    lines = stored(part.mapInArrow(number, "file string, start long, place long, text string"), "lines")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("n")).select(
        "file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(counts), ["file", "start"]).select("file", (F.col("before") + F.col("place")).alias("line"), "text")


def check_lines(lines: DataFrame, schema: str | StructType = PAPERS_SCHEMA, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of (file, line, text).

    `rows` has the schema's columns and `extra`, a map of fields the schema does
    not know. `rejected` is (file, line, reason, text): lines that are no JSON
    object (or name a field twice), that have a value of another type than their
    column (a number is not text), or whose key is missing. A field that is
    missing or null is null. Blank lines are neither.
    """
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = F.trim(F.col("text"), F.lit(" \t\r\n"))
    parsed = lines.where(text != "").withColumn("__json", F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    one = F.try_variant_get("__json", "$[0]", "variant")  # in brackets, so that nothing may follow the object
    good, values = F.lit(True), []
    for f in target.fields:
        place, kind = f"$[0]['{f.name}']", f.dataType.simpleString()
        value = F.try_variant_get("__json", place, kind)
        found = F.schema_of_variant(F.try_variant_get("__json", place, "variant"))
        same = found == "STRING" if isinstance(f.dataType, StringType) else value.isNotNull()
        good &= found.isNull() | (found == "VOID") | same
        values.append(value.alias(f.name))
    names = [f.name for f in target.fields]
    reason = (F.when(one.isNull() | ~F.startswith(F.schema_of_variant(one), F.lit("OBJECT"))
                     | F.try_variant_get("__json", "$[1]", "variant").isNotNull(), BROKEN)
              .when(~good, WRONG_TYPE).when(values[names.index(key)].isNull(), NO_KEY))
    extra = F.map_filter(F.from_json(text, "map<string,string>"), lambda name, _: ~name.isin(*names))
    judged = stored(parsed.withColumn("reason", reason).select(
        "file", "line", "reason", F.when(F.col("reason").isNotNull(), F.col("text")).alias("text"),
        F.when(F.col("reason").isNull(), F.struct(*values, extra.alias("extra"))).alias("row")), "judged")
    return (judged.where("reason IS NULL").select("row.*"),
            judged.where("reason IS NOT NULL").select("file", "line", "reason", "text"))


def schema_drift(rows: DataFrame) -> DataFrame:
    """(field, rows): fields that the schema does not know, and how many rows
    have them."""
    return (rows.select(F.explode(F.map_keys("extra")).alias("field"))
            .groupBy("field").agg(F.count("*").alias("rows")))
