"""Tables of many small files: packed into full ones behind a manifest.

A version is a list of Parquet files. Readers follow the newest list; packing
writes new files beside the old ones and then one new list, so a reader sees
the files of one version and nothing in between. Old files stay until
`unlisted` names them and their owner removes them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticode.sources.tables import INDEX_KEYS

MANIFEST = "version long, file string, bytes long"


def files_of(df: DataFrame) -> DataFrame:
    """(file, bytes) of a Parquet scan, from the scan's own metadata."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, file, bytes) of all versions."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest/*")


def _newest(spark: SparkSession, path: str, version: int | None) -> tuple[int, list]:
    rows = read_manifest(spark, path)
    chosen = rows.agg(F.max("version")).first()[0] if version is None else version
    files = rows.where(F.col("version") == chosen).orderBy("file").collect()
    if not files:
        raise ValueError(f"no version {chosen} in {path}")
    return chosen, files


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The files of a version, by default of the newest; partition columns come
    from the files' folders."""
    _, files = _newest(spark, path, version)
    return spark.read.option("basePath", path).parquet(*[r.file for r in files])


def publish(spark: SparkSession, path: str, files: DataFrame, version: int) -> None:
    """Makes (file, bytes) the given version. Two writers of one version: the
    second fails, since the folder exists."""
    rows = files.select(F.lit(version).cast("long").alias("version"), "file", "bytes")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/_manifest/version-{version}")


def start_versions(spark: SparkSession, path: str, version: int = 0) -> None:
    """The first version: all Parquet files below `path`."""
    publish(spark, path, files_of(spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)),
            version)


def pack_files(files: list[tuple[str, int]], target: int) -> list[list[str]]:
    """Files of less than half the target in bins of at most the target, the
    largest first into the first bin with room; bins of one file are left out."""
    bins: list[tuple[int, list[str]]] = []
    for name, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if 2 * size >= target:
            continue
        at = next((n for n, (used, _) in enumerate(bins) if used + size <= target), None)
        if at is None:
            bins.append((size, [name]))
        else:
            bins[at] = bins[at][0] + size, [*bins[at][1], name]
    return [names for _, names in bins if len(names) > 1]


def _folder(file: str, path: str) -> str:
    """The partition folders of a file, e.g. `n_bits=4/mse_seed=42`."""
    return "/".join(part for part in file.rsplit("/", 1)[0].split("/") if "=" in part and f"{part}/" in file.removeprefix(path))


def compact(spark: SparkSession, path: str, target_bytes: int, keys: list[str] | None = None) -> int:
    """Packs the small files of the newest version and publishes the next one,
    whose number it returns; with nothing to pack, the old one.

    Files are packed within their partition folder, `keys` being the partition
    columns. Every bin is one task that reads its files and writes one: no
    shuffle, and as many tasks as bins. The list of files, which the driver also
    holds to plan any scan of the table, is what it packs.
    """
    keys = INDEX_KEYS if keys is None else keys
    version, files = _newest(spark, path, None)
    folders: dict[str, list[tuple[str, int]]] = {}
    for r in files:
        folders.setdefault(_folder(r.file, path), []).append((r.file, r.bytes))
    bins = [b for members in folders.values() for b in pack_files(members, target_bytes)]
    if not bins:
        return version
    target = f"{path}/_packed-{version + 1}"
    number = spark.createDataFrame([(f, n) for n, b in enumerate(bins) for f in b], "file string, bin int")
    packed = spark.read.option("basePath", path).parquet(*[f for b in bins for f in b])
    named = packed.withColumn("file", F.col("_metadata.file_path")).join(F.broadcast(number), "file")  # one row per small file
    (named.repartition(len(bins), "bin").sortWithinPartitions("bin").drop("file", "bin")
     .write.mode("overwrite").partitionBy(*[k for k in keys if k in packed.columns]).parquet(target))
    gone = {f for b in bins for f in b}
    kept = spark.createDataFrame([(r.file, r.bytes) for r in files if r.file not in gone], "file string, bytes long")
    publish(spark, path, kept.unionByName(files_of(spark.read.parquet(target))), version + 1)
    return version + 1


def unlisted(spark: SparkSession, path: str) -> DataFrame:
    """(file): files of older versions that the newest does not list."""
    version, _ = _newest(spark, path, None)
    rows = read_manifest(spark, path)
    return rows.where(F.col("version") < version).select("file").distinct().join(
        rows.where(F.col("version") == version), "file", "left_anti")
