"""One query per operator, over whole tables, one scalar per output column."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixed import BROKEN_EVERY, BUCKETS, CARDS, CELLS, CLUSTERS, CODEBOOK, DIM, DIRECTIONS, INDEX_CAP, PADDED, PROBES, PUSH, QUESTIONS, ROW_CAP, SAMPLE_EVERY, TOP_N
from latticode.functions import codes, text, vectors
from latticode.functions.encoders import hashed_encoder
from latticode.operators import cascade, cells, grid, kmeans, power, sketches
from latticode.operators import codebook as cb
from latticode.operators import index as ix
from latticode.operators import reduction as rd
from latticode.operators import rows as rw
from latticode.operators import search as sr
from latticode.operators import stats as st
from latticode.plans import exploration, indexing, papers, retrieval
from latticode.sources import checked, colocated, tables, versions
from latticode.streaming import index_stream, standing

MSE, QJL = ix.MSE_SEED, ix.QJL_SEED
ENCODER = hashed_encoder(DIM)


def r6(c):
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# Inputs.


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", "label")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table in the shape of papers."""
    return tables.read_table(spark, f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit(" "), "lang").alias("title"),
        F.col("text").alias("abstract"), F.col("source").alias("authors"))


def longer_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with half of their first coordinates behind them: neither of a
    power of two nor of length one."""
    more = F.transform(F.slice("embedding", 1, PADDED - DIM), lambda x: (x / 2).cast("float"))
    return embeddings(spark, sf).withColumn("embedding", F.concat("embedding", more))


def label_queries(spark: SparkSession, sf: str, vectors_of=embeddings) -> DataFrame:
    """One query per label: the mean of its vectors."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    return (vectors_of(spark, sf).groupBy("label").agg(Summarizer.mean(vector).alias("mean"))
            .select(F.col("label").cast("bigint").alias("qid"), vector_to_array("mean").alias("embedding")))


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def index(spark: SparkSession, sf: str, n_bits: int = 4, **options) -> DataFrame:
    return ix.build_index(embeddings(spark, sf), CODEBOOK[n_bits], n_bits, dim=DIM, **options)


def text_index(spark: SparkSession, sf: str) -> DataFrame:
    return ix.build_index(papers.embed(documents(spark, sf), ENCODER), CODEBOOK[4], 4, dim=DIM)


# Exploding uses the outer form: the inner one adds a filter on the exploded
# column, for which Spark computes that column a second time.


def coordinates(df: DataFrame, vector: str) -> DataFrame:
    return df.select("id", F.posexplode_outer(vector).alias("pos", "x")).select("id", "pos", r6(F.col("x").cast("double")).alias("x"))


def rotated(spark, sf):
    return embeddings(spark, sf).select("id", vectors.rotate(F.col("embedding"), MSE, DIM).alias("rotated"))


# Text.


def text_filter_content(spark, sf):
    return papers.contents(documents(spark, sf))


def content_split(spark, sf):
    return papers.split_contents(papers.contents(documents(spark, sf)))


def snippet(spark, sf):
    return documents(spark, sf).select("id", text.snippet(F.col("abstract")).alias("snippet"))


def result_card(spark, sf):
    return papers.result_cards(documents(spark, sf))


def display_text(spark, sf):
    return papers.one_line_texts(documents(spark, sf))


def embed_hashed(spark, sf):
    return coordinates(papers.embed(documents(spark, sf), ENCODER), "embedding")


def embed_row_cap(spark, sf):
    return papers.embed(documents(spark, sf), ENCODER, num_rows=ROW_CAP).select("id", "content")


def embeddings_write_read(spark, sf):
    path = tables.new_shared_path(spark, "embeddings")
    papers.write_embeddings(papers.embed(documents(spark, sf), ENCODER), path)
    return tables.read_table(spark, path).select("id", "content", F.size("embedding").alias("dim"))


def json_roundtrip(spark, sf):
    source, target = tables.new_shared_path(spark, "papers-json"), tables.new_shared_path(spark, "papers")
    documents(spark, sf).write.json(source)
    return papers.ingest_json(spark, source, target, sort_by="id").select("id", "title", "abstract", "authors")


# Statistics and rows.


def non_null_counts(spark, sf):
    return st.non_null_counts(documents(spark, sf))


def valid_count(spark, sf):
    return exploration.valid_count(documents(spark, sf), "abstract")


def table_height(spark, sf):
    return st.row_count(index(spark, sf))


def text_profile(spark, sf):
    return exploration.profile_texts(documents(spark, sf), "abstract").select("statistic", r6(F.col("value")).alias("value"))


def text_profile_linear(spark, sf):
    return exploration.profile_texts(documents(spark, sf), "abstract", "linear").select(
        "statistic", r6(F.col("value")).alias("value"))


def sample_every_n(spark, sf):
    return rw.sample_every(documents(spark, sf), SAMPLE_EVERY, "id").select("id", "title", "abstract")


def sample_every_n_files(spark, sf):
    docs = tables.read_table(spark, f"{sf}/documents.parquet")
    return rw.sample_file_rows(docs, SAMPLE_EVERY).select("doc_id", "source", "text")


def dimension_check(spark, sf):
    return ix.check_dimensions(embeddings(spark, sf))


def index_profile(spark, sf):
    return tables.profile(index(spark, sf))


# Vectors.


def vector_normalize(spark, sf):
    return coordinates(longer_embeddings(spark, sf).select("id", vectors.l2_normalize(F.col("embedding")).alias("v")), "v")


def vector_pad(spark, sf):
    return coordinates(embeddings(spark, sf).select("id", vectors.pad_zeros(F.col("embedding"), 2 * DIM).alias("v")), "v")


def rotate(spark, sf):
    return coordinates(rotated(spark, sf), "rotated")


def unrotate_roundtrip(spark, sf):
    back = vectors.unrotate(F.col("rotated"), MSE, DIM)
    return coordinates(rotated(spark, sf).select("id", back.alias("v")), "v")


def rotate_padded(spark, sf):
    turned = vectors.rotate(F.col("embedding"), MSE, PADDED)
    return coordinates(longer_embeddings(spark, sf).select("id", turned.alias("v")), "v")


def unrotate_cut(spark, sf):
    turned = longer_embeddings(spark, sf).select("id", vectors.rotate(F.col("embedding"), MSE, PADDED).alias("rotated"))
    return coordinates(turned.select("id", vectors.unrotate(F.col("rotated"), MSE, PADDED).alias("v")), "v")


def codebook_step(spark, sf):
    points = rotated(spark, sf).select(F.explode_outer("rotated").alias("x"), F.lit(1.0).alias("w"))
    step = cb.lloyd_step(points, CODEBOOK)
    return step.select("bits", "idx", r6(F.col("weight")).alias("weight"),
                       r6(F.col("centroid")).alias("centroid"), r6(F.col("spread")).alias("spread"))


def codebook_fit(spark, sf):
    points = rotated(spark, sf).select(F.explode_outer("rotated").alias("x"), F.lit(1.0).alias("w"))
    return cb.fit(points, DIM).select("dim", "bits", "idx", r6(F.col("centroid")).alias("centroid"))


def quantize_codes(spark, sf):
    code = codes.byte_values(codes.quantize(F.col("rotated"), CODEBOOK[4], DIM))
    return rotated(spark, sf).select("id", F.posexplode_outer(code).alias("pos", "code"))


def quantize_histogram(spark, sf):
    coded = rotated(spark, sf).select(F.inline(F.array(*[
        F.struct(F.lit(bits).alias("bits"), codes.byte_values(codes.quantize(F.col("rotated"), table, DIM)).alias("codes"))
        for bits, table in CODEBOOK.items()])))
    return coded.select("bits", F.explode_outer("codes").alias("code")).groupBy("bits", "code").agg(F.count("*").alias("n"))


def pack_hex(spark, sf):
    packed = [F.struct(F.lit(bits).alias("bits"),
                       F.hex(codes.pack(codes.quantize(F.col("rotated"), CODEBOOK[bits], DIM), bits, DIM)).alias("hex"))
              for bits in (1, 2, 4)]
    return rotated(spark, sf).select("id", F.inline(F.array(*packed)))


def unpack_codes(spark, sf):
    unpacked = codes.byte_values(codes.unpack(F.col("packed"), 2, DIM))
    return index(spark, sf, 2, with_qjl=False).select("id", F.posexplode_outer(unpacked).alias("pos", "code"))


def centroid_coordinates(spark, sf):
    values = codes.centroid_values(F.col("packed"), CODEBOOK[4], 4, DIM)
    return coordinates(index(spark, sf, with_qjl=False).select("id", values.alias("v")), "v")


def dequantize(spark, sf):
    back = codes.dequantize(F.col("packed"), CODEBOOK[4], 4, MSE, DIM)
    return coordinates(index(spark, sf, with_qjl=False).select("id", back.alias("v")), "v")


def residual(spark, sf):
    return coordinates(index(spark, sf, full_data=True), "residual")


def residual_gamma(spark, sf):
    """Residual and its norm as expressions over the dequantized vectors."""
    unit = vectors.l2_normalize(F.col("embedding"))
    stored = codes.pack(codes.quantize(vectors.rotate(unit, MSE, DIM), CODEBOOK[4], DIM), 4, DIM)
    restored = embeddings(spark, sf).select(
        "id", unit.alias("unit"), codes.dequantize(stored, CODEBOOK[4], 4, MSE, DIM).alias("approximate"))
    rest = vectors.subtract(F.col("unit"), F.col("approximate"))
    return restored.select("id", r6(vectors.norm(rest)).alias("gamma"))


def qjl_bits_hex(spark, sf):
    return index(spark, sf).select("id", F.hex("qjl_bits").alias("hex"))


def qjl_bits_values(spark, sf):
    bits = codes.byte_values(codes.unpack(F.col("qjl_bits"), 1, DIM))
    return index(spark, sf).select("id", F.posexplode_outer(bits).alias("pos", "bit"))


# Indexes.


def index_rows(df: DataFrame) -> DataFrame:
    return df.select("n_bits", "id", F.hex("packed").alias("packed"),
                     r6(F.col("gamma").cast("double")).alias("gamma"), F.hex("qjl_bits").alias("qjl_bits"))


def index_build(spark, sf):
    return index_rows(index(spark, sf))


def padded_index(spark, sf):
    return ix.build_index(longer_embeddings(spark, sf), CODEBOOK[4], 4, dim=PADDED)


def index_build_padded(spark, sf):
    return index_rows(padded_index(spark, sf))


def index_union(spark, sf):
    return index_rows(index(spark, sf, 1).unionByName(index(spark, sf, 2)))


def index_write_read(spark, sf):
    path = tables.new_shared_path(spark, "index")
    tables.write_index(index(spark, sf, 2), path)
    tables.write_index(index(spark, sf, 4), path, mode="append")
    return index_rows(tables.read_index(spark, path, 4, MSE, QJL))


def run_index_job(spark, sf, **options):
    source, base = tables.new_shared_path(spark, "embeddings"), tables.new_shared_path(spark, "indexes")
    book, kept = tables.new_shared_path(spark, "codebook"), [
        (DIM, b, i, c) for b, t in CODEBOOK.items() for i, c in enumerate(t)]
    tables.write_table(embeddings(spark, sf).select("id", "embedding"), source)
    tables.write_codebook(spark.createDataFrame(kept, cb.SCHEMA), book)
    path = indexing.create_index(spark, source, base, tables.read_codebook(spark, book, DIM), 4, with_qjl=True, **options)
    return index_rows(tables.read_table(spark, path))


def index_job(spark, sf):
    """Embeddings file and codebook file to index files, as the job runs it."""
    return run_index_job(spark, sf, rows_per_file=200)


def index_row_cap(spark, sf):
    return run_index_job(spark, sf, max_rows=INDEX_CAP)


def index_stream_append(spark, sf):
    path, checkpoint = tables.new_shared_path(spark, "stream-index"), tables.new_shared_path(spark, "stream-log")
    source = f"{sf}/embeddings.parquet"
    stream = index_stream.read_embeddings_stream(spark, index_stream.table_pattern(source), spark.read.parquet(source).schema, pattern="*")
    query = index_stream.append_index(stream, CODEBOOK[4], path, checkpoint, DIM, id_col="vec_id")
    query.awaitTermination()
    return index_rows(tables.read_index(spark, path, 4, MSE, QJL))


def index_size_report(spark, sf):
    report = st.storage_report(index(spark, sf, full_data=True))
    return report.select("representation", "bytes", r6(F.col("megabytes")).alias("megabytes"))


def index_verify(spark, sf):
    checks = indexing.verify_index(index(spark, sf, full_data=True), CODEBOOK[4], 4, DIM)
    return checks.select("rows", "wrong_codes", "invertible", r6(F.col("mean_squared_error")).alias("mean_squared_error"))


def reconstruction_error(spark, sf):
    """Mean squared error of the stored vectors per bit width."""
    tables_of = {bits: CODEBOOK[bits] for bits in (1, 2, 4)}
    errors = embeddings(spark, sf).select(codes.squared_errors(F.col("embedding"), tables_of, MSE, DIM).alias("error"))
    each = errors.select(F.inline(F.array(*[
        F.struct(F.lit(bits).alias("bits"), F.col(f"error.bits_{bits}").alias("squared")) for bits in tables_of])))
    return each.groupBy("bits").agg(r6(F.avg("squared")).alias("mse"))


# Search.


def query_lookup_table(spark, sf):
    products = sr.query_tables(label_queries(spark, sf), CODEBOOK[4], 4, DIM)
    return products.select("qid", "position", F.posexplode_outer("products").alias("byte", "value")).select(
        "qid", "position", "byte", r6(F.col("value")).alias("value"))


def score_one_query(spark, sf):
    """Every vector against the mean of all vectors."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    mean = embeddings(spark, sf).agg(Summarizer.mean(vector)).first()[0].toArray()
    scores = sr.score_rows(index(spark, sf), mean, CODEBOOK[4])
    return scores.select("id", *[r6(F.col(c)).alias(c) for c in ("mse_score", "qjl_dot", "qjl_score", "score")])


def hits(spark, sf, n_bits=4, **options):
    build = {"residual_sign": options.pop("residual_sign", "unbiased"), "with_qjl": options.get("with_qjl", True)}
    return sr.search(index(spark, sf, n_bits, **build), label_queries(spark, sf), CODEBOOK[n_bits], TOP_N,
                     n_bits=n_bits, dim=DIM, **options)


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", r6(F.col("score")))


def search_mse(spark, sf):
    return scored(hits(spark, sf, with_qjl=False))


def search_mse_tables(spark, sf):
    return scored(hits(spark, sf, with_qjl=False, method="table"))


def search_qjl(spark, sf):
    return scored(hits(spark, sf))


def search_qjl_1bit(spark, sf):
    return scored(hits(spark, sf, 1))


def search_qjl_2bit(spark, sf):
    return scored(hits(spark, sf, 2, method="table"))


def search_qjl_reference(spark, sf):
    return scored(hits(spark, sf, residual_sign="reference", alpha="reference"))


def search_padded(spark, sf):
    found = sr.search(padded_index(spark, sf), label_queries(spark, sf, longer_embeddings), CODEBOOK[4], TOP_N,
                      dim=PADDED, codebook_dim=DIM)
    return scored(found)


def search_short_queries(spark, sf):
    """Queries of a billionth of the length find the same rows."""
    short = label_queries(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x * 1e-9))
    found = sr.search(index(spark, sf), short, CODEBOOK[4], TOP_N, dim=DIM)
    return scored(found.withColumn("score", F.col("score") * 1e9))


def search_stored(spark, sf):
    """Search of an index that was written before."""
    path = tables.new_shared_path(spark, "index")
    tables.write_index(index(spark, sf), path)
    return scored(sr.search(tables.read_index(spark, path, 4, MSE, QJL), label_queries(spark, sf), CODEBOOK[4], TOP_N, dim=DIM))


def search_documents(spark, sf):
    asked = label_queries(spark, sf).count() * TOP_N
    found = sr.attach_documents(hits(spark, sf), documents(spark, sf), max_hits=asked)
    return scored(found).select("qid", "rank", "id", "score", "title")


def search_documents_semi(spark, sf):
    return sr.attach_documents(hits(spark, sf), documents(spark, sf), how="semi").select("id", "title")


def search_text(spark, sf):
    engine = retrieval.DocumentSearch(documents(spark, sf), text_index(spark, sf), CODEBOOK[4], ENCODER, dim=DIM)
    return scored(engine.query_many(benchmark_queries(spark, sf), TOP_N)).select("qid", "rank", "id", "score", "title")


def search_questions(spark, sf):
    engine = retrieval.DocumentSearch(documents(spark, sf), text_index(spark, sf), CODEBOOK[4], ENCODER, dim=DIM)
    asked = spark.createDataFrame(QUESTIONS, "qid bigint, text string")
    found = sr.lookup_documents(engine.hits(asked, CARDS), documents(spark, sf))
    return scored(papers.result_cards(found)).select("qid", "rank", "id", "score", "title", "snippet", "link")


# Search of laid out indexes, query tables and streams.


def grouped_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors moved along one axis per label, so that they form groups."""
    moved = F.transform("embedding", lambda x, i: x + F.when(i == F.col("label") * 6, PUSH).otherwise(0.0).cast("float"))
    return embeddings(spark, sf).withColumn("embedding", moved)


def search_grid(spark, sf):
    """Queries as a table: blocks of queries against blocks of the index."""
    return scored(grid.search_grid(index(spark, sf), label_queries(spark, sf), CODEBOOK[4], TOP_N, dim=DIM))


def search_grid_text(spark, sf):
    """Every benchmark text as a query, from text to hits as tables."""
    asked = retrieval.encode_queries(benchmark_queries(spark, sf), ENCODER)
    return scored(grid.search_grid(text_index(spark, sf), asked, CODEBOOK[4], TOP_N, dim=DIM))


def cell_hits(spark, sf, vectors_of=embeddings, **options):
    built = ix.build_index(vectors_of(spark, sf), CODEBOOK[4], 4, dim=DIM)
    rows, kept = cells.in_cells(built, CODEBOOK[4], CELLS, dim=DIM)
    return cells.search_cells(rows, kept, label_queries(spark, sf, vectors_of), CODEBOOK[4], TOP_N, dim=DIM, **options)


def search_cells(spark, sf):
    """Cells in the order of their bounds, until no other can matter."""
    return scored(cell_hits(spark, sf))


def search_cells_grouped(spark, sf):
    """The same on vectors that form groups, where most cells are not read."""
    return scored(cell_hits(spark, sf, grouped_embeddings))


def search_cells_all(spark, sf):
    """As many nearest cells as there are."""
    return scored(cell_hits(spark, sf, probes=CELLS))


def search_cells_near(spark, sf):
    """Some nearest cells only: most of the hits."""
    return scored(cell_hits(spark, sf, probes=PROBES))


def cell_ranges(spark, sf):
    """What is kept of one cell that holds every row."""
    rows, kept = cells.in_cells(index(spark, sf), CODEBOOK[4], 1, dim=DIM)
    low, high = (codes.byte_values(F.col(c)) for c in ("low", "high"))
    return kept.select("n", r6(F.col("gamma")).alias("gamma"), r6(F.col("radius")).alias("radius"),
                       F.posexplode_outer(F.arrays_zip(low.alias("low"), high.alias("high"))).alias("pos", "range")).select(
        "n", "gamma", "radius", "pos", "range.low", "range.high")


def search_cascade(spark, sf):
    """One bit per coordinate bounds the scores; only rows it lets through are scored."""
    built = tables.stored(index(spark, sf), "index")
    sketch = tables.stored(cascade.code_sketch(built, CODEBOOK[4], dim=DIM), "sketch")
    return scored(cascade.search_cascade(built, sketch, label_queries(spark, sf), CODEBOOK[4], TOP_N, dim=DIM))


def search_cascade_2bit(spark, sf):
    built = tables.stored(index(spark, sf), "index")
    sketch = tables.stored(cascade.code_sketch(built, CODEBOOK[4], dim=DIM, prefix_bits=2), "sketch")
    return scored(cascade.search_cascade(built, sketch, label_queries(spark, sf), CODEBOOK[4], TOP_N, dim=DIM, prefix_bits=2))


def search_standing(spark, sf):
    """Hits of standing queries after a stream has brought the vectors in parts."""
    folder, path, log = (tables.new_shared_path(spark, name) for name in ("arriving", "standing", "standing-log"))
    embeddings(spark, sf).repartition(3, "id").write.parquet(folder)
    asked = tables.stored(label_queries(spark, sf), "standing-queries")
    stream = index_stream.read_embeddings_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    standing.watch(stream, asked, CODEBOOK[4], path, log, TOP_N, DIM).awaitTermination()
    return scored(standing.current_hits(spark, path))


def index_compacted(spark, sf):
    """An index of many small files, packed, read by its manifest."""
    path = tables.new_shared_path(spark, "index")
    tables.write_index(index(spark, sf).repartition(12), path)
    versions.start_versions(spark, path)
    versions.compact(spark, path, 8 << 20)
    return index_rows(versions.read_version(spark, path))


def spoiled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as NDJSON lines, one in `BROKEN_EVERY` cut off, one with a number
    for a title, one without an id, and a field that papers do not have."""
    docs = documents(spark, sf)
    turn = F.col("id") % BROKEN_EVERY
    title = F.to_json(F.struct(F.col("id").alias("title")))
    line = F.to_json(F.struct(F.when(turn != 3, F.col("id").cast("string")).alias("id"), "title", "abstract", "authors",
                              F.when(turn == 4, F.lit("x")).alias("venue")))
    spoiled = F.when(turn == 1, F.expr("left(line, length(line) - 1)")).when(turn == 2, title).otherwise(F.col("line"))
    path = tables.new_shared_path(spark, "spoiled")
    docs.withColumn("line", line).select(spoiled.alias("value")).write.text(path)  # a file per task
    return checked.read_lines(spark, path)


def json_checked(spark, sf):
    """The good rows of broken NDJSON."""
    rows, _ = checked.check_lines(spoiled_lines(spark, sf))
    return rows.select("id", "title", "abstract", "authors", F.element_at("extra", "venue").alias("venue"))


def json_rejected(spark, sf):
    """How many lines are rejected, for which reason, and where the lines are."""
    lines = spoiled_lines(spark, sf)
    _, rejected = checked.check_lines(lines)
    placed = lines.groupBy("file").agg(F.max("line").alias("last"), F.count("*").alias("n"), F.countDistinct("line").alias("different"))
    sound = placed.agg(F.bool_and((F.col("last") == F.col("n")) & (F.col("n") == F.col("different"))).alias("numbered"))
    return rejected.groupBy("reason").agg(F.count("*").alias("rows")).crossJoin(F.broadcast(sound))  # one row


# PCA and clusters.


def pca_variance(spark, sf):
    df = embeddings(spark, sf)
    variance = rd.explained_variance(df, rd.fit_pca(df))
    return variance.select("component", r6(F.col("ratio")).alias("ratio"), r6(F.col("cumulative")).alias("cumulative"))


def pca_components(spark, sf):
    df = embeddings(spark, sf)
    return rd.components_for(rd.explained_variance(df, rd.fit_pca(df)))


def kmeans_step(spark, sf):
    """One step from the first vectors as centers: members and means."""
    points = embeddings(spark, sf)
    centers = [r.embedding for r in points.where(F.col("id") < CLUSTERS).orderBy("id").collect()]
    moved = kmeans.lloyd_step(points, centers)
    return moved.select("cluster", "n", r6(F.col("cost")).alias("cost"), F.posexplode_outer("center").alias("pos", "x")).select(
        "cluster", "n", "cost", "pos", r6(F.col("x")).alias("x"))


def pca_power_step(spark, sf):
    """The covariance times a block of fixed directions."""
    points = embeddings(spark, sf)
    count, mean, _ = power.moments(points)
    rows, columns = np.arange(DIM)[:, None], np.arange(DIRECTIONS)[None, :]
    block = ((rows * (columns + 2) + columns) % 7 - 3).astype(float)
    image = power.covariance_times(points, mean, block).select("coordinate", F.posexplode("image").alias("direction", "x"))
    return image.select("coordinate", "direction", r6(F.col("x") / (count - 1)).alias("x"))


def text_profile_merged(spark, sf):
    """Statistics of text lengths, merged from those of files; a quantile is
    right if its place among the lengths is, within the sketches' bound."""
    path = tables.new_shared_path(spark, "lengths")
    lengths = tables.read_table(spark, f"{sf}/documents.parquet").select(F.length("text").alias("n"))
    lengths.repartition(4).write.parquet(path)
    files = tables.stored(sketches.file_statistics(spark.read.parquet(path), "n"), "statistics")
    merged = sketches.merged_statistics(files)
    found = merged.agg(F.map_from_entries(F.collect_list(F.struct("statistic", "value")))).scalar()
    slack, names = 3 * sketches.rank_error(), {f"{q:.0%}": q for q in st.QUARTILES}
    n, at = F.col("n"), {name: F.element_at(found, F.lit(name)) for name in names}
    within = [((F.avg((n < at[name]).cast("int")) <= q + slack) & (F.avg((n <= at[name]).cast("int")) >= q - slack)).alias(name)
              for name, q in names.items()]
    right = spark.read.parquet(path).where("n is not null").agg(*within)
    rows = right.select(F.inline(F.array(*[F.struct(F.lit(name).alias("statistic"), F.lit(None).cast("double").alias("value"),
                                                    F.col(f"`{name}`").alias("within")) for name in names])))
    exact = merged.where(~F.col("statistic").endswith("%"))
    return exact.select("statistic", r6(F.col("value")).alias("value"), F.lit(True).alias("within")).union(rows)


def search_colocated(spark, sf):
    """Hits of a search with their documents, which are laid out by id."""
    path = tables.new_shared_path(spark, "documents")
    colocated.write_colocated(documents(spark, sf), path, "id", BUCKETS)
    return scored(colocated.attach_colocated(hits(spark, sf), path)).select("qid", "rank", "id", "score", "title")


def index_documents_colocated(spark, sf):
    """An index next to its documents, both laid out by id."""
    paths = [tables.new_shared_path(spark, n) for n in ("documents", "index")]
    colocated.write_colocated(documents(spark, sf), paths[0], "id", BUCKETS)
    colocated.write_colocated(index(spark, sf), paths[1], "id", BUCKETS)
    docs, built = (colocated.read_colocated(spark, p) for p in paths)
    return docs.hint("merge").join(built, "id").select("id", "title", F.length("packed").alias("bytes"))


def cluster_vectors(spark, sf):
    return exploration.cluster_vectors(embeddings(spark, sf), "id", every=1).select("id", "cluster")


QUERIES = [
    text_filter_content, content_split, snippet, result_card, display_text, embed_hashed, embed_row_cap,
    embeddings_write_read, json_roundtrip, non_null_counts, valid_count, table_height, text_profile,
    text_profile_linear, sample_every_n,
    sample_every_n_files, dimension_check, index_profile, vector_normalize, vector_pad, rotate,
    unrotate_roundtrip, rotate_padded, unrotate_cut, codebook_step, codebook_fit, quantize_codes, quantize_histogram, pack_hex, unpack_codes,
    centroid_coordinates, dequantize, residual, residual_gamma, qjl_bits_hex, qjl_bits_values, index_build,
    index_build_padded, index_union, index_write_read, index_job, index_row_cap, index_stream_append, index_size_report, index_verify,
    reconstruction_error, query_lookup_table, score_one_query, search_mse, search_mse_tables, search_qjl, search_qjl_1bit,
    search_qjl_2bit, search_qjl_reference, search_padded, search_short_queries, search_stored, search_documents, search_documents_semi, search_text,
    search_questions, search_grid, search_grid_text, search_cells, search_cells_grouped, search_cells_all, search_cells_near,
    cell_ranges, search_cascade, search_cascade_2bit, search_standing, index_compacted, json_checked, json_rejected, pca_variance, pca_components, kmeans_step, cluster_vectors,
    pca_power_step, text_profile_merged, search_colocated, index_documents_colocated,
]
