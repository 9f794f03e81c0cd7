"""The registered queries in SQL, written from the definitions: rotations are
sums over sign matrices, codes are nearest centroids, scores are dot products."""

import math

import numpy as np

from checks.fixed import BROKEN_EVERY, CARDS, CLUSTERS, CODEBOOK, DIM, DIRECTIONS, INDEX_CAP, PADDED, PUSH, QUESTIONS, ROW_CAP, SAMPLE_EVERY, TOP_N

MSE, QJL = 42, 24
UNBIASED = repr(math.sqrt(math.pi / 2) / math.sqrt(DIM)) + "::DOUBLE"
REFERENCE = repr(math.sqrt(math.pi / 2) / DIM) + "::DOUBLE"

PAPERS = """papers AS (SELECT doc_id AS id, source || ' ' || lang AS title, text AS abstract,
  source AS authors FROM documents)"""
CONTENTS = PAPERS + """, contents AS (SELECT id, 'Title: ' || title || ' | Abstract: ' || abstract AS content
  FROM papers WHERE length(abstract) > 150 AND title IS NOT NULL)"""
SPACES = r"\t-\r\x1c-\x1f\x{85}\p{Z}"


def array(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def signs(seed: int, at: str, dim: int = DIM) -> str:
    flips = 1 - 2 * np.random.default_rng(seed).integers(0, 2, size=dim)
    return f"({array(flips)})[{at} + 1]"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def parity(a: str, b: str) -> str:
    return f"(1 - 2 * (bit_count(({a}) & ({b})) % 2))"


def rotation(name: str, source: str, seed: int, key: str = "id", dim: int = DIM) -> str:
    """name(key, i, y): rotated coordinates of source(key, j, x), which may have
    fewer than `dim`."""
    return f"""{name} AS (SELECT {key}, i, sum(x * {signs(seed, 'j', dim)} * {parity('i', 'j')}) / sqrt({dim}) AS y
  FROM {source}, (SELECT unnest(range({dim})) AS i) GROUP BY {key}, i)"""


def unrotation(name: str, source: str, seed: int, value: str, dim: int = DIM, kept: int | None = None) -> str:
    """name(id, j, x): source(id, i, value) turned back, the first `kept`."""
    return f"""{name} AS (SELECT id, j, sum({value} * {parity('i', 'j')}) / sqrt({dim}) * {signs(seed, 'j', dim)} AS x
  FROM {source}, (SELECT unnest(range({kept or dim})) AS j) GROUP BY id, j)"""


RAW = """raw AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)"""
UNITS = """, lengths AS (SELECT id, sqrt(sum(x * x)) AS n FROM raw GROUP BY id),
unit AS (SELECT id, j, CASE WHEN n > 0 THEN x / n ELSE 0 END AS x FROM raw JOIN lengths USING (id))"""
UNIT = RAW + UNITS
# Vectors of another dimension than a power of two, and not of length one.
LONGER = f"list_concat(embedding, list_transform(embedding[1:{PADDED - DIM}], lambda v: v / 2))"
WIDE_RAW = f"""raw AS (SELECT vec_id AS id, unnest({LONGER})::DOUBLE AS x, unnest(range({PADDED})) AS j FROM embeddings)"""
WIDE = 2 * DIM


def code(value: str, bits: int) -> str:
    """Nearest centroid: the number of borders below the value."""
    table = CODEBOOK[bits]
    borders = [(a + b) / 2 for a, b in zip(table, table[1:])]
    return "(" + " + ".join(f"(round({value}, 12) > {border!r}::DOUBLE)::INT" for border in borders) + ")"


def coded(name: str, source: str, bits: int) -> str:
    """name(id, i, y, code, c): codes and centroids of source(id, i, y)."""
    return (f"{name}_codes AS (SELECT id, i, y, {code('y', bits)} AS code FROM {source}), "
            f"{name} AS (SELECT *, ({array(CODEBOOK[bits])})[code + 1] AS c FROM {name}_codes)")


def byte_hex(name: str, source: str, value: str, bits: int, out: str) -> str:
    slots = 8 // bits
    return f"""{name}_bytes AS (SELECT id, i // {slots} AS p,
  sum(({value}) << ({bits} * ({slots - 1} - i % {slots}))) AS b FROM {source} GROUP BY id, i // {slots}),
{name} AS (SELECT id, string_agg(printf('%02X', b::INT), '' ORDER BY p) AS {out} FROM {name}_bytes GROUP BY id)"""


def index(bits: int = 4, unit: str = UNIT, reference: bool = False, p: str = "", dim: int = DIM,
          kept: int = DIM) -> str:
    """CTEs rot, q (codes), rec, res, gam, sk (sign bits) of an index."""
    residual = "r.x - u.x" if reference else "u.x - r.x"
    return ", ".join([
        unit, rotation(f"rot{p}", "unit", MSE, dim=dim), coded(f"q{p}", f"rot{p}", bits),
        unrotation(f"rec{p}", f"q{p}", MSE, "c", dim, kept),
        f"res{p} AS (SELECT u.id, u.j, {residual} AS x FROM unit u JOIN rec{p} r ON u.id = r.id AND u.j = r.j)",
        f"gam{p} AS (SELECT id, sqrt(sum(x * x))::FLOAT::DOUBLE AS gamma FROM res{p} GROUP BY id)",
        rotation(f"resrot{p}", f"res{p}", QJL, dim=dim),
        f"sk{p} AS (SELECT id, i, (round(y, 12) > 0)::INT AS bit FROM resrot{p})",
    ])


def index_rows(bits: int = 4, **options) -> str:
    return (f"WITH {index(bits, **options)}, {byte_hex('ph', 'q', 'code', bits, 'packed')}, "
            f"{byte_hex('bh', 'sk', 'bit', 1, 'qjl_bits')} "
            f"SELECT {bits} AS n_bits, id, packed, {r6('gamma')} AS gamma, qjl_bits "
            "FROM ph JOIN gam USING (id) JOIN bh USING (id)")


LABELS = """asked AS (SELECT label AS qid, j, avg(x) AS x FROM
  (SELECT label::BIGINT AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j
   FROM embeddings) GROUP BY label, j)"""


def scores(asked: str, sketch: bool, scale: str, top_n: int, dim: int = DIM) -> str:
    """CTE hits(qid, id, score, rank); `asked` defines asked(qid, j, x)."""
    parts = [asked, rotation("aq", "asked", MSE, "qid", dim),
             "mse AS (SELECT qid, id, sum(aq.y * q.c) AS s FROM q JOIN aq ON q.i = aq.i GROUP BY qid, id)"]
    if sketch:
        parts += [rotation("sq", "asked", QJL, "qid", dim),
                  "dots AS (SELECT qid, id, sum(sq.y * (2 * bit - 1)) AS s FROM sk JOIN sq ON sk.i = sq.i GROUP BY qid, id)",
                  f"""total AS (SELECT m.qid, m.id, m.s + {scale} * gamma * d.s AS s FROM mse m
  JOIN dots d ON m.qid = d.qid AND m.id = d.id JOIN gam ON gam.id = m.id)"""]
    else:
        parts.append("total AS (SELECT * FROM mse)")
    parts.append(f"""hits AS (SELECT qid, id, round(s, 9) AS score, row_number() OVER
  (PARTITION BY qid ORDER BY round(s, 9) DESC, id)::INT AS rank FROM total QUALIFY rank <= {top_n})""")
    return ", ".join(parts)


def label_hits(bits: int = 4, sketch: bool = True, reference: bool = False) -> str:
    scale = REFERENCE if reference else UNBIASED
    return f"{index(bits, reference=reference)}, {scores(LABELS, sketch, scale, TOP_N)}"


PADDED_INDEX = {"unit": WIDE_RAW + UNITS, "dim": WIDE, "kept": PADDED}
PADDED_LABELS = f"""asked AS (SELECT label AS qid, j, avg(x) AS x FROM
  (SELECT label::BIGINT AS label, unnest({LONGER})::DOUBLE AS x, unnest(range({PADDED})) AS j FROM embeddings) GROUP BY label, j)"""
PADDED_SCALE = repr(math.sqrt(math.pi / 2) / math.sqrt(WIDE)) + "::DOUBLE"
PADDED_HITS = f"{index(**PADDED_INDEX)}, {scores(PADDED_LABELS, True, PADDED_SCALE, TOP_N, WIDE)}"

# Vectors that form groups: every label's are moved along an axis of its own.
MOVED = f"(x + CASE WHEN j = label * 6 THEN {PUSH} ELSE 0 END::FLOAT)::FLOAT::DOUBLE"
GROUPED_RAW = f"""raw AS (SELECT id, j, {MOVED} AS x FROM (SELECT vec_id AS id, label, unnest(embedding) AS x,
  generate_subscripts(embedding, 1) - 1 AS j FROM embeddings))"""
GROUPED_LABELS = f"""asked AS (SELECT label::BIGINT AS qid, j, avg({MOVED}) AS x FROM (SELECT label, unnest(embedding) AS x,
  generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) GROUP BY label, j)"""
GROUPED_HITS = f"{index(unit=GROUPED_RAW + UNITS)}, {scores(GROUPED_LABELS, True, UNBIASED, TOP_N)}"
SPOILED = f"spoiled AS (SELECT *, id % {BROKEN_EVERY} AS turn FROM papers)"

HITS = f"SELECT qid, id, {r6('score')} AS score, rank FROM hits"


def words(name: str, source: str, key: str, text: str) -> str:
    """name(key, j, x): hashed words of length one, as 32-bit floats."""
    return f"""{name}_words AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}),
{name}_hashes AS (SELECT {key}, ('0x' || substring(md5(w), 1, 5))::INT AS h FROM {name}_words),
{name}_counts AS (SELECT {key}, (h // 16) % {DIM} AS j, sum(1 - 2 * (h % 2)) AS n FROM {name}_hashes GROUP BY ALL),
{name}_grid AS (SELECT {key}, j, coalesce(n, 0)::DOUBLE AS n FROM
  (SELECT {key}, unnest(range({DIM})) AS j FROM {source}) LEFT JOIN {name}_counts USING ({key}, j)),
{name}_norms AS (SELECT {key}, sqrt(sum(n * n)) AS len FROM {name}_grid GROUP BY {key}),
{name} AS (SELECT {key}, j, CASE WHEN len > 0 THEN n / len ELSE 0 END::FLOAT::DOUBLE AS x
  FROM {name}_grid JOIN {name}_norms USING ({key}))"""


TEXT_UNIT = f"""{CONTENTS}, {words('raw', 'contents', 'id', 'content')},
lengths AS (SELECT id, sqrt(sum(x * x)) AS n FROM raw GROUP BY id),
unit AS (SELECT id, j, CASE WHEN n > 0 THEN x / n ELSE 0 END AS x FROM raw JOIN lengths USING (id))"""
BENCHMARK = "texts AS (SELECT item_id AS qid, text FROM benchmark WHERE length(text) > 0), " + words("asked", "texts", "qid", "text")
ASKED = ("texts AS (SELECT * FROM (VALUES " + ", ".join(f"({q}::BIGINT, '{t}')" for q, t in QUESTIONS)
         + ") v(qid, text)), " + words("asked", "texts", "qid", "text"))



def strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{SPACES}]+|[{SPACES}]+\z', '', 'g')"


def snippet() -> str:
    line = f"replace({strip("coalesce(abstract, '')")}, chr(10), ' ')"
    return (f"CASE WHEN length({line}) > 280 THEN "
            rf"regexp_replace(substring({line}, 1, 280), ' [^ ]*\z', '') || '…' ELSE {line} END")


TITLE, ABSTRACT, SNIPPET = strip("title"), strip("abstract"), snippet()


def describe(nearest: bool) -> str:
    def at(place):
        return f"(SELECT v FROM ranked WHERE rn = {place})"

    rows = ["SELECT 'count' AS statistic, count(v)::DOUBLE AS value FROM lens",
            "SELECT 'null_count', count(*) FILTER (WHERE v IS NULL)::DOUBLE FROM lens",
            "SELECT 'mean', avg(v) FROM lens", "SELECT 'std', stddev_samp(v) FROM lens",
            "SELECT 'min', min(v)::DOUBLE FROM lens"]
    for q in (0.25, 0.5, 0.75):
        place = f"((SELECT count(v) FROM lens) - 1) * {q}"
        value = at(f"floor({place} + 0.5)") if nearest else f"(SELECT quantile_cont(v, {q}) FROM lens)"
        rows.append(f"SELECT '{q:.0%}', {value}::DOUBLE")
    rows.append("SELECT 'max', max(v)::DOUBLE FROM lens")
    return ("WITH lens AS (SELECT length(text) AS v FROM documents), "
            "ranked AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn FROM lens WHERE v IS NOT NULL), "
            f"stats AS ({' UNION ALL '.join(rows)}) SELECT statistic, {r6('value')} AS value FROM stats")


def coordinates(ctes: str, source: str, pos: str, value: str) -> str:
    return f"WITH {ctes} SELECT id, {pos}::INT AS pos, {r6(value)} AS x FROM {source}"


ROT = f"{RAW}, {rotation('rot', 'raw', MSE)}"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def packed_hex() -> str:
    ctes = [ROT]
    for b in (1, 2, 4):
        ctes += [coded(f"q{b}", "rot", b), byte_hex(f"h{b}", f"q{b}", "code", b, "hex")]
    return f"WITH {', '.join(ctes)} " + union(f"SELECT id, {b} AS bits, hex FROM h{b}" for b in (1, 2, 4))


def nearest_codes() -> str:
    """Codes by smallest distance to the literal centroids, not by borders."""
    table = ", ".join(f"({i}, {c!r}::DOUBLE)" for i, c in enumerate(CODEBOOK[4]))
    return f"""WITH {ROT}, book(idx, c) AS (VALUES {table}),
near AS (SELECT id, i, idx, row_number() OVER (PARTITION BY id, i ORDER BY abs(y - c), idx) AS place FROM rot, book)
SELECT id, i::INT AS pos, idx AS code FROM near WHERE place = 1"""


def lookup_table() -> str:
    left, right = (f"({array(CODEBOOK[4])})[{c} + 1]" for c in ("byte // 16", "byte % 16"))
    return f"""WITH {LABELS}, {rotation('aq', 'asked', MSE, 'qid')}, pairs AS (SELECT a.qid, a.i // 2 AS position,
  a.y AS high, b.y AS low FROM aq a JOIN aq b ON a.qid = b.qid AND b.i = a.i + 1 WHERE a.i % 2 = 0)
SELECT qid, position::INT AS position, byte::INT AS byte, {r6(f'high * {left} + low * {right}')} AS value
FROM pairs, (SELECT unnest(range(256)) AS byte)"""


def step() -> str:
    parts, ctes = [], [ROT]
    for b in CODEBOOK:
        ctes.append(coded(f"q{b}", "rot", b))
        parts.append(f"SELECT {b} AS bits, code AS idx, {r6('count(*)::DOUBLE')} AS weight, {r6('avg(y)')} AS centroid, "
                     f"{r6('sum((y - c) * (y - c))')} AS spread FROM q{b} GROUP BY code")
    return f"WITH {', '.join(ctes)} {union(parts)}"


def histogram() -> str:
    ctes = [ROT] + [coded(f"q{b}", "rot", b) for b in CODEBOOK]
    return f"WITH {', '.join(ctes)} " + union(
        f"SELECT {b} AS bits, code, count(*) AS n FROM q{b} GROUP BY code" for b in CODEBOOK)


def errors() -> str:
    ctes = [UNIT, rotation("rot", "unit", MSE)]
    for b in (1, 2, 4):
        ctes += [coded(f"q{b}", "rot", b), unrotation(f"rec{b}", f"q{b}", MSE, "c")]
    return f"WITH {', '.join(ctes)} " + union(
        f"""SELECT {b} AS bits, {r6('avg(e)')} AS mse FROM (SELECT sum((u.x - r.x) * (u.x - r.x)) AS e
  FROM unit u JOIN rec{b} r ON u.id = r.id AND u.j = r.j GROUP BY u.id)""" for b in (1, 2, 4))


def sizes() -> str:
    per_row = {"embedding": 4 * DIM, "rotated": 4 * DIM, "codes": DIM, "packed": DIM // 2, "gamma": 4, "qjl_bits": DIM // 8}
    return union(f"SELECT '{n}' AS representation, count(*) * {b} AS bytes, {r6(f'count(*) * {b} / 1048576')} AS megabytes "
                 "FROM embeddings" for n, b in per_row.items())


def profile() -> str:
    columns = [("id", "bigint"), ("packed", "binary"), ("gamma", "float"), ("qjl_bits", "binary"),
               ("n_bits", "int"), ("mse_seed", "int"), ("qjl_seed", "int")]
    return union(f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count(*) AS rows FROM embeddings"
                 for i, (c, t) in enumerate(columns))


TEXT_INDEX = index(unit=TEXT_UNIT)
BENCHMARK_HITS = f"{TEXT_INDEX}, {scores(BENCHMARK, True, UNBIASED, TOP_N)}"
QUESTION_HITS = f"{TEXT_INDEX}, {scores(ASKED, True, UNBIASED, CARDS)}"

SQL = {
    "text_filter_content": f"WITH {CONTENTS} SELECT id, content FROM contents",
    "content_split": f"""WITH {CONTENTS}, cut AS (SELECT id, content, position(' | Abstract: ' IN content) AS p FROM contents)
SELECT id, {strip('substring(content, 1, p - 1)')} AS title_part,
  {strip('substring(content, p + 13)')} AS abstract_part FROM cut""",
    "snippet": f"WITH {PAPERS} SELECT id, {SNIPPET} AS snippet FROM papers",
    "result_card": f"""WITH {PAPERS} SELECT id, {TITLE} AS title, {SNIPPET} AS snippet, authors, {ABSTRACT} AS abstract,
  'https://arxiv.org/abs/' || id::VARCHAR AS link FROM papers""",
    "display_text": f"""WITH {PAPERS} SELECT id, replace({TITLE}, chr(10), '') AS title,
  replace({ABSTRACT}, chr(10), ' ') AS abstract FROM papers""",
    "embed_hashed": coordinates(f"{CONTENTS}, {words('v', 'contents', 'id', 'content')}", "v", "j", "x"),
    "embed_row_cap": f"WITH {CONTENTS} SELECT id, content FROM contents ORDER BY id LIMIT {ROW_CAP}",
    "embeddings_write_read": f"WITH {CONTENTS} SELECT id::VARCHAR AS id, content, {DIM} AS dim FROM contents",
    "json_roundtrip": f"WITH {PAPERS} SELECT id::VARCHAR AS id, title, abstract, authors FROM papers",
    "non_null_counts": f"WITH {PAPERS} " + union(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM papers" for c in ("id", "title", "abstract", "authors")),
    "valid_count": "SELECT count(*) AS rows FROM documents WHERE length(text) > 150",
    "table_height": "SELECT count(*) AS rows FROM embeddings",
    "text_profile": describe(nearest=True),
    "text_profile_linear": describe(nearest=False),
    "sample_every_n": f"""WITH {PAPERS}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM papers)
SELECT id, title, abstract FROM numbered WHERE n % {SAMPLE_EVERY} = 0""",
    "sample_every_n_files": f"""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
SELECT doc_id, source, text FROM numbered WHERE n % {SAMPLE_EVERY} = 0""",
    "dimension_check": "SELECT len(embedding)::INT AS dim, count(*) AS vectors FROM embeddings GROUP BY 1",
    "index_profile": profile(),
    "vector_normalize": coordinates(WIDE_RAW + UNITS, "unit", "j", "x"),
    "rotate_padded": coordinates(f"{WIDE_RAW}, {rotation('rot', 'raw', MSE, dim=WIDE)}", "rot", "i", "y"),
    "unrotate_cut": coordinates(WIDE_RAW, "raw", "j", "x"),
    "index_build_padded": index_rows(**PADDED_INDEX),
    "search_padded": f"WITH {PADDED_HITS} {HITS}",
    "search_short_queries": f"WITH {label_hits()} {HITS}",
    "search_stored": f"WITH {label_hits()} {HITS}",
    "index_row_cap": f"SELECT * FROM ({index_rows()}) WHERE id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {INDEX_CAP})",
    "vector_pad": coordinates(f"{RAW}, ids AS (SELECT vec_id AS id, unnest(range({2 * DIM})) AS j FROM embeddings)",
                              "ids LEFT JOIN raw USING (id, j)", "j", "coalesce(x, 0)"),
    "rotate": coordinates(ROT, "rot", "i", "y"),
    "unrotate_roundtrip": coordinates(RAW, "raw", "j", "x"),
    "codebook_step": step(),
    "quantize_codes": nearest_codes(),
    "quantize_histogram": histogram(),
    "pack_hex": packed_hex(),
    "unpack_codes": f"WITH {UNIT}, {rotation('rot', 'unit', MSE)}, {coded('q', 'rot', 2)} SELECT id, i::INT AS pos, code FROM q",
    "centroid_coordinates": coordinates(f"{UNIT}, {rotation('rot', 'unit', MSE)}, {coded('q', 'rot', 4)}", "q", "i", "c"),
    "dequantize": coordinates(index(), "rec", "j", "x"),
    "residual": coordinates(index(), "res", "j", "x::FLOAT::DOUBLE"),
    "residual_gamma": f"""WITH {index()} SELECT id, {r6('sqrt(sum(x * x))')} AS gamma FROM res GROUP BY id""",
    "qjl_bits_hex": f"WITH {index()}, {byte_hex('bh', 'sk', 'bit', 1, 'hex')} SELECT id, hex FROM bh",
    "qjl_bits_values": f"WITH {index()} SELECT id, i::INT AS pos, bit FROM sk",
    "index_build": index_rows(),
    "index_union": f"SELECT * FROM ({index_rows(1)}) UNION ALL SELECT * FROM ({index_rows(2)})",
    "index_write_read": index_rows(),
    "index_job": index_rows(),
    "index_stream_append": index_rows(),
    "index_size_report": sizes(),
    "index_verify": f"""WITH {index()} SELECT count(*) AS rows, 0::BIGINT AS wrong_codes, true AS invertible,
  {r6('avg(e)')} AS mean_squared_error FROM (SELECT sum(x * x) AS e FROM res GROUP BY id)""",
    "reconstruction_error": errors(),
    "query_lookup_table": lookup_table(),
    "score_one_query": f"""WITH {index()}, asked AS (SELECT 0 AS qid, j, avg(x) AS x FROM raw GROUP BY j),
{rotation('aq', 'asked', MSE, 'qid')}, {rotation('sq', 'asked', QJL, 'qid')},
mse AS (SELECT id, sum(aq.y * q.c) AS m FROM q JOIN aq USING (i) GROUP BY id),
dots AS (SELECT id, sum(sq.y * (2 * bit - 1)) AS d FROM sk JOIN sq USING (i) GROUP BY id)
SELECT id, {r6('m')} AS mse_score, {r6('d')} AS qjl_dot, {r6(UNBIASED + ' * gamma * d')} AS qjl_score,
  {r6('m + ' + UNBIASED + ' * gamma * d')} AS score FROM mse JOIN dots USING (id) JOIN gam USING (id)""",
    "search_mse": f"WITH {label_hits(sketch=False)} {HITS}",
    "search_mse_tables": f"WITH {label_hits(sketch=False)} {HITS}",
    "search_qjl": f"WITH {label_hits()} {HITS}",
    "search_qjl_1bit": f"WITH {label_hits(1)} {HITS}",
    "search_qjl_2bit": f"WITH {label_hits(2)} {HITS}",
    "search_qjl_reference": f"WITH {label_hits(reference=True)} {HITS}",
    **{name: f"WITH {label_hits()} {HITS}" for name in (
        "search_grid", "search_cells", "search_cells_all", "search_cascade", "search_cascade_2bit", "search_standing")},
    "search_cells_grouped": f"WITH {GROUPED_HITS} {HITS}",
    "search_grid_text": f"WITH {BENCHMARK_HITS} {HITS}",
    "cell_ranges": f"""WITH {index()}, far AS (SELECT id, sqrt(sum(c * c)) AS d FROM q GROUP BY id)
SELECT count(*) AS n, (SELECT {r6('max(gamma)')} FROM gam) AS gamma, (SELECT {r6('max(d)')} FROM far) AS radius,
  i::INT AS pos, min(code) AS low, max(code) AS high FROM q GROUP BY i""",
    "kmeans_step": f"""WITH {RAW}, d AS (SELECT a.id, b.id AS c, round(sum((a.x - b.x) * (a.x - b.x)), 9) AS cost
  FROM raw a JOIN raw b ON a.j = b.j WHERE b.id < {CLUSTERS} GROUP BY a.id, b.id),
near AS (SELECT id, c, cost FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, c) = 1),
size AS (SELECT c, count(*) AS n, sum(cost) AS cost FROM near GROUP BY c)
SELECT c::INT AS cluster, n, {r6('size.cost')} AS cost, j::INT AS pos, {r6('avg(x)')} AS x
FROM raw JOIN near USING (id) JOIN size USING (c) GROUP BY c, n, size.cost, j""",
    "pca_power_step": f"""WITH {RAW}, middle AS (SELECT j, avg(x) AS m FROM raw GROUP BY j),
centered AS (SELECT id, j, x - m AS x FROM raw JOIN middle USING (j)),
along AS (SELECT id, c, sum(x * ((j * (c + 2) + c) % 7 - 3)) AS y FROM centered, range({DIRECTIONS}) AS d(c) GROUP BY id, c)
SELECT j::INT AS coordinate, c::INT AS direction, {r6('sum(x * y) / (count(*) - 1)')} AS x
FROM centered JOIN along USING (id) GROUP BY j, c""",
    "text_profile_merged": f"""WITH n AS (SELECT length(text) AS n FROM documents), whole AS (SELECT unnest([
  {{'statistic': 'count', 'value': count(n)::DOUBLE}}, {{'statistic': 'null_count', 'value': (count(*) - count(n))::DOUBLE}},
  {{'statistic': 'mean', 'value': {r6('avg(n)')}}}, {{'statistic': 'min', 'value': min(n)::DOUBLE}},
  {{'statistic': 'max', 'value': max(n)::DOUBLE}}, {{'statistic': '25%', 'value': NULL}},
  {{'statistic': '50%', 'value': NULL}}, {{'statistic': '75%', 'value': NULL}}], recursive := true) FROM n)
SELECT statistic, value, true AS within FROM whole""",
    "search_colocated": f"""WITH {label_hits()}, {PAPERS} SELECT qid, rank, id, {r6('score')} AS score, title
FROM hits JOIN papers USING (id)""",
    "index_documents_colocated": f"""WITH {PAPERS} SELECT id, title, {DIM // 2}::INT AS bytes
FROM papers JOIN embeddings ON id = vec_id""",
    "index_compacted": index_rows(),
    "json_checked": f"""WITH {PAPERS}, {SPOILED} SELECT id::VARCHAR AS id, title, abstract, authors,
  CASE WHEN turn = 4 THEN 'x' END AS venue FROM spoiled WHERE turn NOT IN (1, 2, 3)""",
    "json_rejected": f"""WITH {PAPERS}, {SPOILED} SELECT CASE turn WHEN 1 THEN 'not JSON' WHEN 2 THEN 'wrong type' ELSE 'no key' END AS reason,
  count(*) AS rows, true AS numbered FROM spoiled WHERE turn IN (1, 2, 3) GROUP BY turn""",
    "search_documents": f"""WITH {label_hits()}, {PAPERS} SELECT qid, rank, id, {r6('score')} AS score, title
FROM hits JOIN papers USING (id)""",
    "search_documents_semi": f"WITH {label_hits()}, {PAPERS} SELECT id, title FROM papers WHERE id IN (SELECT id FROM hits)",
    "search_text": f"WITH {BENCHMARK_HITS} SELECT qid, rank, id, {r6('score')} AS score, title FROM hits JOIN papers USING (id)",
    "search_questions": f"""WITH {QUESTION_HITS} SELECT qid, rank, id, {r6('score')} AS score, {TITLE} AS title,
  {SNIPPET} AS snippet, 'https://arxiv.org/abs/' || id::VARCHAR AS link FROM hits JOIN papers USING (id)""",
}
