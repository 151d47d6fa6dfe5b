"""The registered queries, one or more a kernel of the library, and their SQL.

The tables have no pictures, so kernels run on columns of the same shape: the embeddings read
as a plane of samples, extents from line items, file names from page addresses, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, levels, numbers, rules, text
from ..operators import archive, errors, lines, samples, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Knots of a sample curve, and coefficients of sample lens polynomials.
KNOTS = [(0.0, 1.0), (0.01, 1.02), (0.02, 1.05), (0.03, 1.04), (0.04, 1.1), (0.05, 1.2), (0.06, 1.15), (0.07, 1.3), (0.08, 1.35), (0.09, 1.5)]
WARP, GAIN = [0.98, 0.03, -0.01, 0.002], [0.5, 0.2, -0.05, 0.01, 0.003]
BLACK, WHITE = [15600.0, 15700.0, 15650.0, 15800.0], 47000.0
MATRIX = [[1.6, -0.4, -0.2], [-0.3, 1.5, -0.2], [0.1, -0.6, 1.5]]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): the embeddings as rows of 16-bit samples."""
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return long.select("y", F.col("x").cast("bigint").alias("x"), F.floor((F.col("e").cast("double") + 1) * 32767.5).cast("bigint").alias("v"))


def picture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, line): the same as pictures, a hundred lines each."""
    value = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 32767.5).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("image"), (F.col("vec_id") % 100).alias("y"), value.alias("line"))


PICTURES = "pics AS (SELECT y // 100 AS image, y % 100 AS y, x, v FROM plane)"
PLANE = """plane AS (
  SELECT vec_id AS y, CAST(i AS BIGINT) AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 32767.5) AS BIGINT) AS v
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM embeddings)
)"""


def with_plane(body: str) -> str:
    return f"WITH {PLANE}{body}"


HEX = "lower(lpad(to_hex(v & 255), 2, '0') || lpad(to_hex(v >> 8), 2, '0'))"
rounded = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# Digests


@query(
    with_plane(f""", {PICTURES}, tiles AS (
  SELECT image, y // 64 AS ty, x // 64 AS tx, md5(unhex(string_agg({HEX}, '' ORDER BY y, x))) AS d FROM pics GROUP BY 1, 2, 3
) SELECT image, md5(unhex(string_agg(d, '' ORDER BY ty, tx))) AS digest, count(*) AS n FROM tiles GROUP BY 1""")
)
def digest_tiles(spark, sf_dir):
    return lines.image_digests(picture_lines(spark, sf_dir), ["image"], 64)


@query(with_plane(f" SELECT y // 100 AS image, md5(unhex(string_agg({HEX}, '' ORDER BY y, x))) AS digest FROM plane GROUP BY 1"))
def digest_linear(spark, sf_dir):
    return lines.linear_digests(picture_lines(spark, sf_dir), ["image"])


@query("SELECT source, doc_id // 100 AS part, md5(unhex(string_agg(md5(text), '' ORDER BY doc_id))) AS digest, count(*) AS n FROM documents GROUP BY 1, 2")
def digest_chunks(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", F.md5("text").alias("d"))
    return samples.digest_of_digests(parts, ["source", "part"], "doc_id", "d")


@query(f"SELECT doc_id, strlen(text) AS size, md5(text) AS md5, '{text.RECORD_PREFIX}' || strlen(text) || ', MD5 ' || md5(text) AS record FROM documents")
def file_fingerprint(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size"), F.md5("text").alias("md5"))
    return found.withColumn("record", text.record_text(F.col("size"), F.col("md5")))


DAMAGE = "CASE doc_id % 6 WHEN 1 THEN upper(r) WHEN 2 THEN r || ' ' WHEN 3 THEN r || ', sidecar MD5 ' || md5(lang) WHEN 4 THEN replace(r, 'size ', 'size 99999999999') ELSE r END"


@query(
    f"""WITH r AS (SELECT doc_id, lang, '{text.RECORD_PREFIX}' || strlen(text) || ', MD5 ' || md5(text) AS r FROM documents),
t AS (SELECT doc_id, {DAMAGE} AS t FROM r),
p AS (SELECT doc_id, regexp_extract(t, '^{text.RECORD_PREFIX}([0-9]{{1,20}}), MD5 ([0-9a-f]{{32}})(?:, sidecar MD5 ([0-9a-f]{{32}}))?$', ['a', 'b', 'c']) AS m FROM t)
SELECT doc_id, m.a <> '' AS present, nullif(m.a, '') AS size, nullif(m.b, '') AS digest, nullif(m.c, '') AS sidecar FROM p"""
)
def record_parse(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", "lang", text.record_text(F.octet_length("text"), F.md5("text")).alias("r"))
    changed = made.select("doc_id", F.expr(DAMAGE).alias("t"))
    return changed.select("doc_id", text.parsed_record(F.col("t")).alias("p")).select("doc_id", "p.*").withColumn("size", F.col("size").cast("string"))


# Files and names


@query("SELECT page_id, url, lower(regexp_extract(url, '[^/](\\.[^./]*)$', 1)) AS ext FROM pages WHERE lower(regexp_extract(url, '[^/](\\.[^./]*)$', 1)) IN ('.html', '.com', '.org', '.net', '')")
def scan_filter(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", "url", text.extension(F.col("url")).alias("ext"))
    return found.where(F.col("ext").isin(".html", ".com", ".org", ".net", ""))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[\\x00-\\x1F\\x7F:]', '', 'g'), '[ .]+$', '') AS name FROM pages")
def bare_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.bare_name(F.col("url")).alias("name"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[^ -~]', '', 'g'))) AS clean FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean"))


@query(
    """SELECT p_partkey, CASE WHEN starts_with(lower(p_name), lower(p_brand)) THEN p_name ELSE trim(concat_ws(' ', p_brand, p_name)) END AS model,
lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS normal, format('{:.1f} MB', p_retailprice * 12345 / 1048576.0) AS megabytes FROM part"""
)
def model_name(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        text.unique_model(F.col("p_brand"), F.col("p_name")).alias("model"),
        text.normalised_name(F.col("p_brand")).alias("normal"),
        text.megabytes(F.col("p_retailprice") * 12345).alias("megabytes"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS exif, CASE WHEN o_custkey % 9 < 8 THEN [1, 2, 4, 3, 5, 8, 6, 7][o_custkey % 9 + 1] ELSE 1 END AS orientation FROM orders")
def exif_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.exif_time(F.col("o_orderdate")).alias("exif"), numbers.orientation(F.col("o_custkey") % 9).alias("orientation"))


# Matching, claims and updates


@query(
    """WITH i AS (SELECT c_custkey AS picture, upper(n_name) AS model, c_custkey % 3 + 2 AS planes FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT s_suppkey AS ord, s_nationkey % 4 AS profile, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE lower(n_name) || '.' END AS camera, s_suppkey % 2 + 2 AS profile_planes, CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 0 END AS policy FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT *, CASE WHEN planes <> profile_planes THEN 'planes' WHEN policy = 2 THEN 'policy' END AS reason FROM i JOIN p ON camera = '' OR lower(regexp_replace(camera, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(model, '[^A-Za-z0-9]', '', 'g')))
SELECT picture, model, planes, ord, profile, camera, profile_planes, policy,
coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY picture, profile, reason IS NULL ORDER BY ord) > 1 THEN 'twin' END, 'chosen') AS verdict FROM m"""
)
def profile_select(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    pictures = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("picture"), F.upper("n_name").alias("model"), (F.col("c_custkey") % 3 + 2).alias("planes"))
    profiles = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("ord"),
        (F.col("s_nationkey") % 4).alias("profile"),
        F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(F.concat(F.lower("n_name"), F.lit("."))).alias("camera"),
        (F.col("s_suppkey") % 2 + 2).alias("profile_planes"),
        F.when(F.col("s_suppkey") % 7 == 0, 2).otherwise(0).alias("policy"),
    )
    return archive.select_profiles(pictures, profiles)


@query("SELECT p_brand, p_type, arg_min(p_name, p_partkey) AS p_name, min(p_partkey) AS p_partkey, count(*) AS twins FROM part GROUP BY 1, 2")
def profile_distinct(spark, sf_dir):
    return archive.distinct_first(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name", "p_partkey"), ["p_brand", "p_type"], "p_partkey")


@query(
    """SELECT doc_id, lang || '/' || source AS target, CASE WHEN row_number() OVER w = 1 THEN 'kept' ELSE 'refused' END AS claim,
first_value(doc_id) OVER w AS holder FROM documents WINDOW w AS (PARTITION BY lang || '/' || source ORDER BY doc_id)"""
)
def target_clash(spark, sf_dir):
    jobs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("target"))
    return archive.claims(jobs, "target", ["doc_id"], "doc_id")


@query(
    """WITH t AS (SELECT l_orderkey AS k, max(l_shipdate) AS target_time FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
s AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL 60 DAY AS source_time, CASE WHEN o_custkey % 3 = 0 THEN o_orderdate + INTERVAL 80 DAY END AS sidecar_time FROM orders)
SELECT k, CASE WHEN target_time IS NULL THEN 'new' WHEN target_time >= greatest(source_time, coalesce(sidecar_time, source_time)) THEN 'up to date' ELSE 'stale' END AS state FROM s LEFT JOIN t USING (k)"""
)
def update_by_time(spark, sf_dir):
    targets = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("target_time"))
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("k"), F.expr("o_orderdate + INTERVAL 60 DAY").alias("source_time"), F.expr("CASE WHEN o_custkey % 3 = 0 THEN o_orderdate + INTERVAL 80 DAY END").alias("sidecar_time"))
    return archive.update_by_time(jobs, targets, "k").select("k", "state")


@query(
    """WITH s AS (SELECT doc_id, strlen(text) AS size, md5(text) AS digest, CASE WHEN doc_id % 4 <> 0 THEN md5(source) END AS sidecar FROM documents),
r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN size + 1 ELSE size END AS r_size, CASE WHEN doc_id % 13 = 0 THEN md5('x') ELSE digest END AS r_md5,
 CASE WHEN doc_id % 6 = 0 THEN md5('y') WHEN doc_id % 5 = 0 THEN NULL ELSE sidecar END AS r_sidecar FROM s WHERE doc_id % 7 <> 0),
j AS (SELECT s.doc_id, r_size IS NOT NULL AS known,
 CASE WHEN size <> r_size OR digest <> r_md5 THEN 'source changed' END AS a,
 CASE WHEN r_sidecar IS NOT NULL AND sidecar IS NULL THEN 'sidecar no longer there' WHEN r_sidecar IS NULL AND sidecar IS NOT NULL THEN 'sidecar added' WHEN r_sidecar <> sidecar THEN 'sidecar changed' END AS b
 FROM s LEFT JOIN r USING (doc_id))
SELECT doc_id, CASE WHEN NOT known THEN 'no record' WHEN a IS NULL AND b IS NULL THEN 'up to date' ELSE 'changed' END AS state, CASE WHEN known THEN concat_ws(', ', a, b) ELSE '' END AS what FROM j"""
)
def update_by_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sources = d.select("doc_id", "text", F.octet_length("text").alias("size"), F.when(F.col("doc_id") % 4 != 0, F.md5("source")).alias("sidecar_md5"))
    records = sources.where("doc_id % 7 <> 0").select(
        "doc_id",
        F.when(F.col("doc_id") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("r_size"),
        F.when(F.col("doc_id") % 13 == 0, F.md5(F.lit("x"))).otherwise(F.md5("text")).alias("r_md5"),
        F.when(F.col("doc_id") % 6 == 0, F.md5(F.lit("y"))).when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("sidecar_md5")).alias("r_sidecar"),
    )
    return archive.update_by_content(sources, records, "doc_id", F.md5("text")).select("doc_id", "state", "what")


@query(
    """WITH e AS (SELECT user_id, event_type, event_id % 2 AS half, max(event_id) AS last FROM events GROUP BY 1, 2, 3)
SELECT user_id, event_type, last FROM e WHERE half = 0
UNION ALL SELECT user_id, event_type, last FROM e b WHERE half = 1 AND NOT EXISTS (SELECT 1 FROM e a WHERE a.half = 0 AND a.user_id = b.user_id AND a.event_type = b.event_type)"""
)
def merge_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("half")).agg(F.max("event_id").alias("last"))
    return archive.merge_missing(e.where("half = 0").drop("half"), e.where("half = 1").drop("half"), ["user_id", "event_type"])


@query(
    """WITH c AS (SELECT l_orderkey AS k, min(CASE WHEN l_orderkey % 3 <> 0 THEN l_shipdate END) AS t FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS t FROM orders)
SELECT coalesce(c.k, d.k) AS k, strftime(coalesce(c.t, d.t), '%Y:%m:%d %H:%M:%S') AS t, CASE WHEN c.t IS NOT NULL THEN 'camera' WHEN d.t IS NOT NULL THEN 'decoder' END AS origin FROM c FULL JOIN d ON c.k = d.k"""
)
def override_merge(spark, sf_dir):
    camera = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_shipdate"))).alias("t"))
    decoder = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("t"))
    return archive.overridden(camera, decoder, ["k"], "t").withColumn("t", F.when(F.col("t").isNotNull(), text.exif_time(F.col("t"))))


KNOT_ROWS = ", ".join(f"({r}::DOUBLE, {v}::DOUBLE)" for r, v in KNOTS)


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY r) AS i, lead(r) OVER (ORDER BY r) AS r1, lead(v) OVER (ORDER BY r) AS v1 FROM (VALUES {KNOT_ROWS}) t(r, v)),
s AS (SELECT CASE WHEN i = 1 THEN '-inf'::DOUBLE ELSE r END AS low, CASE WHEN i = {len(KNOTS) - 1} THEN 'inf'::DOUBLE ELSE r1 END AS high, r, v, (v1 - v) / (r1 - r) AS slope FROM k WHERE r1 IS NOT NULL)
SELECT l_orderkey, l_linenumber, round(v + (l_discount * 1.1 - 0.005 - r) * slope, 6) AS factor FROM lineitem JOIN s ON l_discount * 1.1 - 0.005 >= low AND l_discount * 1.1 - 0.005 < high"""
)
def curve_interp(spark, sf_dir):
    knots = spark.createDataFrame(KNOTS, "radius double, value double")
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 1.1 - 0.005).alias("r"))
    return archive.interpolated(points, knots, [], "r", "factor").select("l_orderkey", "l_linenumber", rounded("factor"))


# Samples

PATTERN = "[" + ", ".join(f"{b}::DOUBLE" for b in BLACK) + "][(y % 2) * 2 + x % 2 + 1]"


@query(with_plane(f" SELECT y, x, CAST(round(greatest(0.0, least(1.0, (v - {PATTERN}) * (1.0::DOUBLE / {WHITE - max(BLACK)}::DOUBLE))) * 65535.0) AS INTEGER) AS linear FROM plane"))
def levels_linear(spark, sf_dir):
    return samples.linearised(plane(spark, sf_dir), BLACK, 2, 2, WHITE).select("y", "x", "linear")


def _neighbours(at: list[tuple[int, int]]) -> tuple[str, str]:
    looks = [f"(SELECT v FROM h b WHERE b.image = a.image AND b.y = a.y + {dy} AND b.x = a.x + {dx})" for dy, dx in at]
    return " + ".join(f"coalesce({s}, 0)" for s in looks), " + ".join(f"(CASE WHEN coalesce({s}, 0) > 0 THEN 1 ELSE 0 END)" for s in looks)


_DIAGONAL, _STRAIGHT = _neighbours([(-1, -1), (-1, 1), (1, -1), (1, 1)]), _neighbours([(-2, 0), (2, 0), (0, -2), (0, 2)])


@query(
    with_plane(f""", {PICTURES}, h AS (SELECT image, y, x, CASE WHEN (y * 31 + x * 17) % 97 = 0 THEN 0 ELSE v END AS v FROM pics),
z AS (SELECT image, y, x, CASE WHEN (y + x) % 2 = 1 THEN {_DIAGONAL[0]} ELSE {_STRAIGHT[0]} END AS t, CASE WHEN (y + x) % 2 = 1 THEN {_DIAGONAL[1]} ELSE {_STRAIGHT[1]} END AS n FROM h a WHERE v = 0)
SELECT image, y, x, CAST(CASE WHEN n > 0 THEN (t + n // 2) // n ELSE 0 END AS BIGINT) AS fixed FROM z""")
)
def defect_repair(spark, sf_dir):
    holes = picture_lines(spark, sf_dir).withColumn("line", F.transform("line", lambda v, x: F.when((F.col("y") * 31 + x * 17) % 97 == 0, 0).otherwise(v)))
    fixed = lines.to_samples(lines.repaired(holes, ["image"]), ["image"], ("line", "fixed"), ("v", "fixed"))
    return fixed.where("v = 0").drop("v")


_K = "27.0::DOUBLE * (v / 65535.0::DOUBLE) * power(15.0::DOUBLE / 16, 2)"
_R = f"cbrt({_K} + sqrt(power({_K}, 2) + 108.0::DOUBLE * power(1.0::DOUBLE / 16, 3) * power(15.0::DOUBLE / 16, 3)))"
_C2 = "cbrt(2.0::DOUBLE)"


@query(
    with_plane(f""", c AS (SELECT y, x, v / 65535.0::DOUBLE AS u, greatest(0.0, least(1.0, {_R} / (3 * {_C2} * (15.0::DOUBLE / 16)) - {_C2} * (1.0::DOUBLE / 16) / {_R})) AS e FROM plane)
SELECT y, x, round(e, 6) AS encoded, round(e / 16 + 15.0::DOUBLE / 16 * e * e * e, 6) AS back, round(u / 16 + 15.0::DOUBLE / 16 * u * u * u, 6) AS decoded FROM c""")
)
def lossy_curve(spark, sf_dir):
    u = F.col("v") / 65535.0
    e = levels.lossy_encode(u)
    return plane(spark, sf_dir).select("y", "x", rounded(e, "encoded"), rounded(levels.lossy_decode(e), "back"), rounded(levels.lossy_decode(u), "decoded"))


_TOE = "(u * u + 0.3 * 0.000625::DOUBLE) / (u * u + 0.000625::DOUBLE) / ((1 + 0.3 * 0.000625::DOUBLE) / (1 + 0.000625::DOUBLE))"


@query(
    with_plane(f""", s AS (SELECT y, x, round(v / 65535.0::DOUBLE * 16383) / 16383 AS u FROM plane), t AS (SELECT y, x, u, u * 2.5 / (1 + 1.5 * u) * {_TOE} AS t FROM s)
SELECT y, x, round(t, 6) AS tone, CAST(round((CASE WHEN t <= 0.0031308 THEN 12.92 * t ELSE 1.055 * power(t, 1.0::DOUBLE / 2.4) - 0.055 END) * 255) AS INTEGER) AS output FROM t""")
)
def tone_srgb(spark, sf_dir):
    u = F.col("v") / 65535.0
    step = F.round(u * 16383) / 16383
    return plane(spark, sf_dir).select("y", "x", rounded(levels.tone_curve(step), "tone"), levels.output_value(u).alias("output"))


def _polynomial(c: list[float]) -> str:
    out = f"{c[-1]}::DOUBLE"
    for k in reversed(c[:-1]):
        out = f"({k}::DOUBLE + r2 * {out})"
    return out


@query(with_plane(f""", r AS (SELECT y, x, ((y - 250) * (y - 250) + (x - 32) * (x - 32)) / 63524.0::DOUBLE AS r2 FROM plane)
SELECT y, x, round({_polynomial(WARP)}, 6) AS warp, round({_polynomial([1.0, *GAIN])}, 6) AS gain FROM r"""))
def warp_gain(spark, sf_dir):
    r = F.sqrt(((F.col("y") - 250) * (F.col("y") - 250) + (F.col("x") - 32) * (F.col("x") - 32)) / 63524.0)
    return plane(spark, sf_dir).select("y", "x", rounded(levels.warp(WARP, r), "warp"), rounded(levels.gain(GAIN, r), "gain"))


CELLS = "cells AS (SELECT y // 2 AS cy, x // 2 AS cx, (y % 2) + (x % 2) AS plane, avg(v - 15000.0::DOUBLE) AS mean, count(*) AS n FROM plane GROUP BY 1, 2, 3)"


def _cells(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 32767.5).cast("bigint")).alias("line"))
    made = errors.cell_means(own, [], 2, 2, [[0, 1], [1, 2]], [[15000.0]])
    across = made.select("cy", F.posexplode(F.arrays_zip("cells", "counts")).alias("cx", "c"))
    each = across.select("cy", F.col("cx").cast("bigint").alias("cx"), F.posexplode(F.arrays_zip(F.col("c.cells").alias("mean"), F.col("c.counts").alias("n"))).alias("plane", "m"))
    return each.select("cy", "cx", F.col("plane").cast("bigint").alias("plane"), "m.mean", "m.n").where("n > 0")


@query(with_plane(f", {CELLS} SELECT cy, cx, plane, round(mean, 6) AS mean, n FROM cells"))
def cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("cy", "cx", "plane", rounded("mean"), "n")


def _clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_ROWS = [" + ".join(f"{m}::DOUBLE * p{k}" for k, m in enumerate(row)) for row in MATRIX]


@query(
    with_plane(f""", {CELLS}, w AS (SELECT cy, cx, {", ".join(f"{_clip(f'max(CASE WHEN plane = {k} THEN mean END) / 30000.0::DOUBLE * {g}::DOUBLE')} AS p{k}" for k, g in enumerate((1.9, 1.0, 1.4)))} FROM cells GROUP BY 1, 2)
SELECT cy, cx, {", ".join(f"round({_clip(r)}, 6) AS {c}" for r, c in zip(_ROWS, ("red", "green", "blue")))} FROM w""")
)
def white_balance(spark, sf_dir):
    planes = _cells(spark, sf_dir).groupBy("cy", "cx").agg(*[levels.clamped(F.max(F.when(F.col("plane") == k, F.col("mean"))) / 30000.0 * g).alias(f"p{k}") for k, g in enumerate((1.9, 1.0, 1.4))])
    mixed = colour.white_balanced([F.col(f"p{k}") for k in range(3)], [1.0] * 3, MATRIX)
    return planes.select("cy", "cx", *[rounded(m, c) for m, c in zip(mixed, ("red", "green", "blue"))])


@query(
    with_plane(""", o AS (SELECT y, t, least(x + 1.0::DOUBLE, (t + 1) * (64.0::DOUBLE / 24)) - greatest(x::DOUBLE, t * (64.0::DOUBLE / 24)) AS w, v FROM plane, range(24) r(t) WHERE x + 1 > t * (64.0::DOUBLE / 24) AND x < (t + 1) * (64.0::DOUBLE / 24))
SELECT y, t AS x, round(sum(w / (64.0::DOUBLE / 24) * v), 4) AS v FROM o WHERE w > 1e-12 GROUP BY 1, 2""")
)
def area_shrink(spark, sf_dir):
    own = picture_lines(spark, sf_dir)
    height = F.max("y") + 1
    sizes = own.groupBy("image").agg(height.alias("height"), F.lit(64).alias("width"), height.alias("to_height"), F.lit(24).alias("to_width"))
    made = lines.to_samples(errors.shrunk(own, sizes, ["image"]), ["image"])
    return made.select((F.col("image") * 100 + F.col("y")).alias("y"), "x", F.round("v", 4).alias("v"))


def _stored(line: str, size: int, n: int) -> str:
    return f"(({line} % {n}) * ({size} // {n}) + least({line} % {n}, {size} % {n}) + {line} // {n})"


@query(with_plane(f" SELECT y, x, {_stored('x', 64, 3)} AS sx, {_stored('y % 500', 500, 7)} AS sy, v FROM plane"))
def interleave(spark, sf_dir):
    return plane(spark, sf_dir).select("y", "x", numbers.stored_line(F.col("x"), F.lit(64), F.lit(3)).alias("sx"), numbers.stored_line(F.col("y") % 500, F.lit(500), F.lit(7)).alias("sy"), "v")


@query(
    """WITH s AS (SELECT o_orderkey, o_orderkey % 5000 + 1 AS size, o_custkey % 6 + 1 AS factor),
f AS (SELECT *, (size + factor - 1) // factor AS f0 FROM s), c AS (SELECT *, (f0 + 255) // 256 AS n FROM f), t AS (SELECT *, ((f0 + n - 1) // n + 7) // 8 * 8 AS tile FROM c)
SELECT o_orderkey, tile, tile * n AS field, tile * n * factor AS padded, (tile * n * factor - size) // 2 AS pad,
CASE WHEN size + 3 >= size AND size >= 12 THEN size - 6 + (9 % 6) ELSE NULL END AS wrapped FROM t""".replace("AS factor)", "AS factor FROM orders)")
)
def axis_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5000 + 1).alias("size"), (F.col("o_custkey") % 6 + 1).alias("factor"))
    plan = numbers.axis_plan(F.col("size"), F.col("factor"), F.lit(256))
    wrapped = F.when(F.col("size") >= 12, numbers.margin_source(F.col("size") + 3, F.col("size"), F.lit(6)))
    return o.select("o_orderkey", plan.alias("p"), wrapped.alias("wrapped")).select("o_orderkey", "p.*", "wrapped")


RESIDUAL = f"""{PICTURES}, r AS (SELECT image, y, x, ((v - coalesce(lag(v) OVER (PARTITION BY image, y, x % 2 ORDER BY x), lag(v) OVER (PARTITION BY image, x ORDER BY y), 32768)) % 65536 + 65536) % 65536 AS m FROM pics),
d AS (SELECT image, y, x, CASE WHEN m > 32768 THEN m - 65536 ELSE m END AS difference FROM r),
k AS (SELECT *, CASE WHEN difference = 0 THEN 0 ELSE length(bin(abs(difference))) END AS category FROM d)"""


def _residuals(spark, sf_dir):
    found = lines.residuals(picture_lines(spark, sf_dir), ["image"], 2)
    return lines.to_samples(found, ["image"], ("difference", "category"), ("difference", "category"))


@query(with_plane(f", {RESIDUAL} SELECT image, y, x, difference, category FROM k"))
def residuals(spark, sf_dir):
    return _residuals(spark, sf_dir)


@query(with_plane(f", {RESIDUAL} SELECT image, category, count(*) AS n, CAST(sum(difference) AS BIGINT) AS total FROM k GROUP BY 1, 2"))
def residual_histogram(spark, sf_dir):
    return _residuals(spark, sf_dir).groupBy("image", "category").agg(F.count("*").alias("n"), F.sum("difference").alias("total"))


@query(
    with_plane(f""", {PICTURES}, n AS (SELECT image, y, x, v, lag(v) OVER (PARTITION BY image, y ORDER BY x) AS a, lag(v) OVER (PARTITION BY image, x ORDER BY y) AS b FROM pics),
m AS (SELECT *, lag(b) OVER (PARTITION BY image, y ORDER BY x) AS c FROM n)
SELECT image, y, x, v, a AS p1, b AS p2, c AS p3, a + b - c AS p4, a + ((b - c) >> 1) AS p5, b + ((a - c) >> 1) AS p6, (a + b) >> 1 AS p7 FROM m WHERE c IS NOT NULL""")
)
def predictors(spark, sf_dir):
    made = [f"p{k}" for k in range(1, 8)]
    found = lines.to_samples(lines.predictors(picture_lines(spark, sf_dir), ["image"]), ["image"], ("line", *made), ("v", *made))
    return found.withColumn("x", F.col("x") + 1)


NOISY = "pairs AS (SELECT y // 250 AS image, y, x, v, v + (y * 7 + x * 13) % 41 - 20 + CASE WHEN (y * 5 + x) % 997 = 0 THEN 900 ELSE 0 END AS stored FROM plane)"


def _noisy(spark, sf_dir):
    """(image, y, line, stored): two hundred and fifty lines a picture, and what a lossy copy might hold of them."""
    y = F.col("vec_id")
    value = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 32767.5).cast("bigint"))
    own = table(spark, sf_dir, "embeddings").select(F.floor(y / 250).alias("image"), y.alias("y"), value.alias("line"))
    noise = lambda v, x: (v + (F.col("y") * 7 + x * 13) % 41 - 20 + F.when((F.col("y") * 5 + x) % 997 == 0, 900).otherwise(0)).cast("bigint")
    return own.withColumn("stored", F.transform("line", noise))


@query(
    with_plane(f""", {NOISY}, d AS (SELECT *, (stored - v)::DOUBLE AS d FROM pairs),
w AS (SELECT image, avg(d) AS mean, sqrt(avg(d * d)) AS rms, count(*) AS n FROM d GROUP BY 1),
t AS (SELECT image, y // 64 AS ty, x // 64 AS tx, sqrt(avg(d * d)) AS s FROM d GROUP BY 1, 2, 3),
tw AS (SELECT image, s AS tile_rms, ty AS worst_ty, tx AS worst_tx FROM t QUALIFY row_number() OVER (PARTITION BY image ORDER BY s DESC, ty, tx) = 1),
b AS (SELECT image, max(m) AS block_mean FROM (SELECT image, y // 32, x // 32, abs(avg(d)) AS m FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 256) GROUP BY 1),
h AS (SELECT image, abs(d) AS e, count(*) AS c FROM d GROUP BY 1, 2),
p AS (SELECT image, e, sum(c) OVER (PARTITION BY image ORDER BY e) AS upto, sum(c) OVER (PARTITION BY image) AS n FROM h),
q AS (SELECT image, min(CASE WHEN upto >= n - n // 1000 THEN e END) AS p999, max(e) AS most FROM p GROUP BY 1)
SELECT image, w.n AS n, round(mean / 65535.0, 9) AS mean, round(rms / 65535.0, 9) AS rms, round(tile_rms / 65535.0, 9) AS tile_rms, worst_ty, worst_tx, round(block_mean / 65535.0, 9) AS block_mean, round(p999 / 65535.0, 9) AS p999, round(most / 65535.0, 9) AS most
FROM w JOIN tw USING (image) JOIN b USING (image) JOIN q USING (image)""")
)
def error_stats(spark, sf_dir):
    found = errors.error_statistics(_noisy(spark, sf_dir), ["image"], 64, 32)
    nine = lambda c: F.round(c, 9).alias(c)
    return found.select("image", "n", nine("mean"), nine("rms"), nine("tile_rms"), "worst_ty", "worst_tx", nine("block_mean"), nine("p999"), nine("most"))


MOVES = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (0, 2), (2, 0)]


@query(
    with_plane(f""", {NOISY}, m AS (SELECT * FROM (VALUES {", ".join(map(str, MOVES))}) t(dy, dx)),
s AS (SELECT a.image, dy, dx, (a.y % 2) * 2 + a.x % 2 AS field, sum(((a.stored - a.v) * (a.stored - a.v))::DOUBLE) AS own, sum(((a.stored - b.v) * (a.stored - b.v))::DOUBLE) AS moved
FROM pairs a CROSS JOIN m JOIN pairs b ON a.image = b.image AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4)
SELECT image, dy, dx, field, own, moved, round(CASE WHEN own = moved THEN NULL WHEN own > 0 THEN (moved - own) / own ELSE 1e9 END, 6) AS margin FROM s""")
)
def alignment(spark, sf_dir):
    return errors.alignment(_noisy(spark, sf_dir), ["image"], MOVES, 2, 2).withColumn("margin", F.round("margin", 6))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.025::DOUBLE * d THEN 'rms' WHEN l_discount > 0.03::DOUBLE * d THEN 'tile' WHEN l_quantity / 1000 > 0.01::DOUBLE * d + 0.001 THEN 'block'
WHEN l_quantity - 2 <= 0 THEN 'alignment' WHEN abs(l_tax - 0.01) > 0.001::DOUBLE * d + 0.0001 THEN 'mean' END AS broken FROM (SELECT *, (l_partkey % 8)::DOUBLE AS d FROM lineitem)"""
)
def lossy_verdict(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    d = (F.col("l_partkey") % 8).cast("double")
    return l.select("l_orderkey", "l_linenumber", samples.lossy_verdict(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 1000, F.col("l_quantity") - 2, F.col("l_tax") - 0.01, d).alias("broken"))


# Checks, counts and fits


@query(
    """SELECT l_orderkey, required, 500000 AS size, greatest(0, required - 500000) AS missing FROM
(SELECT l_orderkey, max(l_partkey * 100 + l_quantity::BIGINT * 1000) AS required FROM lineitem GROUP BY 1)"""
)
def required_size(spark, sf_dir):
    extents = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 100).alias("offset"), (F.col("l_quantity").cast("bigint") * 1000).alias("bytes"))
    return archive.required_sizes(extents, ["l_orderkey"], F.lit(500000))


@query("SELECT o_orderstatus, count(*) AS n, CASE WHEN o_orderstatus IN ('F') THEN 1 ELSE 0 END AS status FROM orders GROUP BY 1")
def outcomes(spark, sf_dir):
    return archive.outcomes(table(spark, sf_dir, "orders"), "o_orderstatus", ["F"])


@query("SELECT p_partkey, CASE WHEN i < 65535 THEN i ELSE 65535 END AS short, CASE WHEN i >= 65535 THEN i END AS long FROM (SELECT p_partkey, CAST(floor(p_retailprice * 50) AS BIGINT) AS i FROM part)")
def iso_split(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", numbers.iso_fields(F.floor(F.col("p_retailprice") * 50)).alias("i")).select("p_partkey", "i.*")


FRAME = {
    "width": "l_partkey % 50", "height": "l_suppkey % 40 + 1", "spp": "l_linenumber % 6", "planes": "l_orderkey % 6", "is_cfa": "l_orderkey % 2 = 0",
    "samples": "CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE (l_partkey % 50) * (l_suppkey % 40 + 1) * (l_linenumber % 6) END", "top": "l_linenumber % 3", "left": "l_partkey % 4",
    "bottom": "l_suppkey % 40 + 1", "right": "l_partkey % 50", "crop_width": "l_partkey % 30", "crop_height": "l_suppkey % 20", "crop_left": "l_orderkey % 3", "crop_top": "l_orderkey % 4",
    "orientation": "l_partkey % 10", "scale_h": "l_tax", "scale_v": "1.0",
}


@query(
    f"""WITH f AS (SELECT l_orderkey, l_linenumber, {", ".join(f'{e} AS "{c}"' for c, e in FRAME.items())} FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN width <= 0 OR height <= 0 THEN 'empty frame' WHEN spp NOT BETWEEN 1 AND 4 THEN 'samples per pixel' WHEN samples <> width * height * spp THEN 'buffer length'
WHEN planes NOT BETWEEN 1 AND 4 THEN 'colour planes' WHEN is_cfa AND spp <> 1 THEN 'mosaic samples' WHEN is_cfa AND planes < 3 THEN 'mosaic planes' WHEN NOT is_cfa AND planes <> spp THEN 'linear planes'
WHEN bottom > height OR "right" > width OR top >= bottom OR "left" >= "right" THEN 'active area'
WHEN crop_width <= 0 OR crop_height <= 0 OR crop_left + crop_width > "right" - "left" OR crop_top + crop_height > bottom - top THEN 'default crop'
WHEN orientation NOT BETWEEN 1 AND 8 THEN 'orientation' WHEN NOT (scale_h > 0 AND scale_v > 0) THEN 'pixel scale' END AS reason FROM f"""
)
def first_fail(spark, sf_dir):
    frames = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(c) for c, e in FRAME.items()])
    return frames.select("l_orderkey", "l_linenumber", archive.first_failure(archive.frame_rules()).alias("reason"))


def _moments(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (1.0 + F.col("l_discount")).alias("w"))
    return archive.poly_moments(points, ["l_returnflag"], F.col("x"), F.col("y"), F.col("w"), 2)


_M = ", ".join([*(f"round(sum(w * power(x, {k})), 4) AS s{k}" for k in range(5)), *(f"round(sum(w * y * power(x, {k})), 4) AS t{k}" for k in range(3))])


@query(f"SELECT l_returnflag, {_M} FROM (SELECT l_returnflag, l_quantity / 50 AS x, l_extendedprice / 1000 AS y, 1.0::DOUBLE + l_discount AS w FROM lineitem) GROUP BY 1")
def poly_moments(spark, sf_dir):
    found = _moments(spark, sf_dir)
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in found.columns[1:]])


_DET = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
_SYSTEM = [f"s{i + j}" for i in range(3) for j in range(3)]
_CRAMER = [_DET([f"t{i}" if j == k else f"s{i + j}" for i in range(3) for j in range(3)]) for k in range(3)]
_RAW_M = ", ".join([*(f"sum(w * power(x, {k})) AS s{k}" for k in range(5)), *(f"sum(w * y * power(x, {k})) AS t{k}" for k in range(3))])


@query(
    f"""WITH m AS (SELECT l_returnflag, {_RAW_M} FROM (SELECT l_returnflag, l_quantity / 50 AS x, l_extendedprice / 1000 AS y, 1.0::DOUBLE + l_discount AS w FROM lineitem) GROUP BY 1)
SELECT l_returnflag, {", ".join(f"round({c} / {_DET(_SYSTEM)}, 4) AS c{k}" for k, c in enumerate(_CRAMER))} FROM m"""
)
def poly_fit(spark, sf_dir):
    found = archive.poly_fits(_moments(spark, sf_dir), ["l_returnflag"], 2)
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in found.columns[1:]])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each picture (here: a hundred rows of the plane) its profile, brightness, digest and verdict in one table."""
    own = plane(spark, sf_dir).withColumn("image", F.floor(F.col("y") / 100))
    digest = lines.image_digests(picture_lines(spark, sf_dir), ["image"], 64)
    mean = samples.cell_means(own, ["image"], 2, 2, F.col("y") % 2 + F.col("x") % 2, F.lit(15000.0)).groupBy("image").agg(F.round(F.avg("mean"), 3).alias("brightness"))
    pictures = own.select("image").distinct().join(table(spark, sf_dir, "nation"), F.col("image") == F.col("n_nationkey")).select(F.col("image").alias("picture"), F.col("n_name").alias("model"), F.lit(3).alias("planes"))
    profiles = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    profiles = profiles.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("profile"), F.col("n_name").alias("camera"), (F.col("s_suppkey") % 2 + 2).alias("profile_planes"), F.lit(0).alias("policy"))
    chosen = archive.select_profiles(pictures, profiles).where("verdict = 'chosen'").groupBy(F.col("picture").alias("image")).agg(F.min_by("profile", "ord").alias("profile"))
    return digest.join(mean, "image").join(chosen, "image", "left").withColumn("outcome", F.when(F.col("profile").isNull(), "without profile").otherwise("done"))


# Rules and small tables


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey % 60000 AS tag, (l_partkey % 60000) NOT IN (37500, 40965, 59932, 59933, 41730, 34856, 37388, 41484, 41995) AS exif, (l_partkey % 60000) IN (270, 315, 33432, 700) AS descriptive,
l_suppkey % 2 AS num, CASE WHEN l_suppkey % 2 = 0 AND l_linenumber = 1 THEN 0 ELSE l_linenumber END AS den FROM lineitem"""
)
def tag_filters(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    tag = F.col("l_partkey") % 60000
    spec = rules.lens_specification(F.col("l_suppkey") % 2, F.col("l_linenumber"))
    return l.select("l_orderkey", "l_linenumber", tag.alias("tag"), rules.kept_exif(tag).alias("exif"), rules.kept_descriptive(tag).alias("descriptive"), spec.alias("s")).select("l_orderkey", "l_linenumber", "tag", "exif", "descriptive", "s.num", "s.den")


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey % 2 = 0 AS z, l_partkey % 3 = 0 AS hn, l_partkey % 5 < 2 AS ho, l_suppkey % 7 > 0 AS nok, l_suppkey % 5 > 0 AS ook, l_suppkey % 6 = 0 AS mask, l_orderkey % 9 = 0 AS cut,
 CASE l_orderkey % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'intact' WHEN 2 THEN 'unverified' ELSE 'damaged' END AS original FROM lineitem),
r AS (SELECT *, CASE WHEN NOT (hn OR ho) OR (mask AND CASE WHEN z THEN hn OR ho ELSE hn END) THEN 'unverified' WHEN CASE WHEN z THEN CASE WHEN hn THEN nok ELSE ook END ELSE (NOT hn OR nok) AND (NOT ho OR ook) END THEN 'intact' ELSE 'damaged' END AS raw FROM f)
SELECT l_orderkey, l_linenumber, raw, CASE WHEN cut OR raw = 'damaged' OR original = 'damaged' THEN 'damaged' WHEN raw = 'intact' AND original IN ('intact', 'absent') THEN 'intact' ELSE 'unverified' END AS verdict,
NOT (cut OR raw = 'damaged' OR original = 'damaged') AND ((NOT hn AND NOT ho AND NOT mask) OR original = 'unverified') AS addable FROM r"""
)
def check_verdicts(spark, sf_dir):
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    new, old, mask, cut = p % 3 == 0, p % 5 < 2, s % 6 == 0, o % 9 == 0
    original = F.element_at(F.array(*[F.lit(x) for x in ("absent", "intact", "unverified", "damaged")]), (o % 4 + 1).cast("int"))
    raw = rules.raw_state(p % 2 == 0, new, old, s % 7 > 0, s % 5 > 0, mask)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), rules.verdict(raw, original, cut).alias("verdict"), rules.can_add(raw, original, cut, new, old, mask).alias("addable"))


@query(
    """SELECT l_orderkey, l_linenumber, round((l_linenumber - 1 + 0.5::DOUBLE) / 10, 6) AS radius, round(1 + (l_partkey % 2001 - 1000) / 16384.0::DOUBLE, 6) AS distortion, round((l_suppkey % 201 - 100) / 2097152.0::DOUBLE, 9) AS aberration,
round(power(2.0::DOUBLE, power(2.0::DOUBLE, (l_partkey % 16384) / 8192.0::DOUBLE - 1) - 0.5::DOUBLE), 6) AS gain FROM lineitem"""
)
def lens_steps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        rounded(rules.knot_radius(F.col("l_linenumber") - 1, F.lit(11)), "radius"),
        rounded(rules.step_distortion((F.col("l_partkey") % 2001 - 1000).cast("double")), "distortion"),
        F.round(rules.step_aberration((F.col("l_suppkey") % 201 - 100).cast("double")), 9).alias("aberration"),
        rounded(rules.step_vignetting(F.col("l_partkey") % 16384), "gain"),
    )


@query("WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127) AS BIGINT)) AS w FROM embeddings) SELECT vec_id, CAST(list_reduce(w, lambda s, x: (s * 73 + x) % 65519, 0::BIGINT) AS BIGINT) AS checksum FROM b")
def word_checksums(spark, sf_dir):
    words = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", rules.word_checksum(words).alias("checksum"))


@query(
    """WITH c AS (SELECT l_orderkey, list(l_discount * 10 + l_linenumber ORDER BY l_linenumber, l_discount, l_tax) AS r, list(l_tax * 20 ORDER BY l_linenumber, l_discount, l_tax) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(r) >= 2 AND len(list_filter(v, lambda x: x < 0.5 OR x > 1.5)) = 0 AND len(list_filter(range(1, len(r)), lambda i: r[i + 1] <= r[i])) = 0 AS sane FROM c"""
)
def curve_sanity(spark, sf_dir):
    knots = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") * 10 + F.col("l_linenumber")).alias("r"), (F.col("l_tax") * 20).alias("v")))).alias("k"))
    return knots.select("l_orderkey", rules.sane_curve(F.col("k.r"), F.col("k.v"), *rules.DISTORTION_RANGE).alias("sane"))


# The luminance table of the JPEG standard, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]


@query(
    f"""WITH b AS (SELECT p_partkey, p_size * 2 + 1 AS q, {LUMINANCE} AS base FROM part), s AS (SELECT *, CASE WHEN least(100, greatest(1, q)) < 50 THEN 5000 // least(100, greatest(1, q)) ELSE 200 - 2 * least(100, greatest(1, q)) END AS scale FROM b)
SELECT p_partkey, array_to_string(list_transform(base, lambda x: greatest(1, least(255, (x * scale + 50) // 100))), ',') AS quantisers FROM s"""
)
def quality_tables(spark, sf_dir):
    base = F.array(*[F.lit(x) for x in LUMINANCE])
    made = rules.quality_table(base, F.col("p_size") * 2 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(made.cast("array<string>"), ",").alias("quantisers"))


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/out/all.dng' WHEN page_id % 2 = 0 THEN '/out/' || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '([^/])\\.[^./]*$', '\\1') || '.dng' ELSE regexp_replace(url, '([^/])\\.[^./]*$', '\\1') || '.dng' END AS target FROM pages"""
)
def output_names(spark, sf_dir):
    root = F.when(F.col("page_id") % 5 == 0, "/out/all.dng").when(F.col("page_id") % 2 == 0, "/out/").otherwise("")
    relative = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return table(spark, sf_dir, "pages").select("page_id", rules.output_path(F.col("url"), relative, root, F.col("page_id") % 5 == 0).alias("target"))


@query(
    """WITH s AS (SELECT o_orderkey, o_custkey % 13 = 0 AS same, o_custkey % 3 > 0 AS there, o_custkey % 7 = 0 AS force, ['up to date', 'no record', 'changed', 'stale', 'new'][o_orderkey % 5 + 1] AS state FROM orders)
SELECT o_orderkey, CASE WHEN same THEN 'refused: same file' WHEN NOT there OR force THEN 'write' WHEN state = 'up to date' THEN 'skipped: up to date' WHEN state = 'no record' THEN 'left alone: no record' WHEN state IN ('changed', 'stale') THEN 'write' ELSE 'refused: exists' END AS action FROM s"""
)
def target_policy(spark, sf_dir):
    c = F.col("o_custkey")
    state = F.element_at(F.array(*[F.lit(x) for x in ("up to date", "no record", "changed", "stale", "new")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.target_policy(c % 13 == 0, c % 3 > 0, c % 7 == 0, state).alias("action"))


@query()
def huffman_lengths(spark, sf_dir):
    return tables.huffman(_residuals(spark, sf_dir), ["image"])


_FITS = "floor(x) <= 4294967295 AND floor(x) * p + p0 <= 4294967295 AND floor(x) * q + q0 <= 1000000000"


@query(
    f"""WITH RECURSIVE v AS (SELECT DISTINCT p_retailprice / 7 AS value FROM part),
d AS (SELECT value, min(k) AS k FROM v, range(5) r(k) WHERE abs(floor(value * 10.0::DOUBLE ** k + 0.5) / 10.0::DOUBLE ** k - value) <= value * 1.5e-7::DOUBLE AND floor(value * 10.0::DOUBLE ** k + 0.5) >= 1 GROUP BY 1),
e AS (SELECT value, CAST(floor(value * 10.0::DOUBLE ** k + 0.5) AS BIGINT) AS n, CAST(10.0::DOUBLE ** k AS BIGINT) AS den FROM d),
c AS (SELECT value, value AS x, 1::BIGINT AS p, 0::BIGINT AS q, 0::BIGINT AS p0, 1::BIGINT AS q0, 0 AS i FROM v WHERE value NOT IN (SELECT value FROM d)
UNION ALL SELECT value, CASE WHEN abs((floor(x) * p + p0) / (floor(x) * q + q0) - value) > value * 1.5e-7::DOUBLE AND x - floor(x) >= 1e-12::DOUBLE THEN 1 / (x - floor(x)) END,
 CAST(floor(x) * p + p0 AS BIGINT), CAST(floor(x) * q + q0 AS BIGINT), p, q, i + 1 FROM c WHERE x IS NOT NULL AND {_FITS})
SELECT value, n // gcd(n, den) AS num, den // gcd(n, den) AS den FROM e UNION ALL SELECT value, arg_max(p, i), arg_max(q, i) FROM c GROUP BY 1"""
)
def rational_values(spark, sf_dir):
    return tables.rationals(table(spark, sf_dir, "part").select((F.col("p_retailprice") / 7).alias("value")), "value")


_S = "(4000.0::DOUBLE / sqrt(52000000.0::DOUBLE))"


@query(
    f"""WITH k AS (SELECT l_suppkey, l_linenumber / 7.0::DOUBLE AS r, 0.9::DOUBLE + avg(l_discount) AS v FROM lineitem GROUP BY l_suppkey, l_linenumber),
n AS (SELECT *, lead(r) OVER w AS r1, lead(v) OVER w AS v1, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_suppkey) AS m FROM k WINDOW w AS (PARTITION BY l_suppkey ORDER BY r)),
s AS (SELECT *, CASE WHEN i = 1 THEN '-inf'::DOUBLE ELSE r END AS low, CASE WHEN i >= m - 1 THEN 'inf'::DOUBLE ELSE r1 END AS high, CASE WHEN m = 1 THEN 0.0::DOUBLE ELSE (v1 - v) / (r1 - r) END AS slope FROM n WHERE i < m OR m = 1),
e AS (SELECT l_suppkey, low, high, share, v - slope * r AS f, (v - slope * r) * (v - slope * r) + slope * share * 4 AS inside FROM s, (VALUES (1.0::DOUBLE), {_S}) t(share)),
z AS (SELECT l_suppkey, 2 / (f + sqrt(inside)) AS z FROM e WHERE inside >= 0 AND f + sqrt(greatest(inside, 0)) > 0 AND share * 2 / (f + sqrt(inside)) >= low AND share * 2 / (f + sqrt(inside)) < high
 UNION ALL SELECT l_suppkey, greatest(1 / v, r) FROM k WHERE v > 0 AND greatest(1 / v, r) * {_S} <= r),
l AS (SELECT l_suppkey, min(z) AS z FROM z GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN z >= 0.5 AND z < 2 THEN z ELSE 1.0 END, 6) AS zoom FROM (SELECT DISTINCT l_suppkey FROM lineitem) LEFT JOIN l USING (l_suppkey)"""
)
def frame_zooms(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("d"))
    knots = means.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") / 7.0).alias("r"), (F.lit(0.9) + F.col("d")).alias("v")))).alias("k"))
    found = tables.zooms(knots.select("l_suppkey", F.lit(6000.0).alias("width"), F.lit(4000.0).alias("height"), F.col("k.r").alias("radius"), F.col("k.v").alias("ratio")), ["l_suppkey"])
    return found.withColumn("zoom", F.round("zoom", 6))
