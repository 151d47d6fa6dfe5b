"""Registered queries on frames, lines, directories, colours and lenses, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary, colour, frames, rules
from ..operators import archive, checks, directories, errors, lenses, lines, profiles, warps
from ..operators import tables as small
from ..sources import catalog
from .catalogue import PICTURES as _PICTURES
from .catalogue import QUERIES, _noisy, picture_lines, query, table, with_plane

__all__ = ["QUERIES"]

# Frames and their levels


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS a, l_suppkey % 36 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, gcd(a, b) AS g, lcm(a, b) AS l, a + a % 2 AS even, greatest(5, least(20, a)) AS held FROM a"""
)
def number_rules(spark, sf_dir):
    a, b = F.col("l_partkey") % 40, F.col("l_suppkey") % 36
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", frames.gcd(a, b).alias("g"), frames.lcm(a, b).alias("l"), frames.even_size(a).alias("even"), frames.clamp(a, F.lit(5), F.lit(20)).alias("held"))


@query(
    """WITH s AS (SELECT o_orderkey, o_orderkey % 600 AS line, o_custkey % 5 + 1 AS factor, 120 AS field FROM orders)
SELECT o_orderkey, (line % factor) * field + line // factor AS stored, (((line % factor) * field + line // factor) % field) * factor + ((line % factor) * field + line // factor) // field AS frame FROM s"""
)
def whole_fields(spark, sf_dir):
    line, factor, field = F.col("o_orderkey") % 600, F.col("o_custkey") % 5 + 1, F.lit(120)
    stored = frames.whole_stored_line(line, field, factor)
    return table(spark, sf_dir, "orders").select("o_orderkey", stored.alias("stored"), frames.frame_line(stored, field, factor).alias("frame"))


@query("SELECT p_partkey, round(CASE WHEN abs(a - 1) > 1e-3 AND a > 1 THEN a ELSE 1 END, 9) AS h, round(CASE WHEN a > 0 AND abs(a - 1) > 1e-3 AND a <= 1 THEN 1 / a ELSE 1 END, 9) AS v FROM (SELECT p_partkey, (p_size - 1) / 25.0::DOUBLE AS a FROM part)")
def pixel_scales(spark, sf_dir):
    s = frames.pixel_scale((F.col("p_size") - 1) / 25.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(s["h"], 9).alias("h"), F.round(s["v"], 9).alias("v"))


_INSET = {"width": "l_partkey % 120", "height": "l_suppkey % 90", "left": "CASE WHEN l_orderkey % 3 = 0 THEN 65535 ELSE l_linenumber * 3 END", "top": "CASE WHEN l_orderkey % 4 = 0 THEN 65535 ELSE l_linenumber * 2 END"}


@query(
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, 20 + l_orderkey % 100 AS w, 30 + l_orderkey % 60 AS h, 4 AS x, 6 AS y, l_partkey % 2 = 0 AS cfa, {", ".join(f"{e} AS i_{n}" for n, e in _INSET.items())} FROM lineitem),
f AS (SELECT *, i_width > 0 AND i_height > 0 AND i_width <= w AND i_height <= h AS fits FROM a),
s AS (SELECT *, CASE WHEN fits THEN greatest(0, least(w - i_width, CASE WHEN i_left = 65535 THEN (w - i_width) // 2 ELSE i_left - x END)) ELSE 0 END AS x0,
 CASE WHEN fits THEN greatest(0, least(h - i_height, CASE WHEN i_top = 65535 THEN (h - i_height) // 2 ELSE i_top - y END)) ELSE 0 END AS y0 FROM f),
e AS (SELECT *, x0 + CASE WHEN fits THEN i_width ELSE w END AS x1, y0 + CASE WHEN fits THEN i_height ELSE h END AS y1 FROM s),
m AS (SELECT *, cfa AND w > 32 AND h > 32 AND least(x1, w - 2) > greatest(x0, 2) AND least(y1, h - 2) > greatest(y0, 2) AS held FROM e)
SELECT l_orderkey, l_linenumber, CASE WHEN held THEN greatest(x0, 2) ELSE x0 END AS "left", CASE WHEN held THEN greatest(y0, 2) ELSE y0 END AS top,
CASE WHEN held THEN least(x1, w - 2) - greatest(x0, 2) ELSE x1 - x0 END AS width, CASE WHEN held THEN least(y1, h - 2) - greatest(y0, 2) ELSE y1 - y0 END AS height FROM m"""
)
def default_crops(spark, sf_dir):
    inset = {n: F.expr(e) for n, e in _INSET.items()}
    crop = frames.default_crop(20 + F.col("l_orderkey") % 100, 30 + F.col("l_orderkey") % 60, F.lit(4), F.lit(6), inset, F.col("l_partkey") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", crop.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 5000 AS camera, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_suppkey % 4000 + 100 END AS fmt, l_orderkey % 600 AS black FROM lineitem),
w AS (SELECT *, CASE WHEN fmt > 0 THEN fmt ELSE 65535 END AS most FROM a), v AS (SELECT *, CASE WHEN camera > black AND camera < most THEN camera ELSE most END AS white FROM w)
SELECT l_orderkey, l_linenumber, CAST(least(65535, CASE WHEN white <= black THEN 65535 ELSE white END) AS DOUBLE) AS white, greatest(1.0::DOUBLE, least(4000.0::DOUBLE, camera::DOUBLE) - greatest(black::DOUBLE, 300.0::DOUBLE)) AS span FROM v"""
)
def white_levels(spark, sf_dir):
    camera, most, black = F.col("l_partkey") % 5000, F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_suppkey") % 4000 + 100), F.col("l_orderkey") % 600
    common = frames.common_levels(F.array(F.lit(4000.0), camera.cast("double")), F.array(black.cast("double"), F.lit(300.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", frames.white_level(camera, most, black).alias("white"), common["range"].alias("span"))


@query(
    """WITH a AS (SELECT o_orderkey, o_custkey % 3 AS pr, o_orderkey % 4 AS pc, CASE WHEN o_orderkey % 2 = 0 THEN [3.0::DOUBLE, 3, 3, 3] ELSE [3.0::DOUBLE, 5, 6, 8] END AS by_colour FROM orders),
b AS (SELECT *, pr > 0 AND pc > 0 AS has FROM a), c AS (SELECT *, CASE WHEN has THEN lcm(2, pr) ELSE 2 END AS r, CASE WHEN has THEN lcm(2, pc) ELSE 2 END AS c FROM b),
l AS (SELECT o_orderkey, r, c, list_transform(range(r * c), lambda i: 100 + by_colour[[0, 1, 1, 2][(i // c) % 2 * 2 + i % c % 2 + 1] + 1] + CASE WHEN has THEN ((i // c) % pr * pc + i % c % pc)::DOUBLE ELSE 0.0 END) AS l FROM c)
SELECT o_orderkey, CASE WHEN list_min(l) = list_max(l) THEN 1 ELSE r END AS "rows", CASE WHEN list_min(l) = list_max(l) THEN 1 ELSE c END AS cols,
list_sum(CASE WHEN list_min(l) = list_max(l) THEN l[1:1] ELSE list_transform(l, lambda x, i: x * i) END) AS weighed, false AS simplified FROM l"""
)
def black_patterns(spark, sf_dir):
    rows, cols = F.col("o_custkey") % 3, F.col("o_orderkey") % 4
    by_colour = F.when(F.col("o_orderkey") % 2 == 0, F.array(*[F.lit(3.0)] * 4)).otherwise(F.array(*[F.lit(x) for x in (3.0, 5.0, 6.0, 8.0)]))
    pattern = F.array(*[F.lit(float(i)) for i in range(6)])
    made = frames.black_pattern(F.lit(100.0), by_colour, F.array(*[F.lit(x) for x in (0, 1, 1, 2)]), F.lit(2), F.lit(2), pattern, rows, cols)
    found = table(spark, sf_dir, "orders").select("o_orderkey", made.alias("b")).select("o_orderkey", "b.*")
    weighed = F.aggregate(F.transform("levels", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return found.select("o_orderkey", "rows", "cols", weighed.alias("weighed"), "simplified")


_COLOURS = "list_transform(range(16), lambda i: CASE WHEN o_orderkey % 3 = 0 THEN (i // 2) % 2 + i % 2 WHEN o_orderkey % 3 = 1 THEN ((i // 2) % 4 * 3 + i % 2) % 3 + CASE WHEN (i // 2) % 4 = 3 THEN 1 ELSE 0 END ELSE i % 5 END)"


@query(
    f"""WITH c AS (SELECT o_orderkey, {_COLOURS} AS c FROM orders)
SELECT o_orderkey, CASE WHEN len(list_filter(range(16), lambda i: c[i + 1] <> c[i % 4 + 1])) = 0 THEN 2 WHEN len(list_filter(range(16), lambda i: c[i + 1] <> c[i % 8 + 1])) = 0 THEN 4 ELSE 8 END AS "rows" FROM c"""
)
def filter_periods(spark, sf_dir):
    k = F.col("o_orderkey") % 3

    def one(i):
        r = F.floor(i / 2)
        return F.when(k == 0, r % 2 + i % 2).when(k == 1, (r % 4 * 3 + i % 2) % 3 + F.when(r % 4 == 3, 1).otherwise(0)).otherwise(i % 5)

    return table(spark, sf_dir, "orders").select("o_orderkey", frames.cfa_rows(F.array(*[one(F.lit(i)) for i in range(16)])).alias("rows"))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 + 1 AS w, l_suppkey % 700 + 1 AS h, l_linenumber % 2 AS sx, l_orderkey % 2 AS sy, 1.0::DOUBLE + (l_orderkey % 3) * 0.25 AS scale, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE 100 END AS most FROM lineitem),
b AS (SELECT *, w - (2 - sx % 2) % 2 AS bw, h - (2 - sy % 2) % 2 AS bh FROM a), c AS (SELECT *, bw // 2 AS cx, bh // 2 AS cy, bw * scale AS dw, bh * 1.0::DOUBLE AS dh FROM b),
d AS (SELECT *, least(1.0, cx / dw, cy / dh, CASE WHEN most > 0 THEN most / greatest(dw, dh) ELSE 1.0 END) AS s FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN bw >= 2 AND bh >= 2 THEN CAST(greatest(1, least(cx, floor(dw * s + 0.5))) AS BIGINT) END AS width, CASE WHEN bw >= 2 AND bh >= 2 THEN CAST(greatest(1, least(cy, floor(dh * s + 0.5))) AS BIGINT) END AS height FROM d"""
)
def render_sizes(spark, sf_dir):
    c = F.col
    scale = 1.0 + (c("l_orderkey") % 3) * 0.25
    size = frames.render_size(c("l_partkey") % 900 + 1, c("l_suppkey") % 700 + 1, c("l_linenumber") % 2, c("l_orderkey") % 2, F.lit(2), F.lit(2), scale, F.lit(1.0), F.when(c("l_partkey") % 4 == 0, 0).otherwise(100))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", size.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 + 1 AS w, l_suppkey % 700 + 1 AS h, l_linenumber % 2 AS sx, l_orderkey % 2 AS sy, 1.0::DOUBLE + (l_orderkey % 3) * 0.25 AS scale, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE 100 END AS most FROM lineitem),
b AS (SELECT *, w - (2 - sx % 2) % 2 AS bw, h - (2 - sy % 2) % 2 AS bh FROM a), c AS (SELECT *, bw // 2 AS cx, bh // 2 AS cy, bw * scale AS dw, bh * 1.0::DOUBLE AS dh FROM b),
d AS (SELECT *, least(1.0, cx / dw, cy / dh, CASE WHEN most > 0 THEN most / greatest(dw, dh) ELSE 1.0 END) AS s FROM c),
e AS (SELECT *, (2 - sx % 2) % 2 AS lx, (2 - sy % 2) % 2 AS ly, CAST(greatest(1, least(cx, floor(dw * s + 0.5))) AS BIGINT) AS tw, CAST(greatest(1, least(cy, floor(dh * s + 0.5))) AS BIGINT) AS th FROM d WHERE bw >= 2 AND bh >= 2),
f AS (SELECT *, 2 * (cx // tw) AS qx, 2 * (cy // th) AS qy FROM e)
SELECT l_orderkey, l_linenumber, tw AS width, th AS height, qx AS cell_width, qy AS cell_height, bw // qx AS across, bh // qy AS down,
5 + lx + (bw - bw // qx * qx) // 2 // 2 * 2 AS "left", 3 + ly + (bh - bh // qy * qy) // 2 // 2 * 2 AS top FROM f"""
)
def render_layouts(spark, sf_dir):
    """The cells of renderings of crops that begin at 5, 3."""
    c = F.col
    scale = 1.0 + (c("l_orderkey") % 3) * 0.25
    made = frames.render_layout(F.lit(5), F.lit(3), c("l_partkey") % 900 + 1, c("l_suppkey") % 700 + 1, c("l_linenumber") % 2, c("l_orderkey") % 2, F.lit(2), F.lit(2), scale, F.lit(1.0), F.when(c("l_partkey") % 4 == 0, 0).otherwise(100))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("r")).where("r is not null").select("l_orderkey", "l_linenumber", "r.*")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, ['auto', 'camera', 'render', 'none'][l_orderkey % 4 + 1] AS mode, l_partkey % 2 = 0 AS has, l_partkey % 3000 AS cw, 400 AS ch, l_suppkey % 3 > 0 AS can, l_suppkey * 5 AS rw, 300 AS rh FROM lineitem),
b AS (SELECT *, has AND mode IN ('auto', 'camera') AS c, can AND mode IN ('auto', 'render') AS r FROM a), d AS (SELECT *, c AND (NOT r OR greatest(cw, ch) >= 1000 OR greatest(cw, ch) >= greatest(rw, rh)) AS own FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN own THEN 'camera' WHEN r THEN 'rendered' END AS kind, CASE WHEN own THEN cw WHEN r THEN rw END AS width, CASE WHEN own THEN ch WHEN r THEN rh END AS height FROM d"""
)
def preview_choices(spark, sf_dir):
    c = F.col
    size = lambda w, h: F.struct(w.cast("bigint").alias("width"), F.lit(h).cast("bigint").alias("height"))
    mode = F.element_at(F.array(*[F.lit(x) for x in ("auto", "camera", "render", "none")]), (c("l_orderkey") % 4 + 1).cast("int"))
    made = frames.preview_choice(mode, F.when(c("l_partkey") % 2 == 0, size(c("l_partkey") % 3000, 400)), F.when(c("l_suppkey") % 3 > 0, size(c("l_suppkey") * 5, 300)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'lossless jpeg' ELSE 'jxl' END AS comp, l_linenumber % 5 AS spp, (l_suppkey % 3)::DOUBLE AS dist,
 CASE WHEN l_linenumber % 5 <> 1 THEN 'full-colour raw data (several samples per pixel)' WHEN l_partkey % 20 < 4 OR l_suppkey % 20 < 4 THEN 'an active area too small for its colour pattern' END AS why FROM lineitem),
b AS (SELECT *, comp = 'jxl' AND spp NOT IN (1, 3) AS back FROM a), c AS (SELECT *, CASE WHEN back THEN 'lossless jpeg' ELSE comp END AS compression FROM b)
SELECT l_orderkey, l_linenumber, compression, CASE WHEN compression = 'jxl' AND dist > 0 AND why IS NOT NULL THEN 0.0 ELSE dist END AS distance,
concat_ws('; ', CASE WHEN back THEN spp || ' samples per pixel cannot be stored with JPEG XL; lossless JPEG was used' END, CASE WHEN compression = 'jxl' AND dist > 0 AND why IS NOT NULL THEN 'lossy JPEG XL cannot store ' || why || '; stored losslessly' END) AS notes FROM c"""
)
def storage_choices(spark, sf_dir):
    c = F.col
    spp = c("l_linenumber") % 5
    refusal = frames.lossy_refusal(spp, c("l_partkey") % 20, c("l_suppkey") % 20, F.lit(2), F.lit(2))
    made = frames.storage_choice(F.when(c("l_orderkey") % 3 == 0, "lossless jpeg").otherwise("jxl"), (c("l_suppkey") % 3).cast("double"), spp, refusal)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN NOT (d = 0 OR d BETWEEN 0.05 AND 25) THEN 'distance' WHEN e NOT BETWEEN 1 AND 9 THEN 'effort' WHEN j NOT BETWEEN 1 AND 1024 THEN 'jobs' WHEN NOT (p = 0 OR p BETWEEN 64 AND 65535) THEN 'preview size' END AS broken
FROM (SELECT *, l_tax AS d, l_linenumber * 2 - 1 AS e, l_orderkey % 1100 AS j, l_suppkey AS p FROM lineitem)"""
)
def option_ranges(spark, sf_dir):
    broken = archive.first_failure(frames.option_rules(F.col("l_tax"), F.col("l_linenumber") * 2 - 1, F.col("l_orderkey") % 1100, F.col("l_suppkey")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", broken.alias("broken"))


@query(
    """WITH a AS (SELECT o_orderkey, [o_custkey % 3, 1 + o_custkey % 4, 2, o_orderkey % 2] AS cam, [2.0::DOUBLE, 1, 1.5, 1] AS day FROM orders), m AS (SELECT *, CASE WHEN len(list_filter(cam[1:3], lambda x: x <= 0)) = 0 THEN cam[1:3]::DOUBLE[] ELSE day[1:3] END AS m FROM a)
SELECT o_orderkey, CASE WHEN len(list_filter(cam[1:3], lambda x: x <= 0)) = 0 THEN 'as shot' ELSE 'daylight' END AS source, round(list_min(m) / m[1], 9) AS red, round(list_min(m) / m[2], 9) AS green, round(list_min(m) / m[3], 9) AS blue,
CASE WHEN o_orderkey % 5 > 0 THEN 'known' WHEN o_custkey % 2 = 0 THEN 'derived' ELSE 'srgb' END AS matrix FROM m JOIN orders USING (o_orderkey)"""
)
def neutrals(spark, sf_dir):
    c = F.col
    camera = F.array(*[x.cast("double") for x in (c("o_custkey") % 3, 1 + c("o_custkey") % 4, F.lit(2), c("o_orderkey") % 2)])
    found = frames.neutral(camera, F.array(*[F.lit(x) for x in (2.0, 1.0, 1.5, 1.0)]), F.lit(3))
    known = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.when((i == 4) & (c("o_orderkey") % 5 > 0), 0.7).otherwise(0.0))
    at = lambda k, name: F.round(F.get("n.neutral", F.lit(k)), 9).alias(name)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", found.alias("n"), frames.matrix_source(known, F.lit(3), c("o_custkey") % 2 == 0).alias("matrix"))
    return rows.select("o_orderkey", "n.source", at(0, "red"), at(1, "green"), at(2, "blue"), "matrix")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, [0, 255, 3, 16][l_partkey % 4 + 1] AS d, [0, 255, 3][l_suppkey % 3 + 1] AS c, [256, 511, 0, 257][l_orderkey % 4 + 1] AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, d <> 255 AS distortion_known, d NOT IN (0, 255) AS distortion, c <> 255 AS aberration_known, c NOT IN (0, 255) AS aberration, v <> 511 AS vignetting_known, v NOT IN (256, 511) AS vignetting_in_data FROM a"""
)
def lens_settings(spark, sf_dir):
    pick = lambda of, c: F.element_at(F.array(*[F.lit(x) for x in of]), (F.col(c) % len(of) + 1).cast("int"))
    made = frames.maker_settings(pick((0, 255, 3, 16), "l_partkey"), pick((0, 255, 3), "l_suppkey"), pick((256, 511, 0, 257), "l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(s, '[A-Za-z0-9]') THEN s ELSE '' END AS serial, concat_ws(', ', nullif(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END, ''), CASE WHEN p_size % 2 = 0 THEN p_type END) AS notes,
coalesce(nullif(CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END, ''), nullif(CASE WHEN p_size % 8 = 0 THEN '' ELSE p_brand END, ''), 'unnamed profile') AS label,
CASE p_size WHEN 1 THEN 'daylight' WHEN 2 THEN 'fluorescent' WHEN 3 THEN 'tungsten' WHEN 4 THEN 'flash' WHEN 17 THEN 'A' WHEN 18 THEN 'B' WHEN 19 THEN 'C' WHEN 20 THEN 'D55' WHEN 21 THEN 'D65' WHEN 22 THEN 'D75' WHEN 23 THEN 'D50' WHEN 24 THEN 'studio tungsten' ELSE 'light source ' || p_size END AS light,
format('rms {:.3f} %, worst tile {:.3f} %, 99.9 % within {:.2f} %', p_size / 67.0::DOUBLE, p_size / 33.0::DOUBLE, p_size / 7.0::DOUBLE) AS errors,
CASE p_size % 4 WHEN 0 THEN 'no illuminants' WHEN 1 THEN 'one illuminant (D65)' WHEN 2 THEN 'two illuminants (D65, A)' ELSE 'three illuminants (D65, A, flash)' END || CASE WHEN p_size % 5 = 0 THEN ', forward matrix' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ', hue and saturation table 90x30x1' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN ', tone curve' ELSE '' END AS summary
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN ' . ' ELSE p_brand END AS s FROM part)"""
)
def description_texts(spark, sf_dir):
    c, size = F.col, F.col("p_size")
    lights = F.slice(F.array(F.lit(21), F.lit(17), F.lit(4)), F.lit(1), size % 4)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        frames.serial(F.when(size % 3 == 0, " . ").otherwise(c("p_brand"))).alias("serial"),
        frames.joined_notes(F.when(size % 3 == 0, c("p_brand")).otherwise(""), F.when(size % 2 == 0, c("p_type"))).alias("notes"),
        frames.profile_label(F.when(size % 4 == 0, "").otherwise(c("p_name")), F.when(size % 8 == 0, "").otherwise(c("p_brand"))).alias("label"),
        frames.illuminant(size).alias("light"),
        frames.error_text(size / 6700.0, size / 3300.0, size / 700.0).alias("errors"),
        frames.profile_summary(lights, size % 5 == 0, F.when(size % 2 == 0, F.array(F.lit(90), F.lit(30), F.lit(1))), F.lit(None).cast("array<int>"), size % 7 == 0).alias("summary"),
    )


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN 'cut at ' || l_partkey END AS cut, ['intact', 'unverified', 'damaged'][l_partkey % 3 + 1] AS raw, ['absent', 'intact', 'unverified', 'damaged'][l_suppkey % 4 + 1] AS orig, l_linenumber % 2 = 0 AS mask, l_suppkey % 5 = 0 AS has, l_partkey % 7 = 0 AS comp, 256 + l_suppkey % 8 AS version FROM lineitem),
v AS (SELECT *, cut IS NOT NULL OR raw = 'damaged' OR orig = 'damaged' AS bad, raw = 'intact' AND orig IN ('intact', 'absent') AS good FROM f)
SELECT l_orderkey, l_linenumber, CASE WHEN bad THEN 'damaged' WHEN good THEN 'intact' ELSE 'unverified' END AS outcome,
CASE WHEN bad THEN 'DAMAGED: ' || coalesce(cut, concat_ws('; ', CASE WHEN raw = 'damaged' THEN 'raw detail' END, CASE WHEN orig = 'damaged' THEN 'original detail' END)) WHEN good THEN 'intact (raw image' || CASE WHEN orig = 'intact' THEN ', embedded original' ELSE '' END || ')'
ELSE 'not verified: ' || concat_ws('; ', CASE WHEN raw = 'intact' THEN 'raw image intact' ELSE 'raw detail' END, CASE WHEN orig = 'intact' THEN 'embedded original intact' WHEN orig = 'unverified' THEN 'embedded original original detail' END) END AS "text",
CASE WHEN bad OR mask OR has THEN NULL WHEN comp OR version >= 260 THEN 'new' ELSE 'old' END AS addable FROM v"""
)
def check_texts(spark, sf_dir):
    c = F.col
    pick = lambda of, col: F.element_at(F.array(*[F.lit(x) for x in of]), (c(col) % len(of) + 1).cast("int"))
    cut = F.when(c("l_orderkey") % 9 == 0, F.concat(F.lit("cut at "), c("l_partkey").cast("string")))
    raw, original = pick(("intact", "unverified", "damaged"), "l_partkey"), pick(("absent", "intact", "unverified", "damaged"), "l_suppkey")
    said = frames.verdict_text(cut, raw, F.lit("raw detail"), original, F.lit("original detail"))
    bad = cut.isNotNull() | (raw == "damaged") | (original == "damaged")
    add = frames.addable_digest(256 + c("l_suppkey") % 8, c("l_partkey") % 7 == 0, bad, c("l_linenumber") % 2 == 0, c("l_suppkey") % 5 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", said.alias("s"), add.alias("addable")).select("l_orderkey", "l_linenumber", "s.*", "addable")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, [8, 16, 12, 4][l_partkey % 4 + 1] AS bits, l_suppkey % 10 AS planes, l_linenumber % 2 + 1 AS planar, 1 + l_orderkey % 11 // 10 AS fmt, 1 + l_orderkey % 13 // 12 AS fill, [1, 7, 8, 52546, 34892, 5][l_partkey % 6 + 1] AS comp, l_orderkey % 17 AS rf, 1 AS cf, l_partkey % 100 AS w, 16 AS h FROM lineitem),
d AS (SELECT *, CASE WHEN w <= 0 THEN 'the raw image has no size' WHEN planes NOT BETWEEN 1 AND 8 THEN 'the raw image has an impossible number of colour planes' WHEN comp = 52546 AND planes NOT IN (1, 3) THEN 'JPEG XL data with other than one or three colour planes' WHEN rf <= 0 OR rf > h OR cf > w THEN 'the raw image has an impossible interleave factor' END AS damage FROM a)
SELECT l_orderkey, l_linenumber, damage, CASE WHEN damage IS NOT NULL THEN NULL WHEN fmt <> 1 THEN 'floating-point raw data' WHEN bits NOT BETWEEN 8 AND 16 THEN bits || ' bits per sample' WHEN planes > 1 AND planar <> 1 THEN 'colour planes stored separately' WHEN fill <> 1 THEN 'reversed bit order' WHEN comp = 8 THEN 'Deflate compression' WHEN comp = 34892 THEN 'lossy JPEG compression' WHEN comp NOT IN (1, 7, 52546) THEN 'compression type ' || comp END AS unsupported FROM d"""
)
def layout_verdicts(spark, sf_dir):
    c = F.col
    pick = lambda of, col: F.element_at(F.array(*[F.lit(x) for x in of]), (c(col) % len(of) + 1).cast("int"))
    one = lambda col, n: 1 + F.floor(c(col) % n / (n - 1))
    made = frames.layout_reasons(pick((8, 16, 12, 4), "l_partkey"), c("l_suppkey") % 10, c("l_linenumber") % 2 + 1, one("l_orderkey", 11), one("l_orderkey", 13), pick((1, 7, 8, 52546, 34892, 5), "l_partkey"), c("l_orderkey") % 17, F.lit(1), c("l_partkey") % 100, F.lit(16))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query(
    """SELECT p_partkey, CAST(CASE WHEN v < 0 THEN -n ELSE n END AS BIGINT) AS num, d AS den FROM (SELECT p_partkey, (p_size - 25) / 8.0::DOUBLE AS v, CASE WHEN p_size = 25 THEN 0 ELSE abs(p_size - 25) // gcd(abs(p_size - 25), 8) END AS n, CASE WHEN p_size = 25 THEN 1 ELSE 8 // gcd(abs(p_size - 25), 8) END AS d FROM part)"""
)
def signed_rationals(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", small.signed_rational((F.col("p_size") - 25) / 8.0).alias("r")).select("p_partkey", "r.*")


@query(
    """SELECT o_orderkey, upper(lpad(to_hex(o_orderkey), 8, '0')) AS big, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS little, '00000001' || '00000004' || '01030000' || '00000001' || '00000008' || '00000000' || lpad(CAST(CASE WHEN o_custkey % 5 > 3 THEN NULL ELSE xor((o_custkey % 5)::INTEGER, 1) END AS VARCHAR), 8, '0') AS opcode
FROM (SELECT *, upper(lpad(to_hex(o_orderkey), 8, '0')) AS h FROM orders)"""
)
def byte_orders(spark, sf_dir):
    word = F.unhex(F.lpad(F.hex("o_orderkey"), 8, "0"))
    phase = F.when(F.col("o_custkey") % 5 > 3, -1).otherwise(F.col("o_custkey") % 5)
    opcode = frames.bad_pixels_opcode(F.lit(0), frames.written_phase(phase))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(word).alias("big"), F.hex(frames.swapped(word, F.lit(4))).alias("little"), F.hex(opcode).alias("opcode"))


# Colours

_PLANES = 3
_BASE = [0.83, -0.18, -0.11, -0.5, 1.29, 0.23, -0.12, 0.28, 0.61]
_M = [f"({b}::DOUBLE + (p_size * {k + 1} % 7) / 100.0::DOUBLE)" for k, b in enumerate(_BASE)]
_ROW = lambda p, c: "(" + " + ".join(f"m{3 * p + k} * {colour.XYZ_OF_SRGB[k][c]}::DOUBLE" for k in range(3)) + ")"
_CROSS = lambda a, b: [f"({x}{y})" for x, y in ((f"n{a}1 * n{b}2", f" - n{a}2 * n{b}1"), (f"n{a}2 * n{b}0", f" - n{a}0 * n{b}2"), (f"n{a}0 * n{b}1", f" - n{a}1 * n{b}0"))]
_COFACTORS = [_CROSS(1, 2), _CROSS(2, 0), _CROSS(0, 1)]


@query(
    f"""WITH m AS (SELECT p_partkey, {", ".join(f"{e} AS m{k}" for k, e in enumerate(_M))} FROM part),
r AS (SELECT p_partkey, {", ".join(f"{_ROW(p, c)} AS r{p}{c}" for p in range(3) for c in range(3))} FROM m),
n AS (SELECT p_partkey, {", ".join(f"r{p}{c} / (r{p}0 + r{p}1 + r{p}2) AS n{p}{c}" for p in range(3) for c in range(3))}, {", ".join(f"r{p}0 + r{p}1 + r{p}2 AS d{p}" for p in range(3))} FROM r),
v AS (SELECT *, {" + ".join(f"n0{c} * {_COFACTORS[0][c]}" for c in range(3))} AS det FROM n)
SELECT p_partkey, {", ".join(f"round({_COFACTORS[p][c]} / det, 6) AS c{c}{p}" for c in range(3) for p in range(3))}, {", ".join(f"round(greatest(d0, d1, d2) / d{p}, 6) AS b{p}" for p in range(3))} FROM v"""
)
def colour_transforms(spark, sf_dir):
    """A square matrix has its inverse for the least squares, which is what the SQL says."""
    matrix = F.array(*[F.lit(b) + (F.col("p_size") * (k + 1) % 7) / 100.0 for k, b in enumerate(_BASE)])
    found = table(spark, sf_dir, "part").select("p_partkey", colour.colour_transform(matrix, _PLANES).alias("t"))
    at = lambda field, k, name: F.round(F.get(f"t.{field}", F.lit(k)), 6).alias(name)
    return found.select("p_partkey", *[at("rgb", 3 * c + p, f"c{c}{p}") for c in range(3) for p in range(3)], *[at("balance", p, f"b{p}") for p in range(3)])


# Lines


_BYTES = "lower(lpad(to_hex(v & 255), 2, '0') || lpad(to_hex(v >> 8), 2, '0'))"


@query(
    with_plane(f""", {_PICTURES}, t AS (SELECT image, y // 20 AS ty, x // 2 // 20 AS tx, md5(unhex(string_agg({_BYTES}, '' ORDER BY x % 2, y, x))) AS d FROM pics GROUP BY 1, 2, 3)
SELECT image, md5(unhex(string_agg(d, '' ORDER BY ty, tx))) AS digest, count(*) AS n FROM t GROUP BY 1""")
)
def digest_planes(spark, sf_dir):
    return lines.image_digests(picture_lines(spark, sf_dir), ["image"], 20, 2)


@query(with_plane(f""", {_PICTURES}, t AS (SELECT image, y // 32 AS ty, x // 32 AS tx, md5(unhex(string_agg(lower(lpad(to_hex(v & 255), 2, '0')), '' ORDER BY y, x))) AS d FROM pics GROUP BY 1, 2, 3)
SELECT image, md5(unhex(string_agg(d, '' ORDER BY ty, tx))) AS digest, count(*) AS n FROM t GROUP BY 1"""))
def digest_bytes(spark, sf_dir):
    return lines.image_digests(picture_lines(spark, sf_dir), ["image"], 32, 1, 1)


@query(with_plane(f""", {_PICTURES}, h AS (SELECT image, y, x, CASE WHEN (y * 31 + x * 17) % 97 = 0 THEN 0 ELSE v END AS v FROM pics), z AS (SELECT image, count(*) AS n FROM h WHERE v = 0 GROUP BY 1) SELECT image, n AS repaired FROM z"""))
def repaired_count(spark, sf_dir):
    holes = picture_lines(spark, sf_dir).withColumn("line", F.transform("line", lambda v, x: F.when((F.col("y") * 31 + x * 17) % 97 == 0, 0).otherwise(v)))
    return lines.repaired_counts(lines.repaired(holes, ["image"]), ["image"])


@query(with_plane(f""", {_PICTURES}, r AS (SELECT image, min(v) // 300 AS low, max(v) // 300 AS high FROM pics GROUP BY 1) SELECT image, CASE WHEN high < low + 255 THEN least(65535, low + 255) - 255 ELSE low END AS lower, CASE WHEN high < low + 255 THEN least(65535, low + 255) ELSE high END AS upper FROM r"""))
def value_range(spark, sf_dir):
    own = picture_lines(spark, sf_dir).withColumn("linear", F.transform("line", lambda v: F.floor(v / 300)))
    return lines.value_ranges(own, ["image"])


_U = "((v - lower) / (upper - lower)::DOUBLE)"
_SPAN = "(2 * sqrt(1.0::DOUBLE / 45))"
_ENCODED = f"{_SPAN} * sinh(asinh({_U} * 4 / (power({_SPAN}, 3) * (15.0::DOUBLE / 16))) / 3)"


@query(
    f"""WITH r AS (SELECT n_nationkey AS image, n_nationkey * 100 AS lower, 40000 + n_nationkey * 1000 AS upper FROM nation), t AS (SELECT image, CAST(v AS INTEGER) AS v, {_U} AS u, {_ENCODED} AS e FROM r, range(65536) s(v))
SELECT image, CAST(sum(CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 65535 ELSE round(e * 65535) END) AS BIGINT) AS total, count(*) AS n FROM t GROUP BY 1"""
)
def tone_table(spark, sf_dir):
    ranges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image"), (F.col("n_nationkey") * 100).alias("lower"), (F.col("n_nationkey") * 1000 + 40000).alias("upper"))
    return lines.tone_tables(ranges, ["image"]).groupBy("image").agg(F.sum("stored").alias("total"), F.count("*").alias("n"))


@query(with_plane(f""", {_PICTURES} SELECT image, count(*) AS n, count(*) FILTER (WHERE (y * 3 + x) % 101 = 0) AS differing FROM pics GROUP BY 1"""))
def verify_lines(spark, sf_dir):
    own = picture_lines(spark, sf_dir)
    copy = own.withColumn("line", F.transform("line", lambda v, x: F.when((F.col("y") * 3 + x) % 101 == 0, v + 1).otherwise(v)))
    return lines.differing(own, copy, ["image"])


@query(
    with_plane(""", pairs AS (SELECT y // 250 AS image, y, x, v, v + (y * 7 + x * 13) % 41 - 20 + CASE WHEN (y * 5 + x) % 997 = 0 THEN 900 ELSE 0 END AS stored FROM plane), m AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, 2)) t(dy, dx)),
s AS (SELECT a.image, dy, dx, (a.y % 2) * 2 + a.x % 2 AS field, sum(((a.stored - a.v) * (a.stored - a.v))::DOUBLE) AS own, sum(((a.stored - b.v) * (a.stored - b.v))::DOUBLE) AS moved
FROM pairs a CROSS JOIN m JOIN pairs b ON a.image = b.image AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4), g AS (SELECT *, CASE WHEN own = moved THEN NULL WHEN own > 0 THEN (moved - own) / own ELSE 1e9 END AS margin FROM s)
SELECT image, round(min(margin), 6) AS margin FROM g GROUP BY 1""")
)
def least_margin(spark, sf_dir):
    return errors.alignment(_noisy(spark, sf_dir), ["image"], [(0, 1), (1, 0), (0, 2)], 2, 2).groupBy("image").agg(F.round(F.min("margin"), 6).alias("margin"))


_SRGB = colour.SRGB_OF_XYZ


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 AS c, 1 + o_custkey % 50 / 100.0::DOUBLE AS u, o_orderkey % 40 / 100.0::DOUBLE AS v, o_custkey % 30 / 100.0::DOUBLE AS w FROM orders),
i AS (SELECT k, c, [1 / u, -v / u, v * w / (u * u), 0, 1, -w / u, 0, 0, 1 / u] AS m FROM o),
e AS (SELECT k, c, p, q, CASE c WHEN 0 THEN (p * 3 + q) / 8.0::DOUBLE WHEN 1 THEN list_sum([m[p * 3 + j + 1] * {list(_SRGB)}[j * 3 + q + 1] FOR j IN [0, 1, 2]]) / [2.0, 1.0, 1.5][p + 1] ELSE {list(_SRGB)}[p * 3 + q + 1] END AS x FROM i, range(3) s(p), range(3) t(q))
SELECT k, ['known', 'derived', 'srgb'][c + 1] AS source, p * 3 + q AS place, round(x, 4) AS x FROM e"""
)
def colour_matrices(spark, sf_dir):
    """The matrix of every order's camera: its own, one derived from a triangular matrix, or sRGB's."""
    c = F.col
    case, u, v, w = c("o_orderkey") % 3, 1 + c("o_custkey") % 50 / 100.0, c("o_orderkey") % 40 / 100.0, c("o_custkey") % 30 / 100.0
    one, zero = F.lit(1.0), F.lit(0.0)
    to_srgb = F.when(case == 2, F.array(*[zero] * 9)).otherwise(F.array(u, v, zero, zero, one, w, zero, zero, u))
    known = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(case == 0, i / 8.0).otherwise(0.0))
    made = colour.camera_matrix(c("known"), c("to_srgb"), F.array(*[F.lit(x) for x in (2.0, 1.0, 1.5)]), F.lit(3))
    given = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), known.alias("known"), to_srgb.alias("to_srgb"))
    rows = given.select("k", made.alias("m")).select("k", "m.source", F.posexplode("m.matrix").alias("place", "x"))
    return rows.select("k", "source", F.col("place").cast("bigint").alias("place"), F.round("x", 4).alias("x"))


_LETTERS, _NUMBERS = ["RGBG", "RGBE", "CYMG", "RXBG"], [3, 3, 4, 3]


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS c, o_custkey % 3 AS s FROM orders),
l AS (SELECT *, {_LETTERS}[c + 1] AS letters, {_NUMBERS}[c + 1] AS number, CASE WHEN k % 7 = 0 THEN 36 ELSE 16 END AS n FROM o),
p AS (SELECT *, list_transform(range(n), lambda i: CASE WHEN s = 0 THEN i % 4 WHEN s = 1 THEN i % 8 // 2 ELSE (i + i // 9) % 4 END) AS x FROM l),
m AS (SELECT *, CASE WHEN n = 36 THEN 6 WHEN len(list_filter(range(16), lambda i: x[i + 1] <> x[i % 4 + 1])) = 0 THEN 2 WHEN len(list_filter(range(16), lambda i: x[i + 1] <> x[i % 8 + 1])) = 0 THEN 4 ELSE 8 END AS r FROM p)
SELECT k, CASE WHEN c <> 3 THEN r END AS "rows", CASE WHEN c <> 3 THEN array_to_string(list_transform(x[1:CASE WHEN n = 36 THEN 36 ELSE r * 2 END], lambda i: CASE WHEN i = 3 AND number = 3 THEN 1 ELSE i END), '') END AS pattern,
CASE c WHEN 0 THEN '012' WHEN 1 THEN '012' WHEN 2 THEN '3541' END AS planes, CASE WHEN c = 3 THEN 'colour filter ''X'' has no DNG equivalent' END AS reason FROM m"""
)
def filter_patterns(spark, sf_dir):
    """Patterns of eight rows of two and of six by six, with the planes that their indices stand for."""
    k, case, s = F.col("o_orderkey"), F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    n = F.when(k % 7 == 0, 36).otherwise(16)
    colours = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(s == 0, i % 4).when(s == 1, F.floor(i % 8 / 2)).otherwise((i + F.floor(i / 9)) % 4).cast("int"))
    of = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (case + 1).cast("int"))
    found = frames.filter_pattern(colours, of(_LETTERS), of(_NUMBERS), F.lit(False))
    text = lambda c: F.array_join(c.cast("array<string>"), "")
    return table(spark, sf_dir, "orders").select(k.alias("k"), found.alias("f")).select("k", "f.rows", text(F.col("f.pattern")).alias("pattern"), text(F.col("f.plane_colours")).alias("planes"), "f.reason")


@query(
    "SELECT vec_id, vec_id % 6 <> 5 AS sound, vec_id % 6 <> 5 AND vec_id % 2 = 0 AS \"on\" FROM embeddings"
)
def sixteen_words(spark, sf_dir):
    """Tags of thirty-two bytes with their four checksums; in some a byte has changed since."""
    k = F.col("vec_id")
    byte = lambda i: F.floor((F.get("embedding", F.lit(i)).cast("double") + 1) * 127).cast("bigint")
    middle = [F.when(k % 2 == 0, F.lit(1)).otherwise(F.lit(2)) if i == 14 else byte(i) for i in range(4, 28)]
    step = lambda part: rules.word_checksum(F.array(*part))
    low, high = lambda v: v.bitwiseAND(255), lambda v: F.shiftright(v, 8)
    first, last = step(middle[:12]), step(middle[12:])
    inner = [low(first), high(first), *middle, low(last), high(last)]
    evens, odds = step(inner[0::2]), step(inner[1::2])
    whole = [low(evens), high(evens), *inner, low(odds), high(odds)]
    data = F.transform(F.array(*whole), lambda v, i: F.when((k % 6 == 5) & (i == k % 32), v.bitwiseXOR(F.lit(1).cast("bigint"))).otherwise(v))
    made = table(spark, sf_dir, "embeddings").select("vec_id", data.alias("data"))
    return made.select("vec_id", rules.sixteen_words(F.col("data")).alias("r")).select("vec_id", "r.sound", "r.on")


@query("SELECT DISTINCT url AS path, dense_rank() OVER (ORDER BY url) AS ord FROM pages")
def path_order(spark, sf_dir):
    """All pages' addresses as paths, in the order of their bytes."""
    return catalog.ordered_jobs(table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()).select("path", "ord")


# Directories

_TAGS = (0, 1, 270, 315, 33432, 37500, 40965, 700, 254, 256, 50706, 41995)


def _entries(spark, sf_dir):
    """Line items as directory entries: an order is a file, its lines are entries of a few directories."""
    tag = F.element_at(F.array(*[F.lit(x) for x in _TAGS]), (F.col("l_partkey") % len(_TAGS) + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("main", "exif", "gps", "sub")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    value = F.unhex(F.lpad(F.hex(F.col("l_suppkey") % 5), 8, "0"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), (F.col("l_linenumber") % 4).alias("ifd"), kind.alias("kind"), "l_linenumber", tag.alias("tag"), F.lit(4).alias("type"), F.lit(1).cast("bigint").alias("count"), value.alias("value"), F.lit(True).alias("big_endian")
    )


_ENTRIES = f"e AS (SELECT l_orderkey AS path, l_linenumber % 4 AS ifd, ['main', 'exif', 'gps', 'sub'][l_linenumber % 4 + 1] AS kind, l_linenumber, {list(_TAGS)}[l_partkey % {len(_TAGS)} + 1] AS tag, l_suppkey % 5 AS number FROM lineitem)"


@query(
    f"""WITH {_ENTRIES} SELECT path, ifd, l_linenumber, tag FROM e WHERE (kind = 'exif' AND tag NOT IN (37500, 40965, 59932, 59933, 41730, 34856, 37388, 41484, 41995)) OR (kind = 'main' AND tag IN (270, 315, 33432, 700))
OR (kind = 'gps' AND (path, ifd) IN (SELECT (path, ifd) FROM e WHERE kind = 'gps' AND tag <> 0))"""
)
def metadata_kept(spark, sf_dir):
    return directories.kept_metadata(_entries(spark, sf_dir)).select("path", "ifd", "l_linenumber", "tag")


@query(f"WITH {_ENTRIES} SELECT path, ifd, string_agg(tag::VARCHAR, ',' ORDER BY tag) AS tags, count(tag) > count(DISTINCT tag) AS refused FROM e GROUP BY 1, 2")
def tag_order(spark, sf_dir):
    return directories.sorted_tags(_entries(spark, sf_dir)).withColumn("tags", F.array_join(F.col("tags").cast("array<string>"), ","))


@query(
    f"""WITH {_ENTRIES}, i AS (SELECT path, ifd, max(CASE WHEN tag = 254 THEN number END) AS subfile, max(tag = 256) AS sized, max(tag = 50706) AS versioned FROM e WHERE kind IN ('main', 'sub') GROUP BY 1, 2)
SELECT path, max(ifd = 0 AND versioned) AS is_dng, min(CASE WHEN subfile = 0 AND sized THEN ifd END) AS raw_ifd, coalesce(max(subfile = 4), false) AS has_mask FROM i GROUP BY 1"""
)
def raw_directory(spark, sf_dir):
    return directories.raw_directories(directories.with_numbers(_entries(spark, sf_dir)))


def _layout_entries(spark, sf_dir):
    """Orders as directories of strips: a size, a height of strips, and tables of offsets and lengths."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 90).alias("w"), (F.col("o_orderkey") % 50).alias("h"), (F.col("o_custkey") % 12 + 1).alias("rows"))
    n = F.greatest(F.lit(1), F.ceil(F.col("h") / F.col("rows")) - F.when(F.col("path") % 11 == 0, 1).otherwise(0)).cast("int")
    long = lambda v: F.lpad(F.hex(v.cast("bigint")), 8, "0")
    many = lambda step: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: long(k * step + 8)), "")
    each = [(256, long(F.col("w"))), (257, long(F.col("h"))), (278, long(F.col("rows"))), (273, many(100)), (279, many(7))]
    row = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.unhex(v).alias("value")) for t, v in each]))
    return o.select("path", F.lit(0).alias("ifd"), F.lit("main").alias("kind"), row.alias("e")).select("path", "ifd", "kind", "e.tag", F.lit(4).alias("type"), F.lit(1).cast("bigint").alias("count"), "e.value", F.lit(True).alias("big_endian"))


@query(
    """WITH o AS (SELECT o_orderkey AS path, o_custkey % 90 AS w, o_orderkey % 50 AS h, o_custkey % 12 + 1 AS r FROM orders), n AS (SELECT *, greatest(1, (h + r - 1) // r - CASE WHEN path % 11 = 0 THEN 1 ELSE 0 END) AS n, least(r, h) AS rows FROM o),
s AS (SELECT *, (h + rows - 1) // rows AS down FROM n WHERE w > 0 AND h > 0)
SELECT path, 0 AS ifd, CAST(k AS INTEGER) AS chunk, 0 AS x, k * rows AS y, w AS width, least(rows, h - k * rows) AS "rows", k * 100 + 8 AS "offset", k * 7 + 8 AS bytes FROM s, range(60) t(k) WHERE k < down AND n >= down"""
)
def chunk_table(spark, sf_dir):
    return directories.chunks(directories.layouts(directories.with_numbers(_layout_entries(spark, sf_dir))))


# Profiles


def _value(v, size, big):
    """The digits of a number in one of the two orders."""
    h = F.lpad(F.hex(v.cast("bigint")), 2 * size, "0")
    return h if big else binary.turned(h, size)


#: What is wrong with the profile of a part, by its key modulo eight; 6 (a field that no profile has) is sound.
_DEFECTS = ("", "ColorMatrix1 holds a division by zero", "ColorMatrix1 has the wrong type", "ColorMatrix1 cannot be inverted", "ProfileName occurs twice", "CalibrationIlluminant1 has the wrong type", "", "the tone curve is not a list of points")


def _profile_files(spark, sf_dir, big, wide):
    """A profile file a part: a matrix, a light source, a name, and something wrong with most of them."""
    key = F.col("p_partkey")
    case = key % 8
    kind = lambda n, usual, other: F.when(case == n, F.lit(other)).otherwise(F.lit(usual))
    matrix = []
    for i in range(9):
        plain = F.lit(10000) if i % 4 == 0 else (key * (i + 3)) % 997
        matrix += [F.when(case == 3, 10000).otherwise(plain), F.when((case == 1) & F.lit(i == 5), 0).otherwise(10000)]
    name = F.concat(F.hex(F.lpad((key % 5).cast("string"), 7, "P").cast("binary")), F.lit("00"))
    light = F.lit(21) if not wide else F.when(case == 5, 70000).otherwise(21)
    # (tag, type, count, digits); the places of long values follow the twelve bytes of each of six entries.
    own = [
        (F.lit(50708), F.lit(2), F.lit(4), F.lit("43616D00")),
        (F.lit(50936), F.lit(2), F.lit(8), name),
        (F.lit(50721), kind(2, 10, 5), F.lit(9), F.concat(*[_value(v, 4, big) for v in matrix])),
        (F.lit(50778), F.lit(4) if wide else kind(5, 3, 2), F.lit(1), F.concat(_value(light, 4, big)) if wide else F.concat(_value(light, 2, big), F.lit("0000"))),
        (F.when(case == 4, 50936).when(case == 6, 50001).when(case == 7, 50940).otherwise(51110), F.when(case == 4, 2).when(case == 7, 11).otherwise(4), F.when(case == 7, 3).when(case == 4, 4).otherwise(1), F.lit("00000000")),
        (F.lit(52552), F.lit(2), F.lit(3), F.lit("47310000")),
    ]
    at = 8 + 2 + 12 * len(own) + 4
    head = F.lit("4D4D4352" if big else "49495243")
    places = {1: at, 2: at + 8, 4: at + 80}
    parts = [head, _value(F.lit(8), 4, big), _value(F.lit(len(own)), 2, big)]
    for k, (tag, t, n, digits) in enumerate(own):
        # A curve of three values is kept behind the others; what takes four bytes is in its entry.
        spot = _value(F.lit(places[k]), 4, big) if k in places else None
        value = digits if spot is None else F.when(case == 7, spot).otherwise(digits) if k == 4 else spot
        parts += [_value(tag, 2, big), _value(t, 2, big), _value(n, 4, big), value]
    content = F.unhex(F.concat(*parts, F.lit("00000000"), own[1][3], own[2][3], F.lit("00" * 12)))
    path = F.concat(F.lit("/p/"), key.cast("string"), F.lit(f"-{'big' if big else 'little'}.dcp"))
    return table(spark, sf_dir, "part").select(path.alias("path"), content.alias("content"))


_PROFILE_SQL = f"""p AS (SELECT p_partkey AS k, p_partkey % 8 AS c FROM part),
m AS (SELECT k, i, CASE WHEN c = 3 THEN 10000 WHEN i % 4 = 0 THEN 10000 ELSE (k * (i + 3)) % 997 END AS v FROM p, range(9) t(i)),
h AS (SELECT k, string_agg(substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) || '10270000', '' ORDER BY i) AS matrix FROM (SELECT *, lpad(to_hex(v), 8, '0') AS x FROM m) GROUP BY 1),
r AS (SELECT k, c, {list(_DEFECTS)}[c + 1] AS reason, md5(unhex('21C60A0009000000' || matrix || '5AC60300010000001500' || 'F8C6020008000000' || hex(lpad((k % 5)::VARCHAR, 7, 'P')) || '00'
 || CASE WHEN c = 6 THEN '' ELSE 'A6C704000100000000000000' END || '48CD020003000000473100')) AS digest FROM p JOIN h USING (k))"""


@query(
    f"""WITH {_PROFILE_SQL}
SELECT '/p/' || k || '-' || o || '.dcp' AS path, reason, CASE WHEN reason = '' THEN digest END AS digest, CASE WHEN reason = '' THEN lpad((k % 5)::VARCHAR, 7, 'P') || ' for Cam, G1, 3 planes: one illuminant (D65)' END AS said FROM r, (VALUES ('big'), ('little')) v(o)"""
)
def profile_check(spark, sf_dir):
    """Profiles in both byte orders, and with numbers of both widths: the first reason, or the digest, which is one for both."""
    made = profiles.profiles(_profile_files(spark, sf_dir, True, True).unionByName(_profile_files(spark, sf_dir, False, False)))
    said = F.concat("label", F.lit(" for "), "camera", F.lit(", "), "group_name", F.lit(", "), F.col("profile_planes").cast("string"), F.lit(" planes: "), "summary")
    sound = F.col("reason").isNull()
    return made.select("path", F.coalesce("reason", F.lit("")).alias("reason"), F.when(sound, F.col("digest")).alias("digest"), F.when(sound, said).alias("said"))


@query(
    f"""WITH {_PROFILE_SQL} SELECT digest, '/p/' || min(k::VARCHAR || '-big.dcp') AS path FROM r WHERE reason = '' GROUP BY 1"""
)
def profile_fingerprint(spark, sf_dir):
    """Each different profile once, by its first path."""
    made = profiles.profiles(_profile_files(spark, sf_dir, True, True).unionByName(_profile_files(spark, sf_dir, False, False)))
    return profiles.library(made).select("digest", "path")


@query(
    """WITH c AS (SELECT o_orderkey AS k, o_orderdate AS t, o_custkey % 3 AS d FROM orders WHERE o_custkey % 3 > 0) SELECT o_orderkey AS k, tag, CASE WHEN tag = 36867 AND o_custkey % 3 = 0 THEN 'camera' WHEN tag = 36867 THEN 'decoder' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'camera' ELSE 'decoder' END END AS origin,
CASE WHEN tag = 36867 THEN CASE WHEN o_custkey % 3 = 0 THEN 'c' ELSE 'd' END ELSE CASE WHEN o_custkey % 2 = 0 THEN 'c' ELSE 'd' END END || o_orderkey AS v FROM orders, (VALUES (36867), (33434)) t(tag)"""
)
def directory_assembly(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    field = lambda tag, prefix: F.struct(F.lit(tag).alias("tag"), F.concat(F.lit(prefix), F.col("o_orderkey").cast("string")).alias("v"))
    rows = lambda *f: o.select(F.col("o_orderkey").alias("k"), "o_custkey", F.explode(F.array(*f)).alias("f")).select("k", "o_custkey", "f.tag", "f.v")
    decoder = rows(field(36867, "d"), field(33434, "d")).drop("o_custkey")
    camera = rows(field(36867, "c"), field(33434, "c")).where(((F.col("tag") == 36867) & (F.col("o_custkey") % 3 == 0)) | ((F.col("tag") == 33434) & (F.col("o_custkey") % 2 == 0))).drop("o_custkey")
    return archive.overridden(camera, decoder, ["k", "tag"], "v")


# Rules that had no query of their own


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, ['all', 'camera', 'none'][l_orderkey % 3 + 1] AS mode, l_partkey % 2 = 0 AS en, l_suppkey % 4 = 0 AS data, [[0, 1, 1, 2], [1, 0, 2, 1], [1, 2, 0, 1], [2, 1, 1, 0], [0, 1, 2, 1]][l_partkey % 5 + 1] AS p, l_linenumber % 2 AS t, l_orderkey % 2 AS l FROM lineitem),
s AS (SELECT *, concat(p[t * 2 + l + 1], p[t * 2 + (1 - l) + 1], p[(1 - t) * 2 + l + 1], p[(1 - t) * 2 + (1 - l) + 1]) AS seen FROM a)
SELECT l_orderkey, l_linenumber, (mode = 'all' OR (mode = 'camera' AND en)) AND NOT data AS wanted, CASE seen WHEN '0112' THEN 0 WHEN '1021' THEN 1 WHEN '1201' THEN 2 WHEN '2110' THEN 3 ELSE -1 END AS phase, CASE seen WHEN '0112' THEN 1 WHEN '1021' THEN 0 WHEN '1201' THEN 3 WHEN '2110' THEN 2 END AS written FROM s"""
)
def phases_and_wishes(spark, sf_dir):
    c = F.col
    mode = F.element_at(F.array(*[F.lit(x) for x in ("all", "camera", "none")]), (c("l_orderkey") % 3 + 1).cast("int"))
    patterns = F.array(*[F.array(*[F.lit(x) for x in p]) for p in ((0, 1, 1, 2), (1, 0, 2, 1), (1, 2, 0, 1), (2, 1, 1, 0), (0, 1, 2, 1))])
    phase = rules.bayer_phase(F.element_at(patterns, (c("l_partkey") % 5 + 1).cast("int")), c("l_linenumber") % 2, c("l_orderkey") % 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.correction_wanted(mode, c("l_partkey") % 2 == 0, c("l_suppkey") % 4 == 0).alias("wanted"), phase.alias("phase"), frames.written_phase(phase).alias("written"))


@query(
    """WITH a AS (SELECT p_partkey, p_brand, p_size % 2 = 0 AS jxl, CASE WHEN p_size % 5 = 0 THEN 262 END AS pv, p_size % 3 = 0 AS ops, p_size % 7 = 0 AS apart FROM part)
SELECT p_partkey, CASE WHEN jxl THEN '1.7.1.0' WHEN pv = 262 THEN '1.6.0.0' ELSE '1.4.0.0' END AS stored, CASE WHEN jxl THEN '1.7.' || CASE WHEN apart THEN 1 ELSE 0 END || '.0' WHEN ops THEN '1.3.0.0' ELSE '1.1.0.0' END AS oldest,
md5(unhex(md5(p_brand)) || encode(p_brand) || unhex(lpad(to_hex(p_partkey % 250), 2, '0') || '000000' || repeat('00', 20)) || encode('x')) AS unique_id FROM a"""
)
def versions_and_ids(spark, sf_dir):
    s = F.col("p_size")
    v = rules.file_versions(s % 2 == 0, F.when(s % 5 == 0, 262), s % 3 == 0, s % 7 == 0)
    own = rules.unique_id(F.md5("p_brand"), F.col("p_brand"), [F.col("p_partkey") % 250] + [F.lit(0)] * 5, F.lit("x").cast("binary"))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v"), own.alias("unique_id")).select("p_partkey", "v.*", "unique_id")


# Lenses


_KNOTS = 121
#: Lenses whose knots a task makes: the suppliers are a small file, but each has some hundred times its size of knots.
_LENSES_A_TASK = 250
_SHAPES = {"distortion": "0.98 + a * x - b * x * x", "red": "(a - 0.03) * r / 40", "blue": "(b - 0.01) * x / 30", "vignetting": "1 + 0.5 * x + a * x * x"}


def _lenses(spark, sf_dir):
    """A lens a supplier; every third has one plane only, every fourth has its centre beside the middle."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lens"))
    s = s.repartition(max(1, -(-s.count() // _LENSES_A_TASK)), "lens")
    off = F.when(F.col("lens") % 4 == 0, 10.0).otherwise(0.0)
    sizes = {"left": off, "top": off * 2, "width": F.lit(6000.0), "height": F.lit(4000.0), "active_width": off + 6000.0, "active_height": off * 3 + 4000.0, "planes": F.when(F.col("lens") % 3 == 0, 1).otherwise(3)}
    flags = {"square": True, "distortion_enabled": True, "ca_enabled": True, "vignetting_enabled": True, "vignetting_in_data": False, "fit_frame": False}
    own = s.select("lens", *[v.alias(k) for k, v in sizes.items()], *[F.lit(v).alias(k) for k, v in flags.items()])
    at = s.select("lens", (F.col("lens") % 7 / 100.0).alias("a"), (F.col("lens") % 5 / 200.0).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(_KNOTS - 1))).alias("k")).withColumn("r", F.col("k") / 100.0).withColumn("x", F.col("r") * F.col("r"))
    value = F.create_map(*[v for c, e in _SHAPES.items() for v in (F.lit(c), F.expr(e).cast("double"))])
    return own, at.select("lens", F.explode(value).alias("curve", "value"), F.col("r").alias("radius"))


_LENS_SQL = f"""l AS (SELECT s_suppkey AS lens, s_suppkey % 7 / 100.0::DOUBLE AS a, s_suppkey % 5 / 200.0::DOUBLE AS b, CASE WHEN s_suppkey % 4 = 0 THEN 10.0::DOUBLE ELSE 0 END AS o, s_suppkey % 3 <> 0 AS colour FROM supplier),
g AS (SELECT *, sqrt((o + 3000) ** 2 + (o * 2 + 2000) ** 2) AS unit, sqrt(6000.0 ** 2 + 4000.0 ** 2) / 2 AS half FROM l),
c AS (SELECT lens, k / 100.0::DOUBLE AS r, {", ".join(e.replace("x", "(k / 100.0::DOUBLE) ** 2").replace("r ", "(k / 100.0::DOUBLE) ") + f" AS {c}" for c, e in _SHAPES.items())} FROM l, range({_KNOTS}) t(k)),
e AS (SELECT c.*, {", ".join(f"lead({v}) OVER w AS {v}1" for v in ("r", *_SHAPES))} FROM c WINDOW w AS (PARTITION BY lens ORDER BY r)),
n AS (SELECT lens, CASE WHEN r = 0 THEN -1e9 ELSE r END AS low, * EXCLUDE (lens) FROM e WHERE r1 IS NOT NULL),
i AS (SELECT lens, colour, unit, half / unit AS edge, (i + 0.5) / 512 AS r, (i + 0.5) / 512 * unit / half AS place, i FROM g, range(512) t(i))"""


def _between(curve, at, t="n"):
    return f"({t}.{curve} + ({at} - {t}.r) * ({t}.{curve}1 - {t}.{curve}) / ({t}.r1 - {t}.r))"


def _solve_sql(keys, source, degree, first):
    """CTEs m0..: moments of (x, y, w) by keys, and the elimination of one unknown after the other; s has the solution c0, c1, ..."""
    n = degree + 1
    cells = [f"sum(w * x ** {2 * first + i + j}) AS a{i}{j}" for i in range(n) for j in range(i, n)] + [f"sum(w * y * x ** {first + i}) AS a{i}{n}" for i in range(n)]
    out = [f"m0 AS (SELECT {keys}, {', '.join(cells)} FROM {source} GROUP BY {keys})"]
    for k in range(degree):
        changed = [f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} AS a{i}{j}" for i in range(k + 1, n) for j in range(i, n + 1)]
        out.append(f"m{k + 1} AS (SELECT * REPLACE ({', '.join(changed)}) FROM m{k})")
    last = f"m{degree}"
    for k in reversed(range(n)):
        rest = "".join(f" - a{k}{j} * c{j}" for j in range(k + 1, n))
        out.append(f"b{k} AS (SELECT *, (a{k}{n}{rest}) / a{k}{k} AS c{k} FROM {last})")
        last = f"b{k}"
    return ", ".join(out)


def _at_sql(degree, x="x"):
    out = f"c{degree}"
    for k in reversed(range(degree)):
        out = f"({out} * {x} + c{k})"
    return out


@query(
    f"""WITH {_LENS_SQL},
d AS (SELECT i.*, {_between("distortion", "i.place")} AS f FROM i ASOF JOIN n ON i.lens = n.lens AND i.place >= n.low),
p AS (SELECT lens, 1 AS plane, unit, edge, r, i, f AS y FROM d UNION ALL
 SELECT d.lens, q, unit, edge, d.r, i, f * (1 + CASE q WHEN 0 THEN {_between("red", "d.z")} ELSE {_between("blue", "d.z")} END) FROM (SELECT *, place * f AS z FROM d) d ASOF JOIN n ON d.lens = n.lens AND d.z >= n.low, (VALUES (0), (2)) v(q) WHERE colour),
w AS (SELECT *, r * r AS x, r * r * CASE WHEN r <= edge THEN 1 ELSE 0.02 END AS w FROM p), {_solve_sql("lens, plane", "w", 3, 0)},
j AS (SELECT w.lens, max(abs({_at_sql(3)} - y) * r * unit) FILTER (WHERE r <= edge) AS error FROM w JOIN b0 USING (lens, plane) GROUP BY 1)
SELECT lens, plane, {", ".join(f"round(c{k}, 3) + 0 AS c{k}" for k in range(4))}, round(error, 1) AS error FROM b0 JOIN j USING (lens)"""
)
def lens_warps(spark, sf_dir):
    own, knots = _lenses(spark, sf_dir)
    made = lenses.corrections(own, knots, ["lens"], "all")
    each = made.select("lens", F.round("warp_error", 1).alias("error"), F.posexplode("warps").alias("at", "c"), F.size("warps").alias("n"))
    plane = F.when(F.col("n") == 1, 1).otherwise(F.col("at"))
    return each.select("lens", plane.alias("plane"), *[(F.round(F.col("c")[k], 3) + 0).alias(f"c{k}") for k in range(4)], "error")


@query(
    f"""WITH {_LENS_SQL}, v AS (SELECT i.*, {_between("vignetting", "i.place")} AS g FROM i ASOF JOIN n ON i.lens = n.lens AND i.place >= n.low),
w AS (SELECT *, r * r AS x, g - 1 AS y, CASE WHEN r <= edge THEN 1 ELSE 0.02 END / (g * g) AS w FROM v), {_solve_sql("lens", "w", 4, 1)},
j AS (SELECT w.lens, max(abs({_at_sql(4)} * x + 1 - g) / g) FILTER (WHERE r <= edge) * 100 AS error FROM w JOIN b0 USING (lens) GROUP BY 1)
SELECT lens, {", ".join(f"round(c{k}, 3) AS c{k}" for k in range(5))}, round(error, 3) AS error, CASE WHEN colour THEN '' ELSE 'chromatic aberration left out: the sensor does not have three colours' END AS notes,
 'distortion, ' || CASE WHEN colour THEN 'chromatic aberration, ' ELSE '' END || 'vignetting' AS summary FROM b0 JOIN j USING (lens) JOIN l USING (lens)"""
)
def lens_gains(spark, sf_dir):
    own, knots = _lenses(spark, sf_dir)
    made = lenses.corrections(own, knots, ["lens"], "all")
    return made.select("lens", *[F.round(F.col("gain")[k], 3).alias(f"c{k}") for k in range(5)], F.round("gain_error", 3).alias("error"), "notes", "summary")


def _bits(v):
    return f"hex(({v})::DOUBLE::BIT::BLOB)"


@query(
    f"""WITH p AS (SELECT p_partkey, p_size / 7.0::DOUBLE AS a, p_retailprice::DOUBLE / -3 AS b, 1 / (p_partkey::DOUBLE + 1) AS c FROM part),
h AS (SELECT *, {_bits("a")} || {_bits("b")} || {_bits("0")} || {_bits("c")} AS four, {_bits("0.5")} || {_bits("c")} AS centre FROM p)
SELECT p_partkey, '00000001000000080103000000000000000000440000000000000000' || lpad(to_hex(p_partkey), 8, '0') || lpad(to_hex(p_partkey * 2), 8, '0') || '000000000000000100000001000000010000' || '0003' || four AS polynomial,
CASE p_partkey % 4 WHEN 3 THEN NULL ELSE CASE p_partkey % 4 WHEN 0 THEN '00000002' ELSE '00000001' END
 || CASE WHEN p_partkey % 4 <> 2 THEN '00000003010300000000000100000038' || four || {_bits("1e-3")} || centre ELSE '' END
 || CASE WHEN p_partkey % 4 <> 1 THEN '000000010103000000000001000000A400000003' || repeat(four || repeat('0', 32), 3) || centre ELSE '' END END AS lens FROM h"""
)
def opcode_lists(spark, sf_dir):
    """The second and the third list of instructions, byte by byte."""
    p = table(spark, sf_dir, "part")
    a, b, c = F.col("p_size") / 7.0, F.col("p_retailprice").cast("double") / -3, 1 / (F.col("p_partkey").cast("double") + 1)
    four, kind = F.array(a, b, F.lit(0.0), c), F.col("p_partkey") % 4
    gain = F.when((kind != 2) & (kind != 3), F.concat(four, F.array(F.lit(1e-3))))
    warps = F.when((kind != 1) & (kind != 3), F.array(four, four, four))
    return p.select("p_partkey", F.hex(binary.polynomial_list(four, F.col("p_partkey"), F.col("p_partkey") * 2)).alias("polynomial"), F.hex(binary.lens_list(gain, warps, F.lit(0.5), c)).alias("lens"))


_WARPED, _SHADED = [0.9, 0.25, -0.1, 0.05], [0.3, 0.1, -0.02, 0.0, 0.01]


@query(
    with_plane(f""", {_PICTURES}, s AS (SELECT image, max(y) + 1 AS h, max(x) + 1 AS w, sqrt(((max(x) + 1) / 2) ** 2 + ((max(y) + 1) / 2) ** 2) AS unit FROM pics GROUP BY 1),
a AS (SELECT *, x + 0.5 - w / 2 AS ax, y + 0.5 - h / 2 AS ay FROM pics JOIN s USING (image)), u AS (SELECT *, (ax * ax + ay * ay) / (unit * unit) AS u FROM a),
l AS (SELECT *, v * (1 + u * ({_SHADED[0]} + u * ({_SHADED[1]} + u * ({_SHADED[2]} + u * ({_SHADED[3]} + u * {_SHADED[4]}))))) AS lit, {_WARPED[0]} + u * ({_WARPED[1]} + u * ({_WARPED[2]} + u * {_WARPED[3]})) AS ratio FROM u),
f AS (SELECT *, greatest(0, least(w - 1, w / 2 + ax * ratio - 0.5)) AS fx, greatest(0, least(h - 1, h / 2 + ay * ratio - 0.5)) AS fy FROM l),
i AS (SELECT image, y, x, lit, w, h, fx, fy, least(floor(fx)::BIGINT, w - 2) AS ix, least(floor(fy)::BIGINT, h - 2) AS iy FROM f),
b AS (SELECT i.image, i.y, i.x, (1 - (fy - iy)) * ((1 - (fx - ix)) * p.lit + (fx - ix) * q.lit) + (fy - iy) * ((1 - (fx - ix)) * r.lit + (fx - ix) * t.lit) AS v FROM i
 JOIN l p ON p.image = i.image AND p.y = iy AND p.x = ix JOIN l q ON q.image = i.image AND q.y = iy AND q.x = ix + 1 JOIN l r ON r.image = i.image AND r.y = iy + 1 AND r.x = ix JOIN l t ON t.image = i.image AND t.y = iy + 1 AND t.x = ix + 1)
SELECT image, y::INTEGER AS y, count(*) AS n, round(sum(v), 2) AS total, round(max(v), 3) AS most, round(sum(v * (x + 1)), 1) AS placed FROM b GROUP BY 1, 2""")
)
def warp_lines(spark, sf_dir):
    """Every picture with a gain and a warp about its middle; of each line its sum, its greatest and its placed sum."""
    own = picture_lines(spark, sf_dir)
    sizes = own.groupBy("image").agg((F.max("y") + 1).alias("height"), F.max(F.size("line")).alias("width"))
    geometry = {"active_width": F.col("width").cast("double"), "active_height": F.col("height").cast("double"), "centre_x": F.lit(0.5), "centre_y": F.lit(0.5), "offset_x": F.lit(0.0), "offset_y": F.lit(0.0), "scale_x": F.lit(1.0), "scale_y": F.lit(1.0)}
    pictures = sizes.select("*", *[v.alias(k) for k, v in geometry.items()], F.array(*map(F.lit, _SHADED)).alias("gain"), F.array(*map(F.lit, _WARPED)).alias("warp"))
    made = warps.corrected(own, pictures, ["image"], channels=1)
    total = lambda each: F.aggregate(each, F.lit(0.0), lambda s, v: s + v)
    placed = F.transform("line", lambda v, x: v * (x + 1))
    return made.select("image", "y", F.size("line").cast("bigint").alias("n"), F.round(total(F.col("line")), 2).alias("total"), F.round(F.array_max("line"), 3).alias("most"), F.round(total(placed), 1).alias("placed"))


# Files


def _little(v):
    return F.hex(frames.swapped(F.unhex(F.lpad(F.hex(v.cast("bigint")), 8, "0")), F.lit(4)))


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS path, 0 AS ifd, 'main' AS kind, 256 AS tag, o_orderkey AS number FROM o UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 0, 'main', 34665, 38 FROM o
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'exif', 33434, o_custkey FROM o"""
)
def directory_entries(spark, sf_dir):
    """Every order as a small file: a directory with a number and a pointer, and the directory behind it."""
    entry = lambda tag, v: F.concat(F.lit(f"{tag & 255:02X}{tag >> 8:02X}040001000000"), v)
    head = F.concat(F.lit("49492A00080000000200"), entry(256, _little(F.col("o_orderkey"))), entry(34665, F.lit("26000000")), F.lit("00000000"))
    content = F.unhex(F.concat(head, F.lit("0100"), entry(33434, _little(F.col("o_custkey"))), F.lit("00000000")))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), content.alias("content"))
    return directories.with_numbers(catalog.ifd_entries(files)).select("path", "ifd", "kind", "tag", "number")


@query(
    r"""WITH p AS (SELECT DISTINCT '/d/' || page_id || '.v' || page_id % 3 || '.nef' AS path, page_id FROM pages), s AS (SELECT *, regexp_replace(path, '\.[^./]*$', '') AS stem FROM p),
l AS (SELECT stem || '.xmp' AS f FROM s WHERE page_id % 3 = 0 UNION SELECT stem || '.XMP' FROM s WHERE page_id % 4 = 0 UNION SELECT path || '.xmp' FROM s WHERE page_id % 5 = 0 UNION SELECT path || '.XMP' FROM s WHERE page_id % 7 = 0)
SELECT path, CASE WHEN stem || '.xmp' IN (SELECT f FROM l) THEN stem || '.xmp' WHEN stem || '.XMP' IN (SELECT f FROM l) THEN stem || '.XMP' WHEN path || '.xmp' IN (SELECT f FROM l) THEN path || '.xmp' WHEN path || '.XMP' IN (SELECT f FROM l) THEN path || '.XMP' END AS sidecar FROM s"""
)
def sidecar_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/d/"), F.col("page_id").cast("string"), F.lit(".v"), (F.col("page_id") % 3).cast("string"), F.lit(".nef")).alias("path")).distinct()
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    names = [(3, F.concat(stem, F.lit(".xmp"))), (4, F.concat(stem, F.lit(".XMP"))), (5, F.concat("path", F.lit(".xmp"))), (7, F.concat("path", F.lit(".XMP")))]
    listing = p.select(F.explode(F.array_compact(F.array(*[F.when(F.col("page_id") % n == 0, name) for n, name in names]))).alias("path"))
    return catalog.sidecars(listing, p.select("path"))


_VERDICTS = [
    ("intact", "intact (raw image, embedded original)", None),
    ("damaged", "DAMAGED: the raw image data does not match its checksum", None),
    ("unverified", "not verified: the file carries no checksum of its raw data; embedded original intact", "new"),
    ("damaged", "DAMAGED: the embedded original does not match its checksum", None),
    ("damaged", "DAMAGED: the file is cut short: 5 bytes are missing at its end", None),
]


@query(
    with_plane(f""", {_PICTURES}, t AS (SELECT DISTINCT image FROM pics),
v AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{o}', '{t}', {'NULL' if a is None else repr(a)})" for k, (o, t, a) in enumerate(_VERDICTS))}) v(k, outcome, "text", addable))
SELECT CAST(image AS VARCHAR) AS path, outcome, "text", addable FROM t JOIN v ON image % 5 = k""")
)
def file_check(spark, sf_dir):
    """Every picture as a file of one strip of two planes with a preview and an original: sound, with another digest or none, with another original, or cut short."""
    own = picture_lines(spark, sf_dir)
    digest = lines.image_digests(own, ["image"], planes=2).select("image", "digest")
    rows = own.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", lines.sample_bytes(F.col("line")).alias("h")))).alias("p"), F.max("y").alias("last"), F.max(F.size("line")).alias("n"))
    rows = rows.join(digest, "image").select("image", F.array_join("p.h", "").alias("data"), (F.col("last") + 1).alias("h"), (F.col("n") / 2).cast("int").alias("w"), "digest")
    case = F.col("image") % 5
    kept = F.when(case == 1, F.md5("digest")).otherwise(F.col("digest"))
    original = F.concat(F.lit("00000007"), F.hex(F.encode("digest", "UTF-8")))
    stored = F.when(case == 3, F.md5("digest")).otherwise(F.md5(F.unhex(original)))
    entry = lambda tag, kind, n, v: F.concat(F.lit(f"{tag & 255:02X}{tag >> 8:02X}{kind:02X}00{n:02X}000000"), v)
    number = lambda tag, v: entry(tag, 4, 1, _little(v if not isinstance(v, int) else F.lit(v)))
    size = F.col("w") * F.col("h") * 4
    # Fourteen entries end at byte 182; two digests, the original, the samples and the preview follow.
    tags = [number(254, 0), number(256, F.col("w")), number(257, F.col("h")), number(258, 16), number(273, 250), number(277, 2), number(278, F.col("h")), number(279, size), number(513, size + 250), number(514, 8), entry(50706, 1, 4, F.lit("01040000"))]
    tags += [entry(50828, 7, 36, F.lit("D6000000")), entry(50973, 7, 16, F.lit("C6000000")), F.when(case == 2, number(50000, 1)).otherwise(entry(51111, 7, 16, F.lit("B6000000")))]
    whole = F.concat(F.lit("49492A00080000000E00"), *tags, F.lit("00000000"), kept, stored, original, F.col("data"), F.lit("AB" * 8))
    content = F.unhex(F.substring(whole, F.lit(1), F.length(whole) - F.when(case == 4, 10).otherwise(0)))
    files = rows.select(F.col("image").cast("string").alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))
    return checks.checked(files)
