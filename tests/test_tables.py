import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rawframe.functions import colour, frames, rules
from rawframe.operators import tables


RATIONALS = [(5.6, (28, 5)), (0.004, (1, 250)), (0.0125, (1, 80)), (1 / 3, (1, 3)), (0.8293, (8293, 10000)), (1e12, (4294967295, 1)), (-3.0, (0, 1)), (float("nan"), (0, 1)), (None, (0, 1)), (1000.0, (1000, 1)), (2.5e-9, (0, 1))]


def test_rationals(spark):
    rows = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(RATIONALS)], "k int, v double")
    got = {r["k"]: tuple(r["r"]) for r in rows.select("k", tables.rational(F.col("v")).alias("r")).collect()}
    assert [got[k] for k in range(len(RATIONALS) - 1)] == [want for _, want in RATIONALS[:-1]]
    made = spark.createDataFrame([(math.pi * 1.37**k,) for k in range(-12, 40)], "v double")
    for v, n, d in tables.rationals(made, "v").collect():
        assert abs(n / d - v) <= v * 1.5e-7 and math.gcd(n, d) == 1 and d <= 10**9
    signed = rows.select("k", tables.signed_rational(-F.col("v")).alias("r")).collect()
    assert {r["k"]: tuple(r["r"]) for r in signed}[0] == (-28, 5) and {r["k"]: tuple(r["r"]) for r in signed}[5] == (-2147483647, 1)


def test_code_lengths_are_optimal_and_bounded():
    rng = random.Random(2)
    for _ in range(200):
        counts = {s: rng.choice([1, 2, 3, 50, 1000, 10**6]) for s in rng.sample(range(17), rng.randrange(1, 18))}
        found = tables.code_lengths(counts)
        assert set(found) == set(counts) and max(found.values()) <= 16
        assert sum(2.0**-b for b in found.values()) < 1  # the code of ones is free
    fibonacci = {k: n for k, n in enumerate([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597])}
    assert max(tables.code_lengths(fibonacci).values()) <= 16
    assert tables.code_lengths({0: 8, 1: 4, 2: 2, 3: 1}) == {0: 1, 1: 2, 2: 3, 3: 4}
    assert tables.code_lengths({}) == {} and tables.code_lengths({5: 9}) == {5: 1}


def brute_zoom(radius, ratio, width, height):
    """The greatest of many zooms up to which no point of the edge comes from outside."""
    at = lambda r: np.interp(r, radius, ratio) if r <= radius[-1] else ratio[-1] + (r - radius[-1]) * (ratio[-1] - ratio[-2]) / (radius[-1] - radius[-2])
    edge = np.linspace(min(width, height) / math.hypot(width, height), 1, 200)
    good = 1.0
    for zoom in np.arange(0.5, 2.0, 0.002):
        if max(at(r * zoom) for r in edge) * zoom > 1:
            return good
        good = zoom
    return 1.0


def test_zooms(spark):
    r = [k / 10 for k in range(13)]
    curves = {1: [1.0] * 13, 2: [0.8] * 13, 3: [0.9 + 0.02 * k for k in range(13)], 4: [1.1 - 0.03 * k for k in range(13)], 5: [0.9 + 0.1 * (k % 3) for k in range(13)], 6: [0.3] * 13}
    rows = [(k, 6000.0, 4000.0, r, v) for k, v in curves.items()] + [(7, 6000.0, 4000.0, [], []), (8, 0.0, 4000.0, r, [0.9] * 13)]
    got = dict(tables.zooms(spark.createDataFrame(rows, "k int, width double, height double, radius array<double>, ratio array<double>"), ["k"]).collect())
    assert got[1] == pytest.approx(1, abs=1e-9) and got[2] == pytest.approx(1.25, abs=1e-9)
    assert got[6] == got[7] == got[8] == 1
    for k in (3, 4, 5):
        assert got[k] == pytest.approx(brute_zoom(r, curves[k], 6000, 4000), abs=0.005)


def test_rules(spark):
    row = spark.range(1).select(
        rules.step_vignetting(F.lit(8192)).alias("g"),
        rules.bayer_phase(F.array(*[F.lit(x) for x in (0, 1, 1, 2)]), F.lit(1), F.lit(0)).alias("p"),
        rules.file_versions(F.lit(False), F.lit(0x0106), F.lit(True), F.lit(False)).alias("v"),
        rules.sane_curve(F.array(F.lit(0.0), F.lit(0.5)), F.array(F.lit(1.0), F.lit(1.2)), 0.5, 1.5).alias("s"),
        rules.sane_curve(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(1.2)), 0.5, 1.5).alias("t"),
        rules.correction_wanted(F.lit("camera"), F.lit(True), F.lit(False)).alias("w"),
        rules.unique_id(F.md5(F.lit("a")), F.lit("M"), [F.lit(258)] + [F.lit(0)] * 5, F.lit(b"x")).alias("u"),
    ).first()
    import hashlib

    want = hashlib.md5(hashlib.md5(b"a").digest() + b"M" + b"\2\1\0\0" + b"\0" * 20 + b"x").hexdigest()
    assert math.isclose(row["g"], math.sqrt(2)) and row["p"] == 2 and tuple(row["v"]) == ("1.6.0.0", "1.3.0.0")
    assert (row["s"], row["t"], row["w"], row["u"]) == (True, False, True, want)


def test_colour_matrices(spark):
    rng = np.random.default_rng(2)
    to_srgb, daylight = (np.eye(3) + rng.normal(0, 0.2, (3, 3))), [2.0, 0.0, 1.5, 1.0]
    known = rng.normal(0, 1, 12)
    srgb = np.array(colour.SRGB_OF_XYZ).reshape(3, 3)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    made = lambda k, m, planes: spark.range(1).select(colour.camera_matrix(lit(k), lit(m), lit(daylight), F.lit(planes)).alias("r")).first()["r"]
    own = made(known, to_srgb.ravel(), 4)
    assert own["source"] == "known" and own["warning"] is None and own["matrix"] == pytest.approx(known.tolist())
    derived = made([0.0] * 12, to_srgb.ravel(), 3)
    want = np.linalg.inv(to_srgb) @ srgb * np.array([1 / 2.0, 1.0, 1 / 1.5])[:, None]
    assert derived["source"] == "derived" and derived["warning"] == colour.DERIVED and derived["matrix"] == pytest.approx(want.ravel().tolist())
    assert made([0.0] * 9 + [1.0] * 3, np.zeros(9), 3)["source"] == "srgb"
    last = made([0.0] * 12, to_srgb.ravel(), 4)
    assert last["warning"] == colour.APPROXIMATE and last["matrix"] == pytest.approx([*srgb.ravel(), 0, 0, 0])
    assert made(known, to_srgb.ravel(), 1) is None
    shot = lambda cam, planes: spark.range(1).select(colour.as_shot(lit(cam), lit([2.0, 1.0, 1.5, 0.0]), F.lit(planes)).alias("r")).first()["r"]
    assert shot([2.0, 1.0, 4.0, 0.0], 3)["neutral"] == [0.5, 1.0, 0.25] and shot([2.0, 1.0, 4.0, 0.0], 3)["warning"] is None
    assert shot([2.0, 0.0, 4.0, 0.0], 3)["warning"] == colour.DAYLIGHT and shot([0.0] * 4, 4) is None


def test_filter_patterns(spark):
    def made(colours, letters="RGBG", number=3, sixteen=False):
        c = frames.filter_pattern(F.array(*[F.lit(x) for x in colours]), F.lit(letters), F.lit(number), F.lit(sixteen))
        return spark.range(1).select(c.alias("r")).first()["r"]

    bayer = made([0, 1, 3, 2] * 4)
    assert (bayer["rows"], bayer["cols"], bayer["pattern"], bayer["plane_colours"], bayer["reason"]) == (2, 2, [0, 1, 1, 2], [0, 1, 2], None)
    four = made([0, 1, 1, 2, 2, 0, 1, 1] * 2, "RGBE")
    assert (four["rows"], four["pattern"]) == (4, [0, 1, 1, 2, 2, 0, 1, 1])
    eight = made([0, 1] * 7 + [2, 1])
    assert eight["rows"] == 8
    trans = [1, 1, 0, 1, 1, 2, 1, 1, 2, 1, 1, 0, 2, 0, 1, 0, 2, 1, 1, 1, 2, 1, 1, 0, 1, 1, 0, 1, 1, 2, 0, 2, 1, 2, 0, 1]
    assert (made(trans)["rows"], made(trans)["cols"], made(trans)["pattern"]) == (6, 6, trans)
    assert made([0, 1, 2, 3] * 4, "CYMG", 4)["plane_colours"] == [3, 5, 4, 1] and made([3] * 16, "RGBB")["pattern"] == [2] * 4
    assert made([0] * 16, sixteen=True)["reason"].startswith("16x16") and made([0] * 16, number=2)["reason"].startswith("unexpected")
    assert made([0] * 16, "RXB ")["reason"] == "colour filter 'X' has no DNG equivalent" and made([0, 1, 4, 2] * 4)["reason"] == "unreadable colour filter layout"


def test_sixteen_words(spark):
    def check(b):
        s = 0
        for x in b:
            s = (73 * s + x) % 65519
        return s

    rng = random.Random(8)
    rows = []
    for k in range(30):
        d = [rng.randrange(256) for _ in range(32)]
        d[14] = d[14] & 0xF0 | (1 if k % 3 else 2)
        for i, part in ((1, lambda: d[4:16]), (14, lambda: d[16:28]), (0, lambda: d[2:30:2]), (15, lambda: d[3:31:2])):
            d[2 * i], d[2 * i + 1] = check(part()) & 255, check(part()) >> 8
        if k % 5 == 4:
            d[k] ^= 1
        rows.append((k, d))
    rows.append((99, [0] * 8))
    made = {r["k"]: tuple(r["r"]) for r in spark.createDataFrame(rows, "k int, d array<int>").select("k", rules.sixteen_words(F.col("d")).alias("r")).collect()}
    for k, d in rows:
        sound = k < 99 and k % 5 != 4
        assert made[k] == (sound, sound and k % 3 != 0), k


def test_layouts(spark):
    def loop(x0, y0, w, h, sx, sy, px, py, most):
        skip_x, skip_y = (px - sx % px) % px, (py - sy % py) % py
        if w < skip_x + px or h < skip_y + py:
            return None
        x0, y0, w, h = x0 + skip_x, y0 + skip_y, w - skip_x, h - skip_y
        cells_x, cells_y = w // px, h // py
        shrink = min(1.0, cells_x / w, cells_y / h, most / max(w, h) if most else 1.0)
        tw, th = (max(1, min(c, math.floor(n * shrink + 0.5))) for n, c in ((w, cells_x), (h, cells_y)))
        bx, by = px * (cells_x // tw), py * (cells_y // th)
        across, down = w // bx, h // by
        return (tw, th, bx, by, across, down, x0 + (w - across * bx) // 2 // px * px, y0 + (h - down * by) // 2 // py * py)

    rng = random.Random(1)
    rows = [(k, rng.randrange(9), rng.randrange(9), rng.randrange(1, 900), rng.randrange(1, 700), rng.randrange(7), rng.randrange(7), rng.choice([1, 2, 3]), rng.choice([1, 2, 3]), rng.choice([0, 1, 64, 100, 333])) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, x0 int, y0 int, w int, h int, sx int, sy int, px int, py int, most int")
    c = F.col
    made = df.select("k", frames.render_layout(c("x0"), c("y0"), c("w"), c("h"), c("sx"), c("sy"), c("px"), c("py"), F.lit(1.0), F.lit(1.0), c("most")).alias("r")).collect()
    for r in made:
        assert (tuple(r["r"]) if r["r"] else None) == loop(*rows[r["k"]][1:]), rows[r["k"]]
