"""Golden values of sample operators on generated frames."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from rawframe.functions import levels
from rawframe.operators import archive, samples


def frame(spark, w, h, f):
    return spark.range(w * h).select(F.floor(F.col("id") / w).alias("y"), (F.col("id") % w).alias("x")).withColumn("v", f(F.col("x"), F.col("y")))


def test_published_digests(spark):
    made = frame(spark, 300, 270, lambda x, y: (x * 7 + y * 13) % 4096).withColumn("image", F.lit(1))
    assert samples.image_digests(made, ["image"]).first()["digest"] == "3ecd9755451ca5ed2c569b1ba3c3611d"
    assert samples.linear_digests(made, ["image"]).first()["digest"] == "56c70e3787ee1f0b49fbb06f965cc971"
    xor = frame(spark, 513, 257, lambda x, y: x.bitwiseXOR(y).bitwiseAND(255))
    assert samples.digest_of_digests(samples.tile_digests(xor, [], 256, 1), [], "ty, tx").first()["digest"] == "0ba3f6f43cd463581eb9ff30ca81bc15"
    assert samples.linear_digests(xor, []).first()["digest"] == "2d23c684d7b392e087b6073be2a506e4"


def test_digests_don_t_depend_on_partitions(spark):
    made = frame(spark, 70, 50, lambda x, y: x * 5 + y * 3)
    assert len({samples.image_digests(made.repartition(n), [], 16).first()["digest"] for n in (1, 3, 7)}) == 1


def test_curves(spark):
    row = spark.range(1).select(
        levels.lossy_decode(F.lit(0.5)).alias("half"),
        levels.lossy_encode(F.lit(0.01)).alias("low"),
        levels.lossy_encode(F.lit(0.0)).alias("zero"),
        levels.lossy_encode(F.lit(1.0)).alias("one"),
        levels.lossy_decode(levels.lossy_encode(F.lit(0.3))).alias("back"),
        levels.tone_curve(F.lit(1.0)).alias("white"),
    ).first()
    assert math.isclose(row["half"], 0.5 / 16 + 15 / 16 * 0.125, abs_tol=1e-12)
    assert 0.125 < row["low"] < 0.135 and row["zero"] == 0 and row["one"] == 1
    assert math.isclose(row["back"], 0.3, abs_tol=1e-12) and math.isclose(row["white"], 1, abs_tol=1e-12)


def test_linear_values(spark):
    rows = spark.createDataFrame([(0, 0, 1000), (0, 1, 1000), (1, 0, 50), (1, 1, 4095)], "y long, x long, v int")
    got = {(r["y"], r["x"]): r["linear"] for r in samples.linearised(rows, [100.0, 200.0, 300.0, 400.0], 2, 2, 4000.0).collect()}
    assert got == {(0, 0): round(900 / 3600 * 65535), (0, 1): round(800 / 3600 * 65535), (1, 0): 0, (1, 1): 65535}


def test_repair_against_loops(spark):
    rng = random.Random(1)
    grid = [[rng.choice([0, 0, 100, 301, 5000]) for _ in range(9)] for _ in range(8)]
    rows = [(y, x, grid[y][x]) for y in range(8) for x in range(9)]

    def fixed(y, x):
        if grid[y][x]:
            return grid[y][x]
        near = [(-1, -1), (-1, 1), (1, -1), (1, 1)] if (y + x) % 2 else [(-2, 0), (2, 0), (0, -2), (0, 2)]
        found = [grid[y + a][x + b] for a, b in near if 0 <= y + a < 8 and 0 <= x + b < 9 and grid[y + a][x + b]]
        return (sum(found) + len(found) // 2) // len(found) if found else 0

    out = samples.repaired(spark.createDataFrame(rows, "y long, x long, v long"), [], (F.col("y") + F.col("x")) % 2 == 1)
    assert {(r["y"], r["x"]): r["fixed"] for r in out.collect()} == {(y, x): fixed(y, x) for y, x, _ in rows}


@pytest.mark.parametrize("case,reason", [((0.026, 0, 0, 1, 0), "rms"), ((0, 0.031, 0, 1, 0), "tile"), ((0, 0, 0.0111, 1, 0), "block"), ((0, 0, 0, -0.01, 0), "alignment"), ((0, 0, 0, 1, -0.0012), "mean"), ((0.02, 0.02, 0.005, 0.1, 0.0005), None)])
def test_lossy_rules(spark, case, reason):
    assert spark.range(1).select(samples.lossy_verdict(*[F.lit(float(x)) for x in case], F.lit(1.0)).alias("r")).first()["r"] == reason


def test_interpolation(spark):
    knots = spark.createDataFrame([("a", 0.2, 1.0), ("a", 0.4, 2.0), ("a", 1.0, 5.0), ("b", 0.5, 7.0)], "lens string, radius double, value double")
    points = spark.createDataFrame([("a", r) for r in (0.3, 0.7, 0.0, 1.2)] + [("b", 0.1), ("c", 0.1)], "lens string, r double")
    got = [r["v"] for r in archive.interpolated(points, knots, ["lens"], "r", "v").orderBy("lens", "r").collect()]
    assert got == pytest.approx([0.0, 1.5, 3.5, 6.0, 7.0, 0.0])


def test_error_statistics(spark):
    rng = random.Random(3)
    rows = [(y, x, 1000, 1000 + rng.randrange(-9, 10)) for y in range(40) for x in range(70)]
    got = samples.error_statistics(spark.createDataFrame(rows, "y long, x long, v long, stored long"), [], 32, 32).first()
    d = sorted(abs(s - v) for _, _, v, s in rows)
    assert math.isclose(got["p999"] * 65535, d[len(d) - len(d) // 1000 - 1]) and math.isclose(got["most"] * 65535, d[-1])
    assert math.isclose(got["rms"] * 65535, math.sqrt(sum(x * x for x in d) / len(d)))


def test_polynomial_fit(spark):
    rows = [("k", i / 40, 0.98 + 0.03 * (i / 40) - 0.01 * (i / 40) ** 2, 1.0) for i in range(41)]
    points = spark.createDataFrame(rows, "lens string, x double, y double, w double")
    got = archive.poly_fits(archive.poly_moments(points, ["lens"], F.col("x"), F.col("y"), F.col("w"), 2), ["lens"], 2).first()
    assert [got["c0"], got["c1"], got["c2"]] == pytest.approx([0.98, 0.03, -0.01], abs=1e-9)


def test_md5_is_the_usual_one(spark):
    assert spark.range(1).select(F.md5(F.lit("abc"))).first()[0] == hashlib.md5(b"abc").hexdigest()
