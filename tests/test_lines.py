"""Lines against the long form and against known digests."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rawframe.operators import lines, samples


def picture(spark, width, height, planes, value):
    rows = [(0, y, [int(value(x, y, c)) for x in range(width) for c in range(planes)]) for y in range(height)]
    return spark.createDataFrame(rows, "image int, y long, line array<int>")


def test_known_digests(spark):
    three = picture(spark, 70, 50, 3, lambda x, y, c: (5 * x + 3 * y + 11 * c) % 251)
    digest = lambda df: df.first()["digest"]
    assert digest(lines.image_digests(three, ["image"], 256, 3, 1)) == "1b2a873ecd6f26b60df98f5c3362cd10"
    assert digest(lines.image_digests(three, ["image"], 256, 3)) == "bb89e1d2c261178cf5583a7076ad8463"
    assert digest(lines.linear_digests(three, ["image"])) == "24b6a7f4662dd9ef395c5ff489897ab1"
    one = picture(spark, 300, 270, 1, lambda x, y, c: (7 * x + 13 * y) % 4096)
    assert digest(lines.image_digests(one, ["image"])) == "3ecd9755451ca5ed2c569b1ba3c3611d"
    assert digest(lines.linear_digests(one, ["image"])) == "56c70e3787ee1f0b49fbb06f965cc971"


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(4)
    rows = [(k, y, [rng.choice([0, rng.randrange(65536)]) for _ in range(13)]) for k in range(2) for y in range(9)]
    own = spark.createDataFrame(rows, "image int, y long, line array<int>")
    return own, lines.to_samples(own, ["image"])


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_against_the_long_form(both):
    own, long = both
    keys = ["image"]
    same(lines.to_samples(lines.to_lines(long, keys), keys), long)
    green = (F.col("y") + F.col("x")) % 2 == 1
    same(lines.to_samples(lines.repaired(own, keys), keys, ("fixed",), ("fixed",)), samples.repaired(long, keys, green))
    for n in (1, 3):
        same(lines.to_samples(lines.residuals(own, keys, n), keys, ("difference", "category"), ("difference", "category")), samples.residuals(long, keys, n))
    ps = [f"p{k}" for k in range(1, 8)]
    made = lines.to_samples(lines.predictors(own, keys), keys, ("line", *ps), ("v", *ps)).withColumn("x", F.col("x") + 1)
    same(made, samples.predictors(long, keys))
    same(lines.tile_digests(own, keys, 4), samples.tile_digests(long, keys, 4))
    levels = ([100.0, 200.0, 300.0, 400.0], 2, 2, 4000.0)
    same(lines.to_samples(lines.linearised(own, *levels), keys, ("linear",), ("linear",)), samples.linearised(long, *levels))


def test_repair_by_hand(spark):
    fixed = lines.repaired(spark.createDataFrame([(0, 0, [100, 9, 0, 9, 500])], "image int, y int, line array<int>"), ["image"])
    assert fixed.first()["fixed"] == [100, 9, 300, 9, 500]
    assert lines.repaired_counts(fixed, ["image"]).first()["repaired"] == 1


@pytest.mark.parametrize("bits", [8, 10, 12, 14, 16])
def test_unpacking(spark, bits):
    values = [(7919 * k) % (1 << bits) for k in range(37)]
    text = "".join(f"{v:0{bits}b}" for v in values)
    raw = bytes(int(text[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(text), 8))
    rows = spark.createDataFrame([(1, raw), (2, None)], "k int, data binary")
    got = dict(lines.unpacked(rows, ["k"], "data", F.lit(bits), F.lit(True)).collect())
    assert got[1][:37] == values and got[2] == []
    if bits == 16:
        little = spark.createDataFrame([(1, struct.pack("<3H", 1, 2, 65535))], "k int, data binary")
        assert lines.unpacked(little, ["k"], "data", F.lit(16), F.lit(False)).first()["line"] == [1, 2, 65535]


def test_ranges_and_bytes(spark):
    own = spark.createDataFrame([(0, 0, [5, 7]), (0, 1, [6, 9]), (1, 0, [10, 60000])], "image int, y int, linear array<int>")
    assert {tuple(r) for r in lines.value_ranges(own, ["image"]).collect()} == {(0, 5, 260), (1, 10, 60000)}
    table = lines.tone_tables(spark.createDataFrame([(0, 0, 65535)], "image int, lower int, upper int"), ["image"]).orderBy("v").collect()
    assert (table[0]["stored"], table[-1]["stored"]) == (0, 65535) and np.all(np.diff([r["stored"] for r in table]) >= 0)
    row = spark.range(1).select(lines.sample_bytes(F.array(F.lit(258), F.lit(7))).alias("l"), lines.sample_bytes(F.array(F.lit(258)), 2, True).alias("b")).first()
    assert tuple(row) == ("02010700", "0102")


def test_a_missing_line_differs(spark):
    own = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3, 4])], "image int, y int, line array<int>")
    assert tuple(lines.differing(own, own.where("y = 0"), ["image"]).first()) == (0, 4, 2)
