"""Gain and warp over lines, against a loop over pixels."""

import math

import numpy as np
import pytest

from rawframe.operators import warps

SIZES = "height int, width int, active_width double, active_height double, centre_x double, centre_y double, offset_x double, offset_y double, scale_x double, scale_y double, gain array<double>, warp array<double>"


def by_pixels(picture, p):
    h, w = picture.shape[:2]
    aw, ah, mx, my, ox, oy, sx, sy, gain, warp = p
    cx, cy = mx * aw, my * ah
    unit = math.hypot(max(cx, aw - cx), max(cy, ah - cy))
    place = lambda y, x: (ox + (x + 0.5) * sx - cx, oy + (y + 0.5) * sy - cy)
    lit = picture.astype(float).copy()
    for y in range(h):
        for x in range(w):
            ax, ay = place(y, x)
            u = (ax * ax + ay * ay) / unit**2
            if gain:
                lit[y, x] *= 1 + sum(g * u ** (k + 1) for k, g in enumerate(gain))
    if not warp:
        return lit
    out = lit.copy()
    for y in range(h):
        for x in range(w):
            ax, ay = place(y, x)
            u = (ax * ax + ay * ay) / unit**2
            ratio = sum(c * u**k for k, c in enumerate(warp))
            fx = min(max((cx + ax * ratio - ox) / sx - 0.5, 0), w - 1)
            fy = min(max((cy + ay * ratio - oy) / sy - 0.5, 0), h - 1)
            ix, iy = min(int(fx), max(w - 2, 0)), min(int(fy), max(h - 2, 0))
            tx, ty = fx - ix, fy - iy
            x1, y1 = min(ix + 1, w - 1), min(iy + 1, h - 1)
            out[y, x] = (1 - ty) * ((1 - tx) * lit[iy, ix] + tx * lit[iy, x1]) + ty * ((1 - tx) * lit[y1, ix] + tx * lit[y1, x1])
    return out


PICTURES = {
    1: ((37, 53), (53.0, 37.0, 0.5, 0.5, 0.0, 0.0, 1.0, 1.0, [0.4, 0.1, -0.05, 0.0, 0.01], [0.97, 0.06, -0.02, 0.01])),
    2: ((40, 30), (66.0, 84.0, 0.45, 0.55, 3.0, 2.0, 2.0, 2.0, None, [1.2, -0.5, 0.3, 0.05])),
    3: ((33, 20), (20.0, 33.0, 0.5, 0.5, 0.0, 0.0, 1.0, 1.0, [0.2, 0.0, 0.0, 0.0, 0.0], None)),
    4: ((1, 9), (9.0, 1.0, 0.5, 0.5, 0.0, 0.0, 1.0, 1.0, None, [1.1, 0.0, 0.0, 0.0])),
    5: ((25, 1), (1.0, 25.0, 0.5, 0.3, 0.0, 0.0, 1.0, 1.0, None, [0.6, 0.2, 0.0, 0.0])),
    6: ((31, 41), (41.0, 31.0, 0.5, 0.5, 0.0, 0.0, 1.0, 1.0, None, [0.2, 2.4, -3.9, 2.0])),
}


@pytest.mark.parametrize("band", [4, 16, 1000])
def test_against_a_loop(spark, band):
    rng = np.random.default_rng(7)
    source = {k: rng.integers(0, 1000, (*size, 3)) for k, (size, _) in PICTURES.items()}
    lines = spark.createDataFrame([(k, y, [float(v) for v in a[y].reshape(-1)]) for k, a in source.items() for y in range(len(a))], "image int, y int, line array<double>").repartition(5)
    pictures = spark.createDataFrame([(k, *size, *p) for k, (size, p) in PICTURES.items()], f"image int, {SIZES}")
    made = {(r["image"], r["y"]): r["line"] for r in warps.corrected(lines, pictures, ["image"], band=band).collect()}
    assert len(made) == sum(len(a) for a in source.values())
    for k, (_, p) in PICTURES.items():
        expected = by_pixels(source[k], p)
        for y in range(len(expected)):
            assert made[k, y] == pytest.approx(expected[y].reshape(-1).tolist(), abs=1e-8), (k, y)


def test_a_band_gets_its_lines_and_a_margin_only(spark):
    pictures = spark.createDataFrame([(1, 4000, 6000, 6000.0, 4000.0, 0.5, 0.5, 0.0, 0.0, 1.0, 1.0, None, [0.98, 0.03, 0.0, 0.0])], f"image int, {SIZES}")
    found = warps.reaches(pictures, ["image"]).collect()
    assert max(r["last"] - r["first"] for r in found) < 60
    assert all(0 <= r["first"] <= r["last"] <= 3999 for r in found)


def test_missing_lines_and_empty_tables(spark):
    lines = spark.createDataFrame([(1, 0, [5.0, 6.0]), (2, 0, [1.0, 1.0])], "image int, y int, line array<double>")
    pictures = spark.createDataFrame([(1, 2, 2, 2.0, 2.0, 0.5, 0.5, 0.0, 0.0, 1.0, 1.0, None, [1.0, 0.0, 0.0, 0.0])], f"image int, {SIZES}")
    made = {r["y"]: r["line"] for r in warps.corrected(lines, pictures, ["image"], channels=1).collect()}
    assert made == {0: [5.0, 6.0], 1: [0.0, 0.0]}
    assert warps.corrected(lines.limit(0), pictures.limit(0), ["image"], channels=1).count() == 0
