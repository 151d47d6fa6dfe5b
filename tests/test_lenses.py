"""Lens corrections against numpy, and the bytes of their instructions."""

import math
import random
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rawframe.functions import binary
from rawframe.operators import lenses

RADIUS = np.arange(0, 13) / 10


def curves(kind):
    r = RADIUS
    return {
        "plain": {"distortion": 0.98 + 0.05 * r**2 - 0.02 * r**4, "red": 0.002 * r, "blue": -0.0015 * r**2, "vignetting": 1 + 0.5 * r**2 + 0.2 * r**4},
        "colours only": {"red": 0.001 + 0 * r, "blue": 0.001 * r},
        "falling": {"distortion": np.maximum(1.3 - 0.79 * r, 0.5), "vignetting": 1 + r},
        "one aberration": {"red": 0.002 * r, "distortion": 1 + 0.01 * r},
        "wild": {"distortion": 2.0 + r, "vignetting": 40.0 + r},
        "none": {},
    }[kind]


LENSES = [
    (1, "plain", dict(fit_frame=True)), (2, "plain", dict(left=10.0, top=8.0, active_width=6024.0, active_height=4016.0)), (3, "plain", dict(planes=1)), (4, "plain", dict(square=False)),
    (5, "plain", dict(vignetting_in_data=True, fit_frame=True)), (6, "plain", dict(left=7000.0)), (7, "colours only", {}), (8, "falling", {}), (9, "one aberration", {}), (10, "wild", {}), (11, "none", {}), (12, "plain", dict(distortion_enabled=False, ca_enabled=False)),
]
DEFAULTS = dict(left=0.0, top=0.0, width=6000.0, height=4000.0, active_width=6000.0, active_height=4000.0, planes=3, square=True, distortion_enabled=True, ca_enabled=True, vignetting_enabled=True, vignetting_in_data=False, fit_frame=False)


def at(values, r):
    r = np.asarray(r, float)
    i = np.clip(np.searchsorted(RADIUS, r, "right"), 1, len(RADIUS) - 1)
    return values[i - 1] + (r - RADIUS[i - 1]) * (values[i] - values[i - 1]) / (RADIUS[i] - RADIUS[i - 1])


def zoom_of(values, w, h):
    corner, t = math.hypot(w, h), np.arange(257) / 256
    fits = lambda z: all((z * e * at(values, z * np.hypot(x * w, y * h) / corner) <= 1 + 1e-12).all() for x, y, e in ((t, 1, 1), (1, t, 1)))
    low, high = 0.5, 2.0
    if not fits(low) or fits(high):
        return 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def fitted(x, y, weight, first, n):
    basis = np.stack([x ** (first + k) for k in range(n)], 1) * np.sqrt(weight)[:, None]
    return np.linalg.lstsq(basis, y * np.sqrt(weight), rcond=None)[0]


def expected(kind, changes, mode):
    p, own, notes = DEFAULTS | changes, dict(curves(kind)), []
    if kind == "wild":
        own = {}
    if ("red" in own) != ("blue" in own):
        own.pop("red")
    none = dict(warps=None, gain=None, zoom=1.0, notes="", warp_error=0.0, gain_error=0.0)
    if not own or mode == "none":
        return none
    if not p["square"]:
        return none | {"notes": lenses.NOT_SQUARE}
    cx, cy = p["left"] + p["width"] / 2, p["top"] + p["height"] / 2
    if not (0 < cx < p["active_width"] and 0 < cy < p["active_height"]):
        return none
    on = lambda name: mode == "all" or p[name]
    bend, colour = "distortion" in own and on("distortion_enabled"), "red" in own and on("ca_enabled")
    if colour and p["planes"] != 3:
        colour = False
        notes.append(lenses.NOT_THREE)
    half, unit = math.hypot(p["width"], p["height"]) / 2, math.hypot(max(cx, p["active_width"] - cx), max(cy, p["active_height"] - cy))
    r = (np.arange(512) + 0.5) / 512
    x, inside = r * r, r <= half / unit
    weight = np.where(inside, 1.0, 0.02)
    out = dict(none)
    if bend or colour:
        zoom = zoom_of(own["distortion"], p["width"], p["height"]) if bend and p["fit_frame"] else 1.0
        camera = r * unit / half
        green = zoom * at(own["distortion"], zoom * camera) if bend else np.ones(512)
        wanted = [green * (1 + at(own[c], camera * green)) if c else green for c in (("red", None, "blue") if colour else (None,))]
        fits = [fitted(x, y, weight * x, 0, 4) for y in wanted]
        values = [np.polynomial.polynomial.polyval(x, k) for k in fits]
        if all((v > 0).all() and (np.diff(np.append(0, r * v)) > 0).all() for v in values):
            out |= dict(zoom=zoom, warps=[k.tolist() for k in fits], warp_error=max((np.abs(v - y) * r * unit)[inside].max() for v, y in zip(values, wanted)))
        else:
            notes.append(lenses.NO_WARP)
    if "vignetting" in own and not p["vignetting_in_data"] and on("vignetting_enabled"):
        g = at(own["vignetting"], r * unit / half)
        k = fitted(x, g - 1, weight / g**2, 1, 5)
        v = 1 + x * np.polynomial.polynomial.polyval(x, k)
        out |= dict(gain=k.tolist(), gain_error=100 * (np.abs(v - g) / g)[inside].max())
    return out | {"notes": "; ".join(notes)}


@pytest.mark.parametrize("mode", ["all", "camera", "none"])
def test_corrections_against_numpy(spark, mode):
    names = list(DEFAULTS)
    own = spark.createDataFrame([(k, *[(DEFAULTS | changes)[n] for n in names]) for k, _, changes in LENSES], "lens int, " + ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for n, v in DEFAULTS.items()))
    knots = spark.createDataFrame([(k, c, float(a), float(b)) for k, kind, _ in LENSES for c, values in curves(kind).items() for a, b in zip(RADIUS, values)], "lens int, curve string, radius double, value double").repartition(3)
    made = {r["lens"]: r for r in lenses.corrections(own, knots, ["lens"], mode).collect()}
    assert len(made) == len(LENSES)
    for k, kind, changes in LENSES:
        got, want = made[k], expected(kind, changes, mode)
        assert got["notes"] == want["notes"], k
        assert got["zoom"] == pytest.approx(want["zoom"], abs=1e-5), k
        for name in ("warps", "gain"):
            assert (got[name] is None) == (want[name] is None), (k, name)
        if want["warps"]:
            r2 = RADIUS[:10] ** 2
            for a, b in zip(got["warps"], want["warps"], strict=True):
                assert np.polynomial.polynomial.polyval(r2, a) == pytest.approx(np.polynomial.polynomial.polyval(r2, b), abs=1e-5), k
        if want["gain"]:
            assert got["gain"] == pytest.approx(want["gain"], abs=1e-4)
        assert got["warp_error"] == pytest.approx(want["warp_error"], abs=0.05)
        assert got["gain_error"] == pytest.approx(want["gain_error"], abs=1e-3)
        assert (got["distortion"], got["aberration"], got["vignetting"]) == (bool(want["warps"]) and kind != "colours only", bool(want["warps"]) and len(want["warps"] or []) == 3, bool(want["gain"]))
    if mode == "all":
        assert made[1]["summary"] == "distortion, chromatic aberration, vignetting" and made[8]["notes"] == lenses.NO_WARP and made[1]["zoom"] != 1
        assert made[10]["opcode_list"] is None


def test_knots_are_read_from_their_buffers():
    knots = [[(k + i / 100, k - i / 100) for i in range(n)] for k, n in enumerate([3, 0, 121, 2, 121] * 200)]
    column = pa.array([[{"radius": r, "value": v} for r, v in own] for own in knots])
    tracemalloc.start()
    got = lenses._knots(column.slice(1, 990))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [list(zip(r.tolist(), v.tolist())) for r, v in got] == knots[1:991]
    # As objects, these 48 906 knots took 16 MB.
    assert peak < 4 << 20


def test_fits_send_no_knots_back_and_take_some_lenses_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lenses, "SOME_LENSES", 3)
    plain = dict(unit=3600.0, camera=1.0, edge=1.0, zoom=1.0, bend=True, colour=False, shade=True)
    rows = [(k, plain, {c: [{"radius": 0.0, "value": 1.0}, {"radius": 1.2, "value": 1.0 + k / 100}] for c in lenses.CURVES}) for k in range(10)]
    knots = "array<struct<radius: double, value: double>>"
    kinds = ", ".join(f"{n}: {'boolean' if isinstance(v, bool) else 'double'}" for n, v in plain.items())
    df = spark.createDataFrame(rows, f"lens int, _lens struct<{kinds}>, _curves struct<{', '.join(f'{c}: {knots}' for c in lenses.CURVES)}>").coalesce(1)
    made = lenses._fits(df, ["lens"])
    assert made.columns == ["lens", "_lens", "_fit"]
    got = {r["lens"]: r["_fit"] for r in made.collect()}
    assert sorted(got) == list(range(10))
    for k, fit in got.items():
        assert np.polynomial.polynomial.polyval(0.36, fit["warps"][0]) == pytest.approx(1 + 0.6 / 1.2 * k / 100, abs=2e-3)


def as_list(got):
    """The third list by the format's description."""
    centre = struct.pack(">2d", got["centre_x"], got["centre_y"])
    out = b""
    if got["gain"]:
        out += struct.pack(">4I5d", 3, 0x01030000, 1, 56, *got["gain"]) + centre
    if got["warps"]:
        out += struct.pack(">5I", 1, 0x01030000, 1, 4 + 48 * len(got["warps"]) + 16, len(got["warps"])) + b"".join(struct.pack(">6d", *k, 0, 0) for k in got["warps"]) + centre
    return struct.pack(">I", bool(got["gain"]) + bool(got["warps"])) + out if out else None


def test_lists_byte_by_byte(spark):
    rows = [(1, [0.1, -2e-9, 3.0, 0.0, 1e300], [[1.0, -0.25, 1 / 3, 5e-324]], 0.5, 0.25), (2, None, [[0.1] * 4, [0.2] * 4, [0.3] * 4], 0.1, 0.9), (3, [1.0] * 5, None, 0.3, 0.3), (4, None, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "k int, gain array<double>, warps array<array<double>>, centre_x double, centre_y double")
    for r in df.select("*", binary.lens_list(F.col("gain"), F.col("warps"), F.col("centre_x"), F.col("centre_y")).alias("made")).collect():
        assert (None if r["made"] is None else bytes(r["made"])) == as_list(r)
    poly = spark.createDataFrame([([17.0, 4093.5, 0.0, -1e-3], 3000, 4000)], "c array<double>, h int, w int")
    made = poly.select(binary.polynomial_list(F.col("c"), F.col("h"), F.col("w")).alias("m")).first()["m"]
    assert bytes(made) == struct.pack(">5I9I4d", 1, 8, 0x01030000, 0, 68, 0, 0, 3000, 4000, 0, 1, 1, 1, 3, 17.0, 4093.5, 0.0, -1e-3)


def test_doubles_there_and_back(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.0, 2.0, 0.1, math.pi, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 0.5, 1 - 2**-53, 1 + 2**-52, 4503599627370497.5]
    values += [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 31)] + [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(600)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", "v", binary.double_hex(F.col("v")).alias("h"))
    for r in df.select("*", binary.double_of(F.col("h")).alias("back")).collect():
        v = values[r["k"]]
        want = "7FF8000000000000" if math.isnan(v) else struct.pack(">d", v).hex().upper()
        assert r["h"] == want, v
        assert math.isnan(r["back"]) if math.isnan(v) else r["back"] == v and math.copysign(1, r["back"]) == math.copysign(1, v)
    floats = [struct.pack(">I", x) for x in [0, 1 << 31, 1, 0x7FFFFF, 0x800000, 0x3F800000, 0x7F800000, 0xFF800000, 0x7FC00000, 0x42C80000, *(rng.randrange(1 << 32) for _ in range(300))]]
    for r in spark.createDataFrame([(x.hex(),) for x in floats], "h string").select("h", binary.float_of(F.col("h")).alias("v")).collect():
        want = struct.unpack(">f", bytes.fromhex(r["h"]))[0]
        assert math.isnan(r["v"]) if math.isnan(want) else r["v"] == want
