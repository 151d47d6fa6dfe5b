"""Lens corrections from cameras' curves: fitted polynomials, zoom, notes and the list of instructions, a row a lens.

A lens has up to four curves: distortion, the aberration of red and of blue, vignetting. Their knots are gathered
once a lens (some hundreds at most), joined to the lenses, and the zoom found by grouped queries; the fits
themselves are a few small arrays a lens, in Arrow batches, of which some lenses are in hand at a time. Curves are composed by looking one up
at what another one gives: the aberration at the radius that the distortion takes a point from, the
distortion at the zoomed radius. If the fit of one plane isn't sound, the lens goes without any warp.

Lines of pictures are then corrected as a reader of the list would do it: `operators.warps`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import binary, rules
from . import tables

# Radii a lens is sampled at, the weight outside the picture, the least gain.
RADII, OUTSIDE, LEAST_GAIN = 512, 0.02, 0.1
#: Lenses that a task fits at once.
SOME_LENSES = 256
CURVES = ("distortion", "red", "blue", "vignetting")
# What values of a curve a lens can need.
SANE = {"distortion": (0.5, 1.5), "red": (-0.02, 0.02), "blue": (-0.02, 0.02), "vignetting": (0.5, 16.0)}
# The notes' texts.
NOT_SQUARE = "lens corrections left out: the pixels are not square"
NOT_THREE = "chromatic aberration left out: the sensor does not have three colours"
NO_WARP = "distortion left out: the camera's curve cannot be expressed in DNG"
NO_GAIN = "vignetting left out: the camera's curve cannot be expressed in DNG"


def gathered(knots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a struct of arrays radius and value for each curve) of knots (keys, curve, radius, value).

    Curves that no lens can have are emptied; the two aberrations stand or fall together."""
    one = lambda c: F.array_sort(F.collect_list(F.when(F.col("curve") == c, F.struct("radius", "value"))))
    raw = knots.groupBy(*keys).agg(*[one(c).alias(c) for c in CURVES])
    good = {c: rules.sane_curve(F.col(c)["radius"], F.col(c)["value"], *SANE[c]) for c in CURVES}
    colours = good["red"] & good["blue"] & ((F.size("red") == 0) == (F.size("blue") == 0))
    kept = good | {"red": colours, "blue": colours}
    return raw.select(*keys, *[F.when(kept[c], F.col(c)).otherwise(F.slice(F.col(c), 1, 0)).alias(c) for c in CURVES])


def curve_at(radius: np.ndarray, value: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A curve's values: linear between its knots, which ascend, and on beyond them; 0 without knots."""
    if len(radius) < 2:
        return np.full(len(r), value[0] if len(value) else 0.0)
    i = np.clip(np.searchsorted(radius, r, "right"), 1, len(radius) - 1)
    return value[i - 1] + (r - radius[i - 1]) * (value[i] - value[i - 1]) / (radius[i] - radius[i - 1])


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, first: int, terms: int) -> np.ndarray:
    """Coefficients of x^first, x^(first + 1), ... by weighted least squares."""
    root = np.sqrt(weight)
    return np.linalg.lstsq(x[:, None] ** np.arange(first, first + terms) * root[:, None], y * root, rcond=None)[0]


_R = (np.arange(RADII) + 0.5) / RADII
_X = _R * _R
#: What the fit of a lens gives.
_FIT = StructType([StructField("warps", ArrayType(ArrayType(DoubleType()))), StructField("warp_error", DoubleType()), StructField("gain", ArrayType(DoubleType())), StructField("gain_error", DoubleType())])


def _fit(lens: dict) -> dict:
    """The polynomials of one lens, null where they aren't wanted or one of them isn't sound, and their greatest errors inside the picture."""
    out = dict.fromkeys(_FIT.fieldNames())
    curve = {c: lens[c] for c in CURVES}
    inside = lens["edge"] is not None and lens["edge"] >= _R
    weight = np.where(inside, 1.0, OUTSIDE)
    if lens["bend"] or lens["colour"]:
        at = _R * lens["camera"]
        green = lens["zoom"] * curve_at(*curve["distortion"], lens["zoom"] * at) if lens["bend"] else np.ones(RADII)
        # The aberrations run over the radius in the stored picture, which green's curve has led to.
        wanted = [green * (1 + curve_at(*curve["red"], at * green)), green, green * (1 + curve_at(*curve["blue"], at * green))] if lens["colour"] else [green]
        fits = [fitted(_X, y, weight * _X, 0, 4) for y in wanted]
        values = [np.polynomial.polynomial.polyval(_X, k) for k in fits]
        # A reader inverts r P(r^2): it must grow, in all planes.
        if all((v > 0).all() and (np.diff(_R * v, prepend=0.0) > 0).all() for v in values):
            out["warps"] = [k.tolist() for k in fits]
            out["warp_error"] = float(max((np.abs(v - y) * _R)[inside].max(initial=0.0) for v, y in zip(values, wanted)) * lens["unit"])
    if lens["shade"]:
        g = curve_at(*curve["vignetting"], _R * lens["camera"])
        k = fitted(_X, g - 1, weight / (g * g), 1, 5)
        value = 1 + _X * np.polynomial.polynomial.polyval(_X, k)
        if (value > LEAST_GAIN).all() and 1 + k.sum() > LEAST_GAIN:
            out |= {"gain": k.tolist(), "gain_error": float(100 * (np.abs(value - g) / g)[inside].max(initial=0.0))}
    return out


def _knots(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The radii and values of each lens's knots: parts of the column's own buffers, never objects."""
    ends = np.cumsum([0, *column.value_lengths().to_numpy(zero_copy_only=False)])
    radius, value = (column.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("radius", "value"))
    return [(radius[i:j], value[i:j]) for i, j in zip(ends, ends[1:])]


def _fits(lenses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _lens, _fit): each lens's struct with its fit. Its curves (_curves) aren't sent back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SOME_LENSES):
                b = batch.slice(at, SOME_LENSES)
                curves = b.column("_curves")
                knots = zip(*(_knots(curves.field(c)) for c in CURVES))
                found = [_fit(lens | dict(zip(CURVES, own))) for lens, own in zip(b.column("_lens").to_pylist(), knots)]
                yield b.select([*keys, "_lens"]).append_column("_fit", pa.array(found, kind))

    kind = to_arrow_type(_FIT)
    return lenses.mapInArrow(run, StructType([*lenses.select(*keys, "_lens").schema.fields, StructField("_fit", _FIT)]))


def corrections(lenses: DataFrame, knots: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """(keys, distortion, aberration, vignetting, zoom, warps, gain, warp_error, gain_error, centre_x, centre_y, notes, summary, opcode_list): a row a lens.

    lenses: left, top, width and height of the picture in the active area; active_width, active_height; planes (3 only
    if they are red, green, blue); square (are the pixels); distortion_enabled, ca_enabled, vignetting_enabled, vignetting_in_data,
    fit_frame. mode: all, camera or none. warps holds one array of four coefficients or three (red, green,
    blue), gain five; null where there is none. Errors are in pixels and percent, inside the picture."""
    c = F.col
    curves = gathered(knots, keys)
    # By a merge: gathered knots take many times the room that the plan expects, so they must not be broadcast.
    met = lenses.join(curves.hint("merge"), keys, "left").withColumns({name: F.coalesce(name, F.array().cast(curves.schema[name].dataType)) for name in CURVES})
    x, y = c("left") + c("width") * 0.5, c("top") + c("height") * 0.5
    reach = F.hypot(F.greatest(x, c("active_width") - x), F.greatest(y, c("active_height") - y))
    half = F.hypot("width", "height") * 0.5
    placed = (c("width") > 0) & (c("height") > 0) & (c("active_width") > 0) & (c("active_height") > 0) & (x > 0) & (y > 0) & (x < c("active_width")) & (y < c("active_height"))
    good = F.coalesce(placed & c("square"), F.lit(False))
    has = {name: F.size(name) > 0 for name in CURVES}
    ask = lambda on, in_data=F.lit(False): rules.correction_wanted(F.lit(mode), F.coalesce(on, F.lit(False)), in_data)
    colours = good & has["red"] & ask(c("ca_enabled"))
    asked = met.select(
        *keys,
        "width",
        "height",
        "fit_frame",
        *CURVES,
        F.when(good, reach).alias("unit"),
        F.when(good, reach / F.nullif(half, F.lit(0.0))).alias("camera"),
        F.when(good, half / F.nullif(reach, F.lit(0.0))).alias("edge"),
        F.when(good, x / F.nullif(c("active_width"), F.lit(0))).alias("centre_x"),
        F.when(good, y / F.nullif(c("active_height"), F.lit(0))).alias("centre_y"),
        (good & has["distortion"] & ask(c("distortion_enabled"))).alias("bend"),
        (colours & (c("planes") == 3)).alias("colour"),
        (good & has["vignetting"] & ask(c("vignetting_enabled"), F.coalesce("vignetting_in_data", F.lit(False)))).alias("shade"),
        (colours & (c("planes") != 3)).alias("left_out"),
        (~c("square") & (has["distortion"] | has["red"] | has["vignetting"]) & (F.lit(mode) != "none")).alias("oblong"),
    )
    filling = asked.where(c("bend") & c("fit_frame")).select(*keys, c("width").cast("double").alias("width"), c("height").cast("double").alias("height"), c("distortion")["radius"].alias("radius"), c("distortion")["value"].alias("ratio"))
    zoomed = asked.join(tables.zooms(filling, keys).hint("merge"), keys, "left").withColumn("zoom", F.coalesce("zoom", F.lit(1.0)))
    parts = ["unit", "camera", "edge", "zoom", "centre_x", "centre_y", "bend", "colour", "shade", "left_out", "oblong"]
    fits = _fits(zoomed.select(*keys, F.struct(*parts).alias("_lens"), F.struct(*CURVES).alias("_curves")), keys).select(*keys, *[c("_lens")[p].alias(p) for p in parts], "_fit.*")
    warped, shaded = c("warps").isNotNull(), c("gain").isNotNull()
    wanted = c("bend") | c("colour")
    notes = F.concat_ws("; ", F.when(c("oblong"), NOT_SQUARE), F.when(c("left_out"), NOT_THREE), F.when(wanted & ~warped, NO_WARP), F.when(c("shade") & ~shaded, NO_GAIN))
    zero = lambda name: F.coalesce(name, F.lit(0.0)).alias(name)
    out = fits.select(*keys, (warped & c("bend")).alias("distortion"), (warped & c("colour")).alias("aberration"), shaded.alias("vignetting"), F.when(warped, c("zoom")).otherwise(1.0).alias("zoom"), "warps", "gain", zero("warp_error"), zero("gain_error"), "centre_x", "centre_y", notes.alias("notes"))
    summary = binary.named([(c("distortion"), "distortion"), (c("aberration"), "chromatic aberration"), (c("vignetting"), "vignetting")])
    return out.withColumns({"summary": summary, "opcode_list": binary.lens_list(c("gain"), c("warps"), c("centre_x"), c("centre_y"))})
