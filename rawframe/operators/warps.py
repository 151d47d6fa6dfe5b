"""Gain and warp of whole pictures, line by line, as a reader of lens instructions applies them.

A line of the corrected picture is sampled from some lines of the source: which ones follows from
the warp's polynomial alone. Lines go to bands of the corrected picture with what their neighbours need of
them; a band is made in one task from its own lines and that margin. A picture is never whole in a task unless a
warp reaches across it, and samples are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a band.
BAND = 128
#: Far beyond the rounding of a line's place.
_SLACK = 1e-6


def _extremes(warp: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The least and the greatest value of k0 + k1 u + k2 u^2 + k3 u^3 for u from low to high."""
    k = [F.get(warp, F.lit(i)) for i in range(4)]
    value = lambda u: k[0] + u * (k[1] + u * (k[2] + u * k[3]))
    root = F.sqrt(F.greatest(k[2] * k[2] - k[1] * k[3] * 3.0, F.lit(0.0)))
    turns = F.array((-k[2] - root) / F.nullif(k[3] * 3.0, F.lit(0.0)), (-k[2] + root) / F.nullif(k[3] * 3.0, F.lit(0.0)), -k[1] / F.nullif(k[2] * 2.0, F.lit(0.0)))
    at = F.concat(F.array(low, high), F.filter(turns, lambda u: u.isNotNull() & (u > low) & (u < high)))
    values = F.transform(at, value)
    return F.array_min(values), F.array_max(values)


def reaches(pictures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, first, last): the source's lines that each line of the corrected picture is sampled from."""
    c = F.col
    cx, cy = c("centre_x") * c("active_width"), c("centre_y") * c("active_height")
    unit = F.hypot(F.greatest(cx, c("active_width") - cx), F.greatest(cy, c("active_height") - cy))
    lined = pictures.select("*", F.explode(F.sequence(F.lit(0), c("height").cast("int") - 1)).alias("y"))
    ay = c("offset_y") + (c("y") + 0.5) * c("scale_y") - cy
    ax = F.greatest(F.abs(c("offset_x") + c("scale_x") * 0.5 - cx), F.abs(c("offset_x") + (c("width") - 0.5) * c("scale_x") - cx))
    low, high = _extremes(c("warp"), ay * ay / (unit * unit), (ay * ay + ax * ax) / (unit * unit))
    place = lambda ratio: (cy + ay * ratio - c("offset_y")) / c("scale_y") - 0.5
    held = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    up, down = F.least(place(low), place(high)) - _SLACK, F.greatest(place(low), place(high)) + _SLACK
    first = F.floor(held(up, F.greatest(c("height") - 2, F.lit(0))))
    last = F.least(F.floor(held(down, c("height") - 1)) + 1, c("height") - 1)
    straight = c("warp").isNull() | ~(unit > 0)
    return lined.select(*keys, "y", F.when(straight, c("y")).otherwise(first).cast("int").alias("first"), F.when(straight, c("y")).otherwise(last).cast("int").alias("last"))


def corrected(lines: DataFrame, pictures: DataFrame, keys: list[str], channels: int = 3, band: int = BAND) -> DataFrame:
    """(keys, y, line): the lines (keys, y, line: of each pixel its channels) of all pictures, with their gain and their warp.

    pictures: keys, height, width (of the picture's pixels), active_width, active_height, centre_x, centre_y (shares
    of the active area), offset_x, offset_y, scale_x, scale_y (which turn a pixel into a place there), gain (five
    coefficients) and warp (four), null where there is none. A line that isn't there is read as zeros;
    lines of pictures that aren't named are left out; places outside are held to the edge."""
    needs = reaches(pictures, keys).groupBy(*keys, F.floor(F.col("y") / band).cast("int").alias("_band")).agg(F.min("first").alias("_first"), F.max("last").alias("_last"))
    blocks = needs.select(*keys, "_band", "_first", "_last", F.explode(F.sequence(F.floor(F.col("_first") / band).cast("int"), F.floor(F.col("_last") / band).cast("int"))).alias("_block"))
    sizes = ["height", "width", "active_width", "active_height", "centre_x", "centre_y", "offset_x", "offset_y", "scale_x", "scale_y"]
    how = F.struct(*[F.col(s).cast("double").alias(s) for s in sizes], F.col("gain").cast("array<double>").alias("gain"), F.col("warp").cast("array<double>").alias("warp"))
    sent = lines.select(*keys, F.col("y").cast("int").alias("y"), F.col("line").cast("array<double>").alias("line"), F.floor(F.col("y") / band).cast("int").alias("_block"))
    met = sent.join(blocks, [*keys, "_block"]).where("y between _first and _last").drop("_block", "_first", "_last")
    # How a picture is corrected goes to its bands once, beside the lines.
    named = needs.select(*keys, "_band").join(pictures.select(*keys, how.alias("how")), keys).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_band").alias("_number"), "how")

    def make(own: pa.Table, parameters: pa.Table) -> pa.Table:
        if not parameters.num_rows:
            return pa.table({**{k: own.column(k)[:0] for k in keys}, "y": pa.array([], pa.int32()), "line": pa.array([], pa.list_(pa.float64()))})
        number = parameters.column("_number")[0].as_py()
        p = parameters.column("how")[0].as_py()
        ys = np.arange(number * band, min(int(p["height"]), (number + 1) * band))
        made = _band(own, p, ys, channels)
        rows = {k: parameters.column(f"_{i}").take(pa.array([0] * len(ys))) for i, k in enumerate(keys)}
        return pa.table({**rows, "y": pa.array(ys, pa.int32()), "line": pa.array(list(made), pa.list_(pa.float64()))})

    schema = ", ".join([*(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys), "y int, line array<double>"])
    return met.groupBy(*keys, "_band").cogroup(named.groupBy(*[f"_{i}" for i in range(len(keys))], "_number")).applyInArrow(make, schema)


def _band(own: pa.Table, p: dict, ys: np.ndarray, channels: int) -> np.ndarray:
    """The corrected lines ys of a picture from the lines in `own`."""
    w, h = int(p["width"]), int(p["height"])
    at = own.column("y").to_numpy()
    low = int(min(at.min(initial=ys[0]), ys[0]))
    source = np.zeros((int(max(at.max(initial=ys[-1]), ys[-1])) - low + 1, w, channels))
    for y, line in zip(at, own.column("line")):
        values = line.values.to_numpy(zero_copy_only=False)
        flat = source[y - low].reshape(-1)
        flat[: len(values)] = values[: len(flat)]
    cx, cy = p["centre_x"] * p["active_width"], p["centre_y"] * p["active_height"]
    unit = np.hypot(max(cx, p["active_width"] - cx), max(cy, p["active_height"] - cy))
    across = p["offset_x"] + (np.arange(w) + 0.5) * p["scale_x"] - cx
    down = lambda y: p["offset_y"] + (y + 0.5) * p["scale_y"] - cy
    if p["gain"] is not None and unit > 0:
        for k, y in enumerate(range(low, low + len(source))):
            x = (across**2 + down(y) ** 2) / unit**2
            source[k] *= (1.0 + x * np.polynomial.polynomial.polyval(x, p["gain"]))[:, None]
    if p["warp"] is None or not unit > 0:
        return source[ys - low].reshape(len(ys), -1)
    out = np.empty((len(ys), w * channels))
    for k, y in enumerate(ys):
        ay = down(y)
        ratio = np.polynomial.polynomial.polyval((across**2 + ay**2) / unit**2, p["warp"])
        fx = np.clip((cx + across * ratio - p["offset_x"]) / p["scale_x"] - 0.5, 0, w - 1)
        fy = np.clip((cy + ay * ratio - p["offset_y"]) / p["scale_y"] - 0.5, 0, h - 1)
        ix, iy = np.minimum(fx.astype(int), max(w - 2, 0)), np.minimum(fy.astype(int), max(h - 2, 0))
        tx, ty = (fx - ix)[:, None], (fy - iy)[:, None]
        right, upper, lower = np.minimum(ix + 1, w - 1), iy - low, np.minimum(iy + 1, h - 1) - low
        above = (1 - tx) * source[upper, ix] + tx * source[upper, right]
        below = (1 - tx) * source[lower, ix] + tx * source[lower, right]
        out[k] = ((1 - ty) * above + ty * below).reshape(-1)
    return out
