"""The sample kernels over lines: one row a line of a picture, its samples in an array.

Lines are (keys, y, line): y counts within the picture, `line` holds its samples from left to
right, of several planes one pixel after another. Neighbours in a line are looked up in the
array, those above and below come from a window over the picture's lines (so a task holds one
picture's lines at most), and a picture of twenty megapixels is some thousand rows. The long
form of `samples` gives the same results, a row a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import levels, numbers

TILE = 256


def to_lines(samples: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Lines of samples (keys, y, x, v)."""
    packed = samples.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v")))).alias("_l"))
    return packed.select(*keys, "y", F.transform("_l", lambda s: s["v"]).alias("line"))


def to_samples(lines: DataFrame, keys: list[str], columns: tuple[str, ...] = ("line",), names: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, y, x, names) of arrays of equal length."""
    long = lines.select(*keys, "y", F.posexplode(F.arrays_zip(*columns)).alias("x", "_s"))
    return long.select(*keys, "y", F.col("x").cast("bigint").alias("x"), *[F.col("_s")[c].alias(n) for c, n in zip(columns, names)])


def above(keys: list[str], by: int = 1) -> Column:
    """The line `by` lines above; below with a negative number."""
    return F.lag("line", by).over(Window.partitionBy(*keys).orderBy("y")) if by > 0 else F.lead("line", -by).over(Window.partitionBy(*keys).orderBy("y"))


def plane_of(line: Column, plane: int, planes: int) -> Column:
    """The samples of one plane of a line."""
    return F.filter(line, lambda _, i: i % planes == plane) if planes > 1 else line


def sample_bytes(line: Column, size: int = 2, big_endian: bool = False) -> Column:
    """The bytes of samples, in hexadecimal digits."""
    byte = lambda v, shift: F.lpad(F.hex(F.shiftright(v.cast("int"), shift).bitwiseAND(255)), 2, "0")
    if size == 1:
        return F.array_join(F.transform(line, lambda v: byte(v, 0)), "")
    order = (8, 0) if big_endian else (0, 8)
    return F.array_join(F.transform(line, lambda v: F.concat(*[byte(v, s) for s in order])), "")


def tiles(lines: DataFrame, keys: list[str], tile: int = TILE, planes: int = 1) -> DataFrame:
    """(keys, ty, tx, plane, y, line): lines cut into tiles, and into planes. The last tiles are as large as what is left."""
    n = F.ceil(F.size("line") / (tile * planes)).cast("int")
    cut = lines.select(*keys, F.floor(F.col("y") / tile).alias("ty"), "y", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.struct(t.alias("tx"), F.slice(F.col("line"), t * (tile * planes) + 1, F.lit(tile * planes)).alias("part")))).alias("_t"))
    each = F.array(*[F.struct(F.lit(p).alias("plane"), plane_of(F.col("_t.part"), p, planes).alias("line")) for p in range(planes)])
    return cut.select(*keys, "ty", F.col("_t.tx").alias("tx"), "y", F.explode(each).alias("_p")).select(*keys, "ty", "tx", "_p.plane", "y", "_p.line")


def tile_digests(lines: DataFrame, keys: list[str], tile: int = TILE, planes: int = 1, size: int = 2) -> DataFrame:
    """(keys, ty, tx, digest): MD5 of each tile, plane after plane, low bytes first."""
    cut = tiles(lines, keys, tile, planes).select(*keys, "ty", "tx", "plane", "y", sample_bytes(F.col("line"), size).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("plane", "y", "h")))
    return cut.groupBy(*keys, "ty", "tx").agg(ordered.alias("_h")).select(*keys, "ty", "tx", F.md5(F.unhex(F.array_join(F.col("_h.h"), ""))).alias("digest"))


def image_digests(lines: DataFrame, keys: list[str], tile: int = TILE, planes: int = 1, size: int = 2) -> DataFrame:
    """(keys, digest, n): the tiles' digests in row-major order, digested."""
    own = tile_digests(lines, keys, tile, planes, size)
    return own.groupBy(*keys).agg(F.md5(F.unhex(F.expr("listagg(digest, '') within group (order by ty, tx)"))).alias("digest"), F.count("*").alias("n"))


def linear_digests(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest): MD5 of all samples in reading order, planes as they are stored; a picture meets in one task, as the definition has it."""
    rows = lines.select(*keys, "y", sample_bytes(F.col("line")).alias("h"))
    return rows.groupBy(*keys).agg(F.md5(F.unhex(F.expr("listagg(h, '') within group (order by y)"))).alias("digest"))


def linearised(lines: DataFrame, black: list[float], rows: int, cols: int, white: float) -> DataFrame:
    """lines with `linear`, by a repeating pattern of black levels."""
    pattern = F.array(*[F.lit(b) for b in black])
    value = lambda v, x: levels.linear_value(v, levels.pattern_at(pattern, rows, cols, F.col("y"), x), F.lit(white), F.lit(max(black)))
    return lines.withColumn("linear", F.transform("line", value))


def repaired(lines: DataFrame, keys: list[str], green: int = 1) -> DataFrame:
    """lines with `fixed`: zeros of a 2x2 mosaic become the mean of neighbours of their colour, green where (y + x) % 2 is `green`.

    Green ones have four diagonal neighbours, others four two away in line; zeros and what lies
    outside don't count, and without any neighbour the zero stays."""
    near = lines.select("*", *[above(keys, by).alias(f"_{n}") for n, by in (("n", 1), ("nn", 2), ("s", -1), ("ss", -2))])
    at = lambda line, x: F.when(x >= 0, F.get(F.col(line) if isinstance(line, str) else line, x))

    def fixed(v: Column, x: Column) -> Column:
        diagonal = F.array(at("_n", x - 1), at("_n", x + 1), at("_s", x - 1), at("_s", x + 1))
        straight = F.array(at("_nn", x), at("_ss", x), at("line", x - 2), at("line", x + 2))
        used = F.filter(F.when((F.col("y") + x) % 2 == green, diagonal).otherwise(straight), lambda n: n > 0)
        n = F.size(used)
        total = F.aggregate(used, F.lit(0).cast("bigint"), lambda s, u: s + u)
        return F.when((v == 0) & (n > 0), F.floor((total + F.floor(n / 2)) / F.nullif(n, F.lit(0))).cast("bigint")).otherwise(v.cast("bigint"))

    return near.withColumn("fixed", F.transform("line", fixed)).drop("_n", "_nn", "_s", "_ss")


def repaired_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, repaired) of lines with `fixed`: how many zeros have got a value."""
    changed = F.size(F.filter(F.zip_with("line", "fixed", lambda a, b: a != b), lambda x: x))
    return lines.groupBy(*keys).agg(F.sum(changed).cast("bigint").alias("repaired"))


def residuals(lines: DataFrame, keys: list[str], components: int = 1, precision: int = 16) -> DataFrame:
    """lines with arrays `difference` and `category` for the left-neighbour predictor.

    Samples belong to `components` in turn; the first of a line is predicted from the line above,
    the very first from the middle of the range."""
    near = lines.withColumn("_n", above(keys))
    left = lambda x: F.when(x >= components, F.get("line", x - components)).otherwise(F.coalesce(F.get("_n", x), F.lit(1 << (precision - 1))))
    out = near.withColumn("difference", F.transform("line", lambda v, x: numbers.residual(v, left(x)).cast("bigint")))
    return out.withColumn("category", F.transform("difference", lambda d: numbers.category(d).cast("bigint"))).drop("_n")


def predictors(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines with `line` less its first sample and arrays p1..p7, the predictions of the seven predictors; the first line has none."""
    near = lines.withColumn("_n", above(keys)).where("_n is not null and size(line) > 1")
    half = lambda x: F.floor(x / 2).cast("bigint")
    rules = [lambda a, b, c: a, lambda a, b, c: b, lambda a, b, c: c, lambda a, b, c: a + b - c, lambda a, b, c: a + half(b - c), lambda a, b, c: b + half(a - c), lambda a, b, c: half(a + b)]
    places = F.sequence(F.lit(1), F.size("line") - 1)
    each = lambda rule: F.transform(places, lambda x: rule(F.get("line", x - 1), F.get("_n", x), F.get("_n", x - 1)).cast("bigint"))
    made = [each(rule).alias(f"p{k + 1}") for k, rule in enumerate(rules)]
    return near.select(*lines.columns, *made).withColumn("line", F.expr("slice(line, 2, size(line) - 1)"))


def value_ranges(lines: DataFrame, keys: list[str], column: str = "linear") -> DataFrame:
    """(keys, lower, upper): the least and greatest values of pictures, 256 steps apart at least."""
    found = lines.groupBy(*keys).agg(F.min(F.array_min(column)).alias("low"), F.max(F.array_max(column)).alias("high"))
    narrow = F.col("high") < F.col("low") + 255
    upper = F.when(narrow, F.least(F.lit(65535), F.col("low") + 255)).otherwise(F.col("high"))
    return found.select(*keys, F.when(narrow, upper - 255).otherwise(F.col("low")).cast("bigint").alias("lower"), upper.cast("bigint").alias("upper"))


def tone_tables(ranges: DataFrame, keys: list[str], steps: int = 65536) -> DataFrame:
    """(keys, v, stored): what each linear value of a picture (keys, lower, upper) is stored as."""
    values = ranges.select(*keys, "lower", "upper", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("v"))
    share = (F.col("v") - F.col("lower")) / F.nullif((F.col("upper") - F.col("lower")).cast("double"), F.lit(0.0))
    return values.select(*keys, "v", F.round(levels.lossy_encode(share) * 65535.0).cast("int").alias("stored"))


def differing(lines: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, differing): samples of pictures, and how many another copy of them has otherwise.

    Lines are compared by place; one that the copy lacks differs wholly."""
    met = lines.join(other.select(*keys, "y", F.col("line").alias("_o")), [*keys, "y"], "left")
    n = F.size(F.filter(F.zip_with("line", F.coalesce("_o", F.array().cast(other.schema["line"].dataType)), lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    return met.groupBy(*keys).agg(F.sum(F.size("line")).cast("bigint").alias("n"), F.sum(n).cast("bigint").alias("differing"))


def unpacked(rows: DataFrame, keys: list[str], data: str, bits: Column, big_endian: Column) -> DataFrame:
    """(keys, line): samples of 8 to 16 bits from packed bytes, the first bit the highest; 16-bit ones in the file's order.

    A last sample that isn't whole is left out; other depths give no samples."""

    def samples(raw: bytes, depth: int, big: bool) -> np.ndarray:
        if depth in (8, 16):
            return np.frombuffer(raw, "u1" if depth == 8 else ">u2" if big else "<u2", len(raw) * 8 // depth)
        if not 8 < depth < 16:
            return np.empty(0, np.int32)
        each = np.unpackbits(np.frombuffer(raw, np.uint8))
        return each[: len(each) // depth * depth].reshape(-1, depth) @ (1 << np.arange(depth - 1, -1, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for b in batches:
            found = [samples(x.as_py() or b"", depth or 0, bool(big)).astype(np.int32) for x, depth, big in zip(b.column(n), b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, pa.list_(pa.int32()))], [*keys, "line"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, F.col(data).alias("_d"), bits.cast("int").alias("_b"), big_endian.alias("_e")).mapInArrow(run, f"{kinds}, line array<int>")
