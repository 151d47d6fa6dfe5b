"""Operators on samples in long form: (image, y, x, v), further columns allowed.

Neighbours come from windows over rows and columns of an image, and statistics from grouped
aggregates, so a picture needn't fit into a task. Large archives keep tiles instead; the long
form is for checks and small frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import levels, numbers

TILE = 256
BLOCK = 32


def tile_digests(samples: DataFrame, keys: list[str], tile: int = TILE, bytes_per_sample: int = 2) -> DataFrame:
    """(keys, ty, tx, digest): MD5 of each tile's samples, row by row, low byte first."""
    low = F.lpad(F.hex(F.col("v").cast("int").bitwiseAND(255)), 2, "0")
    high = F.lpad(F.hex(F.shiftright(F.col("v").cast("int"), 8)), 2, "0")
    cells = samples.select(*keys, F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"), "y", "x", (F.concat(low, high) if bytes_per_sample == 2 else low).alias("h"))
    # Lines first: what a task gathers of a tile are then a few hundred texts.
    lines = cells.groupBy(*keys, "ty", "tx", "y").agg(F.expr("listagg(h, '') within group (order by x)").alias("h"))
    return lines.groupBy(*keys, "ty", "tx").agg(F.md5(F.unhex(F.expr("listagg(h, '') within group (order by y)"))).alias("digest"))


def digest_of_digests(parts: DataFrame, keys: list[str], order: str, digest: str = "digest") -> DataFrame:
    """(keys, digest, n): MD5 of the parts' digests in order."""
    ordered = F.expr(f"listagg({digest}, '') within group (order by {order})")
    return parts.groupBy(*keys).agg(F.md5(F.unhex(ordered)).alias("digest"), F.count("*").alias("n"))


def image_digests(samples: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Tiles are digested by themselves, then the tiles' digests in row-major order."""
    return digest_of_digests(tile_digests(samples, keys, tile), keys, "ty, tx")


def linear_digests(samples: DataFrame, keys: list[str]) -> DataFrame:
    """MD5 of all samples in reading order: a picture's lines meet in one task, as the definition has it."""
    low = F.lpad(F.hex(F.col("v").cast("int").bitwiseAND(255)), 2, "0")
    high = F.lpad(F.hex(F.shiftright(F.col("v").cast("int"), 8)), 2, "0")
    lines = samples.withColumn("h", F.concat(low, high)).groupBy(*keys, "y").agg(F.expr("listagg(h, '') within group (order by x)").alias("h"))
    return lines.groupBy(*keys).agg(F.md5(F.unhex(F.expr("listagg(h, '') within group (order by y)"))).alias("digest"))


def along(keys: list[str], line: str, at: str) -> Window:
    return Window.partitionBy(*keys, line).orderBy(at)


def repaired(samples: DataFrame, keys: list[str], green: Column) -> DataFrame:
    """samples with `fixed`: a 0 of a 2x2 mosaic becomes the mean of its neighbours of the same colour.

    Green ones take the four diagonal neighbours, others those two away in line; neighbours that
    are 0 or outside don't count, and without any the 0 stays."""
    row, column = along(keys, "y", "x"), along(keys, "x", "y")
    # All samples of a line are there, so a neighbour's place is its rank.
    near = samples.select(
        "*",
        F.lag("v", 2).over(row).alias("_w"),
        F.lead("v", 2).over(row).alias("_e"),
        F.lag("v", 2).over(column).alias("_n"),
        F.lead("v", 2).over(column).alias("_s"),
        F.lag("v", 1).over(row).alias("_l"),
        F.lead("v", 1).over(row).alias("_r"),
    )
    for name, side in (("_l", "l"), ("_r", "r")):
        near = near.withColumn(f"_u{side}", F.lag(name, 1).over(column)).withColumn(f"_d{side}", F.lead(name, 1).over(column))
    diagonal, straight = ["_ul", "_ur", "_dl", "_dr"], ["_w", "_e", "_n", "_s"]
    total = lambda c: sum((F.coalesce(F.col(x), F.lit(0)) for x in c), F.lit(0))
    count = lambda c: sum((F.when(F.col(x) > 0, 1).otherwise(0) for x in c), F.lit(0))
    t, n = F.when(green, total(diagonal)).otherwise(total(straight)), F.when(green, count(diagonal)).otherwise(count(straight))
    mean = F.floor((t + F.floor(n / 2)) / F.nullif(n, F.lit(0))).cast("bigint")
    return near.select(*samples.columns, F.when((F.col("v") == 0) & (n > 0), mean).otherwise(F.col("v")).cast("bigint").alias("fixed"))


def residuals(samples: DataFrame, keys: list[str], components: int = 1, precision: int = 16) -> DataFrame:
    """samples with `difference` and `category` for the left-neighbour predictor.

    Samples of a line belong to `components` in turn; the first of a line is predicted from the
    line above, the very first from the middle of the range."""
    own = samples.withColumn("_c", F.col("x") % components)
    left = F.lag("v").over(Window.partitionBy(*keys, "y", "_c").orderBy("x"))
    above = F.lag("v").over(along(keys, "x", "y"))
    predicted = F.coalesce(left, above, F.lit(1 << (precision - 1)))
    out = own.withColumn("difference", numbers.residual(F.col("v"), predicted).cast("bigint"))
    return out.withColumn("category", numbers.category(F.col("difference")).cast("bigint")).drop("_c")


def predictors(samples: DataFrame, keys: list[str]) -> DataFrame:
    """samples with p1..p7, the predictions of the seven predictors, where all three neighbours are there."""
    near = samples.withColumn("_a", F.lag("v").over(along(keys, "y", "x"))).withColumn("_b", F.lag("v").over(along(keys, "x", "y")))
    near = near.withColumn("_c", F.lag("_b").over(along(keys, "y", "x"))).where("_c is not null and _a is not null and _b is not null")
    a, b, c = (F.col(x).cast("bigint") for x in ("_a", "_b", "_c"))
    half = lambda x: F.floor(x / 2).cast("bigint")
    made = [a, b, c, a + b - c, a + half(b - c), b + half(a - c), half(a + b)]
    return near.select(*samples.columns, *[p.alias(f"p{k + 1}") for k, p in enumerate(made)])


def cell_means(samples: DataFrame, keys: list[str], height: int, width: int, plane: Column, black: Column) -> DataFrame:
    """(keys, cy, cx, plane, mean, n): mean of v less black over each cell and plane."""
    at = [F.floor(F.col("y") / height).cast("bigint").alias("cy"), F.floor(F.col("x") / width).cast("bigint").alias("cx"), plane.alias("plane")]
    return samples.groupBy(*keys, *at).agg(F.avg(F.col("v") - black).alias("mean"), F.count("*").alias("n"))


def shrunk(samples: DataFrame, keys: list[str], size: int, to: int, along_: str = "x") -> DataFrame:
    """samples of one axis averaged down from `size` to `to` places, parts of a sample by their share.

    A sample adds to as many places as it overlaps, two at most when shrinking, so they are exploded in place."""
    step = size / to
    first = F.floor(F.col(along_) / F.lit(step)).cast("int")
    last = F.least(F.ceil((F.col(along_) + 1) / F.lit(step)).cast("int") - 1, F.lit(to - 1))
    spread = samples.withColumn("_to", F.explode(F.sequence(first, F.greatest(first, last))))
    low, high = F.greatest(F.col(along_).cast("double"), F.col("_to") * F.lit(step)), F.least(F.col(along_) + F.lit(1.0), (F.col("_to") + 1) * F.lit(step))
    others = [c for c in samples.columns if c not in (along_, "v", *keys)]
    out = spread.withColumn("_w", (high - low) / F.lit(step)).where("_w > 1e-12")
    return out.groupBy(*keys, *others, F.col("_to").cast("bigint").alias(along_)).agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def error_statistics(pairs: DataFrame, keys: list[str], tile: int = TILE, block: int = BLOCK, unit: float = 1 / 65535) -> DataFrame:
    """Of (keys, y, x, v, stored): mean, rms, worst tile and its rms, worst block mean, 99.9th percentile and maximum.

    The percentile is the smallest error that all but n div 1000 don't exceed, from a histogram.
    Blocks of less than a quarter's samples don't count; of equal tiles the first is named."""
    if not keys:
        return error_statistics(pairs.withColumn("_all", F.lit(1)), ["_all"], tile, block, unit).drop("_all")
    d = pairs.withColumn("d", (F.col("stored") - F.col("v")).cast("double"))
    whole = d.groupBy(*keys).agg(F.avg("d").alias("mean"), F.avg(F.col("d") * F.col("d")).alias("square"), F.count("*").alias("n"))
    tiles = d.groupBy(*keys, F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(F.avg(F.col("d") * F.col("d")).alias("s"))
    worst = tiles.groupBy(*keys).agg(F.max(F.struct("s", -F.col("ty"), -F.col("tx"))).alias("w"))
    worst = worst.select(*keys, F.sqrt("w.s").alias("tile_rms"), (-F.col("w.col2")).alias("worst_ty"), (-F.col("w.col3")).alias("worst_tx"))
    blocks = d.groupBy(*keys, F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")).agg(F.abs(F.avg("d")).alias("m"), F.count("*").alias("c"))
    blocks = blocks.where(F.col("c") >= block * block // 4).groupBy(*keys).agg(F.max("m").alias("block_mean"))
    histogram = d.groupBy(*keys, F.abs("d").alias("e")).agg(F.count("*").alias("c"))
    ordered = Window.partitionBy(*keys).orderBy("e")
    seen = histogram.withColumn("upto", F.sum("c").over(ordered)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    top = seen.groupBy(*keys).agg(F.min(F.when(F.col("upto") >= F.col("n") - F.floor(F.col("n") / 1000), F.col("e"))).alias("p999"), F.max("e").alias("most"))
    out = whole
    for other in (worst, blocks, top):
        out = out.join(other, keys, "left")
    scaled = lambda c: (F.col(c) * unit).alias(c)
    return out.select(*keys, "n", scaled("mean"), (F.sqrt("square") * unit).alias("rms"), scaled("tile_rms"), "worst_ty", "worst_tx", (F.coalesce("block_mean", F.lit(0.0)) * unit).alias("block_mean"), scaled("p999"), scaled("most"))


def alignment(pairs: DataFrame, keys: list[str], moves: list[tuple[int, int]], rows: int = 1, cols: int = 1) -> DataFrame:
    """(keys, dy, dx, field, own, moved, margin): is every field of stored values nearest to its own place?

    Each sample is compared with the picture a move away; moves are exploded in place, so the
    picture is joined with itself by place, not crossed."""
    shift = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in moves])
    asked = pairs.withColumn("m", F.explode(shift)).select(*keys, F.col("y"), F.col("x"), "v", "stored", "m.dy", "m.dx", (F.col("y") + F.col("m.dy")).alias("_y"), (F.col("x") + F.col("m.dx")).alias("_x"))
    there = pairs.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("_v"))
    met = asked.join(there, [*keys, "_y", "_x"])
    own, moved = F.col("stored") - F.col("v"), F.col("stored") - F.col("_v")
    field = (F.pmod("y", F.lit(rows)) * cols + F.pmod("x", F.lit(cols))).cast("bigint")
    out = met.groupBy(*keys, "dy", "dx", field.alias("field")).agg(F.sum((own * own).cast("double")).alias("own"), F.sum((moved * moved).cast("double")).alias("moved"))
    margin = F.when(F.col("own") == F.col("moved"), None).when(F.col("own") > 0, (F.col("moved") - F.col("own")) / F.nullif("own", F.lit(0.0))).otherwise(1e9)
    return out.withColumn("margin", margin)


def lossy_verdict(rms: Column, tile_rms: Column, block_mean: Column, margin: Column, mean: Column, distance: Column) -> Column:
    """The first rule that a lossy file breaks, or null."""
    return (
        F.when(rms > distance * 0.025, "rms")
        .when(tile_rms > distance * 0.03, "tile")
        .when(block_mean > distance * 0.01 + 0.001, "block")
        .when(margin <= 0, "alignment")
        .when(F.abs(mean) > distance * 0.001 + 0.0001, "mean")
    )


def linearised(samples: DataFrame, black: list[float], rows: int, cols: int, white: float) -> DataFrame:
    """samples with `linear`, by a repeating pattern of black levels."""
    pattern = F.array(*[F.lit(b) for b in black])
    at = levels.pattern_at(pattern, rows, cols, F.col("y"), F.col("x"))
    return samples.withColumn("linear", levels.linear_value(F.col("v"), at, F.lit(white), F.lit(max(black))))
