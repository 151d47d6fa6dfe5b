"""Errors of lossy pictures and means of pictures over lines: one pass, no row a sample.

Lines are (keys, y, line, ...), their samples arrays, as in `operators.lines`. Tasks add up what they see of each
picture (sums a tile, a block and a field, a sparse histogram of errors) and hand on these sums,
which Spark merges; so the input is read once and what is exchanged grows with tiles, not
with samples. Pictures averaged to cells or to a smaller size go by bands of lines of the result.
The long form of `samples` gives the same results, a row a sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE, BLOCK = 256, 32
#: Lines of the result that a task makes at once.
BAND = 64


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lines of one picture, which are equally long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pictures(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each picture in a batch, split where lines differ in length."""
    lengths = np.diff(batch.column(keys + 1).offsets.to_numpy())
    if not keys:
        groups: dict = {(int(n),): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    else:
        groups = {}
        for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in range(keys)), lengths.tolist())):
            groups.setdefault(k, []).append(i)
    for rows in groups.values():
        yield batch.take(pa.array(np.asarray(rows, np.int64))), np.asarray(rows)


def stored_place(at: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Where a line (or column) of a frame of whole fields is stored."""
    return at % factor * (size // factor) + at // factor


def partial_errors(pairs: DataFrame, keys: list[str], tile: int, block: int, fields: tuple[int, int], size: tuple[int, int] | None) -> DataFrame:
    """(keys, kind, a, b, s, n): of tiles the sum of squared errors, of blocks the sum of errors, of errors' sizes how often they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keys)
        for batch in batches:
            for own, _ in _pictures(batch, k):
                if not len(own.column(k + 1).flatten()):
                    continue
                y = own.column(k).to_numpy(zero_copy_only=False)
                d = _matrix(own.column(k + 2)).astype(np.int64) - _matrix(own.column(k + 1)).astype(np.int64)
                x = np.arange(d.shape[1])
                if size:
                    y, x = stored_place(y, size[0], fields[0]), stored_place(x, size[1], fields[1])
                found = []
                for kind, step, values in ((0, tile, d * d), (1, block, d)):
                    rows, row = np.unique(y // step, return_inverse=True)
                    columns, column = np.unique(x // step, return_inverse=True)
                    at = row[:, None] * len(columns) + column
                    n = np.bincount(at.ravel(), minlength=len(rows) * len(columns))
                    s = np.zeros(len(n), np.int64)
                    np.add.at(s, at.ravel(), values.ravel())
                    used = np.flatnonzero(n)
                    found.append((np.full(len(used), kind), rows[used // len(columns)], columns[used % len(columns)], s[used], n[used]))
                sizes, n = np.unique(np.abs(d), return_counts=True)
                found.append((np.full(len(sizes), 2), sizes, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), n))
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
                first = pa.array(np.zeros(len(columns[0]), np.int64))
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(first) for c in range(k)), *map(pa.array, columns)], [*keys, "kind", "a", "b", "s", "n"])

    parts = pairs.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("line").cast("array<bigint>").alias("line"), F.col("stored").cast("array<bigint>").alias("stored"))
    schema = ", ".join([*([_kinds(pairs, keys)] if keys else []), "kind bigint, a bigint, b bigint, s bigint, n bigint"])
    return parts.mapInArrow(run, schema).groupBy(*keys, "kind", "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def error_statistics(pairs: DataFrame, keys: list[str], tile: int = TILE, block: int = BLOCK, unit: float = 1 / 65535, fields: tuple[int, int] = (1, 1), size: tuple[int, int] | None = None) -> DataFrame:
    """(keys, n, mean, rms, tile_rms, worst_ty, worst_tx, block_mean, p999, most) of (keys, y, line, stored).

    The percentile is the smallest error that all but n div 1000 don't exceed. Blocks of less than a quarter's
    samples don't count; of equal tiles the first is named. With size (height and width of the whole frame) and fields, tiles and
    blocks are those of the frame as it is stored, field by field."""
    parts = partial_errors(pairs, keys, tile, block, fields, size)
    c = F.col
    square = c("s") / c("n")
    own = parts.groupBy(*keys).agg(
        F.sum(F.when(c("kind") == 0, c("n"))).alias("n"),
        F.sum(F.when(c("kind") == 1, c("s"))).alias("total"),
        F.sum(F.when(c("kind") == 0, c("s"))).alias("squares"),
        F.max(F.when(c("kind") == 0, F.struct(square.alias("s"), (-c("a")).alias("ty"), (-c("b")).alias("tx")))).alias("worst"),
        F.max(F.when((c("kind") == 1) & (c("n") >= block * block // 4), F.abs(square))).alias("block"),
        # Errors are numbers of sixteen bits, so a picture has a bounded number of sizes.
        F.array_sort(F.collect_list(F.when(c("kind") == 2, F.struct(c("a").alias("e"), c("n").alias("c"))))).alias("sizes"),
    )
    need = c("n") - F.floor(c("n") / 1000)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at"))
    reached = F.aggregate("sizes", start, lambda s, e: F.struct((s["seen"] + e["c"]).alias("seen"), F.coalesce(s["at"], F.when(s["seen"] + e["c"] >= need, e["e"])).alias("at")))
    return own.select(
        *keys,
        "n",
        (c("total") / c("n") * unit).alias("mean"),
        (F.sqrt(c("squares") / c("n")) * unit).alias("rms"),
        (F.sqrt(c("worst.s")) * unit).alias("tile_rms"),
        (-c("worst.ty")).alias("worst_ty"),
        (-c("worst.tx")).alias("worst_tx"),
        (F.coalesce("block", F.lit(0.0)) * unit).alias("block_mean"),
        (reached["at"] * unit).alias("p999"),
        (F.element_at("sizes", -1)["e"] * unit).alias("most"),
    )


def alignment(pairs: DataFrame, keys: list[str], moves: Sequence[tuple[int, int]], rows: int = 1, cols: int = 1) -> DataFrame:
    """(keys, dy, dx, field, own, moved, margin) of (keys, y, line, stored), with all lines of each picture: is every field of stored values nearest to its own place?

    Lines a move away come from a window over the picture's lines; sums are added up a task before they are merged."""
    away = sorted({dy for dy, _ in moves} - {0})
    ordered = Window.partitionBy(*keys).orderBy("y") if keys else Window.orderBy("y")
    line = F.col("line").cast("array<bigint>")
    shifted = [(F.lead(line, dy) if dy > 0 else F.lag(line, -dy)).over(ordered).alias(f"_{dy}") for dy in away]
    near = pairs.select(*keys, F.col("y").cast("bigint").alias("y"), line.alias("line"), F.col("stored").cast("array<bigint>").alias("stored"), *shifted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keys)
        for batch in batches:
            for part, _ in _pictures(batch, k):
                if not len(part.column(k + 1).flatten()):
                    continue
                out = []
                for dy, dx in moves:
                    there = part.column(f"_{dy}") if dy else part.column("line")
                    used = np.flatnonzero(there.is_valid().to_numpy(zero_copy_only=False))
                    if not len(used):
                        continue
                    y, at = part.column("y").to_numpy(zero_copy_only=False)[used], pa.array(used)
                    v, s, m = (_matrix(x.take(at)) for x in (part.column("line"), part.column("stored"), there))
                    low, high = max(0, -dx), min(v.shape[1], v.shape[1] - dx)
                    if low >= high:
                        continue
                    x = np.arange(low, high)
                    own, moved = (s[:, low:high] - v[:, low:high]) ** 2, (s[:, low:high] - m[:, low + dx : high + dx]) ** 2
                    field = (y % rows)[:, None] * cols + x % cols
                    for f in np.unique(field):
                        out.append((dy, dx, int(f), int(own[field == f].sum()), int(moved[field == f].sum())))
                if out:
                    first = pa.array(np.zeros(len(out), np.int64))
                    numbers = [pa.array(c, pa.int64()) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(first) for c in range(k)), *numbers], [*keys, "dy", "dx", "field", "own", "moved"])

    schema = ", ".join([*([_kinds(pairs, keys)] if keys else []), "dy bigint, dx bigint, field bigint, own bigint, moved bigint"])
    sums = near.mapInArrow(run, schema).groupBy(*keys, "dy", "dx", "field").agg(F.sum("own").cast("double").alias("own"), F.sum("moved").cast("double").alias("moved"))
    margin = F.when(F.col("own") == F.col("moved"), None).when(F.col("own") > 0, (F.col("moved") - F.col("own")) / F.nullif("own", F.lit(0.0))).otherwise(1e9)
    return sums.select(*keys, F.col("dy").cast("int").alias("dy"), F.col("dx").cast("int").alias("dx"), "field", "own", "moved", margin.alias("margin"))


def _banded(lines: DataFrame, keys: list[str], spread: DataFrame, make, schema: str) -> DataFrame:
    """make(lines of a band, its parameters) for each band; spread: keys, _band, how, and the first and last source line that the band needs."""
    each = spread.select(*keys, "_band", "_first", "_last", F.explode(F.sequence(F.floor(F.col("_first") / BAND).cast("int"), F.floor(F.col("_last") / BAND).cast("int"))).alias("_block"))
    sent = lines.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("line").cast("array<double>").alias("line"), F.floor(F.col("y") / BAND).cast("int").alias("_block"))
    met = sent.join(each, [*keys, "_block"]).where("y between _first and _last").select(*keys, "_band", "y", "line")
    named = spread.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_band").alias("_number"), "how")
    return met.groupBy(*keys, "_band").cogroup(named.groupBy(*[f"_{i}" for i in range(len(keys))], "_number")).applyInArrow(make, schema)


def _rows(table: pa.Table, low: int, high: int) -> np.ndarray:
    """The lines low..high in order; those that aren't there are zeros."""
    width = max((len(x) for x in table.column("line").to_pylist()), default=0)
    out = np.zeros((high - low + 1, width))
    for y, line in zip(table.column("y").to_pylist(), table.column("line")):
        values = line.values.to_numpy(zero_copy_only=False)
        out[y - low, : len(values)] = values
    return out


def _averaged(values: np.ndarray, to: int, first: int, last: int, size: int, low: int) -> np.ndarray:
    """The places first..last of `size` lines averaged down to `to`; values has the lines from `low` on. A line counts by the share that a place covers."""
    step = size / to
    edges = np.arange(first, last + 2) * step
    edges = np.minimum(edges, size)
    sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    whole = np.minimum(np.floor(edges).astype(int), size) - low
    part = edges - np.floor(edges)
    padded = np.concatenate([values, np.zeros((1, values.shape[1]))])
    up_to = sums[whole] + padded[np.minimum(whole, len(values))] * part[:, None]
    return np.diff(up_to, axis=0) / step


def shrunk(lines: DataFrame, sizes: DataFrame, keys: list[str], channels: int = 1) -> DataFrame:
    """(keys, y, line): pictures averaged down, every place the mean of what it covers, along lines and then across them.

    lines: (keys, y, line: of each pixel its channels). sizes: keys, height, width, to_height, to_width (not larger)."""
    step = F.col("height") / F.col("to_height")
    bands = sizes.withColumn("_band", F.explode(F.sequence(F.lit(0), F.floor((F.col("to_height") - 1) / BAND).cast("int"))))
    first = F.col("_band") * BAND
    last = F.least(F.col("to_height") - 1, first + BAND - 1)
    how = F.struct(*[F.col(c).cast("int").alias(c) for c in ("height", "width", "to_height", "to_width")], first.cast("int").alias("first"), last.cast("int").alias("last"))
    spread = bands.select(*keys, "_band", F.floor(first * step).cast("int").alias("_first"), F.least(F.ceil((last + 1) * step), F.col("height")).cast("int").alias("_end"), how.alias("how")).withColumn("_last", F.col("_end") - 1)

    def make(own: pa.Table, parameters: pa.Table) -> pa.Table:
        if not parameters.num_rows or not own.num_rows:
            return pa.table({**{k: own.column(k)[:0] for k in keys}, "y": pa.array([], pa.int64()), "line": pa.array([], pa.list_(pa.float64()))})
        p = parameters.column("how")[0].as_py()
        ys = own.column("y").to_numpy()
        low = int(ys.min())
        source = _rows(own, low, int(ys.max()))
        across = source.reshape(len(source), -1, channels).transpose(1, 0, 2).reshape(p["width"], -1)
        narrow = _averaged(across, p["to_width"], 0, p["to_width"] - 1, p["width"], 0).reshape(p["to_width"], len(source), channels).transpose(1, 0, 2).reshape(len(source), -1)
        made = _averaged(narrow, p["to_height"], p["first"], p["last"], p["height"], low)
        zero = pa.array(np.zeros(len(made), np.int64))
        return pa.table({**{k: own.column(k).take(zero) for k in keys}, "y": pa.array(np.arange(p["first"], p["last"] + 1)), "line": pa.array(list(made), pa.list_(pa.float64()))})

    return _banded(lines, keys, spread.drop("_end"), make, f"{_kinds(lines, keys)}, y bigint, line array<double>")


def cell_means(lines: DataFrame, keys: list[str], height: int, width: int, planes: Sequence[Sequence[int]], black: Sequence[Sequence[float]] = ((0.0,),)) -> DataFrame:
    """(keys, cy, cells, counts: of each cell in a row the mean of each plane, null without samples, and their number) of cells of height x width samples.

    planes and black are repeating patterns: of each sample its plane, and what is taken off it. Cells at the edges may be smaller.
    A line's sums are vectors, which are added up in a task and then a row of cells."""
    n = max(map(max, planes)) + 1
    pattern, level = np.array(planes), np.array(black, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keys)
        for batch in batches:
            for own, _ in _pictures(batch, k):
                v = _matrix(own.column(k + 1))
                if not v.size:
                    continue
                y, x = own.column(k).to_numpy(zero_copy_only=False), np.arange(v.shape[1])
                v = v - level[np.ix_(y % len(level), x % len(level[0]))]
                plane = pattern[np.ix_(y % len(pattern), x % len(pattern[0]))]
                rows, row = np.unique(y // height, return_inverse=True)
                across = -(-v.shape[1] // width)
                at = ((row[:, None] * across + x // width) * n + plane).ravel()
                sums = np.bincount(at, v.ravel(), len(rows) * across * n).reshape(len(rows), -1)
                counts = np.bincount(at, minlength=len(rows) * across * n).reshape(len(rows), -1)
                zero = pa.array(np.zeros(len(rows), np.int64))
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(zero) for c in range(k)), pa.array(rows), pa.array(list(sums), pa.list_(pa.float64())), pa.array(list(counts), pa.list_(pa.int64()))], [*keys, "cy", "s", "n"])

    parts = lines.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("line").cast("array<double>").alias("line"))
    schema = ", ".join([*([_kinds(lines, keys)] if keys else []), "cy bigint, s array<double>, n array<bigint>"])
    made = parts.mapInArrow(run, schema)
    # A row of cells has as many partial vectors as tasks (and batches) have seen of its few lines.
    added = made.groupBy(*keys, "cy").agg(F.collect_list("s").alias("s"), F.collect_list("n").alias("n"))
    total = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    means = F.zip_with(total("s"), total("n"), lambda s, m: F.when(m > 0, s / m))
    cut = lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / n).cast("int") - 1), lambda i: F.slice(F.col(c), i * n + 1, F.lit(n)))
    return added.select(*keys, "cy", means.alias("_m"), total("n").alias("_n")).select(*keys, "cy", cut("_m").alias("cells"), cut("_n").alias("counts"))
