"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a few bits each, in order of their values, the cells are ordered by their
index on a Hilbert curve, and the ordered rows are cut into runs. Rows that are close in all
dimensions share a shard, so each shard's range of cells lets a reader skip whole files for
predicates on any of the dimensions. DataFrame functions only.

Defined results: null metadata is cell 0; a null text has no bytes; repeated rows keep one
slot each, in any order among themselves; a null key is placed like any other; a very long text
counts with all its bytes and isn't moved unless rows are carried; an empty table gives no rows;
other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from .common import read_table, stage_table, text_crc32

SHARDS = 40
BITS = 5
DIMENSIONS = ("lang", "source", "n_chars")
#: Bytes each row is taken to cost beside its text.
ROW_BYTES = 16


def ordered_code(df: DataFrame, name: str) -> Column:
    """A number for each value that keeps their order: the value itself, or six bytes of a text behind
    what all texts of the column begin with."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, NumericType):
        return F.when(~F.isnan(value.cast("double")), value.cast("double"))
    text = value.cast("string")
    least, most = df.agg(F.min(text), F.max(text)).first()
    shared = len(os.path.commonprefix([(least or "").encode(), (most or "").encode()]))
    rest = F.hex(F.substring(text.cast("binary"), shared + 1, 6))
    return F.conv(F.rpad(rest, 12, "0"), 16, 10).cast("double")


def quantised(df: DataFrame, name: str, bits: int) -> Column:
    """Cell of a column by approximate quantiles of all its rows (2^bits - 1 cut points). Cells keep the
    order of the values, so a range of values is a range of cells; a missing value is in cell 0."""
    cells = 1 << bits
    code = ordered_code(df, name)
    shares = [i / cells for i in range(1, cells)]
    cuts = df.agg(F.percentile_approx(code, shares, 10_000).alias("c")).first()["c"] or []
    # A frequent value is several cut points, so that few values spread over the whole range too.
    bounds = F.array(*[F.lit(float(c)) for c in sorted(cuts)]) if cuts else F.array().cast("array<double>")
    below = F.size(F.filter(bounds, lambda c: c < code))
    return F.when(code.isNull(), 0).otherwise(below).cast("int")


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with `bits` bits a coordinate (at most 62 bits in all).

    The exchange-and-invert form of the curve: from the top bit down, a set bit inverts the
    lower bits of the first axis, a clear one exchanges them with it; a Gray code follows.
    """
    n = len(coordinates)
    if n * bits > 62:
        raise ValueError("the index takes at most 62 bits")
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        own = F.get(x, s["i"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        exchanged = F.transform(x, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(s["q"]) != 0, inverted).otherwise(exchanged)

    axes = F.array(*[c.cast("int") for c in coordinates])
    turned = F.aggregate(steps, axes, turn) if bits > 1 else axes
    gray = F.aggregate(
        turned,
        F.array().cast("array<int>"),
        lambda done, v: F.concat(done, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))))),
    )
    tops = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    fix = lambda g: F.aggregate(tops, F.lit(0), lambda t, q: F.when(F.element_at(g, F.lit(n)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    planes = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])

    def interleaved(g: Column) -> Column:
        return F.aggregate(
            planes,
            F.lit(0).cast("bigint"),
            lambda out, b: F.aggregate(g, out, lambda o, v: o * 2 + F.call_function("getbit", v, b).cast("bigint")),
        )

    point = F.transform(F.array(gray), lambda g: F.struct(g.alias("g"), fix(g).alias("t")))
    return F.get(F.transform(point, lambda p: interleaved(F.transform(p["g"], lambda v: v.bitwiseXOR(p["t"])))), F.lit(0))


def hilbert_shard(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS, law: str = "rows", text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """df's key with size, text_crc32, law, hilbert, the cells, rank, shard and slot; with carry the whole row too, as a struct.

    law "rows": shard sizes are at most one row apart. law "bytes": runs are cut where the
    running size passes a shard's part of all bytes, so sizes differ by one row's size at most.

    The global order comes from a range partitioning on (index, checksum, key) whose sorted
    partitions are numbered in place: only one count a partition is summed up on the way, so
    no key, however frequent, meets in one task.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    cells = [quantised(df, d, bits) for d in dimensions]
    body = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(
        F.col(key),
        *([F.struct(*df.columns).alias("row"), F.struct(*dimensions).alias("values")] if carry else []),
        (F.octet_length(body).cast("bigint") + ROW_BYTES).alias("size"),
        text_crc32(F.col(text)).alias("text_crc32"),
        F.array(*cells).alias("cells"),
    )
    order = ["hilbert", "text_crc32", key]
    slim = slim.withColumn("hilbert", hilbert_index([F.col("cells")[i] for i in range(len(cells))], bits))
    ordered = stage_table(
        stage_table(slim, "shard-rows").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "shard-order",
    )
    part = F.shiftright("at", 33)
    if law == "bytes":
        within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        ordered = ordered.withColumn("part", part).withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # One row a partition of the range exchange, whatever the table's size.
    totals = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.sum("n").over(everything).alias("all_rows"),
        F.sum("b").over(everything).alias("all_bytes"),
        F.coalesce(F.sum("n").over(every), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("b").over(every), F.lit(0)).alias("bytes_before"),
    )
    placed = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    placed = placed.withColumn("rank", F.col("rows_before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    if law == "rows":
        shard = F.expr(f"rank * {shards} div all_rows").cast("int")
        first = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
        out = placed.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    else:
        middle = F.expr(f"((bytes_before + before) * 2 + size) * {shards} div (2 * all_bytes)")
        out = placed.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int"))
        firsts = out.groupBy("shard").agg(F.min("rank").alias("first"))
        out = out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    return out.select(key, *(["row", "values"] if carry else []), "size", "text_crc32", F.lit(law).alias("law"), "hilbert", "cells", "rank", "shard", "slot")


def manifest(sharded: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row a shard: rows, bytes, the range of the index, and of each dimension the least and greatest
    cell (null values are in cell 0) and, of a carried table, the range of values and the number of nulls.

    A reader skips a shard whose range of any one dimension excludes its predicate."""
    own = []
    for k, d in enumerate(dimensions):
        own += [F.min(F.col("cells")[k]).alias(f"least_cell_{d}"), F.max(F.col("cells")[k]).alias(f"greatest_cell_{d}")]
        if "values" in sharded.columns:
            value = F.col("values")[d]
            own += [F.min(value).alias(f"least_{d}"), F.max(value).alias(f"greatest_{d}"), F.count_if(value.isNull()).alias(f"nulls_{d}")]
    index = (F.min("hilbert").alias("first_index"), F.max("hilbert").alias("last_index"))
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *index, *own)


def write_shards(df: DataFrame, path: str, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS, law: str = "rows", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write all rows of df under path, a folder a shard, in slot order; the shards' manifest.

    Rows travel with their slots (repeated and missing keys are rows like any other), and are dealt
    by shard and a slice of its slots, so a task writes a part of one shard. A column named shard
    gives way to the folder's."""
    placed = hilbert_shard(df, dimensions, shards, bits, law, text, key, carry=True)
    rows = placed.select(*[F.col("row")[c].alias(c) for c in df.columns if c.lower() != "shard"], "shard", F.col("slot").alias("_slot"))
    rows.repartition("shard", F.expr("_slot div 1000000")).sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
    return manifest(placed, dimensions)


def op1_hilbert_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shard(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
