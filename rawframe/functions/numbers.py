"""Number rules: axes of stored frames, fields, categories, plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_start(field: Column, size: Column, factor: Column) -> Column:
    """Where an interleaved field begins among `size` stored lines."""
    return field * F.floor(size / factor) + F.least(field, size % factor)


def stored_line(line: Column, size: Column, factor: Column) -> Column:
    """Where line `line` of a frame is stored: fields one after another."""
    return (field_start(line % factor, size, factor) + F.floor(line / factor)).cast("bigint")


def axis_plan(size: Column, factor: Column, most: Column) -> Column:
    """struct(tile, field, padded, pad): fields of equal whole tiles, each a multiple of eight."""
    field = F.ceil(size / factor)
    count = F.ceil(field / most)
    tile = F.ceil(F.ceil(field / count) / 8) * 8
    return F.struct(
        tile.cast("bigint").alias("tile"),
        (tile * count).cast("bigint").alias("field"),
        (tile * count * factor).cast("bigint").alias("padded"),
        F.floor((tile * count * factor - size) / 2).cast("bigint").alias("pad"),
    )


def margin_source(at: Column, size: Column, period: Column) -> Column:
    """The place in the picture that a place in the margin repeats, a whole period at a time."""
    base = size - period
    return F.when(at < 0, F.pmod(at, period)).when(at >= size, base + (at - base) % period).otherwise(at)


def category(difference: Column) -> Column:
    """Bit length of a difference's magnitude; 32768 counts as 16."""
    return F.when(difference == 0, 0).otherwise(F.length(F.bin(F.abs(difference))))


def residual(v: Column, predicted: Column) -> Column:
    """Difference modulo 2^16, in -32767..32768."""
    d = F.pmod(v - predicted, F.lit(65536))
    return F.when(d > 32768, d - 65536).otherwise(d)


def iso_fields(iso: Column) -> Column:
    """struct(short, long): a speed that doesn't fit 16 bits goes to the long field."""
    return F.struct(F.when(iso < 65535, iso).otherwise(65535).alias("short"), F.when(iso >= 65535, iso).alias("long"))


def orientation(flip: Column) -> Column:
    """Orientation tag for a decoder's flip 0..7; 1 for any other."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in (1, 2, 4, 3, 5, 8, 6, 7)]), (F.when(flip >= 0, flip).otherwise(99) + 1).cast("int")), F.lit(1))
