"""From camera colours to sRGB, as column expressions over small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .levels import clamped

# XYZ of the sRGB primaries under D65, row by row.
XYZ_OF_SRGB = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def inverted(m: Column) -> Column:
    """The inverse of a 3x3 matrix, row by row; null where there is none.

    The columns of the inverse are the cross products of the rows, over their triple product."""
    row = lambda k: [F.get(m, F.lit(3 * k + c)) for c in range(3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    r = [row(k) for k in range(3)]
    columns = [cross(r[1], r[2]), cross(r[2], r[0]), cross(r[0], r[1])]
    volume = sum((r[0][c] * columns[0][c] for c in range(3)), F.lit(0.0))
    return let(volume, lambda v: F.when(F.abs(v) >= 1e-12, F.array(*[columns[c][k] / F.nullif(v, F.lit(0.0)) for k in range(3) for c in range(3)])))


def camera_rows(matrix: Column, planes: int) -> Column:
    """What each plane records of the three primaries, from a matrix of XYZ to the camera's planes (row by row)."""
    primary = lambda c: F.array(*[F.lit(XYZ_OF_SRGB[k][c]) for k in range(3)])
    own = lambda p: F.slice(matrix, 3 * p + 1, 3)
    return F.array(*[F.array(*[dot(own(p), primary(c)) for c in range(3)]) for p in range(planes)])


def colour_transform(matrix: Column, planes: int, shot: Column | None = None) -> Column:
    """struct(rgb, balance): three rows of `planes` numbers that take white-balanced camera values to
    sRGB, and each plane's multiplier.

    Planes are scaled so that white is one in each, then inverted by least squares. Without a
    matrix, or for one plane, planes pass through. shot: the neutral as shot, else daylight's."""
    if planes < 3:
        return F.struct(F.array(*[F.lit(1.0)] * 3).alias("rgb"), F.array(*[F.lit(1.0)] * planes).alias("balance"))
    straight = F.array(*[F.lit(float(c == p)) for c in range(3) for p in range(planes)])
    whole = lambda r: dot(r, F.array(*[F.lit(1.0)] * 3))
    white = lambda r: let(whole(r), lambda s: F.when(F.abs(s) < 1e-9, 1.0).otherwise(s))

    def made(rows: Column) -> Column:
        daylight = F.transform(rows, white)
        scaled = F.transform(rows, lambda r: let(white(r), lambda s: F.transform(r, lambda x: x / s)))

        def solved(a: Column) -> Column:
            product = lambda i, j: F.aggregate(a, F.lit(0.0), lambda t, r: t + F.get(r, F.lit(i)) * F.get(r, F.lit(j)))
            normal = F.array(*[product(i, j) for i in range(3) for j in range(3)])
            rgb = lambda inverse: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.transform(a, lambda r: dot(F.slice(inverse, c * 3 + 1, F.lit(3)), r))))
            return let(inverted(normal), lambda inverse: F.when(inverse.isNull(), straight).otherwise(rgb(inverse)))

        neutral = daylight if shot is None else F.coalesce(shot, daylight)
        balance = let(neutral, lambda n: F.transform(n, lambda x: F.when(x > 1e-6, F.array_max(n) / x).otherwise(1.0)))
        return F.struct(let(scaled, solved).alias("rgb"), balance.alias("balance"))

    given = let(camera_rows(matrix, planes), made)
    return F.when(matrix.isNull(), F.struct(straight.alias("rgb"), F.array(*[F.lit(1.0)] * planes).alias("balance"))).otherwise(given)


def white_balanced(planes: list[Column], balance: list[Column | float], matrix: list[list[Column | float]]) -> list[Column]:
    """Planes times their multipliers, held to 0..1, through a matrix, and held again."""
    held = [clamped(p * b) for p, b in zip(planes, balance)]
    return [clamped(sum((p * m for p, m in zip(held, row)), F.lit(0.0))) for row in matrix]


# sRGB from XYZ under D65, row by row, and the warnings' texts.
SRGB_OF_XYZ = (3.2404542, -1.5371385, -0.4985314, -0.9692660, 1.8760108, 0.0415560, 0.0556434, -0.2040259, 1.0572252)
DERIVED = "no calibrated colour matrix for this camera; derived one from the decoder's built-in camera-to-sRGB matrix"
APPROXIMATE = "no colour matrix available; colours will only be approximate"
DAYLIGHT = "no as-shot white balance in the file; using a daylight default"


def camera_matrix(known: Column, to_srgb: Column, daylight: Column, planes: Column) -> Column:
    """struct(matrix, source, warning): what takes XYZ to a camera's planes, three numbers a plane; null for less than three planes.

    known: the decoder's matrix (twelve numbers), used if any of its first nine isn't 0. Else, for three planes, the decoder's
    matrix of the camera to sRGB (nine numbers) is inverted, and its rows' scales, the daylight multipliers, are undone. Else sRGB's."""
    srgb = F.array(*[F.lit(v) for v in SRGB_OF_XYZ])
    zeros = F.transform(F.sequence(F.lit(0), F.greatest(planes * 3 - 10, F.lit(0))), lambda _: F.lit(0.0))
    own = F.exists(F.slice(known, 1, 9), lambda x: x != 0)

    def derived(inverse: Column) -> Column:
        def row(i: int) -> Column:
            multiplier = F.get(daylight, F.lit(i))
            scale = F.when(multiplier > 0, F.lit(1.0) / F.nullif(multiplier, F.lit(0.0))).otherwise(1.0)
            mixed = [sum((F.get(inverse, F.lit(3 * i + j)) * SRGB_OF_XYZ[3 * j + k] for j in range(3)), F.lit(0.0)) for k in range(3)]
            return F.transform(F.array(*mixed), lambda v: v * scale)

        return F.flatten(F.array(*[row(i) for i in range(3)]))

    def chosen(inverse: Column) -> Column:
        made = lambda m, source, warning: F.struct(m.alias("matrix"), F.lit(source).alias("source"), F.lit(warning).cast("string").alias("warning"))
        last = F.when(planes > 3, F.concat(srgb, zeros)).otherwise(srgb)
        return F.when(planes < 3, None).when(own, made(F.slice(known, F.lit(1), planes * 3), "known", None)).when((planes == 3) & inverse.isNotNull(), made(derived(inverse), "derived", DERIVED)).otherwise(made(last, "srgb", APPROXIMATE))

    return let(inverted(to_srgb), chosen)


def as_shot(camera: Column, daylight: Column, planes: Column) -> Column:
    """struct(neutral, warning): the least multiplier over each, by the camera's multipliers or else daylight's; null where neither can be used."""
    usable = lambda m: (F.size(m) >= planes) & F.forall(F.slice(m, F.lit(1), planes), lambda x: ~F.isnan(x) & (x > 0) & (x < float("inf")))
    of = lambda m, warning: let(F.slice(m, F.lit(1), planes), lambda own: F.struct(F.transform(own, lambda x: F.array_min(own) / x).alias("neutral"), F.lit(warning).cast("string").alias("warning")))
    return F.when(planes < 3, None).when(usable(camera), of(camera, None)).when(usable(daylight), of(daylight, DAYLIGHT))
