"""Numbers to bytes and back, as column expressions: IEEE 754 doubles and floats, whole numbers, and opcode lists made of them.

Bytes are worked on as hexadecimal digits, the highest first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(2**63)


def power_of_two(e: Column) -> Column:
    """2^e for whole e from -1074 to 1023. The power is exact, as what it rounds to is a double itself."""
    return F.pow(F.lit(2.0), e)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), which is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def double_hex(value: Column) -> Column:
    """The 16 digits of a double. Negative zero keeps its sign, and all NaNs are one."""

    def normal(v: Column) -> Column:
        # A logarithm may be off by one at a power of two; the quotient tells.
        near = lambda v: F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(v)).cast("int")))

        def bits(e: Column, q: Column) -> Column:
            off = F.when(q >= 2, 1).when((q < 1) & (e > -1022), -1).otherwise(0)
            share = F.when(q >= 2, q / 2).when((q < 1) & (e > -1022), q * 2).otherwise(q)
            return F.shiftleft((e + off + 1023).cast("bigint"), 52) + ((share - 1) * 2.0**52).cast("bigint")

        return _with(near(v), lambda e: _with(v * power_of_two(-e), lambda q: bits(e, q)))

    def digits(v: Column) -> Column:
        size = F.abs(v)
        bits = F.when(F.isnan(v), F.lit(0x7FF8 << 48)).when(size == float("inf"), F.lit(0x7FF0 << 48)).when(v == 0, F.lit(0)).when(size < 2.0**-1022, (size * 2.0**537 * 2.0**537).cast("bigint")).otherwise(normal(size))
        sign = F.when(v.cast("string").startswith("-"), F.lit(_SIGN)).otherwise(F.lit(0))
        return F.lpad(F.hex(bits.bitwiseOR(sign)), 16, "0")

    return _with(value, digits)


def turned(digits: Column, size: int) -> Column:
    """The digits of up to `size` bytes in the other order."""
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def little(value: Column, size: int) -> Column:
    """The digits of a number of `size` bytes, the lowest first."""
    return turned(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"), size)


def whole(digits: Column, signed: bool = False, size: int = 4) -> Column:
    """The number that up to 15 digits of a hexadecimal text stand for; of `size` bytes, if signed."""
    n = F.conv(digits, 16, 10).cast("bigint")
    return F.when(n >= 1 << (8 * size - 1), n - (1 << (8 * size))).otherwise(n) if signed else n


def _real(digits: Column, exponent_digits: int, exponent_bits: int, fraction_bits: int) -> Column:
    head = whole(F.substring(digits, 1, exponent_digits))
    tail_bits = exponent_digits * 4 - 1 - exponent_bits
    bias = (1 << (exponent_bits - 1)) - 1
    e = F.shiftright(head, tail_bits).bitwiseAND((1 << exponent_bits) - 1).cast("int")
    rest = F.substring(digits, exponent_digits + 1, fraction_bits // 4)
    high = head.bitwiseAND((1 << tail_bits) - 1)
    fraction = high * float(1 << (fraction_bits - tail_bits)) + whole(rest)
    one = float(1 << fraction_bits)
    least = 1 - bias
    small = fraction / one * power_of_two(F.lit(least))
    size = F.when(e == (1 << exponent_bits) - 1, F.when(fraction == 0, F.lit(float("inf"))).otherwise(float("nan"))).when(e == 0, small).otherwise((fraction / one + 1.0) * power_of_two(e - bias))
    return F.when(F.shiftright(head, exponent_digits * 4 - 1) == 1, -size).otherwise(size)


def double_of(digits: Column) -> Column:
    """The double that 16 digits stand for."""
    return _real(digits, 3, 11, 52)


def float_of(digits: Column) -> Column:
    """The float that 8 digits stand for, as a double."""
    return _real(digits, 3, 8, 23)


def word(value: Column | int) -> Column:
    """The 8 digits of an unsigned 32-bit number."""
    return F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("bigint")), 8, "0")


# Numbers of the instructions, the version that brought them, and whether a reader may skip them.
WARP_RECTILINEAR, FIX_VIGNETTE, FIX_BAD_PIXELS, MAP_POLYNOMIAL = 1, 3, 4, 8
SINCE, OPTIONAL, NEEDED = 0x01030000, 1, 0


def instruction(number: int, optional: int, size: Column | int, *parts: Column) -> Column:
    """The digits of one instruction with so many bytes of parameters."""
    return F.concat(word(number), word(SINCE), word(optional), word(size), *parts)


def doubles(values: Column) -> Column:
    """The digits of an array of doubles."""
    return F.array_join(F.transform(values, double_hex), "")


def polynomial_list(coefficients: Column, height: Column, width: Column) -> Column:
    """The second list: what turns stored values of the whole active area into linear ones; null without coefficients."""
    n = F.size(coefficients)
    place = [word(x) for x in (0, 0)] + [word(height), word(width)] + [word(x) for x in (0, 1, 1, 1)]
    return F.unhex(F.concat(word(1), instruction(MAP_POLYNOMIAL, NEEDED, n * 8 + 36, *place, word(n - 1), doubles(coefficients))))


def lens_list(gain: Column, warps: Column, centre_x: Column, centre_y: Column) -> Column:
    """The third list: the gain against vignetting, then the warp of one plane or three (arrays, null where there is none); null without both."""
    centre = F.concat(double_hex(centre_x), double_hex(centre_y))
    vignette = instruction(FIX_VIGNETTE, OPTIONAL, 7 * 8, doubles(gain), centre)
    planes = F.size(warps)
    each = F.array_join(F.transform(warps, lambda k: F.concat(doubles(k), F.lit("0" * 32))), "")
    warp = instruction(WARP_RECTILINEAR, OPTIONAL, planes * 48 + 20, word(planes), each, centre)
    count = F.when(gain.isNotNull(), 1).otherwise(0) + F.when(warps.isNotNull(), 1).otherwise(0)
    return F.when(count > 0, F.unhex(F.concat(word(count), F.coalesce(vignette, F.lit("")), F.coalesce(warp, F.lit("")))))


def named(parts: Sequence[tuple[Column, str]]) -> Column:
    """The names of what is on, with commas."""
    return F.concat_ws(", ", *[F.when(on, name) for on, name in parts])
