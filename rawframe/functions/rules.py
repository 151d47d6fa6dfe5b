"""Rules on tags, lens tables, checks and outputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# EXIF tags that aren't copied, and the descriptive tags that are.
EXIF_LEFT_OUT = (37500, 40965, 59932, 59933, 41730, 34856, 37388, 41484, 41995)
DESCRIPTIVE = (270, 315, 33432, 700)
# What lens curves may plausibly hold.
DISTORTION_RANGE, CA_RANGE, VIGNETTING_RANGE = (0.5, 1.5), (-0.02, 0.02), (0.5, 16.0)


def kept_exif(tag: Column) -> Column:
    return ~tag.isin(*EXIF_LEFT_OUT)


def kept_descriptive(tag: Column) -> Column:
    return tag.isin(*DESCRIPTIVE)


def lens_specification(numerator: Column, denominator: Column) -> Column:
    """0/1 stands for an unknown value, which is written 0/0."""
    return F.struct(numerator.alias("num"), F.when((numerator == 0) & (denominator == 1), 0).otherwise(denominator).alias("den"))


def correction_wanted(mode: Column, enabled: Column, in_data: Column) -> Column:
    """mode: all, camera (as set there) or none."""
    return ((mode == "all") | ((mode == "camera") & enabled)) & ~in_data


def sane_curve(radius: Column, value: Column, low: float, high: float) -> Column:
    """No knots, or at least two: finite, in range, at ascending radii from 0 on."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.forall(value, lambda v: finite(v) & v.between(low, high)) & F.forall(radius, lambda r: finite(r) & (r >= 0))
    steps = F.zip_with(F.slice(radius, F.lit(2), F.size(radius)), F.slice(radius, F.lit(1), F.greatest(F.size(radius) - 1, F.lit(0))), lambda b, a: b > a)
    return (F.size(radius) == F.size(value)) & ((F.size(radius) == 0) | ((F.size(radius) >= 2) & good & F.forall(steps, lambda s: s)))


def knot_radius(i: Column, n: Column) -> Column:
    return (i + 0.5) / (n - 1)


def step_distortion(v: Column) -> Column:
    """Steps of 2^-14 around 1."""
    return v * 2.0**-14 + 1.0


def step_aberration(v: Column) -> Column:
    return v * 2.0**-21


def step_vignetting(v: Column) -> Column:
    return F.pow(F.lit(2.0), F.pow(F.lit(2.0), v / 8192.0 - 1.0) - 0.5)


def word_checksum(values: Column) -> Column:
    """Of an array of bytes: each step takes 73 times the sum so far."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, b: (s * 73 + b) % 65519)


def sixteen_words(data: Column) -> Column:
    """struct(sound, on) of a tag of 32 bytes (an array of numbers): sixteen words, low bytes first, of which the first two and
    the last two are checksums over the others: over the halves of what is between them, and over the low and the high bytes."""
    word = lambda i: F.get(data, F.lit(2 * i)) + F.get(data, F.lit(2 * i + 1)) * 256
    part = lambda start, n, step: word_checksum(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(data, k * step + start)))
    # Which bytes each checksum covers, and the word (its low four bits 1) that says that the correction is on.
    sums = [(1, part(4, 12, 1)), (14, part(16, 12, 1)), (0, part(2, 14, 2)), (15, part(3, 14, 2))]
    sound = F.size(data) == 32
    for i, s in sums:
        sound = sound & (word(i) == s)
    sound = F.coalesce(sound, F.lit(False))
    return F.struct(sound.alias("sound"), (sound & (word(7).bitwiseAND(15) == 1)).alias("on"))


def bayer_phase(pattern: Column, top: Column, left: Column) -> Column:
    """0..3 by where red lies in a 2x2 pattern (colours 0 red, 1 green, 2 blue) at the frame's origin; -1 for others."""
    at = lambda r, c: F.element_at(pattern, (F.pmod(top + r, F.lit(2)) * 2 + F.pmod(left + c, F.lit(2)) + 1).cast("int"))
    seen = F.concat_ws("", at(0, 0), at(0, 1), at(1, 0), at(1, 1))
    return F.when(seen == "0112", 0).when(seen == "1021", 1).when(seen == "1201", 2).when(seen == "2110", 3).otherwise(-1)


def file_versions(jxl: Column, profile_version: Column, opcodes: Column, columns_apart: Column) -> Column:
    """struct(stored, oldest): versions as four numbers with dots."""
    base = F.greatest(F.when(jxl, 0x0107).otherwise(0x0104), F.coalesce(profile_version, F.lit(0)))
    stored = F.concat_ws(".", F.shiftright(base, 8), base.bitwiseAND(255), F.when(jxl, 1).otherwise(0), F.lit(0))
    oldest = F.when(jxl, F.concat(F.lit("1.7."), F.when(columns_apart, 1).otherwise(0), F.lit(".0"))).when(opcodes, "1.3.0.0").otherwise("1.1.0.0")
    return F.struct(stored.alias("stored"), oldest.alias("oldest"))


def quality_table(base: Column, quality: Column) -> Column:
    """A quantisation table scaled for a quality of 1..100."""
    q = F.greatest(F.lit(1), F.least(F.lit(100), quality))
    scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - q * 2)
    return F.transform(base, lambda b: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((b * scale + 50) / 100))).cast("int"))


def raw_state(compressed: Column, has_new: Column, has_old: Column, new_ok: Column, old_ok: Column, mask: Column) -> Column:
    """intact, damaged or unverified: by the digests a file has. A mask rules out the newer digest,
    and for compressed data any."""
    any_digest = has_new | has_old
    ok_compressed = F.when(has_new, new_ok).otherwise(old_ok)
    ok_plain = (~has_new | new_ok) & (~has_old | old_ok)
    masked = mask & F.when(compressed, any_digest).otherwise(has_new)
    return F.when(~any_digest | masked, "unverified").when(F.when(compressed, ok_compressed).otherwise(ok_plain), "intact").otherwise("damaged")


def can_add(raw: Column, original: Column, truncated: Column, has_new: Column, has_old: Column, mask: Column) -> Column:
    """A checksum may be added to a file that nothing speaks against and that lacks one."""
    damaged = truncated | (raw == "damaged") | (original == "damaged")
    return ~damaged & ((~has_new & ~has_old & ~mask) | (original == "unverified"))


def verdict(raw: Column, original: Column, truncated: Column) -> Column:
    """The outcome of a check: damaged, intact or unverified."""
    known = raw.isin("intact") & original.isin("intact", "absent")
    return F.when(truncated | (raw == "damaged") | (original == "damaged"), "damaged").when(known, "intact").otherwise("unverified")


def output_path(path: Column, relative: Column, root: Column, single: Column, extension: str = ".dng") -> Column:
    """The target itself, or the file below the root, or next to its source, with its extension replaced."""
    replaced = lambda p: F.concat(F.regexp_replace(p, r"(?<=[^/])\.[^./]*$", ""), F.lit(extension))
    return F.when(single, root).when(root != "", F.concat_ws("/", F.regexp_replace(root, "/+$", ""), replaced(relative))).otherwise(replaced(path))


def target_policy(is_source: Column, exists: Column, force: Column, state: Column) -> Column:
    """write, or why not: never onto the source; an existing target only by force or as an update says."""
    return (
        F.when(is_source, "refused: same file")
        .when(~exists | force, "write")
        .when(state == "up to date", "skipped: up to date")
        .when(state == "no record", "left alone: no record")
        .when(state.isin("changed", "stale"), "write")
        .otherwise("refused: exists")
    )


def unique_id(digest: Column, model: Column, geometry: list[Column], opcodes: Column) -> Column:
    """MD5 of the image's digest, the model, six little-endian numbers and the opcodes."""
    def little(v: Column) -> Column:
        h = F.lpad(F.hex(v.cast("bigint")), 8, "0")
        return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])

    return F.md5(F.unhex(F.concat(digest, F.hex(F.encode(model, "UTF-8")), *[little(v) for v in geometry], F.hex(opcodes))))
