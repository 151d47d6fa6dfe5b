"""Camera profiles from files: typed fields by a table of rules, soundness with the first reason, canonical digests, libraries.

A profile is a file of one directory. Its fields are cut from the contents in one projection and joined to
the rules; each field is decoded once, and one aggregate a file gives the reason that comes first, the
texts and numbers of the profile, and the digest of its fields in one form whatever the file's byte
order and widths. Files are never looked at twice, and a file's fields meet in one row (500 at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import binary, frames
from ..sources import catalog

# The fields of a profile with their kinds, the version that brought them, and their names.
RULES = [
    (50721, "matrix", 0x0104, "ColorMatrix1"),
    (50722, "matrix", 0x0104, "ColorMatrix2"),
    (50725, "matrix", 0x0104, "ReductionMatrix1"),
    (50726, "matrix", 0x0104, "ReductionMatrix2"),
    (50778, "number16", 0x0104, "CalibrationIlluminant1"),
    (50779, "number16", 0x0104, "CalibrationIlluminant2"),
    (50932, "text", 0x0104, "ProfileCalibrationSignature"),
    (50936, "text", 0x0104, "ProfileName"),
    (50937, "dims", 0x0104, "ProfileHueSatMapDims"),
    (50938, "floats", 0x0104, "ProfileHueSatMapData1"),
    (50939, "floats", 0x0104, "ProfileHueSatMapData2"),
    (50940, "floats", 0x0104, "ProfileToneCurve"),
    (50941, "number32", 0x0104, "ProfileEmbedPolicy"),
    (50942, "text", 0x0104, "ProfileCopyright"),
    (50964, "matrix", 0x0104, "ForwardMatrix1"),
    (50965, "matrix", 0x0104, "ForwardMatrix2"),
    (50981, "dims", 0x0104, "ProfileLookTableDims"),
    (50982, "floats", 0x0104, "ProfileLookTableData"),
    (51107, "number32", 0x0104, "ProfileHueSatMapEncoding"),
    (51108, "number32", 0x0104, "ProfileLookTableEncoding"),
    (51109, "exposure", 0x0104, "BaselineExposureOffset"),
    (51110, "number32", 0x0104, "DefaultBlackRender"),
    (52529, "number16", 0x0106, "CalibrationIlluminant3"),
    (52531, "matrix", 0x0106, "ColorMatrix3"),
    (52532, "matrix", 0x0106, "ForwardMatrix3"),
    (52533, "opaque", 0x0106, "IlluminantData1"),
    (52534, "opaque", 0x0106, "IlluminantData2"),
    (52535, "opaque", 0x0106, "IlluminantData3"),
    (52537, "floats", 0x0106, "ProfileHueSatMapData3"),
    (52538, "matrix", 0x0106, "ReductionMatrix3"),
    (52539, "opaque", 0x0107, "RGBTables"),
    (52544, "opaque", 0x0107, "ProfileGainTableMap2"),
    (52551, "opaque", 0x0107, "ProfileDynamicRange"),
    (52552, "text", 0x0107, "ProfileGroupName"),
    (50708, "camera", 0, "UniqueCameraModel"),
]
# The types each kind may have (byte 1, text 2, short 3, long 4, rational 5, undefined 7, signed rational 10, float 11).
TYPES = {"text": (1, 2), "camera": (1, 2), "matrix": (10,), "number16": (3, 4), "number32": (3, 4), "dims": (3, 4), "floats": (11,), "exposure": (5, 10), "opaque": (1, 7)}
# How many values a kind has, where that is given, and the bytes of a value of each type.
COUNTS = {"number16": 1, "number32": 1, "dims": 3, "exposure": 1}
BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
# The magic number, and limits of what is read.
MAGIC, MOST_BYTES, MOST_FIELDS = 0x4352, 64 << 20, 500
LEAST_DETERMINANT, MOST_SIDE = 1e-9, 4096
CAMERA = 50708
LIGHTS = (50778, 50779, 52529)


def _number(digits: Column, big: Column) -> Column:
    """A number of two or four bytes in a file's order, from its digits."""
    turned = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")
    return binary.whole(F.when(big, digits).otherwise(turned))


def fields(files: DataFrame) -> DataFrame:
    """(path, ord, tag, type, count, value, big, reason) of files (path, content): a row a field, and one row without a tag where there is no directory."""
    c, at = F.col, lambda place, n: F.hex(F.substring("content", place, n))
    size = F.octet_length("content")
    head = files.select("path", "content", at(F.lit(1), F.lit(8)).alias("_h")).withColumn("big", F.substring("_h", 1, 4) == "4D4D")
    head = head.withColumns({"_magic": _number(F.substring("_h", 5, 4), c("big")), "_ifd": _number(F.substring("_h", 9, 8), c("big"))})
    head = head.withColumn("_n", F.when(c("_ifd") + 2 <= size, _number(at((c("_ifd") + 1).cast("int"), F.lit(2)), c("big"))))
    # The reasons' texts.
    reason = (
        F.when(size > MOST_BYTES, "too large to be a camera profile")
        .when(size < 8, "not a camera profile (too short)")
        .when(~F.substring("_h", 1, 4).isin("4949", "4D4D"), "not a camera profile")
        .when(c("_magic") == 42, "a TIFF or DNG file, not a camera profile (.dcp)")
        .when(c("_magic") != MAGIC, "not a camera profile")
        .when(c("_ifd") < 8, "the profile's directory is misplaced")
        .when(c("_n").isNull(), "the profile is cut short")
        .when(~c("_n").between(1, MOST_FIELDS), "the profile's directory is damaged")
    )
    units = F.create_map(*[F.lit(v) for pair in BYTES.items() for v in pair])

    # Each step of a field is a column, worked out once; a file without a directory has one row, number -1.
    ords = F.when(c("_reason").isNull(), F.sequence(F.lit(0), c("_n").cast("int") - 1)).otherwise(F.array(F.lit(-1)))
    own = head.withColumn("_reason", reason).select("path", "content", "big", "_ifd", "_reason", size.cast("bigint").alias("_size"), F.explode(ords).alias("ord"))
    own = own.withColumn("_start", F.when(c("ord") >= 0, c("_ifd") + 2 + c("ord") * 12))
    own = own.withColumn("_e", at((c("_start") + 1).cast("int"), F.lit(12)))
    own = own.withColumns({"type": _number(F.substring("_e", 5, 4), c("big")).cast("int"), "count": _number(F.substring("_e", 9, 8), c("big"))})
    own = own.withColumn("bytes", F.try_element_at(units, c("type")) * c("count"))
    own = own.withColumn("_where", F.when(c("bytes") > 4, _number(F.substring("_e", 17, 8), c("big"))).otherwise(c("_start") + 8))
    inside = (c("bytes") > 0) & (c("bytes") <= MOST_BYTES) & (c("_where") <= c("_size")) & (c("bytes") <= c("_size") - c("_where"))
    whole = c("_start") + 12 <= c("_size")
    value = F.when(inside, F.substring("content", (c("_where") + 1).cast("int"), c("bytes").cast("int")))
    tag = F.when(whole, _number(F.substring("_e", 1, 4), c("big"))).cast("int")
    return own.select("path", "ord", tag.alias("tag"), "type", "count", "bytes", value.alias("value"), F.when(c("ord") < 0, c("_reason")).when(~whole, "the profile is cut short").alias("reason"), "big")


def typed(own: DataFrame) -> DataFrame:
    """fields (those that a profile knows) with rule, name, version, data (low bytes first, numbers as wide as the rules say), stored (the
    type that goes with it), numbers, reals, and reason: what is wrong with the field."""
    c = F.col
    rules = own.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(RULES)], "tag int, rule string, version int, name string, place int")
    # Some dozen rules: a fixed table.
    met = own.join(F.broadcast(rules), "tag", "left").where(c("rule").isNotNull() | c("reason").isNotNull() | c("tag").isNull())
    element = F.when(c("type").isin(3, 8), 2).when(c("type").isin(4, 5, 9, 10, 11, 13), 4).when(c("type") == 12, 8).otherwise(1)
    low = met.withColumn("_low", F.when(c("big") & (element > 1), frames.swapped(c("value"), element)).otherwise(c("value"))).withColumn("_hex", F.hex("_low"))
    words = lambda n: F.transform(F.regexp_extract_all("_hex", F.lit(f"([0-9A-F]{{{2 * n}}})"), F.lit(1)), lambda d: _number(d, F.lit(False)))
    numbers = F.when(c("rule").isin("number16", "number32", "dims"), F.when(c("type") == 3, words(2)).when(c("type") == 4, words(4)))
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)
    pairs = lambda v: F.transform(F.sequence(F.lit(0), (F.size(v) / 2).cast("int") - 1), lambda i: signed(F.get(v, i * 2)) / F.nullif(signed(F.get(v, i * 2 + 1)), F.lit(0)).cast("double"))
    decoded = low.withColumns({"numbers": numbers, "_words": F.when(c("rule") == "matrix", words(4)), "_odd": F.when(c("rule") == "floats", F.exists(words(4), lambda w: w.bitwiseAND(0x7F800000) == 0x7F800000))})
    decoded = decoded.withColumn("reals", F.when(F.size("_words") >= 2, pairs(c("_words"))))
    good_type, good_count = F.lit(False), F.lit(True)
    for kind, types in TYPES.items():
        good_type = good_type | ((c("rule") == kind) & c("type").isin(*types))
    for kind, n in COUNTS.items():
        good_count = good_count & ((c("rule") != kind) | (c("count") == n))
    # The reasons' texts.
    named = lambda what: F.concat("name", F.lit(f" {what}"))
    reason = (
        F.when(c("reason").isNotNull(), c("reason"))
        .when(F.coalesce(c("bytes"), F.lit(0)) == 0, named("is empty or of an unknown type"))
        .when(c("bytes") > MOST_BYTES, named("is implausibly large"))
        .when(c("value").isNull(), named("lies outside the file"))
        .when(~good_type | ~good_count, named("has the wrong type"))
        .when((c("rule") == "number16") & (F.get("numbers", F.lit(0)) > 65535), named("has the wrong type"))
        .when(c("_odd"), named("holds values that are not numbers"))
    )
    first = Window.partitionBy("path", "tag").orderBy("ord")
    twice = (c("rule") != "camera") & (F.row_number().over(first) > 1)
    judged = decoded.withColumn("_wrong", reason).withColumn("reason", F.coalesce("_wrong", F.when(twice, named("occurs twice"))))
    number = F.get("numbers", F.lit(0))
    wide = F.unhex(F.array_join(F.transform("numbers", lambda v: binary.little(v, 4)), ""))
    data = F.when(c("rule") == "number16", F.unhex(binary.little(number, 2))).when(c("rule").isin("number32", "dims"), wide).otherwise(c("_low"))
    stored = F.when(c("rule") == "number16", 3).when(c("rule").isin("number32", "dims"), 4).otherwise(c("type"))
    return judged.select("path", "ord", "tag", "rule", "place", "name", "version", "count", "numbers", "reals", data.alias("data"), stored.alias("stored"), "reason")


def text_of(data: Column) -> Column:
    """A text up to its first NUL, without blanks at its end."""
    return F.rtrim(F.regexp_extract(F.decode(data, "UTF-8"), r"(?s)^([^\x00]*)", 1))


def profiles(files: DataFrame) -> DataFrame:
    """(path, file_name, profile, camera, copyright, group_name, policy, profile_planes, illuminants, lights, forward, hue_dims, look_dims,
    tone_curve, version, digest, label, summary, reason): a row a file (path, content); of one that isn't sound only the reason counts."""
    own = typed(fields(files))
    c = F.col
    of = lambda tag, what: F.max(F.when(c("tag") == tag, c(what)))
    has = lambda tag: F.coalesce(F.max(c("tag") == tag), F.lit(False))
    low = lambda v, n: F.unhex(binary.little(v, n))
    part = F.when((c("rule") != "camera") & c("reason").isNull(), F.concat(low(c("tag"), 2), low(c("stored"), 2), low(c("count"), 4), "data"))
    matrix = c("rule") == "matrix"
    planes = F.floor(c("_m1") / 3)
    raw = own.withColumn("part", part).groupBy("path").agg(
        F.min_by("reason", F.when(c("reason").isNotNull(), c("ord"))).alias("_first"),
        *[of(tag, "data").alias(name) for tag, name in ((50936, "_name"), (50942, "_copyright"), (52552, "_group"))],
        F.max_by("data", F.when(c("tag") == CAMERA, c("ord"))).alias("_camera"),
        F.coalesce(F.get(of(50941, "numbers"), F.lit(0)), F.lit(0)).alias("policy"),
        of(50721, "count").alias("_m1"),
        of(50721, "reals").alias("_r1"),
        # Matrices in the order of the rules: their sizes, and whether a value is divided by zero.
        F.array_sort(F.collect_list(F.when(matrix, F.struct("place", "name", "count", F.exists("reals", lambda v: v.isNull()).alias("odd"))))).alias("_matrices"),
        has(50722).alias("_second"),
        has(52531).alias("_third"),
        has(50964).alias("forward"),
        F.array_compact(F.array(*[F.get(of(t, "numbers"), F.lit(0)) for t in LIGHTS])).alias("lights"),
        of(50937, "numbers").alias("hue_dims"),
        F.array_compact(F.array(*[of(t, "count") for t in (50938, 50939, 52537)])).alias("_hue"),
        of(50981, "numbers").alias("look_dims"),
        F.array_compact(F.array(of(50982, "count"))).alias("_look"),
        of(50940, "count").alias("_curve"),
        F.max("version").alias("version"),
        F.md5(F.expr("listagg(part, X'') within group (order by tag)")).alias("digest"),
    )
    m = [F.get("_r1", F.lit(i)) for i in range(9)]
    determinant = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])

    def table(dims: str, counts: str, what: str) -> Column:
        d = [F.get(dims, F.lit(i)) for i in range(3)]
        there = F.size(counts) > 0
        possible = (d[0] >= 1) & (d[1] >= 2) & (d[2] >= 1) & (F.greatest(*d) <= MOST_SIDE)
        fits = F.forall(counts, lambda n: n == d[0] * d[1] * d[2] * 3)
        return F.when(there & c(dims).isNull(), f"the {what} has no dimensions").when(there & ~possible, f"the {what} has impossible dimensions").when(there & ~fits, f"the {what} does not have the size its dimensions give")

    # The reasons' texts.
    bad = F.get(F.filter("_matrices", lambda x: (x["count"] != planes * 3) | x["odd"]), F.lit(0))
    of_bad = F.when(bad["count"] != planes * 3, F.concat(bad["name"], F.lit(" does not fit a camera with "), planes.cast("string"), F.lit(" colours"))).when(bad["odd"], F.concat(bad["name"], F.lit(" holds a division by zero")))
    reason = (
        F.when(c("_first").isNotNull(), c("_first"))
        .when(c("_m1").isNull(), "the profile has no colour matrix")
        .when(~c("_m1").isin(9, 12), "ColorMatrix1 is not a matrix for three or four colours")
        .when(of_bad.isNotNull(), of_bad)
        .when((planes == 3) & ~F.coalesce(F.abs(determinant) > LEAST_DETERMINANT, F.lit(False)), "ColorMatrix1 cannot be inverted")
        .when(c("_third") & ~c("_second"), "the profile has a third colour matrix but no second")
        .otherwise(F.coalesce(table("hue_dims", "_hue", "hue and saturation table"), table("look_dims", "_look", "look table"), F.when((c("_curve") < 4) | (c("_curve") % 2 != 0), "the tone curve is not a list of points")))
    )
    number = F.when(c("_third"), 3).when(c("_second"), 2).otherwise(1)
    out = raw.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        *[F.coalesce(text_of(c(f"_{n}")), F.lit("")).alias(a) for n, a in (("name", "profile"), ("camera", "camera"), ("copyright", "copyright"), ("group", "group_name"))],
        "policy",
        planes.alias("profile_planes"),
        number.alias("illuminants"),
        "lights",
        "forward",
        F.when(F.size("_hue") > 0, c("hue_dims")).alias("hue_dims"),
        F.when(F.size("_look") > 0, c("look_dims")).alias("look_dims"),
        c("_curve").isNotNull().alias("tone_curve"),
        "version",
        "digest",
        reason.alias("reason"),
    )
    # The summary counts illuminants by matrices, and names the lights that are there.
    summary = frames.profile_summary(c("lights"), c("forward"), c("hue_dims"), c("look_dims"), c("tone_curve"), number=c("illuminants"))
    return out.withColumns({"label": frames.profile_label(c("profile"), c("file_name")), "summary": summary})


def library(found: DataFrame) -> DataFrame:
    """The sound ones of profiles in order of their paths, each once: the same fields for the same camera are the same profile."""
    return found.where("reason IS NULL").groupBy("digest", "camera").agg(F.min_by(F.struct(*[x for x in found.columns if x not in ("digest", "camera")]), "path").alias("_p")).select("digest", "camera", "_p.*").select(*found.columns)


def scan(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(library, skipped) of folders, which are searched for profiles, and of files by name. skipped: (path, reason) of a folder's files that
    aren't sound; a named one, or one that isn't there, is an error."""
    files, missing = catalog.jobs(spark, paths, True, catalog.PROFILE_EXTENSIONS)
    if (gone := missing.first()) is not None:
        raise FileNotFoundError(f"'{gone['path']}': {gone['reason']}")
    found = profiles(files.select("path", "content"))
    named = [r["path"] for r in files.where("named").select("path").collect()]
    if named and (bad := found.where(F.col("path").isin(named) & F.col("reason").isNotNull()).select("path", "reason").first()) is not None:
        raise ValueError(f"'{bad['path']}': {bad['reason']}")
    return library(found), found.where("reason IS NOT NULL").select("path", F.concat(F.lit("'"), "path", F.lit("': "), "reason").alias("reason"))
