"""Relations on directory entries: numbers, metadata rules, raw images, chunk tables.

Entries are rows (path, ifd, kind, tag, type, count, value, big_endian), as `catalog.ifd_entries`
reads them. All rules are grouped aggregates and joins by path: no file is looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames, rules
from ..functions.text import RECORD_PREFIX, parsed_record

# Numbers of tags.
NEW_SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES = 254, 256, 257, 258, 259, 277
STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_BYTES = 273, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
DNG_VERSION, CAMERA_MODEL, OLD_DIGEST, NEW_DIGEST, ORIGINAL_DIGEST = 50706, 50708, 50972, 51111, 50973
SOURCE_RECORD, ORIGINAL_NAME, ORIGINAL_DATA = 65300, 50827, 50828
# Limits of what is read.
MOST_PIXELS, MOST_CHUNKS, MOST_RECORD = 600_000_000, 1 << 20, 256


def numbers_of(value: Column, kind: Column, big_endian: Column) -> Column:
    """The numbers of a SHORT or LONG value; null for other types."""
    size = F.when(kind == 3, 2).when(kind.isin(4, 13), 4)
    data = F.when(big_endian, value).otherwise(frames.swapped(value, size))
    places = F.sequence(F.lit(0).cast("bigint"), F.floor(F.octet_length(value) / size) - 1)
    digits = lambda k: F.substring(F.hex(data), (k * size * 2 + 1).cast("int"), (size * 2).cast("int"))
    return F.when(size.isNotNull() & (F.octet_length(value) >= size), F.transform(places, lambda k: F.conv(digits(k), 16, 10).cast("bigint")))


def text_of(value: Column) -> Column:
    """A text up to its first NUL, without blanks at the ends."""
    return F.trim(F.regexp_extract(F.decode(value, "ISO-8859-1"), r"(?s)^([^\x00]*)", 1))


def with_numbers(entries: DataFrame) -> DataFrame:
    """entries with `numbers` and `number`, the first of them."""
    own = entries.withColumn("numbers", numbers_of(F.col("value"), F.col("type"), F.col("big_endian")))
    return own.withColumn("number", F.get("numbers", F.lit(0)))


def kept_metadata(entries: DataFrame) -> DataFrame:
    """The entries that go with a picture: EXIF less some tags, descriptive ones of the first
    directory, and GPS directories that hold more than their version."""
    tag, kind = F.col("tag"), F.col("kind")
    placed = entries.where((kind == "gps") & (tag != 0)).select("path", "ifd").distinct().withColumn("_placed", F.lit(True))
    met = entries.join(placed, ["path", "ifd"], "left")
    keep = ((kind == "exif") & rules.kept_exif(tag)) | ((kind == "main") & (F.col("ifd") == 0) & rules.kept_descriptive(tag)) | ((kind == "gps") & F.col("_placed"))
    return met.where(F.coalesce(keep, F.lit(False))).select(entries.columns)


def sorted_tags(entries: DataFrame) -> DataFrame:
    """(path, ifd, tags, refused): a directory's tags in order; one that has a tag twice is refused."""
    tags = F.array_sort(F.collect_list("tag"))
    return entries.groupBy("path", "ifd").agg(tags.alias("tags"), (F.count("tag") > F.count_distinct("tag")).alias("refused"))


def raw_directories(entries: DataFrame) -> DataFrame:
    """(path, is_dng, raw_ifd, has_mask) from entries with `number`: the first directory of the full-resolution kind that has a width."""
    own = entries.where(F.col("kind").isin("main", "sub"))
    value = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("number")))
    by_ifd = own.groupBy("path", "ifd").agg(value(NEW_SUBFILE).alias("subfile"), F.max(F.col("tag") == WIDTH).alias("sized"), F.max(F.col("tag") == DNG_VERSION).alias("versioned"))
    return by_ifd.groupBy("path").agg(
        F.max((F.col("ifd") == 0) & F.col("versioned")).alias("is_dng"),
        F.min(F.when((F.col("subfile") == 0) & F.col("sized"), F.col("ifd"))).alias("raw_ifd"),
        F.coalesce(F.max(F.col("subfile") == 4), F.lit(False)).alias("has_mask"),
    )


def stored_digests(entries: DataFrame) -> DataFrame:
    """(path, new_digest, old_digest, original_digest) of the first directories: 16 bytes of type 1 or 7, or null."""
    return entries.where("ifd = 0").groupBy("path").agg(*digest_values())


def source_records(entries: DataFrame, prefix: str = RECORD_PREFIX) -> DataFrame:
    """(path, present, size, digest, sidecar): the record of a file's source in its first directory; a text of at most 256 bytes."""
    own = (F.col("tag") == SOURCE_RECORD) & (F.col("type") == 2) & (F.col("count") <= MOST_RECORD)
    found = entries.where("ifd = 0").groupBy("path").agg(F.max(F.when(own, F.decode("value", "ISO-8859-1"))).alias("_t"))
    return found.select("path", parsed_record(F.coalesce("_t", F.lit("")), prefix).alias("r")).select("path", "r.*")


def originals(entries: DataFrame) -> DataFrame:
    """(path, name, size, packed, verdict) of embedded originals: the size they unpack to, their packed
    bytes, and whether these match the stored digest (absent, intact, damaged or unverified)."""
    own = entries.where("ifd = 0").groupBy("path").agg(
        F.max(F.when(F.col("tag") == ORIGINAL_NAME, text_of(F.col("value")))).alias("name"),
        F.max(F.when(F.col("tag") == ORIGINAL_DATA, F.col("value"))).alias("packed"),
        *digest_values(),
    )
    size = F.conv(F.hex(F.substring("packed", 1, 4)), 16, 10).cast("bigint")
    verdict = F.when(F.col("packed").isNull(), "absent").when(F.col("original_digest").isNull(), "unverified").when(F.md5("packed") == F.col("original_digest"), "intact").otherwise("damaged")
    return own.select("path", "name", F.when(F.octet_length("packed") >= 4, size).alias("size"), "packed", verdict.alias("verdict"))


def digest_values() -> list[Column]:
    """The aggregates of stored_digests."""
    good = (F.col("count") == 16) & F.col("type").isin(1, 7) & (F.octet_length("value") == 16)
    value = lambda tag: F.max(F.when((F.col("tag") == tag) & good, F.lower(F.hex("value"))))
    return [value(NEW_DIGEST).alias("new_digest"), value(OLD_DIGEST).alias("old_digest"), value(ORIGINAL_DIGEST).alias("original_digest")]


def layouts(entries: DataFrame, *more: Column) -> DataFrame:
    """(path, ifd, width, height, planes, bits, chunk_width, chunk_rows, across, down, offsets, counts, reason) of directories with an image, from entries with `numbers`.

    With more, which are aggregates of a directory, all directories come, and these too."""
    first = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("number")))
    every = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("numbers")))
    names = {"width": WIDTH, "height": HEIGHT, "planes": SAMPLES, "bits": BITS, "rows": ROWS_PER_STRIP, "tile_w": TILE_WIDTH, "tile_h": TILE_HEIGHT}
    tables = {"tile_at": TILE_OFFSETS, "tile_bytes": TILE_BYTES, "strip_at": STRIP_OFFSETS, "strip_bytes": STRIP_BYTES}
    found = entries.groupBy("path", "ifd").agg(*[first(t).alias(n) for n, t in names.items()], *[every(t).alias(n) for n, t in tables.items()], F.max(F.col("tag") == TILE_OFFSETS).alias("tiled"), *more)
    c = F.col
    others = [x for x in found.columns if x not in ("path", "ifd", "tiled", *names, *tables)]
    found = found.where(F.lit(bool(more)) | c("width").isNotNull() | c("height").isNotNull()).select(
        *others,
        "path",
        "ifd",
        "width",
        "height",
        F.coalesce("planes", F.lit(1)).alias("planes"),
        F.coalesce("bits", F.lit(1)).alias("bits"),
        F.when(c("tiled"), c("tile_w")).otherwise(c("width")).alias("chunk_width"),
        F.when(c("tiled"), c("tile_h")).otherwise(F.least(F.coalesce("rows", "height"), c("height"))).alias("chunk_rows"),
        F.when(c("tiled"), c("tile_at")).otherwise(c("strip_at")).alias("offsets"),
        F.when(c("tiled"), c("tile_bytes")).otherwise(c("strip_bytes")).alias("counts"),
    )
    parts = lambda size, part: F.ceil(c(size) / F.nullif(c(part), F.lit(0))).cast("bigint")
    found = found.withColumn("across", parts("width", "chunk_width")).withColumn("down", parts("height", "chunk_rows"))
    need = c("across") * c("down")
    # The reasons' texts.
    reason = (
        F.when(F.coalesce(c("width") <= 0, F.lit(True)) | F.coalesce(c("height") <= 0, F.lit(True)), "the raw image has no size")
        .when(~c("planes").between(1, 8), "the raw image has an impossible number of colour planes")
        .when(c("width") * c("height") * c("planes") > MOST_PIXELS, "the image is too large to check")
        .when(need.isNull(), "the tile size of the raw image is missing")
        .when(c("offsets").isNull() | c("counts").isNull() | (F.size("offsets") > MOST_CHUNKS), "the table of the raw image cannot be read")
        .when((F.size("offsets") < need) | (F.size("counts") < need), "the raw image lists fewer strips or tiles than it needs")
    )
    return found.withColumn("reason", reason)


def chunks(found: DataFrame) -> DataFrame:
    """(path, ifd, chunk, x, y, width, rows, offset, bytes): a row a strip or tile of sound layouts; the last strip may be short."""
    each = F.posexplode(F.arrays_zip(F.col("offsets").alias("offset"), F.col("counts").alias("bytes")))
    own = found.where("reason is null").select("path", "ifd", F.col("width").alias("_w"), "height", "chunk_width", "chunk_rows", "across", "down", each.alias("chunk", "_c")).where("chunk < across * down")
    x, y = (F.col("chunk") % F.col("across")) * F.col("chunk_width"), F.floor(F.col("chunk") / F.col("across")) * F.col("chunk_rows")
    return own.select("path", "ifd", "chunk", x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.col("chunk_width").alias("width"), F.least("chunk_rows", F.col("height") - y).cast("bigint").alias("rows"), F.col("_c.offset").alias("offset"), F.col("_c.bytes").alias("bytes"))
