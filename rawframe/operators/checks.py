"""The check of whole files: is all of a file there, is its raw image what its stored checksums say, and the original in it?

Directories are read once into entries; two aggregates (a directory, then a file) make a row a file of all that the
entries say. That row meets the contents once: a file's strips or tiles are unpacked, put in their places, regrouped
if they are stored field by field, and digested in both ways in one go. Rules on columns give the
verdict. A file's contents are one row of the source already, so they are never exchanged in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames, rules
from ..sources import catalog
from . import directories

# Numbers of tags, and what they say where they are missing.
FACTS = {"planar": (284, 1), "sample_format": (339, 1), "fill_order": (266, 1), "compression": (259, 1), "row_factor": (50975, 1), "column_factor": (52547, 1)}
TABLE, JPEG_TABLES, EXTRA_PROFILES = 50712, 347, 50933
#: Offsets and lengths of image data: strips, tiles, and previews of the old kind.
PLACES = ((273, 279), (324, 325), (513, 514))
#: Kinds of compression whose checksum is of the compressed data.
COMPRESSED = (52546, 34892)
LOSSY_JPEG = 34892
NUMBERS = (directories.NEW_SUBFILE, directories.WIDTH, directories.HEIGHT, directories.BITS, directories.SAMPLES, directories.ROWS_PER_STRIP, directories.TILE_WIDTH, directories.TILE_HEIGHT, EXTRA_PROFILES, *(t for pair in PLACES for t in pair), *(t for t, _ in FACTS.values()))
TILE = 256
MAIN = ("new_digest", "old_digest", "original_digest", "version", "new_tag", "old_tag", "original_tag", "original_md5", "original_there", "profiles_end")


def slim_entries(files: DataFrame) -> DataFrame:
    """The entries of files (path, content) that a check goes by: numbers of some tags only, and no long values.

    reach: where the value ends in its file; md5: of an embedded original."""
    entries = catalog.ifd_entries(files.select("path", "content"))
    units = F.create_map(*[F.lit(v) for pair in catalog.UNITS.items() for v in pair])
    size = F.coalesce(F.try_element_at(units, F.col("type")), F.lit(0)) * F.col("count")
    own = ((F.col("kind") == "main") & (F.col("ifd") == 0)) | (F.col("kind") != "main")
    numbers = F.when(F.col("tag").isin(*NUMBERS), directories.numbers_of(F.col("value"), F.col("type"), F.col("big_endian")))
    kept = F.when((F.octet_length("value") <= 64) | (F.col("tag") == JPEG_TABLES), F.col("value"))
    out = entries.where(own).select("path", "ifd", "kind", "tag", "type", "count", "big_endian", numbers.alias("numbers"), kept.alias("value"), F.when(size > 4, F.col("start") + size).alias("reach"), F.when(F.col("tag") == directories.ORIGINAL_DATA, F.md5("value")).alias("md5"))
    return out.withColumn("number", F.get("numbers", F.lit(0)))


def facts(entries: DataFrame) -> DataFrame:
    """A row a file: is_dng, has_mask, required (the bytes that all its parts need), checksums, and raw, a struct of the layout and storage of the raw image."""
    tag = F.col("tag")
    value = lambda t: F.max(F.when(tag == t, F.col("number")))
    every = lambda t: F.max(F.when(tag == t, F.col("numbers")))
    # Versions are four bytes, the first two of which count.
    version = F.max(F.when(tag == directories.DNG_VERSION, F.conv(F.substring(F.hex("value"), 1, 4), 16, 10).cast("int")))
    stored = [F.coalesce(value(t), F.lit(d)).alias(n) for n, (t, d) in FACTS.items()]
    there = [F.max(tag == t).alias(n) for n, t in (("new_tag", directories.NEW_DIGEST), ("old_tag", directories.OLD_DIGEST), ("original_tag", directories.ORIGINAL_DIGEST), ("original_there", directories.ORIGINAL_DATA))]
    pairs = [every(t).alias(f"_{t}") for pair in PLACES for t in pair]
    profiles_end = (F.array_max(every(EXTRA_PROFILES)) + 8).alias("profiles_end")
    more = [F.max("big_endian").alias("big_endian"), F.max("kind").alias("kind"), value(directories.NEW_SUBFILE).alias("subfile"), version.alias("version"), F.max("reach").alias("reach"), F.max("md5").alias("original_md5")]
    more += [F.max(tag == directories.TILE_OFFSETS).alias("in_tiles"), F.max(F.when(tag == TABLE, F.col("count"))).alias("table"), F.max(F.when(tag == JPEG_TABLES, F.col("value"))).alias("jpeg_tables"), profiles_end]
    own = directories.layouts(entries, *more, *directories.digest_values(), *stored, *there, *pairs)
    ends = [F.array_max(F.zip_with(f"_{at}", f"_{n}", lambda a, b: a + b)) for at, n in PLACES]
    own = own.withColumn("end", F.greatest(F.coalesce("reach", F.lit(0)), *[F.coalesce(e, F.lit(0)) for e in ends], F.coalesce("profiles_end", F.lit(0)))).drop("reach", *[f"_{t}" for pair in PLACES for t in pair])
    image = F.col("kind").isin("main", "sub")
    order = F.when(image & (F.col("subfile") == 0) & F.col("width").isNotNull(), F.col("ifd"))
    raw = F.struct(*[c for c in own.columns if c not in ("path", "kind", "subfile", "end", *MAIN)])
    first = lambda c: F.max(F.when(F.col("ifd") == 0, F.col(c))).alias(c)
    met = own.groupBy("path").agg(F.min_by(raw, order).alias("raw"), F.coalesce(F.max(image & (F.col("subfile") == 4)), F.lit(False)).alias("has_mask"), F.max("end").alias("required"), *map(first, MAIN))
    return met.withColumn("is_dng", F.col("version").isNotNull())


def field_places(size: int, factor: int) -> np.ndarray:
    """Where each line (or column) of a frame is stored when they go field by field."""
    x = np.arange(size)
    field = x % factor
    return field * (size // factor) + np.minimum(field, size % factor) + x // factor


def unpacked(data: bytes, per_row: int, rows: int, bits: int, big: bool) -> np.ndarray:
    """rows x per_row samples; every row begins with a byte of its own, the first bit is the highest."""
    row_bytes = (per_row * bits + 7) // 8
    if len(data) < row_bytes * rows:
        raise ValueError("the raw image data is cut short")
    raw = np.frombuffer(data, np.uint8, row_bytes * rows).reshape(rows, row_bytes)
    if bits in (8, 16):
        return raw if bits == 8 else raw.view(">u2" if big else "<u2")
    each = np.unpackbits(raw, axis=1)[:, : per_row * bits].reshape(rows, per_row, bits)
    return each @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int32))


def chunk_bytes(content: bytes, raw: dict) -> Iterator[bytes]:
    for at, n in zip(raw["offsets"][: raw["across"] * raw["down"]], raw["counts"]):
        if not n:
            raise ValueError("a strip or tile of the raw image is empty")
        if at + n > len(content):
            raise ValueError("raw image data lies beyond the end of the file (the file may be cut short)")
        yield content[at : at + n]


def stored_image(content: bytes, raw: dict) -> np.ndarray:
    """height x width x planes samples of a plainly stored image, in their places."""
    w, h, planes = raw["width"], raw["height"], raw["planes"]
    out = np.zeros((h, w, planes), np.uint16)
    for k, data in enumerate(chunk_bytes(content, raw)):
        left, top = k % raw["across"] * raw["chunk_width"], k // raw["across"] * raw["chunk_rows"]
        rows = raw["chunk_rows"] if raw["in_tiles"] else min(raw["chunk_rows"], h - top)
        made = unpacked(data, raw["chunk_width"] * planes, rows, raw["bits"], raw["big_endian"]).reshape(rows, raw["chunk_width"], planes)
        part = out[top : top + rows, left : left + raw["chunk_width"]]
        part[:] = made[: part.shape[0], : part.shape[1]]
    if raw["row_factor"] > 1 or raw["column_factor"] > 1:
        out = out[field_places(h, raw["row_factor"])][:, field_places(w, raw["column_factor"])]
    return out


def digests(content: bytes, raw: dict) -> tuple[str, str | None]:
    """The newer and the older digest of a raw image; of compressed data both are the digest of its parts."""
    if raw["compression"] in COMPRESSED:
        parts = [hashlib.md5(p).digest() for p in chunk_bytes(content, raw)]
        if raw["compression"] == LOSSY_JPEG and raw["jpeg_tables"] is not None:
            parts.append(hashlib.md5(raw["jpeg_tables"]).digest())
        whole = hashlib.md5(b"".join(parts)).hexdigest()
        return whole, whole
    image = stored_image(content, raw)
    kind = "u1" if raw["bits"] <= 8 or (raw["table"] is not None and raw["table"] <= 256) else "<u2"
    new = hashlib.md5()
    for y in range(0, raw["height"], TILE):
        for x in range(0, raw["width"], TILE):
            tile = image[y : y + TILE, x : x + TILE]
            new.update(hashlib.md5(tile.transpose(2, 0, 1).astype(kind).tobytes()).digest())
    old = hashlib.md5()
    for y in range(0, raw["height"], TILE):
        old.update(image[y : y + TILE].astype("<u2").tobytes())
    return new.hexdigest(), old.hexdigest()


def raw_digests(files: DataFrame, readable: DataFrame) -> DataFrame:
    """(path, found_new, found_old, failed) of files (path, content) with a row in readable (path, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for content, raw in zip(b.column("content"), b.column("raw").to_pylist()):
                try:
                    found.append((*digests(content.as_py(), raw), None))
                except ValueError as wrong:  # of the file, not of the job: a verdict
                    found.append((None, None, str(wrong)))
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array([f[k] for f in found], pa.string()) for k in range(3))], ["path", "found_new", "found_old", "failed"])

    return files.select("path", "content").join(readable, "path").mapInArrow(run, "path string, found_new string, found_old string, failed string")


def checked(files: DataFrame) -> DataFrame:
    """(path, outcome, text, addable) of files (path, length, content). outcome: intact, damaged, unverified, or failed for what is no such file.

    All extents are checked (values, image data and previews in all directories; of extra profiles their heads), and the raw
    image and the embedded original against their checksums; addable names the checksums that the file lacks and could be given.
    Data with a coder of its own is checked by its bytes where the checksum is of these (JPEG XL, lossy JPEG), and else
    isn't verified, with the reason; originals aren't unpacked. What the directories say is a row a file, which is used twice."""
    c = F.col
    found = facts(slim_entries(files)).persist()
    r = lambda name: c("raw")[name]
    reasons = frames.layout_reasons(*[r(n) for n in ("bits", "planes", "planar", "sample_format", "fill_order", "compression", "row_factor", "column_factor", "width", "height")])
    compressed = F.coalesce(r("compression").isin(*COMPRESSED), F.lit(False))
    judged = found.select("*", F.coalesce(r("reason"), F.when(~compressed, reasons["damage"])).alias("damage"), F.when(~compressed, F.coalesce(reasons["unsupported"], F.when(r("compression") != 1, F.concat(F.lit("compression type "), r("compression").cast("string"))))).alias("unsupported"))
    readable = judged.where("is_dng AND raw IS NOT NULL AND damage IS NULL AND unsupported IS NULL").select("path", "raw")
    met = files.select("path", "length").join(judged, "path", "left").join(raw_digests(files, readable), "path", "left")

    has_new, has_old = c("new_digest").isNotNull(), c("old_digest").isNotNull()
    same = lambda a, b: F.coalesce(c(a) == c(b), F.lit(False))
    state = rules.raw_state(compressed, has_new, has_old, same("new_digest", "found_new"), same("old_digest", "found_old"), c("has_mask"))
    damage = F.coalesce(F.when(c("raw").isNull(), "the file has no raw image directory"), c("damage"), c("failed"))
    raw = F.when(damage.isNotNull(), "damaged").when(c("unsupported").isNotNull(), "unverified").otherwise(state)
    # The words of the verdicts.
    none = F.concat(F.lit("the file carries no checksum of its raw data"), F.when(c("has_mask"), ", and none can be worked out for an image with a transparency mask").otherwise(""))
    detail = (
        F.when(damage.isNotNull(), damage)
        .when(c("unsupported").isNotNull(), F.concat(F.lit("cannot check: "), c("unsupported")))
        .when(state == "damaged", "the raw image data does not match its checksum")
        .when((has_new | has_old) & (state == "unverified"), "cannot check: the image has a transparency mask")
        .when(state == "unverified", none)
    )
    has_original = F.coalesce(c("original_there"), F.lit(False))
    mismatch = c("original_digest").isNotNull() & (c("original_digest") != c("original_md5"))
    original = F.when(~has_original, "absent").when(c("original_md5").isNull() | mismatch, "damaged").when(c("original_digest").isNull(), "unverified").otherwise("intact")
    of_original = F.when(original == "damaged", F.when(c("original_md5").isNull(), "the embedded original cannot be read").otherwise("the embedded original does not match its checksum")).otherwise("isn't unpacked, and the file carries no checksum of it")
    short = c("required") - c("length")
    truncated = F.when(short > 0, F.concat(F.lit("the file is cut short: "), short.cast("string"), F.when(short == 1, " byte is").otherwise(" bytes are"), F.lit(" missing at its end")))
    said = frames.verdict_text(truncated, raw, detail, original, of_original)
    bad = truncated.isNotNull() | (raw == "damaged") | (original == "damaged")
    kind = frames.addable_digest(F.coalesce(c("version"), F.lit(0x0104)), compressed, bad | c("unsupported").isNotNull(), c("has_mask"), has_new | has_old)
    given = F.when(~F.coalesce(F.when(kind == "new", c("new_tag")).otherwise(c("old_tag")), F.lit(False)), kind)
    addable: Column = F.nullif(F.concat_ws(", ", given, F.when(~bad & (original == "unverified") & ~F.coalesce(c("original_tag"), F.lit(False)), "original")), F.lit(""))
    good = F.coalesce(c("is_dng"), F.lit(False))
    return met.select("path", F.when(good, said["outcome"]).otherwise("failed").alias("outcome"), F.when(good, said["text"]).otherwise("not a DNG file").alias("text"), F.when(good, addable).alias("addable"))
