"""Folders and files as DataFrames, by the binaryFile source.

Listing reads no contents: the source prunes `content` where it isn't selected and takes
filters on length and modification time itself. It leaves out files without a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import RAW_EXTENSIONS, extension

#: Files that hold converted pictures, and camera profiles.
DNG_EXTENSIONS, PROFILE_EXTENSIONS = (".dng",), (".dcp",)
#: A sidecar larger than this is none.
MOST_SIDECAR = 16 << 20
# Bytes of the field types.
UNITS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}


def files(spark: SparkSession, folder: str, recursive: bool = False, extensions: tuple[str, ...] = RAW_EXTENSIONS) -> DataFrame:
    """(path, relative, ext, named, length, modificationTime, content) of a folder's files of some kinds."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    root = folder.rstrip("/").split("://")[-1].split(":", 1)[-1]
    return found.select(
        "path",
        F.regexp_replace("path", f"^[a-z]*:/*{root.lstrip('/')}/*", "").alias("relative"),
        extension(F.col("path")).alias("ext"),
        F.lit(False).alias("named"),
        "length",
        "modificationTime",
        "content",
    ).where(F.col("ext").isin(*extensions))


def named_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for files given by name, whatever their extensions."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("relative"), extension(F.col("path")).alias("ext"), F.lit(True).alias("named"), "length", "modificationTime", "content")


def jobs(spark: SparkSession, paths: list[str], recursive: bool = False, extensions: tuple[str, ...] = RAW_EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(files, missing): folders are listed, files taken whatever their extension; missing holds (path, reason) of what isn't there."""
    status = {}
    for p in dict.fromkeys(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        status[p] = "missing" if not fs.exists(at) else "folder" if fs.getFileStatus(at).isDirectory() else "file"
    found = [files(spark, p, recursive, extensions) for p, s in status.items() if s == "folder"]
    if own := [p for p, s in status.items() if s == "file"]:
        found.append(named_files(spark, own))
    empty = "path string, relative string, ext string, named boolean, length bigint, modificationTime timestamp, content binary"
    out = spark.createDataFrame([], empty)
    for one in found:
        out = out.unionByName(one)
    return out, spark.createDataFrame([(p, "no such file or folder") for p, s in status.items() if s == "missing"], "path string, reason string")


def digests(found: DataFrame) -> DataFrame:
    """(path, length, md5) of files of up to 2 GiB."""
    return found.select("path", "length", F.md5("content").alias("md5"))


def sidecars(listing: DataFrame, raws: DataFrame) -> DataFrame:
    """(path, sidecar): stem.xmp, stem.XMP, full.xmp, full.XMP, the first that is there; null without any."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    names = F.array(F.concat(stem, F.lit(".xmp")), F.concat(stem, F.lit(".XMP")), F.concat("path", F.lit(".xmp")), F.concat("path", F.lit(".XMP")))
    asked = raws.select("path", F.posexplode(names).alias("priority", "sidecar")).where("path <> sidecar")
    there = asked.join(listing.select(F.col("path").alias("sidecar")).distinct(), "sidecar")
    return raws.select("path").join(there.groupBy("path").agg(F.min_by("sidecar", "priority").alias("sidecar")), "path", "left")


def sidecar_text(found: DataFrame) -> DataFrame:
    """(path, md5) of sidecars that look like XMP."""
    body = F.decode("content", "ISO-8859-1")
    return found.where((F.col("length") <= MOST_SIDECAR) & (body.contains("<x:xmpmeta") | body.contains("<rdf:RDF"))).select("path", F.md5("content").alias("md5"))


def ordered_jobs(jobs: DataFrame, parts: int | None = None) -> DataFrame:
    """jobs with `ord`, their place (from 1) by the bytes of their paths over all folders.

    Paths are dealt into ranges, numbered in their range as they lie there, and moved by how many the ranges before
    have: no task sees more than its range. The ranges are used twice, so they are persisted, and
    spark.catalog.clearCache() lets them go. Equal paths are in one range, in any order."""
    n = parts or int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = jobs.repartitionByRange(n, "path").sortWithinPartitions("path").withColumn("_id", F.monotonically_increasing_id())
    placed = numbered.select("*", F.shiftright("_id", 33).alias("_range"), (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_at")).drop("_id").persist()
    # One row a range: as many as there are tasks.
    sizes = placed.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = placed.join(F.broadcast(offsets), placed["_range"] == offsets["_of"])
    return met.withColumn("ord", F.col("_before") + F.col("_at")).select(*jobs.columns, "ord")


def ifd_entries(found: DataFrame, most: int = 2000, magics: tuple[int, ...] = (42, 0x4F52, 0x5352, 0x55, 0x4352)) -> DataFrame:
    """(path, ifd, kind, ord, tag, type, count, value, big_endian, reason, start): directories of TIFF-like files, a row an entry.

    start is where a value lies. kind: main (the chain of directories), sub, exif or gps (directories that others point to).
    Every offset is checked; a damaged file gives a row with a reason. Camera profiles are
    files of this kind too."""
    import struct

    # The tags that point to directories.
    sizes = UNITS
    pointers = {330: "sub", 34665: "exif", 34853: "gps"}
    names = ["path", "ifd", "kind", "ord", "tag", "type", "count", "value", "big_endian", "reason", "start"]
    bad = lambda number, kind, big, reason: (number, kind, None, None, None, None, None, big, reason, None)

    def entries(raw: bytes) -> Iterator[tuple]:
        order = {b"II": "<", b"MM": ">"}.get(raw[:2])
        if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] not in magics:
            yield bad(None, None, None, "not a TIFF")
            return
        big = order == ">"
        waiting, seen = [("main", struct.unpack_from(order + "I", raw, 4)[0])], set()
        for number, (role, at) in enumerate(waiting):
            if at in seen:
                continue
            seen.add(at)
            if at + 2 > len(raw):
                yield bad(number, role, big, "directory outside")
                continue
            n = struct.unpack_from(order + "H", raw, at)[0]
            if n > most or at + 2 + 12 * n + 4 > len(raw):
                yield bad(number, role, big, "directory too long")
                continue
            for k in range(n):
                place = at + 2 + 12 * k
                tag, kind, count = struct.unpack_from(order + "HHI", raw, place)
                size = sizes.get(kind, 0) * count
                start = place + 8 if size <= 4 else struct.unpack_from(order + "I", raw, place + 8)[0]
                whole = kind in sizes and start + size <= len(raw)
                yield number, role, k, tag, kind, count, raw[start : start + size] if whole else None, big, None if whole else "value outside", start
                if whole and tag in pointers and kind in (4, 13) and 0 < count <= 64 and len(waiting) < most:
                    waiting += [(pointers[tag], x) for x in struct.unpack_from(f"{order}{count}I", raw, start)]
            after = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]
            if role == "main" and after and len(waiting) < most:
                waiting.append(("main", after))

    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p.as_py(), *e) for p, c in zip(b.column(0), b.column(1)) for e in entries(c.as_py() or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return found.select("path", "content").mapInArrow(run, "path string, ifd int, kind string, ord int, tag int, type int, count bigint, value binary, big_endian boolean, reason string, start bigint")
