"""Text rules for names, paths and source records, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of raw files.
RAW_EXTENSIONS = (
    ".3fr", ".ari", ".arw", ".bay", ".cap", ".cr2", ".cr3", ".crw", ".dcr", ".dcs",
    ".drf", ".eip", ".erf", ".fff", ".gpr", ".iiq", ".k25", ".kdc", ".mdc", ".mef",
    ".mos", ".mrw", ".nef", ".nrw", ".orf", ".ori", ".pef", ".ptx", ".pxn", ".raf",
    ".raw", ".rw2", ".rwl", ".rwz", ".sr2", ".srf", ".srw", ".sti", ".x3f",
)
#: What a source record begins with; another program's records take another prefix.
RECORD_PREFIX = "source record 1: size "
MOST_SIZE = 2**64 - 1


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def normalised_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def clean_text(text: Column) -> Column:
    """Printable ASCII up to the first NUL, without blanks at the ends."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, r"(?s)^([^\x00]*)", 1), "[^ -~]", ""))


def bare_name(path: Column) -> Column:
    """The last part of a path of either kind, without control characters and colons, dots and blanks at its end."""
    last = F.regexp_extract(path, r"(?s)([^/\\]*)$", 1)
    return F.regexp_replace(F.regexp_replace(last, r"[\x00-\x1F\x7F:]", ""), "[ .]+$", "")


def unique_model(make: Column, model: Column) -> Column:
    """Make and model, but the make only once."""
    return F.when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.trim(F.concat_ws(" ", make, model)))


def megabytes(size: Column) -> Column:
    return F.format_string("%.1f MB", size / 1048576.0)


def exif_time(at: Column) -> Column:
    """EXIF text of a time; nothing up to the epoch."""
    return F.when(F.unix_timestamp(at) > 0, F.date_format(at, "yyyy:MM:dd HH:mm:ss")).otherwise("")


def record_text(size: Column, digest: Column, sidecar_digest: Column | None = None, prefix: str = RECORD_PREFIX) -> Column:
    plain = F.concat(F.lit(prefix), size.cast("string"), F.lit(", MD5 "), digest)
    if sidecar_digest is None:
        return plain
    return F.when(sidecar_digest.isNull(), plain).otherwise(F.concat(plain, F.lit(", sidecar MD5 "), sidecar_digest))


def parsed_record(text: Column, prefix: str = RECORD_PREFIX) -> Column:
    """struct(present, size, digest, sidecar) of a record that begins with the prefix; anything else isn't one. NULs may follow."""
    pattern = f"^{re.escape(prefix)}([0-9]{{1,20}}), MD5 ([0-9a-f]{{32}})(?:, sidecar MD5 ([0-9a-f]{{32}}))?\\x00*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    size = F.nullif(part(1), F.lit("")).cast("decimal(20,0)")
    present = F.coalesce(size <= F.lit(str(MOST_SIZE)).cast("decimal(20,0)"), F.lit(False))
    return F.struct(
        present.alias("present"),
        F.when(present, size).alias("size"),
        F.when(present, part(2)).alias("digest"),
        F.when(present, F.nullif(part(3), F.lit(""))).alias("sidecar"),
    )
