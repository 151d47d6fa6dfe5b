"""The check of whole files on small files with known samples."""

import hashlib
import struct

import numpy as np
import pytest

from rawframe.operators import checks

from .test_directories import tiff


def stored_order(size, factor):
    return [x for f in range(factor) for x in range(f, size, factor)]


def dng(width=7, height=5, planes=1, bits=16, order="<", tiles=None, fields=(1, 1), new=True, old=False, table=None, version=b"\1\4\0\0", compression=1, more=(), original=None, original_digest=True, preview=b"", cut=0, spoil=False, data=None, narrow=False):
    """A file with a raw image, its checksums by the definition, and what else is asked for."""
    rng = np.random.default_rng(width * height + bits + planes)
    image = rng.integers(0, 1 << bits, (height, width, planes))
    stored = image[stored_order(height, fields[0])][:, stored_order(width, fields[1])]
    tw, th = tiles or (width, 2)
    chunks = list(data or ())
    for y in range(0, 0 if data else height, th):
        for x in range(0, width, tw):
            part = stored[y : y + th, x : x + tw]
            if tiles:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
            rows = ["".join(f"{v:0{bits}b}" for v in row.ravel()) for row in part]
            packed = b"".join(bytes(int(r[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(r), 8)) for r in rows)
            chunks.append(part.astype(order + "u2").tobytes() if bits == 16 else packed)
    parts = []
    for y in range(0, height, 256):
        for x in range(0, width, 256):
            tile = image[y : y + 256, x : x + 256]
            parts.append(hashlib.md5(b"".join(tile[:, :, k].astype("u1" if bits == 8 or narrow else "<u2").tobytes() for k in range(planes))).digest())
    newer, older = hashlib.md5(b"".join(parts)).digest(), hashlib.md5(image.astype("<u2").tobytes()).digest()
    if data:
        newer = older = hashlib.md5(b"".join(hashlib.md5(d).digest() for d in [*data, *([table] if table else [])])).digest()
    if spoil:
        chunks[-1] = bytes([chunks[-1][0] ^ 1]) + chunks[-1][1:]

    def build(base):
        at = [base + sum(map(len, chunks[:k])) for k in range(len(chunks))]
        end = base + sum(map(len, chunks))
        long = lambda tag, v: (tag, 4, len(v), struct.pack(f"{order}{len(v)}I", *v))
        e = {254: [0], 256: [width], 257: [height], 258: [bits], 259: [compression], 277: [planes]}
        e |= {322: [tw], 323: [th], 324: at, 325: list(map(len, chunks))} if tiles else {278: [th], 273: at, 279: list(map(len, chunks))}
        if fields != (1, 1):
            e |= {50975: [fields[0]], 52547: [fields[1]]}
        if preview:
            e |= {513: [end], 514: [len(preview)]}
        own = [long(t, v) for t, v in sorted((e | dict(more)).items())] + [(50706, 1, 4, version)]
        own += [(51111, 7, 16, newer)] if new else []
        own += [(50972, 1, 16, older)] if old else []
        if table:
            own.append((347, 7, len(table), table))
        if narrow:
            own.append((50712, 3, 4, struct.pack(order + "4H", 0, 1, 2, 3)))
        if original:
            own.append((50828, 7, len(original), original))
            if original_digest:
                own.append((50973, 1, 16, hashlib.md5(original).digest() if original_digest is True else original_digest))
        return tiff([own], order)

    whole = build(len(build(0))) + b"".join(chunks) + preview
    return whole[: len(whole) - cut]


GOOD = ("intact", "intact (raw image)", None)
CASES = {
    "strips": (dng(), GOOD),
    "big": (dng(order=">"), GOOD),
    "tiles": (dng(tiles=(4, 3)), GOOD),
    "tiles of planes": (dng(planes=3, tiles=(4, 3), order=">"), GOOD),
    "planes": (dng(planes=3), GOOD),
    "bytes": (dng(bits=8), GOOD),
    "twelve": (dng(bits=12, planes=2), GOOD),
    "ten in tiles": (dng(bits=10, tiles=(3, 4), order=">"), GOOD),
    "fields": (dng(fields=(2, 2)), GOOD),
    "odd fields": (dng(fields=(3, 2), tiles=(4, 4), planes=2), GOOD),
    "wide": (dng(width=600, height=300), GOOD),
    "table": (dng(bits=16, narrow=True), GOOD),
    "older": (dng(new=False, old=True, planes=3, fields=(2, 1)), GOOD),
    "both": (dng(old=True), GOOD),
    "spoilt": (dng(spoil=True, tiles=(4, 3)), ("damaged", "DAMAGED: the raw image data does not match its checksum", None)),
    "none": (dng(new=False), ("unverified", "not verified: the file carries no checksum of its raw data", "new")),
    "none of old": (dng(new=False, version=b"\1\3\0\0"), ("unverified", "not verified: the file carries no checksum of its raw data", "old")),
    "cut": (dng(cut=3), ("damaged", "DAMAGED: the file is cut short: 3 bytes are missing at its end", None)),
    "cut preview": (dng(preview=b"jpeg" * 9, cut=1), ("damaged", "DAMAGED: the file is cut short: 1 byte is missing at its end", None)),
    "preview": (dng(preview=b"jpeg" * 9), GOOD),
    "original": (dng(original=b"packed" * 50), ("intact", "intact (raw image, embedded original)", None)),
    "bad original": (dng(original=b"packed" * 50, original_digest=b"z" * 16), ("damaged", "DAMAGED: the embedded original does not match its checksum", None)),
    "two bad": (dng(original=b"packed" * 50, original_digest=b"z" * 16, spoil=True), ("damaged", "DAMAGED: the raw image data does not match its checksum; the embedded original does not match its checksum", None)),
    "open original": (dng(original=b"packed" * 50, original_digest=None), ("unverified", "not verified: raw image intact; embedded original isn't unpacked, and the file carries no checksum of it", "original")),
    "deflate": (dng(compression=8), ("unverified", "not verified: cannot check: Deflate compression", None)),
    "lossless jpeg": (dng(compression=7), ("unverified", "not verified: cannot check: compression type 7", None)),
    "jxl": (dng(compression=52546, data=[b"one", b"two", b"three"]), GOOD),
    "lossy jpeg": (dng(compression=34892, data=[b"one", b"two", b"three"], table=b"tables" * 3), GOOD),
    "bad jxl": (dng(compression=52546, data=[b"one", b"two", b"three"], spoil=True), ("damaged", "DAMAGED: the raw image data does not match its checksum", None)),
    "no planes": (dng(more={277: [0]}), ("damaged", "DAMAGED: the raw image has an impossible number of colour planes", None)),
    "impossible fields": (dng(more={50975: [9], 52547: [1]}), ("damaged", "DAMAGED: the raw image has an impossible interleave factor", None)),
    "short strip": (dng(more={279: [28, 3, 14]}), ("damaged", "DAMAGED: the raw image data is cut short", None)),
    "empty strip": (dng(more={279: [28, 0, 14]}), ("damaged", "DAMAGED: a strip or tile of the raw image is empty", None)),
    "few strips": (dng(more={278: [1]}), ("damaged", "DAMAGED: the raw image lists fewer strips or tiles than it needs", None)),
    "profile beyond": (dng(more={50933: [99990]}), None),
    "no raw": (dng(more={254: [1]}), ("damaged", "DAMAGED: the file has no raw image directory", None)),
    "tiff": (tiff([[(256, 4, 1, struct.pack("<I", 3))]]), ("failed", "not a DNG file", None)),
    "other": (b"II*\0" + b"\0" * 10, ("failed", "not a DNG file", None)),
    "empty": (b"", ("failed", "not a DNG file", None)),
}


def test_verdicts(spark):
    rows = spark.createDataFrame([(p, len(f), f) for p, (f, _) in CASES.items()], "path string, length long, content binary").repartition(3)
    made = {r["path"]: tuple(r)[1:] for r in checks.checked(rows).collect()}
    assert set(made) == set(CASES)
    for name, (file, want) in CASES.items():
        if want is None:
            want = ("damaged", f"DAMAGED: the file is cut short: {99990 + 8 - len(file)} bytes are missing at its end", None)
        assert made[name] == want, name


@pytest.mark.parametrize("size,factor", [(7, 2), (9, 3), (5, 5), (8, 1)])
def test_fields_go_back(size, factor):
    stored = np.array(stored_order(size, factor))
    assert stored[checks.field_places(size, factor)].tolist() == list(range(size))


def test_the_plan_is_short(spark):
    rows = spark.createDataFrame([("a", 3, b"abc")], "path string, length long, content binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = checks.checked(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[-1]
    assert final.count("Exchange hashpartitioning") < 10
    assert checks.checked(rows.limit(0)).count() == 0
