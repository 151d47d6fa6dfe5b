"""Directories, profiles, lenses and colours on small files and frames."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rawframe.functions import colour, frames
from rawframe.operators import directories
from rawframe.sources import catalog

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1, 10: 8}


def tiff(directories_, order="<", magic=42):
    """Directories as lists of (tag, type, count, data); a value "->k" points to directory k, which is then no part of the chain."""
    spots, at = [], 8
    for d in directories_:
        spots.append(at)
        at += 2 + 12 * len(d) + 4
    pointed = {int(v[2:]) for d in directories_ for *_, v in d if isinstance(v, str)}
    chain = [k for k in range(len(directories_)) if k not in pointed]
    out, tail = b"", b""
    for k, d in enumerate(directories_):
        out += struct.pack(order + "H", len(d))
        for tag, kind, count, v in d:
            data = struct.pack(order + "I", spots[int(v[2:])]) if isinstance(v, str) else v
            out += struct.pack(order + "HHI", tag, kind, count)
            if len(data) <= 4:
                out += data.ljust(4, b"\0")
            else:
                out += struct.pack(order + "I", at + len(tail))
                tail += data
        after = chain[chain.index(k) + 1] if k in chain and chain.index(k) + 1 < len(chain) else None
        out += struct.pack(order + "I", spots[after] if after is not None else 0)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", magic, 8) + out + tail


def read(spark, **contents):
    return catalog.ifd_entries(spark.createDataFrame(list(contents.items()), "path string, content binary")).cache()


@pytest.mark.parametrize("order", ["<", ">"])
def test_pointers_metadata_and_raw_images(spark, order):
    long = lambda *v: struct.pack(f"{order}{len(v)}I", *v)
    main = [(254, 4, 1, long(1)), (270, 2, 4, b"hey\0"), (256, 4, 1, long(9)), (330, 4, 1, "->1"), (34665, 4, 1, "->2"), (34853, 4, 1, "->3"), (50706, 1, 4, b"\1\4\0\0"), (51111, 7, 16, bytes(range(16)))]
    raw = [(254, 4, 1, long(0)), (256, 4, 1, long(100)), (257, 4, 1, long(50)), (277, 4, 1, long(1)), (278, 4, 1, long(20)), (273, 4, 3, long(1000, 2000, 3000)), (279, 4, 3, long(5, 6, 7))]
    exif = [(33434, 4, 1, long(3)), (37500, 7, 4, b"note")]
    file = tiff([main, raw, exif, [(0, 1, 4, b"\2\3\0\0")]], order)
    other = tiff([main, raw, exif, [(0, 1, 4, b"\2\3\0\0"), (1, 2, 2, b"N\0")]], order)
    entries = directories.with_numbers(read(spark, a=file, b=other))
    assert {(r["kind"], r["ifd"]) for r in entries.collect()} == {("main", 0), ("sub", 1), ("exif", 2), ("gps", 3)}
    kept = {(r["path"], r["kind"], r["tag"]) for r in directories.kept_metadata(entries).collect()}
    assert kept == {(p, k, t) for p in "ab" for k, t in (("main", 270), ("exif", 33434))} | {("b", "gps", 0), ("b", "gps", 1)}
    assert tuple(directories.raw_directories(entries).where("path = 'a'").first()) == ("a", True, 1, False)
    assert tuple(directories.stored_digests(entries).where("path = 'a'").first()) == ("a", bytes(range(16)).hex(), None, None)
    strips = directories.chunks(directories.layouts(entries)).where("path = 'a' and ifd = 1").orderBy("chunk").collect()
    assert [(r["y"], r["rows"], r["offset"], r["bytes"]) for r in strips] == [(0, 20, 1000, 5), (20, 20, 2000, 6), (40, 10, 3000, 7)]


def test_duplicate_tags(spark):
    got = directories.sorted_tags(read(spark, a=tiff([[(9, 3, 1, b"\0\0"), (3, 3, 1, b"\0\0"), (9, 3, 1, b"\0\0")]]))).first()
    assert got["tags"] == [3, 9, 9] and got["refused"]


def test_jobs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.nef").write_bytes(b"1")
    (tmp_path / "b.odd").write_bytes(b"2")
    found, missing = catalog.jobs(spark, [str(tmp_path / "d"), str(tmp_path / "b.odd"), str(tmp_path / "gone")])
    assert sorted((r["relative"], r["named"]) for r in found.collect()) == [("a.nef", False), ("b.odd", True)]
    assert [r["path"] for r in missing.collect()] == [str(tmp_path / "gone")]


def test_colour_transforms(spark):
    xyz = np.array(colour.XYZ_OF_SRGB)
    for planes in (3, 4):
        m = np.array([[0.8293, -0.1789, -0.1094], [-0.5025, 1.2925, 0.2327], [-0.1199, 0.2769, 0.6108], [0.2, 0.5, 0.1]])[:planes]
        cam = m @ xyz
        scaled = cam / cam.sum(1, keepdims=True)
        want = np.linalg.pinv(scaled)
        t = spark.range(1).select(colour.colour_transform(F.array(*[F.lit(float(v)) for v in m.ravel()]), planes).alias("t")).first()["t"]
        assert np.allclose(np.array(t["rgb"]).reshape(3, planes), want) and np.allclose(t["balance"], cam.sum(1).max() / cam.sum(1))
    t = spark.range(1).select(colour.colour_transform(F.lit(None).cast("array<double>"), 3, F.array(*[F.lit(v) for v in (0.5, 1.0, 0.625)])).alias("t")).first()["t"]
    assert t["rgb"] == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    flat = spark.range(1).select(colour.inverted(F.array(*[F.lit(float(v)) for v in range(9)])).alias("i")).first()["i"]
    assert flat is None


def test_frames(spark):
    pick = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    assert tuple(pick(frames.mosaic_block(lit([0, 1, 1, 2]), 2, 2, 3))) == (2, 2)
    xtrans = [1, 1, 0, 1, 1, 2, 1, 1, 2, 1, 1, 0, 2, 0, 1, 0, 2, 1, 1, 1, 2, 1, 1, 0, 1, 1, 0, 1, 1, 2, 0, 2, 1, 2, 0, 1]
    assert tuple(pick(frames.mosaic_block(lit(xtrans), 6, 6, 3))) == (3, 3)
    size = lambda w, h, sx, sy, p, q, most: tuple(pick(frames.render_size(*[F.lit(v) for v in (w, h, sx, sy, p, q, 1.0, 1.0, most)])) or ())
    assert size(640, 480, 0, 0, 2, 2, 0) == (320, 240) and size(640, 480, 0, 0, 2, 2, 100) == (100, 75)
    assert size(612, 408, 0, 0, 3, 3, 0) == (204, 136) and size(320, 240, 0, 0, 1, 1, 0) == (320, 240) and size(600, 400, 0, 0, 3, 1, 0) == (200, 133) and size(1, 1, 0, 0, 2, 2, 0) == ()
    assert bytes(pick(frames.swapped(F.lit(b"\1\2\3\4\5"), F.lit(2)))) == b"\2\1\4\3\5" and bytes(pick(frames.swapped(F.lit(b""), F.lit(4)))) == b""
    assert pick(frames.gcd(F.lit(0), F.lit(0))) == 0 and pick(frames.lcm(F.lit(4), F.lit(6))) == 12
    assert pick(frames.serial(F.lit(" . "))) == ""


def test_records_and_originals(spark):
    packed = struct.pack(">I", 1234) + b"streams"
    record = b"Other 1: size 77, MD5 " + b"a" * 32 + b"\0"
    text = lambda tag, v: (tag, 2, len(v), v)
    data = (50828, 7, len(packed), packed)
    digest = lambda v: (50973, 1, 16, v)
    files = {"ok": tiff([[text(50827, b"a.raw\0"), data, digest(hashlib.md5(packed).digest()), text(65300, record)]]), "bad": tiff([[data, digest(b"z" * 16)]]), "open": tiff([[data]]), "none": tiff([[text(65300, b"x" * 300)]])}
    entries = read(spark, **files)
    got = {r["path"]: (r["name"], r["size"], r["verdict"]) for r in directories.originals(entries).collect()}
    assert got == {"ok": ("a.raw", 1234, "intact"), "bad": (None, 1234, "damaged"), "open": (None, 1234, "unverified"), "none": (None, None, "absent")}
    records = {r["path"]: (r["present"], r["size"], r["digest"]) for r in directories.source_records(entries, "Other 1: size ").collect()}
    assert records["ok"] == (True, 77, "a" * 32) and not any(records[p][0] for p in ("bad", "open", "none"))
