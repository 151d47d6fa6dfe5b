"""Camera profiles, against a reader that goes field by field."""

import hashlib
import math
import struct

import pytest

from rawframe.operators import profiles

UNITS = profiles.BYTES
KINDS = {tag: (kind, version, name) for tag, kind, version, name in profiles.RULES}


def pack(order, kind, values):
    return b"".join(struct.pack(order + {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 7: "B", 10: "ii", 11: "f"}[kind], *(v if isinstance(v, tuple) else (v,))) for v in values)


def file(fields, order="<", magic=0x4352, at=8, entries=None, cut=0):
    out, tail = b"", b""
    start = at + 2 + 12 * len(fields)
    for tag, kind, values, *count in fields:
        data = values if isinstance(values, bytes) else pack(order, kind, values)
        n = count[0] if count else len(data) // UNITS.get(kind, 1)
        out += struct.pack(order + "HHI", tag, kind, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", start + len(tail)))
        tail += data if len(data) > 4 else b""
    whole = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", magic, at) + b"\0" * (at - 8) + struct.pack(order + "H", len(fields) if entries is None else entries) + out + tail
    return whole[: len(whole) - cut]


MATRIX = [(10000, 10000), (3, 10), (-1, 10), (0, 1), (9, 10), (1, 7), (2, 10), (1, 10), (8, 10)]
BASE = [(50708, 2, b"Cam 1\0"), (50721, 10, MATRIX), (50778, 3, [21]), (50936, 2, b"Std  \0")]
DIMS, TABLE = (50937, 4, [2, 2, 1]), [0.5] * 12
CASES = {
    "plain": BASE,
    "no name": BASE[:3],
    "unknown field": [*BASE, (50001, 4, [7])],
    "broken unknown field": [*BASE, (50001, 99, b"\0")],
    "four planes": [(50721, 10, MATRIX + [(1, 2)] * 3)],
    "two matrices": [*BASE, (50722, 10, MATRIX), (50779, 4, [17])],
    "three": [*BASE, (50722, 10, MATRIX), (52531, 10, MATRIX), (50964, 10, MATRIX)],
    "third only": [*BASE, (52531, 10, MATRIX)],
    "six": [(50721, 10, MATRIX[:6])],
    "none": BASE[2:],
    "misfit": [*BASE, (50964, 10, MATRIX + [(1, 1)] * 3)],
    "zero": [*BASE, (50965, 10, [(1, 0), *MATRIX[1:]])],
    "zero before misfit": [*BASE, (50722, 10, [(1, 0), *MATRIX[1:]]), (50725, 10, MATRIX[:3])],
    "flat": [(50721, 10, [(1, 1)] * 9)],
    "dims": [*BASE, DIMS, (50938, 11, TABLE), (50939, 11, TABLE), (52537, 11, TABLE)],
    "short dims": [*BASE, (50937, 3, [2, 2, 1]), (50938, 11, TABLE)],
    "no dims": [*BASE, (50938, 11, TABLE)],
    "large dims": [*BASE, (50937, 4, [2, 5000, 1]), (50938, 11, TABLE)],
    "flat dims": [*BASE, (50937, 4, [2, 1, 1]), (50938, 11, TABLE)],
    "short table": [*BASE, DIMS, (50938, 11, TABLE), (50939, 11, TABLE[:9])],
    "look": [*BASE, (50981, 4, [1, 2, 2]), (50982, 11, TABLE)],
    "dims alone": [*BASE, (50937, 4, [0, 0, 0])],
    "look bad": [*BASE, (50981, 4, [1, 2, 3]), (50982, 11, TABLE)],
    "curve": [*BASE, (50940, 11, [0.0, 0.0, 1.0, 1.0])],
    "odd curve": [*BASE, (50940, 11, [0.0, 0.0, 1.0, 1.0, 1.0])],
    "infinite": [*BASE, (50940, 11, [0.0, math.inf, 1.0, 1.0])],
    "nan": [*BASE, (50940, 11, [0.0, math.nan, 1.0, 1.0])],
    "wrong type": [*BASE, (50941, 2, b"a\0")],
    "two numbers": [*BASE, (50941, 4, [1, 2])],
    "wide light": [BASE[0], BASE[1], (50778, 4, [70000])],
    "policy": [*BASE, (50941, 3, [2])],
    "twice": [*BASE, (50936, 2, b"x\0")],
    "camera twice": [*BASE, (50708, 2, b"Other\0")],
    "empty": [*BASE, (50942, 2, b"", 0)],
    "unknown type": [*BASE, (50942, 14, b"abc\0")],
    "large": [*BASE, (52539, 7, b"abcdefgh", 70 << 20)],
    "outside": [*BASE, (52539, 7, b"abcdefgh", 900)],
    "two wrongs": [(50941, 2, b"a\0"), (50942, 2, b"", 0), *BASE],
    "exposure": [*BASE, (51109, 10, [(-1, 2)])],
    "exposures": [*BASE, (51109, 10, [(-1, 2), (1, 2)])],
    "opaque": [*BASE, (52544, 7, b"\1\2\3\4\5"), (52552, 1, b"Group\0")],
    "copyright": [*BASE, (50942, 1, "é 2020 \0more".encode())],
}
ODD = {"short": b"II\x52", "other": b"XX\x52\x43aaaa", "tiff": file(BASE, magic=42), "magic": file(BASE, magic=43), "misplaced": b"II\x52\x43\4\0\0\0\0\0", "beyond": b"II\x52\x43\x90\0\0\0\0\0", "no fields": file([], entries=0), "many fields": file([], entries=501), "cut": file(BASE, entries=40), "cut late": file(BASE, cut=3), "": b""}


def expected(data):
    """(reason, facts) by reading one field after the other."""
    if len(data) < 8:
        return "not a camera profile (too short)", None
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        return "not a camera profile", None
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 0x4352:
        return "a TIFF or DNG file, not a camera profile (.dcp)" if magic == 42 else "not a camera profile", None
    if at < 8:
        return "the profile's directory is misplaced", None
    if at + 2 > len(data):
        return "the profile is cut short", None
    n = struct.unpack_from(order + "H", data, at)[0]
    if not 1 <= n <= 500:
        return "the profile's directory is damaged", None
    found, camera = {}, ""
    for k in range(n):
        spot = at + 2 + 12 * k
        if spot + 12 > len(data):
            return "the profile is cut short", None
        tag, kind, count, where = struct.unpack_from(order + "HHII", data, spot)
        if tag not in KINDS:
            continue
        rule, version, name = KINDS[tag]
        size = UNITS.get(kind, 0) * count
        if not size:
            return f"{name} is empty or of an unknown type", None
        if size > 64 << 20:
            return f"{name} is implausibly large", None
        where = spot + 8 if size <= 4 else where
        if where + size > len(data):
            return f"{name} lies outside the file", None
        value = data[where : where + size]
        element = {3: 2, 8: 2, 4: 4, 5: 4, 9: 4, 10: 4, 11: 4, 13: 4, 12: 8}.get(kind, 1)
        if order == ">":
            value = b"".join(value[i : i + element][::-1] for i in range(0, size, element))
        if kind not in profiles.TYPES[rule] or (rule in profiles.COUNTS and count != profiles.COUNTS[rule]):
            return f"{name} has the wrong type", None
        if rule in ("number16", "number32", "dims"):
            numbers = struct.unpack(f"<{count}{'H' if kind == 3 else 'I'}", value)
            if rule == "number16" and numbers[0] > 65535:
                return f"{name} has the wrong type", None
            kind = 3 if rule == "number16" else 4
            value = struct.pack(f"<{count}{'H' if kind == 3 else 'I'}", *numbers)
        if rule == "floats" and not all(map(math.isfinite, struct.unpack(f"<{count}f", value))):
            return f"{name} holds values that are not numbers", None
        if rule == "camera":
            camera = value.split(b"\0")[0].rstrip(b" ").decode()
            continue
        if tag in found:
            return f"{name} occurs twice", None
        found[tag] = (kind, count, value, version)
    count = lambda t: found[t][1]
    if 50721 not in found:
        return "the profile has no colour matrix", None
    if count(50721) not in (9, 12):
        return "ColorMatrix1 is not a matrix for three or four colours", None
    planes = count(50721) // 3
    values = lambda t: [a / b if b else math.nan for a, b in struct.iter_unpack("<ii", found[t][2])]
    for tag, (rule, _, name) in KINDS.items():
        if rule == "matrix" and tag in found:
            if count(tag) != 3 * planes:
                return f"{name} does not fit a camera with {planes} colours", None
            if any(map(math.isnan, values(tag))):
                return f"{name} holds a division by zero", None
    m = values(50721)
    if planes == 3 and not abs(m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])) > 1e-9:
        return "ColorMatrix1 cannot be inverted", None
    if 52531 in found and 50722 not in found:
        return "the profile has a third colour matrix but no second", None
    for dims, tables, what in ((50937, (50938, 50939, 52537), "hue and saturation table"), (50981, (50982,), "look table")):
        for t in tables:
            if t in found:
                if dims not in found:
                    return f"the {what} has no dimensions", None
                h, s, v = struct.unpack("<3I", found[dims][2])
                if h < 1 or s < 2 or v < 1 or max(h, s, v) > 4096:
                    return f"the {what} has impossible dimensions", None
                if h * s * v * 3 != count(t):
                    return f"the {what} does not have the size its dimensions give", None
    if 50940 in found and (count(50940) < 4 or count(50940) % 2):
        return "the tone curve is not a list of points", None
    digest = hashlib.md5(b"".join(struct.pack("<HHI", t, *found[t][:2]) + found[t][2] for t in sorted(found))).hexdigest()
    text = lambda t: found[t][2].split(b"\0")[0].rstrip(b" ").decode() if t in found else ""
    return None, (camera, text(50936), text(50942), text(52552), planes, 3 if 52531 in found else 2 if 50722 in found else 1, struct.unpack("<I", found[50941][2])[0] if 50941 in found else 0, max(f[3] for f in found.values()), digest)


def test_against_a_reader(spark):
    contents = {f"/x/{name}{order}": file(fields, order) for name, fields in CASES.items() for order in "<>"} | {f"/x/{k}": v for k, v in ODD.items()}
    made = {r["path"]: r for r in profiles.profiles(spark.createDataFrame(list(contents.items()), "path string, content binary").repartition(3)).collect()}
    assert set(made) == set(contents)
    for path, data in contents.items():
        reason, facts = expected(data)
        r = made[path]
        assert r["reason"] == reason, path
        if facts:
            assert (r["camera"], r["profile"], r["copyright"], r["group_name"], r["profile_planes"], r["illuminants"], r["policy"], r["version"], r["digest"]) == facts, path
    for name in CASES:
        assert made[f"/x/{name}<"]["digest"] == made[f"/x/{name}>"]["digest"] or made[f"/x/{name}<"]["reason"]
    assert made["/x/plain<"]["digest"] == made["/x/unknown field<"]["digest"] == made["/x/camera twice<"]["digest"]
    assert made["/x/dims<"]["digest"] != made["/x/plain<"]["digest"]
    assert len({r["reason"] for r in made.values()}) > 22
    assert made["/x/three<"]["summary"] == "three illuminants (D65), forward matrix"
    assert made["/x/short dims>"]["summary"] == "one illuminant (D65), hue and saturation table 2x2x1"
    assert made["/x/no name<"]["label"] == "no name<"


def test_folders(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("b.dcp", file(BASE))
    put("a.DCP", file(BASE, ">"))
    put("deep/c.dcp", file([(50708, 2, b"Other\0"), *BASE[1:]]))
    put("deep/bad.dcp", file(CASES["twice"]))
    put("deep/x.txt", b"no")
    own, skipped = profiles.scan(spark, [str(tmp_path / "in")])
    assert sorted((r["file_name"], r["camera"]) for r in own.collect()) == [("a.DCP", "Cam 1"), ("c.dcp", "Other")]
    [one] = skipped.collect()
    assert one["path"].endswith("bad.dcp") and one["reason"].endswith("bad.dcp': ProfileName occurs twice")
    assert profiles.scan(spark, [str(tmp_path / "in" / "b.dcp")])[0].count() == 1
    with pytest.raises(ValueError, match="ProfileName occurs twice"):
        profiles.scan(spark, [str(tmp_path / "in" / "deep" / "bad.dcp")])
    with pytest.raises(FileNotFoundError):
        profiles.scan(spark, [str(tmp_path / "gone")])
    empty = spark.createDataFrame([], "path string, content binary")
    assert profiles.profiles(empty).count() == 0
