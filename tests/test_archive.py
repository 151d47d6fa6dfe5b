"""Files, records, profiles and update states."""

import os
import random
import struct

from pyspark.sql import functions as F

from rawframe.functions import numbers, text
from rawframe.operators import archive
from rawframe.sources import catalog
from rawframe.streaming.incremental import run_new_files

DIGEST = "900150983cd24fb0d6963f7d28e17f72"


def test_records(spark):
    plain = f"{text.RECORD_PREFIX}17137664, MD5 {DIGEST}"
    good = {plain: None, f"{plain}, sidecar MD5 {DIGEST}": DIGEST, f"{plain}\x00": None, f"{text.RECORD_PREFIX}18446744073709551615, MD5 {DIGEST}": None}
    bad = ["", text.RECORD_PREFIX, plain[:-1], plain + "0", plain + " ", " " + plain, plain + ", more", plain[:-1] + "F", plain.replace("17137664", "-5"), plain.replace("17137664", ""), plain.replace("17137664", "18446744073709551616"), plain.replace("17137664", "9" * 23)]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", text.parsed_record(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"]["present"] for r in rows} == {t: t in good for t in [*good, *bad]}
    assert {r["t"]: r["p"]["sidecar"] for r in rows if r["t"] in good} == good


def test_names(spark):
    cases = {"a/b\\c.CR2": "c.CR2", "x/..": "", "n:a\tm.e. .": "nam.e", "plain": "plain", "dir/": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", text.bare_name(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == cases
    row = spark.range(1).select(text.extension(F.lit("/a.b/IMG.NEF")).alias("a"), text.extension(F.lit("/a.b/.NEF")).alias("b"), text.clean_text(F.lit(" Ab\x01é c \x00tail")).alias("c"), text.unique_model(F.lit("Nikon"), F.lit("NIKON Z 6")).alias("d"), text.unique_model(F.lit("Fuji"), F.lit("X")).alias("e")).first()
    assert tuple(row) == (".nef", "", "Ab c", "NIKON Z 6", "Fuji X")


def test_axis_and_plan(spark):
    row = spark.range(1).select(numbers.axis_plan(F.lit(1037), F.lit(2), F.lit(256)).alias("a"), numbers.orientation(F.lit(6)).alias("o"), numbers.orientation(F.lit(-1)).alias("p")).first()
    assert tuple(row["a"]) == (176, 528, 1056, 9) and (row["o"], row["p"]) == (6, 1)


def test_interleaving_is_a_permutation(spark):
    for size, factor in ((8, 2), (9, 2), (13, 6), (7, 3), (31, 2), (5, 5)):
        rows = spark.range(size).select(numbers.stored_line(F.col("id"), F.lit(size), F.lit(factor))).collect()
        assert sorted(r[0] for r in rows) == list(range(size))
        assert [r[0] for r in rows][:: factor] == list(range(-(-size // factor)))


def test_profiles(spark):
    pictures = spark.createDataFrame([(1, "Maker X-1", 3), (2, "Other", 3), (3, "", 3)], "picture int, model string, planes int")
    profiles = spark.createDataFrame([(1, "Std", "maker x1", 3, 0), (2, "Std", "MAKER X 1", 3, 0), (3, "Std", "", 3, 0), (4, "Four", "", 4, 0), (5, "Locked", "", 3, 2), (6, "Else", "other", 3, 0), (7, "Odd", "--", 3, 0)], "ord int, profile string, camera string, profile_planes int, policy int")
    got = {(r["picture"], r["ord"]): r["verdict"] for r in archive.select_profiles(pictures, profiles).collect()}
    assert got == {(1, 1): "chosen", (1, 2): "twin", (1, 3): "twin", (1, 4): "planes", (1, 5): "policy", (2, 3): "chosen", (2, 4): "planes", (2, 5): "policy", (2, 6): "chosen", (3, 3): "chosen", (3, 4): "planes", (3, 5): "policy", (3, 7): "chosen"}
    every = archive.select_profiles(pictures.where("picture = 2"), profiles, any_camera=True)
    assert every.where("verdict = 'chosen'").count() == 3


def test_pictures_of_one_kind_meet_their_verdicts_in_many_tasks(spark):
    pictures = spark.range(2000).select(F.col("id").alias("picture"), F.when(F.col("id") % 2 == 0, "A 1").alias("model"), F.when(F.col("id") % 4 < 2, 3).alias("planes"))
    profiles = spark.range(30).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("profile"), F.when(F.col("id") % 3 == 0, "").otherwise("a1").alias("camera"), F.lit(3).alias("profile_planes"), (F.col("id") % 3).cast("int").alias("policy"))
    made = archive.select_profiles(pictures, profiles)
    assert made.columns == [*pictures.columns, *profiles.columns, "verdict"]
    rows = made.withColumn("task", F.spark_partition_id()).groupBy("model", "planes").agg(F.countDistinct("picture").alias("p"), F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).collect()
    got = {(r["model"], r["planes"]): (r["p"], r["n"]) for r in rows}
    # A picture without a model meets the ten profiles for any camera, whether its planes are known or not.
    assert got == {("A 1", 3): (500, 15000), (None, 3): (500, 5000), ("A 1", None): (500, 15000), (None, None): (500, 5000)}
    assert all(r["tasks"] > 8 for r in rows)


def test_update_states(spark):
    sources = spark.createDataFrame([(1, 5, None, "a"), (2, 5, "s", "a"), (3, 6, None, "a"), (4, 5, "s", "b"), (5, 5, "t", "a"), (6, 5, None, "a")], "k int, size int, sidecar_md5 string, d string")
    records = spark.createDataFrame([(1, 5, "a", None), (2, 5, "a", None), (3, 5, "a", "s"), (4, 5, "a", "s"), (5, 5, "a", "s")], "k int, r_size int, r_md5 string, r_sidecar string")
    got = {r["k"]: (r["state"], r["what"]) for r in archive.update_by_content(sources, records, "k", F.col("d")).collect()}
    assert got == {1: ("up to date", ""), 2: ("changed", "sidecar added"), 3: ("changed", "source changed, sidecar no longer there"), 4: ("changed", "source changed"), 5: ("changed", "sidecar changed"), 6: ("no record", "")}


def test_folders(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    tiff = b"II" + struct.pack("<HIH", 42, 8, 2) + struct.pack("<HHII", 256, 4, 1, 77) + struct.pack("<HHI4s", 271, 2, 3, b"ab\0\0") + struct.pack("<I", 0)
    for name, data in (("b.NEF", tiff), ("a.raf", b"x" * 10), ("sub/c.cr2", b"c"), ("note.txt", b"n"), ("b.XMP", b"<x:xmpmeta/>"), ("a.raf.xmp", b"plain")):
        (tmp_path / name).write_bytes(data)
    found = catalog.files(spark, str(tmp_path), recursive=True)
    assert [(r["relative"], r["ext"], r["ord"]) for r in catalog.ordered_jobs(found).orderBy("path").collect()] == [("a.raf", ".raf", 1), ("b.NEF", ".nef", 2), ("sub/c.cr2", ".cr2", 3)]
    listing = catalog.files(spark, str(tmp_path), True, (".xmp",))
    assert {r["path"].split("/")[-1]: (r["sidecar"] or "").split("/")[-1] for r in catalog.sidecars(listing, found).collect()} == {"a.raf": "a.raf.xmp", "b.NEF": "b.XMP", "c.cr2": ""}
    assert [r["path"].split("/")[-1] for r in catalog.sidecar_text(listing).collect()] == ["b.XMP"]
    entries = catalog.ifd_entries(found).collect()
    assert {(r["tag"], bytes(r["value"])) for r in entries if r["reason"] is None} == {(256, struct.pack("<I", 77)), (271, b"ab\0")}
    assert {r["reason"] for r in entries} == {None, "not a TIFF"}


def test_damaged_directories_never_raise(spark):
    tiff = b"MM" + struct.pack(">HIH", 42, 8, 1) + struct.pack(">HHII", 256, 4, 9, 5000) + struct.pack(">I", 8)
    rows = [(str(k), tiff[:k]) for k in range(len(tiff) + 1)] + [("x", b"II*\0" + b"\xff" * 30), ("n", None)]
    out = catalog.ifd_entries(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r["path"] for r in out} == {p for p, _ in rows} and all(r["reason"] for r in out)


def test_incremental_runs(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.nef").write_bytes(b"1")
    go = lambda: run_new_files(spark, str(folder), str(tmp_path / "state"), lambda rows: seen.extend(sorted(r["path"].split("/")[-1] for r in rows.collect())), (".nef",))
    go()
    (folder / "b.nef").write_bytes(b"2")
    (folder / "c.txt").write_bytes(b"3")
    go()
    assert seen == ["a.nef", "b.nef"]


def test_a_global_order(spark):
    rng = random.Random(6)
    paths = [f"/{rng.choice('aZé-_')}{rng.randrange(99)}/{rng.randrange(999)}.nef" for _ in range(400)] + ["/same/x.nef"] * 5
    rows = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, size int").repartition(5)
    made = catalog.ordered_jobs(rows, 7).orderBy("ord").collect()
    assert [r["ord"] for r in made] == list(range(1, 406))
    assert [r["path"] for r in made] == sorted(paths, key=str.encode)
    assert sorted(r["size"] for r in made) == list(range(405))
    assert catalog.ordered_jobs(rows.limit(0), 3).count() == 0
