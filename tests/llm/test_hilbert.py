import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rawframe.llm import hilbert as H


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 3), (3, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select([F.shiftright("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{k}") for k in range(n)])
    rows = sorted((r["h"], [r[f"x{k}"] for k in range(n)]) for r in cells.withColumn("h", H.hilbert_index([F.col(f"x{k}") for k in range(n)], bits)).collect())
    assert [h for h, _ in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(rows, rows[1:]))


def made():
    rng = random.Random(3)
    rows = [(k, rng.choice(["é", "b"]) * rng.randrange(200), rng.choice(["en", "de", None]), "src0" if rng.random() < 0.4 else f"src{rng.randrange(9)}", rng.randrange(500), "s") for k in range(500)]
    return rows + [(3, "same", "en", "src0", 1, "s"), (3, "same", "en", "src0", 1, "s"), (None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def test_rows_law(spark):
    rows = made()
    got = H.hilbert_shard(spark.createDataFrame(rows, SCHEMA).repartition(5), shards=7).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    own = {}
    for i, t, *_ in rows:
        own.setdefault(i, set()).add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert all((r["size"], r["text_crc32"]) in own[r["doc_id"]] for r in got)
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in got)


def test_bytes_law(spark):
    got = H.hilbert_shard(spark.createDataFrame(made(), SCHEMA), shards=5, law="bytes")
    sums = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 5 and max(sums) - min(sums) <= 2 * got.agg(F.max("size")).first()[0]
    slots = got.groupBy("shard").agg(F.min("slot"), F.max("slot"), F.count_distinct("slot"), F.count("*")).collect()
    assert all(r[1] == 0 and r[2] == r[4] - 1 and r[3] == r[4] for r in slots)


def point_index(point, bits):
    """The curve's index by the published recursion on axes, written out for one point."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def plain_cells(values, bits):
    """Cells by the quantiles of all values, in their order; None is in cell 0."""
    known = sorted(v for v in values if v is not None)
    cuts = [known[max(0, math.ceil(len(known) * i / 2**bits) - 1)] for i in range(1, 2**bits)] if known else []
    return [0 if v is None else sum(c < v for c in cuts) for v in values]


def test_shards_and_slots_row_by_row(spark):
    rows = [r for r in made()[:500] if r[0] is not None]
    got = {r["doc_id"]: (r["hilbert"], r["shard"], r["slot"]) for r in H.hilbert_shard(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=7).collect()}
    cells = list(zip(*[plain_cells([r[k] for r in rows], H.BITS) for k in (2, 3, 4)]))
    order = sorted((point_index(c, H.BITS), zlib.crc32(r[1].encode()), r[0]) for c, r in zip(cells, rows))
    want, firsts = {}, {}
    for rank, (h, _, i) in enumerate(order):
        shard = rank * 7 // len(order)
        want[i] = (h, shard, rank - firsts.setdefault(shard, rank))
    assert got == want


def test_ranges_of_each_dimension_skip_shards(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, "t", rng.choice(["de", "en", "fr", "ja"]), f"source-{rng.randrange(30):02d}", rng.randrange(5000), "s") for k in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    ranges = [r.asDict() for r in H.write_shards(docs, str(tmp_path / "out"), shards=32).collect()]
    assert len(ranges) == 32 and sum(r["rows"] for r in ranges) == 2000
    back = spark.read.parquet(str(tmp_path / "out"))
    held = {(r["shard"], r["doc_id"]) for r in back.select("shard", "doc_id").collect()}
    by_shard = {}
    for shard, i in held:
        by_shard.setdefault(shard, set()).add(i)
    for k, name, low, high in ((2, "lang", "en", "en"), (3, "source", "source-05", "source-08"), (4, "n_chars", 1000, 1400)):
        wanted = {r[0] for r in rows if low <= r[k] <= high}
        read = {r["shard"] for r in ranges if r[f"greatest_{name}"] >= low and r[f"least_{name}"] <= high}
        assert wanted <= set().union(*(by_shard[s] for s in read)) and len(read) <= 24, (name, len(read))


def test_every_row_is_written_once(spark, tmp_path):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("mine")).withColumn("row", F.col("n_chars"))
    told = H.write_shards(docs, str(tmp_path / "out"), ("lang", "n_chars"), shards=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert told.agg(F.sum("rows"), F.sum("nulls_lang")).first()[0] == len(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, back.select("doc_id", "text", "lang", "source", "n_chars", "size").collect())) == sorted(map(key, rows))
    assert {r["row"] for r in back.collect()} == {r[4] for r in rows} and back.select("shard").distinct().count() == 8


def test_empty_and_short_tables(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    assert H.hilbert_shard(docs.limit(0)).count() == 0
    assert sorted(r["slot"] for r in H.hilbert_shard(docs.limit(3)).collect()) == [0, 0, 0]
