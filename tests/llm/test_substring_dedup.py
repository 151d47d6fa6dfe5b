import hashlib
import random

from pyspark.sql import functions as F

from rawframe.llm import substring_dedup as S


def brute(rows, window=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            first[w] = min(first.get(w, 1 << 63), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(["the ", "of ", "é", "x", "\n", "ing", "tion", "a"]) for _ in range(n))
    shared = [text(rng.randrange(10, 80)) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.4 else text(rng.randrange(30)) for _ in range(rng.randrange(5))]
        rows.append((k, "".join(parts)))
    rows += [(k + 200, rows[k][1]) for k in range(0, 40, 3)] + [(3, rows[50][1]), (300, None), (301, ""), (302, "ab" * 300), (303, "ba" * 100), (304, "z" * 49), (305, "z" * 49), (306, "q" * 50), (307, "q" * 50)]
    rng.shuffle(rows)
    return rows


def result(df):
    n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    got = df.select("doc_id", (F.octet_length("kept") + n).alias("b"), n, F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted(map(tuple, got))


def test_against_brute_force(spark):
    for seed, size in ((1, 300), (2, 4000)):
        rows = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert result(S.dedup_substrings(docs, batch_bytes=size)) == brute(rows)


def test_query_columns(spark, tmp_path):
    rows = made(3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op2_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_long_texts(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(1, "".join(rng.choice("abcdefgh ") for _ in range(150_000)) + passage), (2, passage + "x"), (3, "y" * 100_000)]
    assert result(S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=2000)) == brute(rows)


def test_empty_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "a" * 60, 1), (None, "a" * 60, 2), (5, "a" * 60, 3)], "doc_id long, text string, spans int")
    got = {(r["doc_id"], len(r["kept"])) for r in S.dedup_substrings(docs).collect()}
    assert got == {(5, 60), (None, 0)}
    assert S.dedup_substrings(docs.limit(0)).count() == 0
