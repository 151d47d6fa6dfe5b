import random

import numpy as np

from rawframe.llm import topk as T


def brute(queries, rows, k):
    out = []
    for i, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    for seed_rows, scale, lengths in ((4, 3, (8,)), (300, 40, (8, 5, 0)), (4, 1 << 28, (8,))):
        T.SEED_ROWS, old = seed_rows, T.SEED_ROWS
        rows = [(k, [rng.randrange(-scale, scale) for _ in range(rng.choice(lengths))]) for k in range(230)] + [(3, [1] * lengths[0])]
        queries = [rows[k] for k in range(0, 230, 20)]
        frame = lambda x: spark.createDataFrame(x, "id long, v array<long>").repartition(3)
        try:
            got = T.top_k(frame(queries), frame(rows), 7, 50, 4).collect()
        finally:
            T.SEED_ROWS = old
        assert sorted(map(tuple, got)) == brute(queries, rows, 7)


def test_shard_prunes_exactly():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-20, 20, (3000, 64))
    shard = T.Shard(np.arange(3000), vectors)
    for q in range(0, 3000, 300):
        ids, scores = shard.top(q, vectors[q], 20, shard.lists.astype(np.float32))
        exact = vectors @ vectors[q]
        order = [x for x in np.lexsort((np.arange(3000), -exact)) if x != q][:20]
        assert ids.tolist() == order and scores.tolist() == exact[order].tolist()


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5]), (1, [0.25, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [0.25, 0.0]), (20, [0.015, -0.015])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, T.op6_topk(spark, str(tmp_path)).collect()))
    assert got == [(0, 1, 1, 512), (0, 2, 6, 512), (0, 3, 20, 32), (20, 1, 0, 32), (20, 2, 1, 0), (20, 3, 6, 0)]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert T.op6_topk(spark, f"{tmp_path}/none").count() == 0


def test_equal_rows_are_dealt_apart(spark):
    rows = [(1, [3, 3])] * 300 + [(k, [k % 5, 1]) for k in range(2, 40)]
    queries = [(0, [1, 1]), (1, [2, 0])]
    frame = lambda x: spark.createDataFrame(x, "id long, v array<long>").repartition(4)
    got = sorted(map(tuple, T.top_k(frame(queries), frame(rows), 6, 8, 1).collect()))
    assert got == brute(queries, rows, 6)
    copies = frame(rows).groupBy("id", "v").count().selectExpr("id", "v", "explode(sequence(1L, least(count, 6L))) AS copy")
    blocks, n = T._blocked(copies, 8)
    assert n > 4 and blocks.where("block is not null").count() > 3
