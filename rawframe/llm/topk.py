"""Exact top-k by inner product, with MaxScore over shards of inverted lists.

A vector's components are term weights. A shard keeps, for each term, the weights of its
vectors and their greatest and least; these bound what the term can add to a query's score.
A query's terms are split by the score to beat: the essential ones, and those whose bounds
together can't reach it. Essential lists are traversed for all vectors, the others are probed
only for vectors that still can compete. Shards' results are merged.

Queries meet the shards in blocks: every block of queries is sent once to every shard, and a shard
once to every MET blocks of queries, so what a task holds is bounded on both sides.

Defined results: vectors that are null or hold null or non-finite components take no part, nor
do rows without an id; a shorter vector lacks the further terms; rows with a query's own id
aren't its candidates; of several rows with a query's id the least vector asks; an empty table
gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, tidy
from .packed import pack, unpack

K = 20
SCALE = 64
EVERY = 20
SHARD_ROWS = 4096
QUERY_ROWS = 256
#: Blocks of queries that meet a shard in one task.
MET = 64
#: Vectors scored in full for a first score to beat.
SEED_ROWS = 256


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    rows = vectors.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _packed(table: pa.Table) -> pa.Table:
    """One row a block: ids and vectors."""
    block = pack(table.column("id").to_numpy(), _matrix(table.column("v")))
    return pa.table({"block": table.column("block")[:1], "rows": pa.array([block], pa.binary())})


class Shard:
    """Inverted lists of some vectors: a row of weights a term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.lists = ids[order], np.ascontiguousarray(vectors[order].T)
        self.high = self.lists.max(1, initial=0) if len(ids) else np.zeros(vectors.shape[1], np.int64)
        self.low = self.lists.min(1, initial=0) if len(ids) else self.high
        self.most = float(np.abs(self.lists).max(initial=0))

    def top(self, own: int, query: np.ndarray, k: int, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores), ties to smaller ids. lists: this shard's, in a type that holds all sums exactly."""
        n, terms = len(self.ids), min(len(query), len(self.lists))
        q = query[:terms].astype(lists.dtype)
        bounds = np.maximum(q * self.high[:terms], q * self.low[:terms])
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        seed = min(n, max(SEED_ROWS, 4 * k))
        scores = np.full(n, -np.inf) if lists.dtype.kind == "f" else np.full(n, np.iinfo(np.int64).min)
        scores[:seed] = q @ lists[:terms, :seed]
        done = scores[:seed][self.ids[:seed] != own]
        if seed < n:
            beat = np.partition(done, -k)[-k] if len(done) >= k else None
            idle = 0 if beat is None else int(np.searchsorted(reach, beat, "left"))  # bounds of order[:idle] add up to less
            essential, others = order[idle:], order[:idle]
            part = q[essential] @ lists[essential, seed:]
            at = np.arange(seed, n)
            for step in range(0, idle, 8):  # the greatest bounds first, while a vector can compete
                alive = part >= beat - reach[idle - step - 1]
                at, part = at[alive], part[alive]
                probe = others[::-1][step : step + 8]
                part = part + q[probe] @ lists[np.ix_(probe, at)]
            scores[at] = part
        mine = np.flatnonzero((self.ids != own) & (scores > (-np.inf if lists.dtype.kind == "f" else np.iinfo(np.int64).min)))
        best = mine[np.lexsort((self.ids[mine], -scores[mine]))[:k]]
        return self.ids[best], scores[best].astype(np.int64)


def _scored(shards: pa.Table, asking: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): the k best of one shard for each query of some blocks."""
    out: list[tuple] = []
    if shards.num_rows:
        shard = Shard(*unpack(shards.column("rows")[0].as_py()))
        lists: dict[type, np.ndarray] = {}
        for block in asking.column("asking"):
            ids, queries = unpack(block.as_py())
            most = shard.most * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
            kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
            if kind not in lists:
                lists[kind] = shard.lists.astype(kind)
            for i, q in zip(ids, queries):
                found, scores = shard.top(int(i), q, k, lists[kind])
                out.append((np.full(len(found), i), found, scores))
    empty = np.empty(0, np.int64)
    return pa.table({name: pa.array(np.concatenate([x[j] for x in out] or [empty]), pa.int64()) for j, name in enumerate(("query_id", "vec_id", "score"))})


def _blocked(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v", "copy"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(tidy(_packed), "block int, rows binary"), blocks


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (id bigint, v array<bigint>) of both sides."""
    # No query has more than k of equal rows among its best; these are dealt apart, so no shard gets them all.
    equal = candidates.groupBy("id", "v").agg(F.count("*").alias("n"))
    shards, n = _blocked(equal.select("id", "v", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(k)))).alias("copy")), shard_rows)
    asking, m = _blocked(queries.select("id", "v", F.lit(1).cast("bigint").alias("copy")), query_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = asking.select(F.col("rows").alias("asking"), F.floor(F.col("block") / MET).cast("int").alias("part"), every(n).alias("block"))
    held = shards.select("block", "rows", every(-(-m // MET)).alias("part"))
    met = held.groupBy("block", "part").cogroup(sent.groupBy("block", "part"))
    found = met.applyInArrow(tidy(lambda s, q: _scored(s, q, k)), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def weights(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.exists("embedding", bad))
    vectors = rows.select(F.col("vec_id").cast("bigint").alias("id"), weights(F.col("embedding")).alias("v"))
    asking = vectors.where(F.col("id") % EVERY == 0).groupBy("id").agg(F.min("v").alias("v"))
    return top_k(asking, vectors)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
