"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents labelled good), unlabelled web text (documents drawn whatever
their label) and an estimated class prior give a non-negative unbiased risk: the positives'
part of the unlabelled loss is taken off, and where that leaves less than nothing the step
goes back. The model is linear in bounded features of the text's bytes.

The classifier is fitted on at most MOST_FITTED positives and as many unlabelled documents,
drawn by a hash of their ids, and of rows with the same id one, drawn by a hash of the text;
every document is scored.

Defined results: null and empty texts have all features zero and are scored like any other (a text
without words has those of its bytes only); a very long text is one row, scored whole in its task;
where nothing is labelled good all scores are 1 (there is nothing to reject by); repeated rows
give repeated results; several labels of a document count as the lowest; an empty table gives
no rows; extra columns go through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_arrow, read_table, shared
from .kernels import Hasher, byte_class, slices, spans_of, utf8

MOST_FITTED = 6_000
THRESHOLD = 0.7
HASHED = 256
STEPS = 400
_SPACE = byte_class(r"[\x00-\x20]")
_UPPER, _LOWER, _DIGIT = byte_class("[A-Z]"), byte_class(r"[a-z\x80-\xFF]"), byte_class("[0-9]")
_MARK = ~(_SPACE | _UPPER | _LOWER | _DIGIT)
SHAPES = 13
WIDTH = 256 + HASHED + SHAPES


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a text: shares of bytes, of hashed words, and shapes of words and lines."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    size = np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    per = 1 / np.maximum(size, 1)
    count = lambda inside: np.bincount(of, weights=inside[data], minlength=n) * per
    histogram = np.bincount(of * 256 + data, minlength=256 * n).reshape(n, 256)
    out[:, :256] = np.sqrt(histogram * per[:, None])
    starts, ends, doc = spans_of(~_SPACE[data], offsets)
    if len(starts):
        words = np.maximum(np.bincount(doc, minlength=n), 1)
        hashes = Hasher(data).of(starts, ends)
        out[:, 256 : 256 + HASHED] = np.sqrt(np.bincount(doc * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=HASHED * n).reshape(n, HASHED) / words[:, None])
        mean = lambda x: np.bincount(doc, weights=x, minlength=n) / words
        length = (ends - starts).astype(float)
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])])
        pairs = np.unique(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ hashes, return_index=True)[1]
        lines, stops, line_doc = spans_of(data != 10, offsets)
        line_hashes = Hasher(data).of(lines, stops)
        distinct = np.unique(line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ line_hashes, return_index=True)[1]
        per_line = np.maximum(np.bincount(line_doc, minlength=n), 1)
        out[:, 256 + HASHED :] = np.stack(
            [
                mean(length) / 10,
                np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10,
                np.bincount(doc[pairs], minlength=n) / words,
                np.bincount(line_doc[distinct], minlength=n) / per_line,
                mean(_MARK[data[ends - 1]]),
                mean(_MARK[data[starts]]),
                mean(length == 1),
                mean(again),
                count(_UPPER),
                count(_DIGIT),
                count(_MARK),
                np.log1p(size) / 10,
                np.log1p(words / per_line) / 5,
            ],
            axis=1,
        )
        # A text without words has no shapes, whatever texts it is among.
        out[np.bincount(doc, minlength=n) == 0, 256 + HASHED :] = 0
    return out


@dataclass
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.middle) / self.spread, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[np.ndarray, float]:
    """Which way the risk grows, by weights and bias: of prior * R+(p) + R-(u) - prior * R-(p), and where
    the unlabelled part (the last two) is below nothing, of that part turned round: the step goes back."""
    zp, zu = p @ w + b, u @ w + b
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    back = np.logaddexp(0, zu).mean() < prior * np.logaddexp(0, zp).mean()
    gp, gu = -prior * sp / len(p), su / len(u)
    gp, gu = (-gp, -gu) if back else (gp + prior * (sp - 1) / len(p), gu)
    return p.T @ gp + u.T @ gu, float(gp.sum() + gu.sum())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, decay: float = 1e-3, rate: float = 0.02) -> Model:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) under logistic loss."""
    middle, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    scaled = lambda x: np.clip((x - middle) / spread, -6, 6).astype(np.float32)
    p, u = scaled(positive), scaled(unlabelled)
    w, b = np.zeros(p.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = gradient(p, u, w, b, prior)
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w = (w - rate * (m / a) / (np.sqrt(v / c) + 1e-8)).astype(np.float32)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return Model(middle, spread, w, b, prior)


def _with_features(docs: DataFrame) -> DataFrame:
    """docs' other columns with the features of text as 32-bit floats."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            rows = [r.tobytes() for i, j in slices(offsets) for r in features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(rows, pa.binary())], [*kept, "features"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "features binary"])
    return map_arrow(docs, run, schema)


def _drawn(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` of rows with distinct ids, drawn by a hash of doc_id."""
    n = rows.count()
    share = min(1.0, 0.95 * most / max(n, 1)) if n > most else 1.0
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_FITTED) -> Model | None:
    """The model, from rows that aren't held out; None without any positive."""
    own = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = own.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not good:
        return None
    #: The share of good ones among the labelled, kept inside (0, 1).
    prior = (good + 1) / (n + 2)
    rows = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    sets = _drawn(own.where("quality = 1").select("doc_id"), most, 1).withColumn("kind", F.lit("p"))
    sets = sets.unionByName(_drawn(rows.select("doc_id").distinct(), most, 2).withColumn("kind", F.lit("u")))
    # 2 * most ids at most, each with one row, and so many rows of features come to the driver.
    one = F.min(F.struct(F.xxhash64("text").alias("at"), "text")).alias("one")
    met = rows.join(F.broadcast(sets), "doc_id").groupBy("doc_id", "kind").agg(one).select("doc_id", "kind", "one.text")
    drawn = _with_features(met).select("doc_id", "kind", "features").toPandas()
    drawn = drawn.sort_values(["kind", "doc_id"], kind="stable")
    matrix = lambda kind: np.frombuffer(b"".join(map(bytes, drawn[drawn.kind == kind].features)), np.float32).reshape(-1, WIDTH)
    positive, unlabelled = matrix("p"), matrix("u")
    return fit(positive, unlabelled, prior) if len(positive) and len(unlabelled) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, score): each row of docs as a struct, and its score."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    if model is None:
        return whole.select("row", F.lit(1.0).alias("score"))
    sent = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            scores = [own.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], ["row", "score"])

    return map_arrow(whole, run, f"row {whole.schema['row'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    return score(docs, train(docs, labels)).where(F.col("score") >= threshold).select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
