"""The corpus pipeline: each stage applies one operator to all that the stage before has kept.

Documents keep their columns up to the last stage; n_chars follows the text. An empty table goes
through every stage as an empty table. run() keeps what a stage's operators share and stage until the
stage is written. A stage called by itself keeps it until the next one called so: its result has to be
written by then. Nothing else's tables are touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawframe.llm import bpe, decontaminate, jaccard, line_dedup, quality
from rawframe.llm.common import Scope, current_scope, read_table, scope, stage_table, using

#: Near duplicates: sets of five words, similarity from 80 %.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: What the last stage that was called by itself has made.
_ALONE: list[Scope] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _owned(stage: Stage) -> Stage:
    """The stage in the scope around it, or else in one that goes when the next stage is called by itself."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if current_scope() is not None:
            return stage(spark, docs, sf_dir)
        while _ALONE:
            _ALONE.pop().close()
        _ALONE.append(Scope(spark))
        with using(_ALONE[-1]):
            return stage(spark, docs, sf_dir)

    return run


@_owned
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like any other; ties at the threshold stay; repeated rows
    share their verdict; without labels all stay; a very long text is one row, scored whole."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


@_owned
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that had no others.

    Null and empty texts have no lines and stay; of repeated rows the first keeps its lines (by
    doc_id, null last, then place); a very long text is a batch of its own."""
    return line_dedup.drop_repeated(docs).withColumn("n_chars", F.length("text").cast("bigint"))


@_owned
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Texts without words (null, empty) all stay; of repeated rows one does; a null id sorts last;
    a very long text is one row with one set."""
    return jaccard.keep_first(docs, NEAR_WIDTH, NEAR_PERCENT)


@_owned
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go.

    Null and empty texts are clean; repeated rows share their verdict; very long texts are
    streamed whole."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


#: The columns that the last stage adds; columns of documents with these names are replaced.
ADDED = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")


@_owned
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids (little-endian 32-bit numbers), and digests of them and of the decoded text.

    All rows stay, repeated ones too; null and empty texts have no ids; the text itself is left
    out; a very long text is encoded whole."""
    lowered = {c.lower() for c in ADDED}
    others = [c for c in docs.columns if c != "text" and c.lower() not in lowered]
    return bpe.tokenized(docs.select(*others, "text")).select(
        "row.*",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", good_quality),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("tokens", tokens),
]

#: A learned classifier and a tokenizer's merges have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again.

    Only what the result is read from is left: it belongs to the scope around the call, if there is one."""
    docs = read_table(spark, sf_dir, "documents")
    before: Scope | None = None
    for name, stage in STAGES[:-1]:
        # The written stage is the next one's input and goes when that is written.
        kept = Scope(spark)
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            with using(kept):
                docs = stage_table(made, f"pipeline-{name}")
        if before is not None:
            before.close()
        before = kept
    return _last(spark, docs, sf_dir, before)


def _last(spark: SparkSession, docs: DataFrame, sf_dir: str, before: Scope | None) -> DataFrame:
    """The last stage, which isn't written here: its input and what it shares go with the caller's scope."""
    around = current_scope()
    own = around if around is not None else Scope(spark)
    if around is not None and before is not None:
        around.takes(before)
    with using(own):
        return STAGES[-1][1](spark, docs, sf_dir)
