import os
import time
from urllib.parse import urlparse

import corpus_pipeline
from rawframe.llm import queries
from rawframe.llm.common import Scope, scope, scratch_dir, shared, stage_table, using

SMALL = "/root/testdata/sf0.001"


def left(spark):
    return set(os.listdir(urlparse(scratch_dir(spark)).path))


def test_a_run_takes_nothing_from_others_and_leaves_nothing(spark, tmp_path):
    names = ["op1_hilbert_shard", "op2_substring_dedup", "op3_bpe", "op9_line_dedup", "op10_jaccard", "op12_divergence", "op13_alignment"]
    open_results = {n: queries.QUERIES[n](spark, SMALL) for n in names}
    before = left(spark)
    with scope(spark):
        corpus_pipeline.run(spark, SMALL).write.parquet(str(tmp_path / "out"))
    assert left(spark) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    for n, df in open_results.items():
        assert df.count() > 0, n


def test_a_result_can_be_read_after_another_run(spark):
    first = corpus_pipeline.run(spark, SMALL)
    corpus_pipeline.run(spark, SMALL).count()
    assert first.count() > 0


def test_stages_by_themselves(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0


def test_scopes_nest(spark):
    outer = Scope(spark)
    with using(outer):
        kept = stage_table(spark.range(3), "own-outer")
        with scope(spark):
            gone = stage_table(spark.range(4), "own-inner")
            shared(spark, 1)
        assert kept.count() == 3
    assert kept.count() == 3
    assert not any(n.startswith("own-inner") for n in left(spark)) and gone is not None
    outer.close()
    assert not any(n.startswith("own-outer") for n in left(spark))


def test_shuffle_files_go_when_a_table_is_staged(spark):
    blocks = lambda: {b.name() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()) if b.name().startswith("shuffle_")}
    before = blocks()
    rows = spark.range(1000).repartition(3)
    staged = stage_table(rows.groupBy((rows.id % 7).alias("k")).count(), "shuffled")
    left_by = time.time() + 20
    while (after := blocks() - before) and time.time() < left_by:
        time.sleep(0.2)
    assert not after and staged.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
