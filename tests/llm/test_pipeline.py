import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rawframe.llm import quality

from . import test_decontaminate, test_jaccard, test_line_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    return [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]


def test_against_brute_force(spark, result):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["row"]["doc_id"]: r["score"] for r in quality.score(documents, quality.train(documents, labels)).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect() if scores[r["doc_id"]] >= quality.THRESHOLD)
    full = dict(rows)
    rows = [(i, t) for i, t in test_line_dedup.brute(rows, 8) if t.strip("\n ") or not full[i].strip("\n ")]
    groups = test_jaccard.brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if any(g[0] == i and g[2] == i for g in groups)]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not test_decontaminate.brute(t, items)[-1]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        want[i] = (len(t), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result} == want
    assert 0 < len(want) < documents.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens string, row int, score double, contaminated string"


def test_stages_on_odd_rows(spark):
    long = " ".join(f"w{k % 9000}" for k in range(40_000))
    line = "one two three four five six seven eight nine"
    rows = [(1, None), (2, ""), (None, line), (3, line), (3, line), (None, None), (4, long), (5, long + " end"), (6, "é\n\n" + line), (7, " \n "), (8, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, None, "s", 1, "mine", "kept", k, 0.5, "no") for k, (i, t) in enumerate(rows)], ODD)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            got = out.collect()
            if name != "tokens":
                assert out.dtypes == docs.dtypes, name
        kept = {r["row"] for r in stage(spark, docs, SF).collect()}
        if name in ("quality", "lines", "near_duplicates"):
            assert name == "quality" or {0, 1, 5, 9} <= kept
        if name == "lines":
            assert 3 in kept and not {2, 4} & kept and {6, 8, 10} <= kept and 7 not in kept
        if name == "near_duplicates":
            assert len({2, 3, 4} & kept) == 1 and 2 not in kept and 6 in kept and 7 not in kept
        if name in ("benchmark", "tokens"):
            assert kept == set(range(len(rows)))
        if name == "tokens":
            assert sorted(out.columns) == sorted({*docs.columns, *corpus_pipeline.ADDED} - {"text"})
            assert got == [] and {r["n_tokens"] for r in stage(spark, docs, SF).where("row < 2").collect()} == {0}
