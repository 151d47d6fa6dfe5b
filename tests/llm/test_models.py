"""Held-out accuracy, brute-force code lengths and odd rows of the two models."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rawframe.llm import language as L
from rawframe.llm import quality as Q
from rawframe.llm.common import held_out
from rawframe.llm.kernels import utf8

rng = random.Random(11)
SOUNDS = {"aa": ["ka", "to", "ri", "mé"], "bb": ["sch", "en", "über", "ung"]}


def prose(lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def brute_length(texts, probe):
    """Method C by the definition, from the texts themselves."""
    counts = {}
    for t in texts:
        b = t.encode()
        for i, x in enumerate(b):
            for order in range(min(i, 3) + 1):
                own = counts.setdefault(b[i - order : i], {})
                own[x] = own.get(x, 0) + 1
    total, b = 0.0, probe.encode()
    for i, x in enumerate(b):

        def p(order):
            if order < 0:
                return 1 / 256
            here = counts.get(b[i - order : i])  # noqa: B023
            if not here:
                return p(order - 1)
            n, kinds = sum(here.values()), len(here)
            return here[x] / (n + kinds) if x in here else kinds / (n + kinds) * p(order - 1)  # noqa: B023

        total -= math.log(p(min(i, 3)))
    return total


SCRIPTS = {"el": "αβγδεζηθικ", "ja": "日本語の文字列かなカ", "ka": "აბგდევზთიკ", "ru": "абвгдежзик", "uk": "абвгдежзії"}


def script(lang, words):
    return " ".join("".join(rng.choice(SCRIPTS[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(words))


def test_code_lengths_follow_the_definition(spark):
    texts = {"aa": [prose("aa", 30), "k", ""], "bb": [prose("bb", 30), "zé"], "ja": [script("ja", 30)]}
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, own) in enumerate((x, [t]) for x, o in texts.items() for t in o) for t in own], "doc_id long, text string, lang string")
    found = L.count_strings(docs).toPandas()
    at = found["at"].to_numpy(np.int64)
    trees = L.compile_trees(sorted(texts), found["lang"].map({x: k for k, x in enumerate(sorted(texts))}).to_numpy(np.int64), at >> 32, at & 0xFFFFFFFF, found["n"].to_numpy(np.int64))
    probes = [prose("aa", 4), prose("bb", 3), script("ja", 5), script("el", 2), "", "xyz€", "k", "ké"]
    got = trees.lengths(*utf8(pa.array(probes)))
    for i, text in enumerate(probes):
        for k, lang in enumerate(sorted(texts)):
            assert math.isclose(got[i, k], brute_length(texts[lang], text), rel_tol=1e-4, abs_tol=1e-5)


def test_five_scripts(spark):
    rows = [(k, script(lang, rng.randrange(1, 30)), lang) for k in range(500) for lang in [rng.choice(list(SCRIPTS))]]
    docs = spark.createDataFrame([r for r in rows if r[1]], "doc_id long, text string, lang string")
    out = L.predict(docs, L.train(docs, 60)).select("row.doc_id", "row.lang", "lang_pred", held_out(F.col("row.doc_id")).alias("h")).where("h").collect()
    # Two share most of their letters: short texts of these may be taken for each other.
    assert all(r["lang"] == r["lang_pred"] for r in out if r["lang"] not in ("ru", "uk")) and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.9


def test_language_on_held_out_rows(spark):
    rows = [(k, prose(lang, rng.randrange(1, 60)), lang) for k in range(300) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 ++", None), (None, "kato", None), (903, prose("aa", 8), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    out = {r["row"]["doc_id"]: r for r in L.predict(docs, L.train(docs)).collect()}
    assert all(out[k]["lang_pred"] == lang for k, _, lang in rows[:300])
    assert [out[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[1]["row"]["score"] == "mine"
    assert L.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in L.predict(docs, None).collect()} == {"und"}
    assert L.predict(docs.limit(0), L.train(docs)).count() == 0


def test_quality_on_held_out_rows(spark):
    good = [(k, ". ".join(prose("aa", 12).capitalize() for _ in range(rng.randrange(1, 9))) + ".", 1) for k in range(0, 500)]
    bad = [(k, " | ".join(prose("aa", 1) for _ in range(60)) if k % 2 else " ".join(w + "$$$" for w in prose("aa", 80).split()), 0) for k in range(500, 580)]
    docs = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + bad if r[0] % 2], "doc_id long, quality int")
    out = {r["row"]["doc_id"]: r["score"] for r in Q.score(docs, Q.train(docs, labels)).collect()}
    held = [r for r in good + bad if r[0] not in {x["doc_id"] for x in labels.collect()}]
    assert np.mean([(out[k] >= Q.THRESHOLD) == q for k, _, q in held]) > 0.97
    odd = spark.createDataFrame([(1, None, 2.0), (None, "", None)], "doc_id long, text string, score double")
    assert all(0 <= r["score"] <= 1 for r in Q.score(odd, Q.train(docs, labels)).collect())
    assert Q.train(docs, labels.limit(0)) is None and Q.keep_good(odd, labels.limit(0)).columns == odd.columns
    assert Q.keep_good(odd, labels.limit(0)).count() == 2
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), labels)).count() == 0


def test_a_repeated_id_is_fitted_once(spark, monkeypatch):
    rows = [(1, prose("aa", 5)) for _ in range(300)] + [(k, prose("bb", 5)) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    ids = [r["doc_id"] for r in docs.where(~held_out(F.col("doc_id"))).select("doc_id").distinct().collect()]
    assert 1 in ids
    sizes = []
    monkeypatch.setattr(Q, "fit", lambda positive, unlabelled, prior: sizes.append((len(positive), len(unlabelled))))
    Q.train(docs, labels)
    Q.train(docs, labels, 5)
    assert sizes[0] == (len({1, 3} & set(ids)), len(ids)) and max(sizes[1]) <= 5


def plain_features(text):
    """The features of one text by loops."""
    from rawframe.llm.kernels import hash_texts

    b = (text or "").encode()
    out = np.zeros(Q.WIDTH)
    for x in b:
        out[x] += 1
    out[:256] = np.sqrt(out[:256] / max(1, len(b)))
    words = re.findall(rb"[^\x00-\x20]+", b)
    if not words:
        return out
    hashes = hash_texts(words)
    for h in hashes.tolist():
        out[256 + h % Q.HASHED] += 1
    out[256 : 256 + Q.HASHED] = np.sqrt(out[256 : 256 + Q.HASHED] / len(words))
    lines = [x for x in b.split(b"\n") if x]
    sizes = [len(w) for w in words]
    mark = lambda x: not (x <= 32 or 65 <= x <= 90 or 97 <= x <= 122 or x >= 128 or 48 <= x <= 57)
    share = lambda test: sum(map(test, b)) / len(b)
    out[256 + Q.HASHED :] = [
        np.mean(sizes) / 10,
        np.std(sizes) / 10,
        len(set(words)) / len(words),
        len(set(lines)) / len(lines),
        np.mean([mark(w[-1]) for w in words]),
        np.mean([mark(w[0]) for w in words]),
        np.mean([n == 1 for n in sizes]),
        sum(a == c for a, c in zip(words, words[1:])) / len(words),
        share(lambda x: 65 <= x <= 90),
        share(lambda x: 48 <= x <= 57),
        share(mark),
        math.log1p(len(b)) / 10,
        math.log1p(len(words) / len(lines)) / 5,
    ]
    return out


def test_features_by_loops():
    texts = ["One two two. Three!\n\nfour 5 six\nfour 5 six", None, "", " \n ", "é" * 40 + " A b", "word " * 300, "#a $b c% 12 X"]
    got = Q.features(*utf8(pa.array(texts)))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-5)


@pytest.mark.parametrize("back", [False, True])
def test_the_gradient_is_that_of_the_risk(back):
    maker = np.random.default_rng(3)
    p, u = maker.normal(2.0 if back else 0.4, 1, (40, 5)), maker.normal(0, 1, (60, 5))
    w, b, prior = np.full(5, 0.5), 0.1, 0.9 if back else 0.3
    negative = lambda w, b: np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
    risk = lambda w, b: prior * np.logaddexp(0, -(p @ w + b)).mean() + negative(w, b)
    assert (negative(w, b) < 0) == back
    goal = (lambda w, b: -negative(w, b)) if back else risk
    slope = [(goal(w + e * 1e-5, b) - goal(w - e * 1e-5, b)) / 2e-5 for e in np.eye(5)]
    g, gb = Q.gradient(p, u, w, b, prior)
    assert np.allclose(g, slope, atol=1e-6) and math.isclose(gb, (goal(w, b + 1e-5) - goal(w, b - 1e-5)) / 2e-5, abs_tol=1e-6)
