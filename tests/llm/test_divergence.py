import re
from collections import Counter, defaultdict

import duckdb
import pytest

from rawframe.llm import divergence

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def by_definition(rows, least=3, top=200):
    """Loops over every kept term of every group."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        has = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in has if has[t] >= least)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if has[t] >= least)
        whole = sum(counts.values(), Counter())
        weigh = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: weigh(c) for s, c in counts.items()}, weigh(whole)
        for s in p:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in p if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered) if part == "pair" or k < top]
    return sorted(out)


def rows():
    words = ["the", "The", "THE", "Éa", "éa", "straße", "k", "x1y", "中文", "don't", "zz", "a_b", "İ", "K"]
    out = [(["en", "fr", None][k % 3], ["a", "b", "", None, "é", "Z"][k * k % 7 % 6], " ".join(words[(k * j + j) % (3 + k % 12)] for j in range(k % 9))) for k in range(80)]
    out += [("en", "silent", None), ("en", "silent", ""), ("de", "only", "once twice"), ("de", "other", "once"), ("xx", "alone", "w w w"), ("xx", "alone", "w"), ("xx", "alone", "w")]
    return out + [("en", "a", "the zz " * 500)] * 3


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), "lang string, source string, text string").repartition(3)


def test_against_the_definition(spark, docs):
    made = divergence.divergence(docs).select(*COLUMNS)
    assert sorted(map(tuple, made.collect())) == by_definition(rows())
    assert dict(made.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_shards_parts_and_few_ranks(spark, docs, monkeypatch):
    monkeypatch.setattr(divergence, "COUNTED_TERMS", 5)
    monkeypatch.setattr(divergence, "SHARD_COUNTS", 20)
    assert sorted(map(tuple, divergence.divergence(docs, top=2).collect())) == by_definition(rows(), top=2)


def test_sql_says_the_same(spark):
    db = duckdb.connect()
    made = spark.createDataFrame(rows(), "lang string, source string, text string").toArrow()  # noqa: F841
    db.execute("CREATE VIEW documents AS FROM made")
    assert sorted(map(tuple, db.execute(divergence.OP12_SQL).fetchdf()[list(COLUMNS)].values.tolist())) == by_definition(rows())


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, terms = 3_000_000_000_000, 9_000_000_000_000, 7
    made = spark.range(1).select(divergence.weight(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()["p"]
    assert made == 1 + 10**9 * (n + 1) // (total + terms)


def test_empty_and_other_columns(spark, docs):
    assert divergence.divergence(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS term", "2 AS n", "3 AS shard")
    assert sorted(map(tuple, divergence.divergence(clash).collect())) == by_definition(rows())
