import hashlib
import random
import re

from pyspark.sql import functions as F

from rawframe.llm import decontaminate as D

WORDS = re.compile(D.WORD_PATTERN)


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for k in range(len(own) - n + 1):
                if own[k : k + n] == w[i : i + n]:
                    hit |= set(range(k, k + n))
                    names.add(str(name))
    ids = sorted(names)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "É", "été", "cc", "1", "z9"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "-", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 4, 12, 13, 14, 30]))) for k in range(8)] + [(3, "a b A"), (9, None), (10, "...")]
    docs = [(k, text(rng.choice([0, 1, 5, 40, 200])) + (rng.choice(items)[1] or "") + text(rng.choice([0, 9]))) for k in range(60)]
    return docs + [(60, None), (61, ""), (0, docs[0][1])], items


def test_against_brute_force_in_one_and_several_parts(spark):
    for seed, window, most in ((1, 13, 10**6), (2, 5, 10**6), (3, 5, 40)):
        docs, items = made(seed)
        got = D.judged(D.match_benchmark(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window, max_words=most))
        rows = got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated").collect()
        assert sorted(map(tuple, rows)) == sorted((i, *brute(t, items, window)) for i, t in docs)


def test_filter_keeps_columns_and_clean_rows(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id int, text string")
    docs = spark.createDataFrame([(1, " ".join(f"W{k}" for k in range(15)), "x"), (2, "w1 w2 w3", "y"), (None, None, None)], "doc_id long, text string, n_words string")
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(2, "w1 w2 w3", "y"), (None, None, None)]
    assert D.decontaminate(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == 3


def test_a_repeated_item_is_read_once(spark):
    docs, items = made(4)
    frame = lambda x: spark.createDataFrame(x, "item_id long, text string")
    many = frame(items * 200)
    assert len(list(D.automata(many, 13, 10_000))) == len(list(D.automata(frame(items), 13, 10_000)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    read = lambda b: sorted((r["doc_id"], r["n_words"], [tuple(s) for s in r["hit_spans"]], r["items"]) for r in D.match_benchmark(rows, b, 5).collect())
    assert repr(read(many)) == repr(read(frame(items)))
