import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rawframe.llm import jaccard as J
from rawframe.llm.components import components


def gram_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, percent):
    sets = [gram_set(t, width) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), 1 << 62), i)
    return sorted((i, len(s), least[top(k)], links[k]) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randrange(60))
    line = [word() for _ in range(7)]
    bases = [[word() for _ in range(rng.choice([3, 5, 8, 12, 18, 30, 60, 120]))] for _ in range(14)]
    rows = []
    for k in range(150):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(1, 50))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
            words = words or [word()]
        if rng.random() < 0.4:
            words += line
        rows.append((k, "  ".join(w.upper() if rng.random() < 0.3 else w for w in words)))
    rows += [(200, rows[3][1]), (7, rows[60][1]), (201, ""), (202, None), (203, " \n"), (204, "a1 é"), (205, "A1 é")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width,percent,long_list,family", [(1, 4, 85, 3, 8), (2, 3, 80, 50, 1000)])
def test_against_brute_force(spark, monkeypatch, seed, width, percent, long_list, family):
    if seed == 1:
        monkeypatch.setattr(J, "SLICE_GRAMS", 200)
        monkeypatch.setattr(J, "PAIRED_LIST", 4)
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.jaccard_join(docs, width, percent, long_list, family).collect()
    assert sorted(map(tuple, got)) == brute(rows, width, percent)


def test_one_large_family_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w for w in base[: rng.randrange(30, 61)] if rng.random() < 0.99)) for k in range(120)]
    rows += [(500 + k, " ".join(base[:40])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, J.jaccard_join(docs, 1, 85, 2, 7).collect())) == brute(rows, 1, 85)


def test_subsets_of_light_sets_meet():
    for percent in (80, 85):
        for light in (6, 12, 16):
            for n in range(1, light + 1):
                for m in range(n, light + 1):
                    if 100 * n >= percent * m:
                        c = J.overlap(n, m, percent)
                        assert c in J.subset_sizes(n, light, percent) and c in J.subset_sizes(m, light, percent)


def test_the_boundary_has_the_least_cost():
    sizes = {n: 100 for n in range(1, 40)}
    assert J.boundary(sizes, 1.0, 85) == 0 and J.boundary({}, 3.0, 85) == 0
    found = [J.boundary(sizes, x, 85) for x in (2.0, 3.0, 50.0, 5000.0)]
    assert found == sorted(found) and found[0] >= 7 and found[-1] > 14
    # The largest of these light sets shows its subsets less one.
    assert len(J.subset_keys(np.arange(13, dtype=np.uint64), 13, 85)) == 13


def test_light_sets_alone_find_all_links(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, " ".join(str(x) for x in sorted(rng.sample(range(14), rng.randrange(9, 14))))) for k in range(60)]
    monkeypatch.setattr(J, "boundary", lambda *_: 14)
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()
    assert sorted(map(tuple, got)) == brute(rows, 1, 85)
    assert any(r["n_links"] for r in got)


def test_sets_are_not_exchanged_to_find_equal_ones(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(1000))) for k in range(200)]
    rows += [(1000 + k, "  ".join(t.upper().split())) for k, t in rows[:50]]
    written, stage = [], J.stage_table

    def total():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    def staged(df, name):
        before = total()
        out = stage(df, name)
        if name == "sets":
            written.append((total() - before, out.agg({"n": "sum"}).first()[0], out.count()))
        return out

    monkeypatch.setattr(J, "stage_table", staged)
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k % 1000 for k, _ in rows}
    (sent, grams, classes), = written
    assert classes == 200 and 0 < sent < 8 * grams  # an n-gram's number has eight bytes, a word here two


def test_only_texts_with_copied_sets_are_exchanged(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(1000))) for k in range(200)] + [(1000, ""), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, stage = {}, J.stage_table

    def total():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    def staged(df, name):
        before = total()
        out = stage(df, name)
        written.setdefault(name, total() - before)
        return out

    monkeypatch.setattr(J, "stage_table", staged)
    # Of copied texts one goes: here some 300 000 bytes, where three tasks would send that each.
    for several, most in ((1, 20_000), (5, 400_000)):
        written.clear()
        copied = docs.selectExpr("doc_id", "text", f"explode(sequence(0, {several - 1})) AS k").selectExpr("doc_id + 10000 * k AS doc_id", "text").repartition(3).cache()
        got = J.jaccard_join(copied).collect()
        assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in got if r["doc_id"] % 10000 < 1000} == {k + 10000 * c: (k, several - 1) for k, _ in rows[:200] for c in range(several)}
        assert written["sets"] < most, several


@pytest.mark.parametrize("bits", [6, 25])
def test_small_filters_lose_no_set(spark, monkeypatch, bits):
    monkeypatch.setattr(J, "SIEVE", bits)
    rows = made(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.jaccard_join(docs).collect())) == brute(rows, 4, 85)


def test_light_sets_show_no_more_subsets_the_longer_the_lists_are():
    sizes = {n: 100 for n in range(1, 60)}
    for times in (1, 10, 100):
        grown = {n: k * times for n, k in sizes.items()}
        grams = sum(n * k for n, k in grown.items())
        light = J.boundary(grown, 50.0 * times, 85, grams / J.GRAMS_A_SUBSET)
        assert light > 0 and sum(k * J.shown(n, light, 85) for n, k in grown.items() if n <= light) <= grams / J.GRAMS_A_SUBSET


def test_very_long_texts(spark):
    long = " ".join(f"w{k % 70000}" for k in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 3_000_000), (4, "X" * 3_000_000 + " "), (5, long[: len(long) // 2])]
    got = {r["doc_id"]: tuple(r) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][2] == got[2][2] == 1 and got[3] == (3, 1, 3, 1) and got[4] == (4, 1, 3, 1) and got[1][1] == 70_000


def test_empty_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (None, "x")], "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_join(docs).collect()), key=str)
    assert got == sorted([(None, 2, 4, 2), (None, 2, 4, 2), (4, 2, 4, 2), (None, 1, None, 0)], key=str)
    assert J.jaccard_join(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(k + 1, k) for k in range(40)] + [(100, 50), (50, 75), (60, 60)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {50: 50, 75: 50, 100: 50}


def test_keep_first_keeps_all_columns(spark):
    rows = [(5, "a b c d e f g h", "x", 1), (2, "a b c d e f g h", None, 2), (2, "A b c d e f g h", "twice", 3), (9, None, "n", 4), (10, "", "e", 5), (None, "q r s t u é", "z", 6)]
    rows += [(None, None, "both", 7), (None, None, "both", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n int").repartition(2)
    kept = J.keep_first(docs, 5, 80)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert len(got) == 6 and {r["n"] for r in got} in ({2, 4, 5, 6, 7}, {3, 4, 5, 6, 7})
    assert {(r["doc_id"], r["text"]) for r in got if r["n"] > 3} == {(9, None), (10, ""), (None, "q r s t u é"), (None, None)}


def _batch(sets):
    grams = pa.array([np.sort(x).tobytes() for x in sets], pa.binary())
    return pa.record_batch([pa.array(range(len(sets)), pa.int64()), grams], ["rep", "grams"])


def _edges_of(blocks, percent=85):
    by = {}
    for bucket, block in blocks:
        by.setdefault(bucket, []).append(block)
    found = [J._list_edges(pa.table({"bucket": pa.array([k] * len(v), pa.int64()), "block": pa.array(v, pa.binary())}), percent).to_pydict() for k, v in by.items()]
    return sorted(x for f in found for x in zip(f["a"], f["b"], f["met"], f["least"]))


_NONE_LAST = (np.empty(0, np.uint64), np.empty(0, np.int32))


def test_many_subsets_are_listed_a_part_at_a_time():
    rng = np.random.default_rng(5)
    batch = _batch([rng.integers(0, 2**63, 29, dtype=np.uint64) for _ in range(100)])
    tracemalloc.start()
    n = sum(len(block) > 0 for _, block in J._list_rows(batch, 85, 3, _NONE_LAST, 33))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 2.8 million subsets: in one part they took more than 300 MB.
    assert n >= 8 and peak < 150 << 20


def test_parts_of_lists_and_of_pairs_change_no_edge_that_counts(monkeypatch):
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (12, 15, 40, 60)]
    sets = [np.unique(np.append(b[k % 2 :], rng.integers(0, 2**63, k % 3, dtype=np.uint64))) for b in base for k in range(6)]
    batch = _batch(sets)
    pairs = lambda light: _edges_of(J._list_rows(batch, 85, 2, _NONE_LAST, light))
    whole, heavy = pairs(16), pairs(0)
    monkeypatch.setattr(J, "SLICE_ENTRIES", 40)
    monkeypatch.setattr(J, "PAIRED_ENTRIES", 8)
    monkeypatch.setattr(J, "MOST_PAIRS", 4)
    parts = pairs(16)

    def families(edges):
        label = list(range(len(sets)))
        met = {}
        for a, b, m, least in edges:
            was = met.get((a, b), (0, least))
            met[a, b] = (was[0] + m, min(was[1], least))
        for _ in sets:
            for (a, b), (m, least) in met.items():
                if m >= least:
                    label[a] = label[b] = min(label[a], label[b])
        return label

    assert families(parts) == families(whole) and len(set(families(whole))) < len(sets)
    # Without light sets there are no stars here, and all pairs are the same.
    assert pairs(0) == heavy != []
