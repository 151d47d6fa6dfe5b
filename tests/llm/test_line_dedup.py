import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rawframe.llm import line_dedup as L
from rawframe.llm.kernels import utf8
from rawframe.llm.packed import Batch, unpack


def words(line):
    return tuple(w for w in re.split(r"[\x00-\x20]+", line) if w)


def apart(a, b):
    """At most one word inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(rows, near):
    """The lines left of each text, by a comparison with every earlier line."""
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    earlier, out = [], []
    for k in order:
        left = []
        for line in (rows[k][1] or "").split("\n"):
            w = words(line)
            if not w or not any(w == e or (len(w) >= near and len(e) >= near and apart(w, e)) for e in earlier):
                left.append(line)
            if w:
                earlier.append(w)
        out.append((rows[k][0], None if rows[k][1] is None else "\n".join(left)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["aa", "bé", "c", "dd", "aa", "e1"])
    base = [[word() for _ in range(rng.randrange(1, 16))] for _ in range(25)]
    rows = []
    for k in range(90):
        lines = []
        for _ in range(rng.randrange(6)):
            w = list(rng.choice(base)) if rng.random() < 0.8 else [word() for _ in range(rng.randrange(1, 14))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
            lines.append(rng.choice(["  ", " ", "\t"]).join(w))
        rows.append((k, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[3][1])]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, size, near in ((1, 200, 5), (2, 100000, 8)):
        rows = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(((r["row"]["doc_id"], r["row"]["text"]) for r in L.dedup_lines(docs, near, size).collect()), key=str)
        want = brute(rows, near)
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        assert not bad, bad[:3]


def test_columns_and_odd_rows(spark):
    line = "one two three four five six seven eight"
    rows = [(None, line, 1, "k"), (5, line + "\nown", 2, None), (7, line.replace("five", "5"), 3, "a"), (8, None, 4, ""), (9, "", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, row string")
    out = L.drop_repeated(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(5, line + "\nown", 2, None), (8, None, 4, ""), (9, "", None, "")], key=str)
    assert L.drop_repeated(docs.limit(0)).count() == 0


def brute_characters(rows, near):
    """The lines left where those of fewer than `near` words are compared by characters."""
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    earlier, out = [], []
    for k in order:
        left = []
        for line in rows[k][1].split("\n"):
            w = words(line)
            c = " ".join(w)
            unit = lambda e: (w, e) if min(len(w), len(e)) >= near else (c, " ".join(e))
            if not any(w == e or (min(map(len, unit(e))) >= near and apart(*unit(e))) for e in earlier):
                left.append(line)
            earlier.append(w)
        out.append((rows[k][0], "\n".join(left)))
    return sorted(out)


def test_short_lines_and_scripts_without_spaces(spark):
    text = "\n".join(["Posted by Ann on 3 May 2021", "版权所有，未经许可不得转载本文内容。", "cat on", "one two three four five six seven eight"])
    near = "\n".join(["Posted  by Ann on 4 May 2021", "版权所有，未经许可不得转载本文内客。", "cat in", "one twothree four five six seven eight"])
    far = "\n".join(["Posted by Bob on 3 May 2021", "版权所有，未经允许不得转载本文內容。", "one two three four five six seveneighth"])
    docs = spark.createDataFrame([(1, text), (2, near), (3, far)], "doc_id long, text string").repartition(2)
    got = {r["row"]["doc_id"]: r["row"]["text"] for r in L.dedup_lines(docs).collect()}
    assert got == {1: text, 2: "cat in", 3: far}


def short_lines():
    rng = random.Random(4)
    letters = ["a", "é", "版", "𝄞", " ", "\t", "b "]
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 22))) for _ in range(40)]
    rows = []
    for k in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            c = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(c) + 1)
                c[at : at + rng.choice([0, 1])] = [rng.choice(letters)] * rng.choice([0, 1])
            lines.append("".join(c))
        rows.append((k, "\n".join(x for x in lines if x.strip()) or "none"))
    return rows


def test_characters_against_brute_force(spark):
    rows = short_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for near, size in ((5, 200), (3, 100000)):
        got = sorted((r["row"]["doc_id"], r["row"]["text"]) for r in L.dedup_lines(docs, near, size).collect())
        want = brute_characters(rows, near)
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        assert not bad, bad[:3]
        assert want != brute(rows, near)


def test_runs_of_lines_and_keys_change_nothing(monkeypatch):
    rows = short_lines()
    data, offsets = utf8(pa.array([t for _, t in rows]))
    batch = Batch(np.array([i for i, _ in rows]), offsets, data)
    texts = pa.table({"batch": [0], "docs": pa.array([batch.block()], pa.binary())})

    def removed():
        entries = pa.table(dict(zip(("bucket", "batch", "kind", "block"), zip(*L._line_entries(0, batch, 5, 0)))))
        variants = L._variant_entries(texts, L._line_verdicts(entries), 5, 0)
        assert sorted(set(variants["bucket"].to_pylist())) == [-1, 0]
        found = L._near_repeats(variants.filter(pc.greater_equal(variants["bucket"], 0)))
        return {int(k) for b in found["block"] for k in unpack(b.as_py())[0]}

    whole = removed()
    monkeypatch.setattr(L, "CHARACTER_BYTES", 150)
    monkeypatch.setattr(L, "MOST_MEETING", 40)
    assert whole and removed() == whole
