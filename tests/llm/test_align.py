import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rawframe.llm import align


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    rng = random.Random(3)
    letters = "abcdeE  \n\t'srvetlmd019½Ⅷéß中文　 ́▁🙂्ाः.,!<|>_()"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(500)]
    words = ["don't", "it's", "they'll", "naïve", "x'y", "  ", "\n\n", " \n ", "1,234.5", "e.g.", "日本語", "…", "\t", "\r\n", "'", "end", "<|endoftext|>", "<s>", "the", "hyper-active"]
    out += [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(1, 20))) for _ in range(500)]
    return [*out, "", " ", None, "▁", "a▁b", "the " * 4000, "q" * 5000, "\x00a", "".join(chr(c) for c in range(1, 0x2100))]


def expected(rows, libraries):
    """By the definition, with loops: {place: (n_a, n_b, groups)} and the links of each."""
    a, b = libraries
    byte_of = {}
    own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    for k, x in enumerate([*own, *(x for x in range(256) if x not in own)]):
        byte_of[chr(x) if k < len(own) else chr(256 + k - len(own))] = x
    spelled_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    out = []
    for text in rows:
        found = (0, 0, "", [])
        if text:
            spaced = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
            parts_b = [spelled_b[i] for i in ids_b]
            if b"".join(parts_a) == b"".join(parts_b) == spaced:
                ends_a, ends_b, at = [], [], 0
                for p in parts_a:
                    ends_a.append(at := at + len(p))
                at = 0
                for p in parts_b:
                    ends_b.append(at := at + len(p))
                borders = sorted(set(ends_a) & set(ends_b))
                groups, last = [], 0
                for x in borders:
                    groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if last < e <= x) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if last < e <= x) if len(borders) < 2000 else "")
                    last = x
                where = {e: i for i, e in zip(ids_b, ends_b)}
                found = (len(ids_a), len(ids_b), ";".join(groups) if len(borders) < 2000 else None, [(i, where[e]) for i, e in zip(ids_a, ends_a) if e in where])
        out.append(found)
    return out


def test_against_the_definition(spark, libraries):
    rows = list(enumerate(texts()))
    rows += [(k, rows[k][1]) for k in (3, 3, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = sorted((r for r in align.aligned(docs, keep_groups=True).collect()), key=lambda r: r["row"]["doc_id"])
    by_id = dict(enumerate(expected([t for _, t in rows[: len(texts())]], libraries)))
    counts = Counter(link for k, _ in rows for link in by_id[k][3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert len(made) == len(rows)
    assert sum(bool(by_id[k][3]) for k in by_id) > 500
    for r in made:
        n_a, n_b, groups, links = by_id[r["row"]["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(links), len(links)), rows[r["row"]["doc_id"]]
        assert r["n_best"] == sum(counts[x] == most[x[1]] for x in links)
        assert r["count_sum"] == sum(counts[x] for x in links)
        if groups is not None:
            assert r["groups"] == groups
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if n_a else "")


def test_parts_are_whole_and_cut_where_tokens_are(libraries):
    tokens = align.Tokens(align.tokenizer_bytes(), align.piece_bytes())
    assert tokens.model.by_parts
    for text in texts():
        if text:
            assert "".join(align.cut_parts(" " + text)) == " " + text


def test_batches_give_one_result(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 7} other, and-more {k}") for k in range(60)], "doc_id long, text string").repartition(4)
    whole = sorted(map(tuple, align.aligned(docs).drop("groups").collect()))
    monkeypatch.setattr(align, "BATCH_BYTES", 100)
    monkeypatch.setattr(align, "RUN_BYTES", 40)
    assert sorted(map(tuple, align.aligned(docs).drop("groups").collect())) == whole


def test_empty_tables_clashing_and_missing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 2), (None, None, None, None)], "doc_id long, text string, n_a string, batch int")
    out = {r["row"]["doc_id"]: r for r in align.aligned(docs).collect()}
    assert out[1]["row"]["n_a"] == "x" and out[1]["row"]["batch"] == 2 and out[1]["n_a"] == 2
    assert (out[None]["n_a"], out[None]["n_groups"], out[None]["groups_sha256"]) == (0, 0, "")
    assert align.aligned(docs.limit(0)).count() == 0
    assert align.aligned(docs.select("text")).count() == 2
