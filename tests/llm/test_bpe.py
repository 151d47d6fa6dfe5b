import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rawframe.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(5)
    letters = "abcdeE  \n\t'srvetlmd019½Ⅷéß中文  \u0085\x1c🙂्ाः.,!<|>_"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    out += ["<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|> ", "<|endoftext", "the " * 500, "a" * 3000, "  ", " \n ", "x" * 70 + "é" * 70]
    return [*out, "".join(chr(c) + rng.choice("a 1") for c in range(0x3000) if not 0xD800 <= c < 0xE000), "", None]


def test_equal_to_the_library(spark, library):
    rows = list(enumerate(texts())) + [(7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    source = bpe.tokenizer_bytes()
    lexicon = bpe.build_lexicon(docs, source, 300)
    coded = bpe.decode(bpe.encode(docs, source, lexicon), source).collect()
    assert len(coded) == len(rows)
    for r in coded:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids, r["text"]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False) == (r["text"] or "")


def test_every_code_point_is_cut_as_by_the_library(library):
    merger = bpe.Merger(bpe.tokenizer_bytes())
    encoder = bpe.Encoder(merger, None)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 4096):
        text = "".join(f"{c}a{c}1 {c} " for c in chars[k : k + 4096])
        if k == 0:  # the plain cut has to agree where it's used
            for c in chars[:0x250]:
                own = f"{c}a{c}1 {c} {c}'s\n"
                assert bpe.cut_words(own) == bpe.WORDS.findall(own)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(k)


def test_lexicon_shares_and_finds():
    words = {w.encode(): [k, k + 1][: k % 3] for k, w in enumerate(["", "a", "ab", "able", "table", "tables", "cable", "é", "ée"])}
    block = bpe.compile_lexicon(words)
    lexicon = bpe.Lexicon(block)
    assert {w: np.frombuffer(lexicon.find(w), "<u4").tolist() for w in words} == words
    assert all(lexicon.find(w) is None for w in (b"t", b"abl", b"tablesx", b"x"))
    assert lexicon.states < 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})  # fewer than without shared endings
    assert bpe.Lexicon(bpe.compile_lexicon({})).find(b"a") is None


def test_words_of_texts_are_merged_together(monkeypatch):
    merger = bpe.Merger(bpe.tokenizer_bytes())
    rng = random.Random(9)
    words = ["".join(rng.choice("aeilnrstAE é🙂0!") for _ in range(rng.randrange(1, 105))).encode()[: rng.randrange(1, 105)] for _ in range(3000)]
    words += [bytes([b]) * n for b in b"a0\xff" for n in (1, 2, 3, 99, 100, 101, 500)] + [b""]
    assert bpe.Merges(merger).merge(words) == [np.array(merger.merge(w), "<u4").tobytes() for w in words]
    text = " ".join(w.decode("utf-8", "replace") for w in words[:1000]) + "<|endoftext|>" + "b" * 300
    ids = b"".join(np.array([i] if i is not None else [x for w in bpe.cut_words(part) for x in merger.merge(w.encode())], "<u4").tobytes() for part, i in merger.parts(text))
    alone, merge = [], bpe.Merger.merge
    monkeypatch.setattr(bpe.Merger, "merge", lambda self, word: alone.append(word) or merge(self, word))
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 500)
    encoder = bpe.Encoder(merger, None)
    assert encoder.encode(text) == ids == encoder.encode(text)
    assert all(len(w) > bpe.LONG_WORD_BYTES for w in alone)  # none of the others was merged by itself


def test_words_are_found_together():
    words = {w.encode(): [k, k + 1][: k % 3] for k, w in enumerate(["", "a", "ab", "able", "table", "tables", "cable", "é", "ée"])}
    asked = [*words, b"t", b"abl", b"tablesx", b"x", b"\xff", b"able"]
    for lexicon in (bpe.Lexicon(bpe.compile_lexicon(words)), bpe.Lexicon(bpe.compile_lexicon({}))):
        assert lexicon.find_all(asked) == [lexicon.find(w) for w in asked]
        assert lexicon.find_all([]) == []


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 2)], "doc_id long, text string, ids string, decoded int")
    out = bpe.tokenized(docs)
    assert [r["row"].asDict() for r in out.collect()] == [{"doc_id": 1, "ids": "x", "decoded": 2}]
    assert bpe.tokenized(docs.limit(0)).count() == 0
