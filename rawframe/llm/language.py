"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, over all 256 bytes. A byte's
probability under a context is its count there, or the escape probability (of method C) times its
probability under the next shorter context, and 1/256 under none. The statistics are frozen after
training; a text's code length under each language is the sum over its bytes (the first ones have
shorter contexts), and the shortest code wins.

The trees are fitted on a sample of labelled documents, drawn by a hash of their ids: of each
language about MOST_FITTED documents and FITTED_BYTES bytes at most, as its numbers of documents
and bytes give. All contexts and counts of the sample are kept, so the model grows with the number
of languages, not with the corpus. Every document is scored whole.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the
language that sorts first; without any training row all is `und`; repeated rows give repeated
results; a very long text is scored whole in its task; an empty table gives no rows; extra columns
go through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_arrow, read_table, shared
from .kernels import slices, utf8

#: The sample of each language: documents, and bytes of their texts.
MOST_FITTED = 1_500
FITTED_BYTES = 4 << 20
ORDER = 3
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


class Places:
    """Where each of some distinct numbers below 2^32 is, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask, self.probes = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.rows = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            slot = (self._slots(keys[left]) + self.probes) & self.mask
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.rows[taken] = keys[left[free[first]]], left[free[first]]
            left = np.delete(left, free[first])
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        slot = self._slots(keys)
        own = self.keys[slot]
        out = np.where(own == keys, self.rows[slot], -1)
        at = np.flatnonzero((own != keys) & (own >= 0))
        for probe in range(1, self.probes):
            if not len(at):
                break
            near = (slot[at] + probe) & self.mask
            own = self.keys[near]
            hit = own == keys[at]
            out[at[hit]] = self.rows[near[hit]]
            at = at[~hit & (own >= 0)]
        return out


@dataclass
class Level:
    """Code lengths (strings x languages) in nats of strings whose last byte is coded under the others, and of escapes from contexts."""

    strings: Places
    code: np.ndarray
    contexts: Places
    escape: np.ndarray


@dataclass
class Trees:
    """first: 256 x languages, the code lengths without a context; levels: those under contexts of one byte and more."""

    languages: list[str]
    first: np.ndarray
    levels: list[Level]

    def coded(self, strings: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of the last bytes of strings of order + 1 bytes under the others."""
        if not order:
            return self.first[strings]
        level = self.levels[order - 1]
        place = level.strings(strings)
        out = level.code[place]
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            rest = strings[unseen]
            lower = self.coded(rest & ((1 << (8 * order)) - 1), order - 1)
            context = level.contexts(rest >> 8)
            out[unseen] = lower + np.where((context >= 0)[:, None], level.escape[context], 0)
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data):
            return out
        each = np.empty((len(data), len(self.languages)), np.float32)
        for order, at, strings in strings_of(data, offsets):
            each[at] = self.coded(strings, order)
        full = np.diff(offsets) > 0
        out[full] = np.add.reduceat(each, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def strings_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, places, strings as numbers): each byte with up to ORDER bytes of its text before it."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    wide = data.astype(np.int64)
    for order in range(ORDER + 1):
        at = np.flatnonzero(place == order if order < ORDER else place >= order)
        strings = wide[at]
        for k in range(1, order + 1):
            strings = strings | wide[at - k] << (8 * k)
        if len(at):
            yield order, at, strings


def _summed(strings: np.ndarray, language: np.ndarray, n: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings, and their counts in each language."""
    known, place = np.unique(strings, return_inverse=True)
    return known, np.bincount(place * languages + language, weights=n, minlength=len(known) * languages).reshape(-1, languages)


def _method_c(known: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the strings, the contexts, and the probabilities of escapes from them."""
    contexts, own = np.unique(known >> 8, return_inverse=True)
    total, kinds = np.zeros((len(contexts), counts.shape[1])), np.zeros((len(contexts), counts.shape[1]))
    np.add.at(total, own, counts)
    np.add.at(kinds, own, counts > 0)
    # A language that hasn't seen a context passes on to the shorter one for nothing.
    escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    return np.where(counts > 0, counts / np.maximum(total + kinds, 1)[own], escape[own] * lower), contexts, escape


def compile_trees(languages: list[str], language: np.ndarray, order: np.ndarray, string: np.ndarray, n: np.ndarray) -> Trees:
    """Trees from counts of (language, order, string of order + 1 bytes as a number), each byte of a text counted once."""
    size, n = len(languages), n.astype(np.float64)
    levels: list[Level] = []
    known, counts = _summed(string & 255, language, n, size)
    whole = np.zeros((256, size))
    whole[known] = counts
    probability, _, _ = _method_c(np.arange(256), whole, np.full((256, size), 1 / 256))
    first, below = -np.log(probability).astype(np.float32), (np.arange(256), probability)
    for k in range(1, ORDER + 1):
        own = order >= k  # longer strings count under their shorter contexts too
        known, counts = _summed(string[own] & ((1 << (8 * k + 8)) - 1), language[own], n[own], size)
        lower = below[1][np.searchsorted(below[0], known & ((1 << (8 * k)) - 1))]
        probability, contexts, escape = _method_c(known, counts, lower)
        code = lambda p: np.concatenate([-np.log(p), np.zeros((1, size))]).astype(np.float32)  # noqa: E731 (the last row is for -1)
        levels.append(Level(Places(known), code(probability), Places(contexts), code(escape)))
        below = known, probability
    return Trees(languages, first, levels)


def count_strings(docs: DataFrame) -> DataFrame:
    """(lang, at, n): strings of bytes in the texts of each language; at is the string, with its order above 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                key = np.empty(len(part), np.int64)
                for order, at, strings in strings_of(part, own):
                    key[at] = order << 32 | strings
                lang = np.repeat(langs[i:j], np.diff(own))
                for one in sorted(set(langs[i:j])):
                    values, n = np.unique(key[lang == one], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["lang", "at", "n"])

    return map_arrow(docs.select("lang", "text"), run, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, most: int = MOST_FITTED, most_bytes: int = FITTED_BYTES) -> Trees | None:
    """Trees of every language among the rows that aren't held out; None without such rows."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not sizes:
        return None
    parts = 1_000_000
    share = F.lit(0)
    for r in sizes:
        own = min(1.0, most / r["n"], most_bytes / max(1, r["bytes"]))
        share = F.when(F.col("lang") == r["lang"], max(1, int(parts * own))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(parts)) < share)
    found = count_strings(drawn).toPandas()
    languages = sorted(r["lang"] for r in sizes)
    if not len(found):
        return None
    at = found["at"].to_numpy(np.int64)
    return compile_trees(languages, found["lang"].map({lang: k for k, lang in enumerate(languages)}).to_numpy(np.int64), at >> 32, at & 0xFFFFFFFF, found["n"].to_numpy(np.int64))


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(row, lang_pred, score): each row of docs as a struct, its language and the share of it in the likelihoods."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    if trees is None:
        return whole.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = shared(docs.sparkSession, trees)
    # Code lengths of a slice are held for all languages at once.
    limit = max(1 << 12, (1 << 20) // len(trees.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Trees = sent.value
        for batch in batches:
            texts = batch.column(1)
            data, offsets = utf8(texts)
            lengths = np.concatenate([own.lengths(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, limit)] or [np.zeros((0, len(own.languages)))])
            best = lengths.argmin(1) if len(lengths) else np.empty(0, np.int64)
            share = 1 / np.exp(-np.minimum(lengths - lengths.min(1, keepdims=True), 700)).sum(1) if len(lengths) else np.empty(0)
            known = [has_letter(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([own.languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, share, 0.0) if len(known) else share, pa.float64()),
                ],
                ["row", "lang_pred", "score"],
            )

    return map_arrow(whole, run, f"row {whole.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
