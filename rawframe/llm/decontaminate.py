"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items make one suffix automaton over words. The training words are
streamed through it, tracking the longest suffix that occurs in some item: where that reaches
the window length (or a whole shorter item), the words of the window are hit.

The automaton is broadcast, and its size is checked: a benchmark of more than MAX_ITEM_WORDS
words is dealt into several automata, each with a pass of its own, whose spans are united.

Defined results: a null or empty text has no words and no hits; a null or empty item has no
window; repeated items count once per item_id, an item without an id is listed as ""; an empty
table of either kind gives clean or no rows; extra columns of the documents stay untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, shared, stage_table
from .kernels import Hasher, ascii_lower, byte_class, hash_texts, slices, spans_of, utf8

WINDOW = 13
#: A document is contaminated from this share of hit words, as a whole divisor: 20 is 5 %.
COVERAGE_DIVISOR = 20
MAX_ITEM_WORDS = 200_000
WORD_BYTES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD_PATTERN = WORD_BYTES + "+"
_IN_WORD = byte_class(WORD_BYTES)


def item_words(text: str | None) -> list[bytes]:
    data = ascii_lower(np.frombuffer((text or "").encode(), np.uint8))
    starts, ends, _ = spans_of(_IN_WORD[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends)]


class ItemAutomaton:
    """Suffix automaton of many word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: The items of a window: by the state that holds the string, for whole short items by (state, length).
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, words in coded:
            at = 0
            for k, w in enumerate(words):
                at = self.next[at][w]
                if k + 1 >= window:
                    self.windows.setdefault(self._reduced(at), set()).add(name)
            if len(words) < window:
                self.short.setdefault(at, {}).setdefault(len(words), set()).add(name)
        #: The nearest state up the links, itself included, where a short item ends.
        self.shorter = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.shorter[s] = s if s in self.short else self.shorter[self.link[s]] if self.link[s] >= 0 else -1
        self.least = min([window, *(len(words) for _, words in coded)])
        self.hashes = np.sort(hash_texts(list(self.vocabulary)))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def _add(self, length: int, after: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(after)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the part of q that is p plus w, taken over by p and its suffixes."""
        twin = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:  # the sequence so far is part of an earlier item
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new = self._add(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _reduced(self, state: int) -> int:
        """The state of the last `window` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which words may be words of items: no word of an item is missed."""
        out = self.sieve[(hashes >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        out[maybe] = self.hashes[at] == hashes[maybe]
        return out

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (merged) and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = length = 0
        for k, word in enumerate(words):
            w = self.vocabulary.get(word, -1)
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w not in self.next[state]:
                continue
            state = self.next[state][w]
            length += 1
            reach = 0
            if length >= self.window:
                reach = self.window
                found |= self.windows[self._reduced(state)]
            at = self.shorter[state]
            while at > 0:
                for n, names in self.short[at].items():
                    if n <= length:
                        reach = max(reach, n)
                        found |= names
                at = self.shorter[self.link[at]]
            if reach:
                start = k + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, k + 1))
        return spans, found


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(sent: Broadcast, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: ItemAutomaton = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            counts: list[np.ndarray] = []
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for i, j in slices(offsets):
                part = ascii_lower(data[offsets[i] : offsets[j]])
                starts, ends, of = spans_of(_IN_WORD[part], offsets[i : j + 1] - offsets[i])
                counts.append(np.bincount(of, minlength=j - i))
                if not len(automaton.hashes) or not len(starts):
                    continue
                known = automaton.known(Hasher(part).of(starts, ends))
                firsts = np.searchsorted(of, np.arange(j - i + 1))
                begins, stops, docs = spans_of(known, firsts)
                long = stops - begins >= automaton.least
                for b, e, d in zip(begins[long], stops[long], docs[long]):
                    got, names = automaton.stream([part[s:t].tobytes() for s, t in zip(starts[b:e], ends[b:e])])
                    shift = int(b - firsts[d])
                    spans[i + d] += [{"start": s + shift, "end": t + shift} for s, t in got]
                    items[i + d] |= names
            n = np.concatenate(counts) if counts else np.empty(0, np.int64)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                [*columns, "n_words", "hit_spans", "items"],
            )

    return run


def automata(benchmark: DataFrame, window: int, max_words: int, item_id: str = "item_id") -> Iterator[ItemAutomaton]:
    """One automaton, or several of about max_words words each."""
    slim = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col("text")).distinct()
    # Every word takes a byte at least, and the next one a byte between.
    most = slim.agg(F.sum(F.octet_length("text") + 1).alias("b")).first()["b"] or 0
    counted = max(0, most // 2)
    if counted > max_words:
        counted = slim.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = max(1, -(-counted * 2 // max_words)) if counted > max_words else 1
    for k in range(parts):
        own = slim if parts == 1 else slim.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield ItemAutomaton([(r["item"], item_words(r["text"])) for r in own.orderBy("item", "text").toLocalIterator()], window)


def merged_spans(spans: Column) -> Column:
    """Sorted, disjoint spans."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (last["end"] >= s["start"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """docs' columns `keep` with n_words, hit_spans (of words) and items (ids, sorted), for each row of docs."""
    spark = docs.sparkSession
    slim = docs.select(*keep, "text")
    built = automata(benchmark, window, max_words)
    first, second = next(built), next(built, None)
    fields = "n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, items array<string>"

    def scan(rows: DataFrame, automaton: ItemAutomaton) -> DataFrame:
        columns = [c for c in rows.columns if c != "text"]
        schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), fields])
        return map_arrow(rows.select(*columns, "text"), _scan(shared(spark, automaton), columns), schema)

    if second is None:
        return scan(slim, first)
    numbered = stage_table(slim.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    found = scan(numbered, first).unionByName(scan(numbered, second))
    for more in built:
        found = found.unionByName(scan(numbered, more))
    return found.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in keep],
        F.first("n_words").alias("n_words"),
        merged_spans(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).drop("_row")


def judged(matched: DataFrame, divisor: int = COVERAGE_DIVISOR) -> DataFrame:
    """Adds n_hit, and contaminated: some word is hit, and the hit words are at least 1/divisor of all."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return matched.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * divisor >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, divisor: int = COVERAGE_DIVISOR) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return judged(match_benchmark(whole, benchmark, window, ("row",)), divisor).where(~F.col("contaminated")).select("row.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(match_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        "hit_spans",
    )
