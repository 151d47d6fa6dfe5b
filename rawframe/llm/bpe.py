"""Byte-pair encoding and decoding with a word lexicon.

The words of the whole corpus are counted; the most frequent ones, with the ids they encode
to, are compiled into a minimal acyclic transducer: an automaton that shares prefixes and
suffixes, whose arcs carry numbers that add up to a word's place in the table of ids. Tasks
map it into memory. Words outside the lexicon are merged exactly, pair by pair. A task takes the
words of a batch of texts at once: they walk through the lexicon together, and those it doesn't
have are merged together, a pair of each word a round.

The result is that of the tokenizer file whatever the lexicon holds. The lexicon's size is
bounded by a parameter, so what is broadcast doesn't grow with the data.

Defined results: a null or empty text encodes to no ids and decodes to an empty text; repeated
rows give repeated results; an empty table gives no rows; extra columns go through untouched.
A text is held whole in memory, with its ids.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, shared, stage_table
from .kernels import slices

LEXICON_WORDS = 65_536
#: Longer words are left to merging.
LEXICON_WORD_BYTES = 64
#: Encoded words a task remembers before it starts afresh.
REMEMBERED_WORDS = 250_000
#: Characters of texts whose words are looked up and merged together; a longer text goes alone.
TEXTS_AT_ONCE = 1 << 21
#: Distinct words a counting task holds before it hands its counts on.
COUNTED_WORDS = 200_000

LONG_WORD_BYTES = 100
NO_RANK = 1 << 40
#: Words merged together have lengths up to the same one of these, and so many cells at most.
WIDTHS = (4, 8, 12, 16, 24, 40, LONG_WORD_BYTES)
MERGED_CELLS = 1 << 16

# Fixed value: the white space of Unicode, as the tokenizers' pattern takes it.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Fixed value: the pattern that cuts text into words before the merges.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: The same cut for texts of ASCII and Latin letters only, where plain ranges say what a letter is.
LATIN = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F"
LATIN_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
NOT_LATIN = re.compile(r"[^\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\u024F]")


def cut_words(text: str) -> list[str]:
    return (WORDS if NOT_LATIN.search(text) else LATIN_WORDS).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """The tokenizer of a file: exact merges for single words, and the bytes of each id."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        added = spec.get("added_tokens", [])
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec["model"].get("ignore_merges")
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added) or spec.get("normalizer") or spec["model"].get("dropout"):
            raise ValueError("this kind of tokenizer file isn't supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.single = [0] * 256
        for letter, b in letters.items():
            self.single[b] = vocab[letter]
        #: The rank of a pair (two ids as one number), and the id that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of the lowest rank, leftmost first, is merged until none is left."""
        ids = [self.single[b] for b in word]
        if len(ids) > LONG_WORD_BYTES:
            return self._merge_long(ids)
        get, made = self.ranks.get, self.made
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < NO_RANK:
            k = ranks.index(rank)
            ids[k] = new = made[rank]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | new, NO_RANK)
            if k < len(ranks):
                ranks[k] = get(new << 32 | ids[k + 1], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in time near proportional to the length."""
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n + 1)
        heap = [(rank, k) for k in range(n - 1) if (rank := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if gone[k] or (r := after[k]) >= n or get(ids[k] << 32 | ids[r]) != rank:
                continue
            ids[k] = new = self.made[rank]
            gone[r] = 1
            after[k] = far = after[r]
            if far < n:
                before[far] = k
                if (found := get(new << 32 | ids[far])) is not None:
                    heapq.heappush(heap, (found, k))
            if (left := before[k]) >= 0 and (found := get(ids[left] << 32 | new)) is not None:
                heapq.heappush(heap, (found, left))
        return [x for k, x in enumerate(ids) if not gone[k]]

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary text, and special tokens with their ids, in turn."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield text[at : m.start()], None
            yield m.group(), self.special[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:], None


class PairTable:
    """Ranks of many pairs at once: a hash table with open addresses. Ids that no pair has find no rank."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[int, int]):
        bits = max(4, (4 * len(ranks)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._pairs = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, self.NONE, np.int64)
        left = np.fromiter(ranks, np.int64, len(ranks))
        values = np.fromiter(ranks.values(), np.int64, len(ranks))
        at = self._place(left)
        while len(left):
            free = self._pairs[at] == -1
            self._pairs[at[free]] = left[free]  # of several the last stays
            won = self._pairs[at] == left
            self._ranks[at[won]] = values[won]
            left, values, at = left[~won], values[~won], (at[~won] + 1) & self._mask

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a << 32 | b
        at = self._place(pairs)
        seen = self._pairs[at]
        out = np.where(seen == pairs, self._ranks[at], self.NONE)
        more = np.flatnonzero((seen != pairs) & (seen != -1))
        while len(more):
            at = (at[more] if len(at) == len(pairs) else at) + 1 & self._mask
            seen = self._pairs[at]
            hit = seen == pairs[more]
            out[more[hit]] = self._ranks[at[hit]]
            on = ~hit & (seen != -1)
            more, at = more[on], at[on]
        return out


class Merges:
    """Many words merged together: in each round, each word's pair of the lowest rank, leftmost first."""

    def __init__(self, merger: Merger):
        self.merger, self.table = merger, PairTable(merger.ranks)
        self.made = np.array(merger.made, np.int64)
        #: Beyond a word's ends, and in place of ids that were merged away.
        self.nothing = max([*merger.single, *merger.made]) + 1
        self.single = np.array([*merger.single, self.nothing], np.int64)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = [b""] * len(words)
        shorter = 0
        for width in WIDTHS:
            among = np.flatnonzero((lengths > shorter) & (lengths <= width))
            shorter = width
            rows = max(1, MERGED_CELLS // width)
            for k in range(0, len(among), rows):
                part = among[k : k + rows].tolist()
                for place, ids in zip(part, self._together([words[p] for p in part], width)):
                    out[place] = ids
        for place in np.flatnonzero(lengths > shorter).tolist():
            out[place] = np.array(self.merger.merge(words[place]), "<u4").tobytes()
        return out

    def _together(self, words: list[bytes], width: int) -> list[bytes]:
        n, none = len(words), PairTable.NONE << 7
        lengths = np.fromiter(map(len, words), np.int64, n)
        # A column a word; two rows more stand for its ends. A pair's number is its rank and its place.
        letters = np.full((n, width), 256, np.int16)
        letters[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        done = np.full((width + 2, n), self.nothing)
        done[:width] = self.single[letters.T]
        numbers = np.full((width + 2, n), none)
        for k in range(width - 1):
            among = np.flatnonzero(lengths > k + 1)
            numbers[k, among] = self.table.find(done[k, among], done[k + 1, among]) << 7 | k
        np.minimum(numbers, none, out=numbers)
        after = np.repeat(np.arange(1, width + 3)[:, None], n, 1)
        before = np.repeat(np.arange(-1, width + 1)[:, None], n, 1)
        before[0] = width + 1
        ids, columns = done, np.arange(n)
        while True:
            low = numbers.min(axis=0)
            live = np.flatnonzero(low < none)
            if not len(live):
                break
            if 2 * len(live) < len(low):
                # The others move together.
                done[:, columns] = ids
                ids, numbers, after, before = (x.take(live, axis=1) for x in (ids, numbers, after, before))  # in row order, as they are written flat
                columns, low, live = columns[live], low[live], np.arange(len(live))
            low = low[live]
            m, place, new = len(columns), low & 127, self.made[low >> 7]
            here = place * m + live
            gone = after.ravel()[here] * m + live
            right, left = after.ravel()[gone], before.ravel()[here]
            at_right, at_left = right * m + live, left * m + live
            flat, pairs = ids.ravel(), numbers.ravel()
            flat[here], flat[gone], pairs[gone] = new, self.nothing, none
            after.ravel()[here], before.ravel()[at_right] = right, place
            found = self.table.find(np.concatenate([new, flat[at_left]]), np.concatenate([flat[at_right], new]))
            found = np.minimum(found << 7 | np.concatenate([place, left]), none)
            pairs[here], pairs[at_left] = found[: len(new)], found[len(new) :]
        done[:, columns] = ids
        kept = done != self.nothing
        block = done.T[kept.T].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=0))).tolist()
        return [block[a:b] for a, b in zip([0, *ends], ends)]


def pieces(source: bytes) -> list[bytes]:
    """The bytes of each id."""
    spec, letters = json.loads(source), _byte_letters()
    found = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def decoded(ids: bytes, piece: list[bytes]) -> str:
    """The text of ids; broken UTF-8 is replaced."""
    return b"".join(map(piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of words and their ids, as one block of bytes.

    Words come in sorted order; states left behind are looked up among the finished ones, so
    equal endings are kept once. An arc's number counts the words that sort before it in its
    state; the numbers on a word's path add up to the word's place.
    """
    finished: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []

    def close(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in finished:
            finished[key] = len(states)
            states.append((final, list(arcs)))
        return finished[key]

    path: list[list] = [[False, []]]  # of the last word: final, arcs of each open state
    last = b""
    order = sorted(words)
    for word in [*order, None]:
        common = 0
        while word is not None and common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], close(final, arcs)))
        if word is None:
            break
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    root = close(*path[0])
    counts = []  # states are closed after all that they lead to
    for final, arcs in states:
        counts.append(final + sum(counts[t] for _, t in arcs))
    first, labels, targets, skips = [0], bytearray(), [], []
    for final, arcs in states:
        seen = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(seen)
            seen += counts[target]
        first.append(len(labels))
    ids = [words[w] for w in order]
    ends = np.cumsum([0, *map(len, ids)])
    numbers = np.concatenate([first, [int(f) for f, _ in states], targets, skips, ends, *ids]).astype("<u4")
    return struct.pack("<4I", root, len(states), len(labels), len(order)) + numbers.tobytes() + bytes(labels)


class Lexicon:
    """A compiled lexicon, mapped from a file that has no name and goes with the process."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, states, arcs, words = struct.unpack_from("<4I", self._map)
        self._labels = len(block) - arcs
        numbers = memoryview(self._map)[16 : self._labels].cast("I")
        cuts = np.cumsum([0, states + 1, states, arcs, arcs, words + 1]).tolist()
        self.first, self.final, self.targets, self.skips, self.ends = (numbers[a:b] for a, b in zip(cuts, cuts[1:]))
        self.ids = numbers[cuts[-1] :]
        self.states = states
        #: Each arc's state and label as one number; arcs are in this order.
        self.arcs = np.repeat(np.arange(states), np.diff(np.asarray(self.first, np.int64))) << 8 | np.frombuffer(self._map, np.uint8, arcs, self._labels)

    def find(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian 32-bit numbers."""
        state, place, find, labels = self.root, 0, self._map.find, self._labels
        for k in range(len(word)):
            arc = find(word[k : k + 1], labels + self.first[state], labels + self.first[state + 1]) - labels
            if arc < 0:
                return None
            place += self.skips[arc]
            state = self.targets[arc]
        return self.ids[self.ends[place] : self.ends[place + 1]].tobytes() if self.final[state] else None

    def find_all(self, words: list[bytes]) -> list[bytes | None]:
        """The same for many words, which walk through the states together, a byte a round."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        skips, targets, final = (np.asarray(x) for x in (self.skips, self.targets, self.final))
        out: list[bytes | None] = [None] * len(words)
        on, state, place = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        k = 0
        while len(on):
            ended = lengths[on] == k
            known = ended & (final[state] > 0)
            for word, at in zip(on[known].tolist(), place[known].tolist()):
                out[word] = self.ids[self.ends[at] : self.ends[at + 1]].tobytes()
            on, state, place = (x[~ended] for x in (on, state, place))
            arc = state << 8 | letters[starts[on] + k]
            at = np.searchsorted(self.arcs, arc)
            hit = np.append(self.arcs, -1)[at] == arc
            at = at[hit]
            on, state, place = on[hit], targets[at].astype(np.int64), place[hit] + skips[at]
            k += 1
        return out


class Encoder(dict):
    """Words to their ids as bytes: remembered, or from the lexicon, or merged.

    Special tokens are among the words: no ordinary word is one, as texts are cut at them first."""

    def __init__(self, merger: Merger, lexicon: Lexicon | None):
        super().__init__()
        self.merger, self.lexicon, self.merges = merger, lexicon, Merges(merger)

    def words(self, text: str) -> list[str]:
        """Words and special tokens in turn."""
        cut = self.merger.cut
        if cut is None or not cut.search(text):
            return cut_words(text)
        return [w for part, i in self.merger.parts(text) for w in ([part] if i is not None else cut_words(part))]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, some texts at a time."""
        ends = np.cumsum([0, *map(len, texts)])
        return [ids for i, j in slices(ends, TEXTS_AT_ONCE) for ids in self._together(texts[i:j])]

    def _together(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        wanted = set().union(*cut)
        new = wanted - self.keys()
        if new and len(self) + len(new) > REMEMBERED_WORDS:
            self.clear()
            new = wanted
        self._learn(list(new))
        return [b"".join(map(self.__getitem__, words)) for words in cut]

    def _learn(self, words: list[str]) -> None:
        special = self.merger.special
        plain = [w for w in words if w not in special]
        raw = [w.encode() for w in plain]
        found = self.lexicon.find_all(raw) if self.lexicon else [None] * len(raw)
        self.update(zip(plain, found))
        rest = [k for k, ids in enumerate(found) if ids is None]
        self.update(zip((plain[k] for k in rest), self.merges.merge([raw[k] for k in rest])))
        self.update((w, struct.pack("<I", special[w])) for w in words if w in special)


def count_words(docs: DataFrame, source: bytes) -> DataFrame:
    """(word, n) over all texts."""
    spec = Merger(source)
    cut = spec.cut.pattern if spec.cut else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        special = regex.compile(cut) if cut else None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for part in special.split(text.as_py() or "") if special else [text.as_py() or ""]:
                    counts.update(cut_words(part))
                if len(counts) >= COUNTED_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return map_arrow(docs.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, source: bytes, size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words of docs, at most `size`."""
    merger = Merger(source)
    counted = stage_table(count_words(docs, source).where(F.octet_length("word") <= LEXICON_WORD_BYTES), "words")
    # Words by the (rounded) logarithm of their counts: a few hundred rows, from which the least count follows.
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    room, least = size, None
    for r in levels:
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
    top = counted.where(level >= least).select("word") if least is not None else counted.limit(0).select("word")
    words = {r["word"].encode(): None for r in top.collect()}
    return compile_lexicon({w: merger.merge(w) for w in words})


def tokenizer_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def _through(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), values], [*kept, name])


def _schema(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns if c != name), f"`{name}` {kind}"])


def encode(docs: DataFrame, source: bytes, lexicon: bytes | None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids: little-endian unsigned 32-bit numbers."""
    sent = shared(docs.sparkSession, (source, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The encoder goes with its task: workers live on, and other stages need their memory.
        merges, block = sent.value
        encoder = Encoder(Merger(merges), Lexicon(block) if block else None)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            yield _through(batch, ids, pa.array(encoder.encode_all([t.as_py() or "" for t in texts]), pa.binary()))

    return map_arrow(docs, run, _schema(docs, ids, "binary"))


def decode(encoded: DataFrame, source: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the column text; special tokens are kept, broken UTF-8 is replaced."""
    sent = shared(encoded.sparkSession, pieces(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = sent.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [decoded(x.as_py() or b"", piece) for x in column]
            yield _through(batch, text, pa.array(texts, pa.string()))

    return map_arrow(encoded, run, _schema(encoded, text, "string"))


def tokenized(docs: DataFrame, source: bytes | None = None, lexicon_words: int = LEXICON_WORDS, lexicon: bytes | None = None) -> DataFrame:
    """docs' other columns with ids and decoded. The text itself is left out.

    docs may have columns named like the added ones: they are put away while the text is worked on."""
    source = source or tokenizer_bytes()
    if lexicon is None:
        lexicon = build_lexicon(docs, source, lexicon_words)
    whole = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    sent = shared(docs.sparkSession, (source, lexicon, pieces(source)))

    # Both ways in one pass, so that a task has one worker and ids don't travel between two.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, block, piece = sent.value
        encoder = Encoder(Merger(merges), Lexicon(block) if block else None)
        for batch in batches:
            ids = encoder.encode_all([t.as_py() or "" for t in batch.column(1)])
            texts = [decoded(x, piece) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    return map_arrow(whole, run, f"row {whole.schema['row'].dataType.simpleString()}, ids binary, decoded string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenized(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
