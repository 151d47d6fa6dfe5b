"""Exact Jaccard join of word n-gram sets, heavy and light sets apart.

Small sets are light: all their subsets of the fixed sizes that a link needs are enumerated,
and equal subsets meet. Large sets are heavy: the inverted lists of their prefix are scanned,
the prefix being as many n-grams as a linked set can't all miss. The boundary is the size at
which the cost of both together is least: a light set costs its subsets; a heavy one costs its
lists, and counting its n-grams at each meeting there, by the measured length of a list.

The n-grams that most lists would be long for (found by counting all prefixes) come last in the
global order, the longest lists at the very end, so they enter a prefix only where nothing
rarer is left. Any choice and order of them gives the same links; that is why their number can
have a bound.

Lists give candidate families. Prefixes are longer by some n-grams than they must be, and so
linked sets share so many n-grams of them: pairs that meet in fewer short lists are dropped.
A long list is cut where sizes are too far apart and gives star edges, which always count; of
the sets that a task has of it, only one for each such range of sizes is sent on. The connected
components of what is left are the families. Each set then travels to its family, where all
pairs are counted; a family too large for one task is dealt into blocks by size, and only blocks
of sizes that can be linked meet.

Equal sets are one class from the start and aren't expanded. The first pass keeps of each row its id and
a hash of its set, and these are grouped. A filter of the sets that several rows have then lets all other
rows' sets be written where they are read; of the rows it holds back, a second filter chooses those
that may have a class's least id, and only their texts are exchanged (a set takes more room than its text
and doesn't compress), combined and made sets again. The sets are written once, a row a class, and
all later passes read them there. An n-gram is known by 64 bits: two different ones in a pair of sets of a thousand
n-grams each are taken for equal with a chance of about 5e-14.

Defined results: null and empty texts, and texts without words, have no n-grams and no links; a
text with fewer words than n has one n-gram, the whole; a null doc_id sorts after all others;
rows with the same doc_id are separate documents; a very long text is one row, worked on whole
in its task's memory; an empty table gives no rows; other columns aren't looked at, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, shared, stage_table, tidy
from .components import components
from .kernels import Hasher, ascii_lower, byte_class, hash_runs, mix, slices, spans_of, utf8
from .packed import BUCKET_BYTES, NO_ID, pack, pack_sorted, unpack, unpack_sorted
from .substring_dedup import runs

WIDTH = 4
PERCENT = 85
#: In more prefixes than these an n-gram is put last in the order, up to so many n-grams.
LONG_LIST = 16
#: Lists up to this length show their pairs, others a star.
PAIRED_LIST = 32
MOST_LAST = 1 << 20
ROUNDS = 4
#: Sets, and n-grams, that a task counts the pairs of at once.
FAMILY_SETS = 1_000
FAMILY_GRAMS = 1_000_000
#: Rows and sets are sieved by so many bits (as a power of two: four megabytes).
SIEVE = 25
#: N-grams of sets that a pass has in hand at a time.
SLICE_GRAMS = 1 << 18
#: Entries of lists that a pass has in hand at a time, and short lists' entries whose pairs are made at once.
SLICE_ENTRIES = 1 << 19
PAIRED_ENTRIES = 1 << 16
#: Pairs that are kept before equal ones are added up.
MOST_PAIRS = 1 << 21
#: A light set shows at most so many subsets, and all of them one for so many n-grams of all sets.
MOST_SUBSETS = 1 << 17
GRAMS_A_SUBSET = 8
#: A subset's entry takes the room in a bucket of so many bytes of n-grams, of which about a fifth enter lists.
ENTRY_BYTES = 40
_IN_WORD = byte_class(r"[^\x20\x09-\x0D]")
_SUBSET = np.uint64(0xA24BAED4963EE407)


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least size of a set that can be linked with one of n, and the least overlap with one of n or more."""
    return (percent * n + 99) // 100


def spare(n: int | np.ndarray) -> int | np.ndarray:
    """How many n-grams linked sets share in their prefixes at least, the lesser of both sets' numbers."""
    return 1 + n // 16


def prefix(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The n-grams of a set that are looked up in lists."""
    return np.minimum(n, n - needed(n, percent) + spare(n))


def overlap(n: int, m: int, percent: int) -> int:
    """The least intersection of linked sets of sizes n and m: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


@lru_cache(maxsize=256)
def subset_sizes(n: int, light: int, percent: int) -> tuple[int, ...]:
    """The sizes of subsets that a set of n must show to meet every linked set of at most `light`."""
    return tuple(sorted({overlap(n, m, percent) for m in range(needed(n, percent), min(light, 100 * n // percent) + 1)}))


@lru_cache(maxsize=256)
def shown(n: int, light: int, percent: int) -> int:
    """How many subsets a light set of n shows."""
    return sum(comb(n, c) for c in subset_sizes(n, light, percent))


def boundary(sizes: dict[int, int], list_length: float, percent: int, most: float = float("inf")) -> int:
    """The largest size of a light set, by the numbers of sets of each (small) size.

    A light set costs its subsets, and its lists too if it can be linked with a heavy one. A
    heavy set costs its lists: one for itself in each, and its n-grams for each set met there.
    Lists grow with the input, so by cost alone a set would show ever more subsets; as these are
    exchanged, the light sets show at most `most` in all."""

    def scanned(n: int) -> float:
        return int(prefix(n, percent)) * (1 + max(0.0, list_length - 1) * n)

    def whole(light: int) -> float:
        total = 0.0
        for n, sets in sizes.items():
            if n > light:
                total += sets * scanned(n)
            else:
                total += sets * shown(n, light, percent)
                total += sets * int(prefix(n, percent)) * (100 * n >= percent * (light + 1))
        return total

    costs = [whole(0)]
    for light in count(1):
        # One set of this size alone would cost more than no enumeration at all, or show too much, as any larger one does.
        if light > max(sizes, default=0) or shown(light, light, percent) > min(costs[0], MOST_SUBSETS):
            return int(np.argmin(costs))
        if sum(sets * shown(n, light, percent) for n, sets in sizes.items() if n <= light) > most:
            return int(np.argmin(costs))
        costs.append(whole(light))


def gram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams' hashes, sorted and distinct in each text, and where each text's begin."""
    n = len(offsets) - 1
    data = ascii_lower(data)
    starts, ends, doc = spans_of(_IN_WORD[data], offsets)
    words = Hasher(data).of(starts, ends)
    grams = hash_runs(words, width)
    whole = doc[: len(grams)] == doc[width - 1 :] if len(grams) else np.empty(0, bool)
    grams, owner = grams[whole], doc[: len(whole)][whole]
    first = np.searchsorted(doc, np.arange(n + 1))
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    alone = [hash_runs(words[first[d] : first[d + 1]], int(first[d + 1] - first[d]))[0] ^ np.uint64(first[d + 1] - first[d]) for d in short]
    grams, owner = np.concatenate([grams, np.array(alone, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = runs(grams, owner)
    return grams[new], np.searchsorted(owner[new], np.arange(n + 1))


def with_sets(rows: DataFrame, text: Column, width: int, sets: bool, kept: list[str] | None = None, chosen: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """The columns of rows that are kept (all by default) with n, s and t (size and a 128-bit hash of the text's set), and the set itself if asked for.

    With chosen, only those rows that it is true for, by arrays of the kept columns (as structs), n, s and t."""
    whole = rows.select(F.struct(*(kept or rows.columns)).alias("row"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                grams, first = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ salt), dtype=np.uint64)]) for salt in (_SUBSET, ~_SUBSET)]
                s, t = ((x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums)
                columns = [batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in (np.diff(first), s, t))]
                if sets:
                    ends = (first * 8).astype(np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(grams)]))
                out = pa.RecordBatch.from_arrays(columns, ["row", "n", "s", "t", "grams"][: len(columns)])
                yield out if chosen is None else out.filter(pa.array(chosen(columns[0], np.diff(first), s, t)))

    described = map_arrow(whole, run, f"row {whole.schema['row'].dataType.simpleString()}, n bigint, s bigint, t bigint" + ", grams binary" * sets)
    return described.select("row.*", *described.columns[1:])


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a column of sets one after another, and where each set begins."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.frombuffer(data.tobytes(), np.uint64), (ends - ends[0]) // 8


def _in_hand(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The classes' numbers, n-grams and their beginnings, some sets at a time."""
    grams, first = grams_of(batch.column(1))
    rep = batch.column(0).to_numpy()
    for i, j in slices(first, SLICE_GRAMS):
        yield rep[i:j], grams[first[i] : first[j]], first[i : j + 1] - first[i]


def _late(grams: np.ndarray, last: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams come last in the order, and where they are among these."""
    known = last[0]
    if not len(known):
        return np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return known[place] == grams, place


def _in_prefix(late: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams of each set's prefix that don't come last."""
    size = np.diff(first)
    before = np.concatenate([[0], np.cumsum(~late)])
    return ~late & (before[1:] - np.repeat(before[first[:-1]], size) <= np.repeat(prefix(size, percent), size))


def bucketed(key: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys by their top bits."""
    cuts = np.searchsorted((key >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    return ((b, int(i), int(j)) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i)


def _blocks(make: Callable[[pa.RecordBatch], Iterator[tuple[int, bytes]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(make(batch))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "block"])

    return run


def _count_rows(batch: pa.RecordBatch, percent: int, bits: int, old: tuple | None, new: tuple) -> Iterator[tuple[int, bytes]]:
    """(bucket, block): how many prefixes here hold each n-gram that wasn't in them before the order changed."""
    found = []
    for _, grams, first in _in_hand(batch):
        chosen = _in_prefix(_late(grams, new)[0], first, percent)
        if old is not None:
            chosen &= ~_in_prefix(_late(grams, old)[0], first, percent)
        found.append(grams[chosen])
    values, counts = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
    return ((b, pack_sorted(values[i:j], counts[i:j].astype(np.int32))) for b, i, j in bucketed(values, bits))


def _count_lists(table: pa.Table, most: int) -> pa.Table:
    """(gram, n) of the long lists; one row more, without gram, has the sums of the others' lengths and their squares."""
    parts = [unpack_sorted(b.as_py()) for b in table.column("block")]
    grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    begins = runs(grams)
    n = np.add.reduceat(counts.astype(np.int64), begins)
    long = n > most
    rest = n[~long].astype(np.float64)
    return pa.table(
        {
            "gram": pa.array([*grams[begins][long].view(np.int64).tolist(), None], pa.int64()),
            "n": pa.array([*n[long].astype(float).tolist(), rest.sum()], pa.float64()),
            "squares": pa.array([*[0.0] * int(long.sum()), (rest**2).sum()], pa.float64()),
        }
    )


@lru_cache(maxsize=64)
def _choices(n: int, k: int) -> np.ndarray:
    """All choices of k of n places, a row each."""
    return np.fromiter((x for chosen in combinations(range(n), k) for x in chosen), np.uint8).reshape(comb(n, k), k)


def subset_keys(grams: np.ndarray, light: int, percent: int) -> np.ndarray:
    """A hash of each subset that a light set shows."""
    return subset_table(grams[None, :], light, percent)[0]


def subset_table(grams: np.ndarray, light: int, percent: int) -> np.ndarray:
    """The same for sets of one size, a row each.

    A subset's sum is the whole's less what is left out, which is the smaller part."""
    n = grams.shape[1]
    mixed, out = mix(grams ^ _SUBSET), []
    whole = mixed.sum(axis=1, dtype=np.uint64)[:, None]
    for c in subset_sizes(n, light, percent):
        less = 2 * c > n
        places = _choices(n, n - c if less else c)
        sums = np.zeros((len(grams), len(places)), np.uint64)
        for at in places.T:
            sums += mixed[:, at]
        out.append(mix((whole - sums if less else sums) + np.uint64(c)))
    return np.concatenate(out, axis=1)


def _entries(rep: np.ndarray, grams: np.ndarray, first: np.ndarray, percent: int, last: tuple[np.ndarray, np.ndarray], light: int) -> tuple[np.ndarray, ...]:
    """(key, row, size, star) of all lists that the sets enter. Stars are for n-grams that come last, and for subsets."""
    size = np.diff(first)
    late, place = _late(grams, last)
    heavy = (size > light) | (100 * size >= percent * (light + 1))  # it can be linked with a heavy set
    chosen = _in_prefix(late, first, percent) & np.repeat(heavy, size)
    owner = np.repeat(np.arange(len(size)), size)
    keys, owners = [grams[chosen]], [owner[chosen]]
    usual = len(keys[0])
    lacking = prefix(size, percent) - np.bincount(owners[0], minlength=len(size))
    for d in np.flatnonzero(heavy & (lacking > 0)):
        own = np.flatnonzero(late[first[d] : first[d + 1]]) + first[d]
        by_rank = np.argsort(last[1][place[own]], kind="stable")[: lacking[d]]
        keys.append(grams[own[by_rank]])
        owners.append(np.full(len(by_rank), d))
    for n in np.unique(size[(size <= light) & (size > 0)]):
        own = np.flatnonzero(size == n)
        found = subset_table(grams[first[own][:, None] + np.arange(n)], light, percent)
        keys.append(found.ravel())
        owners.append(np.repeat(own, found.shape[1]))
    key, who = np.concatenate(keys), np.concatenate(owners)
    return key, rep[who], size[who], np.arange(len(key)) >= usual


def _ranges(new_key: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Where a range of sizes begins in each key: no set before it can be linked with one from there on. Sorted by low.

    new_key says where keys begin."""
    greatest = int(high.max(initial=0)) + 1
    reach = np.maximum.accumulate((np.cumsum(new_key) - 1) * greatest + high) % greatest
    out = new_key.copy()
    out[1:] |= 100 * reach[:-1] < percent * low[1:]
    return out


def _list_rows(batch: pa.RecordBatch, percent: int, bits: int, last: tuple[np.ndarray, np.ndarray], light: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block): this batch's parts of the lists: key, class, least and greatest size, star.

    A part has about SLICE_ENTRIES entries, as light sets can show very many. What a star has in it is one entry a range of
    sizes; the others' edges come under a negative bucket."""
    subsets = np.array([0, *(shown(n, light, percent) for n in range(1, light + 1)), 0])
    for rep, grams, first in _in_hand(batch):
        size = np.diff(first)
        most = np.cumsum([0, *(prefix(size, percent) + subsets[np.minimum(size, light + 1)])])
        for i, j in slices(most, SLICE_ENTRIES):
            yield from _list_part(rep[i:j], grams[first[i] : first[j]], first[i : j + 1] - first[i], percent, bits, last, light)


def _list_part(rep: np.ndarray, grams: np.ndarray, first: np.ndarray, percent: int, bits: int, last: tuple[np.ndarray, np.ndarray], light: int) -> Iterator[tuple[int, bytes]]:
    key, row, size, star = _entries(rep, grams, first, percent, last, light)
    order = np.lexsort((row, size, key, star))
    key, row, size, star = (x[order] for x in (key, row, size, star))
    high = size.copy()
    n = int((~star).sum())
    if n < len(key):
        fresh = np.ones(len(key) - n, bool)
        fresh[1:] = key[n + 1 :] != key[n:-1]
        begins = np.flatnonzero(_ranges(fresh, size[n:], size[n:], percent)) + n
        head = np.repeat(row[begins], np.diff(np.append(begins, len(key))))
        high[begins] = np.maximum.reduceat(size, begins) if len(begins) else high[begins]
        other = row[n:] != head
        if other.any():
            yield -1 - int(row[0]), pack(row[n:][other], head[other])
        kept = np.concatenate([np.arange(n), begins])
        key, row, size, high, star = (x[kept] for x in (key, row, size, high, star))
        order = np.argsort(key, kind="stable")
        key, row, size, high, star = (x[order] for x in (key, row, size, high, star))
    for b, i, j in bucketed(key, bits):
        yield b, pack_sorted(key[i:j], row[i:j], size[i:j].astype(np.int32), high[i:j].astype(np.int32), star[i:j])


def _list_edges(table: pa.Table, percent: int) -> pa.Table:
    """(a, b, met, least): pairs of the short lists, how often they met here and had to; star edges of the others."""
    blocks = [b.as_py() for b in table.column("block")]
    if table.column("bucket")[0].as_py() < 0:
        a, b = (np.concatenate(x) for x in zip(*map(unpack, blocks)))
        return _edges(a, b, np.zeros(len(a), np.int64))
    parts = [unpack_sorted(b) for b in blocks]
    key, row, low, high, star = (np.concatenate([p[k] for p in parts]) for k in range(5))
    del blocks, parts
    order = np.lexsort((row, low, key))
    key, row, low, high, star = (x[order] for x in (key, row, low.astype(np.int64), high.astype(np.int64), star))
    del order
    begins = runs(key)
    length = np.diff(np.append(begins, len(key)))
    star = np.repeat(np.logical_or.reduceat(star, begins) | (length > PAIRED_LIST), length)
    fresh = np.zeros(len(key), bool)
    fresh[begins] = True
    of = np.flatnonzero(star)
    out = []
    if len(of):
        new = np.flatnonzero(_ranges(fresh[of], low[of], high[of], percent))
        head = np.repeat(row[of][new], np.diff(np.append(new, len(of))))
        other = row[of] != head
        out.append(_summed(row[of][other], head[other], np.zeros(int(other.sum()), np.int64)))
    del of, fresh, high
    key, row, low = (x[~star] for x in (key, row, low))
    # Some lists at a time, as a list shows up to half its square of pairs.
    begins = runs(key)
    near = np.searchsorted(begins, np.arange(0, len(key), PAIRED_ENTRIES))
    cuts = np.unique(np.append(begins[near[near < len(begins)]], len(key)))
    for s, e in zip(cuts, cuts[1:]):
        pairs = []
        for step in range(1, PAIRED_LIST):
            i = np.arange(s, e - step)
            i = i[(key[i] == key[i + step]) & (100 * low[i] >= percent * low[i + step])]
            if not len(i):
                break
            pairs.append((row[i], row[i + step], spare(low[i])))
        if pairs:
            out.append(_summed(*(np.concatenate([x[k] for x in pairs]) for k in range(3))))
        if sum(len(x[0]) for x in out[1:]) > MOST_PAIRS:
            out = [_summed(*(np.concatenate([x[k] for x in out]) for k in (0, 1, 3)), np.concatenate([x[2] for x in out]))]
    empty = np.empty(0, np.int64)
    return _edges(*(np.concatenate([x[k] for x in out] or [empty]) for k in (0, 1, 3)), np.concatenate([x[2] for x in out] or [empty]))


def _summed(a: np.ndarray, b: np.ndarray, least: np.ndarray, met: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(a, b, met, least) of each different pair, the greater row first: how often it met, and the least of what it had to."""
    a, b = np.maximum(a, b), np.minimum(a, b)
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    pair = runs(a, b)
    if not len(pair):
        return a, b, np.empty(0, np.int64), least
    met = np.diff(np.append(pair, len(a))) if met is None else np.add.reduceat(met[order], pair)
    return a[pair], b[pair], met, np.minimum.reduceat(least, pair)


def _edges(a: np.ndarray, b: np.ndarray, least: np.ndarray, met: np.ndarray | None = None) -> pa.Table:
    a, b, met, least = _summed(a, b, least, met)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "met": pa.array(met.astype(np.int32), pa.int32()), "least": pa.array(least.astype(np.int32), pa.int32())})


def linked_pairs(grams: np.ndarray, first: np.ndarray, percent: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of sets; with split, only of pairs across it.

    The inverted lists of the sets are scanned: a list adds one to each pair it holds."""
    size = np.diff(first)
    m = len(size)
    left, right = (m, 0) if split is None else (split, split)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    begins = runs(grams)
    length = np.diff(np.append(begins, len(grams)))
    several = length > 1
    owner, length = owner[np.repeat(several, length)], length[several]
    column = np.repeat(np.arange(len(length)), length)
    common = np.zeros((left, m - right), np.float32)
    for c in range(0, len(length), 1024):
        i, j = np.searchsorted(column, (c, c + 1024))
        used, at = np.unique(owner[i:j], return_inverse=True)
        held = np.zeros((len(used), 1024), np.float32)
        held[at, column[i:j] - c] = 1
        rows, columns = used < left, used >= right
        common[np.ix_(used[rows], used[columns] - right)] += held[rows] @ held[columns].T
    found = []
    for r in range(0, left, 128):  # some rows at a time, as sums of sizes take more room than the counts
        own = common[r : r + 128]
        both = (size[r : r + len(own), None] + size[None, right:]).astype(np.float32) - own
        i, j = np.nonzero((own > 0) & (100 * own >= percent * both))
        i, j = i + r, j + right
        found.append(np.stack([i, j])[:, j > i].astype(np.int32))
    return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, np.int32), np.empty(0, np.int32))


def _family_links(rows: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, the least row it is connected to here, linked documents of other sets) from the linked pairs i, j; rows are sorted."""
    links = np.bincount(i, weights=copies[j], minlength=len(rows)) + np.bincount(j, weights=copies[i], minlength=len(rows))
    label = np.arange(len(rows))
    while True:  # the least place that is reached, over links and over what is reached already
        near = label.copy()
        np.minimum.at(near, i, label[j])
        np.minimum.at(near, j, label[i])
        near = near[near]
        if (near == label).all():
            break
        label = near
    own = np.flatnonzero(links)
    return rows[own], rows[label[own]], links[own].astype(np.int64)


def _counted_families(table: pa.Table, percent: int) -> pa.Table:
    """The links of some small families, or of a pair of blocks of a large one."""
    column = lambda c: table.column(c).to_numpy()
    order = np.lexsort((column("row"), column("block"), column("family")))
    family, block, row, copies = (column(c)[order] for c in ("family", "block", "row", "copies"))
    sets, low, high = table.column("grams"), column("low")[0], column("high")[0]
    out = []
    cuts = np.append(runs(family), len(family))
    for a, b in zip(cuts, cuts[1:]):
        own = [np.frombuffer(sets[int(k)].as_py(), np.uint64) for k in order[a:b]]
        first = np.cumsum([0, *map(len, own)])
        i, j = linked_pairs(np.concatenate(own), first, percent, int((block[a:b] == low).sum()) if low < high else None)
        by_row = np.argsort(row[a:b], kind="stable")
        place = np.empty(b - a, np.int64)
        place[by_row] = np.arange(b - a)
        out.append(_family_links(row[a:b][by_row], copies[a:b][by_row], place[i], place[j]))
    return pa.table({name: pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k, name in enumerate(("row", "root", "links"))})


def _last_ones(classes: DataFrame, percent: int, bits: int, long_list: int) -> tuple[Callable, float]:
    """The n-grams that come last, and their ranks, as a broadcast; and the mean length of the list that an n-gram is in.

    The order is settled in rounds: what is put last makes room in prefixes for others, which may
    turn out to be frequent too. At most MOST_LAST numbers of eight bytes, and their ranks, are
    collected and broadcast."""
    spark, sets = classes.sparkSession, classes.select("rep", "grams")
    longest, lengths = np.empty(0, np.int64), np.empty(0)
    old, usual, found = None, 1.0, 1
    for turn in range(ROUNDS):
        order = np.lexsort((longest, lengths))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        by_gram = np.argsort(longest.view(np.uint64), kind="stable")
        last = shared(spark, (longest.view(np.uint64)[by_gram], rank[by_gram]))
        if turn == ROUNDS - 1 or not found:
            break
        counted = map_arrow(sets, _blocks(lambda b, old=old, new=last: _count_rows(b, percent, bits, old and old.value, new.value)), "bucket bigint, block binary")
        counted = stage_table(counted.groupBy("bucket").applyInArrow(tidy(lambda t: _count_lists(t, long_list)), "gram bigint, n double, squares double"), "lists")
        if not turn:
            usual = counted.agg(F.sum(F.coalesce("squares", F.lit(0.0)) + F.when(F.col("gram").isNotNull(), F.col("n") * F.col("n")).otherwise(0.0)) / F.sum("n")).first()[0] or 1.0
        more = counted.where("gram is not null").orderBy(F.desc("n"), "gram").limit(MOST_LAST - len(longest)).select("gram", "n").toPandas()
        found = len(more)
        longest, lengths, old = np.concatenate([longest, more["gram"].to_numpy(np.int64)]), np.concatenate([lengths, more["n"].to_numpy(float)]), last
    return last, float(usual)


def sieve(bits: DataFrame) -> Broadcast:
    """A filter in which the bits (b, less than 2^SIEVE) are set, whatever their number."""
    words = bits.groupBy(F.shiftright("b", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = words.toPandas()
    table = np.zeros(1 << (SIEVE - 6), np.int64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return shared(bits.sparkSession, table)


def held(filter_: Broadcast, b: np.ndarray) -> np.ndarray:
    """Which of the bits are set in a filter."""
    return ((filter_.value.view(np.uint64)[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def sieved(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of sets whose rep may be among those of wanted, by a filter of 2^SIEVE bits.

    None that is wanted is lost. The filter's size is fixed: with very many wanted ones it lets more
    through, and what it spares is only a part of the exchange that follows."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIEVE))
    sent = sieve(wanted.select(bit("rep").alias("b")))
    names = sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = held(sent, batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(hit))

    return map_arrow(sets.select(*names, bit("rep").alias("_bit")), run, sets.schema)


def class_sets(texts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(least, copies, n, s, t, grams): each distinct set of texts (id, text) once; rows (id, n, s, t) says which row has which set.

    Only texts whose set is another row's too, and of these little more than one a set, are exchanged. Both filters are of
    2^SIEVE bits: with very many copied sets they let more texts through, which changes nothing else."""
    last = (1 << SIEVE) - 1
    # The sets' hashes are mixed, so their bits are as good as any.
    bit = F.col("s").bitwiseAND(F.lit(last))
    counts = stage_table(rows.where("n > 0").groupBy("n", "s", "t").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "counts")
    bits = counts.where("copies > 1").select(bit.alias("b")).distinct()
    several = sieve(bits)
    # The sets whose bit is set, copied or not.
    marked = stage_table(counts.withColumn("b", bit).join(bits, "b", "left_semi").drop("b"), "marked")
    firsts = sieve(marked.select(F.col("t").bitwiseXOR(F.col("least")).bitwiseAND(F.lit(last)).alias("b")))
    alone = lambda row, n, s, t: (n > 0) & ~held(several, s & last)
    may_be_first = lambda row, n, s, t: (n > 0) & held(several, s & last) & held(firsts, (t ^ row.field("id").to_numpy()) & last)
    own = with_sets(texts, F.col("text"), width, True, ["id"], alone).select(F.col("id").alias("least"), F.lit(1).cast("bigint").alias("copies"), "n", "s", "t", "grams")
    # Any text of a class has its set.
    met = with_sets(texts, F.col("text"), width, False, ["id", "text"], may_be_first).select("n", "s", "t", "text")
    known = marked.select("n", "s", "t", F.lit(None).cast("string").alias("text"), "least", "copies")
    one = met.unionByName(known, True).groupBy("n", "s", "t").agg(F.first("text", True).alias("text"), F.max("least").alias("least"), F.max("copies").alias("copies"))
    return own.unionByName(with_sets(one, F.col("text"), width, True, ["least", "copies"]))


def _counted(slim: DataFrame, sets: DataFrame, percent: int, family_sets: int, tasks: int) -> DataFrame:
    """(row, root, links) from slim (rep, family, copies, n) and the sets (rep, grams): the pairs of each family counted.

    Small families share tasks, whose numbers are negative. A large one is dealt into blocks: by
    classes of sizes, of which only neighbours hold links, and by numbers of sets in each class."""
    size_class = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("bigint")
    too_many = F.greatest(F.ceil(F.col("sets") / family_sets), F.ceil(F.col("all_grams") / FAMILY_GRAMS)).cast("bigint")
    sums = (F.count("*").alias("sets"), F.sum("n").alias("all_grams"))
    large = slim.groupBy("family").agg(*sums).where(too_many > 1).select("family")
    blocks = slim.join(large, "family").groupBy("family", size_class.alias("class")).agg(*sums).select("family", "class", too_many.alias("blocks"))
    near = blocks
    for step, name in ((-1, "before"), (1, "after")):
        near = near.join(blocks.select("family", (F.col("class") - step).alias("class"), F.col("blocks").alias(name)), ["family", "class"], "left")
    # Where each set goes is settled without the n-grams; they travel once to meet it, then to the tasks.
    placed = stage_table(slim.withColumn("class", size_class).join(near, ["family", "class"], "left"), "placed")
    # By a merge at every size: nothing of it depends on what could be broadcast.
    placed = sieved(sets, placed).join(placed.hint("merge"), "rep")
    code = lambda c, k: c * (1 << 32) + k
    own = code(F.col("class"), F.pmod(F.xxhash64("rep"), F.col("blocks")))
    others = lambda c, n: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1), lambda k: code(c, k))).otherwise(F.array().cast("array<bigint>"))
    met = F.concat(others(F.col("class") - 1, "before"), others(F.col("class"), "blocks"), others(F.col("class") + 1, "after"))
    shared_task = -1 - F.pmod(F.xxhash64("family"), F.lit(tasks))
    sent = placed.select(
        F.coalesce(F.when(F.col("blocks").isNotNull(), F.col("family")), shared_task).alias("task"),
        "family",
        F.coalesce(own, F.lit(0)).alias("block"),
        F.explode(F.when(F.col("blocks").isNotNull(), met).otherwise(F.array(F.lit(0).cast("bigint")))).alias("other"),
        F.col("rep").alias("row"),
        "copies",
        "grams",
    )
    sent = sent.select("task", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "family", "block", "row", "copies", "grams")
    return sent.groupBy("task", "low", "high").applyInArrow(tidy(lambda t: _counted_families(t, percent)), "row bigint, root bigint, links bigint")


def set_groups(docs: DataFrame, width: int, percent: int, long_list: int, family_sets: int, key: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    """(n, s, t, least, keeper, n_links) of each distinct set: the least id of its component, whether this set has it, its links.

    With it (id, n, s, t) of each row, where a missing id is null."""
    rows = stage_table(with_sets(docs.select(key.cast("bigint").alias("id"), text.alias("text")), F.col("text"), width, False, ["id"]), "rows")
    known = F.coalesce("id", F.lit(NO_ID)).alias("id")
    classes = class_sets(docs.select(key.cast("bigint").alias("id"), text.alias("text")).select(known, "text"), rows.select(known, "n", "s", "t"), width)
    classes = stage_table(classes.withColumn("rep", F.monotonically_increasing_id()), "sets")
    slim = classes.drop("grams")
    sizes = {r["n"]: r["sets"] for r in slim.where("n <= 64").groupBy("n").agg(F.count("*").alias("sets")).collect()}
    total = slim.agg(F.sum("n")).first()[0] or 0
    bits_of = lambda size: (1 << max(7, size // BUCKET_BYTES).bit_length()).bit_length() - 1
    bits = bits_of(total * 8)
    last, usual = _last_ones(classes, percent, bits, long_list)
    light = boundary(sizes, usual, percent, total / GRAMS_A_SUBSET)
    # Subsets are entries of lists too: with very many, there are more buckets.
    subsets = sum(k * shown(n, light, percent) for n, k in sizes.items() if n <= light)
    list_bits = bits_of(total * 8 + subsets * ENTRY_BYTES)
    listed = map_arrow(classes.select("rep", "grams"), _blocks(lambda b: _list_rows(b, percent, list_bits, last.value, light)), "bucket bigint, block binary")
    edges = listed.groupBy("bucket").applyInArrow(tidy(lambda t: _list_edges(t, percent)), "a bigint, b bigint, met int, least int")
    edges = edges.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("least").alias("least")).where("met >= least").select("a", "b")
    families = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = stage_table(families.join(slim.select("rep", "copies", "n"), "rep"), "members")
    links = stage_table(_counted(members, classes.select("rep", "grams"), percent, family_sets, 4 << bits), "links")
    joined = components(links.select(F.col("row").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("row").agg(F.sum("links").alias("links"))
    grouped = slim.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").join(counts.select(F.col("row").alias("rep"), "links"), "rep", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "rep"))
    leasts = grouped.where("links is not null").groupBy("component").agg(F.min(F.struct("least", "rep")).alias("first"))
    return grouped.join(leasts, "component", "left").select(
        "n",
        "s",
        "t",
        F.coalesce("first.least", "least").alias("least"),
        (F.coalesce("first.rep", "rep") == F.col("rep")).alias("keeper"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    ), rows


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, long_list: int = LONG_LIST, family_sets: int = FAMILY_SETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each document.

    Two documents are linked when 100 |A and B| >= percent |A or B| for their sets."""
    groups, rows = set_groups(docs, width, percent, long_list, family_sets, F.col(key), F.col(text))
    known = F.when(F.col("least") != NO_ID, F.col("least"))
    return rows.withColumnRenamed("id", "doc_id").join(groups.select("n", "s", "t", "least", "n_links"), ["n", "s", "t"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(known, F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, key: str = "doc_id", text: str = "text", long_list: int = LONG_LIST, family_sets: int = FAMILY_SETS) -> DataFrame:
    """The rows of docs, with all columns, but of each component only the one with the smallest id.

    Of rows with that id and the same set, the one with the least hash of the whole row stays.
    Rows are combined by id and set before they are exchanged, once, and meet the sets' keepers."""
    groups, _ = set_groups(docs, width, percent, long_list, family_sets, F.col(key), F.col(text))
    keepers = groups.where("keeper").select("n", "s", "t", F.col("least").alias("id"), F.lit(True).alias("keeper"))
    rows = with_sets(docs.select(F.struct(*docs.columns).alias("doc")), F.col(f"doc.`{text}`"), width, False)
    # A row without a set stays whatever its id: a number of its own takes the place of the set's hash.
    rows = rows.withColumn("id", F.coalesce(F.col(f"doc.`{key}`").cast("bigint"), F.lit(NO_ID))).withColumn("s", F.when(F.col("n") == 0, F.monotonically_increasing_id()).otherwise(F.col("s")))
    one = rows.groupBy("n", "s", "t", "id").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return one.join(keepers, ["n", "s", "t", "id"], "left").where((F.col("n") == 0) | F.col("keeper")).select("doc.*")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))
