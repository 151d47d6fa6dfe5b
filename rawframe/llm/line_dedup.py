"""Removal of repeated lines, exact ones and those one edit apart.

A line is its sequence of words. A line goes if an earlier one (by doc_id, then place) is equal
to it or at most one inserted, deleted or replaced unit away. The unit is a word where both
lines have NEAR_WORDS words or more. Where one has fewer, which is any line of a script without
spaces, the unit is a character (words a space apart), and both have as many characters at least.

Near lines are found by a deletion-neighbourhood join: each line shows itself and all its
variants with one unit deleted, as hashed keys of 128 bits; lines with an equal key meet, and
the edit distance is verified from where the unit was deleted: two lines less a unit at the
same place differ by a replacement; a line and another less a unit, by an insertion. Other
meetings are farther apart and don't count. What a meeting keeps is its earliest line, so no
pairs are formed.

Only lines that may have a neighbour show variants: one edit leaves the beginning or the end of
a line as it is, so lines are first exchanged by hashes of both, and those alone in both drop
out. Before each exchange a batch of texts has settled its own repeats, so a line that a third
of all documents hold is one entry a batch.

Defined results: null and empty texts have no lines and stay; blank lines are never removed; a
null doc_id sorts after all others, rows with the same doc_id go by their place in the table;
an empty table gives no rows; other columns go through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stage_table, tidy
from .kernels import Hasher, byte_class, mix, powers, slices, spans_of
from .packed import BATCH_BYTES, Batch, bucket_count, pack, pack_sorted, pack_texts, unpack, unpack_sorted
from .substring_dedup import runs

NEAR_WORDS = 8
#: Variants of characters are made for so many bytes of lines at a time.
CHARACTER_BYTES = 1 << 18
#: Meetings are settled for about so many keys at a time.
MOST_MEETING = 1 << 21
_IN_WORD = byte_class(r"[^\x00-\x20]")
_SALTS = (np.uint64(0), np.uint64(0xC2B2AE3D27D4EB4F))
_HALF = (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
#: The lengths of beginnings and ends that are compared: each about a third more than the one before.
_GRID = np.array([1, 2, 3, *(int(4 * 1.34**k) for k in range(60))], np.int64)


class Units:
    """Hashes of any run of units, from running sums over the units' own."""

    def __init__(self, hashes: np.ndarray):
        up, self._down = powers(len(hashes) + 1)
        self._up = up
        self._sums = []
        for salt in _SALTS:
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(mix(hashes ^ salt) * up[: len(hashes)], dtype=np.uint64, out=sums[1:])
            self._sums.append(sums)

    def raw(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self._sums[which][b] - self._sums[which][a]) * self._down[a]

    def hashes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the units a to b."""
        return tuple(mix(self.raw(k, a, b) ^ (b - a).astype(np.uint64)) for k in (0, 1))

    def without(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the units a to b but one."""
        return tuple(mix((self.raw(k, a, at) + self.raw(k, at + 1, b) * self._up[at - a]) ^ (b - a - 1).astype(np.uint64)) for k in (0, 1))

    def variants(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each run a to b itself and of it less each unit, which run, and the unit's place (-1: itself)."""
        n = b - a
        run = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h, g = self.hashes(a, b)
        vh, vg = self.without(a[run], b[run], a[run] + place)
        return np.concatenate([h, vh]), np.concatenate([g, vg]), np.concatenate([np.arange(len(n)), run]), np.concatenate([np.full(len(n), -1), place])


class Lines(Units):
    """The lines of a batch, and their words as units."""

    def __init__(self, batch: Batch):
        starts, ends, doc = spans_of(batch.data != 10, batch.offsets)
        words, stops, _ = spans_of(_IN_WORD[batch.data], batch.offsets)
        first = np.searchsorted(words, starts)
        last = np.searchsorted(words, ends)
        full = last > first
        self.starts, self.ends, self.doc = starts[full], ends[full], doc[full]
        self.first, self.last = first[full], last[full]
        #: Where the first word begins and the last one ends.
        self.begin, self.end = words[self.first], stops[self.last - 1]
        super().__init__(Hasher(batch.data).of(words, stops))


class Characters(Units):
    """The characters of some lines of a batch as units, one space between words."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        n = end - begin
        starts = np.cumsum(n) - n
        byte = data[np.arange(n.sum()) + np.repeat(begin - starts, n)]
        word, more = _IN_WORD[byte], (byte & 0xC0) == 0x80
        unit = word & ~more
        unit[:-1] |= ~word[:-1] & word[1:]
        value = np.where(word, byte, 32).astype(np.uint64)
        for k in (1, 2, 3):
            at = np.flatnonzero(unit[:-k] & np.logical_and.reduce([more[j : len(more) - k + j] for j in range(1, k + 1)]))
            value[at] |= byte[at + k].astype(np.uint64) << np.uint64(8 * k)
        at = np.flatnonzero(unit)
        self.first, self.last = np.searchsorted(at, starts), np.searchsorted(at, starts + n)
        super().__init__(value[at])


def _characters(batch: Batch, lines: Lines, at: np.ndarray) -> Iterator[tuple[np.ndarray, Characters]]:
    """The lines `at` in runs, with their characters."""
    begin, end = lines.begin[at], lines.end[at]
    for i, j in slices(np.append(0, np.cumsum(end - begin)), CHARACTER_BYTES):
        yield at[i:j], Characters(batch.data, begin[i:j], end[i:j])


def _reach(m: np.ndarray) -> np.ndarray:
    """How many units at the beginning, or at the end, two lines share that are an edit apart, the shorter of m units, at least."""
    return _GRID[np.searchsorted(_GRID, m // 2, "right") - 1]


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _bucketed(key: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    cuts = np.searchsorted((key >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    return ((b, int(i), int(j)) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i)


def _line_entries(number: int, batch: Batch, near: int, bits: int) -> list[tuple]:
    """(bucket, batch, kind, block): each distinct line's first place (kind 0), and its beginnings and ends (kind 1).

    In kind 1 a line stands for its words, and its number plus that of all lines for its characters."""
    lines = Lines(batch)
    h, g = lines.hashes(lines.first, lines.last)
    ids = batch.ids[lines.doc]
    order = _order(h, g, ids, np.arange(len(h)))
    own = order[runs(h[order], g[order])] if len(h) else order
    h, g, ids, words = h[own], g[own], ids[own], (lines.last - lines.first)[own]
    out = [(b, number, 0, pack_sorted(h[i:j], g[i:j], ids[i:j], own[i:j].astype(np.int32))) for b, i, j in _bucketed(h, bits)]
    keys, whose, forms = [], [], []
    long = np.flatnonzero(words >= near)
    at, n = own[long], words[long]
    for m in (n, n - 1):
        reach = _reach(m)
        for side, salt in enumerate(_HALF):
            a = lines.first[at] if side == 0 else lines.last[at] - reach
            keys.append(lines.hashes(a, a + reach)[0] ^ salt)
            whose.append(long)
            forms.append(at)
    # A line one character from one of fewer words has no more than `near`, so those have both forms.
    short = np.flatnonzero(words <= near)
    short = short[np.argsort(own[short])]
    done = 0
    for at, chars in _characters(batch, lines, own[short]):
        n = chars.last - chars.first
        enough = np.flatnonzero(n >= near)
        for m in (n[enough], n[enough] - 1):
            reach = m // 2
            for side, salt in enumerate(_HALF):
                a = chars.first[enough] if side == 0 else chars.last[enough] - reach
                keys.append(mix(chars.hashes(a, a + reach)[1] ^ m.astype(np.uint64)) ^ salt)
                whose.append(short[done + enough])
                forms.append(at[enough] + len(lines.first))
        done += len(at)
    key, who, form = np.concatenate(keys), np.concatenate(whose), np.concatenate(forms)
    if len(key):
        order = _order(key, h[who], form)
        new = runs(key[order], h[who][order])
        key, who, form = (x[order][new] for x in (key, who, form))
        out += [(b, number, 1, pack_sorted(key[i:j], h[who[i:j]], form[i:j].astype(np.int32))) for b, i, j in _bucketed(key, bits)]
    return out


def _line_verdicts(table: pa.Table) -> pa.Table:
    """(batch, kind, block): the lines of each batch that another one has earlier (0), and those with company (1)."""
    kinds = table.column("kind").to_numpy()
    numbers = table.column("batch").to_numpy()
    out = []
    for kind in (0, 1):
        parts = [(int(numbers[k]), unpack_sorted(table.column("block")[int(k)].as_py())) for k in np.flatnonzero(kinds == kind)]
        if not parts:
            continue
        key, other = (np.concatenate([p[k] for _, p in parts]) for k in (0, 1))
        line = np.concatenate([p[-1] for _, p in parts])
        batch = np.repeat([b for b, _ in parts], [len(p[0]) for _, p in parts])
        if kind == 0:
            ids = np.concatenate([p[2] for _, p in parts])
            order = _order(key, other, ids, batch, line)
            hit = np.ones(len(key), bool)
            hit[runs(key[order], other[order])] = False
        else:
            order = _order(key, other)
            begins = runs(key[order])
            ends = np.append(begins[1:], len(key)) - 1
            alone = other[order][begins] == other[order][ends]
            hit = np.repeat(~alone, ends - begins + 1)
        batch, line = batch[order][hit], line[order][hit]
        order = np.argsort(batch, kind="stable")
        batch, line = batch[order], line[order]
        cuts = np.append(runs(batch), len(batch))
        out += [(int(batch[i]), kind, pack(np.unique(line[i:j]))) for i, j in zip(cuts, cuts[1:])]
    return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "block": pa.array([x[2] for x in out], pa.binary())})


def _verdict(table: pa.Table, kind: int) -> np.ndarray:
    own = np.flatnonzero(table.column("kind").to_numpy() == kind)
    return np.unique(np.concatenate([unpack(table.column("block")[int(k)].as_py())[0] for k in own] or [np.empty(0, np.int32)])).astype(np.int64)


def _removed_here(batch: Batch, lines: Lines, later: np.ndarray) -> np.ndarray:
    """All lines of the batch that are repeats: of another one here, or later than one elsewhere."""
    h, g = lines.hashes(lines.first, lines.last)
    order = _order(h, g, batch.ids[lines.doc], np.arange(len(h)))
    begins = runs(h[order], g[order])
    gone = np.ones(len(h), bool)
    gone[order[begins]] = np.isin(order[begins], later)
    return gone


def _variant_entries(texts: pa.Table, verdicts: pa.Table, near: int, bits: int) -> pa.Table:
    """(bucket, batch, block): keys of the lines with company, of themselves and of all variants.

    Under bucket -1 come the repeats of each batch."""
    out = []
    for number, block in zip(texts.column("batch").to_pylist(), texts.column("docs")):
        batch = Batch.of(block.as_py())
        lines = Lines(batch)
        if not len(lines.first):
            continue
        gone = _removed_here(batch, lines, _verdict(verdicts, 0))
        if gone.any():
            out.append((-1, number, pack(np.flatnonzero(gone))))
        form = _verdict(verdicts, 1)
        form = form[~gone[form % len(gone)]]
        if not len(form):
            continue
        at = form[form < len(gone)]
        found = [(at, lines.variants(lines.first[at], lines.last[at]))]
        found += [(at, chars.variants(chars.first, chars.last)) for at, chars in _characters(batch, lines, form[form >= len(gone)] - len(gone))]
        h, g, place = (np.concatenate([v[k] for _, v in found]) for k in (0, 1, 3))
        who = np.concatenate([at[v[2]] for at, v in found])
        del found
        order = _order(h, g, place, who)
        h, g, who, place = h[order], g[order], who[order], place[order]
        for k, i, j in _bucketed(h, bits):
            used, index = np.unique(who[i:j], return_inverse=True)
            out.append((k, number, pack_sorted(h[i:j], g[i:j], place[i:j].astype(np.int32), index.astype(np.int32), used.astype(np.int32), batch.ids[lines.doc[used]])))
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "batch": pa.array([x[1] for x in out], pa.int64()), "block": pa.array([x[2] for x in out], pa.binary())})


def _near_repeats(table: pa.Table) -> pa.Table:
    """(batch, block): the lines of each batch that are an edit away from an earlier one."""
    parts = [unpack_sorted(b.as_py()) for b in table.column("block")]
    numbers = table.column("batch").to_numpy()
    # A key is settled whole, so runs of keys are settled one after another.
    low, high = min(int(p[0][0]) for p in parts), max(int(p[0][-1]) for p in parts)
    n = sum(len(p[0]) for p in parts) // MOST_MEETING + 1
    edges = np.array([low + (high - low) * k // n for k in range(n)], np.uint64)
    cuts = np.array([np.append(np.searchsorted(p[0], edges), len(p[0])) for p in parts])
    out = []
    for k in range(n):
        own = np.flatnonzero(cuts[:, k + 1] > cuts[:, k])
        if len(own):
            out += _settled([tuple(x[cuts[i, k] : cuts[i, k + 1]] for x in parts[i][:4]) + parts[i][4:] for i in own], numbers[own])
    return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.binary())})


def _settled(parts: list[tuple], numbers: np.ndarray) -> list[tuple]:
    h, g, place = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
    line = np.concatenate([p[4][p[3]] for p in parts]).astype(np.int64)
    ids = np.concatenate([p[5][p[3]] for p in parts])
    batch = np.repeat(numbers, [len(p[0]) for p in parts])
    order = _order(h, g, place, ids, batch, line)
    h, g, place, line, ids, batch = (x[order] for x in (h, g, place, line, ids, batch))
    # Each line's rank among all here, so that one number says what is earlier.
    rank = np.empty(len(h), np.int64)
    rank[_order(ids, batch, line)] = np.arange(len(h))
    same = runs(h, g, place)
    sizes = np.diff(np.append(same, len(h)))
    earliest = np.repeat(np.minimum.reduceat(rank, same), sizes)
    gone = (place >= 0) & (rank > earliest)  # a replaced word
    key = runs(h, g)
    sizes = np.diff(np.append(key, len(h)))
    never = np.iinfo(np.int64).max
    whole = np.repeat(np.minimum.reduceat(np.where(place < 0, rank, never), key), sizes)
    less = np.repeat(np.minimum.reduceat(np.where(place >= 0, rank, never), key), sizes)
    gone |= np.where(place >= 0, rank > whole, rank > less)  # an inserted or deleted word
    batch, line = batch[gone], line[gone]
    order = np.argsort(batch, kind="stable")
    batch, line = batch[order], line[order]
    cuts = np.append(runs(batch), len(batch))
    return [(int(batch[i]), pack(np.unique(line[i:j]))) for i, j in zip(cuts, cuts[1:])]


def _kept(texts: pa.Table, removed: pa.Table, names: list[str], text: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    for block in texts.column("docs"):
        batch = Batch.of(block.as_py())
        lines = Lines(batch)
        gone = np.unique(np.concatenate([unpack(b.as_py())[0] for b in removed.column("block")] or [np.empty(0, np.int64)])).astype(np.int64)
        # A line goes with the line break after it, or before it where it is the last.
        stay = np.ones(len(batch.data), bool)
        for s, e, d in zip(lines.starts[gone].tolist(), lines.ends[gone].tolist(), lines.doc[gone].tolist()):
            stay[s : e + (e < batch.offsets[d + 1])] = False
        n_lines = np.bincount(lines.doc, minlength=len(batch.ids))
        n_gone = np.bincount(lines.doc[gone], minlength=len(batch.ids))
        whole = batch.data.tobytes()
        out = []
        for d, (i, j) in enumerate(zip(batch.offsets.tolist(), batch.offsets[1:].tolist())):
            if batch.null is not None and batch.null[d]:
                out.append(None)
            elif not n_gone[d]:
                out.append(whole[i:j].decode())
            else:
                left = batch.data[i:j][stay[i:j]].tobytes().decode()
                out.append(left[:-1] if left.endswith("\n") and whole[j - 1 : j] != b"\n" else left)
        yield batch.rows(names, text, pa.array(out, pa.string())), n_lines, n_gone


def dedup_lines(docs: DataFrame, near: int = NEAR_WORDS, batch_bytes: int = BATCH_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_lines, n_removed): each row of docs as a struct, its text less the repeated lines."""
    texts = pack_texts(docs, batch_bytes, key, text, others=True)
    bits = bucket_count(texts).bit_length() - 1
    packed = texts.select("batch", "docs")

    def entries(batches):
        for b in batches:
            for number, block in zip(b.column(0).to_pylist(), b.column(1)):
                out = _line_entries(number, Batch.of(block.as_py()), near, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())],
                    ["bucket", "batch", "kind", "block"],
                )

    verdicts = map_arrow(packed, entries, "bucket int, batch bigint, kind int, block binary").groupBy("bucket").applyInArrow(tidy(_line_verdicts), "batch bigint, kind int, block binary")
    by_batch = packed.groupBy("batch")
    variants = stage_table(by_batch.cogroup(verdicts.groupBy("batch")).applyInArrow(tidy(lambda t, v: _variant_entries(t, v, near, bits)), "bucket int, batch bigint, block binary"), "variants")
    removed = variants.where("bucket >= 0").groupBy("bucket").applyInArrow(tidy(_near_repeats), "batch bigint, block binary")
    removed = removed.unionByName(variants.where("bucket < 0").select("batch", "block"))
    names = docs.columns

    def kept(t: pa.Table, r: pa.Table) -> pa.Table:
        made = list(_kept(t, r, names, text))
        whole = pa.concat_tables([x for x, _, _ in made]).combine_chunks()
        row = pa.StructArray.from_arrays([whole.column(c).combine_chunks() for c in names], names)
        return pa.table({"row": row, "n_lines": np.concatenate([n for _, n, _ in made]), "n_removed": np.concatenate([n for _, _, n in made])})

    return by_batch.cogroup(removed.groupBy("batch")).applyInArrow(tidy(kept), f"row {docs.schema.simpleString()}, n_lines bigint, n_removed bigint")


def drop_repeated(docs: DataFrame, near: int = NEAR_WORDS) -> DataFrame:
    """docs less the repeated lines; rows all of whose lines were repeats go."""
    out = dedup_lines(docs, near)
    return out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select("row.*")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
