"""Removal of repeated byte strings, by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first WINDOW bytes only, by digits, the most significant
first; what is left in equal groups after the last digit is exactly the repeated windows.

The first digit is chosen so that its pass needs little room: of each window it is the least
hash of the K-byte strings inside. Equal windows have equal first digits, and neighbouring
windows mostly share theirs, so a run of them costs one number. Groups of a single document
end there. The windows left are exchanged by that digit, as runs with their bytes, and sorted
through the remaining digits of eight bytes, groups of one falling out after each pass.

Before both exchanges each batch of texts settles what it can by itself (one number, and one
document's windows, for all copies in the batch), so a string that a third of all documents
hold reaches a bucket once a batch.

Defined results: a null text is empty; a null doc_id sorts after all others; rows with the same
doc_id don't remove each other's bytes; texts shorter than the window stay whole; a very long
text is a batch of its own, held whole by its tasks; an empty table gives no rows; other columns
aren't looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, tidy
from .kernels import Hasher, mix
from .packed import BATCH_BYTES, NO_ID, Batch, bucket_count, pack, pack_sorted, pack_texts, unpack, unpack_sorted

WINDOW = 50
K = 20
#: A bucket is sorted in so many parts, to bound the memory it takes.
PARTS = 8


def first_digits(batch: Batch, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: where it starts, its document's place in the batch, its first digit."""
    n = len(batch.data)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least = Hasher(batch.data).windows(k)
    width, reach = window - k + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    inside = np.ones(n - window + 1, bool)
    for end in batch.offsets[1:-1]:
        inside[max(0, end - window + 1) : end] = False
    at = np.flatnonzero(inside)
    # Least hashes crowd at the low end; mixed, they spread over the buckets.
    return at, np.searchsorted(batch.offsets, at, "right") - 1, mix(least[at])


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def equal_groups(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `at` of windows that aren't alone, and their groups, in order of the groups."""
    place = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    if len(at) < 2:
        return place[:0], group[:0]
    eight = data.astype(np.uint64)
    for step in (1, 2, 4):
        eight = (eight[:-step] << np.uint64(8 * step)) | eight[step:]
    for digit in [*range(0, window - 8, 8), window - 8]:
        key = eight[at[place] + digit]
        if digit == 0:
            order = np.argsort(key, kind="stable")
        else:  # only groups that this digit parts are sorted again
            parted = np.unique(group[1:][(group[1:] == group[:-1]) & (key[1:] != key[:-1])])
            order = np.arange(len(place))
            if len(parted):
                own = np.flatnonzero(np.isin(group, parted))
                order[own] = own[np.lexsort((key[own], group[own]))]
        place, group, key = place[order], group[order], key[order]
        begins = runs(group, key)
        sizes = np.diff(np.append(begins, len(place)))
        group = np.repeat(np.arange(len(begins)), sizes)
        several = np.repeat(sizes > 1, sizes)
        place, group = place[several], group[several]
        if not len(place):
            break
    return place, group


def first_owner(data: np.ndarray, at: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """The least id among the equal windows, for each window."""
    out = ids.copy()
    place, group = equal_groups(data, at, window)
    if len(place):
        begins = runs(group)
        out[place] = np.repeat(np.minimum.reduceat(ids[place], begins), np.diff(np.append(begins, len(place))))
    return out


def _digit_rows(table: pa.Table, window: int, k: int, bits: int) -> pa.Table:
    """(bucket, batch, digits): the distinct first digits of a batch, and which of them several documents have."""
    out = []
    for number, block in zip(table.column("batch").to_pylist(), table.column("docs")):
        batch = Batch.of(block.as_py())
        _, doc, digit = first_digits(batch, window, k)
        new = runs(digit, doc)
        digit, owner = digit[new], batch.ids[doc[new]]
        order = np.lexsort((owner, digit))
        digit, owner = digit[order], owner[order]
        begins = runs(digit)
        several = np.zeros(len(begins), bool)
        if len(begins):
            last = np.append(begins[1:], len(digit)) - 1
            several = owner[begins] != owner[last]
        digit = digit[begins]
        bucket = (digit >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        out += [(b, number, pack_sorted(digit[i:j], several[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "batch": pa.array([x[1] for x in out], pa.int64()), "block": pa.array([x[2] for x in out], pa.binary())})


def _shared_digits(table: pa.Table) -> pa.Table:
    """(batch, block): of each batch the digits that another batch, or another of its documents, has too."""
    parts = [unpack_sorted(b.as_py()) for b in table.column("block")]
    digits = np.concatenate([d for d, _ in parts])
    batch = np.repeat(np.arange(len(parts)), [len(d) for d, _ in parts])
    several = np.concatenate([s for _, s in parts])
    order = np.argsort(digits, kind="stable")
    begins = runs(digits[order])
    sizes = np.diff(np.append(begins, len(order)))
    shared = np.repeat((sizes > 1) | np.logical_or.reduceat(several[order], begins), sizes)
    keep = np.zeros(len(digits), bool)
    keep[order] = shared
    numbers = table.column("batch").to_pylist()
    cuts = np.searchsorted(batch, np.arange(len(parts) + 1))
    out = [(numbers[p], pack_sorted(digits[i:j][keep[i:j]])) for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if keep[i:j].any()]
    return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.binary())})


def _window_rows(texts: pa.Table, shared: pa.Table, window: int, k: int, bits: int) -> pa.Table:
    """(bucket, batch, block): runs of windows whose first digit is shared, to be settled in a bucket.

    Under a negative bucket of its own comes what a smaller id of the same batch has."""
    out = []
    for number, block in zip(texts.column("batch").to_pylist(), texts.column("docs")):
        batch = Batch.of(block.as_py())
        known = np.sort(np.concatenate([unpack_sorted(b.as_py())[0] for b in shared.column("block")] or [np.empty(0, np.uint64)]))
        at, doc, digit = first_digits(batch, window, k)
        if not len(known) or not len(at):
            continue
        new = np.zeros(len(at), bool)
        new[runs(digit)] = True
        heads = digit[new]
        hit = known[np.minimum(np.searchsorted(known, heads), len(known) - 1)] == heads
        own = hit[np.cumsum(new) - 1]
        at, doc, digit = at[own], doc[own], digit[own]
        ids = batch.ids[doc]
        local = first_owner(batch.data, at, ids, window) < ids
        if local.any():
            out.append((-1 - number, number, pack(*merged(at[local], at[local] + window))))
        at, doc, digit = at[~local], doc[~local], digit[~local]
        if not len(at):
            continue
        begins = runs(at - np.arange(len(at)), digit, doc)
        counts = np.diff(np.append(begins, len(at)))
        starts, owner, digit = at[begins], batch.ids[doc[begins]], digit[begins]
        bucket = (digit >> np.uint64(64 - bits)).astype(np.int64)
        part = (digit % np.uint64(PARTS)).astype(np.uint8)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                own = order[i:j]
                s, c = starts[own], counts[own]
                size = c + window - 1
                take = np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                out.append((b, number, pack(owner[own], s.astype(np.int32 if len(batch.data) < 1 << 31 else np.int64), c.astype(np.int32), part[own], batch.data[take], level=3)))
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "batch": pa.array([x[1] for x in out], pa.int64()), "block": pa.array([x[2] for x in out], pa.binary())})


def merged(starts: np.ndarray, ends: np.ndarray, touching: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as sorted disjoint spans; touching ones stay apart, or not."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] >= ends[:-1] + touching])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _removed_rows(table: pa.Table, window: int) -> pa.Table:
    """(batch, block): the spans of each batch whose windows a smaller id has."""
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["batch", "block"])
    parts = [unpack(b.as_py()) for b in table.column("block")]
    numbers, out = table.column("batch").to_pylist(), []
    for k in range(PARTS):  # equal windows are in the same part
        chosen = [p[3] == k for p in parts]
        owner, starts, counts = (np.concatenate([p[i][own] for p, own in zip(parts, chosen)]) for i in range(3))
        if not len(owner):
            continue
        data = np.concatenate([p[4][np.repeat(own, p[2] + window - 1)] for p, own in zip(parts, chosen)])
        batch = np.repeat(np.arange(len(parts)), [int(own.sum()) for own in chosen])
        starts, counts = starts.astype(np.int64), counts.astype(np.int64)
        size = counts + window - 1
        base = np.cumsum(size) - size
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = np.repeat(owner, counts)
        gone = first_owner(data, np.repeat(base, counts) + step, ids, window) < ids
        place, batch = (np.repeat(starts, counts) + step)[gone], np.repeat(batch, counts)[gone]
        begins = np.append(runs(batch), len(batch))
        for i, j in zip(begins, begins[1:]):
            out.append((numbers[batch[i]], pack(*merged(place[i:j], place[i:j] + window))))
    return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.binary())})


def _kept_rows(texts: pa.Table, removed: pa.Table) -> pa.Table:
    """(doc_id, kept, spans) of each document."""
    ids, kept, spans = [], [], []
    for block in texts.column("docs"):
        batch = Batch.of(block.as_py())
        parts = [unpack(b.as_py()) for b in removed.column("block")]
        starts, ends = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
        # No span reaches over a text's end. A gap before each text keeps spans of different texts from touching.
        gap = np.searchsorted(batch.offsets, starts, "right") - 1
        starts, ends = merged(starts + gap, ends + gap, touching=True)
        cut = np.searchsorted(batch.offsets + np.arange(len(batch.offsets)), starts, "right") - 1
        starts, ends = starts - cut, ends - cut
        stay = np.ones(len(batch.data), bool)
        for s, e in zip(starts, ends):
            stay[s:e] = False
        first = np.searchsorted(cut, np.arange(len(batch.ids) + 1))
        for d, (i, j) in enumerate(zip(batch.offsets, batch.offsets[1:])):
            ids.append(None if batch.ids[d] == NO_ID else int(batch.ids[d]))
            kept.append(batch.data[i:j][stay[i:j]].tobytes())
            spans.append([{"start": int(s - i), "end": int(e - i)} for s, e in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])])
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = K, batch_bytes: int = BATCH_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept, spans): the bytes left of each text, and the removed spans of bytes.

    A byte goes if a string of `window` bytes that covers it also starts in a document with a smaller id."""
    if not 8 <= k <= window:
        raise ValueError("8 <= k <= window")
    texts = pack_texts(docs, batch_bytes, key, text)
    bits = bucket_count(texts).bit_length() - 1
    blocks = "bucket int, batch bigint, block binary"

    def digits(batches):
        for b in batches:
            yield from _digit_rows(pa.Table.from_batches([b]), window, k, bits).to_batches()

    shared = map_arrow(texts.select("batch", "docs"), digits, blocks).groupBy("bucket").applyInArrow(tidy(_shared_digits), "batch bigint, block binary")
    by_batch = texts.select("batch", "docs").groupBy("batch")
    windows = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(tidy(lambda t, s: _window_rows(t, s, window, k, bits)), "bucket bigint, batch bigint, block binary")
    removed = windows.groupBy("bucket").applyInArrow(tidy(lambda t: _removed_rows(t, window)), "batch bigint, block binary")
    return by_batch.cogroup(removed.groupBy("batch")).applyInArrow(tidy(_kept_rows), "doc_id bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read_table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id",
        (F.octet_length("kept").cast("bigint") + n_removed).alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
