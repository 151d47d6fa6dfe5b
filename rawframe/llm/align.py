"""Alignment of two tokenizers' tokens over the same bytes, and which of their ids go together.

A text, with a space before it, is cut into tokens by a byte-level BPE (A) and by a piece BPE (B).
B's tokens of a run of texts make a static interval index: their starts and their ends, both in
order. Each A token asks it, by bisection, for the B tokens that it overlaps; the gaps between
these are spanned. Gaps between B tokens that no A token spans are borders in both: they cut the
tokens into groups. The last tokens of a group's two sides end together, which links their ids.
How often a pair of ids is linked is counted over the whole corpus.

Tokenizing goes by pieces of text at whose borders both tokenizers always cut (checked against
B's vocabulary); pieces seen before are remembered. A text that B doesn't give back byte by byte
is tried whole, and has no tokens if the bytes still differ.

Texts are written once, as batches of links; a batch sends each of its distinct pairs once to be
counted, and gets the counts back, so a pair that all texts hold is one row a batch.

Defined results: null and empty texts, and those that B doesn't give back, have no tokens: all
numbers are 0 and groups and their digest are ''; repeated rows give repeated results and count as often as
they stand; a pair that ties with others for the highest count of its B id is a best one; an empty
table gives no rows; extra columns go through as a struct. A text is held whole in its task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import LATIN, NOT_LATIN, SPACE, Merger, cut_words, pieces, tokenizer_bytes
from .common import map_arrow, read_table, shared, stage_table, tidy
from .packed import pack, unpack

#: Texts are aligned in runs of about so many bytes, and their links counted in batches of so many; a longer text is one of its own.
RUN_BYTES = 1 << 19
BATCH_BYTES = 8 << 20
#: Pieces of text a task remembers before it starts afresh.
REMEMBERED = 400_000

BLANK = "▁"
#: Pieces end after letters, or before letters or white space; after an apostrophe before white space only.
_PARTS = rf"[{SPACE}]*'[^{SPACE}]*|[{SPACE}]*LETTERS(?:'[^{SPACE}]*)?|[{SPACE}]*[^{SPACE}'OTHER]+(?:'[^{SPACE}]*)?|[{SPACE}]+"
PARTS = regex.compile(_PARTS.replace("LETTERS", r"\p{L}+").replace("OTHER", r"\p{L}"))
LATIN_PARTS = re.compile(_PARTS.replace("LETTERS", f"[{LATIN}]+").replace("OTHER", LATIN))


def cut_parts(text: str) -> list[str]:
    return (PARTS if NOT_LATIN.search(text) else LATIN_PARTS).findall(text)


class PieceModel:
    """The piece tokenizer of a file: ids of texts behind a space, and the bytes of each id."""

    def __init__(self, source: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.bytes: list[bytes] = []
        whole, odd = True, {BLANK}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
                continue
            self.bytes.append(piece.replace(BLANK, " ").encode())
            if not self.model.is_control(i) and not self.model.is_unknown(i):
                own = piece.lstrip(BLANK)
                whole &= not (BLANK in own or regex.search(r"\p{L}\P{L}|\P{L}\p{L}", own))
                odd.update(regex.findall(f"[{SPACE}]", piece) if len(piece) > 1 else ())
        #: Whether the borders of parts are borders of tokens in every text without odd letters: the blank, and white space in longer pieces.
        self.by_parts, self.odd = whole and "\n" not in odd, re.compile(f"[{re.escape(''.join(sorted(odd)))}]")
        self.newline = self.model.encode("\n")[1:]  # without the blank before it

    def known(self, text: str) -> bool:
        return self.by_parts and not self.odd.search(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a space: the model adds that one itself."""
        return self.model.encode(text[1:], num_threads=1)

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts, in the middle of a text. No token crosses the end of a line."""
        skip = 1 + len(self.newline)
        spaced = self.model.encode([p[1:] if p[0] == " " else f"\n{p}" for p in parts], num_threads=1)
        return [ids if p[0] == " " else ids[skip:] for p, ids in zip(parts, spaced)]

    def spelled(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Tokens:
    """Both tokenizers with what they remember."""

    def __init__(self, a: bytes, b: bytes):
        self.merger, self.model = Merger(a), PieceModel(b)
        self.a: dict[str, bytes] = {}
        self.b: dict[str, bytes | None] = {}
        a_bytes = pieces(a)
        self.lengths_a = np.array([len(x) for x in a_bytes], np.int64)
        self.lengths_b = np.array([len(x) for x in self.model.bytes], np.int64)

    def learn(self, texts: list[list[str]]) -> None:
        """Tokenize the parts of texts that aren't known."""
        if len(self.a) > REMEMBERED:
            self.a.clear()
            self.b.clear()
        new = list(set().union(*texts) - self.a.keys())
        if not new:
            return
        for part, ids in zip(new, self.model.encode_parts(new)):
            self.b[part] = _as_bytes(ids) if self.model.spelled(ids) == part.encode() else None
            self.a[part] = _as_bytes([i for word in cut_words(part) for i in self.merger.merge(word.encode())])

    def of(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """The ids of A and B, as little-endian 32-bit numbers, of each text; None where there are none."""
        parts = [cut_parts(" " + t) if t else [] for t in texts]
        self.learn(parts)
        return [self._joined(t, p) if t else None for t, p in zip(texts, parts)]

    def _joined(self, text: str, parts: list[str]) -> tuple[bytes, bytes] | None:
        b = list(map(self.b.__getitem__, parts)) if self.model.known(text) else [None]
        whole = self._whole(" " + text) if None in b else b"".join(b)
        return None if whole is None else (b"".join(map(self.a.__getitem__, parts)), whole)

    def _whole(self, spaced: str) -> bytes | None:
        """B's ids, without going by parts."""
        ids = self.model.encode(spaced)
        return _as_bytes(ids) if self.model.spelled(ids) == spaced.encode() else None


class IntervalIndex:
    """Spans that follow each other without gaps or overlaps."""

    def __init__(self, lengths: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def overlapped(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last span that each [start, end) overlaps."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left") - 1


@dataclass
class Groups:
    """Tokens by group: which A and B tokens are the last of theirs, and each token's group."""

    last_a: np.ndarray
    last_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def group(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Groups:
    """The groups of tokens over the same bytes, of which each token has one at least."""
    index = IntervalIndex(lengths_b)
    ends = np.cumsum(lengths_a)
    first, last = index.overlapped(ends - lengths_a, ends)
    n = len(lengths_b)
    # A token spans the gaps after its first up to before its last.
    spanned = np.cumsum(np.bincount(first, minlength=n) - np.bincount(last, minlength=n)) > 0
    last_b = ~spanned
    group_b = np.cumsum(last_b) - last_b
    group_a = group_b[first]
    return Groups(np.append(group_a[1:] != group_a[:-1], True) if len(group_a) else np.empty(0, bool), last_b, group_a, group_b)


class Writer:
    """Groups as text: `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, ids: int):
        self.table = pa.array([f"{i}{mark}" for i in range(ids) for mark in ",|;"], pa.large_string())

    def write(self, a: np.ndarray, b: np.ndarray, groups: Groups) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """The bytes of all, and where each A and each B token's mark ends."""
        before_b = np.concatenate([[0], np.flatnonzero(groups.last_b) + 1])  # B tokens before each group
        after_a = np.append(np.flatnonzero(groups.last_a) + 1, len(a))  # A tokens up to each group
        at_a = np.arange(len(a)) + before_b[groups.group_a]
        at_b = np.arange(len(b)) + after_a[groups.group_b]
        each = np.empty(len(a) + len(b), np.int64)
        each[at_a] = a * 3 + groups.last_a
        each[at_b] = b * 3 + 2 * groups.last_b
        out = self.table.take(pa.array(each))
        ends = np.frombuffer(out.buffers()[1], np.int64)[: len(each) + 1]
        return memoryview(out.buffers()[2]), ends[at_a + 1], ends[at_b + 1]


def _bounds(blocks: list[bytes]) -> np.ndarray:
    return np.cumsum([0, *(len(x) // 4 for x in blocks)])


@dataclass
class Aligned:
    """One text: its numbers of tokens and groups, its groups as text, and its links (A's id above 32 bits of B's)."""

    n_a: int
    n_b: int
    groups: bytes
    links: np.ndarray


def align_texts(tokens: Tokens, writer: Writer, texts: list[str | None]) -> list[Aligned | None]:
    """Each text's alignment, or None; all are looked up in one index."""
    found = tokens.of(texts)
    own = [f for f in found if f is not None]
    if not own:
        return [None] * len(found)
    a, b = (np.frombuffer(b"".join(f[k] for f in own), "<u4").astype(np.int64) for k in (0, 1))
    cut_a, cut_b = _bounds([f[0] for f in own]), _bounds([f[1] for f in own])
    groups = group(tokens.lengths_a[a], tokens.lengths_b[b])
    links = a[groups.last_a] << 32 | b[groups.last_b]
    written, _, ends = writer.write(a, b, groups)
    out: list[Aligned | None] = []
    k, at, begun = 0, 0, 0
    closed = np.concatenate([[0], np.cumsum(groups.last_b)])
    for f in found:
        if f is None:
            out.append(None)
            continue
        end = int(ends[cut_b[k + 1] - 1])
        to = int(closed[cut_b[k + 1]])
        out.append(Aligned(int(cut_a[k + 1] - cut_a[k]), int(cut_b[k + 1] - cut_b[k]), bytes(written[begun : end - 1]), links[at:to]))
        k, at, begun = k + 1, to, end
    return out


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about `size` bytes of text (the last column)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
        ends, at = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def _narrow(places: np.ndarray) -> np.ndarray:
    return places.astype(np.uint16 if len(places) == 0 or places.max() < 1 << 16 else np.uint32)


def linked(docs: DataFrame, a: bytes, b: bytes, text: str = "text", keep_groups: bool = False) -> DataFrame:
    """Staged rows of two kinds. Of texts (a is null): row, batch, n_a, n_b, n_groups, groups_sha256,
    groups (if asked for) and links (packed places among the batch's pairs). Of pairs: batch, place, a, b and
    the number n of their links in the batch."""
    others = [F.col(c) for c in docs.columns if c != text]
    whole = docs.select(F.struct(*others or [F.lit(0).alias("none")]).alias("row"), F.col(text).alias("text"))
    sent = shared(docs.sparkSession, (a, b))
    kind = whole.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*sent.value)
        writer = Writer(max(len(tokens.lengths_a), len(tokens.lengths_b)))
        task, number = TaskContext.get(), 0
        first = task.partitionId() << 32
        rows: list[pa.Array] = []
        found: list[Aligned | None] = []
        digests: list[str] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            codes = np.concatenate([np.empty(0, np.int64), *(x.links for x in found if x)])
            known, place, n = np.unique(codes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place, known, n = rank[place], known[order], n[order]
            ends = np.cumsum([0, *(len(x.links) if x else 0 for x in found)])
            own = pa.concat_arrays(rows)
            texts = pa.array([str(x.groups, "ascii") if x else "" for x in found] if keep_groups else [None] * len(found), pa.string())
            numbers = [pa.array([getattr(x, c) if x else 0 for x in found], pa.int64()) for c in ("n_a", "n_b")]
            blocks = pa.array([pack(_narrow(place[i:j])) for i, j in zip(ends, ends[1:])], pa.binary())
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([own, pa.array([first + number] * len(own), pa.int64()), *numbers, pa.array(np.diff(ends)), pa.array(digests, pa.string()), texts, blocks, none, none, none, none], names)
            for i in range(0, len(known), 1 << 16):
                at = np.arange(i, min(i + (1 << 16), len(known)))
                empty = [pa.nulls(len(at), t) for t in (own.type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())]
                pairs = [pa.array(x, pa.int64()) for x in (at, known[at] >> 32, known[at] & 0xFFFFFFFF, n[at])]
                yield pa.RecordBatch.from_arrays([empty[0], pa.array([first + number] * len(at), pa.int64()), *empty[1:], *pairs], names)

        for part in _runs(batches, RUN_BYTES):
            texts = part.column(1).to_pylist()
            aligned = align_texts(tokens, writer, texts)
            digests += [hashlib.sha256(x.groups).hexdigest() if x else "" for x in aligned]
            if not keep_groups:
                for x in aligned:
                    if x:
                        x.groups = b""
            found += aligned
            rows.append(part.column(0))
            size += sum(map(len, filter(None, texts)))
            if size >= BATCH_BYTES:
                yield from out()
                rows, found, digests, size, number = [], [], [], 0, number + 1
        if rows:
            yield from out()

    names = ["row", "batch", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links", "place", "a", "b", "n"]
    schema = f"row {kind.simpleString()}, batch bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, groups string, links binary, place bigint, a bigint, b bigint, n bigint"
    return stage_table(map_arrow(whole, run, schema), "alignment")


def pair_counts(staged: DataFrame) -> DataFrame:
    """(a, b, total, best): how often ids are linked, and whether that is the most of their B id.

    A B id has no more partners than A has ids, so the window is bounded by the vocabulary."""
    totals = staged.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b")))


def with_counts(staged: DataFrame, counts: DataFrame) -> DataFrame:
    """Texts with n_links, n_best and count_sum from what their batches' pairs count over the corpus."""
    told = staged.where("a IS NOT NULL").select("batch", "place", "a", "b").join(counts, ["a", "b"]).select(F.col("batch").alias("of"), "place", "total", "best")
    texts = staged.where("a IS NULL").select("row", "batch", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        total, best = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
        total[place] = right.column("total").to_numpy()
        best[place] = right.column("best").to_numpy(zero_copy_only=False)
        links = [unpack(x.as_py())[0].astype(np.int64) for x in left.column("links")]
        sums = [pa.array(x, pa.int64()) for x in ([len(x) for x in links], [int(best[x].sum()) for x in links], [int(total[x].sum()) for x in links])]
        kept = left.drop_columns(["batch", "links"])
        return kept.append_column("n_links", sums[0]).append_column("n_best", sums[1]).append_column("count_sum", sums[2])

    schema = f"row {staged.schema['row'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, groups string, n_links bigint, n_best bigint, count_sum bigint"
    return texts.groupBy("batch").cogroup(told.groupBy("of")).applyInArrow(tidy(run), schema)


def piece_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def aligned(docs: DataFrame, a: bytes | None = None, b: bytes | None = None, keep_groups: bool = False) -> DataFrame:
    """(row, n_a, n_b, n_groups, groups_sha256, groups, n_links, n_best, count_sum): docs' other columns as a struct, and the
    alignment of their texts; groups is null unless asked for. a and b are the tokenizers' files."""
    staged = linked(docs, a or tokenizer_bytes(), b or piece_bytes(), keep_groups=keep_groups)
    return with_counts(staged, pair_counts(staged))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aligned(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
