"""Texts in compressed batches with stable numbers, for operators that go over them several times."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage_table
from .kernels import slices, utf8

#: Stands for a missing id: it sorts after all others.
NO_ID = np.iinfo(np.int64).max
#: About so many bytes of text are behind each bucket of an exchange of packed arrays.
BUCKET_BYTES = 16 << 20
#: A batch holds about so many bytes of text.
BATCH_BYTES = 1 << 20
#: Documents of a batch at most.
MOST_ROWS = 1 << 20


def pack(*arrays: np.ndarray | bytes | None, level: int = 1) -> bytes:
    """Arrays one after another behind a JSON head of their types and shapes, compressed."""
    parts = [a if a is None or isinstance(a, bytes) else np.ascontiguousarray(a) for a in arrays]
    head = json.dumps([None if a is None else len(a) if isinstance(a, bytes) else [a.dtype.str, a.shape] for a in parts]).encode()
    body = [a if isinstance(a, bytes) else a.tobytes() for a in parts if a is not None]
    return zstandard.ZstdCompressor(level=level).compress(b"".join([struct.pack("<I", len(head)), head, *body]))


def unpack(block: bytes) -> tuple:
    whole = zstandard.ZstdDecompressor().decompress(block)
    at = 4 + struct.unpack_from("<I", whole)[0]
    out = []
    for kind in json.loads(whole[4:at]):
        if kind is None:
            out.append(None)
        elif isinstance(kind, int):
            out.append(whole[at : at + kind])
            at += kind
        else:
            n = int(np.prod(kind[1]))
            out.append(np.frombuffer(whole, kind[0], n, at).reshape(kind[1]))
            at += out[-1].nbytes
    return tuple(out)


def pack_sorted(values: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 64-bit numbers by the bytes of their differences, which compress well."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T.copy(), *more)


def unpack_sorted(block: bytes) -> tuple[np.ndarray, ...]:
    planes, *more = unpack(block)
    return (np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64), *more)


@dataclass
class Batch:
    """Some documents: their ids, and their texts' bytes one after another."""

    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    #: The other columns of the rows, as an Arrow stream; empty if they weren't asked for.
    others: bytes = b""
    #: Which texts are null.
    null: np.ndarray | None = None

    @staticmethod
    def of(block: bytes) -> Batch:
        return Batch(*unpack(block))

    def block(self) -> bytes:
        return pack(self.ids, self.offsets, self.data, self.others, self.null)

    def rows(self, names: list[str], text: str, texts: pa.Array | None = None) -> pa.Table:
        """The rows as they were, with other texts if given."""
        if texts is None:
            buffers = [pa.py_buffer(np.packbits(~self.null, bitorder="little")), pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.data)]
            texts = pa.Array.from_buffers(pa.large_string(), len(self.ids), buffers).cast(pa.string())
        whole = pa.ipc.open_stream(self.others).read_all()
        return pa.table({c: texts if c == text else whole.column(c) for c in names})


def pack_texts(docs: DataFrame, size: int = BATCH_BYTES, key: str = "doc_id", text: str = "text", others: bool = False) -> DataFrame:
    """(batch, docs): all rows of docs in batches of about `size` bytes, written to the shared folder.

    A longer text makes a batch of its own. With others, the batches hold all columns."""
    kept = [c for c in docs.columns if c != text] if others else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            null = np.asarray(batch.column(1).is_null())
            data, offsets = utf8(batch.column(1))
            whole = pa.RecordBatch.from_arrays(batch.columns[2:], kept) if kept else None
            for i, j in ((a, min(a + MOST_ROWS, j)) for i, j in slices(offsets, size) for a in range(i, j, MOST_ROWS)):
                stream = b""
                if whole is not None:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, whole.schema) as out:
                        out.write_batch(whole.slice(i, j - i))
                    stream = sink.getvalue().to_pybytes()
                block = Batch(ids[i:j], offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], stream, null[i:j]).block()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([int(offsets[j] - offsets[i])], pa.int64())], ["docs", "bytes"])

    packed = map_arrow(docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"), *[F.col(c) for c in kept]), run, "docs binary, bytes bigint")
    # The number of a batch takes 40 bits: its partition's, and 16 for its place there.
    number = F.monotonically_increasing_id()
    staged = stage_table(packed.withColumn("at", number), "texts")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    checked = F.when(place < 1 << 16, F.shiftleft(F.shiftright("at", 33), 16) + place).otherwise(F.raise_error(F.lit("a partition has too many batches")))
    return staged.select("docs", "bytes", checked.cast("bigint").alias("batch"))


def bucket_count(packed: DataFrame, least: int = 8) -> int:
    """Buckets for an exchange over all texts: as many as keep each one's share of the texts bounded."""
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    return 1 << max(least - 1, total // BUCKET_BYTES).bit_length()


#: A row's number is its batch's, then so many bits for its place there.
PLACE_BITS = 22


def keep_rows(texts: DataFrame, chosen: DataFrame, schema, text: str = "text") -> DataFrame:
    """The rows of packed texts (with all columns) whose numbers are in chosen.row."""
    place = F.col("row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    wanted = chosen.select(F.shiftright("row", PLACE_BITS).alias("batch"), place.alias("place")).groupBy("batch").agg(F.collect_list("place").alias("places"))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, places in zip(b.column(0), b.column(1)):
                yield from Batch.of(block.as_py()).rows(names, text).take(pa.array(sorted(places.as_py()), pa.int64())).combine_chunks().to_batches()

    return map_arrow(texts.select("batch", "docs").join(wanted, "batch").select("docs", "places"), run, schema)
