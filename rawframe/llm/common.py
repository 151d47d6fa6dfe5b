"""What the operators share: table access and the shared scratch folder."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows enter Python in batches of about so many bytes, unless the session has a setting of its own.
ARROW_BYTES = 2 << 20
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scope:
    """What operators share and stage for one caller, until it closes.

    Results made inside are read no later than that: whoever opens a scope writes them first. Other scopes',
    and what was made outside any, are left alone."""

    def __init__(self, spark: SparkSession):
        self._spark, self._lock = spark, threading.Lock()
        self._shared: list[Broadcast] = []
        self._staged: list[str] = []

    def owns(self, made: Broadcast | str) -> None:
        with self._lock:
            (self._staged if isinstance(made, str) else self._shared).append(made)

    def takes(self, other: Scope) -> None:
        """Own what the other scope owned."""
        with other._lock:
            made = [*other._shared, *other._staged]
            other._shared, other._staged = [], []
        for one in made:
            self.owns(one)

    def close(self) -> None:
        """Take back the broadcasts and delete the staged tables."""
        with self._lock:
            shared, self._shared = self._shared, []
            staged, self._staged = self._staged, []
        for broadcast in shared:
            broadcast.unpersist()
        for name in staged:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


def current_scope() -> Scope | None:
    return _SCOPE.get()


@contextmanager
def using(own: Scope) -> Iterator[Scope]:
    """What operators make inside belongs to a scope that stays open."""
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """What operators make inside goes at the end: results are written inside. Outside any scope it stays for the session."""
    with using(Scope(spark)) as own:
        try:
            yield own
        finally:
            own.close()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    In a session of this machine alone (as in tests) a temporary folder takes its place where the
    setting is missing; anywhere else that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffle files at its end, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP_SETTING, None)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP_SETTING) if before is None else spark.conf.set(_CLEANUP_SETTING, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost
    executor costs no more than the task it ran. Shuffle files go as soon as the table is written, as nothing
    reads them again. The table belongs to the scope around, if there is one."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _SCOPE.get()) is not None:
        own.owns(path)
    with _cleaned_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast, which belongs to the scope around, if there is one."""
    made = spark.sparkContext.broadcast(value)
    if (own := _SCOPE.get()) is not None:
        own.owns(made)
    return made


def _give_back() -> None:
    """Return freed memory to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """df.mapInArrow(f, schema) with batches bounded in bytes; memory goes back after each task."""
    conf = df.sparkSession.conf
    if _ARROW_SETTING not in conf.getAll:
        conf.set(_ARROW_SETTING, str(ARROW_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect()
        _give_back()

    return df.mapInArrow(run, schema)


def tidy(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """f on a group or two, giving memory back after each."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        _give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        _give_back()
        return out

    return one if len(inspect.signature(f).parameters) == 1 else two


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def held_out(doc_id: Column) -> Column:
    """The rows no model learns from: crc32(doc_id as text) mod 4 is 2. A row without an id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))
