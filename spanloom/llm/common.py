"""Shared plumbing of the training-data operators.

Stage tables
    ``stage(df, name)`` writes a DataFrame as Parquet below the folder that the
    cluster names in ``spark.checkpoint.dir`` and reads it back.  That cuts the
    lineage with one computation, survives the loss of executors, and is seen
    by every executor; the shuffle files behind it are removed at once.  Only in
    local mode, and where the setting is absent, is a folder of our own used.

Bytes of Arrow strings
    ``utf8`` views a string column as one byte array plus offsets, so kernels
    run over whole batches at once instead of row by row.
"""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to the byte kernels in runs of about so many bytes.
BLOCK_BYTES = 2 << 20
_MADE: ContextVar[list[str] | None] = ContextVar("stage tables", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lean(task):
    """Give back what a task's libraries hold on to when it ends: Python workers outlive their tasks."""

    @wraps(task)
    def run(batches, *args, **named):
        try:
            yield from task(batches, *args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder for stage tables: ``spark.checkpoint.dir``, else, in local mode, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the rows are stored when the write ends, and its shuffles are of no use then
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the stage tables that are made inside, for ``remove``."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in paths:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def unstage(*frames: DataFrame) -> None:
    """Remove stage tables that no later plan reads."""
    for df in frames:
        remove(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH doesn't already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    folder = tempfile.mkdtemp()
    archive = os.path.join(folder, "spanloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(os.path.join(root, "spanloom")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    shutil.rmtree(folder, ignore_errors=True)
    context._spanloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    return raw[first:last], offsets.astype(np.int64) - first


def runs(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


#: A membership filter has at least so many bits for each entry, and at most MOST_BITS (32 MB).
BITS_EACH, MOST_BITS = 8, 1 << 28


def membership_filter(nodes: DataFrame, column: str) -> bytes:
    """A bitmap of the hashes of ``column``, sized by the number of rows (read twice).

    It lets a scan pass over rows that no join will want, without a shuffle of
    their texts.  A set bit proves nothing: the exact join comes after it.  Where
    the bitmap would be over MOST_BITS it is empty and every row passes.
    """
    size = 1 << max(16, (BITS_EACH * nodes.count()).bit_length())
    if size > MOST_BITS:
        return b""
    at = F.pmod(slot(column), F.lit(size)) + 1
    rows = nodes.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = bytearray(size // 8)
    for b, m in rows.collect():  # 4 KB each
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(m)] = m[: size // 8]
    return bytes(out)


def slot(column: str):
    """What a membership filter is asked by."""
    return F.xxhash64(column)


def in_filter(bits: bytes, slots: np.ndarray) -> np.ndarray:
    if not bits:
        return np.ones(len(slots), bool)
    at = slots.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    table = np.frombuffer(bits, np.uint8)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 7919 + 1))
