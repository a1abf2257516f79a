"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch, far below a worker's memory for long documents too.
BATCH_ROWS = 1000
BATCH_BYTES = "8m"

_STAGED: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and all runs in
    one process (tests), a temporary folder of this machine is set once for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    found = spark.conf.get("spark.jobloom.staging.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="jobloom-")
        spark.conf.set("spark.jobloom.staging.dir", found)
    return found


def staging_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/jobloom/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(clear_staging)
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(spark: SparkSession, *staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let go of finished shuffles.

    Spark drops a shuffle's files once its plan is garbage on the driver, so both
    collectors run here, between the phases of a long operator.
    """
    for df in staged:
        path = getattr(df, "_staged_at", None)
        if path:
            _delete(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_staging() -> None:
    """Delete all staged tables; results that still read them become invalid."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def small_batches(spark: SparkSession) -> None:
    have = spark.conf.getAll
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if f"spark.sql.execution.arrow.{name}" not in have:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` with batches small enough for long documents.

    Worker processes outlive a stage: what another stage has kept there is dropped
    (all but the cache named ``keeps``), and memory is given back after each task.
    The size of a batch is a setting of the session; one that is set already stays.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(keeps)
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


_CACHES: dict[str, object] = {}


def cached(name: str, make: Callable[[], object]) -> object:
    """An object that this worker process keeps for further tasks of a stage."""
    if name not in _CACHES:
        _CACHES[name] = make()
    return _CACHES[name]


def drop_caches(keeps: str | None) -> None:
    for name in [n for n in _CACHES if n != keeps]:
        del _CACHES[name]


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte array and its row offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    flat = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - first


def text_bytes(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each row; null stays None."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.binary() if not pa.types.is_large_string(col.type) else pa.large_binary()).to_pylist()


def _word_table() -> bytes:
    """Bytes of words map to themselves (A-Z to a-z), all other ASCII to a space."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        if "A" <= c <= "Z":
            out[b] = b + 32
        elif not ("a" <= c <= "z" or "0" <= c <= "9"):
            out[b] = 32
    return bytes(out)


WORD_TABLE = _word_table()


def words_of(text: bytes) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

    Every byte of a non-ASCII character is 0x80 or more, so bytes give the same
    words as characters.
    """
    return text.translate(WORD_TABLE).split()
