"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Folders with tables that ``keep`` wrote in this process and nothing has deleted yet.
_KEPT: set[str] = set()
#: The innermost open ``scratch`` of this thread of execution: folders that it deletes at its end.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: What Python workers remember between tasks: how each cache is emptied.
CACHES: dict = {}
#: Allocations of this many bytes and more go back to the system as soon as they are freed.
_MAPPED_FROM = 4 << 20
_LIBC: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``.  Only a single-process local session may do
    without the setting; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _OWN[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.  Inside a
    ``scratch`` block the table goes at the block's end, unless it is handed on;
    elsewhere it stays until ``forget`` or ``clear``.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    folder = path.rsplit("/", 1)[0]
    _KEPT.add(folder)
    if (own := _SCRATCH.get()) is not None:
        own.append(folder)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.kept_at = folder
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    _KEPT.discard(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete a table that ``keep`` returned and nothing reads any more."""
    if df.kept_at in _KEPT:
        _delete(df.sparkSession, df.kept_at)


@contextmanager
def scratch(spark: SparkSession):
    """A block whose kept tables are deleted at its end, also if it fails.

    Yields ``hand_on``: tables given to it belong to the enclosing block instead, or to
    the caller if there is none.  No block touches the tables of another, so results
    that are not read yet stay whole whatever else runs in the process.
    """
    own: list[str] = []
    outer = _SCRATCH.get()
    token = _SCRATCH.set(own)

    def hand_on(df: DataFrame) -> DataFrame:
        own.remove(df.kept_at)
        if outer is not None:
            outer.append(df.kept_at)
        return df

    try:
        yield hand_on
    finally:
        _SCRATCH.reset(token)
        for folder in own:
            if folder in _KEPT:
                _delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Delete every table that this process has kept; results that read them are lost."""
    for folder in list(_KEPT):
        _delete(spark, folder)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators on texts read; other columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _libc():
    """The C library, told to give large blocks back when they are freed; None without glibc."""
    if not _LIBC:
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, _MAPPED_FROM)  # M_MMAP_THRESHOLD: fixed, it grows by itself otherwise
            libc.malloc_trim(0)
        except (AttributeError, OSError):
            libc = None
        if libc:
            pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pool holds what it freed
        _LIBC.append(libc)
    return _LIBC[0]


def settle(*uses: str) -> None:
    """Empty the caches of a Python worker but those named, and give freed memory back to the
    system: a worker lives on beside the JVM when its operator has ended."""
    for name, empty in CACHES.items():
        if name not in uses:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def tidy(*uses: str):
    """Decorator of functions over Arrow batches: the worker settles before and after each task,
    and remembers only the caches that the function uses."""

    def wrap(function):
        @wraps(function)
        def run(batches, *args, **kwargs):
            settle(*uses)
            yield from function(batches, *args, **kwargs)
            settle(*uses)

        return run

    return wrap


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with columns other than doc_id and text named by place: no name clashes or needs
    quoting.  ``toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*(c.lower() if c.lower() in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)))


def bucket_of(doc_id, mod: int):
    """crc32 of the identifier as text, modulo ``mod`` (null identifiers: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def rows_of(batch, *names):
    """Columns of an Arrow batch as Python lists."""
    return [batch.column(n).to_pylist() for n in names]
