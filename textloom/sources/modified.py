"""A stream of files as they are written: a path comes again each time its file is modified."""

from __future__ import annotations

import os
import stat
import sys
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import decoded, without

#: Files modified less than this many milliseconds ago wait: they may be written still.
QUIET_MS = 500
#: What a task reads, about, if no file and no folder (see SHARES) is larger; bytes and files.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 10_000
#: Shares into which one folder is dealt at most: for each all its names are gone through.
SHARES = 32
#: Bytes of an Arrow batch, if no file is larger.
BATCH_BYTES = 8 << 20
SCHEMA = "path string, modified long, content binary"
START = {"modified": -1, "path": ""}


class Files(InputPartition):
    """The files between two offsets of folders, each given as (folder, k, n): the k-th of n shares of its files, by name."""

    def __init__(self, low: tuple[int, str], high: tuple[int, str]):
        self.low, self.high, self.shares = low, high, []


def listed(fs: pa.fs.FileSystem, folder: str, k: int = 0, n: int = 1) -> Iterator[tuple[int, str, int]]:
    """(modified, path, size) of the files in a folder, hidden ones too, or of one share of them; folders have size -1.

    A local folder is gone through entry by entry; of others pyarrow holds all entries at once.
    """
    if fs.type_name == "local":
        with os.scandir(folder or "/") as entries:
            for e in entries:
                if n > 1 and zlib.crc32(os.fsencode(e.name)) % n != k:
                    continue
                try:
                    at = e.stat()
                except FileNotFoundError:
                    continue  # deleted since it was listed
                if stat.S_ISDIR(at.st_mode) or stat.S_ISREG(at.st_mode):
                    yield at.st_mtime_ns, f"{folder}/{e.name}", -1 if stat.S_ISDIR(at.st_mode) else at.st_size
        return
    for f in fs.get_file_info(pa.fs.FileSelector(folder)):
        if f.type in (pa.fs.FileType.File, pa.fs.FileType.Directory) and (n == 1 or zlib.crc32(f.base_name.encode()) % n == k):
            yield f.mtime_ns or 0, f.path, -1 if f.type == pa.fs.FileType.Directory else f.size


class ModifiedReader(DataSourceStreamReader):
    """Offsets are (time of modification in nanoseconds, path), the order in which files come.

    A batch holds the files between two offsets, so a file that is written again leaves its
    old place and has a new one beyond every offset given out.  The driver goes through the folders one
    after the other and holds no files, but the folders that have some; tasks list their own and read them.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.quiet = int(options.get("quietMs", QUIET_MS)) * 1_000_000
        self.top = (START["modified"], START["path"])

    def _folders(self, low: tuple[int, str], high: tuple[int, str]) -> Iterator[tuple[str, Iterator[tuple[int, str, int]]]]:
        """Each folder (or the one file) with its files beyond ``low`` and up to ``high``, to be gone through in turn."""
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        top = fs.get_file_info(root)
        if top.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if top.type == pa.fs.FileType.File:
            yield root, ((m, p, n) for m, p, n in [(top.mtime_ns, top.path, top.size)] if low < (m, p) <= high)
            return
        left = [root.rstrip("/")]

        def files(folder: str):
            try:
                for modified, path, size in listed(fs, folder):
                    if size < 0:
                        left.extend([path] if self.recursive else [])
                    elif low < (modified, path) <= high:
                        yield modified, path, size
            except FileNotFoundError:
                pass  # deleted since it was listed

        while left:
            folder = left.pop()
            yield folder, files(folder)

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        until = (time.time_ns() - self.quiet, chr(sys.maxunicode))
        for _, files in self._folders(self.top, until):
            last = max(files, default=self.top)[:2]
            self.top = max(self.top, last)  # also if the last file is deleted meanwhile
        return {"modified": self.top[0], "path": self.top[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        self.top = max(self.top, high)
        out, size, count = [], 0, 0
        for folder, files in self._folders(low, high):
            found, n = 0, 0
            for _, _, more in files:
                found, n = found + 1, n + more
            shares = min(max(-(-n // PARTITION_BYTES), -(-found // PARTITION_FILES)), SHARES)
            for k in range(shares):
                if not out or shares > 1 or size + n > PARTITION_BYTES or count + found > PARTITION_FILES:
                    out.append(Files(low, high))
                    size, count = 0, 0
                out[-1].shares.append((folder, k, shares))
                size, count = size + n, count + found
        return out

    def read(self, partition: Files):
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        held, size = [], 0

        def found(folder: str, k: int, n: int) -> list[tuple[int, str]]:
            at = fs.get_file_info(folder)
            files = [(at.mtime_ns, at.path, at.size)] if at.type == pa.fs.FileType.File else listed(fs, folder, k, n)
            try:
                return sorted((modified, path) for modified, path, size in files if size >= 0 and partition.low < (modified, path) <= partition.high)
            except FileNotFoundError:
                return []  # deleted since it was listed

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "modified", "content"])

        for modified, path in (f for share in partition.shares for f in found(*share)):
            try:
                with fs.open_input_stream(path) as f:
                    held.append((path, modified, f.read()))
            except FileNotFoundError:
                continue  # deleted since it was listed
            size += len(held[-1][2])
            if size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class ModifiedFiles(DataSource):
    """``format("modified_files")``: options ``path``, ``recursive`` (false) and ``quietMs`` (500)."""

    @classmethod
    def name(cls) -> str:
        return "modified_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ModifiedReader:
        return ModifiedReader(dict(self.options))


def modified_files(spark: SparkSession, path: str, recursive: bool = False, excludes: tuple[str, ...] = (), quiet_ms: int = QUIET_MS) -> DataFrame:
    """A stream of path, ext, content, seq and ts: every file at or below ``path`` each time it is modified.

    ``seq`` is the time of modification in nanoseconds, ``ts`` the same as a timestamp.  Binary
    files are left out and invalid bytes replaced; excludes do not apply to a single file.  A file
    that is modified again before its folder is listed by a task comes with its later content alone, at the later
    time.  A file put in place with an older time of modification than those seen is not noticed.
    """
    spark.dataSource.register(ModifiedFiles)
    raw = spark.readStream.format("modified_files").option("path", path).option("recursive", str(recursive).lower()).option("quietMs", quiet_ms).load()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    single = fs.exists(fs_path) and fs.getFileStatus(fs_path).isFile()
    raw = raw if single else without(raw, excludes)
    return decoded(raw, F.col("modified").alias("seq"), F.timestamp_micros(F.expr("modified div 1000")).alias("ts"))
