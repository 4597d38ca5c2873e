"""Files as rows of path, ext, content; cleaned text as a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.engine import once


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for whole paths: ``*`` and ``?`` also match separators."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 2
        elif c == "*":
            out += ".*"
            i += glob[i + 1 : i + 2] == "*"
        elif c == "?":
            out += "."
        elif c in "[]":
            out += c
        elif c == "!" and out.endswith("["):
            out += "^"
        elif c == "{":
            out += "(?:"
        elif c == "}":
            out += ")"
        elif c == "," and out.count("(?:") > out.count(")"):
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def decoded(raw: DataFrame, *more: Column) -> DataFrame:
    """(path, content bytes) to (path, ext, content) and ``more``: no binary files, invalid bytes replaced."""
    text = raw.where(~F.contains("content", F.lit(bytearray(1))))
    ext = F.regexp_extract("path", r"[^/.][^/]*\.([^./]+)$", 1)
    return text.select("path", F.when(ext != "", ext).alias("ext"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), *more)


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt out over all cores.

    A file of one row group is read by one task, into however many splits it is cut.  Only a scan
    of fewer splits than there are cores is dealt out, so a large input is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def discover(spark: SparkSession, path: str, recursive: bool = False, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Text files at or below ``path``.  Excludes do not apply to a single file; hidden files
    (names that begin with ``_`` or ``.``) are those that Spark's reader passes over."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(path)
    single = fs.getFileStatus(fs_path).isFile()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    return decoded(raw if single else without(raw, excludes))


def without(files: DataFrame, excludes: tuple[str, ...]) -> DataFrame:
    """Files whose paths none of the globs takes."""
    for g in excludes:
        files = files.where(~F.col("path").rlike(glob_pattern(g)))
    return files


def write_cleaned(df: DataFrame, path: str, mode: str = "error") -> None:
    """Changed texts only, to a new place; inputs are never overwritten."""
    once(df.select("path", "content", "cleaned"), "cleaned").where("content <> cleaned").select("path", "cleaned").write.mode(mode).parquet(path)
