"""Token sequences in training order: fixed-stride binary shards by a keyed permutation."""

from __future__ import annotations

import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, id_and_text, keep, new_path, tidy
from .shingles import mix
from .tokens import END_ID, default_path, words_of

LENGTH = 2048
#: Sequences of a shard: 16 MB at two bytes a token.
SHARD = 4096
KEY = 20_240_601
ROUNDS = 4
SEQUENCES = "part long, k long, n_tokens long, tokens binary"
MANIFEST = "slot long, shard long, byte_offset long, sequence_index long, n_tokens long, crc32 long"


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 .. n - 1.

    A balanced Feistel network permutes the next even power of two; values of n and
    above walk on along their cycle until they are below n.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@tidy("tokens")
def _sequences(batches, path: str, length: int):
    """Documents of a partition one after the other, cut into sequences; the last is filled with END_ID."""
    words, end = words_of(path), np.array([END_ID], "<u4").tobytes()
    part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

    def cut(data, count):
        nonlocal k
        t = np.frombuffer(data, "<u4")
        if len(t) and t.max() > 65_535:
            raise ValueError("the vocabulary does not fit two bytes")
        t = t.astype("<u2")
        rows = [t[i : i + length].tobytes() for i in range(0, len(t), length)]
        out = pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(range(k, k + len(rows)), pa.int64()), pa.array(count, pa.int64()), pa.array(rows, pa.binary())], names=["part", "k", "n_tokens", "tokens"])
        k += len(rows)
        return out

    for batch in batches:
        for t in batch.column("text"):
            held.append(words.encode(t.as_py()) + end)
            size += len(held[-1]) // 4
            if size >= 256 * length:
                data = b"".join(held)
                whole = size // length * length
                yield cut(data[: 4 * whole], [length] * (whole // length))
                held, size = [data[4 * whole :]], size - whole
    if size:
        data = b"".join(held)
        n = -(-size // length)
        yield cut(data + end * (n * length - size), [length] * (n - 1) + [size - (n - 1) * length])


@tidy()
def _slots(batches, bases: dict, n: int, key: int):
    for batch in batches:
        index = np.array([bases[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("k").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(permuted(index, n, key)), pa.array(index), batch.column("n_tokens"), batch.column("tokens")], names=["slot", "sequence_index", "n_tokens", "tokens"])


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


@tidy()
def _write(batches, folder: str, per_shard: int, stride: int):
    """Write each shard of a sorted partition under another name, then rename: a task that is
    run again leaves the same files."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    now, out, name = None, None, None

    def close():
        if out is not None:
            out.close()
            fs.move(name, shard_path(root, now))

    for batch in batches:
        rows = []
        for slot, index, n, data in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence_index", "n_tokens", "tokens"))):
            shard = slot // per_shard
            if shard != now:
                close()
                now, name = shard, f"{shard_path(root, shard)}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(name)
            out.write(data)
            rows.append((slot, shard, slot % per_shard * stride, index, n, zlib.crc32(data)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=[c.split()[0] for c in MANIFEST.split(", ")])
    close()


def materialise(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, length: int = LENGTH, per_shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Write all documents as shards in training order; returns a manifest row per sequence.

    Documents are tokenised (each with END_ID after it), joined and cut by partition
    into sequences of ``length`` tokens, kept in the shared folder.  A sequence's index
    (those of earlier partitions, and its place in its own) is permuted to its slot;
    shard s holds slots s * per_shard and following, each at a fixed stride, so a
    reader resumes anywhere by arithmetic.  Every partition writes whole shards.

    Null and empty texts are one END_ID; an empty table gives no shard and no rows;
    repeated rows and null identifiers are written like any other; other columns are
    ignored.  ``byte_offset`` is that within the shard.
    """
    spark = docs.sparkSession
    seq = keep(id_and_text(docs).mapInArrow(partial(_sequences, path=tokenizer_path or default_path(), length=length), SEQUENCES), "sequences")
    bases, n = {}, 0
    for r in sorted(seq.groupBy("part").count().collect()):  # a row for each input partition
        bases[r["part"]] = n
        n += r["count"]
    folder = folder or new_path(spark, "shards")
    if not n:
        forget(seq)
        return spark.createDataFrame([], MANIFEST)
    placed = seq.mapInArrow(partial(_slots, bases=bases, n=n, key=key), "slot long, sequence_index long, n_tokens long, tokens binary")
    shards = -(-n // per_shard)
    ranges = placed.repartitionById(shards, (F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot")
    manifest = keep(ranges.mapInArrow(partial(_write, folder=folder, per_shard=per_shard, stride=2 * length), MANIFEST), "manifest")
    forget(seq)
    return manifest


def read_slots(folder: str, start: int, count: int, length: int = LENGTH, per_shard: int = SHARD):
    """Sequences of slots ``start`` and following, one after the other."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    while count > 0:
        shard, at = divmod(start, per_shard)
        take = min(count, per_shard - at)
        with fs.open_input_file(shard_path(root, shard)) as f:
            f.seek(at * 2 * length)
            data = np.frombuffer(f.read(take * 2 * length), "<u2").reshape(-1, length)
        yield from data
        if len(data) < take:
            return
        start, count = start + take, count - take
