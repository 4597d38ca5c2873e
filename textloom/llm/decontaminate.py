"""Benchmark items inside documents: SimHash of item-sized windows, Hamming blocks, exact check."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import CACHES, id_and_text, plain_names, tidy
from .shingles import WIDTH, cells, shingles, word_hashes, words_of

SIMILARITY = 0.8
#: Fingerprints differ by at most this many of 64 bits.  A pair at similarity 0.8 differs by 9.7 bits
#: on average with a standard deviation of 2.9, so one in about 2000 such pairs is missed; closer ones are not.
RADIUS = 19
BLOCK_BITS = (13, 13, 13, 13, 12)
#: Items of a block and their bytes, about; bytes of items in one pass over the documents; blocks that a worker
#: has an index of at once.
ITEMS_AT_ONCE, BLOCK_BYTES, BYTES_AT_ONCE, BLOCKS_HELD = 500, 4 << 20, 64 << 20, 4
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32())])
_BITMAP = 1 << 20


def signs(values: np.ndarray) -> np.ndarray:
    """(n, 64) of -1 and 1: the bits of each hash."""
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint for each row of summed signs."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def block_values(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in BLOCK_BITS:
        out.append(((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    return out


class HammingIndex:
    """All fingerprints within RADIUS: of five blocks one differs by at most RADIUS // 5 bits.

    For every block a table says which items are that close to each block value.
    """

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        near = RADIUS // len(BLOCK_BITS)
        for bits, values in zip(BLOCK_BITS, block_values(prints)):
            flips = np.array([sum(1 << b for b in c) for k in range(near + 1) for c in combinations(range(bits), k)])
            table = np.zeros((1 << bits, len(prints)), bool)
            for j, v in enumerate(values):
                table[v ^ flips, j] = True
            self.tables.append(table)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of every pair within RADIUS."""
        hit = np.zeros((len(prints), len(self.prints)), bool)
        for table, v in zip(self.tables, block_values(prints)):
            hit |= table[v]
        row, item = np.nonzero(hit)
        far = np.bitwise_count(prints[row] ^ self.prints[item]).astype(np.int32)
        ok = far <= RADIUS
        return row[ok], item[ok], far[ok]


class Items:
    """A block of the searched items, by their number of words."""

    def __init__(self, rows: list[tuple[int, str]]):
        by: dict[int, list] = {}
        for item_id, text in rows:
            if words := words_of(text):
                h = word_hashes(words)
                by.setdefault(len(words), []).append((item_id, shingles(h)))
        self.groups = []
        self.known: dict[int, np.ndarray] = {}
        for n, items in sorted(by.items()):
            width = min(n, WIDTH)
            index = HammingIndex(np.concatenate([fingerprints(signs(s).sum(0, keepdims=True)) for _, s in items]))
            self.groups.append((n, width, [i for i, _ in items], [np.unique(cells(s)) for _, s in items], index))
            self.known[width] = np.unique(np.concatenate([*(s for _, s in items), self.known.get(width, np.empty(0, np.uint64))]))

    def starts(self, hits: np.ndarray, n: int, words: int, width: int) -> np.ndarray:
        """Window starts that can hold a shingle of an item; all others have similarity 0."""
        if words <= n:
            return np.zeros(1, np.int64)
        edge = np.zeros(words - n + 2, np.int64)
        np.add.at(edge, np.maximum(hits - (n - width), 0), 1)
        np.add.at(edge, np.minimum(hits, words - n) + 1, -1)
        return np.flatnonzero(np.cumsum(edge)[:-1] > 0)

    def search(self, h: np.ndarray, at: dict[int, tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple]:
        """(item_id, similarity, start, words, distance): the best window for every item found.

        ``h`` are the word hashes of a text; ``at`` has, by width, its shingles and the places of those
        that some item of the block holds.
        """
        best: dict[tuple[int, int], tuple] = {}
        for g, (n, width, ids, sets, index) in enumerate(self.groups):
            if width not in at:
                continue
            s, hits = at[width]
            starts = self.starts(hits, n, len(h), width)
            span = min(n, len(h)) - width + 1  # shingles of a window
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                for k in range(0, len(part), 8192):
                    p = part[k : k + 8192]
                    total = np.zeros((p[-1] - p[0] + span + 1, 64), np.int32)
                    np.cumsum(signs(s[p[0] : p[-1] + span]), axis=0, out=total[1:])
                    row, item, far = index.search(fingerprints(total[p - p[0] + span] - total[p - p[0]]))
                    for r in np.unique(row).tolist():
                        window = cells(s[p[r] : p[r] + span])
                        for j, d in zip(item[row == r].tolist(), far[row == r].tolist()):
                            c = len(np.intersect1d(window, sets[j], assume_unique=True))
                            sim = c / (len(window) + len(sets[j]) - c)
                            if sim >= similarity and (sim, -p[r]) > best.get((g, j), ((0.0, 0), 0))[0]:
                                best[g, j] = ((sim, -p[r]), (ids[j], sim, int(p[r]), min(n, len(h)), d))
        return [v for _, v in best.values()]


class Known:
    """Which blocks of items hold each shingle."""

    def __init__(self, blocks: list[dict[int, np.ndarray]]):
        self.by = {}
        for width in sorted({w for k in blocks for w in k}):
            values = np.concatenate([k[width] for k in blocks if width in k])
            block = np.concatenate([np.full(len(k[width]), b, np.int32) for b, k in enumerate(blocks) if width in k])
            order = np.lexsort((block, values))
            bitmap = np.zeros(_BITMAP, bool)
            bitmap[(values % np.uint64(_BITMAP)).astype(np.int64)] = True
            self.by[width] = (values[order], block[order], bitmap)

    def hits(self, h: np.ndarray) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """By block and width: the shingles of a text, and the places of those that the block holds."""
        out: dict[int, dict] = {}
        for width, (values, block, bitmap) in self.by.items():
            if len(h) < width:
                continue
            s = shingles(h, width)
            place = np.flatnonzero(bitmap[(s % np.uint64(_BITMAP)).astype(np.int64)])
            lo = np.searchsorted(values, s[place])
            n = np.searchsorted(values, s[place], "right") - lo
            of = block[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            place = np.repeat(place, n)
            for b in np.unique(of).tolist():
                out.setdefault(b, {})[width] = (s, place[of == b])
        return out


_BLOCKS: dict[int, Items] = {}
CACHES["items"] = _BLOCKS.clear


class Benchmark:
    """All items: what shingles they hold, and the items themselves in blocks of broadcasts.

    A worker makes the index of a block when a text shares a shingle with it, and
    remembers BLOCKS_HELD of them.
    """

    def __init__(self, known, blocks):
        self.known, self.blocks = known, blocks

    def block(self, b: int) -> Items:
        if b not in _BLOCKS:
            while len(_BLOCKS) >= BLOCKS_HELD:
                del _BLOCKS[next(iter(_BLOCKS))]
            _BLOCKS[b] = Items(self.blocks[b].value)
        return _BLOCKS[b]

    def search(self, text: str | None, similarity: float) -> list[tuple]:
        words = words_of(text)
        if not words:
            return []
        h = word_hashes(words)
        return [f for b, at in sorted(self.known.value.hits(h).items()) for f in self.block(b).search(h, at, similarity)]


@tidy("shingles")
def _search(batches, items: Benchmark, similarity: float):
    for batch in batches:
        out = [(d.as_py(), *f) for d, t in zip(batch.column("doc_id"), batch.column("text")) for f in items.search(t.as_py(), similarity)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _ARROW.field(k).type) for k in range(6)], schema=_ARROW)


def _passes(benchmark: DataFrame):
    """The items, for one pass over the documents; for several only beyond BYTES_AT_ONCE bytes of items.

    The driver holds the texts of one block of about ITEMS_AT_ONCE items at a time, and the hashes of
    the shingles of a pass.
    """
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(-(-n // ITEMS_AT_ONCE), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, count)))
    passes = -(-size // BYTES_AT_ONCE)
    for numbers in np.array_split(np.arange(count), passes) if count else ():
        known, blocks = [], []
        for b in numbers.tolist():
            rows = sorted(((r["item_id"], r["text"]) for r in items.where(block == b).collect()), key=lambda r: (r[0] is None, r))
            known.append(Items(rows).known)
            blocks.append(sc.broadcast(rows))
        yield Benchmark(sc.broadcast(Known(known)), blocks)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for every document and benchmark item of which some window is a near copy.

    A window has as many words as the item (the whole document, if that is shorter).
    Similarity is weighted Jaccard over five-word shingles; items of under five words
    are one shingle.  Windows that share no shingle with any item have similarity 0
    and are not fingerprinted.  Null and empty texts, and items without words, match
    nothing; repeated rows and items are each reported; an empty table gives no rows.
    """
    out = None
    for items in _passes(benchmark):
        part = id_and_text(docs).mapInArrow(partial(_search, items=items, similarity=similarity), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


@tidy("shingles")
def _clean(batches, items: Benchmark, similarity: float):
    for batch in batches:
        yield batch.filter(pa.array([not items.search(t.as_py(), similarity) for t in batch.column("text")], pa.bool_()))


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no near copy of a benchmark item; columns stay."""
    rows = plain_names(docs)
    for items in _passes(benchmark):
        rows = rows.mapInArrow(partial(_clean, items=items, similarity=similarity), rows.schema)
    return rows.toDF(*docs.columns)
