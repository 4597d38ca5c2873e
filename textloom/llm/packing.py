"""Packing of documents into training windows by multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .runtime import id_and_text, tidy
from .tokens import END_ID, default_path, words_of

CAPACITY = 2048
#: Windows that are balanced at once, and the share of them that is left free so that balanced windows fit.
GROUP_WINDOWS, SLACK = 128, 0.005
#: At each level of cutting: the largest pieces of documents that fit a window, of what is left of longer ones, and (from
#: the second on) of every FINE_EVERY-th document, whose pieces even out what the large ones leave.
LEVELS = ((2048, 96, 96), (2048, 96, 64), (1024, 96, 64), (512, 512, 42), (256, 256, 21), (128, 128, 10))
FINE_EVERY = 12
#: Share of padding in a group that is tried first, and above which documents are cut further.
PADDING = (0.012, 0.026)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: split item indices into ``k`` windows of near-equal size.

    Every item starts as a partial partition that holds it in one window and
    nothing in the others.  The two partitions of the largest imbalance are
    merged, the fullest window of one with the emptiest of the other, until one
    partition is left.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap, joined = [], []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], nodes[-1] = s, i
        heap.append((-(s if k > 1 else 0), i, sums, nodes))
    heapq.heapify(heap)
    n, turn = len(sizes), len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        b, y = b[::-1], y[::-1]
        sums, nodes = a + b, np.maximum(x, y)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            nodes[both] = np.arange(n, n + len(both))
            joined.extend(zip(x[both].tolist(), y[both].tolist()))
            n += len(both)
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), turn, sums, nodes[order]))
        turn += 1
    out = []
    for root in heap[0][3].tolist():
        items, todo = [], [root] if root >= 0 else []
        while todo:
            v = todo.pop()
            if v < len(sizes):
                items.append(v)
            else:
                todo.extend(joined[v - len(sizes)])
        out.append(sorted(items))
    return out


def windows_of(sizes: list[int], capacity: int = CAPACITY, least: int = 0, most: int | None = None) -> list[list[int]] | None:
    """Near-equal windows of uncut items, at least ``least``: their count rises whenever one is over capacity.
    None if it would rise above ``most``."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item is larger than a window")
    k = max(least, -(-sum(sizes) // capacity))
    while most is None or k <= most:
        windows = differencing(sizes, k) if k else []
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += max(1, k // 64)
    return None


class Group:
    """Remainders of documents that wait to be balanced.  A piece is (document, start, length)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room = int(GROUP_WINDOWS * capacity * (1 - SLACK))
        self.waiting: list[tuple] = []
        self.tokens = self.level = self.closed = 0

    def add(self, doc, start: int, length: int) -> None:
        self.waiting.append((doc, start, length))
        self.tokens += length

    @property
    def full(self) -> bool:
        return self.tokens + self.capacity > self.room

    def items(self, level: int) -> list[list]:
        """What is balanced: near-equal pieces, and bundles of small ones.

        What is left of a document longer than a window is cut at every level; documents
        that fit a window are whole at the first one.
        """
        fits, left, small = (max(1, m * self.capacity // CAPACITY) for m in LEVELS[level])
        out, bundle, size, nth = [], [], 0, 0
        for doc, start, length in self.waiting:
            most = left if start else fits
            if level and (nth := nth + 1) % FINE_EVERY == 1:
                most = small
            parts = -(-length // most)
            for i in range(parts):
                lo, hi = start + length * i // parts, start + length * (i + 1) // parts
                if hi - lo >= small // 2:
                    out.append([(doc, lo, hi - lo)])
                    continue
                bundle.append((doc, lo, hi - lo))
                size += hi - lo
                if size >= small // 2:
                    out.append(bundle)
                    bundle, size = [], 0
        return out + ([bundle] if bundle else [])

    def close(self) -> list[list]:
        """All that waits, as windows of pieces, cut no further than the padding asks for.

        The level that the group before ended with is tried first, and now and then the one below.
        """
        self.closed += 1
        start = max(0, self.level - 1) if self.closed % 8 == 0 else self.level
        windows: list[list] = []
        for self.level in range(start, len(LEVELS)):
            items = self.items(self.level)
            sizes = [sum(p[2] for p in i) for i in items]
            last = self.level == len(LEVELS) - 1
            least, most = (int(self.tokens / self.capacity / (1 - p)) + 1 for p in PADDING)
            found = windows_of(sizes, self.capacity) if last else windows_of(sizes, self.capacity, least, most)
            if found is not None:
                windows = [[p for i in w for p in items[i]] for w in found]
                break
        self.waiting, self.tokens = [], 0
        return windows

    def finish(self) -> list[list]:
        """The last windows: what does not fill whole ones, or does not fit when they are balanced, is cut off
        and closed without padding."""
        whole, rest = self.tokens // self.capacity, []
        left = int(whole * self.capacity * (1 - SLACK))
        while self.tokens > left:
            doc, start, length = self.waiting.pop()
            cut = min(length, self.tokens - left)
            rest.append((doc, start + length - cut, cut))
            self.tokens -= cut
            if length > cut:
                self.waiting.append((doc, start, length - cut))
        items = self.items(max(self.level, 3))
        windows = [[p for i in w for p in items[i]] for w in differencing([sum(p[2] for p in i) for i in items], whole)]
        for w in windows:
            over = sum(p[2] for p in w) - self.capacity
            while over > 0:
                doc, start, length = w.pop()
                cut = min(length, over)
                rest.append((doc, start + length - cut, cut))
                over -= cut
                if length > cut:
                    w.append((doc, start, length - cut))
        self.waiting, self.tokens = [], 0
        return [w for w in windows if w] + power_windows(rest, self.capacity)


def power_windows(pieces: list, capacity: int) -> list[list]:
    """Cut pieces into windows of powers of two: no padding."""
    out, left = [], sum(p[2] for p in pieces)
    pieces = pieces[::-1]
    while left:
        room = min(capacity, 1 << (left.bit_length() - 1))
        left -= room
        held = []
        while room:
            d, s, n = pieces.pop()
            held.append((d, s, min(n, room)))
            if n > room:
                pieces.append((d, s + room, n - room))
            room -= min(n, room)
        out.append(held)
    return out


@tidy("tokens")
def _pack(batches, path: str, capacity: int):
    words, end = words_of(path), np.array([END_ID], "<u4").tobytes()
    base, count = TaskContext.get().partitionId() << 33, 0
    group, out = Group(capacity), [[] for _ in _ARROW]

    def emit(window):
        nonlocal count
        at = 0
        for (doc_id, ids), s, n in window:
            row = (doc_id, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), len(ids) // 4, base + count, at)
            for column, v in zip(out, row):
                column.append(v)
            at += n
        count += 1

    def flush():
        done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_ARROW)
        for c in out:
            c.clear()
        return done

    for batch in batches:
        ids_of, texts = batch.column("doc_id"), batch.column("text")
        for i in range(batch.num_rows):
            ids = words.encode(texts[i].as_py()) + end
            doc, n = (ids_of[i].as_py(), ids), len(ids) // 4
            cut = n - n % capacity
            for s in range(0, cut, capacity):
                emit([(doc, s, capacity)])
            if n > cut:
                group.add(doc, cut, n - cut)
            if group.full:
                for w in group.close():
                    emit(w)
            if len(out[0]) >= 4096:
                yield flush()
    for w in group.finish():
        emit(w)
    yield flush()


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack all documents into sequences of at most ``capacity`` tokens.

    Each partition tokenises its documents, cuts whole windows off long ones and
    balances the remainders, a bounded group at a time, by Karmarkar-Karp differencing; a
    group takes one more window as long as one is over capacity, and windows are padded by what they are
    short of it.  Documents that fit a window stay whole if padding then is at most
    3 %; else all are cut, further and further, until it is.  At a partition's end tokens beyond whole windows
    are cut off into windows of powers of two.  No shuffle, no state that grows with the input.  Sequence
    identifiers are partition number and running count, so a task that is run
    again gives the same ones.

    Returns a row per piece (see ``SCHEMA``).  Null and empty texts are one end
    token; repeated rows and null identifiers are packed like any other row; an
    empty table gives no rows; further columns are ignored.
    """
    return id_and_text(docs).mapInArrow(partial(_pack, path=tokenizer_path or default_path(), capacity=capacity), SCHEMA)
