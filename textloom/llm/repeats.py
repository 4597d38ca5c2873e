"""Repeated passages: a sparse suffix array over the bytes of all texts.

Only suffixes that start at anchors are sorted.  Every window of PASSAGE bytes, and so
every one of WINDOW bytes, holds an anchor: its k-gram of least hash.  Equal windows
have equal anchors at equal places, so each pair of them is seen at its anchor: the
suffixes there agree to the right, the bytes before them to the left.

Suffixes with equal bytes all around (as far as any window of theirs reaches) are
counted as one before anything is sorted.  What is left goes by sampled splitters over
the leading k-gram to range partitions.  A splitter falls between two different
k-grams, so suffixes that have a window in common are never on two sides of one.  Each
partition is read in order, in chunks of whole k-grams; a chunk is sorted by multikey
quicksort, and runs of suffixes that share enough bytes with their neighbours are read
off the common prefixes, whatever the number of suffixes.  A k-gram with more than HOT
different surroundings is split: its windows are dealt out by their own bytes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import id_and_text, keep, scratch, tidy
from .shingles import mix

#: Bytes of a removed string, and of a string that counts as shared between documents (50 words take more).
WINDOW, PASSAGE = 400, 256
SIZES = (WINDOW, PASSAGE)
GRAM = 48
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
#: Bytes of a text that are anchored at once, and bytes on both sides that windows of its anchors may reach.
BLOCK, MARGIN = 1 << 22, 2 * WINDOW
#: Suffixes that are sorted at once (whole k-grams), and different surroundings from which a k-gram is split.
CHUNK, HOT = 16_384, 32_768
_POSITION = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM (3 x 16) bytes, by doubling."""
    h, width, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    while width < GRAM // 3:
        h = h[:-width] * power + h[width:]
        power, width = power * power, width * 2
    return mix((h[: -2 * width] * power + h[width:-width]) * power + h[2 * width :])


def _least(least: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each run of windows with the same least k-gram of ``span``."""
    n, width = len(least), 1
    if n < span:
        return (np.empty(0, np.int64),) * 3
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    least = np.minimum(least[: n - span + 1], least[span - width :])
    a = (least & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a[first], first, np.diff(first, append=len(a))


def anchors(data: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, bytes before it, bytes from it on, k-gram hash): as far as the windows of the anchor reach."""
    out = []
    for at in range(0, len(data), block):
        base = max(0, at - MARGIN)
        part = data[base : at + block + MARGIN]
        if len(part) < PASSAGE:
            continue
        h = gram_hashes(part)
        least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        a, lo, n = _least(least, PASSAGE - GRAM + 1)
        hi = lo + n - 1 + PASSAGE
        # the windows of WINDOW bytes reach further, and their anchors are among the same
        wide, w_lo, w_n = _least(least, WINDOW - GRAM + 1)
        at_wide = np.searchsorted(a, wide)
        lo[at_wide] = np.minimum(lo[at_wide], w_lo)
        hi[at_wide] = np.maximum(hi[at_wide], w_lo + w_n - 1 + WINDOW)
        own = (a + base >= at) & (a + base < at + block)
        a, lo, hi = a[own], lo[own], hi[own]
        out.append((a + base, a - lo, hi - a, h[a].view(np.int64)))
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*out))


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in text.split(", "))])


#: A suffix: its text, k-gram, surroundings, place, and the bytes before and from there on that count.
ANCHORS = "tkey binary, akey long, ctx long, a long, l int, r int"


@tidy()
def _anchor_rows(batches, block: int):
    schema = _schema(ANCHORS)
    for batch in batches:
        rows: list[list] = [[] for _ in schema]
        for t in batch.column("text"):
            b = raw(t.as_py())
            if len(b) < PASSAGE:
                continue
            tkey = xxhash.xxh3_128_digest(b)
            a, l, r, h = (c.tolist() for c in anchors(np.frombuffer(b, np.uint8), block))
            ctx = [xxhash.xxh3_64_intdigest(b[x - i : x + k], i) - (1 << 63) for x, i, k in zip(a, l, r)]
            for column, values in zip(rows, ([tkey] * len(a), h, ctx, a, l, r)):
                column.extend(values)
            if len(rows[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                rows = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


SUFFIXES = "gram binary, tkey binary, a long, akey long, ctx long, copies boolean, several boolean, hot boolean, before binary, after binary"


@tidy()
def _suffix_rows(batches):
    """The bytes around the places that ``need`` names in each text."""
    schema = _schema(SUFFIXES)
    for batch in batches:
        for tkey, text, need in zip(*(batch.column(c).to_pylist() for c in ("tkey", "text", "need"))):
            b, rows = raw(text), []
            for x in need:
                a = x["a"]
                rows.append((b[a : a + GRAM], tkey, a, x["akey"], x["ctx"], x["copies"], x["several"], x["hot"], b[a - x["l"] : a], b[a : a + x["r"]]))
                if len(rows) >= 8192:
                    yield _batch(schema, rows)
                    rows = []
            yield _batch(schema, rows)


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes, filled with zeros, as big-endian words: their order is that of the bytes."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), ">u8").reshape(len(parts), -1).astype(np.uint64)


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """The order of rows: three-way partition on one column, the middle goes on with the next."""
    out, todo = [], [(np.arange(len(rows)), 0)]
    while todo:
        part, depth = todo.pop()
        while len(part) > 1 and depth < rows.shape[1]:
            key = rows[part, depth]
            pivot = key[len(key) // 2]
            less, more = key < pivot, key > pivot
            low, high = part[less], part[more]
            if not len(low) and not len(high):
                depth += 1
                continue
            if len(high):
                todo.append((high, depth))
            todo.append((part[~(less | more)], depth + 1))
            part = low
        out.append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common(m: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Leading bytes that each row shares with the one before it in ``order``; the first has none."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    x, y = m[order[1:]], m[order[:-1]]
    differs = x != y
    first = differs.argmax(1)
    at = np.arange(len(first))
    words = (x[at, first] ^ y[at, first]).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[1:] = np.where(differs.any(1), 8 * first + (words != 0).argmax(1), 8 * m.shape[1])
    return out


def repeated(after: list[bytes], before: list[bytes], text: np.ndarray, several: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, kind, least offset, greatest offset) of windows that another row has too.

    A window of SIZES[kind] bytes starts ``offset`` bytes before the row's anchor.  Rows
    are suffixes of whole k-grams; windows of kind 1 count only if the rows are of different
    texts (``text`` numbers them) or one of them is ``several``, that is, of more than one.
    """
    right = _matrix(after, WINDOW)
    order = multikey_quicksort(right)
    shared = common(right, order)
    group = np.empty(len(order), np.uint64)
    group[order] = np.cumsum(shared < GRAM)
    left = np.concatenate([group[:, None], _matrix([b[::-1] for b in before], WINDOW - GRAM)], 1)
    order_l = multikey_quicksort(left)
    shared_l = common(left, order_l) - 8  # the number of the k-gram is no byte of the text
    n_left = np.array([len(b) for b in before])
    n_right = np.array([len(b) for b in after])
    by_right, by_left = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    out = []
    for kind, size in enumerate(SIZES):
        last = np.minimum(n_left, size - GRAM)
        first = np.maximum(0, size - n_right)
        opened = np.full(len(order), -1)
        for o in range(0, size - GRAM + 2):
            here = np.flatnonzero((first <= o) & (o <= last)) if o <= size - GRAM else np.empty(0, np.int64)
            hit = np.zeros(len(order), bool)
            if len(here) > 1:
                by_right[order] = np.cumsum(shared < size - o)
                by_left[order_l] = np.cumsum(shared_l < o)
                key = by_right[here] * (len(order) + 1) + by_left[here]
                _, place, count = np.unique(key, return_inverse=True, return_counts=True)
                two = count > 1
                if kind:
                    least, most = np.full(len(count), 1 << 62), np.full(len(count), -1)
                    np.minimum.at(least, place, text[here])
                    np.maximum.at(most, place, text[here])
                    mixed = np.zeros(len(count), bool)
                    mixed[place[several[here]]] = True
                    two &= mixed | (least < most)
                hit[here[two[place]]] = True
            for i in np.flatnonzero(~hit & (opened >= 0)).tolist():
                out.append((i, kind, int(opened[i]), o - 1))
            opened[~hit] = -1
            opened[hit & (opened < 0)] = o
    return out


#: Windows of a text (or of every copy of a suffix, where ``copies``): offsets before the anchor ``a``.
RANGES = "tkey binary, akey long, ctx long, copies boolean, kind int, a long, least int, most int"


@tidy()
def _bucket(batches, chunk: int):
    """Repeated windows of suffixes that come in order of their k-grams, by chunks of whole k-grams."""
    schema = _schema(RANGES)
    held: list[dict] = []

    def done(rows: list[dict]):
        number = {t: i for i, t in enumerate({r["tkey"]: None for r in rows})}
        text = np.array([number[r["tkey"]] for r in rows], np.int64)
        several = np.array([r["several"] for r in rows], bool)
        found = repeated([r["after"] for r in rows], [r["before"] for r in rows], text, several)
        return _batch(schema, [(r["tkey"], r["akey"], r["ctx"], r["copies"], kind, r["a"], lo, hi) for i, kind, lo, hi in found for r in (rows[i],)])

    for batch in batches:
        for row in batch.to_pylist():
            if len(held) >= chunk and held[-1]["gram"] != row["gram"]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


WINDOWS = "window binary, kind int, tkey binary, a long, o int, akey long, ctx long, copies boolean, several boolean"


@tidy()
def _window_rows(batches):
    """Every window of suffixes of hot k-grams, by a hash of its bytes."""
    schema = _schema(WINDOWS)
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            data, l = r["before"] + r["after"], len(r["before"])
            for kind, size in enumerate(SIZES):
                for o in range(max(0, size - len(r["after"])), min(l, size - GRAM) + 1):
                    rows.append((xxhash.xxh3_128_digest(data[l - o : l - o + size]), kind, r["tkey"], r["a"], o, r["akey"], r["ctx"], r["copies"], r["several"]))
            if len(rows) >= 16_384:
                yield _batch(schema, rows)
                rows = []
        yield _batch(schema, rows)


def _hot(suffixes: DataFrame) -> DataFrame:
    """``_bucket`` for hot k-grams: windows meet by their bytes, with partial aggregation before the shuffle."""
    windows = suffixes.where("hot").mapInArrow(_window_rows, WINDOWS)
    place = F.struct("tkey", F.col("a") - F.col("o"))
    found = windows.groupBy("window", "kind").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.min("tkey").alias("t"), F.max("tkey").alias("u"), F.max("several").alias("s"))
    found = found.where("x <> y and (kind = 0 or t <> u or s)").select("window", "kind")
    return windows.join(found, ["window", "kind"], "left_semi").select("tkey", "akey", "ctx", "copies", "kind", "a", F.col("o").alias("least"), F.col("o").alias("most"))


def _spans(windows, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows (first start, last start) of ``size`` bytes cover."""
    runs: list[list[int]] = []
    for lo, hi in sorted(windows):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + size)
        else:
            runs.append([lo, hi + size])
    return [(a, b) for a, b in runs]


def words_inside(data: bytes, lo: int, hi: int) -> int:
    """Words (between ASCII white space) that lie whole in ``data[lo:hi]``."""
    inside = lambda at: 0 < at < len(data) and not data[at - 1 : at].isspace() and not data[at : at + 1].isspace()
    return max(0, len(data[lo:hi].split()) - inside(lo) - inside(hi))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_bytes long, longest_shared_words long"


@tidy()
def _cut_rows(batches):
    schema = _schema(OUT)
    for batch in batches:
        rows = []
        for doc_id, text, windows in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "windows"))):
            b = raw(text)
            gone = _spans([(w["lo"], w["hi"]) for w in windows or () if w["kind"] == 0], WINDOW)
            shared = _spans([(w["lo"], w["hi"]) for w in windows or () if w["kind"] == 1], PASSAGE)
            if len(b) >= PASSAGE and any(w["kind"] == 2 for w in windows or ()):  # the whole text is in another document
                shared = [(0, len(b))]
            kept = b"".join(b[i:j] for i, j in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(b)]))
            rows.append((doc_id, len(b), len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(j - i for i, j in shared), max((words_inside(b, i, j) for i, j in shared), default=0)))
        yield _batch(schema, rows)


@tidy()
def _with_key(batches):
    for batch in batches:
        keys = [xxhash.xxh3_128_digest(raw(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["doc_id", "text", "tkey"])


def _every(size: int) -> list:
    """The least and greatest offsets of windows of ``size`` bytes around an anchor."""
    return [F.greatest(F.lit(0), F.lit(size) - F.col("r")).alias("least"), F.least("l", F.lit(size - GRAM)).alias("most")]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_bytes, longest_shared_words for every row.

    Removed is each byte that a WINDOW-byte string covers which also starts elsewhere,
    in this text or another; a repeated row is another text.  ``n_shared_bytes`` counts
    bytes of PASSAGE-byte strings that stand in another row too, and
    ``longest_shared_words`` the words in the longest run of such bytes.  Texts shorter
    than these strings have none; null counts as empty; an empty table gives no rows.
    """
    spark, docs = docs.sparkSession, id_and_text(docs)
    with scratch(spark) as hand_on:
        found = keep(docs.mapInArrow(partial(_anchor_rows, block=BLOCK), ANCHORS), "anchors")
        one = F.min(F.struct("tkey", "a", "l", "r")).alias("one")
        classes = found.groupBy("akey", "ctx").agg(F.count("*").alias("n"), one, F.max("tkey").alias("last"))
        classes = keep(classes.select("akey", "ctx", "one.*", (F.col("n") > 1).alias("copies"), (F.col("one.tkey") != F.col("last")).alias("several")), "classes")
        keys = classes.groupBy("akey").agg(F.count("*").alias("kinds"), F.min("several").alias("settled")).where("kinds > 1 and not settled")
        need = classes.join(keys.select("akey", (F.col("kinds") > HOT).alias("hot")), "akey")
        need = need.groupBy("tkey").agg(F.collect_list(F.struct("a", "l", "r", "akey", "ctx", "copies", "several", "hot")).alias("need"))
        keyed = docs.mapInArrow(_with_key, "doc_id long, text string, tkey binary")
        once = keyed.groupBy("tkey").agg(F.min("text").alias("text"))
        suffixes = keep(once.join(need, "tkey").mapInArrow(_suffix_rows, SUFFIXES), "suffixes")
        ranges = suffixes.where("not hot").repartitionByRange("gram").sortWithinPartitions("gram").mapInArrow(partial(_bucket, chunk=CHUNK), RANGES)
        if suffixes.where("hot").limit(1).count():
            ranges = ranges.unionByName(_hot(suffixes))
        ranges = keep(ranges, "ranges")

        # what holds for one of the equal suffixes of a class holds for each
        whole = classes.where("copies").select("akey", "ctx", F.lit(0).alias("kind"), *_every(WINDOW))
        whole = whole.unionByName(classes.where("several").select("akey", "ctx", F.lit(1).alias("kind"), *_every(PASSAGE)))
        whole = whole.unionByName(ranges.where("copies and kind = 1").select("akey", "ctx", "kind", "least", "most")).where("least <= most")
        windows = found.select("akey", "ctx", "tkey", "a").join(whole, ["akey", "ctx"]).select("tkey", "kind", "a", "least", "most")
        windows = windows.unionByName(ranges.select("tkey", "kind", "a", "least", "most"))
        windows = windows.select("tkey", "kind", (F.col("a") - F.col("most")).alias("lo"), (F.col("a") - F.col("least")).alias("hi"))
        several = keyed.groupBy("tkey").agg(F.count("*").alias("n")).where("n > 1").select("tkey", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
        windows = hand_on(keep(windows.unionByName(several).groupBy("tkey").agg(F.collect_set(F.struct("kind", "lo", "hi")).alias("windows")), "windows"))
    return keyed.join(windows, "tkey", "left").select("doc_id", "text", "windows").mapInArrow(_cut_rows, OUT)
