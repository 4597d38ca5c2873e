"""Near-duplicate texts: dart signatures, banded joining, exact similarity, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import components
from .runtime import id_and_text, keep, plain_names, scratch, tidy
from .shingles import cells, mix, shingles, word_hashes, words_of

SIMILARITY = 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^24 < 0.0001.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NAME = np.uint64(0xA0761D6478BD642F)
#: Bits of the parity maps that bound how many cells two texts share.
MAP_BITS = 2048
#: Words and texts whose darts are thrown at once.
BLOCK_WORDS, BLOCK_TEXTS = 250_000, 1024


def darts(regions: np.ndarray, doc: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures (n_docs, k) of sets of unit regions, by hashed darts.

    The weight of an element is the number of its unit regions.  Darts fall on each
    region as a Poisson process in rank, drawn from hashes of the region alone, so
    equal regions of two documents get the same darts.  A document reads darts up to
    a rank at which about k (ln k + 2) have fallen on it in all; each goes to a hashed
    coordinate, where the earliest stays.  Documents with an empty coordinate read on
    to twice the rank.  A coordinate agrees with probability equal to the weighted
    Jaccard similarity; the cost is the number of regions and darts, not their product
    with k.
    """
    out = np.zeros((n_docs, k), np.uint64)
    size = np.bincount(doc, minlength=n_docs)
    limit = k * (np.log(k) + 2) / np.maximum(size, 1)
    todo = size > 0
    while todo.any():
        pick = todo[doc]
        x, d, rank = regions[pick], doc[pick], np.zeros(int(pick.sum()))
        keys, ranks, names = [], [], []
        while len(x):
            x = mix(x + _STEP)
            rank = rank - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = rank <= limit[d]
            x, d, rank = x[on], d[on], rank[on]
            name = mix(x ^ _NAME)
            keys.append(d * k + (name % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            names.append(name)
        key, order = np.concatenate(keys), np.argsort(-np.concatenate(ranks))
        flat, hit = out.reshape(-1), np.zeros(n_docs * k, bool)
        flat[key[order]] = np.concatenate(names)[order]  # the last written, of least rank, stays
        hit[key] = True
        todo &= ~hit.reshape(n_docs, k).all(1)
        limit = limit * 2
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    s = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2])
    for j in range(ROWS):
        out = mix(out * _STEP + s[:, :, j])
    return out.view(np.int64)


def parity_map(short: np.ndarray) -> np.ndarray:
    """MAP_BITS bits as longs: each tells whether an odd number of cells falls on it.

    A cell that one of two texts has alone changes one bit, so their maps differ in no
    more bits than they have cells alone.
    """
    return np.packbits(np.bincount(short & (MAP_BITS - 1), minlength=MAP_BITS) & 1).view(np.int64)


SCHEMA = "doc_id long, key binary, bands array<long>, cells array<int>, parity array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32())), ("parity", pa.list_(pa.int64()))])


def text_key(words: list[str]) -> bytes | None:
    """128 bits that stand for the words of a text; None without words."""
    return xxhash.xxh3_128_digest(" ".join(words)) if words else None


def _lists(values: np.ndarray, sizes: list[int], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


@tidy("shingles")
def _sign(batches):
    ids, keys, regions, n = [], [], [], 0

    def done():
        sizes = [len(r) for r in regions]
        flat = np.concatenate(regions) if regions else np.empty(0, np.uint64)
        b = bands(darts(flat, np.repeat(np.arange(len(regions)), sizes), len(regions)))
        short = [np.unique(r.astype(np.uint32).view(np.int32)) for r in regions]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), _lists(np.where(np.array(sizes)[:, None] > 0, b, 0).reshape(-1), [BANDS] * len(regions), pa.int64()), _lists(np.concatenate(short), [len(s) for s in short], pa.int32()), _lists(np.concatenate([parity_map(s) for s in short]), [MAP_BITS // 64] * len(short), pa.int64())],
            schema=_ARROW,
        )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            words = words_of(text.as_py())
            ids.append(doc_id.as_py())
            keys.append(text_key(words))
            regions.append(cells(shingles(word_hashes(words))))
            n += len(words)
            if n >= BLOCK_WORDS or len(ids) >= BLOCK_TEXTS:
                yield done()
                ids, keys, regions, n = [], [], [], 0
    if ids:
        yield done()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, similarity) of the pairs, by their exact weighted Jaccard similarity.

    ``sets`` has a row per text; cells are 32-bit hashes of (shingle, n-th copy).
    """
    one = sets.select(F.col("key").alias("u"), F.col("cells").alias("a"))
    two = sets.select(F.col("key").alias("v"), F.col("cells").alias("b"))
    both = pairs.select("u", "v").join(one, "u").join(two, "v").select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("c"))
    return both.select("u", "v", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("similarity"))


def _roots(found: DataFrame, similarity: float) -> DataFrame:
    return keep(components(found.where(F.col("similarity") >= similarity).select("u", "v")), "roots")


def _root(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    r = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return df.join(r, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key, class_key, class_id, class_size, kept: a row for every row of ``docs``.

    Texts of weighted Jaccard similarity of at least ``similarity`` over five-word
    shingles are linked; classes are the connected components.  Equal texts (case and
    white space aside) are collapsed first.  Of the texts that share a band

    1. each is compared with the most popular text of its bands (the popularity of a
       text is the number of texts in all of its bands: an original has more than its
       edited copies),
    2. then with every band's most popular text that is still in another component,
    3. then, where a band still holds several components, with each text there that
       is in another component, if what both share with any text there leaves room for
       the similarity (a text with more cells of its own than that has no partner) and
       their parity maps do not differ in more bits than the similarity allows,

    so every pair in a common band is compared, already in one component, or provably
    below the similarity.  Steps 1 and 2 are linear in the texts.

    class_id is the least doc_id of the class, null if it has none; ``kept`` marks its
    rows with that doc_id.  A text without words (null, empty, blank) is a class of
    its own row: class_id is its doc_id.  A text of under five words is one shingle.
    Repeated rows are one class.  An empty table gives no rows.
    """
    with scratch(docs.sparkSession) as hand_on:
        return hand_on(_classes(docs, similarity))


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    signed = keep(id_and_text(docs).mapInArrow(_sign, SCHEMA), "signatures")
    texts = signed.where("key is not null").select("key", "bands").dropDuplicates(["key"])
    entries = texts.select("key", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    entries = keep(entries.join(shared, "band"), "entries")
    popular = entries.groupBy("key").agg(F.sum("n").alias("pop"))
    members = keep(entries.join(popular, "key").select("key", "band", "pop"), "members")
    reps = members.groupBy("band").agg(F.max(F.struct("pop", "key")).alias("rep"))
    stars = keep(members.join(reps, "band").where("key <> rep.key").select(F.col("key").alias("u"), "rep").distinct(), "stars")

    sets = keep(signed.where("key is not null").select("key", "cells", "parity").join(popular.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")

    first = keep(_verified(_ordered(stars.groupBy("u").agg(F.max("rep").alias("rep")).select("u", F.col("rep.key").alias("v"))), sets), "first")
    roots = _roots(first, similarity)
    apart = _root(_root(_ordered(stars.select("u", F.col("rep.key").alias("v"))), roots, "u", "ru"), roots, "v", "rv").where("ru <> rv").select("u", "v")
    second = keep(_verified(apart.join(first, ["u", "v"], "left_anti"), sets), "second")
    found = first.unionByName(second)
    roots = _roots(found, similarity)

    rooted = _root(members.select("band", "key"), roots, "key", "r")
    several = rooted.groupBy("band").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("band")
    left = keep(rooted.join(several, "band", "left_semi"), "left")
    held = sets.join(left.select("key").distinct(), "key", "left_semi")
    # cells of no other text there: a pair has no more in common than the least of what each shares at all
    single = held.select("key", F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count("*").alias("single"))
    room = held.select("key", "parity", F.size("cells").alias("n")).join(single, "key", "left").select("key", "parity", "n", (F.col("n") - F.coalesce("single", F.lit(0))).alias("s"))
    room = keep(room.where(F.col("s") >= similarity * F.col("n") - 1e-6), "room")
    left = left.join(room, "key")
    x = left.select("band", F.col("key").alias("u"), F.col("r").alias("ru"), F.col("n").alias("nu"), F.col("s").alias("su"), F.col("parity").alias("pu"))
    y = left.select("band", F.col("key").alias("v"), F.col("r").alias("rv"), F.col("n").alias("nv"), F.col("s").alias("sv"), F.col("parity").alias("pv"))
    can = F.least("su", "sv") * (1 + similarity) >= similarity * (F.col("nu") + F.col("nv")) - 1e-6
    # c of n + m cells in common leave n + m - 2 c alone: at the similarity, at most this share of n + m
    differ = reduce(Column.__add__, [F.bit_count(F.col("pu")[i].bitwiseXOR(F.col("pv")[i])) for i in range(MAP_BITS // 64)])
    can = can & (differ * (1 + similarity) <= (F.col("nu") + F.col("nv")) * (1 - similarity) + 1e-6)
    rest = x.join(y, (x["band"] == y["band"]) & F.expr("u > v and ru <> rv") & can).select("u", "v").distinct()
    third = keep(_verified(rest.join(found.select("u", "v"), ["u", "v"], "left_anti"), sets), "third")
    roots = _roots(found.unionByName(third), similarity)

    by_key = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    by_key = _root(by_key, roots, "key", "class")
    of_class = by_key.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_key = keep(by_key.join(of_class, "class").select("key", F.col("class").alias("class_key"), "class_id", "class_size"), "classes")
    out = signed.select("doc_id", "key").join(by_key, "key", "left")
    return keep(
        out.select(
            "doc_id", "key", "class_key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        ).withColumn("kept", F.col("key").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))),
        "rows",
    )


@tidy()
def _with_key(batches):
    """Each row with the key of its text; of the rows of a batch with equal doc_id and key one stays."""
    for batch in batches:
        keys = [text_key(words_of(t.as_py())) for t in batch.column("text")]
        seen, stay = set(), []
        for row in zip(batch.column("doc_id").to_pylist(), keys):
            stay.append(row[1] is None or row not in seen)
            seen.add(row)
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "_key"])
        yield out.filter(pa.array(stay, pa.bool_()))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without further members of each class; columns stay.

    Of a class the row of least doc_id stays (of repeated such rows, one); rows
    without words all stay.  Columns may have any names.  Whole rows are shuffled
    once, by text and doc_id, so the copies of one text spread over tasks.
    """
    last = F.lit(2**63 - 1)  # null identifiers come last
    kept = classes(docs, similarity).where("kept and key is not null")
    chosen = kept.groupBy("class_key").agg(F.min("key").alias("_key"), F.coalesce(F.min("class_id"), last).alias("_first")).select("_key", "_first")
    rows = plain_names(docs)
    keyed = rows.mapInArrow(_with_key, StructType([*rows.schema.fields, StructField("_key", BinaryType())]))
    blank = keyed.where("_key is null").select(*rows.columns)
    texts = keyed.where("_key is not null").select("_key", F.coalesce(F.col("doc_id").cast("long"), last).alias("_first"), F.struct(*rows.columns).alias("_row"))
    texts = texts.join(chosen, ["_key", "_first"], "left_semi").groupBy("_key", "_first").agg(F.first("_row").alias("_row"))
    return blank.unionByName(texts.select("_row.*")).toDF(*docs.columns)
