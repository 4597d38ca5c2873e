"""Approximate nearest neighbours by inner product: robust-pruned directed graphs for each shard."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import keep, scratch, tidy

#: Edges of a node, beam of construction and of search, and how much longer a kept edge may be.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 24, 40, 192, 1.2
#: Nearest candidates among which the edges of a node are chosen.
POOL = 64
#: Rounds in which the points of a shard are added, at most.
ROUNDS = 8
NEAREST = 20
#: Norms in one graph differ by this factor at most: edges between vectors then suit queries, which have norm 1.
RANGE = 1.15
#: Shards, as long as none has more vectors than this, on average.
SHARDS, SHARD_ROWS = 8, 16_384
_BATCH = 256


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search for many queries at once: (ids, squared distances) of each beam, nearest
    first, and the ids that were expanded (-1: none)."""
    b, rows = len(q), np.arange(len(q))
    ids = np.full((b, beam), -1, np.int64)
    far = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, ((q - x[start]) ** 2).sum(1), False
    seen = np.zeros((b, len(x) + 1), bool)  # the last column takes the padding
    seen[:, start] = seen[:, -1] = True
    expanded = []
    while True:
        waiting = np.where(done, np.inf, far)
        pick = waiting.argmin(1)
        live = np.isfinite(waiting[rows, pick])
        if not live.any():
            break
        node = np.where(live, ids[rows, pick], -1)
        done[rows, pick] = True
        expanded.append(node)
        near = np.where(live[:, None], graph[node], -1)
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        d = ((x[near] - q[:, None, :]) ** 2).sum(2)
        d[~fresh] = np.inf
        ids, far = np.concatenate([ids, near], 1), np.concatenate([far, d], 1)
        done = np.concatenate([done, ~fresh], 1)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, far, done = (np.take_along_axis(a, order, 1) for a in (ids, far, done))
    return ids, far, np.stack(expanded, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """Diverse neighbours of each point: the nearest candidate stays, and others go that are
    nearer to it, even times ``relax``, than to the point; then the next."""
    order = np.argsort(candidates, axis=1)
    candidates = np.take_along_axis(candidates, order, 1)
    twice = np.zeros(candidates.shape, bool)
    twice[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    far = ((x[candidates] - x[points][:, None, :]) ** 2).sum(2)
    far[(candidates < 0) | (candidates == points[:, None]) | twice] = np.inf
    if far.shape[1] > POOL:
        some = np.argpartition(far, POOL - 1, axis=1)[:, :POOL]
        candidates, far = np.take_along_axis(candidates, some, 1), np.take_along_axis(far, some, 1)
    near = x[candidates]
    norm = (near**2).sum(2)
    pair = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * near @ near.transpose(0, 2, 1), 0)
    out, rows = np.full((len(points), degree), -1, np.int64), np.arange(len(points))
    alive = far.copy()
    for k in range(degree):
        pick = alive.argmin(1)
        ok = np.isfinite(alive[rows, pick])
        if not ok.any():
            break
        out[ok, k] = candidates[rows, pick][ok]
        alive[(relax * relax * pair[rows, pick] <= far) & ok[:, None]] = np.inf
        alive[rows, pick] = np.inf
    return out


def build(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, int]:
    """The graph of one shard (rows of neighbour ids, -1 for none) and its entry point."""
    n, rng = len(x), np.random.default_rng(seed)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, DEGREE), -1, np.int64)
    if n > 1:
        graph[:, : min(DEGREE, n - 1)] = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(DEGREE, n - 1)))) % n
    for relax in (1.0, RELAX):
        # points are added in a fixed number of rounds: each node's back edges of a round are pruned together, so
        # the work stays in proportion to the points
        for p in np.array_split(rng.permutation(n), min(ROUNDS, -(-n // _BATCH))):
            chosen = []
            for part in np.array_split(p, -(-len(p) // _BATCH)):
                ids, _, expanded = beam_search(x, graph, start, x[part], BUILD_BEAM)
                chosen.append(robust_prune(x, part, np.concatenate([ids, expanded, graph[part]], 1), relax, DEGREE))
            graph[p] = np.concatenate(chosen)
            source, target = np.repeat(p, DEGREE), graph[p].reshape(-1)
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            nth = np.arange(len(target)) - np.searchsorted(target, target)
            for lo in range(0, int(nth.max()) + 1 if len(nth) else 0, DEGREE):  # a bounded number of back edges at a time
                now = (nth >= lo) & (nth < lo + DEGREE)
                nodes, row = np.unique(target[now], return_inverse=True)
                more = np.full((len(nodes), DEGREE), -1, np.int64)
                more[row, nth[now] - lo] = source[now]
                for part in np.array_split(np.arange(len(nodes)), -(-len(nodes) // (4 * _BATCH))):
                    graph[nodes[part]] = robust_prune(x, nodes[part], np.concatenate([graph[nodes[part]], more[part]], 1), relax, DEGREE)
    return graph, start


def _flat(x: np.ndarray) -> np.ndarray:
    """Scaled to norms of at most 1, and one more component, so that nearest by distance is largest by
    inner product.  Norms are taken in double precision: squares of any finite float fit."""
    wide = x.astype(np.float64)
    norm = np.sqrt((wide**2).sum(1))
    most = norm.max()
    return np.concatenate([wide / most, np.sqrt(np.maximum(1 - (norm / most) ** 2, 0))[:, None]], 1).astype(np.float32)


def _directions(q: np.ndarray) -> np.ndarray:
    """Queries of norm 1: their length does not change what is nearest."""
    wide = q.astype(np.float64)
    return np.concatenate([wide / np.sqrt((wide**2).sum(1))[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


class Shard:
    """Vectors from the longest to the shortest, and a graph for each range of norms.

    Inner products with a query of norm 1 are at most the norm, so the ranges are searched from
    the longest on, and a query is done when its ``nearest`` best are above all norms left.
    """

    def __init__(self, x: np.ndarray, graph: np.ndarray, cuts: list[int], starts: list[int]):
        self.x, self.graph, self.cuts, self.starts = x, graph, cuts, starts
        self.norms = _norms(x)
        self.flat = [_flat(x[a:b]) for a, b in zip(cuts, cuts[1:])]

    @classmethod
    def of(cls, x: np.ndarray) -> "Shard":
        """``x`` has descending norms."""
        norms, cuts = _norms(x), [0]
        while cuts[-1] < len(x):
            cuts.append(int(np.searchsorted(-norms, -norms[cuts[-1]] / RANGE, side="right")))
        built = [build(_flat(x[a:b])) for a, b in zip(cuts, cuts[1:])]
        return cls(x, np.concatenate([g for g, _ in built]), cuts, [s for _, s in built])

    def search(self, q: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (-1: none) and double-precision products of those found for each query."""
        directions, lengths = _directions(q), _norms(q)
        rows, products = np.full((len(q), nearest), -1, np.int64), np.full((len(q), nearest), -np.inf)
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            live = np.flatnonzero(products[:, -1] <= lengths * self.norms[a] * (1 + 1e-9))
            for part in np.array_split(live, -(-len(live) // _BATCH)) if len(live) else ():
                ids, _, _ = beam_search(self.flat[k], self.graph[a:b], self.starts[k], directions[part], min(SEARCH_BEAM, b - a))
                found = np.where(ids >= 0, ids + a, -1)
                product = (self.x[found].astype(np.float64) * q[part][:, None, :].astype(np.float64)).sum(2)
                product[ids < 0] = -np.inf
                both, all_rows = np.concatenate([products[part], product], 1), np.concatenate([rows[part], found], 1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :nearest]
                products[part], rows[part] = np.take_along_axis(both, order, 1), np.take_along_axis(all_rows, order, 1)
        return rows, products


def _index(key, table):
    vectors = table.column("embedding").combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    order = np.lexsort((*x.T[:4], -_norms(x)))  # the same graphs whatever order the rows come in
    table, x = table.take(pa.array(order)), x[order]
    shard = Shard.of(x)
    members = table.column("ids").to_pylist()
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([x.shape[1]], pa.int32()), "cuts": pa.array([shard.cuts], pa.list_(pa.int64())), "starts": pa.array([shard.starts], pa.list_(pa.int64())),
            "vectors": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), "graph": pa.array([shard.graph.astype(np.int32).tobytes()], pa.binary()), "members": pa.array([members], pa.list_(pa.list_(pa.int64()))),
        }
    )


INDEX = "shard long, dim int, cuts array<long>, starts array<long>, vectors binary, graph binary, members array<array<long>>"
FOUND = "query_id long, vec_id long, score double"


@tidy()
def _search(batches, nearest: int):
    """Rows in order of shard: its index, then the queries, which stream by it."""
    held = None
    for batch in batches:
        shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero(np.diff(shard) | np.diff(kind)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
            part = batch.slice(lo, hi - lo)
            if lo == hi:
                continue
            if kind[lo] == 0:
                row = {c: part.column(c)[0].as_py() for c in ("dim", "cuts", "starts", "vectors", "graph", "members")}
                x = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
                held = Shard(x, np.frombuffer(row["graph"], np.int32).reshape(len(x), -1).astype(np.int64), row["cuts"], row["starts"]), row["members"]
            else:
                q = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                yield from _found(*held, part.column("query_id").to_pylist(), q, nearest)


def _found(shard: Shard, members: list, q_ids: list[int], q: np.ndarray, nearest: int):
    for lo in range(0, len(q), _BATCH):
        ids, score = shard.search(q[lo : lo + _BATCH], nearest + 1)  # one may be the query itself
        out = []
        for own, node, s in zip(q_ids[lo : lo + _BATCH], ids.tolist(), score.tolist()):
            found = sorted((-v, m) for i, v in zip(node, s) if i >= 0 for m in members[i] if m != own)
            out += [(own, m, -v) for v, m in found[:nearest]]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of vectors that are not null, not zero, of finite components.

    A vec_id counts once: of rows that give it different vectors, the least vector is taken.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)
    )
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def build_index(vectors: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """A graph for each shard of the distinct vectors, kept in the shared folder.

    Of equal vectors the ``nearest + 1`` least identifiers are held (no answer needs
    more), cut before the shuffle by Spark's partial group limit.  Vectors of unlike
    length go to shards of their own.
    """
    with scratch(vectors.sparkSession) as hand_on:
        return hand_on(_build_index(vectors, nearest))


def _build_index(vectors: DataFrame, nearest: int) -> DataFrame:
    first = Window.partitionBy("embedding").orderBy("vec_id")
    some = usable(vectors).withColumn("r", F.row_number().over(first)).where(F.col("r") <= nearest + 1)
    distinct = keep(some.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    shards = max(SHARDS, -(-distinct.count() // SHARD_ROWS))
    placed = distinct.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)) + F.size("embedding") * F.lit(1_000_000))
    return keep(placed.groupBy("shard").applyInArrow(_index, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``nearest`` largest inner products found.

    Each query is a row for every shard of its length; a task holds one shard's index
    while its queries stream by.  Scores are double-precision products of the original
    vectors; ties go to the lesser vec_id; a query is not its own neighbour.
    """
    shards = [(r["shard"], r["dim"]) for r in index.select("shard", "dim").collect()]  # one for SHARD_ROWS vectors
    if not shards:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of_dim = F.filter(F.array(*(F.struct(F.lit(s).cast("long").alias("shard"), F.lit(d).alias("dim")) for s, d in sorted(shards))), lambda s: s["dim"] == F.size("embedding"))
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "embedding", F.inline(of_dim)).select("shard", F.lit(1).alias("kind"), "query_id", "embedding")
    rows = index.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    task = F.element_at(F.create_map(*(F.lit(v) for k, (s, _) in enumerate(sorted(shards)) for v in (s, k))), F.col("shard"))  # a shard each
    out = rows.repartitionById(len(shards), task).sortWithinPartitions("shard", "kind", "query_id").mapInArrow(partial(_search, nearest=nearest), FOUND)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 20, nearest: int = NEAREST) -> DataFrame:
    """``search`` with the vectors whose vec_id is divisible by ``every`` as queries.

    Null, zero, null-holding and non-finite vectors take no part; repeated rows count
    once; an empty table gives no rows; further columns are ignored.
    """
    return search(build_index(vectors, nearest), vectors.where(F.col("vec_id") % every == 0), nearest)
