"""Operator 1: exact top-k inner products by KD-trees per shard.

Vectors are dealt into shards of bounded size. Each shard is a KD-tree with
median splits and tight boxes, built once and kept in a written table. Queries
come in blocks of bounded size. A query walks each tree best-first by the
largest inner product its box allows, and stops at a box that cannot reach the
kth score found so far. That score comes from a pilot shard first, which every
block meets, and is carried from shard to shard within a task: a task holds a
few shards, and the blocks of queries stream past them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .vectors import matrices

SHARD_ROWS = 8192
LEAF_ROWS = 256
#: Queries in a block, and shards that a task holds at most.
QUERY_ROWS = 2048
HELD = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_FOUND = "block long, q int, query_id long, vec_id long, score long"
_TREE = ("dim", "ids", "points", "nodes", "low", "high")


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), kept as doubles (whole numbers)."""
    return np.floor(x * 256.0)


def build(points: np.ndarray, leaf: int = LEAF_ROWS):
    """order, and per node: start, end, left child, right child, lower and upper corner."""
    order = np.arange(len(points))
    nodes: list[list[int]] = []
    low, high = [], []

    def grow(s: int, e: int) -> int:
        me = len(nodes)
        part = points[order[s:e]]
        lo, hi = part.min(0), part.max(0)
        nodes.append([s, e, -1, -1])
        low.append(lo)
        high.append(hi)
        axis = int((hi - lo).argmax())
        if e - s > leaf and hi[axis] > lo[axis]:
            mid = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(part[:, axis], mid)]
            nodes[me][2] = grow(s, s + mid)
            nodes[me][3] = grow(s + mid, e)
        return me

    grow(0, len(points))
    return order, np.array(nodes, np.int64), np.array(low), np.array(high)


def dot(points: np.ndarray, q: np.ndarray) -> list[int]:
    """Integer inner products, exact; beyond 64 bits they saturate."""
    if np.abs(points).max(initial=0) * np.abs(q).max(initial=0) * len(q) < _EXACT:
        return (points @ q).astype(np.int64).tolist()
    big = [int(x) for x in q.tolist()]
    return [max(-_LONG - 1, min(_LONG, sum(int(a) * b for a, b in zip(row, big)))) for row in points.tolist()]


def search(tree, q: np.ndarray, own: int, best: list, k: int, floor: int) -> None:
    """Best-first walk; ``best`` is a heap of (score, -id) and is updated in place."""
    ids, points, nodes, low, high = tree
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1 + 1e-9  # bounds of very large vectors may be rounded

    def bound(i: int) -> float:
        b = float(high[i] @ up + low[i] @ down)
        return b if abs(b) < _EXACT else b + abs(b) * (slack - 1)

    heap = [(-bound(0), 0)]
    while heap:
        b, i = heapq.heappop(heap)
        if -b < (best[0][0] if len(best) == k else floor):
            return
        s, e, left, right = nodes[i].tolist()
        if left >= 0:
            heapq.heappush(heap, (-bound(left), left))
            heapq.heappush(heap, (-bound(right), right))
            continue
        score = dot(points[s:e], q)
        for sc, v in zip(score, ids[s:e].tolist()):
            if v == own or sc < floor:
                continue
            if len(best) < k:
                heapq.heappush(best, (sc, -v))
            elif (sc, -v) > best[0]:
                heapq.heapreplace(best, (sc, -v))


def _pack(vectors: DataFrame, rows: int, tree: bool) -> DataFrame:
    """Rows of about ``rows`` vectors of one dimension: dim, ids, points (and nodes, low, high)."""

    def run(batches):
        held: dict[int, list] = {}

        def out(d):
            ids = np.concatenate([x[0] for x in held[d]])
            points = np.concatenate([x[1] for x in held.pop(d)])
            cut = np.linspace(0, len(ids), max(1, round(len(ids) / rows)) + 1).astype(int).tolist()
            for s, e in zip(cut, cut[1:]):
                i, p = ids[s:e], points[s:e]
                more = [b"", b"", b""]
                if tree:
                    order, nodes, low, high = build(p)
                    i, p = i[order], p[order]
                    more = [nodes.tobytes(), low.tobytes(), high.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32())] + [pa.array([x], pa.binary()) for x in (i.tobytes(), p.tobytes(), *more)], ["dim", "ids", "points", "nodes", "low", "high"])

        for b in batches:
            ids = b.column(0)
            for d, at, m in matrices(ids, b.column(1)):
                held.setdefault(d, []).append((np.asarray(ids.take(pa.array(at))), scaled(m)))
                if sum(len(x[0]) for x in held[d]) >= rows:
                    yield from out(d)
        for d in list(held):
            yield from out(d)

    return vectors.mapInArrow(run, "dim int, ids binary, points binary, nodes binary, low binary, high binary")


def _load(d, ids, points, nodes=b"", low=b"", high=b""):
    f = lambda x: np.frombuffer(x, np.float64).reshape(-1, d)
    return np.frombuffer(ids, np.int64), f(points), np.frombuffer(nodes, np.int64).reshape(-1, 4), f(low), f(high)


def top_k(spark: SparkSession, candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact top-k of ``candidates(vec_id, embedding)`` for each row of ``queries``.

    Components are turned into floor(256 * x); the score is the inner product.
    Rows of the query's own vec_id are not its candidates. Ties go to the
    smaller vec_id. Null ids, and vectors that are null, empty or hold null or
    non-finite components, take no part; only vectors of one length are
    compared; repeated query rows give repeated results, repeated candidates
    count each; an empty table gives no rows. Scores beyond 64 bits saturate.
    Returns query_id, rank, vec_id, score.
    """
    scratch = Scratch(spark, "kdtree")
    slim = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    deal = lambda df, rows: slim(df).repartition(max(1, -(-df.count() // rows)))
    shards = scratch.write(_pack(deal(candidates, SHARD_ROWS), SHARD_ROWS, True).withColumn("no", F.monotonically_increasing_id()), "shards")
    blocks = scratch.write(_pack(deal(queries, QUERY_ROWS), QUERY_ROWS, False).select("dim", "ids", "points", F.monotonically_increasing_id().alias("no")), "queries")
    pilots = [r[1] for r in shards.groupBy("dim").agg(F.min("no"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").select("dim", "min(no)").limit(HELD).collect()]  # of the most frequent lengths
    sent = spark.sparkContext.broadcast([tuple(r) for r in shards.where(F.col("no").isin(pilots)).select(*_TREE).collect()] if pilots else [])
    blocks = scratch.write(blocks.repartition(partitions(spark), "no").mapInArrow(_pilot(sent, k), "dim int, ids binary, points binary, no long, floor binary"), "floors")
    count = shards.count()
    groups = max(1, -(-count // HELD), min(count, partitions(spark)))
    none = F.lit(None).cast("binary")
    trees = shards.select(F.pmod(F.shiftright("no", 33) + F.col("no").bitwiseAND((1 << 33) - 1), F.lit(groups)).cast("int").alias("part"), F.lit(0).alias("kind"), "no", *_TREE, none.alias("floor"))
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(1).alias("kind"), "no", "dim", "ids", "points", none.alias("nodes"), none.alias("low"), none.alias("high"), "floor")
    found = trees.unionAll(asked).repartitionById(groups, F.col("part")).sortWithinPartitions("kind", "no").mapInArrow(_searcher(k), _FOUND)
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _walk(trees: list, d: int, ids: bytes, points: bytes, k: int, floor: np.ndarray | None) -> Iterator[tuple[int, int, list]]:
    """(number, id, heap of the best) of each query of a block, over all trees of its length."""
    mine = [t for t in trees if t[1].shape[1] == d]
    points = np.frombuffer(points, np.float64).reshape(-1, d)
    for i, own in enumerate(np.frombuffer(ids, np.int64).tolist()):
        best: list = []
        for tree in mine:
            search(tree, points[i], own, best, k, -_LONG - 1 if floor is None else int(floor[i]))
        yield i, own, best


def _pilot(sent, k: int):
    """Adds to each block of queries the kth score that a pilot shard gives each of them."""

    def run(batches):
        trees = [_load(*r) for r in sent.value]
        for b in batches:
            for d, ids, points, no in zip(*[b.column(c).to_pylist() for c in ("dim", "ids", "points", "no")]):
                floor = np.array([best[0][0] if len(best) == k else -_LONG - 1 for _, _, best in _walk(trees, d, ids, points, k, None)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids], pa.binary()), pa.array([points], pa.binary()), pa.array([no], pa.int64()), pa.array([floor.tobytes()], pa.binary())], ["dim", "ids", "points", "no", "floor"])

    return run


def _searcher(k: int):
    def run(batches):
        trees: list = []
        for b in batches:
            for kind, no, floor, *tree in zip(*[b.column(c).to_pylist() for c in ("kind", "no", "floor", *_TREE)]):
                if kind == 0:  # the task's shards come before the queries
                    trees.append(_load(*tree))
                    continue
                d, ids, points = tree[:3]
                rows = [(no, i, own, -v, s) for i, own, best in _walk(trees, d, ids, points, k, np.frombuffer(floor, np.int64)) for s, v in best]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32())] + [pa.array(x, pa.int64()) for x in c[2:]], ["block", "q", "query_id", "vec_id", "score"])

    return run


def op1_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(spark, vectors, vectors.where("vec_id % 50 = 0"))


OP1_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
