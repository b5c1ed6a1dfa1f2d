"""Operator 3: embedding near-duplicates by a forest of random projection trees.

Equal vectors form a class. Each tree splits at the median of a random
projection; vectors near a split go to both sides. Vectors are compared within
the leaves of every tree. A pair is counted in the first leaf that both share,
which each vector knows from its list of leaves; so a leaf returns sums of
links and a few edges per vector instead of pairs. The upper splits are fitted
on a bounded sample, and every vector is routed through them; where they leave
too many vectors in a leaf, each leaf is split on by its own vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, hot_keys, join_split, partitions, runs_of, sampled
from .vectors import matrices, units

TREES = 6
#: Half width of the band around a split that goes to both sides (unit vectors).
SPILL = 0.025
#: Vectors of a leaf that splits aim at, and of a block of a leaf that cannot be split.
LEAF_ROWS = 1024
BLOCK = 1024
#: Rows of the sample, or one of SAMPLE_SHARE vectors where that is more, but at most SAMPLE_MOST.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_MOST = 20_000, 1000, 200_000
#: Sampled rows in a leaf of the upper splits at least, where vectors are very many.
LEAST = 8


def fit_tree(x: np.ndarray, rng: np.random.Generator, leaf: int) -> list:
    """Nodes of a tree: [direction, threshold, left, right] or [None, rows]."""
    nodes: list = []

    def grow(rows: np.ndarray) -> int:
        me = len(nodes)
        nodes.append([None, len(rows)])
        if len(rows) > leaf:
            for _ in range(4):
                u = rng.normal(size=x.shape[1])
                u /= np.linalg.norm(u)
                p = x[rows] @ u
                t = float(np.median(p))
                left, right = rows[p <= t + SPILL], rows[p >= t - SPILL]
                if max(len(left), len(right)) <= 0.85 * len(rows):  # else a tight group: another direction, or a leaf
                    nodes[me] = [u, t, grow(left), grow(right)]
                    break
        return me

    grow(np.arange(len(x)))
    return nodes


def route(x: np.ndarray, nodes: list) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows of x) for every leaf that is reached."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        i, rows = todo.pop()
        if not len(rows):
            continue
        if nodes[i][0] is None:
            out.append((i, rows))
            continue
        u, t, left, right = nodes[i]
        p = x[rows] @ u
        todo += [(left, rows[p <= t + SPILL]), (right, rows[p >= t - SPILL])]
    return out


def _classes(vectors: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for _, at, m in matrices(ids, b.column(1)):
                ok, unit = units(m)
                at, m = at[ok], m[ok] + 0.0
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in m), "<i8").reshape(-1, 2) if len(m) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array([r.tobytes() for r in unit], pa.binary())], ["vec_id", "k1", "k2", "v"])

    return vectors.mapInArrow(run, "vec_id long, k1 long, k2 long, v binary")


def _wide(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of one width, longer ones cut, shorter ones filled with zeros."""
    x = np.zeros((len(raw), dim))
    for i, r in enumerate(raw):
        r = np.frombuffer(r, np.float64)[:dim]
        x[i, : len(r)] = r
    return x


def _leaves(x: np.ndarray, forest: list, base: list) -> list[list]:
    own: list[list] = [[] for _ in x]
    for t, nodes in enumerate(forest):
        for leaf, rows in route(x, nodes):
            for i in rows.tolist():
                own[i].append(base[t] + leaf)
    return own


def _dealt(cid: list, mult: list, raw: list, own: list[list], blocks: list[dict]):
    """A row per vector and leaf (or pair of blocks): leaf, dim, bi, bj, block, c, mult, leaves, v."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["leaf", "dim", "bi", "bj", "block", "c", "mult", "leaves", "v"])

    out: list[list] = [[] for _ in range(9)]
    for c, m, v, leaves, sizes in zip(cid, mult, raw, own, blocks):
        leaves.sort()
        packed = np.array(leaves, np.int64).tobytes()
        for leaf in leaves:
            n = sizes.get(leaf, 1)
            mine = c % n
            for o in range(n):
                for col, val in zip(out, (leaf, len(v) // 8, min(mine, o), max(mine, o), mine, c, m, packed, v)):
                    col.append(val)
        if len(out[0]) > 4000:
            yield batch()
            out = [[] for _ in range(9)]
    if out[0]:
        yield batch()


_DEALT = "leaf long, dim int, bi int, bj int, block int, c long, mult long, leaves binary, v binary"


def _route_all(reps: DataFrame, sent) -> DataFrame:
    def run(batches):
        forest, base, blocks, dim = sent.value
        for b in batches:
            raw = b.column("v").to_pylist()
            own = _leaves(_wide(raw, dim), forest, base)
            yield from _dealt(b.column("c").to_pylist(), b.column("mult").to_pylist(), raw, own, [blocks] * len(raw))

    return reps.mapInArrow(run, _DEALT)


def split_leaf(x: np.ndarray, seed: int, leaf: int) -> list[np.ndarray]:
    """Rows of the leaves of one more tree, grown on the vectors themselves."""
    nodes = fit_tree(x, np.random.default_rng(seed), leaf)
    return [rows for _, rows in sorted(route(x, nodes), key=lambda r: r[0])]


def _route_on(reps: DataFrame, sent, parts: int, leaf_rows: int) -> DataFrame:
    """Like ``_route_all`` where the upper splits leave more vectors in a leaf than
    one should have: these meet in a task and are split on. Leaves that even a
    sample could not split stay as they are, in blocks."""

    def upper(batches):
        forest, base, blocks, dim = sent.value
        for b in batches:
            raw, cid = b.column("v").to_pylist(), b.column("c").to_pylist()
            rows = [(leaf, c, None if leaf in blocks else v, blocks.get(leaf, 0)) for c, v, leaves in zip(cid, raw, _leaves(_wide(raw, dim), forest, base)) for leaf in leaves]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int32()))], ["leaf", "c", "v", "n"])

    def lower(batches):
        dim = sent.value[3]
        for (leaf,), rows in runs_of(batches, ("leaf",)):
            cid = np.array([r[1] for r in rows], np.int64)
            for no, at in enumerate(split_leaf(_wide([r[2] for r in rows], dim), leaf, leaf_rows)):
                n = -(-len(at) // BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(np.full(len(at), leaf << 32 | no)), pa.array(np.full(len(at), n, np.int32))], ["c", "leaf", "n"])

    def deal(batches):
        for b in batches:
            own, sizes = b.column("leaf").to_pylist(), b.column("n").to_pylist()
            yield from _dealt(b.column("c").to_pylist(), b.column("mult").to_pylist(), b.column("v").to_pylist(), own, [dict(zip(a, n)) for a, n in zip(own, sizes)])

    routed = reps.select("c", "v").mapInArrow(upper, "leaf long, c long, v binary, n int")
    split = routed.where("n = 0").select("leaf", "c", "v").repartition(parts, "leaf").sortWithinPartitions("leaf", "c").mapInArrow(lower, "c long, leaf long, n int")
    all_ = split.unionAll(routed.where("n > 0").select("c", F.shiftleft("leaf", 32).alias("leaf"), "n"))
    lists = all_.groupBy("c").agg(F.collect_list(F.struct("leaf", "n")).alias("l"))  # some leaves per tree
    return reps.join(lists.hint("merge"), "c").select("c", "mult", "v", F.col("l.leaf").alias("leaf"), F.col("l.n").alias("n")).mapInArrow(deal, _DEALT)


def _earlier(leaves: list[bytes], leaf: int) -> np.ndarray:
    """Which leaves before ``leaf`` each row is in: rows by such leaves, ones and zeros."""
    size = np.array([len(v) // 8 for v in leaves])
    ids, row = np.frombuffer(b"".join(leaves), np.int64), np.repeat(np.arange(len(leaves)), size)
    before = ids < leaf
    names, col = np.unique(ids[before], return_inverse=True)
    out = np.zeros((len(leaves), len(names)), np.float32)
    out[row[before], col] = 1
    return out


def compare_leaf(leaf: int, bi: int, bj: int, block: np.ndarray, c: np.ndarray, mult: np.ndarray, leaves: list[bytes], x: np.ndarray, threshold: float):
    """Per row the links counted here, and the smallest row its links lead to."""
    n = len(c)
    before = _earlier(leaves, leaf)
    left = np.flatnonzero(block == bi)
    right = left if bi == bj else np.flatnonzero(block == bj)
    deg, label = np.zeros(n, np.int64), np.arange(n)
    ii, jj = [], []
    for at in range(0, len(left), 512):
        part = left[at : at + 512]
        link = x[part] @ x[right].T >= threshold
        if bi == bj:
            link &= part[:, None] < right[None, :]
        if link.any():
            link &= before[part] @ before[right].T == 0  # else counted in the earlier leaf
        p, q = np.nonzero(link)
        i, j = part[p], right[q]
        deg[part] += link @ mult[right]
        deg[right] += mult[part] @ link
        ii.append(i)
        jj.append(j)
    i, j = np.concatenate(ii), np.concatenate(jj)
    while len(i):  # labels settle at the smallest row of each group
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = np.minimum(label, label[label])
        if (before == label).all():
            break
    return deg, label


def _compare(rows: DataFrame, parts: int, threshold: float) -> DataFrame:
    """c, links and to: partial sums of links and an edge to the leaf's group."""
    keys = ["leaf", "dim", "bi", "bj"]

    def run(batches):
        held: list = []
        cur = None

        def out():
            cols = [sum((h[k] for h in held), []) for k in range(len(held[0]))]
            block, c, mult = (np.array(v, np.int64) for v in cols[:3])
            x = np.frombuffer(b"".join(cols[4]), np.float64).reshape(len(c), -1)
            deg, label = compare_leaf(cur[0], cur[2], cur[3], block, c, mult, cols[3], x, threshold)
            use = (deg > 0) | (label != np.arange(len(c)))
            return pa.RecordBatch.from_arrays([pa.array(c[use]), pa.array(deg[use]), pa.array(c[label[use]])], ["c", "links", "to"])

        for b in batches:
            cols = [b.column(k).to_numpy() for k in keys]
            cut = np.flatnonzero(np.any([v[1:] != v[:-1] for v in cols], axis=0)) + 1 if b.num_rows > 1 else np.zeros(0, int)
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                if e == s:
                    continue
                key = tuple(int(v[s]) for v in cols)
                if key != cur and held:
                    yield out()
                    held = []
                cur = key
                held.append([b.column(k).slice(s, e - s).to_pylist() for k in ("block", "c", "mult", "leaves", "v")])
        if held:
            yield out()

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "c long, links long, to long")


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links of ``vectors(vec_id, embedding)`` with cosine >= threshold.

    Returns vec_id, n_links, component_id and kept per row. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths; repeated rows link with each other; a
    row with a null vec_id links with nothing and is kept; an empty table gives
    no rows. A leaf of the upper splits is held in one task.
    """
    scratch, parts = Scratch(spark, "forest"), partitions(spark)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = scratch.write(_classes(base), "keyed")
    classes = scratch.write(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.any_value("v").alias("v")).withColumn("c", F.monotonically_increasing_id()), "classes")
    total, rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("mult"), F.lit(0))).first()
    sample_rows = max(sample_rows, min(SAMPLE_MOST, total // SAMPLE_SHARE))
    sample = [np.frombuffer(r[0], np.float64) for r in classes.where(sampled(F.struct("k1", "k2"), sample_rows, total)).orderBy("k1", "k2").select("v").collect()]
    dim = max([len(v) for v in sample], default=1)
    x = np.zeros((len(sample), dim))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    leaf = max(LEAST, int(leaf_rows * len(sample) / max(1, total)))
    rng = np.random.default_rng(41)
    forest = [fit_tree(x, rng, leaf) for _ in range(trees)]
    base_no = np.cumsum([0, *[len(t) for t in forest]]).tolist()
    scale = total / max(1, len(sample))
    on = leaf * scale > 2 * leaf_rows  # the sample is too small for leaves of that size
    blocks = {base_no[t] + i: n for t, nodes in enumerate(forest) for i, node in enumerate(nodes) if node[0] is None and (n := -(-int(node[1] * scale) // BLOCK)) > 1 and not (on and node[1] <= leaf)}
    sent = spark.sparkContext.broadcast((forest, base_no, blocks, dim))
    reps = classes.select("c", "mult", "v")
    routed = _route_on(reps, sent, parts, leaf_rows) if on else _route_all(reps, sent)
    found = scratch.write(_compare(routed, parts, threshold), "found")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    comp = scratch.write(components(spark, found.where("c <> to").select(F.col("c").alias("a"), F.col("to").alias("b")), scratch), "comp")
    named = classes.select("c", "k1", "k2", "rep", "mult").join(links, "c", "left").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("component", "c"))
    named = scratch.write(named.select("k1", "k2", "g", "rep", "mult", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    low = named.groupBy("g").agg(F.min("rep").alias("component_id"))
    named = scratch.write(join_split(named, low, ["g"], hot_keys(named, ["g"], total)).select("k1", "k2", "n_links", "component_id", "mult"), "result")
    linked = join_split(keyed.select("vec_id", "k1", "k2"), named.drop("mult"), ["k1", "k2"], hot_keys(named, ["k1", "k2"], rows, F.col("mult"))).select("vec_id", "n_links", "component_id")
    alone = _invalid(base).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _invalid(base: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rest = np.ones(b.num_rows, bool)
            for _, at, m in matrices(b.column(0), b.column(1)):
                rest[at[units(m)[0]]] = False
            yield b.filter(pa.array(rest)).select(["vec_id"])

    return base.mapInArrow(run, "vec_id long")


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as node, vec_id as reach from embeddings union select r.node, l.b from r join l on r.reach = l.a),
c as (select node, min(reach) as component_id from r group by 1),
n as (select a, count(*) as n from l group by 1)
select e.vec_id, coalesce(n.n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join c on c.node = e.vec_id left join n on n.a = e.vec_id
"""
