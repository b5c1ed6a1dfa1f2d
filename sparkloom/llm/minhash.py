"""Operator 10: MinHash near-duplicates with sequential Bayesian verification.

Documents with the same word sequence form a class, which goes on as one.
Banded MinHash signatures give buckets of classes. Within a bucket pairs
are compared batch by batch of the signature, and a pair is dropped once the
posterior probability that its similarity reaches the threshold falls under
the chosen miss probability. Survivors are verified on their full shingle
sets. To stay linear in a bucket of near copies this is done in two passes:
first every member against one centre of its bucket, then the pairs whose two
documents are still in different components: those outside a bucket's largest
component meet all of the bucket, its members do not meet each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, hot_keys, join_split, partitions, slices

#: Values of a signature, and how many are compared at a time.
K, BATCH = 144, 24
#: A pair is dropped when P(similarity >= threshold | matches so far) is below this.
MISS = 1e-6
#: The bands miss a pair exactly at the threshold at most this often.
BAND_MISS = 2e-5
#: Rows of a block; larger buckets are dealt out as pairs of blocks.
BLOCK = 384
#: Word sequences that a task remembers, to send the signature of each once; emptied when full.
SEEN = 200_000
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_POS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return (text or "").encode().lower().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: list[bytes], table: dict, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (the whole sequence if shorter)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter((table[w] for w in words), np.uint64, n)
    width = min(size, n)
    acc = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        acc += h[k : n - width + 1 + k] * _POS[k]
    return np.unique(_mix(acc + np.uint64(width)))


def exact_sets(text: str | None, size: int = 5) -> frozenset:
    """The shingle set itself, as tuples of words."""
    w = words_of(text)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*[w[k:] for k in range(size)]))


def signature(hashes: np.ndarray) -> np.ndarray:
    """K minima of the hashes under K multiply-add permutations, 32 bits each."""
    out = np.full(K, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 256):  # blocks that stay in cache
        part = hashes[None, at : at + 256] * _MUL[:, None]
        part += _ADD[:, None]
        np.minimum(out, part.min(1) >> np.uint64(32), out=out)
    return out.astype(np.uint32)


def need(threshold: float, miss: float = MISS) -> list[int]:
    """Least matches after each batch for which a pair goes on: with a flat
    prior the posterior P(s >= t | m of k) is P(Binomial(k + 1, t) <= m)."""
    out = []
    for k in range(BATCH, K + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def _surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = np.zeros(len(i), np.int32)
    for b, m in enumerate(least):
        got = got + (sig[i, b * BATCH : (b + 1) * BATCH] == sig[j, b * BATCH : (b + 1) * BATCH]).sum(1, dtype=np.int32)
        ok = got >= m
        i, j, got = i[ok], j[ok], got[ok]
        if not len(i):
            break
    return i, j, got


def _groups(batches, keys: tuple[str, ...]):
    """Row groups of equal keys from a sorted stream, as concatenated tables."""
    held, cur = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            cut[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        starts = [*np.flatnonzero(cut).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s] for c in cols)
            if key != cur:
                if held:
                    yield held
                held, cur = [], key
            held.append(b.slice(s, e - s))
    if held:
        yield held


def _arrays(held) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    out = {}
    for name in t.column_names:
        c = t.column(name)
        if name == "sig":
            out[name] = np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, K)
        elif name == "bands":
            out[name] = c.combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        else:
            out[name] = c.to_pylist() if name == "z" else c.to_numpy()
    return out


def band_rows(threshold: float) -> int:
    """Rows of a band: as many as keep the share of missed pairs at the threshold within ``BAND_MISS``."""
    for rows in range(K, 0, -1):
        if (1 - threshold**rows) ** (K // rows) <= BAND_MISS:
            return rows
    raise ValueError(f"a signature of {K} values does not find pairs of similarity {threshold:g} often enough")


def _sign(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id, k1 and k2 (a 128-bit hash of the words), n, and for the first row of
    a word sequence in its task the signature, the keys of its bands and z (the words, zstd)."""

    def run(batches):
        table, seen, zip_ = _Words(), set(), zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches):
            k1, k2, n, sig, keys, z = [], [], [], [], [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                w = words_of(text)
                joined = b" ".join(w)
                d = xxhash.xxh3_128_digest(joined) if w else b"\0" * 16
                a, b = np.frombuffer(d, "<i8").tolist()
                h = shingle_hashes(w, table)
                new = len(h) > 0 and doc is not None and d not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    s = signature(h)
                    more = ((s & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), [xxhash.xxh3_64_intdigest(s[i * rows : (i + 1) * rows].tobytes(), seed=i) - (1 << 63) for i in range(K // rows)], zip_(joined))
                for col, x in zip((k1, k2, n, sig, keys, z), (a, b, len(h), *(more if new else (None, None, None)))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(z, pa.binary())], ["doc_id", "k1", "k2", "n", "sig", "bands", "z"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, sig binary, bands array<long>, z binary")


def _centre_pairs(g: dict, least: list[int], ratio: float):
    """Members of a block against its centre, the row that agrees most with the
    block's most frequent signature values."""
    sig, doc, n = g["sig"], g["c"], g["n"]
    size, c = len(doc), 0
    if size > 2:
        srt = np.sort(sig[:, ::4], axis=0)  # every fourth value suffices to find a centre
        votes = np.zeros(size, np.int32)
        for col in range(srt.shape[1]):
            cut = np.flatnonzero(np.concatenate([[True], srt[1:, col] != srt[:-1, col]]))
            mode = srt[cut[np.diff(np.append(cut, size)).argmax()], col]
            votes += sig[:, 4 * col] == mode
        c = int(np.lexsort((doc, -votes))[0])
    j = np.delete(np.arange(size), c)
    j = j[np.minimum(n[c], n[j]) >= ratio * np.maximum(n[c], n[j])]
    i, j, _ = _surviving(sig, np.full(len(j), c), j, least)
    return np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])


def _cross_links(g: dict, least: list[int], ratio: float, num: int, den: int):
    """Links between different components of a block or pair of blocks.

    A pair is looked at in the first bucket that it shares. Survivors of the
    pruning are verified on their words, the likeliest first, unless links
    found here already join their components: a link less changes nothing.
    """
    sig, doc, n, own, z, keys = g["sig"], g["c"], g["n"], g["comp"], g["z"], g["bands"]
    blk, bi, bj, band = g["block"], g["bi"][0], g["bj"][0], int(g["band"][0])
    left = np.flatnonzero(blk == bi)
    right = left if bi == bj else np.flatnonzero(blk == bj)
    found = []
    for at in range(0, len(left), 128):
        part = left[at : at + 128]
        ok = own[part][:, None] != own[right][None, :]
        ok &= np.minimum(n[part][:, None], n[right][None, :]) >= ratio * np.maximum(n[part][:, None], n[right][None, :])
        if bi == bj:
            ok &= part[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        i, j, got = _surviving(sig, part[x], right[y], least)
        if band and len(i):
            new = ~(keys[i, :band] == keys[j, :band]).any(1)
            i, j, got = i[new], j[new], got[new]
        if len(i):
            found.append((i, j, got))
    if not found:
        return [], []
    i, j, got = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-got, kind="stable")
    unzip, ids = zstandard.ZstdDecompressor().decompress, {}
    sets: dict[int, set] = {}
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (p := root.get(c, c)) != c:
            root[c] = c = root.get(p, p)
        return c

    def set_of(r: int) -> set:
        if r not in sets:
            sets[r] = {ids.setdefault(s, len(ids)) for s in exact_sets(unzip(z[r]).decode())}
        return sets[r]

    a, b = [], []
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        cx, cy = find(int(own[x])), find(int(own[y]))
        if cx == cy:
            continue
        sx, sy = set_of(x), set_of(y)
        both = len(sx & sy)
        if both and den * both >= num * (len(sx) + len(sy) - both):
            root[cx] = cy
            a.append(int(doc[x]))
            b.append(int(doc[y]))
    return a, b


def _in_buckets(rows: DataFrame, work) -> DataFrame:
    """Pairs (a, b) that ``work`` finds in each bucket or pair of blocks."""

    def run(batches):
        out_a, out_b = [], []
        for held in _groups(batches, ("key", "bi", "bj", "band")):
            if sum(b.num_rows for b in held) < 2:
                continue
            a, b = work(_arrays(held))
            out_a += [int(x) for x in a]
            out_b += [int(x) for x in b]
            if len(out_a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose full shingle sets reach num/den, on the words themselves."""
    total = pairs.count()
    rows = pairs
    for end in ("b", "a"):  # a centre may be in very many pairs
        rows = join_split(rows, texts.select(F.col("c").alias(end), F.col("z").alias(f"z{end}")), [end], hot_keys(pairs, [end], total))
    rows = rows.select("a", "b", "za", "zb")

    def run(batches):
        unzip = zstandard.ZstdDecompressor().decompress
        last, kept = None, frozenset()
        for part in slices(batches, 128):
            ok = []
            for za, zb in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                if za != last:
                    last, kept = za, exact_sets(unzip(za).decode())
                other = exact_sets(unzip(zb).decode())
                both = len(kept & other)
                ok.append(both > 0 and den * both >= num * (len(kept) + len(other) - both))
            yield part.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _of_one_id(linkable: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between the classes of a doc_id that has several texts, if there is any."""
    ends = [f(k).alias(f"{n}{k}") for k in ("k1", "k2") for n, f in (("lo", F.min), ("hi", F.max))]
    many = scratch.write(linkable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), *ends).where("lok1 <> hik1 or lok2 <> hik2").select("doc_id", "rows"), "ids")
    total = many.agg(F.sum("rows")).first()[0]
    if not total:
        return None
    hot = hot_keys(many, ["doc_id"], total, F.col("rows"))
    rows = join_split(linkable.select("doc_id", "k1", "k2"), many.select("doc_id"), ["doc_id"], hot).distinct()
    rows = scratch.write(rows.join(classes.select("k1", "k2", "c").hint("merge"), ["k1", "k2"]).select("doc_id", "c"), "classes-of-ids")
    first = rows.groupBy("doc_id").agg(F.min("c").alias("b"))
    return scratch.write(join_split(rows, first, ["doc_id"], hot).select(F.col("c").alias("a"), "b"), "same-id")


def near_duplicates(spark: SparkSession, docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``.

    Links documents whose sets of 5-word shingles have Jaccard similarity of at
    least num/den. Returns doc_id, n_shingles, component_id and kept per row.
    Null, empty and blank texts have an empty set and link with nothing; a text
    of fewer words is one shingle; repeated rows give repeated rows; rows of
    one doc_id with different texts share that id's component; rows with a
    null doc_id link with nothing and are kept; an empty table gives no rows.
    ValueError for a threshold too low for the signature (under about 0.08).
    """
    per_band = band_rows(num / den)
    scratch = Scratch(spark, "minhash")
    least, ratio, parts, bands = need(num / den), num / den, partitions(spark), K // per_band
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.write(_sign(base, per_band), "signed")
    linkable = signed.where("n > 0 and doc_id is not null")
    # a class is a word sequence; its number is fixed when the table is written
    classes = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("n"), F.any_value("sig", True).alias("sig"), F.any_value("bands", True).alias("bands"))
    classes = scratch.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    rows = classes.select("c", F.posexplode("bands").alias("band", "key"))
    full = scratch.write(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    hot = hot_keys(full, ["band", "key"], bands * classes.count(), F.col("size"))
    inside = scratch.write(join_split(rows, full, ["band", "key"], hot), "inside")
    wanted = inside.select("c").distinct().join(classes.select("c", "k1", "k2").hint("merge"), "c")
    texts = signed.where("z is not null").select("k1", "k2", "z").join(wanted.hint("merge"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("c").alias("c"), F.any_value("z").alias("z"))
    texts = scratch.write(texts.select("c", "z"), "texts")

    def dealt(part: DataFrame, own: Column, rest: Column, *more: str) -> DataFrame:
        """Rows by pairs of blocks of their bucket. The first ``own`` rows of a
        bucket meet all of it, the other ``rest`` rows meet those only."""
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        first, more_ = blocks(own), blocks(rest)
        at = lambda n: F.pmod(F.xxhash64("c", "band"), F.greatest(n, F.lit(1))).cast("int")  # noqa: E731  other blocks in every band
        part = part.withColumn("block", F.when(F.col("meets_all"), at(first)).otherwise(first + at(more_)))
        if more:
            part = part.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("meets_all"), first + more_).otherwise(first) - 1)))
            part = part.withColumn("bi", F.least("block", "o")).withColumn("bj", F.greatest("block", "o"))
        else:
            part = part.withColumn("bi", F.col("block")).withColumn("bj", F.col("block"))
        part = part.select("band", "key", "bi", "bj", "block", "c", "n", "sig", *more)
        return part.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "band")

    sigs = classes.select("c", "n", "sig")
    first = scratch.write(_in_buckets(dealt(inside.join(sigs.hint("merge"), "c").withColumn("meets_all", F.lit(True)), F.col("size"), F.lit(0)), lambda g: _centre_pairs(g, least, ratio)), "first")
    links = scratch.write(_verify(first, texts, num, den), "links1")
    same = _of_one_id(linkable, classes, scratch)
    links = links if same is None else links.unionAll(same)
    comp = scratch.write(components(spark, links, scratch), "comp1")
    now = inside.join(comp.withColumnRenamed("node", "c").hint("merge"), "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")
    now = scratch.write(now, "now")
    per = now.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = per.groupBy("band", "key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    open_ = scratch.write(open_.select("band", "key", F.col("main.comp").alias("main"), F.col("main.n").alias("rest"), (F.col("size") - F.col("main.n")).alias("own")), "open")
    both = classes.select("c", "n", "sig", "bands").join(texts.hint("merge"), "c")
    rest = join_split(now.drop("size"), open_, ["band", "key"], hot).withColumn("meets_all", F.col("comp") != F.col("main")).join(both.hint("merge"), "c")
    more = scratch.write(_in_buckets(dealt(rest, F.col("own"), F.col("rest"), "comp", "bands", "z"), lambda g: _cross_links(g, least, ratio, num, den)), "links2")
    comp = scratch.write(components(spark, links.unionAll(more), scratch), "comp2")
    named = classes.select("c", "k1", "k2", "rep", "rows").join(comp.withColumnRenamed("node", "c").hint("merge"), "c", "left").withColumn("g", F.coalesce("component", "c"))
    named = scratch.write(named.select("k1", "k2", "g", "rep", "rows"), "named")
    low = named.groupBy("g").agg(F.min("rep").alias("component_id"))
    total = signed.count()
    named = scratch.write(join_split(named, low, ["g"], hot_keys(named, ["g"], total)).select("k1", "k2", "component_id", "rows"), "components")
    done = join_split(linkable.select("doc_id", "k1", "k2", "n"), named.drop("rows"), ["k1", "k2"], hot_keys(named, ["k1", "k2"], total, F.col("rows"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as reach from w union select r.node, e.b from r join e on r.reach = e.a),
c as (select node, min(reach) as component_id from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from w left join n on n.doc_id = w.doc_id join c on c.node = w.doc_id
"""
