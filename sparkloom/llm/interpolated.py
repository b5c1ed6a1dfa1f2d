"""Operator 7: language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on
the frequency of the context. Counts come from all training texts: each chunk
of texts offers its distinct n-grams with their counts, the counts are summed
by n-gram, and every chunk gets back what the other chunks add to its own.
Weights are learned by expectation-maximisation on held-out counts, made by
deleting each training document from the counts it is predicted with; for that
its tokens are summed up in a histogram of a fixed number of cells.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunk_bytes, expand, partitions, runs_of, slices, squeeze

#: Bytes of text in a chunk; more where there are very many partitions.
CHUNK, MOST = 5 << 20, 40 << 20
ROUNDS = 60
_END = np.uint64(0x5851F42D4C957F2D)
#: Context-frequency classes: 0 for unseen, else 1 + floor(log2(count)), at most this.
CLASSES = 40
#: Cells of a log ratio: quarters of a power of two from 2^-16 to 2^48, and one for zero.
CELLS = 258


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, seed=5)
        if len(self) < 200_000:
            self[word] = h
        return h


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def learns(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def _pack(docs: DataFrame, limit: int) -> DataFrame:
    """Rows of about ``limit`` bytes: chunk, size, ids (a list), lens (int64) and z (texts, zstd)."""

    def run(batches):
        from pyspark import TaskContext

        zip_ = zstandard.ZstdCompressor(level=6)
        ids, raw, size, no = [], [], 0, TaskContext.get().partitionId() << 24

        def out():
            cols = [pa.array([no], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))] + [pa.array([x], pa.binary()) for x in (np.array([len(r) for r in raw], np.int64).tobytes(), zip_.compress(b"".join(raw)))]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "size", "ids", "lens", "z"])

        for part in slices(batches, 64):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(i)
                raw.append((t or "").encode())
                size += len(raw[-1])
                if size >= limit:
                    yield out()
                    ids, raw, size, no = [], [], 0, no + 1
        if ids:
            yield out()

    return docs.mapInArrow(run, "chunk long, size long, ids array<long>, lens binary, z binary")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bounds(buckets: int) -> np.ndarray:
    """Where each bucket of 64-bit hashes begins."""
    return np.array([-(-(k << 64) // buckets) for k in range(buckets)], np.uint64)


class _Chunk:
    """Tokens of a chunk and its distinct n-grams in the order of their hashes,
    of which the buckets are ranges. An n-gram is known by 64 bits."""

    def __init__(self, ids: list, lens: bytes, z: bytes, starts: np.ndarray, table: _Words):
        data = zstandard.ZstdDecompressor().decompress(z)
        self.ids = ids
        ends = np.cumsum(np.frombuffer(lens, np.int64)).tolist()
        parts, count, at = [], [], 0
        for e in ends:
            words = data[at:e].lower().split()
            parts.append(np.fromiter((table[w] for w in words), np.uint64, len(words)))
            parts.append(np.array([_END]))
            count.append(len(words) + 1)
            at = e
        one = np.concatenate(parts)
        self.count = np.array(count, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(count), dtype=np.int32), self.count)
        del parts, data
        before = np.empty_like(one)
        before[1:] = one[:-1]
        before[self.first] = _END
        two = _mix(before * np.uint64(0xD6E8FEB86659FD93) + one)
        one, before = _mix(one), None
        self.train = np.array([learns(i) for i in ids], bool)
        self.held = np.array([held_out(i) for i in ids], bool)
        self.grams = [self._distinct(x, starts, np.repeat(self.train, self.count)) for x in (one, two)]

    @staticmethod
    def _distinct(key: np.ndarray, starts: np.ndarray, train: np.ndarray):
        u, inv = np.unique(key, return_inverse=True)
        inv = inv.astype(np.int32)
        local = np.bincount(inv, train, minlength=len(u)).astype(np.int64)
        return u, inv, local, np.append(np.searchsorted(u, starts), len(u))

    def counts(self, notes: list, kind: int) -> np.ndarray:
        """Global training counts of the chunk's distinct n-grams of a kind."""
        _, _, local, cut = self.grams[kind]
        total = local.copy()
        for bucket, k, x in notes:
            if k == kind:
                total[cut[bucket] : cut[bucket + 1]] += expand(x, np.int64)
        return total


def _offers(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        table, starts = _Words(), bounds(buckets)
        for b in batches:
            for chunk, ids, lens, z in zip(*[b.column(c).to_pylist() for c in ("chunk", "ids", "lens", "z")]):
                c = _Chunk(ids, lens, z, starts, table)
                for kind, (u, _, local, cut) in enumerate(c.grams):
                    rows = [(k, squeeze(np.diff(u[s:e], prepend=starts[k])), squeeze(local[s:e].astype(np.uint32))) for k, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if e > s]
                    if rows:
                        k, h, n = zip(*rows)
                        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([kind] * len(k), pa.int32()), pa.array([chunk] * len(k), pa.int64()), pa.array(h, pa.binary()), pa.array(n, pa.binary())], ["bucket", "kind", "chunk", "h", "n"])

    return chunks.mapInArrow(run, "bucket int, kind int, chunk long, h binary, n binary")


def _extras(offers: DataFrame, parts: int) -> DataFrame:
    """What other chunks add to each chunk's counts, one bucket in memory at a
    time; per bucket a row of chunk null with the number of distinct training
    n-grams and of training tokens."""

    def run(batches):
        for (k, kind), rows in runs_of(batches, ("bucket", "kind")):
            hs = [np.cumsum(expand(r[3], np.uint64), dtype=np.uint64) for r in rows]
            h, n = np.concatenate(hs), np.concatenate([expand(r[4], np.uint32) for r in rows]).astype(np.int64)
            order = np.argsort(h)
            g = h[order]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            total = np.add.reduceat(n[order], cut)
            more = np.empty(len(h), np.int64)
            more[order] = np.repeat(total, np.diff(np.append(cut, len(g))))
            more -= n
            out, at = [(None, b"", int((total > 0).sum()), int(total.sum()))], 0
            for r, x in zip(rows, hs):
                part = more[at : at + len(x)]
                at += len(x)
                if part.any():
                    out.append((r[2], squeeze(part), None, None))
            c, x, v, n = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array([k] * len(c), pa.int32()), pa.array([kind] * len(c), pa.int32()), pa.array(x, pa.binary()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["chunk", "bucket", "kind", "x", "distinct", "tokens"])

    rows = offers.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "kind", "chunk")
    return rows.mapInArrow(run, "chunk long, bucket int, kind int, x binary, distinct long, tokens long")


def _stream(batches):
    notes: list = []
    for b in batches:
        for chunk, last, bucket, kind, x, ids, z in zip(*[c.to_pylist() for c in b.columns]):
            if last == 0:
                notes.append((bucket, kind, x))
            else:
                yield notes, ids, x, z
                notes = []


def _together(chunks: DataFrame, extras: DataFrame, parts: int) -> DataFrame:
    a = extras.where("chunk is not null").select("chunk", F.lit(0).alias("last"), "bucket", "kind", "x", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("z"))
    b = chunks.select("chunk", F.lit(1).alias("last"), F.lit(0).alias("bucket"), F.lit(0).alias("kind"), F.col("lens").alias("x"), "ids", "z")
    even = F.pmod(F.shiftright("chunk", 24) + 7919 * F.col("chunk").bitwiseAND((1 << 24) - 1), F.lit(parts)).cast("int")  # chunks of a partition are numbered from 0
    return a.unionAll(b).repartitionById(parts, even).sortWithinPartitions("chunk", "last")


def context_class(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), CLASSES - 1), 0)


def _cell(ratio: np.ndarray) -> np.ndarray:
    return np.where(ratio > 0, np.clip(np.rint(4 * np.log2(np.maximum(ratio, 1e-30))) + 65, 1, CELLS - 1), 0).astype(np.int64)


def _own(doc: np.ndarray, inv: np.ndarray, size: int) -> np.ndarray:
    """How often each token's n-gram occurs in the token's own document."""
    _, back, n = np.unique(doc.astype(np.int64) * size + inv, return_inverse=True, return_counts=True)
    return n[back]


def _histogram(rows: DataFrame, buckets: int, n_all: int, v_all: int) -> DataFrame:
    """Training tokens by context class and ratios to the uniform estimate, each
    predicted without its own document."""

    def run(batches):
        table, starts = _Words(), bounds(buckets)
        for notes, ids, lens, z in _stream(batches):
            c = _Chunk(ids, lens, z, starts, table)
            use = np.repeat(c.train, c.count)
            if not use.any():
                continue
            (u1, i1, *_), (u2, i2, *_) = c.grams
            c1, c2 = c.counts(notes, 0)[i1], c.counts(notes, 1)[i2]
            d1, d2 = _own(c.doc, i1, len(u1)), _own(c.doc, i2, len(u2))
            rest1, rest2 = c1 - d1, c2 - d2
            del c1, c2, d1, d2, i1, i2, u1, u2
            ctx = np.empty_like(rest1)
            ctx[1:] = rest1[:-1]
            ctx[c.first] = rest1[c.first + c.count - 1]  # a text begins after an end
            left = n_all - np.repeat(c.count, c.count)
            p2 = np.where(ctx > 0, rest2 / np.maximum(ctx, 1), 0)[use] * (v_all + 1)
            p1 = np.where(left > 0, rest1 / np.maximum(left, 1), 0)[use] * (v_all + 1)
            code = (context_class(ctx[use]) * CELLS + _cell(p2)) * CELLS + _cell(p1)
            k, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], ["code", "n"])

    return rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def mixture_weights(codes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context class by expectation-maximisation."""
    out = np.tile([0.0, 0.9, 0.1], (CLASSES, 1))
    out[1:] = [0.3, 0.6, 0.1]
    cls, rest = np.divmod(codes, CELLS * CELLS)
    a, b = np.divmod(rest, CELLS)
    value = lambda c: np.where(c > 0, 2.0 ** ((c - 65) / 4), 0.0)
    p = np.stack([value(a), value(b), np.ones(len(codes))], 1)
    for k in np.unique(cls).tolist():
        x, w = p[cls == k], n[cls == k].astype(float)
        lam = np.array([0.0, 0.5, 0.5]) if k == 0 else np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(rounds):
            post = x * lam
            post /= post.sum(1, keepdims=True)
            lam = (w[:, None] * post).sum(0) / w.sum()
        lam = np.maximum(lam, [0.0 if k == 0 else 1e-9, 1e-9, 1e-6])
        out[k] = lam / lam.sum()
    return out


def _scores(rows: DataFrame, buckets: int, n_all: int, v_all: int, weights: np.ndarray) -> DataFrame:
    def run(batches):
        table, starts = _Words(), bounds(buckets)
        for notes, ids, lens, z in _stream(batches):
            c = _Chunk(ids, lens, z, starts, table)
            (_, i1, *_), (_, i2, *_) = c.grams
            c1, c2 = c.counts(notes, 0)[i1], c.counts(notes, 1)[i2]
            ctx = np.empty_like(c1)
            ctx[1:] = c1[:-1]
            ctx[c.first] = c1[c.first + c.count - 1]
            lam = weights[context_class(ctx)]
            p = lam[:, 0] * (c2 / np.maximum(ctx, 1)) + lam[:, 1] * (c1 / max(n_all, 1)) + lam[:, 2] / (v_all + 1)
            base = np.log10((c1 + 0.1) / (n_all + 0.1 * (v_all + 1)))
            add = lambda x: np.add.reduceat(x, c.first)
            yield pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(c.count), pa.array(add((c1 > 0).astype(np.int64))), pa.array(np.full(len(c.ids), n_all)), pa.array(add(base)), pa.array(add(np.log10(p)))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores every whole text of ``docs(doc_id, text)``.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0. A null text
    is empty (one end token); a null doc_id is neither learned from nor held
    out; repeated rows count each time; an empty table gives no rows. Returns
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    scratch, parts = Scratch(spark, "lm"), partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    limit = chunk_bytes(parts, CHUNK, MOST, 16)
    chunks = scratch.write(_pack(base, limit), "chunks")
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(2 * parts, -(-total // (4 * limit)))  # a task sums up one at a time
    extras = scratch.write(_extras(_offers(chunks, buckets), parts), "extras")
    v_all, n_all = extras.where("kind = 0").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    cells = _histogram(_together(chunks, extras, parts), buckets, n_all, v_all).collect()
    weights = mixture_weights(np.array([r[0] for r in cells], np.int64), np.array([r[1] for r in cells], np.int64))
    return _scores(_together(chunks, extras, parts), buckets, n_all, v_all, weights)


def op7_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
