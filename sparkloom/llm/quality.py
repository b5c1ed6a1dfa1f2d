"""Operator 5: quality classifier, a factorisation machine.

Inputs of a score are hashed words, structure statistics of the text and its
recorded length. Pairwise interactions have rank ``RANK`` and are summed in
linear time: half of (sum v x)^2 - sum v^2 x^2. It is fitted on the driver from
a bounded sample of labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled, ship, slices

BITS = 16
RANK = 6
DENSE = 16
SIZE = (1 << BITS) + DENSE
#: At most about this many labelled rows are learned from (a documented sample bound).
SAMPLE_ROWS = 6000
_SYM = re.compile(rb"[!#$%&*@^~=+<>|\\/_{}\[\]]")
_PUNCT = b".,;:!?\"'()"


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        b = zlib.crc32(word) & ((1 << BITS) - 1)
        if len(self) < 200_000:
            self[word] = b
        return b


def features(text: str | None, n_chars, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text; linear in its length."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n, size = len(words), len(raw)
    dense = np.zeros(DENSE)
    dense[0] = 1.0 if n == 0 else 0.0
    if n:
        idx = np.fromiter((buckets[w] for w in words), np.int64, n)
        counts = np.bincount(idx, minlength=1 << BITS) if n > 20_000 else None
        if counts is None:
            u, c = np.unique(idx, return_counts=True)
        else:
            u = np.flatnonzero(counts)
            c = counts[u]
        x = np.log1p(c)
        x *= 1.0 / np.sqrt((x * x).sum())
        lines = raw.split(b"\n")
        full = [s for s in lines if s.strip()]
        upper = sum(map(raw.count, [bytes([k]) for k in range(65, 91)]))
        sym = len(_SYM.findall(raw))
        digits = len(raw.translate(None, b"0123456789"))
        dense[1] = np.log1p(size) / 12
        dense[2] = min(size / n, 40) / 10
        dense[3] = upper / size * 2
        dense[4] = min(1.0, sym / n)
        dense[5] = (size - digits) / size * 2
        dense[6] = len(u) / n
        dense[7] = float((idx[1:] == idx[:-1]).mean()) * 2 if n > 1 else 0.0
        dense[8] = c.max() / n * 2
        dense[9] = 1 - len(set(full)) / len(full)
        dense[10] = np.log1p(len(full)) / 8
        dense[11] = raw.count(b"!") / n
        dense[12] = raw.count(b"|") / n
        dense[13] = raw.count(b".") / n * 3
        dense[14] = sum(len(raw) - len(raw.translate(None, bytes([k]))) for k in b"#$%&*") / n
    else:
        u, x = np.zeros(0, np.int64), np.zeros(0)
    dense[15] = np.log1p(max(0, n_chars)) / 12 if n_chars is not None else np.log1p(len(text or "")) / 12
    return np.concatenate([u, np.arange(1 << BITS, SIZE)]), np.concatenate([x, dense])


class FactorisationMachine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b = 0.0
        self.w = np.zeros(SIZE)
        self.v = rng.normal(0, 0.02, (SIZE, RANK))

    def margin(self, idx: np.ndarray, x: np.ndarray) -> float:
        v = self.v[idx]
        s = x @ v
        return float(self.b + x @ self.w[idx] + 0.5 * (s @ s - ((x * x) @ (v * v)).sum()))

    def score(self, idx: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(idx, x), -40, 40))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 1e-5, batch: int = 64) -> None:
        """AdaGrad on the logistic loss; the rows' order fixes the result."""
        rng = np.random.default_rng(11)
        gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                idx = np.concatenate([rows[i][0] for i in pick])
                x = np.concatenate([rows[i][1] for i in pick])
                own = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
                starts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                v = self.v[idx]
                xv = x[:, None] * v
                s = np.add.reduceat(xv, starts, axis=0)
                m = self.b + np.add.reduceat(x * self.w[idx], starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), starts))
                d = (1 / (1 + np.exp(-np.clip(m, -40, 40))) - y[pick]) / len(pick)
                u, inv = np.unique(idx, return_inverse=True)
                g = np.bincount(inv, d[own] * x) + decay * self.w[u]
                gw[u] += g * g
                self.w[u] -= rate * g / np.sqrt(gw[u])
                part = (d[own] * x)[:, None] * (s[own] - xv)
                g2 = np.stack([np.bincount(inv, part[:, k]) for k in range(RANK)], 1) + decay * self.v[u]
                gv[u] += g2 * g2
                self.v[u] -= rate * 0.3 * g2 / np.sqrt(gv[u])
                gb += d.sum() ** 2
                self.b -= rate * d.sum() / np.sqrt(gb)


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fits the classifier on labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Of the labelled ids at most about ``sample_rows`` are taken, by a hash of
    the id; a doc_id with several labels counts as 1 only if all are 1; null
    labels and ids are left out. Without any label every score is 0.5.
    """
    ship(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(fold != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    model = FactorisationMachine()
    if not total:
        return model
    known = F.broadcast(known.where(sampled(F.col("doc_id").cast("long"), sample_rows, total)))
    rows = docs.select("doc_id", "text", "n_chars").join(known, "doc_id").select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), F.col("quality").cast("int").alias("y"))

    def extract(batches):
        buckets = _Buckets()
        for part in slices(batches):
            out = [features(t, c, buckets) for t, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array([a.astype("<i4").tobytes() for a, _ in out], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in out], pa.binary())], ["doc_id", "y", "i", "x"])

    # of several texts of an id one, and of a text at most 2^BITS hashed words
    rows = rows.groupBy("doc_id", "y").agg(F.min_by(F.struct("text", "n_chars"), F.xxhash64("text", "n_chars")).alias("row")).select("doc_id", "row.text", "row.n_chars", "y")
    got = sorted(rows.mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, i binary, x binary").collect(), key=lambda r: (r[0], r[2], r[3], r[1]))
    if not got:
        return model
    y = np.array([1.0 if r[1] else 0.0 for r in got])
    model.fit([(np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<f4").astype(float)) for r in got], y)
    return model


def score_quality(spark: SparkSession, docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score, predicted.

    Null and empty texts get the score of an empty text; a null n_chars is
    taken from the text; a null doc_id is never held out; repeated rows give
    repeated rows. With ``keep``, the named columns of ``docs`` come instead,
    for rows that are predicted 1 only.
    """
    ship(spark)
    sent = spark.sparkContext.broadcast((model.b, model.w.astype("f4"), model.v.astype("f4")))

    def run(batches):
        m = FactorisationMachine.__new__(FactorisationMachine)
        m.b, m.w, m.v = sent.value
        buckets = _Buckets()
        for part in slices(batches):
            score = np.array([m.score(*features(t, c, buckets)) for t, c in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist())])
            ok = pa.array((score >= threshold).astype("i4"))
            if keep:
                yield part.filter(pa.array(score >= threshold)).select(keep)
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), ok], ["doc_id", "held_out", "score", "predicted"])

    if keep:
        docs = docs.select(*keep)
        return docs.mapInArrow(run, docs.schema)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(spark, docs, fit_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
