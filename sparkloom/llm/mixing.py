"""Operator 6: mixing to target weights with soft membership.

A classifier learned from a table of labelled rows gives every document
posteriors over domains. Nonnegative document rates are then fitted so that the
expected tokens of each domain (rate x tokens x posterior, summed over all
documents) match its target, by accelerated projected-gradient least squares.
Steps are scaled by the inverse Gram matrix of the domains, so that a rare
domain moves as fast as a frequent one. A gradient is one vector with an entry
per domain: a pass replays the steps since rates were last stored, over the
table of posteriors, and returns the domain totals. The fit ends where every
domain is at its target, or where the totals are proven to be those of the least
squares, to a stated share.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, slices

BITS = 15
#: At most about this many labelled rows are learned from (a documented sample bound).
SAMPLE_ROWS = 4000
#: Of a domain at least about this many labelled rows are learned from, or all where it has fewer.
SAMPLE_FLOOR = 200
#: After so many passes a fit that has not settled says how far from least squares it may be, or raises.
PASSES = 500
#: Rates are stored after so many passes, so that a pass replays fewer steps than that.
STORED = 20
#: The passes end when every domain is this close to its target, as a share of that target,
CLOSE = 1e-4
#: or when every domain's total is proven to be this close to that of the least squares.
SETTLED = 0.01
#: Bytes of memberships that a task goes over in a pass.
PASS_BYTES = 64 << 20


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        b = zlib.crc32(word) & ((1 << BITS) - 1)
        if len(self) < 200_000:
            self[word] = b
        return b


def _indices(text: str | None, buckets: _Buckets) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter((buckets[w] for w in words), np.int64, len(words))


class DomainModel:
    """Multinomial logistic regression on relative frequencies of hashed words."""

    def __init__(self, names: list[str], prior: np.ndarray):
        self.names = names
        self.b = np.log(prior)
        self.w = np.zeros((1 << BITS, len(names)))

    def posterior(self, idx: np.ndarray) -> np.ndarray:
        return self._soft(self.w[idx].sum(0) / np.sqrt(len(idx)) if len(idx) else 0)

    def _soft(self, z) -> np.ndarray:
        z = self.b + z
        e = np.exp(z - z.max())
        return e / e.sum()

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 0.3, batch: int = 64) -> None:
        """AdaGrad on rows of (distinct buckets, their counts); the rows' order fixes the result."""
        rng = np.random.default_rng(5)
        acc = np.full(self.w.shape, 1e-4)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                for i in order[at : at + batch]:
                    u, c = rows[i]
                    if not len(u):
                        continue
                    x = c / np.sqrt(c.sum())
                    p = self._soft(x @ self.w[u])
                    p[y[i]] -= 1
                    g = x[:, None] * p[None, :] + 1e-4 * self.w[u]
                    acc[u] += g * g
                    self.w[u] -= rate * g / np.sqrt(acc[u])


def fit_domains(spark: SparkSession, docs: DataFrame, labelled: DataFrame, domain: str = "lang", sample_rows: int = SAMPLE_ROWS, floor: int = SAMPLE_FLOOR) -> DomainModel:
    """Learns domains from the documents that ``labelled(doc_id, domain)`` names.

    Which domains there are, and how frequent, comes from all labelled rows;
    only weights come from a sample, by a hash of the id: of each domain its
    share of about ``sample_rows`` ids, or ``floor`` where that is more. Null ids
    and domains are left out; of several domains of an id the smallest counts.
    Without labelled rows there is one domain, the empty name.
    """
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labelled.where(F.col("doc_id").isNotNull() & F.col(domain).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(domain).cast("string")).alias("domain"))
    count = dict(map(tuple, docs.select("doc_id").join(known, "doc_id").groupBy("domain").count().collect()))
    if not count:
        return DomainModel([""], np.ones(1))
    names, total = sorted(count), sum(count.values())
    fine = 10**15  # a share in parts so small that one of very many rows is not rounded to none
    share = F.create_map(*[F.lit(x) for n in names for x in (n, int(fine * min(1.0, max(floor / count[n], sample_rows / total))))])
    known = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(fine)) < F.element_at(share, F.col("domain"))))

    def extract(batches):
        buckets = _Buckets()
        for part in slices(batches):
            got = [np.unique(_indices(t, buckets), return_counts=True) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([u.astype("<u2").tobytes() for u, _ in got], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())], ["doc_id", "domain", "i", "n"])

    one = docs.join(known, "doc_id").groupBy("doc_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of several texts of an id, one
    rows = one.select("doc_id", "text", "domain").mapInArrow(extract, "doc_id long, domain string, i binary, n binary").collect()  # at most 2^BITS words each
    rows.sort(key=lambda r: (r[0], r[1]))
    y = np.array([names.index(r[1]) for r in rows])
    model = DomainModel(names, (np.bincount(y, minlength=len(names)) + 1.0) / (len(y) + len(names)))
    model.fit([(np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<u4").astype(float)) for r in rows], y)
    model.b = np.log((np.array([count[n] for n in names]) + 1.0) / (total + len(names)))  # fitted at the frequencies of the sample, used at those of all rows
    return model


def _memberships(docs: DataFrame, sent) -> DataFrame:
    """Packed rows of ids, tokens and posteriors, one for each few thousand documents."""

    def run(batches):
        model, buckets = sent.value, _Buckets()
        ids, tokens, post = [], [], []

        def out():
            missing = [i is None for i in ids]
            blobs = [np.array([i or 0 for i in ids], np.int64), np.array(missing, np.uint8), np.array(tokens, np.float64), np.array(post, np.float64)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["ids", "missing", "tokens", "post"])

        for part in slices(batches):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                idx = _indices(t, buckets)
                ids.append(i)
                tokens.append(len(idx))
                post.append(model.posterior(idx))
            if len(ids) >= 8192:
                yield out()
                ids, tokens, post = [], [], []
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "ids binary, missing binary, tokens binary, post binary")


class TargetsMissed(UserWarning):
    """The fitted rates do not bring every domain to its target."""


def start_rates(n: int, lowest: float) -> tuple[np.ndarray, np.ndarray]:
    rate = np.full(n, max(1.0, lowest))
    return rate, rate


def replay(post: np.ndarray, steps: list[tuple[np.ndarray, float]], lowest: float, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps, from a state or the start, and the point at which the next gradient is taken."""
    rate, ahead = state or start_rates(len(post), lowest)
    for s, momentum in steps:
        new = np.maximum(lowest, ahead - post @ s)
        ahead = np.maximum(lowest, new + momentum * (new - rate))
        rate = new
    return rate, ahead


def _inverse(gram: np.ndarray) -> np.ndarray:
    """Inverse of a Gram matrix; directions that the domains hardly tell apart are bounded."""
    d = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    e, v = np.linalg.eigh(gram / np.outer(d, d))
    return (v / np.maximum(e, e[-1] * 1e-8)) @ v.T / np.outer(d, d)


def _state(row: dict, lowest: float) -> tuple[np.ndarray, np.ndarray]:
    """The stored state of a row of memberships: all start from rate 1, or ``lowest`` where that is more."""
    if row.get("rate") is None:
        return start_rates(len(row["tokens"]) // 8, lowest)
    return np.frombuffer(row["rate"], np.float64), np.frombuffer(row["ahead"], np.float64)


def fit_rates(spark: SparkSession, table: DataFrame, names: list[str], target, lowest: float = 0.0, passes: int = PASSES, stored: int = STORED, strict: bool = False):
    """Steps (each with its momentum) of the fit over a table of memberships, and
    the targets and the totals reached, by domain.

    ``target`` turns the current expected tokens of the domains into those
    wanted. The norm weights a document by its tokens, so that a step changes
    rates by posteriors only; errors are measured by the inverse Gram matrix,
    in which a step of length one never overshoots. Some targets cannot be met,
    as when no rate may be under 1 and a domain that shares documents with
    growing ones is to stay as it is; the fit then ends near the least squares.

    How near is known: with e the error, W the norm and l = We, no totals x* that
    rates can give are better than those at hand, x, by more than l(x - low) + m(x*
    - low), where low are the totals at the lowest rates and m the most that a
    document's posterior times l is under zero. Warns of domains that are not
    within ``CLOSE`` of their targets, and of how far they may be from the least
    squares where ``passes`` did not settle it; ``strict`` raises RuntimeError then.
    """
    k = len(names)
    scratch = Scratch(spark, "rates")

    def sums(f):
        """Sums of ``f`` over all rows, and least values of its last entries: a task gives one vector."""

        def run(batches):
            total = None
            for b in batches:
                for row in b.to_pylist():
                    t, p = np.frombuffer(row["tokens"], np.float64), np.frombuffer(row["post"], np.float64).reshape(-1, k)
                    v, least = f(t, p, row)
                    total = (v, least) if total is None else (total[0] + v, min(total[1], least))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total[0].ravel().tolist()], pa.list_(pa.float64())), pa.array([total[1]], pa.float64())], ["v", "least"])

        got = table.mapInArrow(run, "v array<double>, least double").collect()
        return (np.sum(sorted(r[0] for r in got), axis=0), min(r[1] for r in got)) if got else (None, 0.0)

    def store(steps, name):
        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    got = replay(np.frombuffer(row["post"], np.float64).reshape(-1, k), steps, lowest, _state(row, lowest))
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (row["tokens"], row["post"], *[x.tobytes() for x in got])], ["tokens", "post", "rate", "ahead"])

        return scratch.write(table.mapInArrow(run, "tokens binary, post binary, rate binary, ahead binary"), name)

    first, _ = sums(lambda t, p, _: (np.concatenate([((p * t[:, None]).T @ p).ravel(), t @ p, [len(t)]]), 0.0))
    if first is None or not first[:-1].sum():
        return [], np.zeros(k), np.zeros(k)
    gram, whole, count = first[: k * k].reshape(k, k), first[k * k : -1], first[-1]
    parts = int(count * 8 * (k + 3) / PASS_BYTES) + 1
    table = table.coalesce(parts)  # it is far smaller than the texts it was made from
    want, low = np.asarray(target(whole), float), lowest * whole
    scale = _inverse(gram)
    steps: list[tuple[np.ndarray, float]] = []  # all of them; the table is as far as the first ``done``
    now = ahead = max(1.0, lowest) * whole
    pace, before, done, off = 1.0, np.inf, 0, np.full(k, np.inf)
    near = CLOSE * want + 1e-9 * want.sum()
    slope = scale @ (now - want)
    _, least = sums(lambda t, p, _: (np.zeros(1), float((p @ slope).min(initial=0.0))))
    while np.any(np.abs(now - want) > near):
        gap = max(0.0, slope @ (now - low)) - least * max((now - low).sum(), (want - low).sum())
        off = np.minimum(off, np.sqrt(2 * max(0.0, gap) * np.diag(gram)))
        if np.all(off <= SETTLED * want):
            break
        if len(steps) == passes:
            if strict:
                raise RuntimeError(f"rates did not settle in {passes} passes: {now.tolist()} of {want.tolist()} tokens")
            break
        error = (now - want) @ slope
        pace = 1.0 if error > before else pace  # momentum starts anew when it led away
        before, last, pace = error, pace, (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if len(steps) - done == stored:
            table, old, done = store(steps[done:], f"after-{len(steps)}").coalesce(parts), done, len(steps)
            scratch.drop(f"after-{old}")
        steps.append((scale @ (ahead - want), (last - 1) / pace))
        both, _ = sums(lambda t, p, row: (np.vstack([(t * r) @ p for r in replay(p, steps[done:], lowest, _state(row, lowest))]), 0.0))
        now, ahead = both.reshape(2, k)
        slope = scale @ (now - want)
        if len(steps) % 5 == 0 or len(steps) == passes:  # a bound needs another pass, and few of them do
            _, least = sums(lambda t, p, _: (np.zeros(1), float((p @ slope).min(initial=0.0))))
        else:
            least = -np.inf
    missed = [f"{n!r} {x:.0f} of {w:.0f}" for n, x, w, m in zip(names, now, want, near) if abs(x - w) > m]
    if missed:
        proven = ", ".join(f"{n!r} {100 * o / w:.2g} %" for n, o, w in zip(names, off, want) if w > 0)
        warnings.warn(f"targets not met within {CLOSE:g} after {len(steps)} passes, tokens reached: {', '.join(missed)}; the least squares are at most this far: {proven}", TargetsMissed, stacklevel=2)
    return steps, want, now


def tempered(power: float, grow_only: bool):
    """Targets in proportion to current tokens to a power; as many tokens as now, or as many as let no domain shrink."""

    def target(now: np.ndarray) -> np.ndarray:
        w = now**power / (now**power).sum()
        return w * (np.max(now / np.maximum(w, 1e-300)) if grow_only else now.sum())

    return target


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, target, domain: str = "lang", lowest: float = 0.0) -> DataFrame:
    """Rates of every row of ``docs(doc_id, text)``: doc_id, n_tokens, domain
    (the likeliest), posterior (its probability) and rate (at least ``lowest``).

    Null and empty texts have no tokens and do not count; repeated rows count
    each time; null ids are kept; an empty table gives no rows. Warns where
    ``fit_rates`` does.
    """
    scratch = Scratch(spark, "mixing")
    model = fit_domains(spark, docs, labelled, domain)
    k = len(model.names)
    table = scratch.write(_memberships(docs, spark.sparkContext.broadcast(model)), "memberships")
    steps, _, _ = fit_rates(spark, table, model.names, target, lowest)
    names = model.names

    def run(batches):
        for b in batches:
            for ids, missing, tokens, post in zip(*[b.column(c).to_pylist() for c in ("ids", "missing", "tokens", "post")]):
                p = np.frombuffer(post, np.float64).reshape(-1, k)
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(missing, np.uint8).astype(bool)), pa.array(np.frombuffer(tokens, np.float64).astype(np.int64)), pa.array([names[i] for i in best.tolist()]), pa.array(p.max(1)), pa.array(replay(p, steps, lowest)[0])], ["doc_id", "n_tokens", "domain", "posterior", "rate"])

    return table.mapInArrow(run, "doc_id long, n_tokens long, domain string, posterior double, rate double")


def mixed_documents(spark: SparkSession, docs: DataFrame, labelled: DataFrame, target, domain: str = "lang", lowest: float = 1.0) -> DataFrame:
    """The rows of ``docs``, each repeated by its rate: its whole part, and once
    more where a hash of the id falls under the rest. Columns stay as they are.
    With ``lowest`` of 1 no row goes. Texts are scored again, not joined."""
    scratch = Scratch(spark, "mixed")
    model = fit_domains(spark, docs, labelled, domain)
    sent = spark.sparkContext.broadcast(model)
    table = scratch.write(_memberships(docs, sent), "memberships")
    steps, _, _ = fit_rates(spark, table, model.names, target, lowest)

    def run(batches):
        buckets = _Buckets()
        for part in slices(batches):
            p = np.array([sent.value.posterior(_indices(t, buckets)) for t in part.column("text").to_pylist()])
            rate = replay(p, steps, lowest)[0]
            u = np.array([zlib.crc32(f"mix/{i}".encode()) / 2**32 for i in part.column("doc_id").to_pylist()])
            times = np.floor(rate).astype(np.int64) + (u < rate - np.floor(rate))
            yield part.take(pa.array(np.repeat(np.arange(part.num_rows), times)))

    return docs.mapInArrow(run, docs.schema)


def labelled_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains of the documents that the labels table names."""
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    return docs.select("doc_id", "lang").join(ids, "doc_id", "left_semi")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(spark, docs, labelled_domains(spark, docs, sf_dir), tempered(0.7, False))
