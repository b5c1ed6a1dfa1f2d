"""Helpers shared by the corpus operators: scratch tables on shared storage,
sizes of chunks, packed arrays, sliced Arrow batches, joins that split hot keys,
and component search."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIVE: list[Scratch] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="sparkloom-package-"))  # executors fetch it from the driver when they need it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/{package.name}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, f"{package.name}/{file.relative_to(package)}")
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session,
    on the session's default file system where it names none.

    Where that is unset, a session on one machine gets a temporary folder, which
    is recorded in the session so that later calls agree on it; on a cluster it
    is an error, as no folder of one machine is seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkloom.scratch.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("sparkloom.scratch.dir", root)
    if "://" in root:
        return root
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


class Scratch:
    """Intermediate tables of one query, written as Parquet to shared storage.

    A written table cuts lineage and survives the loss of any executor. Tables
    are removed by ``drop``, by ``release`` once the results that read them are
    written or, at the latest, when the interpreter exits.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/sparkloom-{label}-{uuid.uuid4().hex}"
        _LIVE.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(schema).parquet(where)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for scratch in _LIVE:
        try:
            scratch.drop()
        except Exception:  # the JVM may be gone by now; the folder is only scratch
            return


def release(since: int = 0) -> None:
    """Removes all scratch tables made so far, or those after the first ``since``
    (see ``made``): call it when every result that reads them is written."""
    while len(_LIVE) > since:
        _LIVE.pop().drop()


def made() -> int:
    """How many sets of scratch tables there are."""
    return len(_LIVE)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def chunk_bytes(parts: int, least: int, most: int, entry: int, fill: int = 16) -> int:
    """Bytes of text in a chunk that offers an entry for each ``entry`` bytes to
    every one of ``parts`` buckets: about ``fill`` entries a bucket, so that the
    rows of an exchange grow with the entries and not with chunks x buckets."""
    return max(least, min(most, parts * entry * fill))


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray) -> bytes:
    """An array of whole numbers, byte plane by byte plane, compressed: planes of
    small or slowly growing numbers are mostly zeros."""
    return _ZIP.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T))


def expand(b: bytes, kind) -> np.ndarray:
    """The array that ``squeeze`` packed."""
    planes = np.frombuffer(_UNZIP.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def runs_of(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple, list]]:
    """(key, rows) of a stream that is sorted by ``keys``, one key in memory at a
    time; a row is a tuple of the batch's columns."""
    cur, held = None, []
    for b in batches:
        at = [b.schema.names.index(k) for k in keys]
        for row in zip(*[c.to_pylist() for c in b.columns]):
            key = tuple(row[i] for i in at)
            if key != cur:
                if held:
                    yield cur, held
                cur, held = key, []
            held.append(row)
    if held:
        yield cur, held


def slices(batches, rows: int = 256) -> Iterator:
    """Arrow batches in slices of a few rows, so that long texts stay bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sampled(key: Column, rows: int, total: int) -> Column:
    """True for about ``rows`` of ``total`` keys, by a hash of the key."""
    fine = 10**15  # so many parts that a share of very many keys is not rounded to none
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(fine)) < F.lit(int(fine * min(1.0, rows / max(1, total))))


#: A key with more than this share of the rows is hot; there are fewer such keys than its inverse.
HOT_SHARE = 1000
#: Parts that the rows of a hot key are dealt to.
SALTS = 64


def hot_keys(df: DataFrame, keys: list[str], total: int, weight: Column | None = None) -> list:
    """Keys with more than 1 of ``HOT_SHARE`` of the ``total`` rows, fewer than
    ``HOT_SHARE`` of them; counts are combined before they are moved. With
    ``weight`` the rows of ``df`` are distinct keys and their numbers of rows."""
    if total < 10 * HOT_SHARE:
        return []
    counted = df.select(*keys, weight.alias("_n")) if weight is not None else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") * HOT_SHARE > total).select(*keys).collect()


def join_split(left: DataFrame, right: DataFrame, keys: list[str], hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose ``keys`` are unique. Rows of the hot
    keys (a bounded list) are dealt over ``SALTS`` salts, each of which gets its
    copy of their few right rows, so that no task receives all rows of one key."""
    if not hot:
        return left.join(right.hint("merge"), keys, how)
    few = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*keys).schema))  # fewer than HOT_SHARE keys
    salt = F.pmod(F.xxhash64(*left.columns) + 31 * F.spark_partition_id(), F.lit(SALTS).cast("long"))
    salted = right.join(few, keys, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    warm = left.join(few, keys, "left_semi").withColumn("_salt", salt).join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")
    cold = left.join(few, keys, "left_anti").join(right.hint("merge"), keys, how)
    return cold.unionByName(warm)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``(node, component)``.

    Alternates a small-star and a large-star step over (hi, lo) pairs until the
    pairs form stars; every step is a grouped minimum (combined before the
    shuffle) and a join with it, and its result is a written table. Hot nodes
    of a join are known by their counts and are joined apart. The component of
    a node is its smallest member. Nodes without an edge to another node are
    not returned. Null ends and self links are dropped.
    """
    a, b = F.col("a"), F.col("b")
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    cur = scratch.write(pairs, "cc-0")
    for step in range(1, max_rounds + 1):
        low = scratch.write(cur.groupBy("hi").agg(F.min("lo").alias("m"), F.count("lo").alias("n")), f"cc-low-{step}")
        size, most = low.agg(F.sum("n"), F.max("n")).first()
        if not size:
            return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        small = low.select("hi", F.col("m").alias("lo"))
        if most > 1:
            multi = low.where("n > 1").select("hi", "m")
            moved = join_split(cur, multi, ["hi"], hot_keys(low, ["hi"], size, F.col("n")) if most * HOT_SHARE > size else []).where("lo <> m")
            small = small.unionAll(moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        small = scratch.write(small, f"cc-small-{step}")
        up = scratch.write(small.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("lo"), "m"), f"cc-up-{step}")
        nxt = join_split(small, up, ["lo"], hot_keys(small, ["lo"], size), "left")
        nxt = scratch.write(nxt.select("hi", F.coalesce("m", "lo").alias("lo"), F.col("m").isNotNull().alias("moved")), f"cc-big-{step}")
        changed = most > 1 or nxt.where("moved").limit(1).count()
        for name in (str(step - 1), f"low-{step}", f"small-{step}", f"up-{step}"):
            scratch.drop(f"cc-{name}")
        if not changed:
            return nxt.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(nxt.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
        cur = scratch.write(nxt.select("hi", "lo").distinct(), f"cc-{step}")
        scratch.drop(f"cc-big-{step}")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
