"""Operator 2: deterministic sharded WARC writer and reader.

Pages are dealt to shards by ranges of page_id of about equal bytes (found by
exact histograms that are refined where they are heavy, so that they depend on
the pages only), sorted within each shard, a shard to a task, and
written as gzip members; a file is rolled once its compressed size is reached.
Headers and digests are regenerated from the content, so that the same pages
give the same bytes. A file is written under a temporary name, renamed when it
is whole, and counts only if it is listed in the manifest, which Spark commits
last. The archives are then read back, file by file, from the manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: A file is closed after the record that takes it to this many compressed bytes.
ROLL_BYTES = 16 << 20
#: Smallest payload that may be stored as a revisit of an equal one.
REVISIT_BYTES = 100
#: Bytes of a shard; more where there would be more than ``SHARDS`` shards.
SHARD_BYTES = 16 << 20
SHARDS = 65_536
#: Ranges that a shard is made of, at least.
FINE = 4
_NS = uuid.UUID("6f1c7a52-5a0c-5b7e-9a51-4a2f0b6f8d11")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NS, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record, uncompressed. A revisit carries headers only."""
    block = _HTTP % size + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(root: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    return store, path


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _digests(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))


def revisits(slim: DataFrame) -> DataFrame:
    """page_id, payload_digest, refers_to of the pages that revisit another one,
    from their page_id, payload_bytes and payload_digest.

    The response of equal payloads of at least REVISIT_BYTES is the one with
    the smallest page_id (rows that share it are all responses; a null page_id
    refers to the smallest non-null one, if there is any). Only ids and digests
    are moved for this, and only digests of several ids are joined back.
    """
    slim = slim.where(F.col("payload_bytes") >= REVISIT_BYTES)
    groups = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    found = slim.join(groups, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    return found.select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct()


def _even_ranges(sizes: DataFrame, want: int) -> list[tuple[int, int]]:
    """Where ranges of ``sizes(key, size)`` start, and their bytes: none has more
    than ``want`` / ``FINE`` unless it is a single key. Each round counts the parts
    of the heavy ranges, of which there are at most ``FINE`` x total / ``want``."""
    lo, hi, total = sizes.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    whole, heavy = [], [] if lo is None else [(lo, hi, total)]
    while heavy:
        parts = []
        for first, last, size in sorted(heavy):
            n, k = last - first + 1, min(last - first + 1, FINE * max(2, -(-size // want)))
            parts += [(first + n * i // k, first + n * (i + 1) // k - 1) for i in range(k)]
        starts, ends = (np.array(x, np.int64) for x in zip(*parts))

        @F.pandas_udf("int")
        def number(x: pd.Series) -> pd.Series:
            i = np.searchsorted(starts, x.to_numpy(), "right") - 1
            return pd.Series(np.where((i >= 0) & (x.to_numpy() <= ends[i]), i, -1))

        got = dict(map(tuple, sizes.groupBy(number("key").alias("r")).agg(F.sum("size")).collect()))
        parts = [(a, b, got.get(i, 0)) for i, (a, b) in enumerate(parts)]
        heavy = [p for p in parts if p[2] * FINE > want and p[1] > p[0]]
        whole += [p for p in parts if not (p[2] * FINE > want and p[1] > p[0])]
    return [(a, n) for a, _, n in sorted(whole)]


def _filled(ranges: list[tuple], want: int) -> list:
    """Where shards start: neighbouring ranges make up a shard until it has its share of the bytes."""
    starts, run = [], want
    for first, size in ranges:
        if run >= want or run and run + size > 2 * want:
            starts.append(first)
            run = 0
        run += size
    return starts


def shard_of(slim: DataFrame) -> tuple[Column, int]:
    """The shard of a page (by ``page_id`` and ``payload_digest``) as a column, and
    the number of shards; ``slim`` has these two and ``size``.

    Shards are ranges of page_id; pages without one come first. Rows of one
    page_id, or of none, that have more than two shards' bytes are dealt by
    ranges of their digests.
    """
    none, total = (x or 0 for x in slim.agg(F.sum(F.when(F.col("page_id").isNull(), F.col("size"))), F.sum("size")).first())
    want = max(1, min(SHARD_BYTES, total // 8), -(-total // SHARDS))
    ranges = _even_ranges(slim.where("page_id is not null").select(F.col("page_id").alias("key"), "size"), want)
    heavy = [a for a, n in ranges if n > 2 * want]  # fewer than half as many as there are shards
    even = [((1, a, 0), n) for a, n in ranges if n <= 2 * want] + [((1, a, 0), 0) for a in heavy] + [((0, 0, 0), 0 if none > 2 * want else none)]
    digest = F.conv(F.substring("payload_digest", 1, 8), 16, 10).cast("long")
    if none > 2 * want:
        even += [((0, 0, d), n) for d, n in _even_ranges(slim.where("page_id is null").select(digest.alias("key"), "size"), want)]
    if heavy:
        which = F.broadcast(slim.sparkSession.createDataFrame(list(zip(heavy, range(len(heavy)))), "page_id long, h long"))
        inner = slim.join(which, "page_id").select((F.shiftleft("h", 32) + digest).alias("key"), "size")
        even += [((1, heavy[k >> 32], k & 0xFFFFFFFF), n) for k, n in _even_ranges(inner, want)]
    starts = _filled(sorted(even), want)
    names = np.unique(np.array([a for known, a, _ in starts if known], np.int64))
    place = lambda known, a: known * (1 + int(np.searchsorted(names, a)))
    edges = np.array([place(known, a) << 33 | d for known, a, d in starts], np.int64)

    @F.pandas_udf("int")
    def find(known: pd.Series, page: pd.Series, d: pd.Series) -> pd.Series:
        x = page.to_numpy()
        i = np.searchsorted(names, x, "right")  # the last name that isn't after the page, from 1
        here = (i > 0) & (names[np.maximum(i, 1) - 1] == x) if len(names) else np.zeros(len(x), bool)
        at = np.where(known.to_numpy(), (i << 33) | np.where(here, d.to_numpy(), 1 << 32), d.to_numpy())
        return pd.Series(np.searchsorted(edges, at, "right") - 1)

    return find(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), digest), len(starts)


def _sweep(spark: SparkSession, target: str) -> None:
    """Removes temporary files that lost or repeated attempts have left."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_temporary-*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or []:
        fs.delete(status.getPath(), False)


def write_archives(spark: SparkSession, pages: DataFrame, target: str, manifest: str, roll_bytes: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)`` under ``target``.

    Returns the manifest (shard, part, name, records, bytes, sha256), which is
    written to ``manifest`` as Parquet. A null html is an empty payload, a null
    url leaves out the header, null page_ids come first; columns of other names
    are ignored; an empty table gives an empty manifest.
    """
    slim = Scratch(spark, "warc-pages").write(_digests(pages), "slim")
    shard, shards = shard_of(slim.select("page_id", "payload_digest", (F.col("payload_bytes") + 400).alias("size")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha2(F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8"), 256).alias("payload_digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    notes = revisits(slim).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "payload_digest", F.lit(0).alias("kind"), "refers_to")
    plan = rows.unionAll(notes).withColumn("shard", shard)
    plan = plan.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "payload_digest", "kind", "url")

    def run(batches):
        store, root = _store(target)
        store.create_dir(root, recursive=True)
        cur, part, out, temp = None, 0, None, None
        note: tuple = (object(), None, None)
        done: list[tuple] = []
        count = size = 0
        digest = hashlib.sha256()

        def close():
            nonlocal out, part, count, size, digest
            out.close()
            name = f"shard-{cur:06d}-{part:06d}.warc.gz"
            try:
                store.move(temp, f"{root}/{name}")
            except OSError:  # another attempt of this task was first: its bytes are the same
                if store.get_file_info(f"{root}/{name}").size != size:
                    store.delete_file(f"{root}/{name}")
                    store.move(temp, f"{root}/{name}")
                else:
                    store.delete_file(temp)
            done.append((cur, part, name, count, size, digest.hexdigest()))
            out, part, count, size, digest = None, part + 1, 0, 0, hashlib.sha256()

        for b in batches:
            cols = [b.column(c) for c in ("shard", "page_id", "url", "html", "payload_digest", "kind", "refers_to")]
            for i in range(b.num_rows):
                s, page, url, html, dig, kind, ref = [c[i].as_py() for c in cols]
                if kind == 0:  # goes ahead of the rows that it is about
                    note = (page, dig, ref)
                    continue
                ref = note[2] if note[:2] == (page, dig) else None
                payload = html.encode()
                if s != cur:
                    if out:
                        close()
                    cur, part = s, 0
                if out is None:
                    temp = f"{root}/_temporary-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp, compression=None)
                data = _gzip(record(page, url, payload, len(payload), dig, ref, ref is not None, date))
                out.write(data)
                digest.update(data)
                count, size = count + 1, size + len(data)
                if size >= roll_bytes:
                    close()
        if out:
            close()
        if done:
            cols = list(zip(*done))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5])], ["shard", "part", "name", "records", "bytes", "sha256"])

    schema = "shard int, part int, name string, records long, bytes long, sha256 string"
    plan.select("shard", "page_id", "url", "html", "payload_digest", "kind", "refers_to").mapInArrow(run, schema).write.mode("overwrite").parquet(manifest)
    _sweep(spark, target)
    return spark.read.schema(schema).parquet(manifest)


def records_of(stream):
    """(headers, block) of each record of a gzip stream, one record in memory at a time."""
    z, buf, pending = zlib.decompressobj(31), bytearray(), b""

    def more() -> bool:
        nonlocal z, pending
        while True:
            if z.eof:
                pending, z = z.unused_data + pending, zlib.decompressobj(31)
            data = pending or stream.read(1 << 20)
            pending = b""
            if not data:
                return False
            got = z.decompress(data)
            if got:
                buf.extend(got)
                return True

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf:
                    raise ValueError("the archive ends inside a record")
                return
        lines = bytes(buf[:end]).decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        while len(buf) < stop + 4:
            if not more():
                raise ValueError("the archive ends inside a block")
        block = bytes(buf[end + 4 : stop])
        del buf[: stop + 4]
        yield head, block


def read_archives(spark: SparkSession, target: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Reads the archives a manifest lists: page_id, payload_bytes,
    payload_digest, record_type, refers_to (and url and payload on request).

    Digests of responses are computed from the bytes read and must agree with
    the headers; those of revisits are the header's.
    """

    def run(batches):
        store, root = _store(target)
        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in records_of(stream):
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest, n, kind = head["WARC-Payload-Digest"][7:], int(head["X-Payload-Length"]), head["WARC-Type"]
                        if head["WARC-Block-Digest"][7:] != hashlib.sha256(block).hexdigest():
                            raise ValueError(f"{name}: block digest differs")
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
                            raise ValueError(f"{name}: payload digest differs")
                        page, ref = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                        rows.append((None if page is None else int(page), n, digest, kind, None if ref is None else int(ref), head.get("WARC-Target-URI"), payload if kind == "response" else None))
                        if len(rows) >= (100 if with_payload else 5000):
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    width = 7 if with_payload else 5

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[:width], kinds)], names[:width])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    return manifest.select("name").repartition(partitions(spark), "name").mapInArrow(run, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{scratch.path}/archives", f"{scratch.path}/manifest")
    return read_archives(spark, f"{scratch.path}/archives", manifest)


OP2_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(encode(coalesce(html, ''))) as payload_digest from pages),
g as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1 having count(*) > 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p left join g using (payload_digest)
"""
