"""Operator 8: suffix-array deduplication of repeated byte passages.

Texts are packed into shards. Every 50-byte window has a smallest 24-byte gram,
its anchor; equal windows have equal anchors, so a first exchange of anchor
hashes tells which windows may occur in two documents. Each shard sorts the
text of these by a Larsson-Sadakane suffix array, takes Kasai common prefixes,
and so finds its equal windows and the first of them in the smallest document.
Runs of such windows go, as sorted lists, to the bucket of their anchor. There
the lists of all shards are merged by binary search; windows of runs that agree
in part only are told apart by a suffix array of these runs. Each shard gets
back the smallest document of its windows, where that is another one.

Lists longer than one suffix array should be are sorted in blocks, whose window
lists are merged by the same search. Runs of an anchor that very many shards
hold are merged within groups of shards first, and the groups' lists after that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunk_bytes, expand, partitions, runs_of, slices, squeeze

GRAM = 24
#: Bytes of text in a shard (more where there are very many partitions), and of one suffix array.
CHUNK, MOST = 2 << 20, 32 << 20
BLOCK = 1 << 20
#: Runs of an anchor that more shards hold are merged by groups of shards first.
HOT = 16_384
#: Bytes of text that anchors are computed for at a time.
PART = 2 << 20
_FAR = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _words8(text: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word that starts at each position; zeros follow the end."""
    p = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(text)
    w = (p[:-1] << np.uint64(8)) | p[1:]
    w = (w[: n + 5] << np.uint64(16)) | w[2 : n + 7]
    return (w[:n] << np.uint64(32)) | w[4 : n + 4]


def anchors(text: np.ndarray, width: int, gram: int = GRAM) -> np.ndarray:
    """Smallest hash of a gram in each window of ``width`` bytes (one per window start)."""
    n = len(text)
    if n < width:
        return np.zeros(0, np.uint64)
    w = _words8(text)
    m = n - gram + 1
    h = np.zeros(m, np.uint64)
    for o in [*range(0, gram - 8, 8), gram - 8]:
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w[o : o + m])
    span, have, out = width - gram + 1, 1, h
    while have * 2 <= span:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = span - have
    return np.minimum(out[: n - width + 1], out[rest : rest + n - width + 1])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by Larsson-Sadakane refinement, and the ranks.

    Groups start as equal 8-byte prefixes; each round sorts only the members of
    groups that are still larger than one by the rank of the suffix h further
    on, and doubles h. Order beyond ``depth`` bytes is left open.
    """
    n = len(text)
    key = _words8(text)
    sa = np.argsort(key)
    srt = key[sa]
    head = np.concatenate([[True], srt[1:] != srt[:-1]])
    for tail in range(max(0, n - 7), n):  # zeros that pad a short suffix aren't bytes: it goes ahead, alone
        lo, hi = np.searchsorted(srt, key[tail], "left"), np.searchsorted(srt, key[tail], "right")
        run = sa[lo:hi]
        short = np.sort(run[run >= n - 7])[::-1]
        sa[lo:hi] = np.concatenate([short, run[run < n - 7]])
        head[lo : min(hi, lo + len(short) + 1)] = True
    first = np.flatnonzero(head)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    rank[n] = -1
    h = 8
    while h < depth:
        size = np.diff(np.append(first, n))
        big = size > 1
        if not big.any():
            break
        at = np.repeat(first[big], size[big]) + _ramp(size[big])
        suf = sa[at]
        group = rank[suf]
        nxt = rank[np.minimum(suf + h, n)]
        order = np.argsort(group * (n + 1) + nxt + 1)
        suf, group, nxt = suf[order], group[order], nxt[order]
        sa[at] = suf
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        starts = np.flatnonzero(new)
        rank[suf] = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
        head = np.zeros(n, bool)
        head[first] = True
        head[at[starts]] = True
        first = np.flatnonzero(head)
        h *= 2
    return sa, rank[:n]


def _ramp(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)


def kasai(text: np.ndarray, sa: np.ndarray, limit: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in ``sa``, up to ``limit``.

    Kasai's walk in text order, where a value is at least its predecessor's
    less one, taken by many lanes of consecutive positions at a time; a prefix
    grows by words of 8 bytes.
    """
    n = len(text)
    key = np.concatenate([_words8(text), np.zeros(limit + 9, np.uint64)])
    prev = np.full(n, -1, np.int64)
    prev[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    step = -(-n // lanes)
    base = np.arange(0, n, step)
    h, last = np.zeros(len(base), np.int64), np.full(len(base), -2, np.int64)
    for k in range(step):
        pos = base + k
        live = pos < n
        if not live.all():
            base, pos, h, last = base[live], pos[live], h[live], last[live]
        j = prev[pos]
        # suffixes equal as far as the array is sorted come in any order: a full value holds on for the same pair only
        h = np.where((j < 0) | ((h >= limit) & (j != last + 1)), 0, np.maximum(h - 1, 0))
        last = j
        act = np.flatnonzero((j >= 0) & (h < limit))
        while len(act):
            a, b = pos[act] + h[act], j[act] + h[act]
            diff = key[np.minimum(a, n)] ^ key[np.minimum(b, n)]
            same = np.where(diff == 0, 8, 0)
            odd = np.flatnonzero(diff)
            if len(odd):
                d = diff[odd]
                same[odd] = ((d < np.uint64(1 << 56)).astype(np.int64) + (d < np.uint64(1 << 48)) + (d < np.uint64(1 << 40)) + (d < np.uint64(1 << 32)) + (d < np.uint64(1 << 24)) + (d < np.uint64(1 << 16)) + (d < np.uint64(1 << 8)))
            grown = np.minimum(same, np.minimum(n - a, n - b))
            h[act] = np.minimum(h[act] + grown, limit)
            act = act[(grown == 8) & (h[act] < limit)]
        plcp[pos] = h
    return plcp[sa]


def unify(keys: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of distinct keys, one behind the other and cut at ``cuts``,
    merged two by two by binary search: for each entry the entry that stands for
    all equal ones, and these in order."""
    same = np.arange(len(keys))
    lists = [same[a:b].copy() for a, b in zip(cuts, cuts[1:]) if b > a]
    while len(lists) > 1:
        merged = []
        for x, y in zip(lists[::2], lists[1::2]):
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            kx, ky = keys[x], keys[y]
            p = np.searchsorted(kx, ky)
            hit = kx[np.minimum(p, len(x) - 1)] == ky
            same[y[hit]] = x[p[hit]]
            merged.append(np.insert(x, p[~hit], y[~hit]))
        lists = merged + lists[len(lists) // 2 * 2 :]
    while True:
        up = same[same]
        if (up == same).all():
            return same, lists[0] if lists else same
        same = up


def _keys(text: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, ahead: np.ndarray | None = None) -> np.ndarray:
    """Strings of up to ``width`` bytes as fixed-width keys that sort like them,
    behind 32-bit numbers ``ahead``, if given; the last two bytes are the size."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(width, np.uint8)]), width)
    front = 0 if ahead is None else 4
    rows = np.empty((len(start), front + width + 2), np.uint8)
    if front:
        rows[:, :4] = ahead.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, front:-2] = view[start]
    rows[:, front:-2] *= np.arange(width) < size[:, None]
    rows[:, -2:] = size.astype(">u2").view(np.uint8).reshape(-1, 2)
    return rows.view(f"S{rows.shape[1]}").ravel()


def window_reps(text: np.ndarray, start: np.ndarray, doc: np.ndarray, width: int, block: int = BLOCK) -> np.ndarray:
    """For each window start, the index of the first equal window of the smallest ``doc``.

    ``text`` holds runs end to end; windows lie within their run, so the
    prefixes compared never need what follows it.
    """
    cuts = [0]
    while cuts[-1] < len(start):  # blocks of windows
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(start, start[cuts[-1]] + block))))
    rep, heads = np.empty(len(start), np.int64), []
    for s, e in zip(cuts, cuts[1:]):
        lo, hi = start[s], start[e - 1] + width
        got, head = _block_reps(text[lo:hi], start[s:e] - lo, doc[s:e], width)
        rep[s:e] = got + s
        heads.append(head + s)
    if len(heads) < 2:
        return rep
    head = np.concatenate(heads)
    keys = _keys(text, start[head], np.full(len(head), width), width)
    same, _ = unify(keys, np.cumsum([0, *map(len, heads)]).tolist())
    order = np.lexsort((head, doc[head], same))
    first = order[np.concatenate([[True], same[order][1:] != same[order][:-1]])]
    best = np.empty(len(head), np.int64)
    best[same[first]] = head[first]
    entry = np.empty(len(start), np.int64)
    entry[head] = np.arange(len(head))
    return best[same[entry[rep]]]


def _block_reps(text, start, doc, width):
    """Representatives of the windows, and the distinct ones of these in suffix order."""
    sa, _ = suffix_array(text, width)
    lcp = kasai(text, sa, width)
    row = np.full(len(text), -1, np.int64)
    row[start] = np.arange(len(start))
    group = np.cumsum(lcp < width)
    mine = row[sa]
    use = mine >= 0
    g, w = group[use], mine[use]
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    times = np.diff(np.append(cut, len(w)))
    low = np.minimum.reduceat(doc[w], cut)
    head = np.minimum.reduceat(np.where(doc[w] == np.repeat(low, times), w, len(start)), cut)
    rep = np.empty(len(start), np.int64)
    rep[w] = np.repeat(head, times)
    return rep, head


def window_minima(text: np.ndarray, start: np.ndarray, doc: np.ndarray, width: int, block: int = BLOCK) -> np.ndarray:
    """For each window start, the smallest ``doc`` among equal windows."""
    return doc[window_reps(text, start, doc, width, block)]


def _pack(docs: DataFrame, rest: list[str] | None, limit: int) -> DataFrame:
    """Rows of about ``limit`` bytes: chunk, size, ids (int64), lens (int64), z (texts,
    zstd), and rest (an Arrow stream of the columns of that list and ``text is null``)."""

    def run(batches):
        from pyspark import TaskContext

        zip_ = zstandard.ZstdCompressor(level=3)
        ids, raw, size, no, kept = [], [], 0, TaskContext.get().partitionId() << 24, []

        def out():
            blobs = [np.array(ids, np.int64).tobytes(), np.array([len(r) for r in raw], np.int64).tobytes(), zip_.compress(b"".join(raw)), None]
            if kept:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept[0].schema) as w:
                    for k in kept:
                        w.write_batch(k)
                blobs[3] = zip_.compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([size], pa.int64())] + [pa.array([x], pa.binary()) for x in blobs], ["chunk", "size", "ids", "lens", "z", "rest"])

        for part in slices(batches, 64):
            more = None if rest is None else pa.RecordBatch.from_arrays([*part.columns[2:], part.column(1).is_null()], [f"c{k}" for k in range(part.num_columns - 1)])
            done = 0
            for row, (i, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist()), 1):
                data = (t or "").encode()
                ids.append(i)
                raw.append(data)
                size += len(data)
                if size >= limit or row == part.num_rows:
                    if more is not None:
                        kept.append(more.slice(done, row - done))
                    done = row
                if size >= limit:
                    yield out()
                    ids, raw, size, no, kept = [], [], 0, no + 1, []
        if ids:
            yield out()

    return docs.mapInArrow(run, "chunk long, size long, ids binary, lens binary, z binary, rest binary")


def _texts(z: bytes, ids: bytes, lens: bytes):
    """text, document number of each byte, ids."""
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    size = np.frombuffer(lens, np.int64)
    return text, np.repeat(np.arange(len(size), dtype=np.int32), size), np.frombuffer(ids, np.int64)


def _anchored(text: np.ndarray, own: np.ndarray, width: int, buckets: int):
    """Runs of windows that have one anchor and one document, in text order:
    start, count, and the anchor's bucket and 32 more bits of its hash in one number."""
    out = [[], [], []]
    for at in range(0, len(text) - width + 1, PART):
        a = anchors(text[at : at + PART + width - 1], width)
        n = len(a)
        doc = own[at : at + n]
        use = doc == own[at + width - 1 : at + width - 1 + n]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]) | (use[1:] != use[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        ok = use[start]
        start, count = start[ok], count[ok]
        h = a[start]
        for x, y in zip(out, (start + at, count, ((h % np.uint64(buckets)) << np.uint64(32)) | ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)))):
            x.append(y)
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in out)


def _offer(chunks: DataFrame, buckets: int, width: int) -> DataFrame:
    """The distinct anchors of each chunk by bucket, and which of them two of its documents hold."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for chunk, ids, lens, z in zip(*[b.column(c).to_pylist() for c in ("chunk", "ids", "lens", "z")]):
                text, own, real = _texts(z, ids, lens)
                start, _, code = _anchored(text, own, width, buckets)
                if not len(code):
                    continue
                doc, order = real[own[start]], np.argsort(code)
                code, doc = code[order], doc[order]
                at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                multi = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                code = code[at]
                bucket = (code >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = [*first[1:].tolist(), len(code)]
                h = code.astype(np.uint32)
                rows = [(squeeze(np.diff(h[s:e], prepend=np.uint32(0))), zip_(np.packbits(multi[s:e]).tobytes())) for s, e in zip(first.tolist(), ends)]
                x, y = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array([chunk] * len(x), pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["bucket", "chunk", "h", "multi"])

    return chunks.mapInArrow(run, "bucket int, chunk long, h binary, multi binary")


def _shared(offers: DataFrame, parts: int, hot: int) -> DataFrame:
    """Per chunk and bucket, for each anchor offered: 0 if one document only holds
    it, 2 if more than ``hot`` chunks do, else 1. A bucket is in memory at a time."""

    def run(batches):
        zip_, unzip = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for (k,), rows in runs_of(batches, ("bucket",)):
            parts_ = [np.cumsum(expand(r[2], np.uint32), dtype=np.uint32) for r in rows]
            h = np.concatenate(parts_)
            multi = np.concatenate([np.unpackbits(np.frombuffer(unzip(r[3]), np.uint8), count=len(x)) for r, x in zip(rows, parts_)]).astype(bool)
            order = np.argsort(h)
            g = h[order]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            n = np.diff(np.append(cut, len(g)))
            level = np.zeros(len(h), np.uint8)
            level[order] = np.repeat(((n > 1) | np.logical_or.reduceat(multi[order], cut)) * (1 + (n > hot)), n)
            ends = np.cumsum([len(x) for x in parts_]).tolist()
            got = [(r[1], zip_(level[e - len(x) : e].tobytes())) for r, x, e in zip(rows, parts_, ends) if level[e - len(x) : e].any()]
            if got:
                c, x = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array([k] * len(c), pa.int32()), pa.array(x, pa.binary()), pa.array([b""] * len(c), pa.binary())], ["chunk", "bucket", "x", "y"])

    rows = offers.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "chunk")
    return rows.mapInArrow(run, "chunk long, bucket int, x binary, y binary")


def _by_chunk(chunks: DataFrame, notes: DataFrame, parts: int) -> DataFrame:
    """Notes and then the text of each chunk, in one partition and in that order."""
    none = F.lit(None).cast("binary")
    a = notes.select("chunk", F.lit(0).alias("kind"), "bucket", "x", "y", none.alias("z"), none.alias("rest"))
    b = chunks.select("chunk", F.lit(1).alias("kind"), F.lit(0).alias("bucket"), F.col("ids").alias("x"), F.col("lens").alias("y"), "z", "rest")
    even = F.pmod(F.shiftright("chunk", 24) + 7919 * F.col("chunk").bitwiseAND((1 << 24) - 1), F.lit(parts)).cast("int")  # chunks of a partition are numbered from 0
    return a.unionAll(b).repartitionById(parts, even).sortWithinPartitions("chunk", "kind")


def _stream(batches):
    """(chunk, notes, ids, lens, z, rest) from the sorted stream of _by_chunk."""
    notes: list = []
    for b in batches:
        for chunk, kind, bucket, x, y, z, rest in zip(*[c.to_pylist() for c in b.columns]):
            if kind == 0:
                notes.append((bucket, x, y))
            else:
                yield chunk, notes, x, y, z, rest
                notes = []


_LOCAL = -2  # in place of a bucket: what a shard found within itself
_PIECES = "shard int, hot int, chunk long, z binary, size binary, key binary, docs binary, at binary"
_FOUND = "chunk long, bucket int, x binary, y binary, anchor long, id long, run binary, low long"


def chunk_pieces(chunk: int, notes: list, ids: bytes, lens: bytes, z: bytes, buckets: int, width: int, block: int, salts: int) -> Iterator[tuple]:
    """A shard's rows of ``_PIECES``: by bucket the sorted list of the runs of its
    representative windows, and one row that leads its other windows to these."""
    text, own, real = _texts(z, ids, lens)
    start, count, code = _anchored(text, own, width, buckets)
    names, inv = np.unique(code, return_inverse=True)
    level = np.zeros(len(names), np.uint8)
    for bucket, x, _ in notes:
        lo, hi = np.searchsorted(names, np.array([bucket, bucket + 1], np.uint64) << np.uint64(32))
        level[lo:hi] = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    level = level[inv]
    use = level > 0
    start, count, code, level = start[use], count[use], code[use], level[use]
    if not len(start):
        return
    pos, run = np.repeat(start, count) + _ramp(count), np.repeat(np.arange(len(start)), count)
    first = np.flatnonzero(np.concatenate([[True], np.diff(pos) != 1]))  # regions of windows, end to end for the suffix array
    n = np.diff(np.append(first, len(pos)))
    size = n + width - 1
    body = text[np.repeat(pos[first], size) + _ramp(size)]
    rep = window_reps(body, np.repeat(np.cumsum(size) - size, n) + _ramp(n), real[own[pos]], width, block)
    mine = rep == np.arange(len(pos))
    if not mine.all():
        p, r = pos[~mine], pos[rep[~mine]]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(r) != 1)]))
        local = np.stack([p[cut], np.diff(np.append(cut, len(p))), r[cut]]).astype(np.uint32)
        yield chunk % buckets, _LOCAL, chunk, b"", squeeze(local.ravel()), b"", b"", b""
    p, r = pos[mine], run[mine]
    span = width - GRAM + 1
    new = np.concatenate([[True], (np.diff(p) != 1) | (r[1:] != r[:-1])])
    new |= (np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))) % span == 0  # a gram that comes again and again makes long runs
    cut = np.flatnonzero(new)
    start, n, r = p[cut], np.diff(np.append(cut, len(p))), r[cut]
    code, hot = code[r], level[r] > 1
    keys = _keys(text, start, n + width - 1, width + span - 1)
    group = code | (hot.astype(np.uint64) << np.uint64(63))
    order = np.argsort(group)
    same = group[order][1:] == group[order][:-1]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    order[tied] = order[tied][np.lexsort((keys[order[tied]], group[order[tied]]))]
    start, n, group, keys = start[order], n[order], group[order], keys[order]
    docs, rows = real[own[start]], keys.view(np.uint8).reshape(len(keys), -1)[:, :-2]
    inside = np.arange(rows.shape[1]) < (n + width - 1)[:, None]
    part = group >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    zip_ = zstandard.ZstdCompressor(level=3).compress
    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
        bucket, is_hot = int(part[s]) & 0x7FFFFFFF, bool(int(part[s]) >> 31)
        shard = (bucket + (chunk * 2654435761 >> 12) % salts * max(1, buckets // salts)) % buckets if is_hot else bucket
        yield shard, bucket if is_hot else -1, chunk, zip_(rows[s:e][inside[s:e]].tobytes()), squeeze(n[s:e].astype(np.uint16)), squeeze(np.diff(group[s:e].astype(np.uint32), prepend=np.uint32(0))), squeeze(docs[s:e]), squeeze(start[s:e].astype(np.uint32))


class _Lists:
    """The runs of several shards' lists, merged: ``same`` names for each run the
    one that stands for it, ``order`` has these sorted by anchor and bytes."""

    def __init__(self, rows: list, width: int):
        unzip, span = zstandard.ZstdDecompressor().decompress, width - GRAM + 1
        sizes = [expand(r[4], np.uint16) for r in rows]
        self.text = np.frombuffer(b"".join([unzip(r[3]) for r in rows]), np.uint8)
        self.n = np.concatenate(sizes).astype(np.int64)
        self.key = np.concatenate([np.cumsum(expand(r[5], np.uint32), dtype=np.uint32) for r in rows])
        self.docs = np.concatenate([expand(r[6], np.int64) for r in rows])
        self.at = np.concatenate([expand(r[7], np.uint32) for r in rows]).astype(np.int64)
        self.who = np.repeat(np.arange(len(rows)), [len(x) for x in sizes])
        self.size = self.n + width - 1
        self.off = np.cumsum(self.size) - self.size
        keys = _keys(self.text, self.off, self.size, width + span - 1, self.key)
        self.same, self.order = unify(keys, np.cumsum([0, *map(len, sizes)]).tolist())
        low = self.docs.copy()
        np.minimum.at(low, self.same, self.docs)
        self.low = low[self.order]

    def bytes_of(self, runs: np.ndarray) -> np.ndarray:
        size = self.size[runs]
        return self.text[np.repeat(self.off[runs], size) + _ramp(size)]


def _segments(body: np.ndarray, n: np.ndarray, low_doc: np.ndarray, width: int, block: int):
    """Runs end to end, as (run, offset, windows, smallest document) of stretches with one answer."""
    size = n + width - 1
    starts = np.repeat(np.cumsum(size) - size, n) + _ramp(n)
    low = window_minima(body, starts, np.repeat(low_doc, n), width, block)
    row, offset = np.repeat(np.arange(len(n)), n), _ramp(n)
    cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])]))
    return row[cut], offset[cut], np.diff(np.append(cut, len(low))), low[cut]


def shard_minima(rows: list, width: int, block: int) -> Iterator[tuple]:
    """Of a bucket's lists, per chunk where the smallest document of a window is
    another one: chunk, positions and windows, documents."""
    m = _Lists(rows, width)
    count, key = len(m.order), m.key[m.order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(edge[1:], count)
    many = np.repeat(ends - edge > 1, ends - edge)
    alone = np.flatnonzero(~many)
    segs = [(alone, np.zeros(len(alone), np.int64), m.n[m.order[alone]], m.low[alone])]
    rivals = np.flatnonzero(many)  # runs of one anchor that agree in part at most
    done, stop = np.cumsum(m.size[m.order[rivals]]), np.searchsorted(rivals, ends[ends - edge > 1] - 1, "right")
    lo = 0
    while lo < len(rivals):  # whole anchors, as many as fit a suffix array
        fit = stop[(stop > lo) & (done[stop - 1] <= (done[lo - 1] if lo else 0) + block)]
        hi = int(fit[-1]) if len(fit) else int(stop[stop > lo][0])
        pick, lo = rivals[lo:hi], hi
        row, offset, n, low = _segments(m.bytes_of(m.order[pick]), m.n[m.order[pick]], m.low[pick], width, block)
        segs.append((pick[row], offset, n, low))
    run, off, length, low = (np.concatenate(x) for x in zip(*segs))
    by = np.argsort(run, kind="stable")
    off, length, low = off[by], length[by], low[by]
    times = np.bincount(run, minlength=count)
    place = np.empty(len(m.same), np.int64)
    place[m.order] = np.arange(count)
    mine = place[m.same]  # a run of a chunk takes the stretches of the run that stands for it
    own = np.repeat(np.arange(len(mine)), times[mine])
    seg = np.repeat((np.cumsum(times) - times)[mine], times[mine]) + _ramp(times[mine])
    need = low[seg] < m.docs[own]
    own, seg = own[need], seg[need]
    if len(own):
        yield from _by_owner(m.who[own], [r[2] for r in rows], m.at[own] + off[seg], length[seg], low[seg])


def _by_owner(who: np.ndarray, names: list, pos: np.ndarray, n: np.ndarray, low: np.ndarray) -> Iterator[tuple]:
    by = np.lexsort((pos, who))
    at = np.flatnonzero(np.concatenate([[True], who[by][1:] != who[by][:-1]]))
    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(by)]):
        b = by[s:e]
        yield names[int(who[b[0]])], squeeze(np.concatenate([pos[b], n[b]]).astype(np.uint32)), squeeze(low[b])


def shard_combined(rows: list, width: int) -> Iterator[tuple]:
    """Of a hot anchor's lists, each distinct run with its smallest document and
    the chunks, places and documents that it stands for: x, y, anchor, run, low."""
    m = _Lists(rows, width)
    by = np.argsort(m.same, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], m.same[by][1:] != m.same[by][:-1]]))
    place = np.empty(len(m.same), np.int64)
    place[m.order] = np.arange(len(m.order))
    chunk = np.array([r[2] for r in rows], np.int64)
    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(by)]):
        b, head = by[s:e], int(m.same[by[s]])
        yield squeeze(np.concatenate([chunk[m.who[b]], m.docs[b]])), squeeze(m.at[b].astype(np.uint32)), rows[0][1] << 32 | int(m.key[head]), m.text[m.off[head] : m.off[head] + m.size[head]].tobytes(), int(m.low[place[head]])


def _pieces(rows: DataFrame, *args) -> DataFrame:
    def run(batches):
        names = [c.split()[0] for c in _PIECES.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        for chunk, notes, ids, lens, z, _ in _stream(batches):
            got = list(chunk_pieces(chunk, notes, ids, lens, z, *args)) if notes else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names)

    return rows.mapInArrow(run, _PIECES)


def _minima(pieces: DataFrame, parts: int, width: int, block: int) -> DataFrame:
    """Rows of ``_FOUND``, one bucket in memory at a time: notes for the chunks, or combined runs of hot anchors."""

    def run(batches):
        from pyspark import TaskContext

        names = [c.split()[0] for c in _FOUND.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        no = TaskContext.get().partitionId() << 36
        for (shard, hot), rows in runs_of(batches, ("shard", "hot")):
            if hot == _LOCAL:
                got = [(r[2], _LOCAL, r[4], b"", None, None, None, None) for r in rows]
            elif hot == -1:
                got = [(c, shard, x, y, None, None, None, None) for c, x, y in shard_minima(rows, width, block)]
            else:
                got = [(None, hot, x, y, a, no + i, t, low) for i, (x, y, a, t, low) in enumerate(shard_combined(rows, width))]
                no += len(got)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names)

    return pieces.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "hot", "chunk").mapInArrow(run, _FOUND)


def _hot_notes(hot: DataFrame, parts: int, width: int, block: int) -> DataFrame:
    """Notes from the combined runs of hot anchors: the lists of all groups of
    shards are compared by anchor, and every run's answer goes back to its chunks."""

    def compare(batches):
        for _, rows in runs_of(batches, ("anchor",)):
            n = np.array([len(r[2]) - width + 1 for r in rows])
            run, off, length, low = _segments(np.frombuffer(b"".join([r[2] for r in rows]), np.uint8), n, np.array([r[3] for r in rows], np.int64), width, block)
            cut = np.searchsorted(run, np.arange(len(rows) + 1)).tolist()
            got = [(r[1], squeeze(np.concatenate([off[s:e], length[s:e]]).astype(np.uint32)), squeeze(low[s:e])) for r, s, e in zip(rows, cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), (pa.int64(), pa.binary(), pa.binary()))], ["id", "seg", "lows"])

    def back(batches):
        held: list[list] = [[], [], [], []]
        schema = ["chunk", "bucket", "x", "y"]

        def out():
            chunk, pos, n, low = (np.concatenate(h) for h in held)
            names, who = np.unique(chunk, return_inverse=True)
            got = list(_by_owner(who, names.tolist(), pos, n, low))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([0] * len(got), pa.int32()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.binary())], schema)

        for b in batches:
            for x, y, seg, lows in zip(*[b.column(c).to_pylist() for c in ("x", "y", "seg", "lows")]):
                chunk, doc = expand(x, np.int64).reshape(2, -1)
                at, (off, n), low = expand(y, np.uint32).astype(np.int64), expand(seg, np.uint32).astype(np.int64).reshape(2, -1), expand(lows, np.int64)
                i, j = np.nonzero(low[None, :] < doc[:, None])
                if len(i):
                    for h, v in zip(held, (chunk[i], at[i] + off[j], n[j], low[j])):
                        h.append(v)
                if sum(map(len, held[0])) > 200_000:
                    yield out()
                    held = [[], [], [], []]
        if held[0]:
            yield out()

    done = hot.select("anchor", "id", "run", "low").repartition(parts, "anchor").sortWithinPartitions("anchor", "id").mapInArrow(compare, "id long, seg binary, lows binary")
    return hot.select("id", "x", "y").join(done.hint("merge"), "id").select("x", "y", "seg", "lows").mapInArrow(back, "chunk long, bucket int, x binary, y binary")


def _removed(notes, ids: bytes, lens: bytes, z: bytes, width: int):
    """text, ids, and per document its start, end and mask of removed bytes."""
    data = zstandard.ZstdDecompressor().decompress(z)
    real, size = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
    ends = np.cumsum(size)
    gone = np.zeros(len(data), bool)
    if notes:
        own = np.repeat(np.arange(len(size), dtype=np.int32), size)
        low, seen = np.full(len(data), _FAR), []
        for k, x, y in sorted(notes, key=lambda n: n[0] == _LOCAL):
            if k == _LOCAL:  # windows that equal a representative, whose own answer is there by now
                pos, n, to = expand(x, np.uint32).astype(np.int64).reshape(3, -1)
                at, to = np.repeat(pos, n) + _ramp(n), np.repeat(to, n) + _ramp(n)
                low[at] = np.minimum(low[to], real[own[to]])
            else:
                pos, n = expand(x, np.uint32).astype(np.int64).reshape(2, -1)
                at = np.repeat(pos, n) + _ramp(n)
                low[at] = np.repeat(expand(y, np.int64), n)
            seen.append(at)
        at = np.concatenate(seen)
        begun = np.zeros(len(data) + width, np.int32)
        begun[at[low[at] < real[own[at]]] + width] = 1
        np.cumsum(begun, out=begun)
        gone = begun[width:] > begun[: len(data)]  # a removed window began within the last ``width`` bytes
    for i, e, n in zip(real.tolist(), ends.tolist(), size.tolist()):
        g = gone[e - n : e]
        part = data[e - n : e]
        yield i, n, g, np.frombuffer(part, np.uint8)[~g].tobytes() if g.any() else part


def _cut(rows: DataFrame, width: int, with_kept: bool) -> DataFrame:
    def run(batches):
        for _, notes, ids, lens, z, _ in _stream(batches):
            out: list[list] = [[] for _ in range(7)]
            for i, n, g, kept in _removed(notes, ids, lens, z, width):
                spans = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))).reshape(-1, 2).tolist() if g.any() else []
                for c, v in zip(out, (i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_kept else None, spans if with_kept else None)):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            k = 7 if with_kept else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:k], kinds)], names[:k])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(run, schema + ", kept binary, spans array<array<long>>" * with_kept)


def _shortened(rows: DataFrame, width: int, schema, columns: list[str]) -> DataFrame:
    """The documents again: text as kept (bytes of cut characters go), n_chars as its length."""

    def run(batches):
        for _, notes, ids, lens, z, rest in _stream(batches):
            blob = zstandard.ZstdDecompressor().decompress(rest)
            table = pa.ipc.open_stream(blob).read_all().combine_chunks()
            null = table.column(table.num_columns - 1).to_pylist()
            texts = [None if x else kept.decode(errors="ignore") for x, (_, _, _, kept) in zip(null, _removed(notes, ids, lens, z, width))]
            cols = {c: table.column(k) for k, c in enumerate(columns)}
            cols["doc_id"] = pa.array(np.frombuffer(ids, np.int64))
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            yield from pa.table([cols[f.name] for f in schema.fields], [f.name for f in schema.fields]).to_batches(max_chunksize=512)

    return rows.mapInArrow(run, schema)


def _found(scratch: Scratch, base: DataFrame, width: int, rest: list[str] | None, sizes: tuple | None) -> DataFrame:
    parts = partitions(scratch.spark)
    chunk, block, hot = sizes or (chunk_bytes(parts, CHUNK, MOST, 10), BLOCK, HOT)
    chunks = scratch.write(_pack(base, rest, chunk), "chunks")
    total, count = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    buckets, salts = max(parts, -(-total // (8 * chunk))), max(1, -(-count // hot))
    shared = _shared(_offer(chunks, buckets, width), parts, hot)
    pieces = _pieces(_by_chunk(chunks.withColumn("rest", F.lit(None).cast("binary")), shared, parts), buckets, width, block, salts)
    found = scratch.write(_minima(pieces, parts, width, block), "found")
    notes = found.where("chunk is not null").select("chunk", "bucket", "x", "y")
    if count > hot:  # else no anchor can be hot
        notes = notes.unionAll(_hot_notes(found.where("chunk is null"), parts, width, block))
    return _by_chunk(chunks, notes, parts)


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = 50, with_kept: bool = False, sizes: tuple | None = None) -> DataFrame:
    """Removes bytes covered by a ``width``-byte string that also starts in a
    document of a smaller doc_id, of every whole text of ``docs(doc_id, text)``.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request,
    kept (binary) and spans ([start, end) pairs). Null texts count as empty;
    texts shorter than ``width`` bytes are kept whole; repeated rows of one
    doc_id do not remove each other; rows with a null doc_id are kept whole and
    remove nothing; an empty table gives no rows. ``sizes``: bytes of a shard and of
    a suffix array, and how many shards make an anchor hot; they change speed
    and memory only. A document is held whole.
    """
    if width < GRAM + 1:
        raise ValueError(f"width must be over {GRAM}")
    scratch = Scratch(spark, "suffix")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _cut(_found(scratch, base.where("doc_id is not null"), width, None, sizes), width, with_kept)
    whole = base.where("doc_id is null").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    size = F.octet_length("kept").cast("long")
    whole = whole.select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *([F.col("kept"), F.array().cast("array<array<long>>").alias("spans")] if with_kept else []))
    return out.unionByName(whole)


def without_repeats(spark: SparkSession, docs: DataFrame, width: int = 50) -> DataFrame:
    """The rows of ``docs``, texts without what ``remove_repeats`` removes.

    All columns stay; n_chars, if there is one, becomes the length of the text
    that is left. A text that goes entirely is left empty; null texts stay null.
    """
    scratch = Scratch(spark, "repeats")
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select(*docs.columns)
    base = whole.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *columns)
    out = _shortened(_found(scratch, base, width, columns, None), width, base.select(*docs.columns).schema, columns)
    return out.unionByName(whole.where("doc_id is null"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, substr(x, 2 * i - 1, 100) as win from d, unnest(generate_series(1, n - 49)) as t(i) where n >= 50),
m as (select win, min(doc_id) as first from w group by 1),
h as (select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before
  from w join m using (win) where first < doc_id),
b as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as span from h),
s as (select doc_id, span, min(i) as lo, max(i) + 49 as hi from b group by 1, 2),
k as (select d.doc_id, x, n, lo, hi, lag(hi, 1, 0) over (partition by d.doc_id order by lo) as prev from d left join s using (doc_id)),
g as (select doc_id, any_value(x) as x, any_value(n) as n, coalesce(sum(hi - lo + 1), 0) as gone, count(lo) as n_spans,
  coalesce(string_agg(substr(x, 2 * prev + 1, 2 * (lo - prev - 1)), '' order by lo), '') as head, coalesce(max(hi), 0) as tail from k group by 1)
select doc_id, cast(n as bigint) as n_bytes, cast(gone as bigint) as n_removed, n_spans, sha256(unhex(head || substr(x, 2 * tail + 1))) as kept_sha256 from g
"""
