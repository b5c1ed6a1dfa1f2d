"""Operator 4: byte-level BPE encoding and decoding.

A pre-token is first looked up whole through a minimal perfect hash over the
vocabulary (displacements found per bucket, singles placed directly); only
pre-tokens that are not in the vocabulary are merged, by a heap of candidate
pairs over doubly linked byte positions.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import ship, slices

_M = (1 << 64) - 1
_C1, _C2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Entries of the pre-token memo of a worker. When it is full a new one is begun,
#: and the old one is asked for what the new one lacks.
MEMO = 300_000


def _slot(h: int, d: int, n: int) -> int:
    return ((((h ^ (d * _C1)) * _C2) & _M) >> 29) % n


class PerfectHash:
    """Minimal perfect hash: key -> slot in [0, n), each slot holds key and rank."""

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = max(1, len(ranks))
        nb = self.buckets = max(1, n // 2)
        byb: list[list[tuple[int, bytes]]] = [[] for _ in range(nb)]
        for k in sorted(ranks):
            h = xxhash.xxh3_64_intdigest(k)
            byb[h % nb].append((h, k))
        self.disp = [0] * nb
        self.keys: list[bytes | None] = [None] * n
        self.rank = [-1] * n
        order = sorted(range(nb), key=lambda i: -len(byb[i]))
        for i in order:
            if len(byb[i]) <= 1:
                break
            d = 1
            while True:
                got = [_slot(h, d, n) for h, _ in byb[i]]
                if len(set(got)) == len(got) and all(self.keys[s] is None for s in got):
                    break
                d += 1
            self.disp[i] = d
            for s, (_, k) in zip(got, byb[i]):
                self.keys[s], self.rank[s] = k, ranks[k]
        free = (s for s in range(n) if self.keys[s] is None)
        for i in order:
            if len(byb[i]) == 1:
                s = next(free)
                self.disp[i] = -s - 1
                self.keys[s], self.rank[s] = byb[i][0][1], ranks[byb[i][0][1]]

    def __getstate__(self):  # as arrays, which workers read faster than lists
        return self.n, self.buckets, b"".join(self.keys), *[np.array(x, np.int64) for x in ([len(k) for k in self.keys], self.disp, self.rank)]

    def __setstate__(self, state):
        self.n, self.buckets, keys, size, disp, rank = state
        ends = np.cumsum(size).tolist()
        self.keys = [keys[e - k : e] for e, k in zip(ends, size.tolist())]
        self.disp, self.rank = disp.tolist(), rank.tolist()

    def get(self, key: bytes) -> int:
        """The rank of ``key``, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.disp[h % self.buckets]
        s = -d - 1 if d < 0 else _slot(h, d, self.n)
        return self.rank[s] if self.keys[s] == key else -1


class Codec:
    """Encoder and decoder over the ranks of one vocabulary.

    ``space`` in ``pattern`` follows the Unicode White_Space property, as the
    reference tokenizers' regular expressions do.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table = PerfectHash(ranks)
        self.pattern = pattern
        self.words: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.words[r] = k
        self._open()

    def _open(self) -> None:
        import regex

        white = r"\t-\r \x85\xa0  -     　"
        text = self.pattern.replace(r"[^\s", "[^" + white).replace(r"(?!\S)", f"(?![^{white}])").replace(r"\s", f"[{white}]")
        self.split = regex.compile(text).findall
        self.memo: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.parts = {k: r for r, k in enumerate(self.words) if k}  # for the many lookups within a merge

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "aged", "parts")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def merge(self, data: bytes) -> list[int]:
        """Heap merge: lowest rank first, ties to the left."""
        get, n = self.parts.get, len(data)
        end = list(range(1, n + 1))  # a part at i spans data[i:end[i]]; dead parts have end 0
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != to:
                continue  # stale: one of the two parts has grown or gone
            end[i], end[mid] = to, 0
            if to < n:
                prev[to] = i
                stop = end[to]
                if (r := get(data[i:stop])) is not None:
                    heapq.heappush(heap, (r, i, stop))
            if (p := prev[i]) >= 0 and (r := get(data[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(get(data[i : end[i]], -1))
            i = end[i]
        return out

    def word(self, token: str) -> bytes:
        ids = self.aged.get(token)
        if ids is None:
            data = token.encode()
            r = self.table.get(data)
            got = [r] if r >= 0 else self.merge(data)
            ids = struct.pack(f"<{len(got)}I", *got)
        if len(token) <= 64:
            if len(self.memo) >= MEMO:
                self.aged, self.memo = self.memo, {}
            self.memo[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        memo, word = self.memo, self.word
        out = []
        for t in self.split(text):
            ids = memo.get(t)
            if ids is None:
                ids = word(t)
                memo = self.memo
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_documents(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole ``text`` of ``docs``.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, the
    ids (binary, little-endian unsigned 32-bit). A null text counts as empty
    (no ids); repeated rows give repeated rows; null doc_ids are kept; an empty
    table gives an empty result. Columns other than doc_id and text are ignored.
    The vocabulary (fixed size) is the only thing broadcast.
    """
    ship(spark)
    model = spark.sparkContext.broadcast(Codec(ranks, pattern))

    def run(batches):
        codec = model.value
        for part in slices(batches, 512):
            n, ih, dh, raw = [], [], [], []
            for text in part.column(1).to_pylist():
                ids = codec.encode(text or "")
                n.append(len(ids) // 4)
                ih.append(hashlib.sha256(ids).hexdigest())
                dh.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                raw.append(ids)
            cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ih, pa.string()), pa.array(dh, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def production_codec() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), *production_codec())
