"""Operators against brute force on small tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from sparkloom.llm import bpe, chat, forest, interpolated, kdtree, minhash, mixing, quality, suffix, warc

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def oracle(name, columns):
    import os

    import duckdb

    from sparkloom.llm import SQL

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    got = con.sql(SQL[name])
    at = [got.columns.index(c) for c in columns]
    return sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", ["op1_kdtree", "op2_warc", "op3_forest", "op8_suffix_array", "op9_chat", "op10_minhash"])
def test_against_sql(spark, name):
    from sparkloom.llm import QUERIES

    df = QUERIES[name](spark, SMALL)
    assert sorted(map(tuple, df.collect()), key=str) == oracle(name, df.columns)


def test_minhash_in_small_blocks(spark, monkeypatch):
    """Buckets of many blocks, whose rows are mostly in one component."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):  # near copies at distances round the threshold
        w = list(words)
        for j in rng.choice(60, rng.integers(0, 9), replace=False).tolist():
            w[5 * j] = f"x{i}.{j}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [minhash.exact_sets(t) for _, t in rows]
    assert {i: r.component_id for i, r in got.items()} == groups(sets, 85) and len({r.component_id for r in got.values()}) > 1


def groups(sets, percent):
    """The smallest member of each set's component, by comparing all pairs."""
    low = list(range(len(sets)))
    links = [(i, j) for j in range(len(sets)) for i in range(j) if (n := len(sets[i] & sets[j])) and 100 * n >= percent * len(sets[i] | sets[j])]
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return dict(enumerate(low))


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "QUERY_ROWS", 4)
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 90)
    df = kdtree.op1_kdtree(spark, SMALL)
    assert sorted(map(tuple, df.collect()), key=str) == oracle("op1_kdtree", df.columns)


def test_bpe_against_tiktoken(spark, texts, docs):
    import tiktoken

    ranks, pattern = bpe.production_codec()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, pattern)
    assert all(codec.table.get(k) == r for k, r in ranks.items()) and sorted(x for x in codec.table.rank) == sorted(ranks.values())
    for text in ["", " ", "a\x1cb\x85c 　d", "x" * 3000, "<|endoftext|> it's\r\n\n  \t", "\U0001F600́", "\x00\x00", *texts.values()]:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == own.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()
    for r in bpe.encode_documents(spark, docs, ranks, pattern, with_ids=True).collect():
        ids = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, bytes(r.ids)) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_quality_accuracy(spark):
    got = {r.doc_id: r for r in quality.op5_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    held = [(got[i], y) for i, y in labels if i in got and got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([r.predicted == y for r, y in held]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine()
    m.v = rng.normal(size=m.v.shape)
    idx, x = rng.choice(quality.SIZE, 12, replace=False), rng.normal(size=12)
    pairs = sum(m.v[idx[a]] @ m.v[idx[b]] * x[a] * x[b] for a in range(12) for b in range(a))
    assert math.isclose(m.margin(idx, x), m.b + x @ m.w[idx] + pairs, rel_tol=1e-9)


def test_language_model(spark, docs, texts):
    tok = {i: [w for w in t.encode().lower().split()] + [None] for i, t in texts.items()}
    one, two = collections.Counter(), collections.Counter()
    for i, w in tok.items():
        if zlib.crc32(str(i).encode()) % 10:
            one.update(w)
            two.update(zip([None] + w, w))
    n, v = sum(one.values()), len(one)
    rows = {r.doc_id: r for r in interpolated.score_texts(spark, docs).collect()}
    # the weights by plain expectation-maximisation over the tokens, each without its own document
    seen = collections.defaultdict(list)
    for i, w in tok.items():
        if zlib.crc32(str(i).encode()) % 10:
            a, b = collections.Counter(w), collections.Counter(zip([None] + w, w))
            for prev, cur in zip([None] + w, w):
                c = one[prev] - a[prev]
                cls = int(interpolated.context_class(np.array([c]))[0])
                seen[cls].append(((two[prev, cur] - b[prev, cur]) / c if c else 0, (one[cur] - a[cur]) / (n - len(w)), 1 / (v + 1)))
    lam = {}
    for cls, p in seen.items():
        p, w = np.array(p), np.array([0, 0.5, 0.5]) if cls == 0 else np.ones(3) / 3
        for _ in range(interpolated.ROUNDS):
            post = p * w
            w = (post / post.sum(1, keepdims=True)).mean(0)
        lam[cls] = w
    for i, w in tok.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), n) and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        plain = 0.0
        for prev, cur in zip([None] + w, w):
            m = lam[int(interpolated.context_class(np.array([one[prev]]))[0])]
            plain += math.log10(max(1e-12, m[0] * (two[prev, cur] / one[prev] if one[prev] else 0) + m[1] * one[cur] / n + m[2] / (v + 1)))
        assert abs(r.score - plain) < 0.03 * abs(plain) + 1
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_any_id(spark):
    """The smallest long is an id like any other: its text is learned from, or held out."""
    low = -(1 << 63)
    df = spark.createDataFrame([(low, "one two"), (None, "one three"), (low + 1, "two")], "doc_id long, text string")
    got = {r.doc_id: r for r in interpolated.score_texts(spark, df).collect()}
    learned = [i for i in (low, low + 1) if interpolated.learns(i)]
    assert set(got) == {low, low + 1, None} and {r.train_tokens for r in got.values()} == {sum(got[i].n_tokens for i in learned)} and learned
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0) for i in (low, low + 1)) and not got[None].held_out


def test_language_model_in_small_chunks(spark, docs, monkeypatch):
    whole = sorted(map(tuple, interpolated.score_texts(spark, docs).collect()))
    monkeypatch.setattr(interpolated, "chunk_bytes", lambda *a: 3000)
    small = sorted(map(tuple, interpolated.score_texts(spark, docs).collect()))
    for a, b in zip(whole, small):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_mixing(spark, docs):
    labelled = mixing.labelled_domains(spark, docs, SMALL)
    target = mixing.tempered(0.7, False)
    got = mixing.mix(spark, docs, labelled, target).collect()
    assert len(got) == docs.count() and min(r.rate for r in got) >= 0
    model = mixing.fit_domains(spark, docs, labelled)
    p = np.array([model.posterior(mixing._indices(t, mixing._Buckets())) for t in [r.text for r in docs.orderBy("doc_id").collect()]])
    got.sort(key=lambda r: r.doc_id)
    tokens, rate = np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    want = target(tokens @ p)
    assert np.abs((tokens * rate) @ p - want).max() < 1e-3 * want.sum()


def memberships(spark, shares, hard):
    rng = np.random.default_rng(1)
    kind = np.repeat(np.arange(len(shares)), [max(3, round(30_000 * s)) for s in shares])
    z = rng.normal(0, 1, (len(kind), len(shares))) + 8 * np.eye(len(shares))[kind] + np.log(shares)
    post = np.eye(len(shares))[kind] if hard else np.exp(z) / np.exp(z).sum(1, keepdims=True)
    tokens = rng.integers(50, 500, len(kind)).astype(float)
    return tokens, post, spark.createDataFrame([(bytearray(tokens.tobytes()), bytearray(post.tobytes()))], "tokens binary, post binary")


@pytest.mark.parametrize("rare", [0.01, 0.001, 0.0001])
@pytest.mark.parametrize("hard,grow_only", [(True, False), (True, True), (False, False)])
def test_mixing_reaches_rare_domains(spark, rare, hard, grow_only):
    tokens, post, table = memberships(spark, [0.61, 0.15, 0.14, 0.1 - rare, rare], hard)
    lowest = 1.0 if grow_only else 0.0
    steps, want, now = mixing.fit_rates(spark, table, list("abcde"), mixing.tempered(0.7, grow_only), lowest)
    rate = mixing.replay(post, steps, lowest)[0]
    assert np.abs((tokens * rate) @ post / want - 1).max() < 1e-4 and np.allclose((tokens * rate) @ post, now) and rate.min() >= lowest
    assert np.allclose(want, mixing.tempered(0.7, grow_only)(tokens @ post))


def test_mixing_ends_at_least_squares(spark):
    """Targets out of reach: the totals are those of plain projected gradients run to the end, with rates at their bound."""
    rng = np.random.default_rng(0)
    post = rng.dirichlet([0.4, 0.5, 0.8, 0.3], 60)
    tokens = rng.integers(5, 90, 60).astype(float)
    table = spark.createDataFrame([(bytearray(tokens[a:b].tobytes()), bytearray(post[a:b].tobytes())) for a, b in ((0, 25), (25, 60))], "tokens binary, post binary")
    goal = tokens @ post * np.array([0.2, *rng.uniform(0.7, 3, 3)])  # the first cannot go under 0.6 of what it has
    with pytest.warns(mixing.TargetsMissed, match="at most this far"):
        steps, want, now = mixing.fit_rates(spark, table, list("abcd"), lambda _: goal, 0.6)
    rate = mixing.replay(post, steps, 0.6)[0]
    scale = mixing._inverse((post * tokens[:, None]).T @ post)
    plain = np.ones(60)
    for _ in range(60_000):
        plain = np.maximum(0.6, plain - post @ (scale @ ((tokens * plain) @ post - goal)))
    assert (plain == 0.6).any() and mixing.STORED < len(steps) < mixing.PASSES and np.allclose((tokens * rate) @ post, now)
    assert (np.abs(now - (tokens * plain) @ post) <= 2 * mixing.SETTLED * goal).all()


def test_mixing_says_that_it_has_not_settled(spark):
    _, _, table = memberships(spark, [0.61, 0.15, 0.14, 0.09, 0.01], False)
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(spark, table, list("abcde"), mixing.tempered(0.7, True), 1.0, passes=2, strict=True)
    with pytest.warns(mixing.TargetsMissed, match="after 3 passes.*at most this far: 'a' "):
        mixing.fit_rates(spark, table, list("abcde"), mixing.tempered(0.7, True), 1.0, passes=3)
    _, want, now = mixing.fit_rates(spark, table, list("abcde"), mixing.tempered(0.7, False), 0.0, stored=1)
    assert np.abs(now / want - 1).max() < 1e-4


def test_mixing_tells_domains(spark):
    """Languages of documents that were not learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    part = docs.where("doc_id % 3 <> 0")
    model = mixing.fit_domains(spark, docs, part.select("doc_id", "lang"))
    rest = docs.where("doc_id % 3 = 0 and n_chars > 200").select("text", "lang").collect()
    right = [model.names[model.posterior(mixing._indices(r.text, mixing._Buckets())).argmax()] == r.lang for r in rest]
    assert len(right) > 100 and np.mean(right) > 0.95


@pytest.mark.parametrize("rare", [3, 40])
def test_mixing_knows_every_domain(spark, rare):
    words = {"common": "the cat sat on a mat", "other": "le chat est sur la table", "rare": "zwei hunde laufen im wald"}
    kinds = ["common"] * 3500 + ["other"] * 500 + ["rare"] * rare
    df = spark.createDataFrame([(i, f"{words[n]} {i}", n) for i, n in enumerate(kinds)], "doc_id long, text string, lang string")
    lost = spark.createDataFrame([(10**6, "gone")], "doc_id long, lang string")
    model = mixing.fit_domains(spark, df, df.select("doc_id", "lang").unionAll(lost), sample_rows=60, floor=40)
    prior = np.array([3501, 501, rare + 1]) / (4003 + rare)
    assert model.names == ["common", "other", "rare"] and np.allclose(np.exp(model.b), prior)
    post = np.array([model.posterior(mixing._indices(t, mixing._Buckets())) for t in words.values()])
    assert post[2, 2] > 50 * prior[2] and (rare < 40 or (post.argmax(1) == [0, 1, 2]).all())


def test_mixing_repeats(spark, docs):
    labelled = mixing.labelled_domains(spark, docs, SMALL)
    out = mixing.mixed_documents(spark, docs, labelled, mixing.tempered(0.7, True))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} and out.count() > docs.count()


@pytest.mark.parametrize("sizes", [(40_000, 3_000, 10**6), (40_000, 3_000, 3), (5_000, 200, 1)])
def test_repeats_in_small_blocks(spark, docs, sizes):
    df = suffix.remove_repeats(spark, docs, sizes=sizes)
    assert sorted(map(tuple, df.collect()), key=str) == oracle("op8_suffix_array", df.columns)


def test_repeats_spans(spark, docs, texts):
    for r in suffix.remove_repeats(spark, docs, with_kept=True).collect():
        data = texts[r.doc_id].encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in r.spans]], [*[s for s, _ in r.spans], len(data)]))
        assert bytes(r.kept) == kept and r.n_removed == len(data) - len(kept) and r.n_spans == len(r.spans)


def test_lists_merge_by_search():
    rng = np.random.default_rng(6)
    lists = [np.unique(np.array([b"%03d" % n for n in rng.integers(0, 300, size)] or [], "S3")) for size in (0, 90, 200, 1, 150)]
    keys = np.concatenate(lists)
    same, order = suffix.unify(keys, np.cumsum([0, *map(len, lists)]).tolist())
    assert (keys[same] == keys).all() and keys[order].tolist() == sorted(set(keys.tolist())) and set(same) == set(order)


@pytest.mark.parametrize("block", [150, 1 << 20])
def test_windows_of_a_shard(block):
    """Representatives against a dictionary, in one suffix array and in blocks merged by search."""
    rng = np.random.default_rng(block)
    runs = [rng.integers(0, 3, n).astype(np.uint8) for n in (60, 90, 75, 52, 120)]
    runs += [runs[1][5:80], np.concatenate([runs[0][:55], runs[4][:60]]), np.zeros(90, np.uint8)]
    text, size = np.concatenate(runs), np.array([len(r) for r in runs])
    n = size - 49
    start = np.repeat(np.cumsum(size) - size, n) + suffix._ramp(n)
    doc = np.repeat(rng.permutation(len(runs)), n)
    first = {}
    for i, (s, d) in enumerate(zip(start, doc)):
        w = text[s : s + 50].tobytes()
        first[w] = min(first.get(w, (d, i)), (d, i))
    want = [first[text[s : s + 50].tobytes()][1] for s in start]
    assert suffix.window_reps(text, start, doc, 50, block).tolist() == want


def test_shards_meet_in_buckets():
    """The lists of two shards go through the search that merges them, and what agrees in part through a suffix array."""
    import zstandard

    rng = np.random.default_rng(8)
    common = bytes(rng.integers(97, 123, 400).astype(np.uint8))
    texts = {0: [(7, b"x" * 30 + common), (9, common[100:300])], 1: [(3, common[40:390] + b"y" * 60), (8, b"nothing of it" * 9)]}
    zip_ = zstandard.ZstdCompressor().compress
    found, lists = {}, {}
    for chunk, docs in texts.items():
        ids, lens = np.array([i for i, _ in docs]).tobytes(), np.array([len(t) for _, t in docs]).tobytes()
        z = zip_(b"".join(t for _, t in docs))
        text, own, _ = suffix._texts(z, ids, lens)
        shared = np.unique(suffix._anchored(text, own, 50, 4)[2])
        notes = [(k, zip_(np.ones(((shared >> np.uint64(32)) == k).sum(), np.uint8).tobytes()), b"") for k in range(4)]
        rows = list(suffix.chunk_pieces(chunk, notes, ids, lens, z, 4, 50, 1 << 20, 1))
        found[chunk] = (ids, lens, z, [(r[1], r[4], b"") for r in rows if r[1] == suffix._LOCAL])
        for r in rows:
            if r[1] == -1:
                lists.setdefault(r[0], []).append(r)
    assert any(len(rows) == 2 for rows in lists.values())
    for rows in lists.values():
        for chunk, x, y in suffix.shard_minima(rows, 50, 1 << 20):
            found[chunk][3].append((0, x, y))
    kept = {i: k for ids, lens, z, notes in found.values() for i, _, _, k in suffix._removed(notes, ids, lens, z, 50)}
    assert kept == {7: b"x" * 30 + common[:40] + common[390:], 9: b"", 3: texts[1][0][1], 8: texts[1][1][1]}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for letters, n in ((1, 300), (2, 900), (4, 1500), (250, 900)):
        t = rng.integers(0, letters, n).astype(np.uint8)
        t[n // 2 : n // 2 + 120] = t[10:130]
        b, (sa, _) = t.tobytes(), suffix.suffix_array(t, 50)
        assert sorted(sa.tolist()) == list(range(n)) and all(b[i : i + 50] <= b[j : j + 50] for i, j in zip(sa, sa[1:]))
        lcp = suffix.kasai(t, sa, 50, lanes=32)
        for k in range(1, n):
            x, y = b[sa[k - 1] :][:50], b[sa[k] :][:50]
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_chat_round_trip(spark):
    import random

    rng = random.Random(3)
    parts = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", ">", "\n", "a", "<\\|", "im_end|>", "<|"]
    for _ in range(5000):
        turns = [("".join(rng.choices(parts, k=rng.randrange(4))), "".join(rng.choices(parts, k=rng.randrange(7)))) for _ in range(3)]
        assert [t[:2] for t in chat.parse("".join(chat.render_turn(*t) for t in turns))] == turns
    assert chat.parse("nonsense") is None
    rows = chat.format_conversations(spark, spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a <|im_end|>")], "conv_id long, turn long, role string, text string"), with_text=True).orderBy("turn_no").collect()
    assert rows[0].loss_start is None and chat.unescape(rows[1].rendered[rows[1].loss_start : rows[1].loss_end]) == "a <|im_end|>"


def test_warc_shards_are_even(spark):
    """Ids bunched in a corner, one id of a third of all rows, rows without id: no shard far over its share."""
    rng = np.random.default_rng(3)
    rows = [(int(i), f"{rng.bytes(32).hex()}") for i in rng.integers(10**12, 10**12 + 3000, 3000)] + [(-(10**15), "ab" * 32), (10**18, "cd" * 32)]
    rows += [(5, f"{rng.bytes(32).hex()}") for _ in range(3000)] + [(None, f"{rng.bytes(32).hex()}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, payload_digest string").selectExpr("*", "1000L as size")
    shard, n = warc.shard_of(df)
    got = df.withColumn("s", shard).collect()
    sizes = collections.Counter(r.s for r in got)
    assert set(sizes) == set(range(n)) and max(sizes.values()) <= 2.3 * len(rows) / 8 and n >= 6
    order = sorted(got, key=lambda r: (r.page_id is not None, r.page_id or 0, int(r.payload_digest[:8], 16)))
    assert [r.s for r in order] == sorted(r.s for r in got)


def test_warc_files(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = []
    for k in (1, 2):
        m = warc.write_archives(spark, pages.repartition(k), f"file://{tmp_path}/a{k}", f"file://{tmp_path}/m{k}", roll_bytes=2_000)
        found.append(sorted((r.shard, r.part, r.name, r.records, r.bytes, r.sha256) for r in m.collect()))
        for r in m.collect():
            data = (tmp_path / f"a{k}" / r.name).read_bytes()
            assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        assert not list((tmp_path / f"a{k}").glob("_temporary*"))
    assert found[0] == found[1] and max(x[1] for x in found[0]) > 0
    back = warc.read_archives(spark, f"file://{tmp_path}/a1", m, with_payload=True).collect()
    html = {r.page_id: r for r in pages.collect()}
    assert len(back) == len(html) and all(bytes(r.payload) == html[r.page_id].html.encode() for r in back if r.record_type == "response")


def test_tree_search_prunes():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(2000, 3)) * 256)
    order, nodes, low, high = kdtree.build(points, 32)
    ids, sorted_points = order, points[order]
    for q in np.floor(rng.normal(size=(20, 3)) * 256):
        best = []
        kdtree.search((ids, sorted_points, nodes, low, high), q, -1, best, 5, float("-inf"))
        want = sorted(((int(s), -i) for i, s in enumerate(points @ q)), reverse=True)[:5]
        assert sorted(best, reverse=True) == want
    assert all((sorted_points[s:e] >= low[k]).all() and (sorted_points[s:e] <= high[k]).all() for k, (s, e, *_) in enumerate(nodes))


def test_large_components(spark):
    big = np.array([1e30, -1e30]), np.array([[1e30, 1.0], [3.0, 4.0]])
    assert kdtree.dot(big[1], big[0])[0] == (1 << 63) - 1 and kdtree.dot(np.array([[3.0, 4.0]]), np.array([2.0, 1.0])) == [10]


@pytest.mark.parametrize("rows,on", [(120, False), (18, True), (8, True)])
def test_forest_splits_on(spark, monkeypatch, rows, on):
    """A sample too small for leaves of that size: leaves are split on; groups that cannot be are compared in blocks."""
    monkeypatch.setattr(forest, "BLOCK", 40)
    used = []
    plain = forest._route_on
    monkeypatch.setattr(forest, "_route_on", lambda *a: used.append(1) or plain(*a))
    rng = np.random.default_rng(5)
    tight = rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.02
    centre = rng.normal(size=(40, 16))
    x = np.concatenate([tight, np.repeat(centre, 10, 0) + rng.normal(size=(400, 16)) * 0.1, rng.normal(size=(450, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in forest.near_vectors(spark, df, sample_rows=200, leaf_rows=rows, trees=8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert bool(used) == on and (found <= link.sum(1)).all() and found.sum() >= 0.97 * link.sum()
    assert {got[i].component_id for i in range(150)} == {0} and link[:150, :150].sum() == 150 * 149


def test_forest_of_extreme_lengths(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e-200, 1e-202]), (3, [0.0, 5e-324]), (4, [0.0, 0.0]), (5, [0.0, 1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (1, 3)}


def test_search_in_many_blocks(spark, monkeypatch):
    for name, size in (("SHARD_ROWS", 37), ("QUERY_ROWS", 11), ("HELD", 2)):
        monkeypatch.setattr(kdtree, name, size)
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = kdtree.top_k(spark, vectors, vectors.where("vec_id % 5 = 0"), 7)
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, float)) for r in vectors.collect()}
    want = []
    for q in (i for i in x if i % 5 == 0):
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:7]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_forest_recall(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 32))
    x = np.concatenate([np.repeat(centre, 20, 0) + rng.normal(size=(1200, 32)) * rng.uniform(0.02, 0.3, (1200, 1)), rng.normal(size=(1500, 32))])
    x[5] = x[6]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in forest.near_vectors(spark, df, leaf_rows=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.97 * link.sum() and got[5].component_id == got[6].component_id


def test_minhash_band_rows():
    for t in (0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.99):
        rows = minhash.band_rows(t)
        assert (1 - t**rows) ** (minhash.K // rows) <= minhash.BAND_MISS
    assert (minhash.band_rows(0.85), minhash.band_rows(0.8)) == (6, 5)
    with pytest.raises(ValueError):
        minhash.band_rows(0.03)


def test_minhash_low_threshold(spark):
    rng = np.random.default_rng(10)
    rows = []
    for i in range(60):
        w = [f"w{i // 3}.{k}" for k in range(80)]
        for j in rng.choice(80, rng.integers(0, 14), replace=False).tolist():
            w[j] = f"x{i}.{j}"
        rows.append((i, " ".join(w)))
    low = groups([minhash.exact_sets(t) for _, t in rows], 40)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 40, 100).collect()}
    assert got == low and len(set(low.values())) > 20


def test_minhash_repeated_rows(spark):
    """Many rows of one id and text, a near copy of it, and ids that have several texts."""
    base = [f"w{i}" for i in range(200)]
    near = base[:100] + ["other"] + base[101:]
    far = [f"v{i}" for i in range(50)]
    rows = [(5, " ".join(base))] * 4000 + [(9, " ".join(near))] + [(9, " ".join(far))] * 3 + [(2, " ".join(far))] + [(7, "alone in this table of rows")] + [(8, " ".join(far) + f" {i}") for i in range(40)] + [(8, f"short text number {i}") for i in range(300)]
    got = collections.Counter(map(tuple, minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()))
    assert got == {(5, 2, False): 4000, (9, 2, False): 4, (2, 2, True): 1, (7, 7, True): 1, (8, 2, False): 340}


def test_minhash_pieces():
    a = [b"w%d" % i for i in range(400)]
    t = minhash._Words()
    base = minhash.shingle_hashes(a, t)
    assert len(base) == 396 and len(minhash.shingle_hashes(a[:3], t)) == 1 and len(minhash.shingle_hashes([], t)) == 0
    hits = []
    for k in range(1, 30):
        b = list(a)
        for j in range(k):
            b[13 * j] = b"x%d" % j
        other = minhash.shingle_hashes(b, t)
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        hits.append(abs((minhash.signature(base) == minhash.signature(other)).mean() - true))
    assert np.mean(hits) < 0.06
    least = minhash.need(0.85)
    assert least == sorted(least) and least[-1] < 0.85 * minhash.K


def test_pipeline(spark):
    """Every stage on what its predecessor kept, against plain versions."""
    import tiktoken

    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    quality_of, rows = {}, []
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        docs = docs.cache()
        tables.append((name, before, docs))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == corpus_pipeline.COLUMNS and docs.dtypes == before.select(*corpus_pipeline.COLUMNS).dtypes, name
    row = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    # quality: the margin by explicit pairs, for the words and statistics of each text
    _, before, after = tables[0]
    model = quality.fit_quality(spark, before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    for r in before.collect():
        idx, x = quality.features(r.text, r.n_chars, quality._Buckets())
        v = model.v[idx] * x[:, None]
        quality_of[r.doc_id] = model.b + x @ model.w[idx] + np.triu(v @ v.T, 1).sum()
    margin = math.log(0.3 / 0.7)
    assert min(abs(m - margin) for m in quality_of.values()) > 1e-6
    assert row(after) == sorted((tuple(r) for r in before.collect() if quality_of[r.doc_id] >= margin), key=str)
    # near-duplicates: all pairs
    _, before, after = tables[1]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    low = groups([minhash.exact_sets(r.text) for r in rows], 80)
    assert row(after) == sorted((tuple(r) for i, r in enumerate(rows) if low[i] == i), key=str)
    # repeats: every window of every text, in the order of doc_id
    _, before, after = tables[2]
    seen, want = set(), []
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        data = r.text.encode()
        windows = [data[i : i + 50] for i in range(len(data) - 49)]
        gone = {i + k for i, w in enumerate(windows) if w in seen for k in range(50)}
        seen.update(windows)
        text = bytes(b for i, b in enumerate(data) if i not in gone).decode(errors="ignore")
        want.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert row(after) == sorted(want, key=str)
    # mixing: no row goes, copies follow the rates
    _, before, after = tables[3]
    rate = {r.doc_id: r.rate for r in mixing.mix(spark, before, mixing.labelled_domains(spark, before, SMALL), mixing.tempered(0.7, True), lowest=1.0).collect()}
    copies = {i: math.floor(x) + (zlib.crc32(f"mix/{i}".encode()) / 2**32 < x - math.floor(x)) for i, x in rate.items()}
    assert row(after) == sorted((tuple(r) for r in before.collect() for _ in range(copies[r.doc_id])), key=str) and min(copies.values()) == 1
    # encoding
    _, before, after = tables[4]
    ranks, pattern = bpe.production_codec()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before.collect():
        ids = np.array(own.encode_ordinary(r.text), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert row(after) == sorted(want, key=str) == row(corpus_pipeline.run(spark, SMALL))
