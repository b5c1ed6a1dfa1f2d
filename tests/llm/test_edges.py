"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns of clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, chat, common, forest, interpolated, kdtree, minhash, mixing, quality, suffix, warc

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, "One TWO three\tfour five\nsix", None, None, None), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 4), (6, LONG, "fr", "c", len(LONG)), (7, LONG + " tail", "fr", "c", 1), (8, "é" * 100 + "\x00 end", "fr", "c", 105), (None, "one two three four five six", "en", "a", 27), (None, None, None, None, None), (9, "short", "de", "d", 5), (10, "short", "de", "d", 5),
]
CLASH = ["n", "sig", "key", "chunk", "rep", "component", "z", "kept", "shard", "rank", "score", "held_out", "bands", "node", "y"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    for name, df in (("full", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{path}/{name}/documents.parquet")
    labels = [(1, 1, 0), (1, 1, 0), (4, 0, 0), (None, 1, 1), (6, None, None), (9, 0, 1), (8, 1, 0), (99, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    lab.write.parquet(f"{path}/full/labels.parquet")
    lab.limit(0).write.parquet(f"{path}/none/labels.parquet")
    return str(path)


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bpe(spark, docs):
    out = bpe.encode_documents(spark, docs, *bpe.production_codec()).collect()
    assert len(out) == len(ROWS)
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256) == (0, empty) for r in out if r.doc_id in (3, 4))
    assert all(r.decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() for r in out if r.doc_id == 6)
    assert bpe.encode_documents(spark, docs.limit(0), *bpe.production_codec()).count() == 0


def test_quality(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/full/labels.parquet")
    model = quality.fit_quality(spark, docs, labels)
    out = quality.score_quality(spark, docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out) and all(r.held_out is not None for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    none = quality.fit_quality(spark, docs, labels.limit(0))
    assert {r.predicted for r in quality.score_quality(spark, docs, none).collect()} == {1}
    assert quality.score_quality(spark, docs.limit(0), model).count() == 0


def test_minhash(spark, docs):
    out = sorted(map(tuple, minhash.near_duplicates(spark, docs).collect()), key=str)
    want = [(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 9, False), (None, 0, None, True), (None, 2, None, True)]
    long = [r for r in out if r[0] in (6, 7)]
    assert [r for r in out if r[0] not in (6, 7)] == sorted(want, key=str)
    assert [(r[0], r[2], r[3]) for r in long] == [(6, 6, True), (7, 6, False)]
    assert minhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_minhash_chain_of_near_copies(spark):
    import random

    rng = random.Random(1)
    base, rows = [f"w{i}" for i in range(300)], []
    cur = base
    for i in range(120):  # each is near the one before it, the ends are far apart
        cur = list(cur)
        cur[rng.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(cur)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: minhash.exact_sets(t) for i, t in rows}
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, df).collect()} == {i: find(i) for i in range(120)}


def test_repeats(spark, docs):
    got = by_id(suffix.remove_repeats(spark, docs))
    assert len(got) == len(ROWS)
    for r in got:
        if r[0] in (None, 1, 2, 3, 4, 5, 6, 8, 9, 10):
            assert r[2] == 0, r
    seven = next(r for r in got if r[0] == 7)
    assert seven[1] - seven[2] <= len(" tail") and seven[3] == 1
    same = suffix.without_repeats(spark, docs)
    assert same.columns == docs.columns and same.count() == len(ROWS) and same.where("doc_id = 3").first().text is None
    assert suffix.remove_repeats(spark, docs.limit(0)).count() == 0 and suffix.without_repeats(spark, docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(spark, docs, width=10)


def test_language_model(spark, docs):
    out = interpolated.score_texts(spark, docs).collect()
    assert len(out) == len(ROWS) and all(r.score < 0 and r.base_score < 0 for r in out)
    assert all(r.n_tokens == 1 for r in out if r.doc_id in (3, 4, 5)) and interpolated.score_texts(spark, docs.limit(0)).count() == 0
    alone = interpolated.score_texts(spark, docs.where("doc_id is null")).collect()
    assert all(r.train_tokens == 0 and not r.held_out for r in alone)


def test_mixing(spark, docs, folder):
    labelled = mixing.labelled_domains(spark, docs, f"{folder}/full")
    out = mixing.mix(spark, docs, labelled, mixing.tempered(0.7, False)).collect()
    assert len(out) == len(ROWS) and all(r.rate >= 0 for r in out)
    none = mixing.mix(spark, docs, labelled.limit(0), mixing.tempered(0.7, False)).collect()
    assert {r.domain for r in none} == {""} and all(abs(r.rate - 1) < 1e-6 for r in none)
    assert mixing.mix(spark, docs.limit(0), labelled, mixing.tempered(0.7, False)).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 0, None, None), (1, 0, None, None), (None, None, "user\nx", "<|im_end|>"), (2, None, "<|im_start|>", "z"), (3, 5, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in CLASH})
    out = {r.conv_id: r for r in chat.format_conversations(spark, df).collect()}
    assert (out[1].n_turns, out[1].loss_chars) == (4, 2) and out[1].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert out[None].turns_sha256 == hashlib.sha256(b"user\nx\n<|im_end|>\n").hexdigest() and out[3].loss_chars == len(LONG)
    assert chat.format_conversations(spark, df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big = "x" * 200
    rows = [(1, "http://a/\r\nb c", big), (2, None, big), (3, "u", None), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", big), (2, None, big), (-7, "ü", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASH})
    m = warc.write_archives(spark, df, f"file://{tmp_path}/a", f"file://{tmp_path}/m")
    out = sorted(map(tuple, warc.read_archives(spark, f"file://{tmp_path}/a", m).collect()), key=str)
    assert len(out) == len(rows)
    assert [(r[0], r[3], r[4]) for r in out if r[1] == 200] == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (None, "revisit", 1)]
    assert all(r[3] == "response" for r in out if r[1] != 200) and sum(r[1] == 0 for r in out) == 2
    m = warc.write_archives(spark, df.limit(0), f"file://{tmp_path}/b", f"file://{tmp_path}/n")
    assert m.count() == 0 and warc.read_archives(spark, f"file://{tmp_path}/b", m).count() == 0


VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, []), (9, [0.0, 1.0]), (10, [0.1, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, [float("inf"), 0.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in [*CLASH, "v", "c", "g", "dim", "ids"]})


def test_forest(spark, vectors):
    out = sorted(map(tuple, forest.near_vectors(spark, vectors).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False), (11, 0, 11, True), (None, 0, None, True), (12, 0, 12, True)]
    assert out == sorted(want, key=str)
    assert forest.near_vectors(spark, vectors.limit(0)).count() == 0


def test_kdtree(spark, vectors):
    out = sorted(map(tuple, kdtree.top_k(spark, vectors, vectors.where("vec_id in (3, 4, 5, 11)")).collect()))
    assert [r for r in out if r[0] == 11] == []
    one = [(3, 1, 2, 131072), (3, 2, 1, 65536), (3, 3, 10, 6400), (3, 4, 4, 0), (3, 5, 9, 0)]
    assert [r for r in out if r[0] == 3] == sorted(one * 2) and [r[2] for r in out if r[0] == 4] == [1, 2, 3, 3, 9]
    assert kdtree.top_k(spark, vectors.limit(0), vectors).count() == 0 and kdtree.top_k(spark, vectors, vectors.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["full", "none"])
def test_stages(spark, folder, which):
    docs = spark.read.parquet(f"{folder}/{which}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{folder}/{which}")
        assert out.count() == 0 if which == "none" else out.count() > 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run(spark, f"{folder}/{which}").count() >= 0


def test_shared_folder(spark, tmp_path):
    class Session:
        """A session of a given master and settings."""

        def __init__(self, master, **conf):
            self.conf = type("Conf", (), {"get": lambda _, k, d=None: conf.get(k, d), "set": lambda _, k, v: conf.__setitem__(k, v)})()
            self.sparkContext = type("Context", (), {"master": master})()
            self._jvm, self._jsc = spark._jvm, spark._jsc

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.shared_root(Session(master))
    alone = Session("local[4]")
    assert common.shared_root(alone).startswith("file:///") and common.shared_root(alone) == common.shared_root(alone)
    set_ = {"spark.checkpoint.dir": f"{tmp_path}/shared"}
    assert common.shared_root(Session("yarn", **set_)) == f"file://{tmp_path}/shared"  # the default file system here
    assert common.shared_root(Session("yarn", **{"spark.checkpoint.dir": "hdfs://n/x"})) == "hdfs://n/x"


def test_release(spark):
    before = common.made()
    scratch = common.Scratch(spark, "test")
    path = scratch.path.removeprefix("file://")
    scratch.write(spark.range(3), "t")
    import os

    assert os.path.isdir(path)
    common.release(before)
    assert not os.path.exists(path) and common.made() == before


def test_split_joins(spark):
    left = spark.range(30_000).selectExpr("case when id % 3 = 0 then 7 else id end as k", "id as v")
    right = spark.range(20_000).selectExpr("id as k", "id * 2 as w")
    hot = common.hot_keys(left, ["k"], 30_000)
    assert [tuple(r) for r in hot] == [(7,)]
    for how in ("inner", "left"):
        got = common.join_split(left, right, ["k"], hot, how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_packed_arrays():
    import numpy as np

    for a in (np.zeros(0, np.int64), np.array([1, -5, 1 << 62]), np.arange(1000, dtype=np.uint32), np.array([65535], np.uint16)):
        assert (common.expand(common.squeeze(a), a.dtype) == a).all()


def test_components_of_a_star(spark):
    """One node that all others hang on, as the smallest and as the largest."""
    scratch = common.Scratch(spark, "test")
    for hub in (0, 10**9):
        edges = spark.range(1, 15_001).selectExpr("id as a", f"{hub}L as b")
        got = common.components(spark, edges, scratch)
        assert got.count() == 15_001 and [tuple(r) for r in got.select("component").distinct().collect()] == [(min(hub, 1),)]


def test_components(spark):
    scratch = common.Scratch(spark, "test")
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (100, 95), (95, 90), (7, 7), (None, 3), (200, 201), (201, 200)] + [(300, k) for k in range(301, 360)]
    got = dict(map(tuple, common.components(spark, spark.createDataFrame(edges, "a long, b long"), scratch).collect()))
    want = {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200} | {k: 300 for k in range(300, 360)}
    assert got == want
    assert common.components(spark, spark.createDataFrame([], "a long, b long"), scratch).count() == 0
