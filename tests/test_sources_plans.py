import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import NotSupported
from sparkloom.plans import build
from sparkloom.sources import readers, sinks
from sparkloom.streaming import deduplicate, keep_latest, run_available, session_counts

SCHEMA = "k int, s string, v double"
ROWS = [(1, "a", 1.5), (2, "b", None), (3, "", 2.5), (4, None, 0.5)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("format", ["ORC", "PARQUET", "JSON", "CSV"])
def test_formats(spark, df, tmp_path, format):
    sinks.write_files(df.filter("k < 3"), f"{tmp_path}/t", format.lower())
    got = readers.read_files(spark, f"{tmp_path}/t", format, df.schema)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1.5), (2, "b", None)]
    with pytest.raises(NotSupported):
        readers.read_files(spark, "x", "DWRF")


def test_catalogs(spark, df, tmp_path):
    (tmp_path / "main.properties").write_text("# comment\nconnector.name=files\nwarehouse=%s/w\nformat=ORC\n" % tmp_path)
    sinks.write_files(df, f"{tmp_path}/w/s/t", "orc")
    catalogs = readers.load_catalogs(str(tmp_path))
    assert list(catalogs) == ["main"] and catalogs["main"].read(spark, "s", "t", schema=df.schema).count() == 4
    (tmp_path / "bad.properties").write_text("x=1\n")
    with pytest.raises(ValueError):
        readers.load_catalogs(str(tmp_path))


def test_partition_values(spark, df, tmp_path):
    sinks.write_files(df, f"{tmp_path}/p", partitioned_by=["s"])
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/p").filter("s is null").select("k").collect()) == [3, 4]
    sinks.write_files(df.select("k"), f"{tmp_path}/a")
    got = readers.read_splits(spark, [(f"{tmp_path}/a", {"p": "7"}), (f"{tmp_path}/a", {"p": ""})], "PARQUET", T.StructType([T.StructField("k", T.IntegerType())]), {"p": T.IntegerType()})
    assert sorted((r.p for r in got.collect()), key=str) == [7] * 4 + [None] * 4
    assert readers.read_splits(spark, [], "PARQUET", df.schema, {"p": T.IntegerType()}).count() == 0


def test_schema_and_deletes(spark, df, tmp_path):
    new = T.StructType([T.StructField("k", T.LongType()), T.StructField("extra", T.StringType()), T.StructField("v", T.StringType())])
    assert readers.coerce(df, new).schema == new
    deletes = spark.createDataFrame([("a",), (None,)], "s string")
    assert sorted(r.k for r in readers.without_deleted(df, deletes, ["s"]).collect()) == [2, 3]
    sinks.write_files(df, f"{tmp_path}/m")
    assert "$path" in readers.with_file_columns(spark.read.parquet(f"{tmp_path}/m")).columns


def test_tables(spark, df):
    for t in ("bucketed", "other"):
        spark.sql(f"drop table if exists {t}")
    sinks.create_table(df, "bucketed", bucketed_by=["k"], buckets=4, sorted_by=["k"], not_null=["k"])
    sinks.create_table(df, "other", bucketed_by=["k"], buckets=4, sorted_by=["k"])
    sinks.insert_into(df.select("v", "s", "k"), "bucketed")
    assert spark.table("bucketed").count() == 8
    join = spark.table("bucketed").hint("merge").join(spark.table("other"), "k")
    assert "Exchange" not in join._jdf.queryExecution().executedPlan().toString()
    sinks.insert_into(df.limit(1), "bucketed", overwrite=True)
    assert spark.table("bucketed").count() == 1
    with pytest.raises(Exception, match="NOT NULL"):
        sinks.create_table(df, "refused", not_null=["s"])


def test_rewrites(spark, df, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write_files(df, path)
    with pytest.raises(Exception):
        sinks.write_files(df, path)
    sinks.update_rows(spark, path, "k >= 3", {"v": "v + 1"})
    sinks.delete_rows(spark, path, "s = 'a'")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "b", None), (3, "", 3.5), (4, None, 1.5)]
    for _ in range(3):
        sinks.write_files(df, path, mode="append")
    sinks.optimize(spark, path)
    assert spark.read.parquet(path).count() == 15 and len([f for f in (tmp_path / "t").glob("*.parquet")]) == 1
    sinks.refresh_view(df.limit(2), f"{tmp_path}/view")
    sinks.refresh_view(df, f"{tmp_path}/view")
    assert spark.read.parquet(f"{tmp_path}/view").count() == 4
    report = sinks.write_with_result(df, f"{tmp_path}/w", not_null=["k"])
    assert report.agg(F.sum("rows")).first()[0] == 4


@pytest.mark.parametrize("broken", [1, 2])
def test_failing_renames_lose_nothing(spark, df, tmp_path, monkeypatch, broken):
    path, calls, plain = f"{tmp_path}/t", [], sinks._rename
    sinks.write_files(df, path)

    def rename(fs, a, b):
        calls.append(1)
        return False if len(calls) == broken else plain(fs, a, b)

    monkeypatch.setattr(sinks, "_rename", rename)
    for change in (lambda: sinks.delete_rows(spark, path, "k = 1"), lambda: sinks.update_rows(spark, path, "k = 1", {"v": "9"}), lambda: sinks.optimize(spark, path), lambda: sinks.refresh_view(df.limit(1), path)):
        calls.clear()
        with pytest.raises(OSError, match="as it was"):
            change()
        assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == sorted(ROWS, key=str)
        assert [p.name for p in tmp_path.iterdir() if ".old-" in p.name] == []


def test_half_done_swap_is_recovered(spark, df, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write_files(df, path)
    (tmp_path / "t").rename(tmp_path / "t.old-1")
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 4 and not sinks.recover(spark, path)


def test_failing_append_leaves_the_table(spark, df, tmp_path, monkeypatch):
    path, plain = f"{tmp_path}/t", sinks._rename
    sinks.write_files(df, path)
    calls = []
    monkeypatch.setattr(sinks, "_rename", lambda fs, a, b: calls.append(1) or (len(calls) < 2 and plain(fs, a, b)))
    with pytest.raises(OSError, match="as it was"):
        sinks.write_with_result(df.repartition(2), path, mode="append")
    assert spark.read.parquet(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_writer_reports_its_own_rows(spark, df, tmp_path):
    path = f"{tmp_path}/t"
    told = lambda rows, **m: [(r.fragment is not None, r.rows) for r in sinks.write_with_result(rows, path, **m).collect()]
    first = told(df)
    assert sum(n for _, n in first) == 4 and all(named and n for named, n in first)
    assert sum(r.rows for r in sinks.write_with_result(df.limit(3), path, mode="append").collect()) == 3
    assert told(df.limit(0), mode="append") == [(False, 0)] and spark.read.parquet(path).count() == 7
    with pytest.raises(FileExistsError):
        sinks.write_with_result(df, path)
    assert sum(r.rows for r in sinks.write_with_result(df, path, mode="overwrite", partitioned_by=["k"]).collect()) == 4 and spark.read.parquet(path).count() == 4


def test_one_read_for_all_splits(spark, df, tmp_path):
    for k in range(30):
        sinks.write_files(df.limit(1), f"{tmp_path}/s{k}")
    got = readers.read_splits(spark, [readers.Split(f"{tmp_path}/s{k}", {"p": str(k)}) for k in range(30)], "PARQUET", df.schema, {"p": T.IntegerType()})
    assert sorted(r.p for r in got.collect()) == list(range(30))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    with pytest.raises(Exception, match="another bucket"):
        readers.read_splits(spark, [readers.Split(f"{tmp_path}/s1", bucket=3)], "PARQUET", df.schema, {}).collect()
    with pytest.raises(NotSupported):
        readers.Catalog("c", {"connector.name": "tpch"})


def test_shared_folder(spark, monkeypatch):
    from sparkloom.session import shared_folder

    class Cluster:
        conf = type("Conf", (), {"get": lambda _, key, default=None: default})()
        sparkContext = type("Context", (), {"master": "yarn"})()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Cluster(), "x")
    assert shared_folder(spark, "x").startswith("file:/")


def test_statistics(df):
    s = sinks.column_statistics(df.withColumn("flag", F.col("k") > 2)).first().asDict()
    assert s["rows"] == 4 and s["k$min"] == 1 and s["k$max"] == 4 and s["k$ndv"] == 4 and s["s$non_null"] == 3 and s["s$max_size"] == 1 and s["s$total_size"] == 2 and s["flag$true_count"] == 2 and s["k$ndv_summary"] is not None


def test_declared_plans(spark, df, tmp_path):
    open_ = lambda t: df
    scan = {"@type": "tableScan", "table": {"predicate": {"k": {"ranges": [{"low": 2}]}}}, "outputSymbols": ["a", "b"], "assignments": {"a": "k", "b": "s"}}
    run = lambda n, **m: [tuple(r) for r in build(spark, n, open_, **m).df.collect()]
    order = {"orderBy": ["a"], "orderings": {"a": "DESC_NULLS_LAST"}}
    assert run({"@type": "sort", "source": scan, "orderingScheme": order}) == [(4, None), (3, ""), (2, "b")]
    assert run({"@type": ".LimitNode", "source": scan, "count": 1, "tiesResolvingScheme": order}) == [(4, None)]
    assert run({"@type": "topN", "source": {"@type": "project", "source": scan, "assignments": {"a": "a * 2"}}, "count": 1, "orderingScheme": order}) == [(8,)]
    values = {"@type": ".ValuesNode", "outputSymbols": ["x"], "types": {"x": "bigint"}, "rows": [[1], [4]]}
    assert run(values) == [(1,), (4,)] and run({"@type": ".ValuesNode", "outputSymbols": [], "rowCount": 2}) == [(), ()]
    join = {"@type": "x.y.JoinNode", "type": "INNER", "left": scan, "right": values, "criteria": [{"left": "a", "right": "x"}], "leftOutputSymbols": ["b"], "rightOutputSymbols": ["x"]}
    assert run(join) == [(None, 4)]
    union = {"@type": "exchange", "type": "GATHER", "sources": [values, values], "inputs": [["x"], ["x"]], "outputSymbols": ["y"]}
    assert sorted(run(union)) == [(1,), (1,), (4,), (4,)]
    assert sorted(run({"@type": "remoteSource", "sourceFragmentIds": ["1", "1"], "orderingScheme": {"orderBy": ["x"], "orderings": {"x": "ASC_NULLS_FIRST"}}}, fragments={"1": values})) == [(1,), (1,), (4,), (4,)]
    ids = {"@type": ".GroupIdNode", "source": scan, "groupingSets": [["b"], []], "groupingColumns": {"b": "b"}, "aggregationArguments": ["a"], "groupIdSymbol": "g"}
    agg = {"@type": ".AggregationNode", "source": {**ids, "source": {"@type": ".FilterNode", "source": scan, "predicate": "a > 99"}}, "groupingSets": {"groupingKeys": ["b", "g"], "groupingSetCount": 2, "globalGroupingSets": [1]}, "groupIdSymbol": "g", "aggregations": {"n": {"function": "count"}}}
    assert run(agg) == [(None, 1, 0)]
    assert len(run({**agg, "source": ids})) == 4
    assert run({"@type": ".DistinctLimitNode", "source": union, "limit": 9, "distinctSymbols": ["y"]}).__len__() == 2
    write = {"@type": "tableWriter", "source": values, "columns": ["x"], "columnNames": ["id"], "notNullColumnSymbols": ["x"], "target": {"path": f"{tmp_path}/out"}, "rowCountSymbol": "rows", "fragmentSymbol": "fragment"}
    assert sum(r[0] for r in run(write)) == 2 and spark.read.parquet(f"{tmp_path}/out").columns == ["id"]
    steps = {"@type": ".AggregationNode", "source": scan, "groupingSets": [["b"]], "aggregations": {"n": {"function": "count"}}}
    with pytest.raises(NotSupported, match="partial"):
        run({**steps, "step": "FINAL", "aggregations": {"m": {"function": "count", "arguments": ["n"]}}})
    with pytest.raises(ValueError):
        run({**steps, "step": "HALF"})
    with pytest.raises(NotSupported):
        run({"@type": "remoteSource", "sourceFragmentIds": ["1"], "exchangeType": "SPOOLING"}, fragments={"1": values})
    for bad in ({"@type": "special", "form": "MAYBE", "arguments": []}, {"@type": "guess"}):
        with pytest.raises(NotSupported):
            run({"@type": "filter", "source": scan, "predicate": bad})
    with pytest.raises(NotSupported):
        run({"@type": "patternRecognition"})
    with pytest.raises(ValueError):
        run({**join, "type": "SIDEWAYS"})


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:10", 3.0), (1, "2024-01-01 01:00:00", 2.0), (2, "2024-01-01 00:00:05", 9.0)]
    df = spark.createDataFrame(rows, "u long, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = run_available(session_counts(stream(), "t", "1 minute", ["u"]), "complete")
    assert sorted((r.u, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    once = run_available(deduplicate(stream(), "t", ["u"], "1 day"), "append")
    assert sorted(r.u for r in once.collect()) == [1, 2]
    last = run_available(keep_latest(stream(), "u", "t", "v"), "update")
    assert {r.u: r.v for r in last.collect()} == {1: 2.0, 2: 9.0}


def test_compaction_goes_by_bytes(spark, tmp_path, monkeypatch):
    """Neither cores nor the planner's wish for small partitions make more files."""
    rows = spark.range(400_000).selectExpr("id", "uuid() as text")
    path = f"{tmp_path}/t"
    sinks.write_files(rows.repartition(6), path)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.optimize(spark, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(sinks.files_of(spark, path)) == 1 and spark.read.parquet(path).agg({"id": "sum"}).first()[0] == 400_000 * 399_999 // 2
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(sinks, "FILE_BYTES", size // 3 + 1)
    sinks.write_files(rows.repartition(5), f"{tmp_path}/u")
    sinks.optimize(spark, f"{tmp_path}/u")
    assert len(sinks.files_of(spark, f"{tmp_path}/u")) in (3, 4) and spark.read.parquet(f"{tmp_path}/u").count() == 400_000
