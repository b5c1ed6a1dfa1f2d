import pytest
from pyspark.sql import functions as F

from sparkloom.errors import NotSupported
from sparkloom.functions import AGGREGATES, COLLECTED, OPERATORS, SCALARS, call, library, resolve
from sparkloom.operators import Relation


def test_every_name_resolves(spark):
    known = {r[0].rpartition(".")[2] for r in spark.sql("show all functions").collect()}
    for name in library.names():
        assert name in OPERATORS or name in SCALARS or name in COLLECTED or AGGREGATES.get(name, name) in known, name
        assert resolve(f"presto.default.{name}").name == name
    with pytest.raises(KeyError):
        resolve("no_such_function")


def test_renamed_functions(spark):
    df = spark.createDataFrame([(5, "a,b", [3, 1], {"k": 2})], "n int, s string, l array<int>, m map<string,int>")
    one = lambda c: df.select(c.alias("x")).first()[0]
    assert one(call(df, "bitwise_left_shift", "n", F.lit(1))) == 10 and one(call(df, "bitwise_not", "n")) == -6
    assert one(call(df, "split_part", "s", "','", "2")) == "b" and one(call(df, "day_of_week", "date'2024-01-07'")) == 7
    assert one(call(df, "map", "array('a')", "array(1)")) == {"a": 1} and one(call(df, "reduce", F.col("l"), F.lit(0), lambda a, x: a + x)) == 4
    assert one(call(df, "from_utf8", call(df, "to_utf8", "s"))) == "a,b" and one(F.hex(call(df, "sha256", "s")))[:4] == one(F.upper(F.sha2("s", 256)))[:4]
    assert df.agg(call(df, "approx_distinct", "n").alias("x")).first()[0] == 1 and round(df.agg(call(df, "geometric_mean", "n").alias("x")).first()[0], 9) == 5
    assert one(call(df, "date_diff", "date'2024-01-07'", "date'2024-01-01'")) == 6 and one(call(df, "is_nan", "double('nan')")) is True


def test_dialect(spark):
    df = spark.createDataFrame([("a.b.c", 1)], "s string, n int")
    one = lambda name, *a: df.select(call(df, f"presto.default.{name}", *a).alias("x")).first()[0]
    assert one("split", "s", "'.'") == ["a", "b", "c"] and one("split", "s", "'.'", "2") == ["a", "b.c"]
    assert one("regexp_extract", "s", F.lit("[a-b]")) == "a" and one("regexp_extract", "s", F.lit("z")) is None
    assert one("truncate", "-1e300D") == -1e300 and one("truncate", "-2.7D") == -2.0 and one("truncate", "double('-inf')") == float("-inf")
    assert one("from_unixtime", "1.5D").microsecond == 500_000 and len(one("md5", "s")) == 16 and len(one("sha512", "s")) == 64
    assert one("date_diff", F.lit("day"), "timestamp_ntz'2024-01-01 23:00:00'", "timestamp_ntz'2024-01-02 22:00:00'") == 0
    assert one("date_diff", F.lit("month"), "date'2024-01-31'", "date'2024-02-29'") == 1 and one("date_diff", F.lit("month"), "date'2024-03-31'", "date'2024-02-29'") == -1
    assert one("to_base64", "repeat('x', 300)").count("\n") == 0 and one("url_extract_path", "'http://h'") == ""
    assert one("to_base", "-255L", "16") == "-ff" and one("bitwise_right_shift", "-8L", "60") == 15
    assert one("hamming_distance", "'karolin'", "'kathrin'") == 3
    with pytest.raises(Exception, match="one length"):
        one("hamming_distance", "'a'", "'ab'")
    for bad in (lambda: one("date_diff", F.lit("fortnight"), "date'2024-01-01'", "date'2024-01-01'"), lambda: one("date_format", "date'2024-01-01'", F.lit("%U"))):
        with pytest.raises(NotSupported):
            bad()


def test_empty_groups(spark):
    """Aggregates that collect, over no value and over NULLs."""
    from sparkloom.operators import Agg

    df = spark.createDataFrame([(1, None, None), (2, "a", 1)], "g int, k string, v int")
    aggs = {n: Agg(n, ["k", "v"]) for n in ("map_agg", "multimap_agg")} | {n: Agg(n, ["k"]) for n in ("histogram", "checksum")} | {"entropy": Agg("entropy", ["v"])}
    rows = {r.g: r for r in Relation(df).aggregate(["g"], aggs).df.collect()}
    assert rows[2].map_agg == {"a": 1} and rows[2].multimap_agg == {"a": [1]} and rows[2].histogram == {"a": 1}
    assert rows[1].map_agg is None and rows[1].histogram == {} and rows[1].entropy == 0.0


def test_reduce_takes_columns(spark):
    df = spark.range(1)
    with pytest.raises(Exception):
        call(df, "no_such_function", "id").alias("x") and df.select(call(df, "no_such_function", "id")).collect()


def test_nested_columns_are_pruned(spark, tmp_path):
    spark.sql("select named_struct('a', id, 'b', named_struct('c', id * 2, 'd', 'x')) as s from range(3)").write.parquet(f"{tmp_path}/n")
    r = Relation.scan(spark.read.parquet(f"{tmp_path}/n"), {"c": "s.b.c"})
    assert sorted(x[0] for x in r.df.collect()) == [0, 2, 4]
    assert "ReadSchema: struct<s:struct<b:struct<c:bigint>>>" in r.df._jdf.queryExecution().executedPlan().toString()


def test_partition_pruning(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 as p").write.partitionBy("p").parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p").filter("p = 1")
    assert "PartitionFilters: [isnotnull(p" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 3
