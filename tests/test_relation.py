import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.errors import NotSupported, classify
from sparkloom.operators import Agg, Domain, Order, Range, Relation, domain_to_column

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


@pytest.fixture
def abc(spark):
    return Relation.values(spark, [(i, 5 * i, d) for i, d in enumerate(DAYS)], "a long, b long, dow string")


def rows(relation):
    return [tuple(r) for r in relation.df.collect()]


def plan(relation):
    return relation.df._jdf.queryExecution().toString()


def test_projections(abc):
    assert rows(abc.project({"s": "a + b"})) == [(6 * i,) for i in range(7)]
    assert [r[0] for r in rows(abc.project({"m": "2 * a + b % 3"}))] == [0, 4, 5, 6, 10, 11, 12]
    assert [r[0] for r in rows(abc.project({"d": "concat(upper(substr(dow,1,1)), substr(dow,2,2))"}))] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def test_aggregate_sort_top_filter(abc):
    assert rows(abc.aggregate([], {"sa": "sum(a)", "aa": "avg(a)", "sb": "sum(b)", "ab": "avg(b)"})) == [(21, 3.0, 105, 15.0)]
    assert [r[0] for r in rows(abc.sort([("a", "DESC_NULLS_LAST")]).output(["a"]))] == [6, 5, 4, 3, 2, 1, 0]
    top = abc.top_n(3, [("a", Order.DESC_NULLS_FIRST)]).output(["a"])
    assert [r[0] for r in rows(top)] == [6, 5, 4] and "TakeOrderedAndProject" in plan(top)
    assert [r[0] for r in rows(abc.filter("a % 2 == 0").output(["a"]))] == [0, 2, 4, 6]


def test_zero_column_values(spark):
    r = Relation.values(spark, None, row_count=3)
    assert r.df.count() == 3 and r.df.columns == []


@pytest.mark.parametrize("order,expected", [("ASC_NULLS_FIRST", [None, 1, 2]), ("ASC_NULLS_LAST", [1, 2, None]), ("DESC_NULLS_FIRST", [None, 2, 1]), ("DESC_NULLS_LAST", [2, 1, None])])
def test_null_orders(spark, order, expected):
    r = Relation.values(spark, [(2,), (None,), (1,)], "v int")
    for x in (r.sort([("v", order)]), r.top_n(3, [("v", order)]), r.aggregate([], {"l": Agg("array_agg", ["coalesce(v, -1)"], order_by=[("v", order)])})):
        got = [y[0] for y in rows(x)]
        assert (got if len(got) == 3 else [None if v == -1 else v for v in got[0]]) == expected


def test_unknown_order():
    with pytest.raises(ValueError):
        Order.of("UP")


def test_limits(spark, abc):
    v = Relation.values(spark, [(3,), (3,), (2,), (2,), (2,), (1,), (None,)], "v int")
    assert sorted(r[0] for r in rows(v.limit(3, ties=[("v", "DESC_NULLS_LAST")]))) == [2, 2, 2, 3, 3]
    assert rows(v.limit(0, ties=[("v", "ASC_NULLS_LAST")])) == []
    assert len(rows(v.limit(99, ties=[("v", "ASC_NULLS_LAST")]))) == 7
    assert rows(v.limit(1, ties=[("v", "ASC_NULLS_FIRST")])) == [(None,)]
    assert len(rows(v.distinct_limit(2, ["v"]))) == 2
    assert [r[0] for r in rows(abc.offset_limit(2, 2, [("a", "ASC_NULLS_LAST")]).output(["a"]))] == [2, 3]
    with pytest.raises(NotSupported):
        abc.limit(1 << 40)


@given(st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=12), st.integers(0, 6), st.sampled_from([o.value for o in Order]))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_ties_against_rank(spark, values, n, order):
    r = Relation.values(spark, [(v,) for v in values], "v int")
    key = (lambda v: (v is not None if "FIRST" in order else v is None, -(v or 0) if order.startswith("DESC") else v or 0))
    ranked = sorted(values, key=key)
    expected = [v for i, v in enumerate(ranked) if n and (i < n or (key(v) == key(ranked[n - 1])))]
    assert sorted(map(str, (x[0] for x in rows(r.limit(n, ties=[("v", order)]))))) == sorted(map(str, expected))


def test_joins(spark):
    left = Relation.values(spark, [(1, 5), (2, 50), (None, 1), (3, 7)], "k int, x int")
    right = Relation.values(spark, [(1, 10), (2, 10), (None, 10), (4, 9)], "j int, y int")
    join = lambda how, **m: sorted(rows(left.join(right, how, [("k", "j")], "l.x < r.y", **m)), key=str)
    assert join("inner") == [(1, 5, 1, 10)]
    assert join("left") == sorted([(1, 5, 1, 10), (2, 50, None, None), (None, 1, None, None), (3, 7, None, None)], key=str)
    assert join("right") == sorted([(1, 5, 1, 10), (None, None, 2, 10), (None, None, None, 10), (None, None, 4, 9)], key=str)
    assert len(join("full")) == 7
    assert join("semi") == [(1, 5)] and len(join("anti")) == 3
    assert len(rows(left.join(right, "inner", []))) == 16
    assert rows(left.join(right, "inner", [("k", "j")], None, ["x"], ["y"]).filter("x = 5")) == [(5, 10)]
    assert "BroadcastHashJoin" in plan(left.join(right, "inner", [("k", "j")], distribution="REPLICATED"))
    assert "SortMergeJoin" in plan(left.merge_join(right, "inner", [("k", "j")]))
    with pytest.raises(ValueError):
        left.join(right, "sideways", [])
    with pytest.raises(NotSupported):
        left.join(right, "left", [])


@pytest.mark.parametrize("residual", [None, "l.x < r.y"])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_dealt_joins(spark, monkeypatch, how, residual):
    """Hot keys, NULLs, equal rows and rows of no partner, over many cells."""
    monkeypatch.setattr("sparkloom.operators.relation.CELL_ROWS", 8)
    left = Relation(spark.range(400).selectExpr("cast(if(id % 10 = 0, id % 3, if(id % 10 = 1, null, 1)) as int) as k", "if(id % 7 = 0, null, id % 50) as x"))
    right = Relation(spark.range(300).selectExpr("if(id % 9 = 0, id % 4, if(id % 9 = 1, null, 1)) as j", "id % 40 as y"))
    plain, dealt = (left.join(right, how, [("k", "j")], residual, distribution=d) for d in (None, "DEALT"))
    assert dealt.df.schema.simpleString() == plain.df.schema.simpleString()
    want = sorted(rows(plain), key=str)
    assert sorted(rows(dealt), key=str) == want and len(want) > 10_000


def test_dealt_joins_spread_one_key(spark):
    """One key's pairs are not one task's."""
    left, right = Relation(spark.range(30_000).selectExpr("id % 1 as k", "id as x")), Relation(spark.range(5_000).selectExpr("id % 1 as j", "id as y"))
    per = [r[1] for r in left.join(right, "inner", [("k", "j")], distribution="DEALT").df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).collect()]
    assert sum(per) == 150_000_000 and len(per) > 8 and max(per) < sum(per) / 4


def test_range_join_dealt(spark, monkeypatch):
    """A hot bin, NULLs, equal rows, empty bands and bands over several bins, over many cells."""
    monkeypatch.setattr("sparkloom.operators.relation.CELL_ROWS", 8)
    monkeypatch.setattr("sparkloom.operators.relation.TASK_ROWS", 64)
    left = Relation(spark.range(500).selectExpr("if(id % 11 = 0, null, if(id % 3 = 0, 5D, id % 97 - 20D)) as p", "if(id % 7 = 0, null, id % 50) as x"))
    right = Relation(spark.range(200).selectExpr("if(id % 13 = 0, null, id % 60 - 25D) as low", "id % 60 - 25D + id % 9 * 4 - 2 as high", "id % 40 as y"))
    for residual, more in ((None, ""), ("l.x < r.y", " and x < y")):
        want = sorted(rows(Relation(left.df.crossJoin(right.df).where("p between low and high" + more))), key=str)
        assert sorted(rows(left.range_join(right, "p", "low", "high", 10, residual)), key=str) == want and len(want) > 5_000
    assert rows(left.range_join(Relation(right.df.limit(0)), "p", "low", "high", 10)) == []


def test_range_join_is_stored_small(spark, tmp_path):
    """Pairs come by point and low end in tasks of even size: a file of them has far under a byte a pair."""
    left = Relation(spark.range(0, 20_000, 1, 1).selectExpr("id as k", "cast(id * 7919 % 20000 as double) as p"))
    right = Relation(spark.range(0, 2_000, 1, 1).selectExpr("id as j", "cast(id * 1201 % 2000 * 10 as double) as low").selectExpr("*", "low + 900 as high"))
    out = left.range_join(right, "p", "low", "high", 900, None, ["k"], ["j"]).df
    out.write.parquet(str(tmp_path / "pairs"))
    per = [r[0] for r in spark.read.parquet(str(tmp_path / "pairs")).groupBy(F.input_file_name()).agg(F.count(F.lit(1))).select("count(1)").collect()]
    assert sum(per) == sum(min(901, 20_000 - low) for low in range(0, 20_000, 10)) and max(per) < sum(per) / 4
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * sum(per)


def test_grouping_sets(spark):
    r = Relation.values(spark, [(1, "a", 2), (1, "b", 3), (2, "a", 4), (None, "a", 5)], "k int, s string, v int")
    got = sorted(rows(r.grouping_sets([["k"], ["k"], [], ["k", "s"]], {"t": "sum(v)"}, "g")), key=str)
    expected = [(k, None, g, t) for g in (0, 1) for k, t in ((1, 5), (2, 4), (None, 5))] + [(None, None, 2, 14), (1, "a", 3, 2), (1, "b", 3, 3), (2, "a", 3, 4), (None, "a", 3, 5)]
    assert got == sorted(expected, key=str)
    empty = Relation(r.df.limit(0))
    assert rows(empty.grouping_sets([["k"], [], []], {"n": "count(1)", "t": "sum(v)"})) == [(None, 0, None)] * 2
    assert len(rows(r.rollup(["k", "s"], {"n": "count(1)"}))) == 4 + 3 + 1
    assert len(rows(r.cube(["k", "s"], {"n": "count(1)"}))) == 4 + 3 + 2 + 1
    ids = r.group_id([["x"], []], {"x": "k"}, ["v"], "g")
    assert ids.df.columns == ["x", "v", "g"] and sorted(rows(ids), key=str) == sorted([(1, 2, 0), (1, 3, 0), (2, 4, 0), (None, 5, 0)] + [(None, v, 1) for v in (2, 3, 4, 5)], key=str)


def test_aggregate_modifiers(spark):
    r = Relation.values(spark, [(1, 2), (1, 2), (1, None), (2, 7)], "k int, v int").mark_distinct("m", ["k", "v"])
    got = dict((x[0], tuple(x[1:])) for x in rows(r.aggregate(["k"], {"d": Agg("sum", ["v"], distinct=True), "f": Agg("count", [], filter="v > 2"), "m": Agg("sum", ["v"], mask="m"), "n": Agg("catalog.default.ARBITRARY", ["k"])})))
    assert got == {1: (2, 0, 2, 1), 2: (7, 1, 7, 2)}


def test_sets_and_unions(spark):
    a, b = Relation.values(spark, [(1, "x"), (1, "x"), (2, "y")], "k int, s string"), Relation.values(spark, [("x", 1)], "t string, j int")
    assert sorted(rows(a.union_all(b, inputs=[["k", "s"], ["j", "t"]]))) == [(1, "x"), (1, "x"), (1, "x"), (2, "y")]
    assert sorted(rows(a.union(b, inputs=[["k", "s"], ["j", "t"]]))) == [(1, "x"), (2, "y")]
    c = b.project({"k": "j", "s": "t"})
    assert rows(a.intersect(c)) == [(1, "x")] and rows(a.except_(c)) == [(2, "y")] and sorted(rows(a.except_(c, all=True))) == [(1, "x"), (2, "y")]


def test_exchanges(spark, abc):
    assert abc.round_robin(5).df.rdd.getNumPartitions() == 5
    assert abc.hash_partition(["a"], 3).df.rdd.getNumPartitions() == 3
    assert abc.round_robin(5).gather().df.rdd.getNumPartitions() == 1
    part = abc.hash_partition(["a"], 3).sort([("a", "DESC_NULLS_LAST")], partial=True)
    assert all(list(p) == sorted(p, reverse=True) for p in part.df.select("a").rdd.map(lambda r: r[0]).glom().collect())


def test_rows_of_arrays_and_maps(spark):
    r = Relation(spark.sql("select 1 as k, array(1, 2) as a, array('x') as b, map('p', 9) as m union all select 2, array(), null, null"))
    assert sorted(rows(r.unnest(["k"], {"a": ["x"], "b": ["y"]}, "n")), key=str) == [(1, 1, "x", 1), (1, 2, None, 2)]
    assert rows(r.unnest(["k"], {"m": ["mk", "mv"]})) == [(1, "p", 9)]
    assert len(rows(r.unnest(["k"], {"a": ["x"]}, outer=True))) == 3


def test_single_row_and_ids(spark, abc):
    assert rows(abc.filter("a = 3").output(["a"]).enforce_single_row()) == [(3,)]
    assert rows(abc.filter("a = 99").output(["a"]).enforce_single_row()) == [(None,)]
    with pytest.raises(Exception, match="more than one row") as e:
        rows(abc.enforce_single_row())
    assert classify(e.value) == ("USER_ERROR", "GENERIC_USER_ERROR")
    ids = [r[0] for r in rows(abc.assign_unique_id("id").output(["id"]))]
    assert len(set(ids)) == 7


def test_domains(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")
    keep = lambda d: sorted((r[0] for r in df.filter(domain_to_column("v", d)).collect()), key=str)
    assert keep(Domain([1, 3])) == [1, 3] and keep(Domain([1], inclusive=False)) == [2, 3]
    assert keep(Domain([1], null_allowed=True)) == [1, None] and keep(Domain(ranges=[Range(1, 2, False)])) == [2]
    assert keep(Domain(ranges=[])) == [] and keep(Domain(ranges=[Range()])) == [1, 2, 3]
    assert keep(Domain(all=True)) == [1, 2, 3] and keep(Domain(all=True, null_allowed=True)) == [1, 2, 3, None] and keep(Domain(all=False)) == [] and keep(Domain(all=False, null_allowed=True)) == [None]
    assert Relation.scan(df, None, None).df.count() == 0


def test_pushdown(spark, tables):
    scan = Relation.scan(spark.read.parquet(f"{tables}/orders.parquet"), {"k": "o_orderkey"}, {"o_custkey": Domain(ranges=[Range(5, 10)])})
    text = scan.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,5)" in text.split("PushedFilters: ")[1]
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_every_order_pair(spark):
    values = [(a, b) for a, b in itertools.product([None, 1, 2], repeat=2)]
    r = Relation.values(spark, values, "a int, b int")
    for x, y in itertools.product([o.value for o in Order], repeat=2):
        keys = [("a", x), ("b", y)]
        by_sort = rows(r.sort(keys))
        by_agg = rows(r.aggregate([], {"l": Agg("array_agg", ["struct(a, b)"], order_by=keys)}))[0][0]
        assert [tuple(v) for v in by_agg] == by_sort


def test_broadcasts_are_bounded(spark):
    little, large = Relation(spark.range(3).toDF("k")), Relation(spark.range(1 << 40).toDF("k"))
    assert little.small() and not large.small()
    plan = lambda r: little.join(r, "inner", [("k", "k")], distribution="REPLICATED").df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(little) and "strategy=broadcast" not in plan(large) and "strategy=merge" in plan(large)
    assert large.replicate() is large


def test_masks_over_first_rows_become_distinct(spark):
    """The marker is never sorted for where the aggregate is one of distinct values."""
    df = spark.range(1000).selectExpr("id % 3 as g", "id % 7 as v")
    marked = Relation(df).mark_distinct("first", ["g", "v"])
    out = marked.aggregate(["g"], {"n": Agg("count", ["v"], mask="first"), "s": Agg("sum", ["v"], mask="first")}).df
    assert {tuple(r) for r in out.collect()} == {(g, 7, 21) for g in range(3)} and "Window" not in out._jdf.queryExecution().executedPlan().toString()
    plain = marked.aggregate([], {"n": Agg("count", ["v"], mask="first")}).df  # other keys: the marker itself
    assert plain.first()[0] == 21


def test_grouping_sets_are_expanded_by_spark(spark):
    df = spark.range(100).selectExpr("id % 2 as a", "id % 5 as b")
    out = Relation(df).grouping_sets([["a", "b"], ["a"], ["b"]], {"n": "count(1)"}, "g").df
    assert "Expand" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.g, r.n) for r in out.collect()} == {(0, 10), (1, 50), (2, 20)}


def test_gather_keeps_tasks_before_it(spark):
    plan = Relation(spark.range(100).repartition(3)).gather().df._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "SinglePartition" in plan


def test_skipped_duplicates_are_semi_joins(spark):
    a, b = Relation(spark.range(5).withColumnRenamed("id", "x")), Relation(spark.range(10).selectExpr("id % 3 as y"))
    semi = a.join(b, "inner", [("x", "y")], None, ["x"], [], skip_duplicates=True)
    assert sorted(r.x for r in semi.df.collect()) == [0, 1, 2] and "LeftSemi" in semi.df._jdf.queryExecution().optimizedPlan().toString()
    other = a.join(b, "inner", [("x", "y")], None, [], ["y"], skip_duplicates=True)
    assert sorted(r.y for r in other.df.collect()) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert a.join(b, "inner", [("x", "y")], None, ["x"], []).df.count() == 10


def test_partitions_are_pruned_by_the_other_side(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 10 as p").write.partitionBy("p").parquet(f"{tmp_path}/p")
    few = Relation(spark.range(10).selectExpr("id as k", "id * 2 as w")).filter("w = 8")
    out = Relation(spark.read.parquet(f"{tmp_path}/p")).join(few, "inner", [("p", "k")], None, ["id"], [])
    assert out.df.count() == 100 and "dynamicpruning" in out.df._jdf.queryExecution().executedPlan().toString()


def test_asof_join_edges(spark):
    left = Relation(spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 7, "c"), (None, 7, "d"), (1, None, "e")], "k int, t int, x string"))
    right = Relation(spark.createDataFrame([(1, 5, "r5"), (1, 5, "s5"), (1, 9, "r9"), (2, 8, "late"), (None, 1, "n"), (1, None, "m")], "k int, t int, y string"))
    for bucket in (None, "floor(_time / 3)"):
        got = {r.x: r.y for r in left.asof_join(right, "t", "t", [("k", "k")], ["y"], bucket).df.collect()}
        assert got == {"a": "r9", "b": "s5", "c": None, "d": None, "e": None}


def test_distinct_beside_wide_states(spark):
    """Sketches and percentiles are not kept once per distinct value."""
    r = Relation(spark.range(1000).selectExpr("if(id % 4 = 3, null, id % 4) as k", "id as v"))
    aggs = {"m": "median(v)", "d": Agg("count", ["v"], distinct=True), "s": "hll_sketch_estimate(hll_sketch_agg(v))", "e": "count(distinct v % 10)", "n": "count(1)"}
    one = r.aggregate([], aggs)
    assert one.df.columns == list(aggs) and rows(one)[0][0] == 499.5 and rows(one)[0][1] == 1000 and rows(one)[0][3:] == (10, 1000)
    single = r.aggregate([], {x: aggs[x] for x in "mds"})
    states = [x for x in plan(single).split("Physical Plan")[1].splitlines() if "keys=[v" in x]
    assert states and not any("median" in x or "percentile" in x or "hll" in x for x in states)
    each = {x[0]: (x[1], x[2], x[4], x[5]) for x in rows(r.aggregate(["k"], aggs))}
    assert each == {k: (i + 498.0, 250, 5, 250) for i, k in enumerate((0, 1, 2, None))}
    assert rows(Relation(r.df.limit(0)).aggregate([], aggs))[0][1] == 0
    assert "Join" not in plan(r.aggregate(["k"], {"d": "count(distinct v)", "n": "round(avg(v), 2)"}))


def test_streams_leave_their_result_with_the_executors(spark, tmp_path):
    """A result table is files, the last batch of a complete one and all of others."""
    from sparkloom.streaming import deduplicate, run_available, windowed

    days = spark.range(4000).selectExpr("timestamp_seconds(id * 60) as ts", "id % 5 as u")
    days.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = run_available(windowed(stream(), "ts", "1 day", {"n": F.count(F.lit(1))}, ["u"], late="9 days"))
    assert "FileScan parquet" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.select("u", "n").collect()) == sorted((u, n) for n in (288, 288, 224) for u in range(5))
    assert sorted(r.u for r in run_available(deduplicate(stream(), "ts", ["u"], "9 days"), "append").collect()) == list(range(5))
    (tmp_path / "none").mkdir()
    assert run_available(spark.readStream.schema(days.schema).parquet(f"{tmp_path}/none"), "append").count() == 0
