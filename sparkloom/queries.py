"""Registered queries of the engine and the SQL that they are compared with.

Keys of sorts and limits are made unique, sums of doubles are rounded, and
counts are cast, so that both engines give the same values and types.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import call
from .operators import Agg, Domain, Range, Relation
from .registered import QUERIES, SQL, named, query, rel
from .session import shared_folder
from .sources import sinks
from .streaming import run_available, windowed

# scans, values, projections


@query("select r_name, count(*) as nation_cnt from nation join region on n_regionkey = r_regionkey group by r_name order by r_name")
def nations_per_region(spark, d):
    rows = rel(spark, d, "nation").join(rel(spark, d, "region"), "inner", [("n_regionkey", "r_regionkey")])
    return rows.aggregate(["r_name"], {"nation_cnt": Agg("count", ["1"])}).sort([("r_name", "ASC_NULLS_LAST")]).output(["r_name", "nation_cnt"]).df


_ROWS = [(n, n * n - 9, word) for n, word in enumerate("amber birch cedar dogwood elder fir grape hazel ivy".split(), 3)]
_ROWS_SQL = "(values " + ", ".join(f"(cast({a} as bigint), cast({b} as bigint), '{c}')" for a, b, c in _ROWS) + ") as t(n, m, word)"


@query(f"select n - m as gap, 5 * n + m % 4 as mix, concat(upper(substr(word, 1, 2)), '-', substr(word, 3)) as shown, n % 2 = 1 as odd from {_ROWS_SQL}")
def values_project(spark, d):
    rows = Relation.values(spark, _ROWS, "n long, m long, word string")
    return rows.project({"gap": "n - m", "mix": "5 * n + m % 4", "shown": "concat(upper(substr(word, 1, 2)), '-', substr(word, 3))", "odd": "n % 2 = 1"}).df


@query(f"select cast(sum(n) as bigint) as sum_n, avg(n) as avg_n, cast(sum(m) as bigint) as sum_m, avg(m) as avg_m, count(*) as rows from {_ROWS_SQL}")
def values_aggregate(spark, d):
    return Relation.values(spark, _ROWS, "n long, m long, word string").aggregate([], {"sum_n": "sum(n)", "avg_n": "avg(n)", "sum_m": "sum(m)", "avg_m": "avg(m)", "rows": Agg("count", ["1"])}).df


@query("select 1 as one from range(3)")
def values_without_columns(spark, d):
    return Relation.values(spark, None, row_count=3).project({"one": "1"}).df


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey % 7 = 0")
def filter_mod(spark, d):
    return rel(spark, d, "lineitem").filter("l_orderkey % 7 = 0").output(["l_orderkey", "l_linenumber"]).df


@query("select p_partkey as k, p_retailprice as price from part where p_size >= 10 and p_size < 20")
def scan_assignments(spark, d):
    source = spark.read.parquet(f"{d}/part.parquet")
    return Relation.scan(source, {"k": "p_partkey", "price": "p_retailprice"}, {"p_size": Domain(ranges=[Range(10, 20, True, False)])}).df


@query("select o_orderkey, o_orderstatus, o_custkey from orders where (o_orderstatus in ('F', 'P')) and ((o_custkey between 10 and 200) or o_custkey > 1000) and o_orderpriority not in ('1-URGENT')")
def domain_predicates(spark, d):
    domains = {"o_orderstatus": Domain(["F", "P"]), "o_custkey": Domain(ranges=[Range(10, 200), Range(1000, None, False)]), "o_orderpriority": Domain(["1-URGENT"], inclusive=False)}
    return Relation.scan(spark.read.parquet(f"{d}/orders.parquet"), None, domains).output(["o_orderkey", "o_orderstatus", "o_custkey"]).df


# operators


@query("select l_orderkey, l_linenumber, l_orderkey + l_partkey as a, l_orderkey - l_partkey as s, l_orderkey * 3 as m, l_orderkey // 7 as d, (-l_orderkey) % 7 as r, -l_orderkey as n from lineitem")
def ops_arith(spark, d):
    df = rel(spark, d, "lineitem").df
    f = lambda name, *a: call(df, f"$operator${name}", *a)
    return df.select("l_orderkey", "l_linenumber", f("add", "l_orderkey", "l_partkey").alias("a"), f("subtract", "l_orderkey", "l_partkey").alias("s"), f("multiply", "l_orderkey", "3").alias("m"), f("divide", "l_orderkey", "7").alias("d"), f("modulus", "-l_orderkey", "7").alias("r"), f("negation", "l_orderkey").alias("n"))


@query("select o_orderkey, o_totalprice = 1000 as eq, o_totalprice <> 1000 as ne, o_totalprice > 1000 as gt, o_totalprice >= 1000 as ge, o_totalprice < 1000 as lt, o_totalprice <= 1000 as le, o_totalprice between 1000 and 90000 as bt from orders")
def ops_compare(spark, d):
    df = rel(spark, d, "orders").df
    f = lambda name, *a: call(df, name, "o_totalprice", *a)
    return df.select("o_orderkey", *[f(n, "1000").alias(o) for o, n in (("eq", "equal"), ("ne", "not_equal"), ("gt", "greater_than"), ("ge", "greater_than_or_equal"), ("lt", "less_than"), ("le", "less_than_or_equal"))], f("between", "1000", "90000").alias("bt"))


@query("select c_custkey, o_orderkey, nullif(o_orderstatus, 'F') is distinct from 'O' as x, o_orderkey is not distinct from null as n from customer left join orders on c_custkey = o_custkey")
def ops_distinct_from(spark, d):
    df = rel(spark, d, "customer").join(rel(spark, d, "orders"), "left", [("c_custkey", "o_custkey")]).df
    return df.select("c_custkey", "o_orderkey", call(df, "is_distinct_from", "nullif(o_orderstatus, 'F')", "'O'").alias("x"), (~call(df, "is_distinct_from", "o_orderkey", "cast(null as bigint)")).alias("n"))


@query("select vec_id, embedding[1] as first, embedding[3] as third, map {'a': vec_id}['a'] as a, map {'a': vec_id}['b'] as b from embeddings")
def ops_subscript(spark, d):
    df = rel(spark, d, "embeddings").df
    m = F.create_map(F.lit("a"), F.col("vec_id"))
    return df.select("vec_id", call(df, "subscript", "embedding", "1").alias("first"), call(df, "subscript", "embedding", "3").alias("third"), call(df, "subscript", m, "'a'").alias("a"), call(df, "subscript", m, "'b'").alias("b"))


@query("select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size_class, coalesce(nullif(p_size, 1), -1) as c, p_size in (1, 2, 3) as i, not (p_size > 5 and p_retailprice > 1000) or p_size = 7 as l, cast(p_size as varchar) as t from part")
def ops_logic(spark, d):
    df = rel(spark, d, "part").df
    cond = call(df, "or", call(df, "not", call(df, "and", "p_size > 5", "p_retailprice > 1000")), "p_size = 7")
    return df.select("p_partkey", call(df, "switch", "p_size < 10", "'small'", "p_size < 30", "'medium'", "'large'").alias("size_class"), call(df, "coalesce", call(df, "nullif", "p_size", "1"), "-1").alias("c"), call(df, "in", "p_size", F.lit(1), F.lit(2), F.lit(3)).alias("i"), cond.alias("l"), F.col("p_size").cast("string").alias("t"))


@query("select n_nationkey, true as within from nation")
def ops_random(spark, d):
    df = rel(spark, d, "nation").df
    return df.select("n_nationkey", call(df, "random").between(0, 1).alias("within"))


# aggregation


@query("select count(*) as n, cast(sum(l_linenumber) as bigint) as lines, round(avg(l_quantity), 6) as avg_qty, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from lineitem")
def global_agg(spark, d):
    return rel(spark, d, "lineitem").aggregate([], {"n": "count(1)", "lines": "sum(l_linenumber)", "avg_qty": "round(avg(l_quantity), 6)", "first_ship": "min(l_shipdate)", "last_ship": "max(l_shipdate)"}).df


@query("select count(*) as n, cast(sum(n_nationkey) as bigint) as s, max(n_name) as m from nation where n_nationkey > 99")
def global_agg_empty(spark, d):
    return rel(spark, d, "nation").filter("n_nationkey > 99").aggregate([], {"n": "count(1)", "s": "sum(n_nationkey)", "m": "max(n_name)"}).df


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem group by all")
def pricing_summary(spark, d):
    return rel(spark, d, "lineitem").aggregate(["l_returnflag", "l_linestatus"], {"sum_qty": "round(sum(l_quantity), 2)", "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 2)", "avg_disc": "round(avg(l_discount), 6)", "n": "count(1)"}).df


@query("select l_returnflag, count(distinct l_suppkey) as suppliers, count(*) filter (where l_discount > 0.05) as discounted, cast(sum(distinct l_linenumber) as bigint) as s from lineitem group by l_returnflag")
def agg_distinct_filter(spark, d):
    return rel(spark, d, "lineitem").aggregate(["l_returnflag"], {"suppliers": Agg("count", ["l_suppkey"], distinct=True), "discounted": Agg("count", [], filter="l_discount > 0.05"), "s": Agg("sum", ["l_linenumber"], distinct=True)}).df


@query("select o_orderpriority, count(distinct o_custkey) as customers from orders group by 1")
def agg_mask(spark, d):
    rows = rel(spark, d, "orders").mark_distinct("is_first", ["o_orderpriority", "o_custkey"])
    return rows.aggregate(["o_orderpriority"], {"customers": Agg("count", ["o_custkey"], mask="is_first")}).df


@query("select n_regionkey, string_agg(n_name, ',' order by n_name desc) as names, list(n_nationkey order by n_name asc) as keys from nation group by 1")
def agg_ordered(spark, d):
    return rel(spark, d, "nation").aggregate(["n_regionkey"], {"names": Agg("listagg", ["n_name", "','"], order_by=[("n_name", "DESC_NULLS_LAST")]), "keys": Agg("array_agg", ["n_nationkey"], order_by=[("n_name", "ASC_NULLS_LAST")])}).df


@query("select distinct o_orderstatus, o_orderpriority from orders")
def agg_distinct_rows(spark, d):
    return rel(spark, d, "orders").aggregate(["o_orderstatus", "o_orderpriority"]).df


@query("select o_orderstatus, o_orderpriority, count(*) as n, max(o_custkey) as top from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark, d):
    return rel(spark, d, "orders").grouping_sets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], {"n": "count(1)", "top": "max(o_custkey)"}).df


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return rel(spark, d, "orders").rollup(["o_orderstatus", "o_orderpriority"], {"n": "count(1)"}).df


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return rel(spark, d, "orders").cube(["o_orderstatus", "o_orderpriority"], {"n": "count(1)"}).df


@query("select n_regionkey, cast(0 as bigint) as g, count(*) as n from nation group by 1 union all select n_regionkey, 1, count(*) from nation group by 1 union all select null, 2, count(*) from nation")
def grouping_sets_repeated(spark, d):
    return rel(spark, d, "nation").grouping_sets([["n_regionkey"], ["n_regionkey"], []], {"n": "count(1)"}, "g").df


@query("select cast(null as integer) as n_regionkey, count(*) as n from nation where n_nationkey > 99")
def grouping_sets_empty(spark, d):
    return rel(spark, d, "nation").filter("n_nationkey > 99").grouping_sets([["n_regionkey"], []], {"n": "count(1)"}).df


@query("select n_regionkey as r, n_nationkey, cast(0 as bigint) as g from nation union all select null, n_nationkey, 1 from nation")
def group_id(spark, d):
    return rel(spark, d, "nation").group_id([["r"], []], {"r": "n_regionkey"}, ["n_nationkey"], "g").output(["r", "n_nationkey", "g"]).df


# order and limits

_PRICES = "select o_orderkey, nullif(o_totalprice, case when o_orderkey % 5 = 0 then o_totalprice end) as price from orders"


def _sorted(order: str) -> None:
    keys = [("price", order), ("o_orderkey", "ASC_NULLS_LAST")]
    words = order.replace("_", " ", 1).replace("_", " ")
    prices = lambda spark, d: rel(spark, d, "orders").project({"o_orderkey": "o_orderkey", "price": "nullif(o_totalprice, case when o_orderkey % 5 = 0 then o_totalprice end)"})
    named(f"sort_{order.lower()}", f"{_PRICES} order by price {words}, o_orderkey", lambda spark, d: prices(spark, d).sort(keys).df)
    named(f"merge_{order.lower()}", f"{_PRICES} order by price {words}, o_orderkey", lambda spark, d: prices(spark, d).round_robin(3).sort(keys, partial=True).merge_sorted(keys).df)
    named(f"top_n_{order.lower()}", f"{_PRICES} order by price {words}, o_orderkey limit 700", lambda spark, d: prices(spark, d).top_n(700, keys).df)


for _order in ("ASC_NULLS_FIRST", "ASC_NULLS_LAST", "DESC_NULLS_FIRST", "DESC_NULLS_LAST"):
    _sorted(_order)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey")
def sort_total(spark, d):
    return rel(spark, d, "orders").output(["o_orderkey", "o_totalprice"]).sort([("o_totalprice", "DESC_NULLS_LAST"), ("o_orderkey", "ASC_NULLS_FIRST")]).df


@query("select o_orderkey, o_custkey from orders")
def sort_partial(spark, d):
    return rel(spark, d, "orders").output(["o_orderkey", "o_custkey"]).hash_partition(["o_custkey"]).sort([("o_custkey", "ASC_NULLS_LAST")], partial=True).df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_n(spark, d):
    return rel(spark, d, "orders").output(["o_orderkey", "o_totalprice"]).top_n(25, [("o_totalprice", "DESC_NULLS_LAST"), ("o_orderkey", "ASC_NULLS_LAST")]).df


@query("select p_partkey, p_size from (select *, rank() over (order by p_size desc nulls last) as r from part) where r <= 10")
def limit_ties(spark, d):
    return rel(spark, d, "part").output(["p_partkey", "p_size"]).limit(10, ties=[("p_size", "DESC_NULLS_LAST")]).df


@query("select count(*) as n from (select * from orders limit 37)")
def limit_rows(spark, d):
    return rel(spark, d, "orders").limit(37).aggregate([], {"n": "count(1)"}).df


@query("select o_orderkey from orders order by o_orderkey desc offset 10 limit 20")
def offset_limit(spark, d):
    return rel(spark, d, "orders").output(["o_orderkey"]).offset_limit(10, 20, [("o_orderkey", "DESC_NULLS_LAST")]).df


@query("select count(*) as n, count(distinct (o_orderstatus, o_orderpriority)) as k from (select distinct o_orderstatus, o_orderpriority from orders limit 4)")
def distinct_limit(spark, d):
    return rel(spark, d, "orders").distinct_limit(4, ["o_orderstatus", "o_orderpriority"]).aggregate([], {"n": "count(1)", "k": "count(distinct o_orderstatus, o_orderpriority)"}).df


# joins


def _join(name: str, how: str, on: str, residual=None) -> None:
    """Nations are shifted, so that both sides have rows without a partner.
    They are 25 at any size, so every pair of one nation's rows is a result."""

    def run(spark, d):
        left = rel(spark, d, "customer").output(["c_custkey", "c_nationkey", "c_acctbal"])
        right = rel(spark, d, "supplier").project({"s_suppkey": "s_suppkey", "s_acctbal": "s_acctbal", "k": "s_nationkey + 5"})
        return left.join(right, how, [("c_nationkey", "k")], residual, ["c_custkey", "c_nationkey"], ["s_suppkey", "s_acctbal"], "DEALT").df

    named(name, f"select c_custkey, c_nationkey, s_suppkey, s_acctbal from customer {how} join supplier on {on}", run)


for _how in ("inner", "left", "right", "full"):
    _join(f"join_{_how}", _how, "c_nationkey = s_nationkey + 5")
    _join(f"join_residual_{_how}", _how, "c_nationkey = s_nationkey + 5 and c_acctbal < s_acctbal", "l.c_acctbal < r.s_acctbal")


@query("select a.r_name as a, b.n_name as b from region a cross join nation b")
def join_cross(spark, d):
    return rel(spark, d, "region").project({"a": "r_name"}).join(rel(spark, d, "nation").project({"b": "n_name"}), "inner", []).df


@query("select l_orderkey, l_linenumber, l_suppkey, s_name, s_nationkey from lineitem join (select s_suppkey, s_nationkey, s_name from supplier) on l_suppkey = s_suppkey and l_linenumber = s_nationkey % 7 + 1")
def join_multi_key(spark, d):
    right = rel(spark, d, "supplier").project({"s_suppkey": "s_suppkey", "line": "s_nationkey % 7 + 1", "s_name": "s_name", "s_nationkey": "s_nationkey"})
    return rel(spark, d, "lineitem").join(right, "inner", [("l_suppkey", "s_suppkey"), ("l_linenumber", "line")], None, ["l_orderkey", "l_linenumber", "l_suppkey"], ["s_name", "s_nationkey"]).df


def _distribution(name: str, how: str) -> None:
    def run(spark, d):
        return rel(spark, d, "lineitem").join(rel(spark, d, "part"), "inner", [("l_partkey", "p_partkey")], distribution=how).aggregate(["p_brand"], {"n": "count(1)", "qty": "round(sum(l_quantity), 2)"}).df

    named(name, "select p_brand, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem join part on l_partkey = p_partkey group by 1", run)


for _name, _how in (("join_broadcast", "REPLICATED"), ("join_partitioned", "PARTITIONED"), ("join_merge", "MERGE")):
    _distribution(_name, _how)


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_semi(spark, d):
    return rel(spark, d, "customer").join(rel(spark, d, "orders").filter("o_totalprice > 200000"), "semi", [("c_custkey", "o_custkey")], None, ["c_custkey", "c_name"]).df


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(spark, d):
    return rel(spark, d, "customer").join(rel(spark, d, "orders"), "anti", [("c_custkey", "o_custkey")], None, ["c_custkey"]).df


@query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from region join nation on r_regionkey = n_regionkey join supplier on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey and c_nationkey = s_nationkey where r_name = (select min(r_name) from region) and o_orderdate >= timestamp '1995-01-01' group by 1")
def local_supplier_volume(spark, d):
    region = rel(spark, d, "region")
    first = region.aggregate([], {"first": "min(r_name)"}).enforce_single_row()
    region = region.join(first, "inner", [("r_name", "first")], None, ["r_regionkey"], [])
    nation = rel(spark, d, "nation").join(region, "inner", [("n_regionkey", "r_regionkey")], None, ["n_nationkey", "n_name"], [])
    supplier = rel(spark, d, "supplier").join(nation, "inner", [("s_nationkey", "n_nationkey")], None, ["s_suppkey", "s_nationkey"], ["n_name"])
    orders = rel(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1995-01-01'")
    lines = rel(spark, d, "lineitem").join(supplier, "inner", [("l_suppkey", "s_suppkey")], None, ["l_orderkey", "l_extendedprice", "l_discount"], ["n_name", "s_nationkey"])
    lines = lines.join(orders, "inner", [("l_orderkey", "o_orderkey")], None, None, ["o_custkey"])
    lines = lines.join(rel(spark, d, "customer"), "inner", [("o_custkey", "c_custkey"), ("s_nationkey", "c_nationkey")], None, None, [])
    return lines.aggregate(["n_name"], {"revenue": "round(sum(l_extendedprice * (1 - l_discount)), 2)"}).df


# unions, exchanges, sets


@query("select c_name as name, c_acctbal as bal from customer union all select s_name, s_acctbal from supplier")
def union_all_mapped(spark, d):
    return rel(spark, d, "customer").union_all(rel(spark, d, "supplier"), inputs=[["c_name", "c_acctbal"], ["s_name", "s_acctbal"]], outputs=["name", "bal"]).df


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, d):
    return rel(spark, d, "customer").union(rel(spark, d, "supplier"), inputs=[["c_nationkey"], ["s_nationkey"]], outputs=["k"]).df


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(spark, d):
    return rel(spark, d, "customer").project({"k": "c_nationkey"}).intersect(rel(spark, d, "supplier").project({"k": "s_nationkey"})).df


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def set_except_all(spark, d):
    return rel(spark, d, "customer").project({"k": "c_nationkey"}).except_(rel(spark, d, "supplier").project({"k": "s_nationkey"}), all=True).df


@query("select o_orderstatus, count(*) as n from orders group by 1")
def exchange_kinds(spark, d):
    rows = rel(spark, d, "orders").round_robin(4).hash_partition(["o_orderstatus", F.lit(1)], 4)
    return rows.aggregate(["o_orderstatus"], {"n": "count(1)"}).gather().df


# nested values


@query("select vec_id, generate_subscripts(embedding, 1) as pos, unnest(embedding) as x from embeddings")
def unnest(spark, d):
    return rel(spark, d, "embeddings").unnest(["vec_id"], {"embedding": ["x"]}, "pos").df.select("vec_id", "pos", "x")


_NESTED_SQL = "(values (1, [10, 20, 30], ['a'], map {'x': 1, 'y': 2}), (2, [], ['b', 'c'], map {}), (3, null, null, null)) as t(id, nums, words, m)"


def _nested(spark):
    return Relation(spark.sql("select * from values (1, array(10, 20, 30), array('a'), map('x', 1, 'y', 2)), (2, cast(array() as array<int>), array('b', 'c'), cast(map() as map<string,int>)), (3, null, null, null) as t(id, nums, words, m)"))


@query(f"select id, cast(i as bigint) as at, nums[i] as num, words[i] as word from {_NESTED_SQL}, range(1, 4) as r(i) where i <= greatest(coalesce(len(nums), 0), coalesce(len(words), 0))")
def unnest_side_by_side(spark, d):
    return _nested(spark).unnest(["id"], {"nums": ["num"], "words": ["word"]}, "at").df


@query(f"select id, unnest(map_keys(m)) as k, unnest(map_values(m)) as v from {_NESTED_SQL} union all select id, null, null from {_NESTED_SQL} where coalesce(cardinality(m), 0) = 0")
def unnest_map_outer(spark, d):
    return _nested(spark).unnest(["id"], {"m": ["k", "v"]}, outer=True).df


@query("select count(distinct id) = count(*) as unique_ids, count(*) as n from (select row_number() over () as id from orders)")
def assign_unique_id(spark, d):
    return rel(spark, d, "orders").assign_unique_id("id").aggregate([], {"unique_ids": "count(distinct id) = count(1)", "n": "count(1)"}).df


@query("select event_id, cast(props->>'$.k' as bigint) as k from events")
def json_extract(spark, d):
    df = rel(spark, d, "events").df
    return df.select("event_id", call(df, "json_extract_scalar", "props", "'$.k'").cast("long").alias("k"))


@query("select vec_id, len(embedding) as n, list_min(embedding) as lo, list_max(embedding) as hi, list_position(embedding, embedding[2]) as pos, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)), 4) as norm, list_contains(embedding, embedding[5]) as has, len(list_filter(embedding, lambda x: x > 0)) as positive from embeddings")
def array_fns(spark, d):
    df = rel(spark, d, "embeddings").df
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return df.select("vec_id", call(df, "cardinality", "embedding").cast("long").alias("n"), F.array_min("embedding").alias("lo"), F.array_max("embedding").alias("hi"), F.array_position("embedding", F.element_at("embedding", 2)).cast("int").alias("pos"), F.round(norm, 4).alias("norm"), call(df, "contains", "embedding", F.element_at("embedding", 5)).alias("has"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@query("select n_nationkey, map_keys(m) as k, map_values(m) as v, cast(cardinality(m) as bigint) as n from (select n_nationkey, map {'key': n_nationkey, 'region': n_regionkey} as m from nation)")
def map_fns(spark, d):
    rows = rel(spark, d, "nation").project({"n_nationkey": "n_nationkey", "m": "map('key', n_nationkey, 'region', n_regionkey)"})
    return rows.project({"n_nationkey": "n_nationkey", "k": "map_keys(m)", "v": "map_values(m)", "n": "cast(cardinality(m) as bigint)"}).df


# scalar functions


@query("select doc_id, sha256(lower(text)) as lo, sha256(upper(replace(text, 'ß', 'ss'))) as up, length(text) as len, sha256(reverse(text)) as rev, substr(text, 2, 30) as sub, sha256(replace(text, 'e', 'xy')) as rep, instr(text, 'the') as pos, sha256(concat(text, '/', doc_id)) as cc, sha256(split_part(text, 'e', 2)) as part, sha256(trim('  ' || text || ' ', ' ')) as t, sha256(translate(text, 'ae', 'AE')) as tr, left(text, 1) as c1, right(text, 2) as c2, starts_with(text, 'T') as st, suffix(text, '.') as en from documents where text is not null")
def string_fns(spark, d):
    df = rel(spark, d, "documents").df.filter("text is not null")
    f = lambda name, *a: call(df, name, *a)
    h = lambda c: F.sha2(c, 256)
    return df.select("doc_id", h(f("lower", "text")).alias("lo"), h(f("upper", f("replace", "text", "'ß'", "'ss'"))).alias("up"), f("length", "text").cast("long").alias("len"), h(f("reverse", "text")).alias("rev"), f("substr", "text", "2", "30").alias("sub"), h(f("replace", "text", "'e'", "'xy'")).alias("rep"), f("strpos", "text", "'the'").alias("pos"), h(f("concat", "text", "'/'", "doc_id")).alias("cc"), h(f("split_part", "text", "'e'", "2")).alias("part"), h(f("trim", "'  ' || text || ' '")).alias("t"), h(f("translate", "text", "'ae'", "'AE'")).alias("tr"), f("left", "text", "1").alias("c1"), f("right", "text", "2").alias("c2"), f("starts_with", "text", "'T'").alias("st"), f("ends_with", "text", "'.'").alias("en"))


@query("select n_nationkey, lpad(n_name, 12, '*') as lp, rpad(n_name, 12, '-') as rp, levenshtein(n_name, 'CHINA') as lev, repeat(n_name, 3) as r3, hamming(n_name, reverse(n_name)) as ham, ascii(n_name) as cp, chr(n_nationkey + 65) as ch, ltrim('xx' || n_name, 'x') as lt, rtrim(n_name || 'xx', 'x') as rt, length(n_name) - instr(reverse(n_name), 'A') + 1 as last_a, string_split(n_name, 'A') as parts, case when len(string_split(n_name, 'A')) > 2 then length(string_split(n_name, 'A')[1]) + length(string_split(n_name, 'A')[2]) + 2 else 0 end as second_a, concat_ws('|', n_name, null, n_regionkey) as cw from nation where contains(n_name, 'A')")
def string_fns_short(spark, d):
    df = rel(spark, d, "nation").df.filter("contains(n_name, 'A')")
    f = lambda name, *a: call(df, name, *a)
    return df.select("n_nationkey", f("lpad", "n_name", "12", "'*'").alias("lp"), f("rpad", "n_name", "12", "'-'").alias("rp"), f("levenshtein_distance", "n_name", "'CHINA'").alias("lev"), f("array_join", F.array_repeat("n_name", 3), "''").alias("r3"), f("hamming_distance", "n_name", "reverse(n_name)").alias("ham"), f("codepoint", "n_name").alias("cp"), f("chr", "n_nationkey + 65").alias("ch"), F.ltrim(F.concat(F.lit("xx"), "n_name"), F.lit("x")).alias("lt"), F.rtrim(F.concat("n_name", F.lit("xx")), F.lit("x")).alias("rt"), f("strrpos", "n_name", "'A'").alias("last_a"), f("split", "n_name", "'A'").alias("parts"), f("strpos", "n_name", "'A'", "2").alias("second_a"), f("concat_ws", "'|'", "n_name", "null", "n_regionkey").alias("cw"))


@query("select page_id, regexp_matches(url, 'https?://[^/]*example') as ex, regexp_extract(url, '://([^/]+)', 1) as host, regexp_replace(url, '[0-9]+', '#', 'g') as masked, cast(len(regexp_extract_all(url, '[0-9]')) as integer) as digits from pages")
def regex_fns(spark, d):
    df = rel(spark, d, "pages").df
    return df.select("page_id", call(df, "regexp_like", "url", F.lit("https?://[^/]*example")).alias("ex"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_replace("url", "[0-9]+", "#").alias("masked"), F.size(F.regexp_extract_all("url", F.lit("([0-9])"))).alias("digits"))


@query("select doc_id, md5(text) as m, sha256(text) as s, sha256(hex(encode(text))) as h, sha256(base64(encode(text))) as b, sha256(base64(encode(text))) as back from documents where text is not null")
def hash_fns(spark, d):
    df = rel(spark, d, "documents").df.filter("text is not null")
    f = lambda name, *a: call(df, name, *a)
    again = call(df, "to_base64", call(df, "from_base64", f("to_base64", "text")))
    return df.select("doc_id", F.lower(f("to_hex", f("md5", "text"))).alias("m"), F.lower(f("to_hex", f("sha256", "text"))).alias("s"), F.sha2(f("to_hex", "text"), 256).alias("h"), F.sha2(f("to_base64", "text"), 256).alias("b"), F.sha2(again, 256).alias("back"))


@query("select o_orderkey, abs(o_totalprice - 1000) as a, ceil(o_totalprice) as c, floor(o_totalprice) as f, round(sqrt(o_totalprice), 6) as s, round(ln(o_totalprice), 6) as l, round(log10(o_totalprice), 6) as l10, round(pow(o_totalprice, 0.5), 6) as p, sign(o_totalprice - 50000) as g, greatest(o_orderkey, o_custkey) as gr, least(o_orderkey, o_custkey) as le, o_orderkey & 255 as ba, o_orderkey | 1 as bo, xor(o_orderkey, 3) as bx from orders")
def math_fns(spark, d):
    df = rel(spark, d, "orders").df
    return df.select("o_orderkey", *[F.expr(e).alias(n) for n, e in {"a": "abs(o_totalprice - 1000)", "c": "cast(ceil(o_totalprice) as double)", "f": "cast(floor(o_totalprice) as double)", "s": "round(sqrt(o_totalprice), 6)", "l": "round(ln(o_totalprice), 6)", "l10": "round(log10(o_totalprice), 6)", "p": "round(pow(o_totalprice, 0.5), 6)", "g": "cast(sign(o_totalprice - 50000) as tinyint)", "gr": "greatest(o_orderkey, o_custkey)", "le": "least(o_orderkey, o_custkey)"}.items()], call(df, "bitwise_and", "o_orderkey", F.lit(255)).alias("ba"), call(df, "bitwise_or", "o_orderkey", F.lit(1)).alias("bo"), call(df, "bitwise_xor", "o_orderkey", F.lit(3)).alias("bx"))


@query("select event_id, cast(year(ts) as integer) as y, cast(month(ts) as integer) as m, cast(day(ts) as integer) as dd, cast(hour(ts) as integer) as h, cast(quarter(ts) as integer) as q, cast(dayofyear(ts) as integer) as doy, date_trunc('hour', ts) as hr, cast(ts as date) as dt, strftime(ts, '%Y-%m-%d %H:%M') as f, last_day(ts) as ld, date_diff('day', date '2020-01-01', cast(ts as date)) as days from events")
def date_parts(spark, d):
    return rel(spark, d, "events").df.selectExpr("event_id", "year(ts) y", "month(ts) m", "day(ts) dd", "hour(ts) h", "quarter(ts) q", "dayofyear(ts) doy", "cast(date_trunc('hour', ts) as timestamp_ntz) hr", "cast(ts as date) dt", "date_format(ts, 'yyyy-MM-dd HH:mm') f", "last_day(ts) ld", "cast(datediff(cast(ts as date), date'2020-01-01') as bigint) days")


@query("select o_orderkey, o_orderdate + interval 3 day as d3, o_orderdate - interval 2 hour as h2, o_orderdate + interval 1 month as m1 from orders")
def interval_add(spark, d):
    return rel(spark, d, "orders").df.selectExpr("o_orderkey", "o_orderdate + interval '3' day d3", "o_orderdate - interval '2' hour h2", "o_orderdate + interval '1' month m1")


@query("select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(18,2)) as p, cast(l_extendedprice as decimal(18,2)) + cast(l_tax as decimal(18,2)) as s from lineitem")
def decimal_ops(spark, d):
    return rel(spark, d, "lineitem").df.selectExpr("l_orderkey", "l_linenumber", "cast(l_extendedprice as decimal(18,2)) p", "cast(l_extendedprice as decimal(18,2)) + cast(l_tax as decimal(18,2)) s")


# aggregate functions


@query("select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_quantity), 6) as vp, round(corr(l_quantity, l_extendedprice), 6) as co, round(covar_pop(l_quantity, l_discount), 6) as cv, round(skewness(l_quantity), 4) as sk, median(l_quantity) as med, bool_and(l_quantity > 0) as ba, bool_or(l_discount > 0.09) as bo, bit_and(l_orderkey) as bia, bit_or(l_orderkey) as bio, bit_xor(l_orderkey) as bix, cast(count_if(l_tax > 0.04) as bigint) as ci, min_by(l_orderkey, l_orderkey * 10 + l_linenumber) as mib, max_by(l_orderkey, l_orderkey * 10 + l_linenumber) as mab from lineitem group by 1")
def agg_fns(spark, d):
    return rel(spark, d, "lineitem").aggregate(["l_returnflag"], {"sd": "round(stddev_samp(l_quantity), 6)", "vp": "round(var_pop(l_quantity), 6)", "co": "round(corr(l_quantity, l_extendedprice), 6)", "cv": "round(covar_pop(l_quantity, l_discount), 6)", "sk": "round(skewness(l_quantity) * sqrt(count(1) * (count(1) - 1)) / (count(1) - 2), 4)", "med": "median(l_quantity)", "ba": "bool_and(l_quantity > 0)", "bo": "bool_or(l_discount > 0.09)", "bia": Agg("bitwise_and_agg", ["l_orderkey"]), "bio": Agg("bitwise_or_agg", ["l_orderkey"]), "bix": Agg("bitwise_xor_agg", ["l_orderkey"]), "ci": "count_if(l_tax > 0.04)", "mib": "min_by(l_orderkey, l_orderkey * 10 + l_linenumber)", "mab": "max_by(l_orderkey, l_orderkey * 10 + l_linenumber)"}).df


@query("select n_regionkey, list_sort(list(n_name)) as names, len(list_distinct(list(n_regionkey))) as k from nation group by 1")
def agg_collections(spark, d):
    return rel(spark, d, "nation").aggregate(["n_regionkey"], {"names": "array_sort(array_agg(n_name))", "k": "cast(size(collect_set(n_regionkey)) as bigint)"}).df


@query("select true as close, true as middle from (select 1)")
def agg_approximate(spark, d):
    rows = rel(spark, d, "lineitem").aggregate([], {"exact": "count(distinct l_orderkey)", "approx": Agg("approx_distinct", ["l_orderkey"]), "sketch": "hll_sketch_estimate(hll_sketch_agg(l_orderkey))", "p50": "approx_percentile(l_quantity, 0.5)", "median": "median(l_quantity)"})
    return rows.project({"close": "abs(approx - exact) <= 0.15 * exact and abs(sketch - exact) <= 0.15 * exact", "middle": "abs(p50 - median) <= 1"}).df


# writing and reading back


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def write_roundtrip(spark, d):
    rows, path = rel(spark, d, "orders").output(["o_orderkey", "o_custkey", "o_orderstatus"]).df, shared_folder(spark, "roundtrip")
    sinks.write_files(rows.filter("o_orderkey % 2 = 0"), path, "orc", partitioned_by=["o_orderstatus"])
    sinks.write_files(rows.filter("o_orderkey % 2 = 1"), path, "orc", mode="append", partitioned_by=["o_orderstatus"])
    return spark.read.schema(rows.schema).orc(path)


@query("select count(*) as rows, min(o_custkey) as lo, max(o_custkey) as hi, count(o_orderstatus) as present, max(octet_length(encode(o_orderpriority))) as longest from orders")
def write_stats(spark, d):
    stats = sinks.column_statistics(rel(spark, d, "orders").df, ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return stats.select("rows", F.col("`o_custkey$min`").alias("lo"), F.col("`o_custkey$max`").alias("hi"), F.col("`o_orderstatus$non_null`").alias("present"), F.col("`o_orderpriority$max_size`").alias("longest"))


# extensions: windows, streams, user functions


@query("select o_orderkey, row_number() over w as rn, rank() over (partition by o_custkey order by o_orderdate) as rk, lag(o_orderkey) over w as prev, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as run, ntile(4) over w as nt, first_value(o_orderkey) over w as f from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def window_fns(spark, d):
    keys = [("o_orderdate", "ASC_NULLS_LAST"), ("o_orderkey", "ASC_NULLS_LAST")]
    rows = rel(spark, d, "orders").window({"rn": "row_number()", "prev": "lag(o_orderkey)", "nt": "ntile(4)", "f": "first_value(o_orderkey)"}, ["o_custkey"], keys)
    rows = rows.window({"rk": "rank()"}, ["o_custkey"], keys[:1]).window({"run": "sum(o_totalprice)"}, ["o_custkey"], keys, ("rows", -2, 0))
    return rows.project({"o_orderkey": "o_orderkey", "rn": "cast(rn as long)", "rk": "cast(rk as long)", "prev": "prev", "run": "round(run, 2)", "nt": "cast(nt as long)", "f": "f"}).df


@query("select o_orderkey, dense_rank() over w as dr, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd, lead(o_orderkey, 2, -1) over (partition by o_custkey order by o_orderkey) as nx, last_value(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as la, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey) as n2, count(*) over (partition by o_custkey order by o_orderkey rows between 1 following and 3 following) as ahead from orders window w as (partition by o_orderstatus order by o_orderpriority)")
def window_more(spark, d):
    key = [("o_orderkey", "ASC_NULLS_LAST")]
    rows = rel(spark, d, "orders").window({"dr": "dense_rank()", "pr": "percent_rank()", "cd": "cume_dist()"}, ["o_orderstatus"], [("o_orderpriority", "ASC_NULLS_LAST")])
    rows = rows.window({"nx": "lead(o_orderkey, 2, -1L)", "n2": "nth_value(o_orderkey, 2)"}, ["o_custkey"], key).window({"la": "last_value(o_orderkey)"}, ["o_custkey"], key, ("rows", None, None)).window({"ahead": "count(1)"}, ["o_custkey"], key, ("rows", 1, 3))
    return rows.project({"o_orderkey": "o_orderkey", "dr": "cast(dr as long)", "pr": "round(pr, 6)", "cd": "round(cd, 6)", "nx": "nx", "la": "la", "n2": "n2", "ahead": "ahead"}).df


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_daily_counts(spark, d):
    source = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_available(windowed(stream, "ts", "1 day", {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}, ["event_type"]))
    return out.select(F.to_utc_timestamp("window_start", F.current_timezone()).cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("select s_suppkey, round(s_acctbal * 1.1 + 1, 4) as x from supplier")
def pandas_udf_scalar(spark, d):
    @F.pandas_udf("double")
    def grown(x):
        return x * 1.1 + 1

    return rel(spark, d, "supplier").df.select("s_suppkey", F.round(grown("s_acctbal"), 4).alias("x"))


@query("select o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 2) as spread from orders group by 1")
def pandas_udf_aggregate(spark, d):
    def spread(x):
        return float(x.max() - x.min())

    udaf = F.pandas_udf(spread, "double", F.PandasUDFType.GROUPED_AGG)
    return rel(spark, d, "orders").df.groupBy("o_orderstatus").agg(F.round(udaf("o_totalprice"), 2).alias("spread"))


@query("select r_regionkey, i as step, r_regionkey * i as v from region, range(1, 4) as t(i)")
def table_function(spark, d):
    @F.udtf(returnType="step: bigint, v: bigint")
    class Steps:
        def eval(self, k: int):
            for i in range(1, 4):
                yield i, k * i

    name = f"steps_{uuid.uuid4().hex}"
    spark.udtf.register(name, Steps)
    rel(spark, d, "region").df.createOrReplaceTempView(f"{name}_in")
    return spark.sql(f"select r_regionkey, step, v from {name}_in, lateral {name}(r_regionkey)")


@query("select a.event_id, max(b.event_id) as before from events a join events b on a.user_id = b.user_id and b.ts < a.ts and b.ts >= a.ts - interval 1 hour group by 1")
def join_time_range(spark, d):
    left, right = rel(spark, d, "events"), rel(spark, d, "events").project({"other": "event_id", "u": "user_id", "t": "ts"})
    rows = left.join(right, "inner", [("user_id", "u")], "r.t < l.ts and r.t >= l.ts - interval '1' hour", ["event_id"], ["other"])
    return rows.aggregate(["event_id"], {"before": "max(other)"}).df


@query("select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as recent from events")
def window_time_range(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "user_id", "count(1) over (partition by user_id order by ts range between interval '1' day preceding and current row) as recent")


@query("select * from (select doc_id, lang, row_number() over (partition by lang order by n_chars desc, doc_id) as rn from documents where lang is not null) where rn <= 3")
def top_n_per_group(spark, d):
    rows = rel(spark, d, "documents").filter("lang is not null")
    return rows.top_n_per_group(3, ["lang"], [("n_chars", "DESC_NULLS_LAST"), ("doc_id", "ASC_NULLS_LAST")], "rn").output(["doc_id", "lang", "rn"]).df


@query("select l_shipdate >= timestamp '1995-01-01' as late, round(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then l_extendedprice else 0 end), 2) as urgent, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1")
def priority_revenue(spark, d):
    rows = rel(spark, d, "lineitem").join(rel(spark, d, "orders"), "inner", [("l_orderkey", "o_orderkey")], None, ["l_shipdate", "l_extendedprice"], ["o_orderpriority"])
    rows = rows.project({"late": "l_shipdate >= timestamp_ntz'1995-01-01'", "urgent": "case when o_orderpriority in ('1-URGENT', '2-HIGH') then l_extendedprice else 0 end"})
    return rows.aggregate(["late"], {"urgent": "round(sum(urgent), 2)", "n": "count(1)"}).df


# the other modules register theirs

from . import queries_functions, queries_plans, queries_tables  # noqa: E402

__all__ = ["QUERIES", "SQL", "queries_functions", "queries_plans", "queries_tables"]
