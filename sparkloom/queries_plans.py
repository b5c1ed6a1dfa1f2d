"""Registered queries of declared plans, exchanges, joins beyond equality, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import Relation
from .plans import build
from .registered import query, rel
from .session import shared_folder
from .sources import readers, sinks
from .streaming import deduplicate, keep_latest, run_available, session_counts, windowed


def _open(spark, d):
    return lambda t: spark.read.parquet(f"{d}/{t['name']}.parquet")


def _scan(table: str, **assignments: str) -> dict:
    return {"@type": ".TableScanNode", "table": {"name": table}, "outputSymbols": list(assignments), "assignments": assignments}


def _var(name: str, kind: str = "bigint") -> dict:
    return {"@type": "variable", "name": name, "type": kind}


def _const(value, kind: str) -> dict:
    return {"@type": "constant", "value": value, "type": kind}


def _call(name: str, *args) -> dict:
    return {"@type": "call", "name": f"presto.default.{name}", "arguments": list(args)}


def _form(form: str, *args) -> dict:
    return {"@type": "special", "form": form, "arguments": list(args)}


# plans


@query("select n_regionkey as r, count(*) as n from nation where n_nationkey > 3 group by 1 order by r desc nulls last limit 3")
def declared_plan(spark, d):
    agg = {"@type": ".AggregationNode", "source": {"@type": ".FilterNode", "source": _scan("nation", k="n_nationkey", r="n_regionkey"), "predicate": "k > 3"}, "groupingSets": [["r"]], "aggregations": {"n": {"function": "count"}}, "step": "SINGLE"}
    top = {"@type": "topN", "source": agg, "count": 3, "orderingScheme": {"orderBy": ["r"], "orderings": {"r": "DESC_NULLS_LAST"}}}
    return build(spark, {"@type": "output", "source": top, "columns": ["r", "n"], "outputs": ["r", "n"]}, _open(spark, d)).df


@query("select n_nationkey as k, n_nationkey // 4 + n_regionkey as a, case when n_regionkey = 1 then 'one' when n_regionkey = 2 then 'two' else 'more' end as s, n_nationkey between 3 and 20 and not (n_regionkey = 4) as b, coalesce(nullif(n_name, 'CHINA'), 'was null') as c, n_nationkey in (1, 5, 7) as i, case when n_nationkey > 10 then n_name end as f, n_regionkey as d, [n_nationkey + 1, n_regionkey + 1] as l, cast(n_nationkey as varchar) as t, case when n_regionkey = 0 then null else n_nationkey // n_regionkey end as safe, n_name is null as z from nation where n_nationkey > 2 or n_name = 'ALGERIA'")
def plan_expressions(spark, d):
    """Trees of variables, constants, calls, special forms and a lambda."""
    k, r, name = _var("k"), _var("r"), _var("name", "varchar")
    scan = _scan("nation", k="n_nationkey", r="n_regionkey", name="n_name")
    keep = _form("OR", _call("$operator$greater_than", k, _const(2, "integer")), _call("$operator$equal", name, _const("ALGERIA", "varchar")))
    row = _form("ROW_CONSTRUCTOR", k, r)
    plus = {"@type": "lambda", "arguments": ["x"], "body": _call("$operator$add", _var("x"), _const(1, "integer"))}
    one = lambda v, w: _form("WHEN", _const(v, "integer"), _const(w, "varchar"))
    columns = {
        "k": k, "a": _call("$operator$add", _call("$operator$divide", k, _const(4, "integer")), r), "s": _form("SWITCH", r, one(1, "one"), one(2, "two"), _const("more", "varchar")),
        "b": _form("AND", _call("$operator$between", k, _const(3, "integer"), _const(20, "integer")), _form("NOT", _call("$operator$equal", r, _const(4, "integer")))),
        "c": _form("COALESCE", _form("NULL_IF", name, _const("CHINA", "varchar")), _const("was null", "varchar")), "i": _form("IN", k, *[_const(v, "integer") for v in (1, 5, 7)]),
        "f": _form("IF", _call("$operator$greater_than", k, _const(10, "integer")), name), "d": _form("DEREFERENCE", row, "field1"),
        "l": _call("transform", _call("array", k, r), plus), "t": {**_call("cast", k), "returnType": "varchar"}, "safe": _call("try", _call("$operator$divide", k, r)), "z": _form("IS_NULL", name),
    }
    return build(spark, {"@type": ".ProjectNode", "source": {"@type": ".FilterNode", "source": scan, "predicate": keep}, "assignments": columns}, _open(spark, d)).df


@query("select o_orderstatus as s, count(*) as n, avg(o_custkey) as a, max(o_orderkey) as m, count(distinct o_custkey) as u from orders group by 1")
def plan_steps(spark, d):
    """Partial steps in two fragments, an intermediate one, and the final one."""
    partial = {"@type": ".AggregationNode", "source": _scan("orders", s="o_orderstatus", c="o_custkey", k="o_orderkey"), "groupingSets": {"groupingKeys": ["s"], "groupingSetCount": 1}, "step": "PARTIAL", "aggregations": {"n_1": {"function": "count"}, "a_1": {"function": "avg", "arguments": ["c"]}, "m_1": {"function": "max", "arguments": ["k"]}, "u_1": {"function": "count", "arguments": ["c"], "distinct": True}}}
    values = lambda mark, step, source: {"@type": ".AggregationNode", "source": source, "groupingSets": {"groupingKeys": ["s"], "groupingSetCount": 1}, "step": step, "aggregations": {f"{x}{mark}": {"function": f, "arguments": [f"{x}_{1 if mark else 2}"]} for x, f in (("n", "count"), ("a", "avg"), ("m", "max"), ("u", "count"))}}
    odd = {**partial, "source": {"@type": ".FilterNode", "source": partial["source"], "predicate": "k % 2 = 1"}}
    even = {**partial, "source": {"@type": ".FilterNode", "source": partial["source"], "predicate": "k % 2 = 0"}}
    remote = {"@type": "remoteSource", "sourceFragmentIds": ["1", "2"], "outputs": ["s", "n_1", "a_1", "m_1", "u_1"]}
    local = {"@type": "exchange", "type": "REPARTITION", "sources": [values("_2", "INTERMEDIATE", remote)], "partitionKeys": ["s"]}
    return build(spark, values("", "FINAL", local), _open(spark, d), {"1": odd, "2": even}).output(["s", "n", "a", "m", "u"]).df


@query("select o_custkey as c, o_orderkey as k from orders order by c nulls first, k")
def plan_remote_merge(spark, d):
    """A remote source that merges the sorted rows of two fragments."""
    order = {"orderBy": ["c", "k"], "orderings": {"c": "ASC_NULLS_FIRST", "k": "ASC_NULLS_LAST"}}
    part = lambda p: {"@type": "sort", "partial": True, "orderingScheme": order, "source": {"@type": ".FilterNode", "source": _scan("orders", c="o_custkey", k="o_orderkey"), "predicate": p}}
    return build(spark, {"@type": "remoteSource", "sourceFragmentIds": ["1", "2"], "outputs": ["c", "k"], "orderingScheme": order}, _open(spark, d), {"1": part("c < 300"), "2": part("c >= 300")}).df


@query("select 'path' as target, count(*) as told, count(*) as stored from orders union all select 'create', count(*), count(*) from orders union all select 'insert', 7, (select count(*) from orders) + 7 union all select 'refresh', 3, 3")
def plan_writers(spark, d):
    """The table writer's targets, what it reports, and what is there afterwards."""
    path, view, table = shared_folder(spark, "plan"), shared_folder(spark, "plan-view"), f"loom_{uuid.uuid4().hex}"
    scan = _scan("orders", k="o_orderkey", c="o_custkey")
    few = lambda n: {"@type": ".LimitNode", "source": scan, "count": n}
    writer = lambda source, target: {"@type": ".TableWriterNode", "source": source, "columns": ["k", "c"], "columnNames": ["key", "cust"], "notNullColumnSymbols": ["k"], "target": target, "rowCountSymbol": "rows", "fragmentSymbol": "fragment"}
    todo = [
        ("path", scan, {"path": path}, lambda: spark.read.parquet(path)),
        ("create", scan, {"@type": "CreateTarget", "table": table, "path": shared_folder(spark, "plan-table"), "bucketProperty": {"bucketedBy": ["cust"], "bucketCount": 2, "sortedBy": ["key"]}}, lambda: spark.table(table)),
        ("insert", few(7), {"@type": "InsertTarget", "table": table}, lambda: spark.table(table)),
        ("refresh", few(3), {"@type": "RefreshTarget", "path": view}, lambda: spark.read.parquet(view)),
    ]
    rows = []
    for name, source, target, back in todo:
        told = build(spark, writer(source, target), _open(spark, d)).df.agg(F.sum("rows")).first()[0]
        rows.append((name, told, back().count()))
    return spark.createDataFrame(rows, "target string, told long, stored long")


@query("select o_orderkey as key, case when o_custkey < 100 then -1 else o_custkey end as cust from orders where o_orderkey % 3 <> 0")
def plan_changes(spark, d):
    """Delete, update and compact nodes on one table."""
    path, source = shared_folder(spark, "changes"), _open(spark, d)
    sinks.write_files(rel(spark, d, "orders").output(["o_orderkey", "o_custkey"], ["key", "cust"]).df, path)
    target = {"path": path}
    for node in ({"@type": ".TableDeleteNode", "target": target, "predicate": "key % 3 = 0"}, {"@type": ".TableUpdateNode", "target": target, "predicate": "cust < 100", "assignments": {"cust": "-1"}}, {"@type": ".TableExecuteNode", "target": target}):
        build(spark, node, source)
    return spark.read.parquet(path)


@query("select o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as rn, cast(sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 1 preceding and 1 following) as bigint) as near from orders")
def plan_window(spark, d):
    spec = {"partitionBy": ["c"], "orderingScheme": {"orderBy": ["k"], "orderings": {"k": "ASC_NULLS_LAST"}}}
    first = {"@type": ".WindowNode", "source": _scan("orders", k="o_orderkey", c="o_custkey"), "specification": spec, "windowFunctions": {"rn": "row_number()"}}
    both = {"@type": ".WindowNode", "source": first, "specification": spec, "windowFunctions": {"near": "sum(k)"}, "frame": ["rows", -1, 1]}
    return build(spark, {"@type": ".ProjectNode", "source": both, "assignments": {"k": "k", "rn": "cast(rn as bigint)", "near": "near"}}, _open(spark, d)).df


@query("select s, cast(g as bigint) as g, count(*) as n from (select o_orderstatus as s, 0 as g from orders union all select null, 1 from orders) group by 1, 2 union all select null, 1, 0 where not exists (select 1 from orders)")
def plan_group_id(spark, d):
    ids = {"@type": ".GroupIdNode", "source": _scan("orders", s="o_orderstatus", c="o_custkey"), "groupingSets": [["s"], []], "groupingColumns": {"s": "s"}, "aggregationArguments": ["c"], "groupIdSymbol": "g"}
    agg = {"@type": ".AggregationNode", "source": ids, "groupingSets": {"groupingKeys": ["s", "g"], "groupingSetCount": 2, "globalGroupingSets": [1]}, "groupIdSymbol": "g", "aggregations": {"n": {"function": "count"}}}
    return build(spark, agg, _open(spark, d)).output(["s", "g", "n"]).df


@query("select count(distinct o_custkey) as u, (select count(*) from (select distinct o_orderstatus from orders limit 2)) as two, (select count(*) from (select * from orders limit 5)) as five from orders")
def plan_small_nodes(spark, d):
    """Mark-distinct under an aggregate, distinct-limit and limit in steps, a scalar subquery, unique ids."""
    run = lambda n: build(spark, n, _open(spark, d))
    scan = _scan("orders", s="o_orderstatus", c="o_custkey")
    marked = {"@type": ".MarkDistinctNode", "source": scan, "markerSymbol": "first", "distinctSymbols": ["c"]}
    count = lambda source, out, **more: {"@type": ".AggregationNode", "source": source, "groupingSets": [[]], "aggregations": {out: {"function": "count", **more}}}
    distinct = {"@type": ".DistinctLimitNode", "source": {"@type": ".DistinctLimitNode", "source": scan, "limit": 2, "partial": True, "distinctSymbols": ["s"]}, "limit": 2, "distinctSymbols": ["s"]}
    ids = {"@type": ".AssignUniqueId", "source": {"@type": ".LimitNode", "source": scan, "count": 5}, "idColumn": "id"}
    u = run({"@type": ".EnforceSingleRowNode", "source": count(marked, "u", arguments=["c"], mask="first")})
    return u.join(run(count(distinct, "two")), "inner", []).join(run(count(ids, "five", arguments=["id"], distinct=True)), "inner", []).df


# joins


@query("select distinct c_custkey, c_nationkey from customer join orders on c_custkey = o_custkey")
def join_skip_duplicates(spark, d):
    """How often a customer comes is of no account: a semi join will do."""
    rows = rel(spark, d, "customer").join(rel(spark, d, "orders"), "inner", [("c_custkey", "o_custkey")], None, ["c_custkey", "c_nationkey"], [], skip_duplicates=True)
    return rows.aggregate(["c_custkey", "c_nationkey"]).df


@query("select o_orderkey, s_suppkey from orders join supplier on o_totalprice between s_acctbal * 20 and s_acctbal * 20 + 900")
def join_range_bins(spark, d):
    bands = rel(spark, d, "supplier").project({"s_suppkey": "s_suppkey", "low": "s_acctbal * 20", "high": "s_acctbal * 20 + 900"})
    return rel(spark, d, "orders").range_join(bands, "o_totalprice", "low", "high", 900, None, ["o_orderkey"], ["s_suppkey"]).df


_ASOF = "select event_id, (select arg_max(o_orderkey, row(o_orderdate, o_orderkey)) from (select o_orderkey, o_custkey % 50 as u, o_orderdate + interval 25 year as o_orderdate from orders) where u = user_id % 50 and o_orderdate <= ts) as o_orderkey from events"


def _asof(spark, d, bucket=None):
    events = rel(spark, d, "events").project({"event_id": "event_id", "u": "user_id % 50", "ts": "ts"})
    orders = rel(spark, d, "orders").project({"o_orderkey": "o_orderkey", "w": "o_custkey % 50", "at": "o_orderdate + interval '25' year"})
    return events.asof_join(orders, "ts", "at", [("u", "w")], ["o_orderkey"], bucket).output(["event_id", "o_orderkey"]).df


@query(_ASOF)
def join_asof(spark, d):
    return _asof(spark, d)


@query(_ASOF)
def join_asof_by_month(spark, d):
    return _asof(spark, d, "date_trunc('month', _time)")


@query("select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem where l_linestatus = (select min(l_linestatus) from lineitem) group by 1")
def join_dynamic_filter(spark, d):
    """The build side decides which partition folders of the probe side are read."""
    path = shared_folder(spark, "dynamic")
    sinks.write_files(rel(spark, d, "lineitem").output(["l_returnflag", "l_quantity", "l_linestatus"]).df, path, partitioned_by=["l_linestatus"])
    wanted = rel(spark, d, "lineitem").aggregate([], {"status": "min(l_linestatus)"})
    rows = Relation(spark.read.parquet(path)).join(wanted, "inner", [("l_linestatus", "status")], None, ["l_returnflag", "l_quantity"], [], "REPLICATED")
    return rows.aggregate(["l_returnflag"], {"n": "count(1)", "qty": "round(sum(l_quantity), 2)"}).df


# exchanges


@query("select kind, n from (select count(*) as c from orders), (values ('arbitrary'), ('constant'), ('coordinator'), ('hash'), ('round robin'), ('scaled'), ('single'), ('source')) as k(kind), lateral (select c as n)")
def exchange_partitionings(spark, d):
    """Every system partitioning gives all rows once."""
    scan, out = _scan("orders", c="o_custkey"), None
    kinds = {"single": ("SINGLE", "SINGLE", []), "round robin": ("FIXED", "ROUND_ROBIN", []), "hash": ("FIXED", "HASH", ["c"]), "constant": ("FIXED", "HASH", ["c", _const(1, "integer")]), "source": ("SOURCE", "UNKNOWN", []), "scaled": ("SCALED", "ROUND_ROBIN", []), "coordinator": ("COORDINATOR_ONLY", "SINGLE", []), "arbitrary": ("ARBITRARY", "UNKNOWN", [])}
    for name, (kind, function, arguments) in kinds.items():
        node = {"@type": "exchange", "type": "REPARTITION", "sources": [scan], "inputs": [["c"]], "outputSymbols": ["c"], "partitions": 3, "partitioningScheme": {"handle": {"partitioning": kind, "function": function}, "arguments": arguments}}
        part = build(spark, node, _open(spark, d)).df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("select 4 * (select count(*) from orders where o_orderkey % 9 = 0) + (select count(*) from orders where o_orderkey % 9 <> 0) + 3 as n, 4 as partitions, (select count(*) from orders where o_orderkey % 9 = 0) as least_nulls, true as each_has_any")
def exchange_nulls_everywhere(spark, d):
    """Rows of NULL keys go to all four partitions, and one other row does."""
    rows = rel(spark, d, "orders").project({"k": "case when o_orderkey % 9 <> 0 then o_orderkey end"}).hash_partition(["k"], 4, replicate_nulls_and_any=True)
    per = rows.df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k").isNull()).alias("nulls"), F.count("k").alias("known"))
    return per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("partitions"), F.min("nulls").alias("least_nulls"), (F.min("known") > 0).alias("each_has_any"))


@query("select count(*) as n, true as together, true as mapped from orders")
def exchange_buckets(spark, d):
    """By buckets: a bucket's rows are in one partition, the one that the map names."""
    where = [2, 0, 1, 0, 2]
    rows = rel(spark, d, "orders").output(["o_custkey"]).hash_partition(["o_custkey"], bucket_to_partition=where).df
    per = rows.groupBy(F.spark_partition_id().alias("p"), readers.bucket_number(["o_custkey"], 5).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    places = F.get(F.array(*[F.lit(w) for w in where]), F.col("b"))
    return per.agg(F.sum("n").alias("n"), (F.count(F.lit(1)) == F.countDistinct("b")).alias("together"), F.bool_and(places == F.col("p")).alias("mapped"))


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 5")
def exchange_bucket_join(spark, d):
    """Both sides by the same buckets: their join needs no other exchange."""
    left = rel(spark, d, "orders").output(["o_custkey"]).bucket_partition(["o_custkey"], 4)
    return left.aggregate(["o_custkey"], {"n": "count(1)"}).filter("n > 5").df


# streams


def _events(spark, d):
    source = spark.read.parquet(f"{d}/events.parquet")
    return spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _naive(c: str):
    return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz").alias(c)


@query("select w as window_start, event_type, count(*) as n from (select event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as w from events) group by all")
def stream_sliding_counts(spark, d):
    out = run_available(windowed(_events(spark, d), "ts", "2 days", {"n": F.count(F.lit(1))}, ["event_type"], slide="1 day"))
    return out.select(_naive("window_start"), "event_type", "n")


@query("select min(ts) as session_start, user_id, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from events)) group by user_id, s")
def stream_sessions(spark, d):
    out = run_available(session_counts(_events(spark, d), "ts", "6 hours", ["user_id"]))
    return out.select(_naive("session_start"), "user_id", "n")


@query("select distinct user_id, event_type from events")
def stream_distinct(spark, d):
    return run_available(deduplicate(_events(spark, d), "ts", ["user_id", "event_type"], "3650 days"), "append").select("user_id", "event_type")


@query("select user_id, epoch_us(max(ts)) as at_us, arg_max(value, row(ts, value)) as value from events group by 1")
def stream_latest(spark, d):
    """Custom state: the last value of each key."""
    return run_available(keep_latest(_events(spark, d), "user_id", "ts", "value"), "update").select("user_id", "at_us", "value")
