"""Registered queries of the function library, by name through ``call`` and ``Agg``."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from .functions import call, forget, register_aggregate, register_scalar, register_table, resolve
from .operators import Agg, Relation
from .registered import query, rel
from .types import literal


def _caller(df):
    return lambda name, *a: call(df, f"presto.default.{name}", *a)


@query("select o_orderkey, ceil(o_totalprice) as ce, trunc(o_totalprice - 50000) as tr, trunc((o_totalprice - 50000) * 10) / 10 as tr1, round(exp(o_orderkey / 1e6), 8) as ex, round(cbrt(o_totalprice), 6) as cb, round(log2(o_totalprice), 6) as l2, round(ln(o_totalprice) / ln(3), 6) as l3, round(sin(o_orderkey), 6) as si, round(atan2(o_orderkey, o_custkey), 6) as at, round(tanh(o_orderkey / 1e5), 6) as th, round(degrees(o_orderkey), 4) as de, round(radians(o_orderkey), 6) as ra, isnan(o_totalprice) as nn, isfinite(o_totalprice) as fi, o_orderkey // 1 % 7 as pm, round(pi(), 8) as pi, 1 + least(4, greatest(-1, floor((o_totalprice - 0) / 100000))) as wb, to_base(o_orderkey, 16) as hx, cast(o_orderkey as bigint) as ba, round(o_totalprice, -2) as r2 from orders")
def math_dialect(spark, d):
    df = rel(spark, d, "orders").df
    f, r = _caller(df), F.round
    return df.select("o_orderkey", f("ceiling", "o_totalprice").cast("double").alias("ce"), f("truncate", "o_totalprice - 50000").alias("tr"), f("truncate", "o_totalprice - 50000", "1").alias("tr1"), r(f("exp", "o_orderkey / 1e6"), 8).alias("ex"), r(f("cbrt", "o_totalprice"), 6).alias("cb"), r(f("log2", "o_totalprice"), 6).alias("l2"), r(f("log", "3.0D", "o_totalprice"), 6).alias("l3"), r(f("sin", "o_orderkey"), 6).alias("si"), r(f("atan2", "o_orderkey", "o_custkey"), 6).alias("at"), r(f("tanh", "o_orderkey / 1e5"), 6).alias("th"), r(f("degrees", "o_orderkey"), 4).alias("de"), r(f("radians", "o_orderkey"), 6).alias("ra"), f("is_nan", "o_totalprice").alias("nn"), f("is_finite", "o_totalprice").alias("fi"), f("pmod", "o_orderkey", "7").alias("pm"), r(f("pi"), 8).alias("pi"), f("least", "5.0D", f("width_bucket", "o_totalprice", "0D", "500000D", "5").cast("double")).alias("wb"), F.upper(f("to_base", "o_orderkey", "16")).alias("hx"), f("from_base", f("to_base", "o_orderkey", "36"), "36").alias("ba"), r(F.col("o_totalprice"), -2).alias("r2"))


@query("select o_orderkey, o_orderkey & 12 as a, o_orderkey | 12 as o, xor(o_orderkey, 12) as x, ~o_orderkey as n, o_orderkey << 3 as sl, o_orderkey >> 2 as sr, (-o_orderkey) >> 2 as sa, cast(bit_count(o_orderkey) as integer) as bc from orders")
def bit_fns(spark, d):
    df = rel(spark, d, "orders").df
    f = _caller(df)
    return df.select("o_orderkey", f("bitwise_and", "o_orderkey", "12L").alias("a"), f("bitwise_or", "o_orderkey", "12L").alias("o"), f("bitwise_xor", "o_orderkey", "12L").alias("x"), f("bitwise_not", "o_orderkey").alias("n"), f("bitwise_left_shift", "o_orderkey", "3").alias("sl"), f("bitwise_right_shift", "o_orderkey", "2").alias("sr"), f("bitwise_arithmetic_shift_right", "-o_orderkey", "2").alias("sa"), f("bit_count", "o_orderkey").alias("bc"))


@query(r"select page_id, regexp_matches(url, 'e+') as li, nullif(regexp_extract(url, '[a-z]+[0-9]'), '') as ex, nullif(regexp_extract(url, '([a-z]+)([0-9])', 2), '') as gr, regexp_extract_all(url, '[0-9]+') as al, regexp_replace(url, '([a-z])([0-9])', '\2-\1', 'g') as re, regexp_replace(url, '[0-9]', '', 'g') as rm, string_split_regex(url, '[/.]+') as sp, cast(len(regexp_extract_all(url, 'e')) as integer) as co, case when regexp_matches(url, '[0-9]') then cast(length(string_split_regex(url, '[0-9]')[1]) + 1 as bigint) else -1 end as po from pages")
def regex_dialect(spark, d):
    df = rel(spark, d, "pages").df
    f, t = _caller(df), F.lit
    return df.select("page_id", f("regexp_like", "url", t("e+")).alias("li"), f("regexp_extract", "url", t("[a-z]+[0-9]")).alias("ex"), f("regexp_extract", "url", t("([a-z]+)([0-9])"), t(2)).alias("gr"), f("regexp_extract_all", "url", t("[0-9]+")).alias("al"), f("regexp_replace", "url", t("([a-z])([0-9])"), t("$2-$1")).alias("re"), f("regexp_replace", "url", t("[0-9]")).alias("rm"), f("regexp_split", "url", t("[/.]+")).alias("sp"), f("regexp_count", "url", t("e")).alias("co"), f("regexp_position", "url", t("[0-9]")).alias("po"))


@query("select s, string_split(s, '.') as sp, string_split(s, '|') as pi, case when s = 'a.b.c' then ['a', 'b.c'] when s = 'x|y' then ['x|y'] when s = '' then [''] else ['\\E', 'q'] end as two from (values ('a.b.c'), ('x|y'), (''), ('\\E.q')) as t(s)")
def split_literal(spark, d):
    """Delimiters that a pattern would read differently."""
    df = spark.createDataFrame([("a.b.c",), ("x|y",), ("",), ("\\E.q",)], "s string")
    f = _caller(df)
    return df.select("s", f("split", "s", "'.'").alias("sp"), f("split", "s", "'|'").alias("pi"), f("split", "s", "'.'", "2").alias("two"))


@query("select page_id, regexp_extract(url, '^([a-z]+):', 1) as pr, regexp_extract(url, '://([^/:?#]+)', 1) as ho, regexp_extract(url, '://[^/]+([^?#]*)', 1) as pa, url_encode(url) as en, url_decode(url_encode(url)) as de, 'a b' as q, 8080 as po, 'top' as fr from pages where url is not null and regexp_matches(url, '^https?://[a-z0-9.-]+/[A-Za-z0-9/._-]*$')")
def url_fns(spark, d):
    df = rel(spark, d, "pages").df.filter(r"url is not null and url rlike '^https?://[a-z0-9.-]+/[A-Za-z0-9/._-]*$'")
    f, whole = _caller(df), F.lit("http://h.example:8080/p/q?k=a%20b&z=1#top")
    return df.select("page_id", f("url_extract_protocol", "url").alias("pr"), f("url_extract_host", "url").alias("ho"), f("url_extract_path", "url").alias("pa"), f("url_encode", "url").alias("en"), f("url_decode", f("url_encode", "url")).alias("de"), f("url_decode", f("url_extract_parameter", whole, F.lit("k"))).alias("q"), f("url_extract_port", whole).cast("int").alias("po"), f("url_extract_fragment", whole).alias("fr"))


@query("select event_id, date_part('minute', ts) as mi, date_part('second', ts) as se, date_part('week', ts) as we, date_part('isoyear', ts) as yo, date_part('isodow', ts) as dw, date_part('day', ts) as dm, date_part('doy', ts) as dy, date_part('millisecond', ts) % 1000 as ms, strftime(ts, '%Y/%m/%d %H:%M:%S') as fo, date_trunc('month', ts) as mo, date_diff('hour', timestamp '2020-01-01', date_trunc('hour', ts)) as dh, date_diff('month', date '2019-12-01', cast(ts as date)) as dmo, date_diff('year', date '2010-01-01', cast(ts as date)) as dye, ts + interval 2 month as m2, ts - interval 3 hour as h3, ts + interval 10 day as d10, cast(epoch_us(ts) as double) / 1e6 as un, cast(epoch(date_trunc('second', ts)) as bigint) as es, make_timestamp(epoch_us(ts) // 1000000 * 1000000) as fu, last_day(ts) as ld, strptime('2024-03-01 05:06', '%Y-%m-%d %H:%M') as pa, date '2024-02-29' as dd from events")
def date_dialect(spark, d):
    df = rel(spark, d, "events").df
    f, t = _caller(df), F.lit
    ntz = lambda c: c.cast("timestamp_ntz")
    long = lambda c: c.cast("long")
    return df.select("event_id", long(f("minute", "ts")).alias("mi"), long(f("second", "ts")).alias("se"), long(f("week", "ts")).alias("we"), long(f("year_of_week", "ts")).alias("yo"), long(f("day_of_week", "ts")).alias("dw"), long(f("day_of_month", "ts")).alias("dm"), long(f("day_of_year", "ts")).alias("dy"), long(f("millisecond", "ts")).alias("ms"), f("date_format", "ts", t("%Y/%m/%d %H:%i:%s")).alias("fo"), ntz(f("date_trunc", "'month'", "ts")).alias("mo"), f("date_diff", t("hour"), "timestamp_ntz'2020-01-01'", "ts").alias("dh"), f("date_diff", t("month"), "date'2019-12-01'", "cast(ts as date)").alias("dmo"), f("date_diff", t("year"), "date'2010-01-01'", "cast(ts as date)").alias("dye"), f("date_add", t("month"), t(2), "ts").alias("m2"), f("date_add", t("hour"), t(-3), "ts").alias("h3"), f("date_add", t("day"), t(10), "ts").alias("d10"), f("to_unixtime", "ts").alias("un"), long(F.floor(f("to_unixtime", "ts"))).alias("es"), ntz(f("from_unixtime", F.floor(f("to_unixtime", "ts")))).alias("fu"), f("last_day_of_month", "ts").alias("ld"), ntz(f("date_parse", t("2024-03-01 05:06"), t("%Y-%m-%d %H:%i"))).alias("pa"), f("from_iso8601_date", t("2024-02-29")).alias("dd"))


_LISTS_SQL = "(values (1, [3, 1, 3, 2]), (2, [5]), (3, cast([] as integer[]))) as t(id, l)"


def _lists(spark):
    return spark.createDataFrame([(1, [3, 1, 3, 2]), (2, [5]), (3, [])], "id int, l array<int>")


@query(f"select id, list_sort(l) as so, list_reverse_sort(l) as sd, list_sort(list_distinct(l)) as di, list_contains(l, 3) as co, cast(coalesce(list_position(l, 3), 0) as bigint) as po, cast(coalesce(list_sum(l), 0) as bigint) as su, list_avg(l) as av, list_concat(l, [9]) as ca, l[1:2] as sl, list_reverse(l) as re, list_filter(l, lambda x: x <> 3) as rm, list_transform(l, lambda x: x * 2) as tr, list_filter(l, lambda x: x > 1) as fi, array_to_string(l, '-') as jo, len(list_filter(l, lambda x: x > 4)) > 0 as an, len(list_filter(l, lambda x: x > 0)) = len(l) as al, len(list_filter(l, lambda x: x > 9)) = 0 as no, list_has_any(l, [1, 5]) as ov, list_sort(list_intersect(l, [1, 2, 3, 9])) as it, [id, id, id] as rp, case id when 1 then [3] else cast([] as integer[]) end as du, cast(to_json(case id when 1 then [[3, 1], [1, 3], [3, 2]] else [l] end) as varchar) as ng, generate_series(1, id) as se, flatten([l, l]) as fl, cast(len(l) as integer) as ca2, list_first(list_filter(l, lambda x: x < 3)) as ff, case id when 1 then [3, 1, 3] else [] end as ta from {_LISTS_SQL}")
def array_dialect(spark, d):
    df = _lists(spark)
    f = _caller(df)
    ints = lambda c: c.cast("array<int>")
    return df.select("id", f("array_sort", "l").alias("so"), f("array_sort_desc", "l").alias("sd"), f("array_sort", f("array_distinct", "l")).alias("di"), f("contains", "l", "3").alias("co"), f("array_position", "l", "3").alias("po"), f("array_sum", "l").alias("su"), f("array_average", "l").alias("av"), f("concat", "l", "array(9)").alias("ca"), f("slice", "l", "1", "2").alias("sl"), f("reverse", "l").alias("re"), f("array_remove", "l", "3").alias("rm"), F.transform("l", lambda x: x * 2).alias("tr"), F.filter("l", lambda x: x > 1).alias("fi"), f("array_join", "l", "'-'").alias("jo"), call(df, "any_match", "l", lambda x: x > 4).alias("an"), call(df, "all_match", "l", lambda x: x > 0).alias("al"), call(df, "none_match", "l", lambda x: x > 9).alias("no"), f("arrays_overlap", "l", "array(1, 5)").alias("ov"), f("array_sort", f("array_intersect", "l", "array(1, 2, 3, 9)")).alias("it"), f("repeat", "id", "3").alias("rp"), f("array_duplicates", "l").alias("du"), F.to_json(f("ngrams", "l", "2")).alias("ng"), f("sequence", "1L", "cast(id as long)").alias("se"), f("flatten", "array(l, l)").alias("fl"), f("cardinality", "l").alias("ca2"), call(df, "find_first", "l", lambda x: x < 3).alias("ff"), ints(F.when(F.size("l") > 1, f("trim_array", "l", "1")).otherwise(F.array().cast("array<int>"))).alias("ta"))


@query("select n_nationkey, map_keys(m) as ks, map_values(m) as vs, cast(cardinality(m) as bigint) as n, m['key'] as k, m['none'] as missing, map_entries(m)[1].value as first, map_values(map_concat(m, map {'z': 1})) as joined, n_nationkey > 5 as big, [n_nationkey * 2, n_regionkey * 2] as doubled, [n_regionkey] as subset, [n_nationkey + n_regionkey] as zipped, ['KEY', 'REGION'] as upper, [greatest(n_nationkey, n_regionkey)] as top from (select n_nationkey, n_regionkey, map {'key': n_nationkey, 'region': n_regionkey} as m from nation)")
def map_dialect(spark, d):
    df = rel(spark, d, "nation").df.selectExpr("n_nationkey", "n_regionkey", "map('key', n_nationkey, 'region', n_regionkey) as m")
    f, m = _caller(df), F.col("m")
    return df.select("n_nationkey", f("map_keys", "m").alias("ks"), f("map_values", "m").alias("vs"), f("cardinality", "m").cast("long").alias("n"), f("element_at", "m", "'key'").alias("k"), f("element_at", "m", "'none'").alias("missing"), F.get(f("map_entries", "m"), F.lit(0))["value"].alias("first"), f("map_values", f("map_concat", "m", "map('z', 1)")).alias("joined"), (F.size(F.map_filter(m, lambda k, v: (k == "key") & (v > 5))) > 0).alias("big"), f("map_values", F.transform_values(m, lambda k, v: v * 2)).alias("doubled"), f("map_values", f("map_subset", "m", "array('region', 'q')")).alias("subset"), f("map_values", F.map_zip_with(f("map", "array('a')", "array(n_nationkey)"), f("map_from_entries", "array(struct('a', n_regionkey))"), lambda k, a, b: a + b)).alias("zipped"), f("map_keys", F.transform_keys(m, lambda k, v: F.upper(k))).alias("upper"), f("map_values", f("map_top_n", "m", "1")).alias("top"))


@query("select event_id, props->>'$.k' as sc, cast(props->'$.k' as varchar) as ex, cast(json_array_length('[1, [2], {\"a\": 3}]') as integer) as al, cast('[1, [2], {\"a\": 3}]'->>'$[2].a' as bigint) as de, cast(1 as bigint) as si, '3' as ge, true as co, cast(props->>'$.k' as bigint) as va, '{\"a\":1,\"b\":[2]}' as fo, cast(props->>'$.k' as integer) as fr, ['a', 'b'] as ke, '{\"k\":' || cast(event_id as varchar) || '}' as tj from events")
def json_dialect(spark, d):
    df = rel(spark, d, "events").df
    f, text = _caller(df), F.lit('[1, [2], {"a": 3}]')
    return df.select("event_id", f("json_extract_scalar", "props", "'$.k'").alias("sc"), f("json_extract", "props", "'$.k'").alias("ex"), f("json_array_length", text).alias("al"), f("json_extract_scalar", text, "'$[2].a'").cast("long").alias("de"), f("json_size", "props", "'$'").alias("si"), f("json_array_get", F.lit("[1, 2, 3]"), F.lit(-1)).alias("ge"), f("json_array_contains", F.lit("[1, 2]"), F.lit(2)).alias("co"), f("variant_get", f("json_parse", "props"), "'$.k'", "'bigint'").alias("va"), f("json_format", f("json_parse", F.lit('{"a":1,"b":[2]}'))).alias("fo"), F.from_json("props", "k int")["k"].alias("fr"), F.json_object_keys(F.lit('{"a":1,"b":[2]}')).alias("ke"), F.to_json(F.struct(F.col("event_id").alias("k"))).alias("tj"))


@query("select o_orderkey, case when o_custkey % 10 = 0 then null else 100 / (o_custkey % 10) end as di, case when o_custkey % 10 = 0 then null else 100 // (o_custkey % 10) end as idi, cast(null as integer) as ov, try_cast(o_orderstatus as integer) as ca, coalesce(nullif(o_orderstatus, 'F'), 'none') as co, o_custkey is null as nu from orders")
def try_fns(spark, d):
    df = rel(spark, d, "orders").df
    return df.select("o_orderkey", call(df, "try", "divide", "100D", "cast(o_custkey % 10 as double)").alias("di"), call(df, "try", "divide", "100L", "o_custkey % 10").alias("idi"), call(df, "try", "add", "2147483647", "1").alias("ov"), F.col("o_orderstatus").try_cast("int").alias("ca"), call(df, "coalesce", call(df, "nullif", "o_orderstatus", "'F'"), "'none'").alias("co"), call(df, "is_null", "o_custkey").alias("nu"))


@query("select cast(5 as varchar) as ti, cast(-300 as varchar) as sm, cast(70000 as varchar) as it, cast(5000000000 as varchar) as bi, '1.5' as re, '2.25' as do, 'true' as bo, 'text' as vc, '2024-02-29' as da, '2024-02-29 12:30:00' as ts, '123.45' as de, '99999999999999999999999999999999999999' as dl, true as nothing, 'AB' as bn, 90061 as iv")
def literal_types(spark, d):
    kinds = [("ti", 5, "tinyint"), ("sm", -300, "smallint"), ("it", 70000, "integer"), ("bi", 5000000000, "bigint"), ("re", 1.5, "real"), ("do", 2.25, "double"), ("bo", True, "boolean"), ("vc", "text", "varchar(9)"), ("da", "2024-02-29", "date"), ("ts", "2024-02-29 12:30:00", "timestamp"), ("de", "123.45", "decimal(10,2)"), ("dl", "9" * 38, "decimal(38,0)")]
    nulls = F.lit(True)
    for _, _, kind in kinds:
        nulls = nulls & literal(None, kind).isNull()
    import datetime

    span = literal(datetime.timedelta(days=1, hours=1, minutes=1, seconds=1), "interval day to second")
    return spark.range(1).select(*[literal(v, k).cast("string").alias(n) for n, v, k in kinds], nulls.alias("nothing"), literal("AB", "varbinary").cast("string").alias("bn"), (F.extract(F.lit("DAY"), span) * 86400 + F.extract(F.lit("HOUR"), span) * 3600 + F.extract(F.lit("MINUTE"), span) * 60 + F.extract(F.lit("SECOND"), span)).cast("int").alias("iv"))


@query("select o_orderstatus, list_sort(list(distinct o_orderpriority)) as mk, list_transform(list_sort(list(distinct o_orderpriority)), lambda x: cast(length(x) as integer)) as mv, (select list(n order by o_orderpriority) from (select o_orderpriority, count(*) as n from orders i where i.o_orderstatus = o.o_orderstatus group by 1)) as hv, list_sort(list(distinct o_orderpriority)) as su, round(exp(avg(ln(o_totalprice))), 4) as gm, list_sort(list(o_custkey), 'DESC')[1:3] as t3, list_sort(list(o_custkey))[1:3] as b3, round(entropy_of, 6) as en, true as ck from orders o join (select o_orderstatus as st, log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy_of from (select o_orderstatus, cast(o_orderkey % 5 + 1 as double) as n from orders) group by 1) e on e.st = o.o_orderstatus group by o_orderstatus, entropy_of")
def agg_dialect(spark, d):
    rows = rel(spark, d, "orders")
    both = rows.df.withColumn("w", F.expr("cast(o_orderkey % 5 + 1 as double)"))
    out = Relation(both).aggregate(["o_orderstatus"], {"ma": Agg("map_agg", ["o_orderpriority", "length(o_orderpriority)"]), "hi": Agg("histogram", ["o_orderpriority"]), "su": Agg("set_union", ["array(o_orderpriority)"]), "gm": Agg("geometric_mean", ["o_totalprice"]), "t3": Agg("max", ["o_custkey", "3"]), "b3": Agg("min", ["o_custkey", "3"]), "en": Agg("entropy", ["w"]), "c1": Agg("checksum", ["o_orderkey"])})
    again = Relation(both.orderBy(F.desc("o_orderkey"))).aggregate(["o_orderstatus"], {"c2": Agg("checksum", ["o_orderkey"])})
    pairs = out.join(again, "inner", [("o_orderstatus", "o_orderstatus")], None, None, ["c2"])
    return pairs.project({"o_orderstatus": "o_orderstatus", "mk": "map_keys(ma)", "mv": "map_values(ma)", "hv": "transform(map_values(hi), v -> cast(v as bigint))", "su": "array_sort(su)", "gm": "round(gm, 4)", "t3": "t3", "b3": "b3", "en": "round(en, 6)", "ck": "c1 = c2 and octet_length(c1) = 8"}).df


@query("select n_regionkey, list_sort(list(n_name)) as names, cast(sum(n_nationkey) as double) as total, count(*) as kept from nation where n_nationkey > 2 group by 1")
def agg_maps(spark, d):
    """Maps of lists, unions of maps, and sums by key, under a filter."""
    maps = {"mm": Agg("multimap_agg", ["n_regionkey", "n_name"], filter="n_nationkey > 2"), "ms": Agg("map_union_sum", ["map(n_regionkey, n_nationkey)"], filter="n_nationkey > 2"), "mu": Agg("map_union", ["map(n_nationkey, n_name)"], filter="n_nationkey > 2")}
    rows = rel(spark, d, "nation").aggregate(["n_regionkey"], maps)
    return rows.project({"n_regionkey": "n_regionkey", "names": "array_sort(mm[n_regionkey])", "total": "ms[n_regionkey]", "kept": "cast(size(mu) as bigint)"}).df


@query("select l_returnflag, round(stddev_pop(l_quantity), 6) as sp, round(var_samp(l_quantity), 6) as vs, round(covar_samp(l_quantity, l_tax), 6) as cs, round(regr_slope(l_extendedprice, l_quantity), 4) as rs, round(regr_intercept(l_extendedprice, l_quantity), 2) as ri, round(regr_r2(l_extendedprice, l_quantity), 6) as rr, cast(regr_count(l_extendedprice, l_quantity) as bigint) as rc, quantile_cont(l_quantity, 0.25) as q1, any_value(l_returnflag) as av, bool_and(l_quantity > 0) as ev, string_agg(distinct l_linestatus, ',' order by l_linestatus) as li, cast(mode(l_linenumber) as integer) as mo, round(kurtosis_pop(l_quantity), 4) as ku from lineitem group by 1")
def agg_more(spark, d):
    aggs = {"sp": "round(stddev_pop(l_quantity), 6)", "vs": "round(var_samp(l_quantity), 6)", "cs": "round(covar_samp(l_quantity, l_tax), 6)", "rs": "round(regr_slope(l_extendedprice, l_quantity), 4)", "ri": "round(regr_intercept(l_extendedprice, l_quantity), 2)", "rr": "round(regr_r2(l_extendedprice, l_quantity), 6)", "rc": "regr_count(l_extendedprice, l_quantity)", "q1": "percentile(l_quantity, 0.25)", "av": Agg("arbitrary", ["l_returnflag"]), "ev": Agg("every", ["l_quantity > 0"]), "li": "array_join(array_sort(collect_set(l_linestatus)), ',')", "mo": "mode(l_linenumber, true)", "ku": "round(kurtosis(l_quantity), 4)"}
    return rel(spark, d, "lineitem").aggregate(["l_returnflag"], aggs).df


@query("select * from (values ('presto.default.$operator$add', 'add', 'SCALAR', true, true), ('a.b.Sum', 'sum', 'AGGREGATE', true, true), ('random', 'random', 'SCALAR', false, true), ('row_number', 'row_number', 'WINDOW', true, true), ('coalesce', 'coalesce', 'SCALAR', true, false), ('map_agg', 'map_agg', 'AGGREGATE', true, true)) as t(asked, name, kind, deterministic, null_on_null)")
def function_signatures(spark, d):
    rows = [(asked, s.name, s.kind, s.deterministic, s.null_on_null) for asked in ("presto.default.$operator$add", "a.b.Sum", "random", "row_number", "coalesce", "map_agg") for s in [resolve(asked)]]
    return spark.createDataFrame(rows, "asked string, name string, kind string, deterministic boolean, null_on_null boolean")


@query("select o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 2) as spread, max(o_custkey * 2 + 1) as top from orders group by 1")
def registered_fns(spark, d):
    """A scalar and an aggregate of one's own, called by name."""

    def odd(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    register_scalar("odd_of", odd, "long")
    register_aggregate("spread_of", spread, "double")
    try:
        df = rel(spark, d, "orders").df
        rows = Relation(df.select("o_orderstatus", "o_totalprice", call(df, "odd_of", "o_custkey").alias("odd")))
        return rows.aggregate(["o_orderstatus"], {"spread": Agg("spread_of", ["o_totalprice"])}).join(rows.aggregate(["o_orderstatus"], {"top": "max(odd)"}), "inner", [("o_orderstatus", "o_orderstatus")], None, ["o_orderstatus", "spread"], ["top"]).project({"o_orderstatus": "o_orderstatus", "spread": "round(spread, 2)", "top": "top"}).df
    finally:
        forget("odd_of")
        forget("spread_of")


@query("select r_regionkey, i as step, r_regionkey * i as v from region, range(1, 4) as t(i)")
def registered_table_fn(spark, d):
    class Steps:
        def eval(self, k: int):
            for i in range(1, 4):
                yield i, k * i

    name = f"steps_{uuid.uuid4().hex}"
    register_table(spark, name, Steps, "step: bigint, v: bigint")
    rel(spark, d, "region").df.createOrReplaceTempView(f"{name}_in")
    return spark.sql(f"select r_regionkey, step, v from {name}_in, lateral {name}(r_regionkey)")
