"""Registered queries of sources and sinks: what is written is read back."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from .operators import Agg, Domain, Range, Relation
from .registered import query, rel
from .session import shared_folder
from .sources import readers, sinks
from .types import parse_schema

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus"]


def _orders(spark, d):
    return rel(spark, d, "orders").output(_COLUMNS).df


def _table(spark) -> dict:
    return {"name": f"loom_{uuid.uuid4().hex}", "path": shared_folder(spark, "table")}


# tables


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def table_create(spark, d):
    t = _table(spark)
    sinks.create_table(_orders(spark, d), t["name"], partitioned_by=["o_orderstatus"], bucketed_by=["o_custkey"], buckets=3, sorted_by=["o_orderkey"], path=t["path"], not_null=["o_orderkey"])
    return spark.table(t["name"]).select(*_COLUMNS)


@query("select o_orderkey, o_custkey, o_orderstatus from orders union all select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey > 50")
def table_insert(spark, d):
    t = _table(spark)
    sinks.create_table(_orders(spark, d).limit(0), t["name"], "orc", path=t["path"])
    sinks.insert_into(_orders(spark, d).limit(10), t["name"])
    sinks.insert_into(_orders(spark, d), t["name"], overwrite=True)
    sinks.insert_into(_orders(spark, d).where("o_custkey > 50").select("o_orderstatus", "o_custkey", "o_orderkey"), t["name"])
    return spark.table(t["name"])


@query("select o_orderkey, o_custkey, o_orderstatus from orders where not (o_orderstatus = 'F' and o_custkey < 700)")
def table_delete(spark, d):
    path = shared_folder(spark, "delete")
    sinks.write_files(_orders(spark, d), path)
    sinks.delete_rows(spark, path, "o_orderstatus = 'F' and o_custkey < 700")
    return spark.read.parquet(path)


@query("select o_orderkey, case when o_orderstatus = 'O' then o_custkey + 1 else o_custkey end as o_custkey, case when o_orderstatus = 'O' then 'X' else o_orderstatus end as o_orderstatus from orders")
def table_update(spark, d):
    path = shared_folder(spark, "update")
    sinks.write_files(_orders(spark, d), path)
    sinks.update_rows(spark, path, "o_orderstatus = 'O'", {"o_custkey": "o_custkey + 1", "o_orderstatus": "'X'"})
    return spark.read.parquet(path)


@query("select o_orderkey, o_custkey, o_orderstatus, true as fewer from orders")
def table_optimize(spark, d):
    path = shared_folder(spark, "optimize")
    sinks.write_files(_orders(spark, d).repartition(12), path)
    sinks.optimize(spark, path)
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().agg((F.count("f") < 12).alias("fewer"))
    return spark.read.parquet(path).crossJoin(F.broadcast(files))  # one row


@query("select o_orderstatus, count(*) as n from orders group by 1")
def view_refresh(spark, d):
    path = shared_folder(spark, "view")
    counts = _orders(spark, d).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    sinks.refresh_view(counts.withColumn("n", -F.col("n")), path)
    sinks.refresh_view(counts, path)
    return spark.read.parquet(path)


@query("select 'first' as write, count(*) as rows from orders where o_orderstatus = 'F' union all select 'append', count(*) from orders where o_orderstatus <> 'F' union all select 'empty', 0 union all select 'total', count(*) from orders")
def writer_report(spark, d):
    path, rows = shared_folder(spark, "report"), _orders(spark, d)
    parts = [("first", rows.where("o_orderstatus = 'F'"), "error"), ("append", rows.where("o_orderstatus <> 'F'").repartition(3), "append"), ("empty", rows.limit(0), "append")]
    out = None
    for name, part, mode in parts:
        told = sinks.write_with_result(part, path, mode=mode, not_null=["o_orderkey"], partitioned_by=["o_orderstatus"] if name != "empty" else None)
        told = told.agg(F.sum("rows").alias("rows")).select(F.lit(name).alias("write"), "rows")
        out = told if out is None else out.unionAll(told)
    return out.unionAll(spark.read.parquet(path).agg(F.count(F.lit(1))).select(F.lit("total"), "count(1)"))


@query("select true as refused, 0 as left_behind")
def writer_not_null(spark, d):
    path, refused = shared_folder(spark, "strict"), False
    rows = _orders(spark, d).withColumn("o_custkey", F.expr("nullif(o_custkey, o_custkey)"))
    try:
        sinks.write_with_result(rows, path, not_null=["o_custkey"])
    except Exception as e:
        refused = "NOT NULL" in str(e)
    return spark.createDataFrame([(refused, int(sinks.exists(spark, path)))], "refused boolean, left_behind int")


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def write_scaled(spark, d):
    path = shared_folder(spark, "scaled")
    sinks.write_files(Relation(_orders(spark, d)).scaled("o_orderstatus").df, path, partitioned_by=["o_orderstatus"], scale=True)
    return spark.read.parquet(path).select(*_COLUMNS)


@query("select count(*) as rows, min(value) as lo, max(value) as hi, count(props) as present, cast(count_if(value > 50) as bigint) as high, cast(max(octet_length(encode(props))) as bigint) as longest, cast(sum(octet_length(encode(props))) as bigint) as bytes, true as close, true as sketched from events")
def write_all_stats(spark, d):
    df = rel(spark, d, "events").project({"value": "value", "props": "props", "high": "value > 50", "user_id": "user_id"}).df
    s = sinks.column_statistics(df).crossJoin(df.agg(F.countDistinct("user_id").alias("exact")))
    near = lambda c: (F.abs(c - F.col("exact")) <= 0.15 * F.col("exact")).alias
    return s.select("rows", F.col("`value$min`").alias("lo"), F.col("`value$max`").alias("hi"), F.col("`props$non_null`").alias("present"), F.col("`high$true_count`").alias("high"), F.col("`props$max_size`").alias("longest"), F.col("`props$total_size`").alias("bytes"), near(F.col("`user_id$ndv`"))("close"), near(F.hll_sketch_estimate("`user_id$ndv_summary`"))("sketched"))


# sources


@query("select format, n_nationkey, n_name from nation, (values ('ORC'), ('PARQUET'), ('JSON'), ('CSV')) as f(format) union all select 'TEXTFILE', null, n_name from nation")
def read_formats(spark, d):
    rows, out = rel(spark, d, "nation").output(["n_nationkey", "n_name"]).df, None
    for name in ("ORC", "PARQUET", "JSON", "CSV", "TEXTFILE"):
        path, part = shared_folder(spark, "format"), rows if name != "TEXTFILE" else rows.select(F.col("n_name").alias("value"))
        sinks.write_files(part, path, readers.FORMATS[name])
        back = readers.read_files(spark, path, name, part.schema)
        back = back.select(F.lit(name).alias("format"), *(["n_nationkey", "n_name"] if name != "TEXTFILE" else [F.lit(None).cast("int").alias("n_nationkey"), F.col("value").alias("n_name")]))
        out = back if out is None else out.unionAll(back)
    return out


@query("select c.catalog, r_regionkey, r_name from region, (values ('files'), ('hive'), ('hive2')) as c(catalog)")
def catalog_tables(spark, d):
    rows, t = rel(spark, d, "region").df, _table(spark)
    warehouse = shared_folder(spark, "warehouse")
    sinks.write_files(rows, f"{warehouse}/db/region", "orc")
    sinks.create_table(rows, t["name"], path=t["path"])
    with tempfile.TemporaryDirectory() as conf:  # settings, which the driver reads
        Path(conf, "files.properties").write_text(f"# a warehouse of folders\nconnector.name=files\nwarehouse={warehouse}\nformat=ORC\n")
        Path(conf, "hive.properties").write_text("connector.name=hive\n")
        Path(conf, "hive2.properties").write_text("connector.name=hive-hadoop2\n")
        catalogs = readers.load_catalogs(conf)
    out = None
    for name, catalog in catalogs.items():
        part = catalog.read(spark, *(("db", "region") if name == "files" else ("default", t["name"])), schema=rows.schema).select(F.lit(name).alias("catalog"), "r_regionkey", "r_name")
        out = part if out is None else out.unionAll(part)
    return out


@query("select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as status, case o_orderstatus when 'F' then 1 when 'O' then 2 end as level from orders")
def read_split_values(spark, d):
    """Files of one status each, in plain folders, every file in two byte ranges."""
    root, splits = shared_folder(spark, "splits"), []
    schema = parse_schema({"o_orderkey": "bigint", "o_custkey": "bigint"})
    for status, level in (("F", "1"), ("O", "2"), ("P", "")):
        folder = f"{root}/{status}"
        sinks.write_files(_orders(spark, d).where(F.col("o_orderstatus") == status).drop("o_orderstatus").repartition(2), folder)
        values = {"status": "" if status == "P" else status, "level": level}
        for file in sinks.files_of(spark, folder):
            splits += [readers.Split(file, values, 0, 50, select_pushdown=True), readers.Split(file, values, 50)]
    return readers.read_splits(spark, splits, "PARQUET", schema, dict((f.name, f.dataType) for f in parse_schema({"status": "varchar", "level": "integer"}).fields))


@query("select r_regionkey, r_name, cast(null as integer) as p from region where false")
def read_empty_split(spark, d):
    rows = rel(spark, d, "region").output(["r_regionkey", "r_name"]).df
    return readers.read_splits(spark, [], "ORC", rows.schema, {f.name: f.dataType for f in parse_schema({"p": "integer"}).fields})


@query("select o_orderstatus as s, count(*) as n, min(o_orderkey) as lo from orders where nullif(o_orderstatus, 'P') is null or o_orderstatus = 'F' group by 1")
def read_partition_folders(spark, d):
    """Partition folders: the empty value is NULL, and only folders that are asked for are read."""
    path = shared_folder(spark, "parts")
    sinks.write_files(_orders(spark, d).withColumn("s", F.expr("nullif(o_orderstatus, 'P')")), path, partitioned_by=["s"])
    rows = Relation.scan(spark.read.parquet(path), None, {"s": Domain(["F"], null_allowed=True)})
    return rows.aggregate(["o_orderstatus"], {"n": "count(1)", "lo": "min(o_orderkey)"}).output(["o_orderstatus", "n", "lo"], ["s", "n", "lo"]).df


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def read_buckets(spark, d):
    """A bucketed table by its bucket filter, and by splits that name their bucket."""
    t = _table(spark)
    sinks.create_table(_orders(spark, d), t["name"], bucketed_by=["o_custkey"], buckets=4, sorted_by=["o_custkey"], path=t["path"])
    even = readers.in_buckets(spark.table(t["name"]), ["o_custkey"], 4, [0, 2])
    splits = [readers.Split(f, bucket=b) for f in sinks.files_of(spark, t["path"]) for b in (1, 3) if f"_{b:05d}." in f]
    return even.unionByName(readers.read_splits(spark, splits, "PARQUET", _orders(spark, d).schema, {}))


@query("select o_orderkey as k, o_orderstatus as s, o_custkey % 10 as last from orders where o_custkey > 500")
def read_nested(spark, d):
    """Leaves of nested columns; the scan's predicate is on a column of the top."""
    path = shared_folder(spark, "nested")
    rows = _orders(spark, d).select(F.struct("o_orderkey", F.struct("o_orderstatus", F.struct((F.col("o_custkey") % 10).alias("digit"), F.lit("unread").alias("x")).alias("more")).alias("in")).alias("row"), F.col("o_custkey").alias("c"))
    sinks.write_files(rows, path)
    return Relation.scan(spark.read.parquet(path), {"k": "row.o_orderkey", "s": "row.in.o_orderstatus", "last": "row.in.more.digit"}, {"c": Domain(ranges=[Range(500, None, False)])}).df


@query("select o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus as status, cast(null as double) as rating from orders")
def read_evolved(spark, d):
    """Files of an older schema: narrower types, a column less and one that is gone."""
    path = shared_folder(spark, "evolved")
    sinks.write_files(_orders(spark, d).selectExpr("cast(o_orderkey as int) o_orderkey", "cast(o_custkey as int) o_custkey", "o_orderstatus status", "1 as dropped"), path)
    return readers.coerce(spark.read.parquet(path), parse_schema({"o_orderkey": "bigint", "o_custkey": "varchar", "status": "varchar", "rating": "double"}))


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey % 7 <> 0 and o_orderkey % 5 <> 0")
def read_without_deleted(spark, d):
    """Rows that delete files do not name, by keys of which some are NULL."""
    rows = _orders(spark, d).withColumn("k", F.expr("case when o_orderkey % 5 <> 0 then o_orderkey end"))
    deletes = rows.where("o_custkey % 7 = 0 or k is null").select("k")
    path = shared_folder(spark, "deltas")
    sinks.write_files(deletes, path, "orc")
    return readers.without_deleted(rows, spark.read.schema(deletes.schema).orc(path), ["k"]).select(*_COLUMNS)


@query("select 'all' as kind, count(*) as n from orders union all select 'none', 0 union all select 'all known', (select count(*) from orders where o_orderkey % 5 <> 0) union all select 'only null', (select count(*) from orders where o_orderkey % 5 = 0) union all select 'some or null', (select count(*) from orders where o_orderkey % 5 = 0 or o_orderkey in (1, 2, 3)) union all select 'others', (select count(*) from orders where o_orderkey % 5 <> 0 and o_orderkey not in (1, 2, 3)) union all select 'ranges', (select count(*) from orders where o_orderkey % 5 <> 0 and (o_orderkey < 40 or o_orderkey between 90 and 200 or o_orderkey > 1000)) union all select 'nothing at all', 0")
def domain_kinds(spark, d):
    source, out = rel(spark, d, "orders").project({"k": "case when o_orderkey % 5 <> 0 then o_orderkey end"}).df, None
    kinds = {
        "all": {"k": Domain(all=True, null_allowed=True)}, "none": {"k": Domain(all=False)}, "all known": {"k": Domain(all=True)}, "only null": {"k": Domain(all=False, null_allowed=True)},
        "some or null": {"k": Domain([1, 2, 3], null_allowed=True)}, "others": {"k": Domain([1, 2, 3], inclusive=False)}, "nothing at all": None,
        "ranges": {"k": Domain(ranges=[Range(None, 40, True, False), Range(90, 200), Range(1000, None, False)])},
    }
    for name, domains in kinds.items():
        part = Relation.scan(source, None, domains).aggregate([], {"n": Agg("count")}).df.select(F.lit(name).alias("kind"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("select o_orderstatus, count(*) as n, min(o_custkey) as lo from orders group by 1")
def cached_scan(spark, d):
    """Read twice, from the source once."""
    rows = Relation(_orders(spark, d)).cached()
    counts = rows.aggregate(["o_orderstatus"], {"n": "count(1)"})
    lows = rows.aggregate(["o_orderstatus"], {"lo": "min(o_custkey)"})
    return counts.join(lows, "inner", [("o_orderstatus", "o_orderstatus")], None, None, ["lo"]).df


@query("select count(*) as n, true as named from nation")
def file_columns(spark, d):
    rows = readers.with_file_columns(spark.read.parquet(f"{d}/nation.parquet"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("`$path`").endswith("nation.parquet") & (F.col("`$file_size`") > 0)).alias("named"))
