"""Writers: create, insert, delete, update, compact, refresh, and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import plain_uri

#: Compacted files have about so many bytes.
FILE_BYTES = 256 << 20


def require_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails on the first NULL in one of the columns."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"NULL in the NOT NULL column {c}")).cast(df.schema[c].dataType)))
    return df


def create_table(df: DataFrame, name: str, format: str = "parquet", partitioned_by: list[str] | None = None, bucketed_by: list[str] | None = None, buckets: int = 0, sorted_by: list[str] | None = None, properties: dict[str, str] | None = None, path: str | None = None, not_null: list[str] | None = None) -> None:
    """A new table from rows; partitioned, bucketed and sorted as declared."""
    writer = require_not_null(df, not_null or []).write.format(format).mode("error")
    for k, v in (properties or {}).items():
        writer = writer.option(k, v)
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    if bucketed_by:
        writer = writer.bucketBy(buckets, *bucketed_by)
        if sorted_by:
            writer = writer.sortBy(*sorted_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def insert_into(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """Rows into an existing table, columns by name."""
    columns = df.sparkSession.table(name).columns
    df.select(*columns).write.insertInto(name, overwrite=overwrite)


def write_files(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partitioned_by: list[str] | None = None, scale: bool = False, **options) -> None:
    """Files in a new folder (``error``), an existing one (``append``) or in its
    place (``overwrite``). ``scale`` evens out file sizes first."""
    if scale:
        df = df.hint("rebalance", *(partitioned_by or []))
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partitioned_by) if partitioned_by else writer).save(path)


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _rename(fs, source, target) -> bool:
    return fs.rename(source, target)


def _files(fs, folder) -> list[tuple[str, object]]:
    """Data files below a folder: their path within it, and as they are."""
    out, found, root = [], fs.listFiles(folder, True), fs.makeQualified(folder).toString()
    while found.hasNext():
        path = found.next().getPath()
        if not path.getName().startswith(("_", ".")):
            out.append((path.toString()[len(root) :].lstrip("/"), path))
    return sorted(out, key=lambda f: f[0])


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files below a folder."""
    fs, at = _fs(spark, path)
    return [f.toString() for _, f in _files(fs, at)]


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows that are counted (``rows``) as they are written, without another pass."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_with_result(df: DataFrame, path: str, format: str = "parquet", not_null: list[str] | None = None, mode: str = "error", partitioned_by: list[str] | None = None, **more) -> DataFrame:
    """Writes and returns what a writer reports: each file of this write
    (``fragment``) and its row count; one row of no fragment for an empty write.

    Files are written to a staging folder, counted there (by their footers,
    where the format has any) and then moved: an append reports its own rows.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fs, target = _fs(spark, path)
    if mode not in ("error", "append", "overwrite"):
        raise ValueError(f"unknown write mode {mode!r}")
    if mode == "error" and fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    here = _fs(spark, stage)[1]
    Path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    try:
        write_files(require_not_null(df, not_null or []), stage, format, partitioned_by=partitioned_by, **more)
        schema = T.StructType([f for f in df.schema.fields if f.name not in (partitioned_by or [])])
        names = _files(fs, here)
        rows: dict[str, int] = {}
        if names:
            back = spark.read.format(format).schema(schema).option("recursiveFileLookup", True).load(stage)
            rows = dict(map(tuple, back.groupBy(plain_uri(F.col("_metadata.file_path"))).agg(F.count(F.lit(1))).collect()))
        if mode == "overwrite" or not fs.exists(target):
            _swap(spark, path, stage)
        else:
            moved = []
            for name, file in names:
                to = Path(f"{path}/{name}")
                if not fs.mkdirs(to.getParent()) or not _rename(fs, file, to) or not fs.exists(to):
                    for done in moved:
                        fs.delete(done, False)
                    raise OSError(f"{name} could not be moved to {path}, which is as it was")
                moved.append(to)
    finally:
        fs.delete(here, True)
    spark.catalog.refreshByPath(path)
    done = [(name, rows.get(plain_uri(file.toUri().toString()), 0)) for name, file in names]
    return spark.createDataFrame([r for r in done if r[1]] or [(None, 0)], "fragment string, rows long")


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back a table that a driver lost between the two steps of a swap."""
    fs, target = _fs(spark, path.rstrip("/"))
    old = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-*")) or []
    return not fs.exists(target) and len(old) == 1 and _rename(fs, old[0].getPath(), target)


def _swap(spark: SparkSession, path: str, fresh: str) -> None:
    """Puts a written folder in the place of another one, if there is one.

    The old folder is set aside first and goes only once the new one is in its
    place; where that fails it is put back and OSError is raised.
    """
    fs, target = _fs(spark, path)
    source, old = _fs(spark, fresh)[1], _fs(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    if not fs.exists(source):
        raise OSError(f"{fresh} was not written")
    had = fs.exists(target)
    if had and (not _rename(fs, target, old) or fs.exists(target)):
        raise OSError(f"{path} could not be set aside and is as it was")
    if not _rename(fs, source, target) or not fs.exists(target):
        if had and not _rename(fs, old, target):
            raise OSError(f"{path} could not be replaced; its rows are in {old.toString()}, new ones in {fresh}")
        raise OSError(f"{path} could not be replaced and is as it was; new rows are in {fresh}")
    if had:
        fs.delete(old, True)


def _rewrite(spark: SparkSession, path: str, format: str, df: DataFrame, partitioned_by: list[str] | None) -> None:
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    write_files(df, fresh, format, partitioned_by=partitioned_by)
    _swap(spark, path.rstrip("/"), fresh)
    spark.catalog.refreshByPath(path)


def delete_rows(spark: SparkSession, path: str, predicate: str, format: str = "parquet", partitioned_by: list[str] | None = None) -> None:
    """Rewrites the files of a folder without the rows for which the predicate is true."""
    df = spark.read.format(format).load(path)
    _rewrite(spark, path, format, df.filter(~F.coalesce(F.expr(predicate), F.lit(False))), partitioned_by)


def update_rows(spark: SparkSession, path: str, predicate: str, assignments: dict[str, str], format: str = "parquet", partitioned_by: list[str] | None = None) -> None:
    """Rewrites the files of a folder with new values where the predicate is true."""
    df = spark.read.format(format).load(path)
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    cols = [(F.when(hit, F.expr(assignments[f.name]).cast(f.dataType)).otherwise(F.col(f.name)) if f.name in assignments else F.col(f.name)).alias(f.name) for f in df.schema.fields]
    _rewrite(spark, path, format, df.select(*cols), partitioned_by)


def optimize(spark: SparkSession, path: str, format: str = "parquet", partitioned_by: list[str] | None = None) -> None:
    """Compacts a folder's files to even sizes.

    Without partitions they are as many as their bytes fill files of
    FILE_BYTES, whatever the number of cores, and never more than there were.
    """
    df = spark.read.format(format).load(path)
    if partitioned_by:
        df = df.hint("rebalance", *partitioned_by)
    else:
        fs, at = _fs(spark, path)
        sizes = [fs.getFileStatus(file).getLen() for _, file in _files(fs, at)]
        df = df.repartition(max(1, min(len(sizes), -(-sum(sizes) // FILE_BYTES))))
    _rewrite(spark, path, format, df, partitioned_by)


def refresh_view(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Replaces the stored rows of a derived table."""
    _rewrite(df.sparkSession, path, format, df, None)


STATISTICS = ("min", "max", "ndv", "ndv_summary", "non_null", "true_count", "max_size", "total_size")


def _statistic(name: str, kind: T.DataType, what: str) -> Column | None:
    c = F.col(name)
    text = isinstance(kind, (T.StringType, T.BinaryType))
    plain = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    if what in ("min", "max"):
        return getattr(F, what)(c) if plain and not isinstance(kind, (T.BooleanType, T.BinaryType)) else None
    if what == "ndv":
        return F.approx_count_distinct(c) if plain else None
    if what == "ndv_summary":
        return F.hll_sketch_agg(c) if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else None
    if what == "non_null":
        return F.count(c)
    if what == "true_count":
        return F.count_if(c) if isinstance(kind, T.BooleanType) else None
    if what == "max_size":
        return F.max(F.octet_length(c)).cast("long") if text else None
    return F.sum(F.octet_length(c)).cast("long") if text else None


def column_statistics(df: DataFrame, columns: list[str] | None = None, kinds: tuple[str, ...] = STATISTICS) -> DataFrame:
    """One row: the row count and ``column$statistic`` for what applies, in one pass."""
    cols = [F.count(F.lit(1)).alias("rows")]
    for name in columns or df.columns:
        for what in kinds:
            if (c := _statistic(name, df.schema[name].dataType, what)) is not None:
                cols.append(c.alias(f"{name}${what}"))
    return df.agg(*cols)
