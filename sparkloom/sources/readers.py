"""Readers: formats, partition values, nested columns, coercions, deletes."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotSupported

#: Storage formats by name, and Spark's reader for each that there is one for.
FORMATS = {
    "ORC": "orc", "PARQUET": "parquet", "JSON": "json", "TEXTFILE": "text", "CSV": "csv", "AVRO": "avro", "DWRF": None, "PAGEFILE": None,
    "RCBINARY": "hive", "RCTEXT": "hive", "SEQUENCEFILE": "hive",
}


#: Connectors by name: tables that Spark's own catalog knows, or folders of a warehouse.
CONNECTORS = {"hive": "tables", "hive-hadoop2": "tables", "files": "folders"}


class Catalog:
    """A named set of tables, as one properties file describes it. With a
    ``warehouse`` tables are its folders, else those of Spark's catalog."""

    def __init__(self, name: str, properties: dict[str, str]):
        if "connector.name" not in properties:
            raise ValueError(f"catalog {name} lacks connector.name")
        if properties["connector.name"] not in CONNECTORS:
            raise NotSupported(f"unknown connector {properties['connector.name']!r}")
        self.name, self.properties = name, properties
        self.folders = "warehouse" in properties or CONNECTORS[properties["connector.name"]] == "folders"

    def path(self, database: str, table: str) -> str:
        return f"{self.properties['warehouse'].rstrip('/')}/{database}/{table}"

    def read(self, spark: SparkSession, database: str, table: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
        if not self.folders:
            return spark.table(f"`{database}`.`{table}`")
        return read_files(spark, self.path(database, table), self.properties.get("format", "PARQUET"), schema, **options)


def load_catalogs(folder: str) -> dict[str, Catalog]:
    """A catalog for each ``*.properties`` file of a folder."""
    out = {}
    for file in sorted(Path(folder).glob("*.properties")):
        lines = [x.strip() for x in file.read_text().splitlines()]
        out[file.stem] = Catalog(file.stem, dict(tuple(p.strip() for p in x.split("=", 1)) for x in lines if x and not x.startswith("#")))
    return out


def read_files(spark: SparkSession, path: str | list[str], format: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Files of a storage format; pass a schema rather than have one inferred."""
    kind = FORMATS.get(format.upper())
    if kind is None or kind == "hive":
        raise NotSupported(f"no reader for {format}" if format.upper() in FORMATS else f"unknown format {format}")
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def with_partition_values(df: DataFrame, values: dict[str, str | None], types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Partition keys of a split as constant columns; an empty value is NULL."""
    types = types or {}
    return df.withColumns({k: F.lit(None if v in ("", None, "__HIVE_DEFAULT_PARTITION__") else v).cast(types.get(k, T.StringType())) for k, v in values.items()})


@dataclass(frozen=True)
class Split:
    """A file, or all files of a folder, with the values of its partition keys;
    of a file possibly a byte range; the bucket that its rows must be of.
    ``select_pushdown`` asks a store to filter: here filters reach the scan anyway."""

    path: str
    values: dict[str, str | None] = field(default_factory=dict)
    start: int = 0
    length: int | None = None
    bucket: int | None = None
    select_pushdown: bool = False


def plain_uri(uri: str | Column):
    """Addresses of local files are written with one slash and with three."""
    return F.regexp_replace(uri, "^file:/+", "file:/") if isinstance(uri, Column) else "file:/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def _resolved(spark: SparkSession, split: Split) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(split.path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(path)] if fs.getFileStatus(path).isFile() else [s for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return [s.getPath().toUri().toString() for s in found]


#: Splits are joined by a broadcast up to so many of them.
FEW_SPLITS = 50_000


def read_splits(spark: SparkSession, splits: list[Split | tuple], format: str, schema: T.StructType, partition_types: dict[str, T.DataType]) -> DataFrame:
    """The rows of splits with their partition values, in one read of all files,
    which is joined with the list of splits.

    A byte range has the rows of the blocks that start in it, so that ranges
    which cover a file give each row once. An empty partition value is NULL.
    """
    splits = [s if isinstance(s, Split) else Split(*s) for s in splits]
    rows = [(plain_uri(file), s.start, s.length, s.bucket, *[None if s.values.get(k) in ("", None, "__HIVE_DEFAULT_PARTITION__") else s.values[k] for k in partition_types]) for s in splits for file in _resolved(spark, s)]
    if not rows:
        return spark.createDataFrame([], T.StructType([*schema.fields, *[T.StructField(k, t) for k, t in partition_types.items()]]))
    keys = [f"_v{i}" for i in range(len(partition_types))]
    table = spark.createDataFrame(rows, ", ".join(["_file string", "_start long", "_length long", "_bucket int", *[f"{k} string" for k in keys]]))
    files = read_files(spark, sorted({f for s in splits for f in _resolved(spark, s)}), format, schema)
    files = files.select("*", plain_uri(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    found = files.join(table.hint("broadcast" if len(rows) <= FEW_SPLITS else "merge"), "_file")
    found = found.where((F.col("_at") >= F.col("_start")) & (F.col("_length").isNull() | (F.col("_at") < F.col("_start") + F.col("_length"))))
    own = F.nullif(F.regexp_extract("_file", r"_(\d+)(?:\.[^/]*)?$", 1), F.lit("")).cast("int")
    wrong = F.col("_bucket").isNotNull() & ~own.eqNullSafe(F.col("_bucket"))
    found = found.where(F.when(wrong, F.raise_error(F.concat(F.lit("a file of another bucket: "), F.col("_file"))).cast("boolean")).otherwise(True))
    return found.select(*[F.col(f"`{f.name}`") for f in schema.fields], *[F.col(k).cast(t).alias(name) for k, (name, t) in zip(keys, partition_types.items())])


def bucket_number(columns: list[str], buckets: int) -> Column:
    """The bucket that Spark's bucketed tables put a row in."""
    return F.pmod(F.hash(*columns), F.lit(buckets))


def in_buckets(df: DataFrame, columns: list[str], buckets: int, keep: list[int]) -> DataFrame:
    """A bucket filter: the rows of some of the buckets."""
    return df.where(bucket_number(columns, buckets).isin(keep))


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of an older file brought to a table's schema: cast, or NULL where missing."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select([(F.col(f.name) if have.get(f.name) == f.dataType else F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def without_deleted(df: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no delete file names; NULL keys compare equal."""
    d = deletes.select(*[F.col(k).alias(f"_d_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        c = df[k].eqNullSafe(d[f"_d_{k}"])
        on = c if on is None else on & c
    return df.join(d, on, "left_anti")


def with_file_columns(df: DataFrame) -> DataFrame:
    """The synthesized columns of a file scan."""
    return df.select("*", F.col("_metadata.file_path").alias("$path"), F.col("_metadata.file_size").alias("$file_size"), F.col("_metadata.file_modification_time").alias("$file_modified_time"))
