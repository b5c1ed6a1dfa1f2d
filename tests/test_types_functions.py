import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import NotSupported, classify
from sparkloom.functions import call, normalise
from sparkloom.session import apply_session_properties
from sparkloom.types import ZONED, TypeSignatureError, literal, parse_type, zoned, zoned_local
from sparkloom.units import parse_duration, parse_size


@pytest.mark.parametrize("text,kind", [
    ("BIGINT", T.LongType()), ("int", T.IntegerType()), ("double precision", T.DoubleType()), ("varchar(25)", T.StringType()), ("char(3)", T.StringType()), ("varbinary", T.BinaryType()),
    ("decimal(38, 4)", T.DecimalType(38, 4)), ("timestamp(3)", T.TimestampType()), ("timestamp with time zone", ZONED), ("timestamp(3) with time zone", ZONED), ("unknown", T.NullType()),
    ("interval day to second", T.DayTimeIntervalType()), ("interval year to month", T.YearMonthIntervalType()), ("array(map(varchar, integer))", T.ArrayType(T.MapType(T.StringType(), T.IntegerType()))),
    ('row(x bigint, "a b" array(date), double precision)', T.StructType([T.StructField("x", T.LongType()), T.StructField("a b", T.ArrayType(T.DateType())), T.StructField("field2", T.DoubleType())])),
])
def test_type_signatures(text, kind):
    assert parse_type(text) == kind


def test_type_signature_errors():
    for bad in ("nope", "array(", "decimal(1,2", "bigint)", "time with time zone", "row()"):
        with pytest.raises(TypeSignatureError):
            parse_type(bad)
    assert parse_type("timestamp", legacy_timestamp=False) == T.TimestampNTZType()


def test_operators(spark):
    df = spark.createDataFrame([(7, 2, -7, [10, 20], {"a": 1})], "a int, b int, c int, l array<int>, m map<string,int>")
    one = lambda c: df.select(c.alias("x")).first()[0]
    assert one(call(df, "cat.main.$operator$divide", "a", "b")) == 3 and one(call(df, "divide", "c", "b")) == -3
    assert one(call(df, "divide", "a", "2.0D")) == 3.5 and one(call(df, "modulus", "c", "3")) == -1
    assert one(call(df, "subscript", "l", "1")) == 10 and one(call(df, "subscript", "m", "'z'")) is None
    assert one(call(df, "is_distinct_from", "a", "null")) is True and one(call(df, "eq", "a", "cast(null as int)")) is None
    assert one(call(df, "if", "a > 1", "'y'")) == "y" and one(call(df, "truncate", F.lit(-2.7))) == -2
    assert one(call(df, "cardinality", "l")) == 2
    assert one(call(df, "contains", "l", F.lit(20))) is True and one(call(df, "strpos", F.lit("hello"), F.lit("l"))) == 3
    for bad in (call(df, "subscript", "l", "5"), call(df, "divide", "a", "0"), call(df, "add", "2147483647", "a")):
        with pytest.raises(Exception) as e:
            one(bad)
        assert classify(e.value) == ("USER_ERROR", "GENERIC_USER_ERROR")
    assert normalise("a.b.Sum") == "sum" and normalise("$operator$Add") == "add"


def test_three_valued_logic(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert [r[0] for r in df.filter(~F.col("v").isin(1)).collect()] == [2]
    assert df.filter("v not in (1, null)").count() == 0


def test_literals(spark):
    row = spark.range(1).select(literal(5, "smallint").alias("a"), literal("1.50", "decimal(10,2)").alias("b"), literal(None, "date").alias("c"), literal("99999999999999999999999999999999999999", "decimal(38,0)").alias("d"), literal('{"x": 1}', "json").alias("e"), literal(dt.timedelta(days=1), "interval day to second").alias("f"))
    assert [f.dataType.simpleString() for f in row.schema.fields] == ["smallint", "decimal(10,2)", "date", "decimal(38,0)", "variant", "interval day to second"]
    got = row.first()
    assert got[:4] == (5, Decimal("1.50"), None, Decimal("9" * 38)) and got[5] == dt.timedelta(days=1)


def test_zoned_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01 12:00:00", "America/New_York")], "t string, z string").select(zoned(F.col("t"), F.col("z")).alias("v"))
    assert df.schema["v"].dataType == ZONED
    assert df.select(zoned_local(F.col("v")).cast("string")).first()[0] == "2024-01-01 07:00:00"


def test_legacy_timestamps(spark):
    old = spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.timestampType")
    try:
        apply_session_properties(spark, {}, "America/New_York", legacy_timestamp=True)
        assert spark.sql("select timestamp'2024-01-01 00:00:00' t").schema["t"].dataType == T.TimestampType()
        assert spark.sql("select cast(timestamp'2024-01-01 00:00:00' as long)").first()[0] == 1704085200
        apply_session_properties(spark, {}, legacy_timestamp=False)
        assert spark.sql("select timestamp'2024-01-01 00:00:00' t").schema["t"].dataType == T.TimestampNTZType()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old[0])
        spark.conf.set("spark.sql.timestampType", old[1])


def test_units():
    assert parse_size("1.5kB") == 1536 and parse_size("2 GB") == 2 << 30 and parse_duration("1.5m") == 90 and abs(parse_duration("3ns") - 3e-9) < 1e-18
    assert parse_duration(" 250 ms ") == 0.25 and parse_size("10B") == 10
    for bad in ("5", "5 XB", "-1s", "1_0 s", "nan s", "", "kB"):
        with pytest.raises(ValueError):
            parse_size(bad)


def test_classify():
    assert classify(NotSupported("x")) == ("USER_ERROR", "NOT_SUPPORTED") and classify(RuntimeError("x")) == ("INTERNAL_ERROR", "GENERIC_INTERNAL_ERROR")
    assert classify(MemoryError()) == ("INSUFFICIENT_RESOURCES", "GENERIC_INSUFFICIENT_RESOURCES")
