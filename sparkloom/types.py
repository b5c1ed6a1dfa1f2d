"""Type signatures as text, and zoned timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "integer": T.IntegerType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "real": T.FloatType(), "double": T.DoubleType(), "double precision": T.DoubleType(), "varchar": T.StringType(), "char": T.StringType(), "varbinary": T.BinaryType(),
    "date": T.DateType(), "interval day to second": T.DayTimeIntervalType(), "interval year to month": T.YearMonthIntervalType(), "unknown": T.NullType(),
    "json": T.VariantType(), "hyperloglog": T.BinaryType(),
}
_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z_][A-Za-z0-9_]*)|(\d+)|([(),]))')
#: An instant and the name of the zone that it is shown in.
ZONED = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("tz", T.StringType())])
_LONGER = ("double precision", "time with time zone", "timestamp with time zone", "interval day to second", "interval year to month")


class TypeSignatureError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str, legacy_timestamp: bool):
        self.text, self.legacy, self.at = text, legacy_timestamp, 0
        self.tokens: list[str] = []
        pos = 0
        while pos < len(text.rstrip()):
            m = _TOKEN.match(text, pos)
            if not m:
                raise TypeSignatureError(f"unexpected {text[pos:]!r} in type {text!r}")
            self.tokens.append(m[0].strip())
            pos = m.end()

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise TypeSignatureError(f"expected {want or 'a name'}, got {got or 'the end'!r} in type {self.text!r}")
        self.at += 1
        return got

    def name(self) -> str:
        for words in sorted((w.split() for w in _LONGER), key=len, reverse=True):
            if [self.peek(k).lower() for k in range(len(words))] == words:
                self.at += len(words)
                return " ".join(words)
        return self.take().lower()

    def numbers(self) -> list[int]:
        if self.peek() != "(":
            return []
        self.take("(")
        out = [int(self.take())]
        while self.peek() == ",":
            self.take(",")
            out.append(int(self.take()))
        self.take(")")
        return out

    def type(self) -> T.DataType:
        name = self.name()
        if name == "array":
            self.take("(")
            item = self.type()
            self.take(")")
            return T.ArrayType(item)
        if name == "map":
            self.take("(")
            key = self.type()
            self.take(",")
            value = self.type()
            self.take(")")
            return T.MapType(key, value)
        if name == "row":
            self.take("(")
            fields = []
            while True:
                fields.append(self.field(len(fields)))
                if self.peek() != ",":
                    break
                self.take(",")
            self.take(")")
            return T.StructType(fields)
        numbers = self.numbers()
        if name == "decimal":
            p, s = (numbers + [0])[:2] if numbers else (38, 0)
            return T.DecimalType(p, s)
        if name == "timestamp":
            if [self.peek(k).lower() for k in range(4)] == ["with", "time", "zone", ""] or [self.peek(k).lower() for k in range(3)] == ["with", "time", "zone"]:
                self.at += 3
                return ZONED
            return T.TimestampType() if self.legacy else T.TimestampNTZType()
        if name == "timestamp with time zone":
            return ZONED
        if name == "time with time zone":
            raise TypeSignatureError("time with time zone has no counterpart")
        if name not in _SIMPLE:
            raise TypeSignatureError(f"unknown type {name!r} in {self.text!r}")
        return _SIMPLE[name]

    def field(self, no: int) -> T.StructField:
        word = self.peek()
        named = word.startswith('"')
        if not named and re.fullmatch(r"[A-Za-z_]\w*", word or ""):  # a name if a type follows it, else the type itself
            at = self.at
            try:
                kind = self.type()
                if self.peek() in (",", ")"):
                    return T.StructField(f"field{no}", kind)
            except TypeSignatureError:
                pass
            self.at, named = at, True
        if not named:
            raise TypeSignatureError(f"expected a field in {self.text!r}")
        self.take()
        return T.StructField(word[1:-1].replace('""', '"') if word.startswith('"') else word, self.type())


def parse_type(signature: str, legacy_timestamp: bool = True) -> T.DataType:
    """The Spark type of a signature such as ``map(varchar, array(decimal(10, 2)))``.

    Names are case-insensitive. Lengths of varchar, char and varbinary and
    precisions of timestamps are accepted and dropped.
    """
    parser = _Parser(signature, legacy_timestamp)
    kind = parser.type()
    if parser.at != len(parser.tokens):
        raise TypeSignatureError(f"{parser.peek()!r} is left over in type {signature!r}")
    return kind


def parse_schema(columns: dict[str, str], legacy_timestamp: bool = True) -> T.StructType:
    return T.StructType([T.StructField(name, parse_type(text, legacy_timestamp)) for name, text in columns.items()])


def zoned(ts: Column, tz: Column | str) -> Column:
    """A timestamp with time zone; compare and order it by its ``ts`` field, the instant."""
    return F.struct(ts.cast("timestamp").alias("ts"), (F.lit(tz) if isinstance(tz, str) else tz).alias("tz"))


def zoned_local(value: Column) -> Column:
    """The local date and time of a zoned timestamp in its own zone."""
    return F.convert_timezone(F.current_timezone(), value["tz"], value["ts"].cast("timestamp_ntz"))


def literal(value, signature: str) -> Column:
    """A constant of a declared type; None is a NULL of that type."""
    kind = parse_type(signature)
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.VariantType):
        return F.parse_json(F.lit(value))
    return F.lit(value).cast(kind)
