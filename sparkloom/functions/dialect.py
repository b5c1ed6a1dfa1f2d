"""Scalars of the SQL dialect whose name, arguments or results differ from Spark's.

Where both have a name, the dialect's meaning holds for its own number of
arguments, Spark's for the other: ``date_diff(unit, a, b)`` and ``date_diff(a, b)``.
Hashes take and give binary; a string is taken as UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NotSupported


def _sql(name: str) -> Callable[..., Column]:
    return lambda *a: F.call_function(name, *a)


def text_of(c: Column) -> str:
    """The text of a constant argument, which some functions need when a plan is made."""
    shown = c._jc.toString()
    return shown[1:-1] if len(shown) > 1 and shown[0] == shown[-1] == "'" else shown


def _binary(a: Column) -> Column:
    return a.cast("binary")


def _base64(a: Column) -> Column:
    """On one line, however long."""
    return F.translate(F.base64(_binary(a)), "\r\n", "")


def _split(s: Column, delimiter: Column, limit: Column | None = None) -> Column:
    """At a literal delimiter; with a limit the last part holds the rest."""
    quoted = F.concat(F.lit("\\Q"), F.replace(delimiter, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.call_function("split", s, quoted, limit if limit is not None else F.lit(-1))


def _truncate(a: Column, digits: Column | None = None) -> Column:
    """Towards zero, as a double of any size."""
    a = a.cast("double")
    scale = F.lit(1.0) if digits is None else F.pow(F.lit(10.0), digits)
    cut = (a * scale - (a * scale) % F.lit(1.0)) / scale
    return F.when(F.abs(a * scale) == float("inf"), a).otherwise(cut)


_UNITS = {"millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_DAYS = {"day": 1, "week": 7}


def _date_diff(unit: Column, a: Column, b: Column | None = None) -> Column:
    """Whole units from a to b; with two arguments days between dates, as Spark has it."""
    if b is None:
        return F.date_diff(unit, a)
    name = text_of(unit).lower()
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    if name not in (*_UNITS, *_DAYS, *_MONTHS):
        raise NotSupported(f"unknown unit {name!r}")
    return _whole_units(name, a, b)


def _whole_units(name: str, a: Column, b: Column) -> Column:
    instant = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = instant(b) - instant(a)
    if name in _MONTHS:
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        ahead, behind = F.add_months(a.cast("date"), months), instant(b)
        rest = instant(a) - F.unix_micros(a.cast("date").cast("timestamp"))
        reached = F.unix_micros(ahead.cast("timestamp")) + rest
        whole = months - F.when((months > 0) & (reached > behind), 1).when((months < 0) & (reached < behind), -1).otherwise(0)
        return F.call_function("div", whole, F.lit(_MONTHS[name])).cast("long")
    size = _UNITS.get(name) or _DAYS[name] * 24 * 3600 * 10**6
    return F.call_function("div", gap, F.lit(size))


def _date_add(unit: Column, n: Column, t: Column | None = None) -> Column:
    """t moved by n units, of t's type; with two arguments days after a date, as Spark has it."""
    if t is None:
        return F.date_add(unit, n)
    name = text_of(unit).lower()
    if name in _MONTHS:
        return t + F.make_ym_interval(F.lit(0), n * _MONTHS[name])
    if name in _DAYS:
        return t + F.make_dt_interval(n * _DAYS[name])
    if name in _UNITS:
        return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * _UNITS[name]).cast("decimal(18,6)") / F.lit(10**6).cast("decimal(8,0)"))
    raise NotSupported(f"unknown unit {name!r}")


_MYSQL = {
    "%a": "EEE", "%b": "MMM", "%c": "M", "%d": "dd", "%e": "d", "%f": "SSSSSS", "%H": "HH", "%h": "hh", "%I": "hh", "%i": "mm", "%j": "DDD", "%k": "H", "%l": "h",
    "%M": "MMMM", "%m": "MM", "%p": "a", "%r": "hh:mm:ss a", "%S": "ss", "%s": "ss", "%T": "HH:mm:ss", "%W": "EEEE", "%Y": "yyyy", "%y": "yy", "%%": "%",
}


def _pattern(c: Column) -> str:
    """A format of percent signs as one of letters; other letters are quoted."""
    text = text_of(c)
    if "%" not in text:
        return text

    def part(m: re.Match) -> str:
        if m[0].startswith("%"):
            if m[0] not in _MYSQL:
                raise NotSupported(f"date format {m[0]}")
            return _MYSQL[m[0]]
        return f"'{m[0]}'"

    return re.sub(r"%.|[A-Za-z]+", part, text)


def _url(part: str) -> Callable[..., Column]:
    return lambda u, *key: F.call_function("parse_url", u, F.lit(part), *key)


def _path(json: Column, path: Column) -> Column:
    return F.call_function("get_json_object", json, path)


def _zip(*arrays: Column) -> Column:
    return F.arrays_zip(*[a.alias(f"field{i}") for i, a in enumerate(arrays)])


def _sum(a: Column, zero: Column) -> Column:
    return F.aggregate(a, zero, lambda s, x: s + F.coalesce(x, zero))


def _to_base(n: Column, radix: Column) -> Column:
    return F.when(n < 0, F.concat(F.lit("-"), F.lower(_conv(F.abs(n).cast("string"), F.lit(10), radix)))).otherwise(F.lower(_conv(n.cast("string"), F.lit(10), radix)))


def _conv(s: Column, a: Column, b: Column) -> Column:
    return F.call_function("conv", s, a, b)


def _from_base(s: Column, radix: Column) -> Column:
    magnitude = _conv(F.ltrim(s, F.lit("-")), radix, F.lit(10)).cast("long")
    return F.when(F.startswith(s, F.lit("-")), -magnitude).otherwise(magnitude)


def _runs(ordered: Column, finish: Callable[[Column, Column], Column]) -> Column:
    """``finish(items, starts)`` of sorted items and the places where a new value starts; null for none."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~F.get(s, i - 1).eqNullSafe(F.get(s, i)))
    return F.get(F.transform(F.array(ordered), lambda s: F.when(F.size(s) > 0, F.get(F.transform(F.array(starts(s)), lambda p: finish(s, p)), F.lit(0)))), F.lit(0))


def length_of_run(s: Column, p: Column, j: Column) -> Column:
    return F.coalesce(F.get(p, j + 1), F.size(s)) - F.get(p, j)


def array_frequency(a: Column) -> Column:
    counted = _runs(F.array_sort(F.array_compact(a)), lambda s, p: F.map_from_arrays(F.transform(p, lambda i: F.get(s, i)), F.transform(p, lambda i, j: length_of_run(s, p, j))))
    return F.when(a.isNotNull(), F.coalesce(counted, F.map_from_arrays(F.slice(a, 1, 0), F.array().cast("array<int>"))))


def array_duplicates(a: Column) -> Column:
    found = _runs(F.array_sort(a), lambda s, p: F.filter(F.transform(p, lambda i, j: F.when(length_of_run(s, p, j) > 1, F.struct(F.get(s, i).alias("v")))), lambda x: x.isNotNull()))
    return F.when(a.isNotNull(), F.coalesce(F.transform(found, lambda x: x["v"]), F.slice(a, 1, 0)))


def _split_to_map(s: Column, entry: Column, pair: Column) -> Column:
    return F.map_from_entries(F.transform(_split(s, entry), lambda e: F.struct(F.get(_split(e, pair, F.lit(2)), F.lit(0)).alias("key"), F.get(_split(e, pair, F.lit(2)), F.lit(1)).alias("value"))))


def _width_bucket(x: Column, low: Column, *more: Column) -> Column:
    if more:
        return F.width_bucket(x, low, *more)
    return F.size(F.filter(low, lambda b: b <= x)).cast("long")


def _hamming(a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(F.call_function("split", a, F.lit("")).alias("a"), F.call_function("split", b, F.lit("")).alias("b"))
    same_length = F.when(F.length(a) != F.length(b), F.raise_error(F.lit("hamming_distance takes strings of one length")).cast("long"))
    return F.coalesce(same_length, F.size(F.filter(pairs, lambda p: p["a"] != p["b"])).cast("long"))


def _nth_position(s: Column, part: Column, n: Column | None = None) -> Column:
    """Where the nth occurrence of a part starts, from 1; 0 if there is none."""
    if n is None:
        return F.call_function("locate", part, s).cast("long")
    parts = _split(s, part)
    return F.when(F.size(parts) > n, F.length(F.array_join(F.slice(parts, F.lit(1), n), "")) + F.length(part) * (n - 1) + 1).otherwise(0).cast("long")


def _last_position(s: Column, part: Column) -> Column:
    at = F.call_function("locate", F.reverse(part), F.reverse(s))
    return F.when(at > 0, F.length(s) - at - F.length(part) + 2).otherwise(0).cast("long")


def _json_array_contains(json: Column, value: Column) -> Column:
    items = F.from_json(json, "array<string>")
    return F.array_contains(items, value.cast("string"))


#: What a name stands for; each takes the arguments as columns.
SCALARS: dict[str, Callable[..., Column]] = {
    # numbers
    "random": lambda *a: F.rand(*a),
    "rand": lambda *a: F.rand(*a),
    "truncate": _truncate,
    "ceiling": lambda a: F.ceil(a),
    "power": lambda a, b: F.pow(a, b),
    "log": lambda *a: F.log(*a) if len(a) == 1 else F.ln(a[1]) / F.ln(a[0]),
    "pi": lambda: F.pi(),
    "e": lambda: F.e(),
    "infinity": lambda: F.lit(float("inf")),
    "nan": lambda: F.lit(float("nan")),
    "is_nan": lambda a: F.isnan(a),
    "is_infinite": lambda a: F.abs(a) == float("inf"),
    "is_finite": lambda a: ~F.isnan(a) & (F.abs(a) != float("inf")),
    "to_base": _to_base,
    "from_base": _from_base,
    "width_bucket": _width_bucket,
    "cosine_similarity": lambda a, b: _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b)),
    # bits
    "bitwise_and": lambda a, b: a.bitwiseAND(b),
    "bitwise_or": lambda a, b: a.bitwiseOR(b),
    "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "bitwise_not": lambda a: F.bitwise_not(a),
    "bitwise_left_shift": _sql("shiftleft"),
    "bitwise_right_shift": _sql("shiftrightunsigned"),
    "bitwise_logical_shift_right": lambda a, n, bits: _sql("shiftrightunsigned")(a.bitwiseAND(_sql("shiftrightunsigned")(F.lit(-1).cast("long"), 64 - bits)), n),
    "bitwise_arithmetic_shift_right": _sql("shiftright"),
    # strings
    "strpos": _nth_position,
    "strrpos": _last_position,
    "codepoint": lambda s: F.ascii(s),
    "chr": lambda n: F.char(n),
    "substr": _sql("substring"),
    "replace": lambda s, a, b=None: F.replace(s, a, b if b is not None else F.lit("")),
    "split": _split,
    "split_to_map": _split_to_map,
    "starts_with": lambda a, b: F.startswith(a, b),
    "ends_with": lambda a, b: F.endswith(a, b),
    "levenshtein_distance": lambda a, b: F.levenshtein(a, b).cast("long"),
    "hamming_distance": _hamming,
    "to_utf8": lambda a: F.encode(a, "UTF-8"),
    "from_utf8": lambda a: F.decode(a, "UTF-8"),
    "concat_ws": lambda s, *a: F.call_function("concat_ws", s, *a),
    # patterns
    "regexp_like": lambda a, b: F.regexp_like(a, b),
    "regexp_extract": lambda s, p, g=None: F.when(F.regexp_like(s, p), F.call_function("regexp_extract", s, p, g if g is not None else F.lit(0))),
    "regexp_extract_all": lambda s, p, g=None: F.call_function("regexp_extract_all", s, p, g if g is not None else F.lit(0)),
    "regexp_replace": lambda s, p, r=None: F.call_function("regexp_replace", s, p, r if r is not None else F.lit("")),
    "regexp_split": lambda s, p: F.call_function("split", s, p),
    "regexp_position": lambda s, p: F.when(F.regexp_like(s, p), F.length(F.get(F.call_function("split", s, p, F.lit(2)), F.lit(0))) + 1).otherwise(-1).cast("long"),
    # binary, hashes, addresses
    "to_hex": lambda a: F.hex(_binary(a)),
    "from_hex": lambda a: F.unhex(a),
    "to_base64": lambda a: _base64(a),
    "from_base64": lambda a: F.unbase64(a),
    "to_base64url": lambda a: F.translate(_base64(a), "+/", "-_"),
    "from_base64url": lambda a: F.unbase64(F.translate(a, "-_", "+/")),
    "md5": lambda a: F.unhex(F.md5(_binary(a))),
    "sha1": lambda a: F.unhex(F.sha1(_binary(a))),
    "sha256": lambda a: F.unhex(F.sha2(_binary(a), 256)),
    "sha512": lambda a: F.unhex(F.sha2(_binary(a), 512)),
    "crc32": lambda a: F.crc32(_binary(a)),
    "url_extract_protocol": _url("PROTOCOL"),
    "url_extract_host": _url("HOST"),
    "url_extract_path": lambda u: F.coalesce(_url("PATH")(u), F.when(u.isNotNull(), "")),
    "url_extract_query": _url("QUERY"),
    "url_extract_fragment": _url("REF"),
    "url_extract_parameter": _url("QUERY"),
    "url_extract_port": lambda u: F.nullif(F.regexp_extract(F.call_function("parse_url", u, F.lit("AUTHORITY")), r":(\d+)$", 1), F.lit("")).cast("long"),
    "url_encode": _sql("url_encode"),
    "url_decode": _sql("url_decode"),
    # dates and times
    "date_diff": _date_diff,
    "date_add": _date_add,
    "date_format": lambda t, f: F.date_format(t, _pattern(f)),
    "format_datetime": lambda t, f: F.date_format(t, text_of(f)),
    "date_parse": lambda s, f: F.to_timestamp(s, _pattern(f)),
    "parse_datetime": lambda s, f: F.to_timestamp(s, text_of(f)),
    "from_unixtime": lambda n, *f: F.call_function("from_unixtime", n, *f) if f else F.timestamp_micros(F.round(n.cast("double") * 10**6).cast("long")),
    "to_unixtime": lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(10.0**6),
    "from_iso8601_date": lambda s: s.cast("date"),
    "from_iso8601_timestamp": lambda s: s.cast("timestamp"),
    "to_iso8601": lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    "day_of_week": lambda a: F.weekday(a) + 1,
    "dow": lambda a: F.weekday(a) + 1,
    "day_of_month": lambda a: F.day(a),
    "day_of_year": lambda a: F.dayofyear(a),
    "doy": lambda a: F.dayofyear(a),
    "week": lambda a: F.weekofyear(a),
    "week_of_year": lambda a: F.weekofyear(a),
    "year_of_week": lambda a: F.extract(F.lit("YEAROFWEEK"), a),
    "yow": lambda a: F.extract(F.lit("YEAROFWEEK"), a),
    "millisecond": lambda a: F.pmod(F.floor(F.unix_micros(a.cast("timestamp")) / 1000), F.lit(1000)).cast("int"),
    "last_day_of_month": lambda a: F.last_day(a),
    # arrays
    "cardinality": lambda a: F.when(a.isNotNull(), F.size(a)),
    "contains": lambda a, b: F.array_contains(a, b),
    "transform": lambda a, f: F.transform(a, f),
    "filter": lambda a, f: F.filter(a, f),
    "exists": lambda a, f: F.exists(a, f),
    "forall": lambda a, f: F.forall(a, f),
    "aggregate": lambda a, init, step, *end: F.aggregate(a, init, step, *end),
    "reduce": lambda a, init, step, *end: F.aggregate(a, init, step, *end),
    "zip_with": lambda a, b, f: F.zip_with(a, b, f),
    "any_match": lambda a, f: F.exists(a, f),
    "all_match": lambda a, f: F.forall(a, f),
    "none_match": lambda a, f: ~F.exists(a, f),
    "find_first": lambda a, f: F.get(F.filter(a, f), F.lit(0)),
    "array_average": lambda a: _sum(F.array_compact(a).cast("array<double>"), F.lit(0.0)) / F.nullif(F.size(F.array_compact(a)), F.lit(0)),
    "array_sum": lambda a: _sum(a, F.lit(0).cast("long")),
    "array_sort_desc": lambda a: F.sort_array(a, asc=False),
    "array_frequency": array_frequency,
    "array_duplicates": array_duplicates,
    "array_has_duplicates": lambda a: F.size(array_duplicates(a)) > 0,
    "array_remove": lambda a, x: F.array_remove(a, x),
    "array_join": lambda a, d, *null: F.call_function("array_join", a, d, *null),
    "repeat": lambda x, n: F.call_function("array_repeat", x, n),
    "trim_array": lambda a, n: F.slice(a, F.lit(1), F.size(a) - n),
    "ngrams": lambda a, n: F.when(F.size(a) <= n, F.array(a)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.slice(a, i, n))),
    "zip": _zip,
    # maps
    "map": lambda *kv: F.map_from_arrays(*kv) if kv else F.create_map(),
    "map_filter": lambda m, f: F.map_filter(m, f),
    "transform_keys": lambda m, f: F.transform_keys(m, f),
    "transform_values": lambda m, f: F.transform_values(m, f),
    "map_zip_with": lambda a, b, f: F.map_zip_with(a, b, f),
    "map_subset": lambda m, keys: F.map_filter(m, lambda k, v: F.array_contains(keys, k)),
    "map_top_n": lambda m, n: _top_entries(m, n),
    "multimap_from_entries": lambda e: multimap(F.filter(e, lambda x: x.isNotNull())),
    # json
    "json_extract": _path,
    "json_extract_scalar": _path,
    "json_parse": lambda s: F.parse_json(s),
    "json_format": lambda v: F.to_json(v),
    "json_size": lambda s, p: F.coalesce(F.json_array_length(_path(s, p)), F.size(F.json_object_keys(_path(s, p))), F.when(_path(s, p).isNotNull(), 0)).cast("long"),
    "json_array_get": lambda s, i: F.get(F.from_json(s, "array<string>"), F.when(i < 0, F.size(F.from_json(s, "array<string>")) + i).otherwise(i)),
    "json_array_contains": _json_array_contains,
    # aggregates that are Spark's under another name
    "array_agg": lambda a: F.collect_list(a),
    "arbitrary": lambda a: F.any_value(a),
}


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _top_entries(m: Column, n: Column) -> Column:
    entries = F.sort_array(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))), asc=False)
    return F.map_from_entries(F.transform(F.slice(entries, F.lit(1), n), lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))


def multimap(entries: Column) -> Column:
    """A map of each key to its values, from structs whose first field is the key and second the value."""
    pairs = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1)["k"] != F.get(s, i)["k"]))
    of_key = lambda s, p: F.map_from_arrays(F.transform(p, lambda i: F.get(s, i)["k"]), F.transform(p, lambda i, j: F.transform(F.slice(s, i + 1, length_of_run(s, p, j)), lambda x: x["v"])))
    return F.get(F.transform(F.array(pairs), lambda s: F.when(F.size(s) > 0, F.get(F.transform(F.array(starts(s)), lambda p: of_key(s, p)), F.lit(0)))), F.lit(0))
