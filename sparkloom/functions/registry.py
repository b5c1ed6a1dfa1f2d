"""Name resolution for functions.

A name may carry a qualifier (``catalog.schema.name``) and the operator mark
``$operator$``; both are taken off and the rest is lower-cased. What Spark has
under another name, or with other semantics, is mapped here and in ``dialect``
and ``collected``; every other name is Spark's own built-in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collected import COLLECTED
from .dialect import SCALARS

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def normalise(name: str) -> str:
    name = name.rpartition(".")[2] if "$operator$" not in name else name.rpartition("$operator$")[2]
    return name.lower()


def _divide(kinds, a: Column, b: Column) -> Column:
    """Whole numbers divide to a whole number, cut towards zero; all else as Spark does."""
    if all(isinstance(k, _WHOLE) for k in kinds):
        wide = max(kinds, key=lambda k: _WHOLE.index(type(k)))
        return F.call_function("div", a, b).cast(wide)
    return a / b


def _subscript(kinds, base: Column, index: Column) -> Column:
    """Arrays count from 1 (out of range raises); a missing map key is NULL."""
    return F.call_function("element_at", base, index)


#: Operators take the types of their arguments, then the arguments.
OPERATORS: dict[str, Callable[..., Column]] = {
    "add": lambda k, a, b: a + b,
    "plus": lambda k, a, b: a + b,
    "subtract": lambda k, a, b: a - b,
    "minus": lambda k, a, b: a - b,
    "multiply": lambda k, a, b: a * b,
    "divide": _divide,
    "modulus": lambda k, a, b: a % b,
    "mod": lambda k, a, b: a % b,
    "negation": lambda k, a: -a,
    "negate": lambda k, a: -a,
    "equal": lambda k, a, b: a == b,
    "eq": lambda k, a, b: a == b,
    "not_equal": lambda k, a, b: a != b,
    "neq": lambda k, a, b: a != b,
    "greater_than": lambda k, a, b: a > b,
    "gt": lambda k, a, b: a > b,
    "greater_than_or_equal": lambda k, a, b: a >= b,
    "gte": lambda k, a, b: a >= b,
    "less_than": lambda k, a, b: a < b,
    "lt": lambda k, a, b: a < b,
    "less_than_or_equal": lambda k, a, b: a <= b,
    "lte": lambda k, a, b: a <= b,
    "between": lambda k, a, b, c: a.between(b, c),
    "is_distinct_from": lambda k, a, b: ~a.eqNullSafe(b),
    "distinct_from": lambda k, a, b: ~a.eqNullSafe(b),
    "subscript": _subscript,
    "and": lambda k, *a: _fold(a, lambda x, y: x & y),
    "or": lambda k, *a: _fold(a, lambda x, y: x | y),
    "not": lambda k, a: ~a,
    "if": lambda k, c, a, *b: F.when(c, a).otherwise(b[0]) if b else F.when(c, a),
    "switch": lambda k, *a: _case(a),
    "coalesce": lambda k, *a: F.coalesce(*a),
    "in": lambda k, a, *b: a.isin(*b),
    "is_null": lambda k, a: a.isNull(),
    "nullif": lambda k, a, b: F.nullif(a, b),
}


def _fold(items, f):
    out = items[0]
    for x in items[1:]:
        out = f(out, x)
    return out


def _case(items) -> Column:
    """condition, value, condition, value, ..., otherwise."""
    pairs, rest = items[: len(items) // 2 * 2], items[len(items) // 2 * 2 :]
    out = F.when(pairs[0], pairs[1])
    for c, v in zip(pairs[2::2], pairs[3::2]):
        out = out.when(c, v)
    return out.otherwise(rest[0]) if rest else out


#: Aggregates whose name differs from Spark's.
AGGREGATES: dict[str, str] = {
    "arbitrary": "any_value",
    "array_agg": "collect_list",
    "set_agg": "collect_set",
    "approx_distinct": "approx_count_distinct",
    "bitwise_and_agg": "bit_and",
    "bitwise_or_agg": "bit_or",
    "bitwise_xor_agg": "bit_xor",
    "approx_set": "hll_sketch_agg",
    "merge": "hll_union_agg",
    "every": "bool_and",
}


#: Operators that give NULL where the plain one raises.
_SAFE = {"add": "try_add", "plus": "try_add", "subtract": "try_subtract", "minus": "try_subtract", "multiply": "try_multiply", "modulus": "try_mod", "mod": "try_mod", "subscript": "try_element_at"}


def attempt(df: DataFrame, name: str, *args: Column | str) -> Column:
    """``try`` around one function or operator: NULL where it would raise."""
    name = normalise(name)
    cols = [F.expr(a) if isinstance(a, str) else a for a in args]
    if name == "divide":
        return F.when(cols[1] != 0, call(df, name, cols[0], F.nullif(cols[1], F.lit(0))))
    return F.call_function(_SAFE.get(name, f"try_{name}"), *cols)


def call(df: DataFrame, name: str, *args: Column | str) -> Column:
    """A function or operator by name over columns (or SQL text) of ``df``.

    ``try`` takes the name of another one and its arguments.
    """
    name = normalise(name)
    if name == "try":
        return attempt(df, *args)
    cols = [F.expr(a) if isinstance(a, str) else a for a in args]
    if name in OPERATORS:
        kinds = [f.dataType for f in df.select(*[c.alias(f"_{i}") for i, c in enumerate(cols)]).schema.fields] if name == "divide" else []
        return OPERATORS[name](kinds, *cols)
    if name in SCALARS:
        return SCALARS[name](*cols)
    if name in COLLECTED:
        return COLLECTED[name](None, *cols)
    return F.call_function(AGGREGATES.get(name, name), *cols)
