"""Aggregates that Spark has no single function for, built from those it has.

Each takes its argument columns and a condition (or None) and gives a column.
What they collect of a group is their result, in the size of the group.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import _runs, array_frequency, length_of_run, multimap


def _if(where: Column | None, c: Column) -> Column:
    return c if where is None else F.when(where, c)


def _entries(where: Column | None, k: Column, v: Column) -> Column:
    keep = k.isNotNull() if where is None else k.isNotNull() & where
    return F.collect_list(F.when(keep, F.struct(k.alias("key"), v.alias("value"))))


def _union(where: Column | None, m: Column) -> Column:
    return F.flatten(F.collect_list(_if(where, F.map_entries(m))))


def _first_values(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.get(v, F.lit(0)))


def _total(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.aggregate(F.array_compact(v).cast("array<double>"), F.lit(0.0), lambda s, x: s + x))


def _entropy(where: Column | None, c: Column) -> Column:
    c = _if(where, c.cast("double"))
    total = F.sum(c)
    return F.coalesce(F.when(total > 0, F.log2(total) - F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / total), F.lit(0.0))


def _checksum(where: Column | None, x: Column) -> Column:
    """Eight bytes that do not depend on the order of the rows."""
    total = F.sum(_if(where, F.xxhash64(x)).cast("decimal(38,0)"))
    return F.unhex(F.lpad(F.hex(F.pmod(total, F.lit(Decimal(2**63))).cast("long")), 16, "0"))


def _numeric_histogram(where: Column | None, buckets: Column, x: Column) -> Column:
    bars = F.call_function("histogram_numeric", _if(where, x.cast("double")), buckets)
    return F.map_from_entries(F.transform(bars, lambda b: F.struct(b["x"].alias("key"), b["y"].alias("value"))))


def _most(largest: bool) -> Callable[..., Column]:
    def build(where: Column | None, x: Column, n: Column | None = None) -> Column:
        if n is None:
            return (F.max if largest else F.min)(_if(where, x))
        return F.slice(F.sort_array(F.collect_list(_if(where, x)), asc=not largest), F.lit(1), n)

    return build


COLLECTED: dict[str, Callable[..., Column]] = {
    "map_agg": lambda where, k, v: _first_values(multimap(_entries(where, k, v))),
    "multimap_agg": lambda where, k, v: multimap(_entries(where, k, v)),
    "map_union": lambda where, m: _first_values(multimap(_union(where, m))),
    "map_union_sum": lambda where, m: _total(multimap(_union(where, m))),
    "set_union": lambda where, a: F.array_distinct(F.flatten(F.collect_list(_if(where, a)))),
    "histogram": lambda where, x: array_frequency(F.collect_list(_if(where, x))),
    "numeric_histogram": _numeric_histogram,
    "entropy": _entropy,
    "checksum": _checksum,
    "geometric_mean": lambda where, x: F.exp(F.avg(F.ln(_if(where, x)))),
    "min": _most(False),
    "max": _most(True),
}
