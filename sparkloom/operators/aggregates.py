"""Aggregate calls: DISTINCT, FILTER, mask and ORDER BY."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NotSupported
from ..functions.collected import COLLECTED
from ..functions.registry import AGGREGATES, normalise
from .ordering import Keys, comparator


#: Aggregates whose state is a few numbers or one value, and scalars around them.
#: Others (sketches, percentiles, collections, one's own) count as wide.
_NARROW = set("count count_if sum avg mean min max min_by max_by any_value first last first_value last_value bool_and bool_or every some any bit_and bit_or bit_xor stddev stddev_samp stddev_pop variance var_samp var_pop corr covar_samp covar_pop skewness kurtosis round abs sqrt cast coalesce nullif struct named_struct where filter distinct and or not in case when then else".split())


@dataclass
class Agg:
    """``name(args)`` with its modifiers. Arguments, filter and mask are SQL text.

    A mask is a boolean column made earlier (say, the first row of each value);
    it counts like a filter, and both may be given. With ``order_by`` the values
    of the first argument are collected in that order.
    """

    name: str
    args: list[str] = field(default_factory=list)
    distinct: bool = False
    filter: str | None = None
    mask: str | None = None
    order_by: Keys | None = None

    def column(self) -> Column:
        name = normalise(self.name)
        conditions = [f"({c})" for c in (self.filter, self.mask) if c]
        where = f" FILTER (WHERE {' AND '.join(conditions)})" if conditions else ""
        if self.order_by:
            return self._ordered(name, where)
        args = ", ".join(self.args) or ("*" if name == "count" else "")
        if name in COLLECTED and not (name in ("min", "max") and len(self.args) == 1):
            if self.distinct:
                raise NotSupported(f"{name} of distinct values")
            return COLLECTED[name](F.expr(" AND ".join(conditions)) if conditions else None, *map(F.expr, self.args))
        return F.expr(f"{AGGREGATES.get(name, name)}({'DISTINCT ' * self.distinct}{args}){where}")

    def _ordered(self, name: str, where: str) -> Column:
        if self.distinct:
            raise ValueError("DISTINCT with ORDER BY isn't supported in one aggregate")
        keys = [(f"k{i}", order) for i, (_, order) in enumerate(self.order_by)]
        parts = ", ".join([f"'k{i}', {name_}" for i, (name_, _) in enumerate(self.order_by)] + [f"'v', {self.args[0]}"])
        items = f"transform(array_sort(collect_list(named_struct({parts})){where}, (l, r) -> {comparator(keys)}), x -> x.v)"
        if name in ("array_agg", "collect_list"):
            return F.expr(items)
        if name in ("listagg", "string_agg"):
            return F.expr(f"array_join({items}, {self.args[1] if len(self.args) > 1 else repr('')})")
        if name in ("first", "arbitrary", "any_value"):
            return F.expr(f"get({items}, 0)")
        raise ValueError(f"{name} takes no ORDER BY")


def aggregate_columns(aggs: dict[str, Agg | str]) -> list[Column]:
    return [(a.column() if isinstance(a, Agg) else F.expr(a)).alias(out) for out, a in aggs.items()]


def apart(aggs: dict[str, Agg | str]) -> tuple[dict[str, Agg | str], dict[str, Agg | str]]:
    """The DISTINCT aggregates and the others, where they should not share a plan.

    In one plan the others' states are kept for every distinct value, which for
    wide ones is kilobytes a value; without any the first part is empty.
    """
    texts = {out: (a if isinstance(a, str) else f"{AGGREGATES.get(normalise(a.name), normalise(a.name))}({'distinct ' * a.distinct}{', '.join(a.args)})").lower() for out, a in aggs.items()}
    distinct = {out for out, t in texts.items() if re.search(r"\(\s*distinct\b", t)}
    wide = any(isinstance(aggs[out], Agg) and aggs[out].order_by or set(re.findall(r"(\w+)\s*\(", t)) - _NARROW for out, t in texts.items() if out not in distinct)
    if not distinct or not wide:
        return {}, aggs
    return {out: a for out, a in aggs.items() if out in distinct}, {out: a for out, a in aggs.items() if out not in distinct}
