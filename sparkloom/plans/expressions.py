"""Columns from declared expressions: SQL text, or trees of variables, constants,
calls, special forms and lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotSupported
from ..functions import attempt, call, normalise
from ..types import literal, parse_type


def _fold(items: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    out = items[0]
    for x in items[1:]:
        out = join(out, x)
    return out


class _Builder:
    def __init__(self, df: DataFrame, bound: dict[str, Column] | None = None, safe: bool = False):
        self.df, self.bound, self.safe = df, bound or {}, safe

    def build(self, node: dict | str) -> Column:
        if isinstance(node, str):
            return F.expr(node)
        kind = node["@type"].rpartition(".")[2]
        make = getattr(self, f"_{kind[:1].lower()}{kind[1:]}".replace("Expression", "").replace("Reference", ""), None)
        if make is None:
            raise NotSupported(f"unknown expression {node['@type']!r}")
        return make(node)

    def _variable(self, n):
        return self.bound[n["name"]] if n["name"] in self.bound else F.col(f"`{n['name']}`")

    def _constant(self, n):
        return literal(n.get("value"), n["type"])

    def _call(self, n):
        name = n["name"] if "name" in n else n["functionHandle"]["signature"]["name"]
        args = [self.lambda_(a) if self._is_lambda(a) else self.build(a) for a in n["arguments"]]
        plain = normalise(name)
        if plain == "try":
            return _Builder(self.df, self.bound, True).build(n["arguments"][0])
        if plain == "cast":
            return (args[0].try_cast if self.safe else args[0].cast)(parse_type(n["returnType"]))
        if self.bound and plain == "divide":  # a lambda's variables have no type to look up yet
            return args[0] / args[1]
        return attempt(self.df, name, *args) if self.safe and plain in ("add", "subtract", "multiply", "divide", "modulus", "subscript") else call(self.df, name, *args)

    @staticmethod
    def _is_lambda(n) -> bool:
        return isinstance(n, dict) and n["@type"].rpartition(".")[2].lower().startswith("lambda")

    def lambda_(self, n) -> Callable[..., Column]:
        names = n["arguments"]
        make = lambda *columns: _Builder(self.df, {**self.bound, **dict(zip(names, columns))}, self.safe).build(n["body"])
        return {1: lambda a: make(a), 2: lambda a, b: make(a, b), 3: lambda a, b, c: make(a, b, c)}[len(names)]

    def _special(self, n):
        form, raw = n["form"].upper(), n["arguments"]
        if form == "DEREFERENCE":
            return self.build(raw[0])[raw[1] if isinstance(raw[1], str) else raw[1]["value"]]
        if form == "SWITCH":
            return self._switch(raw)
        args = [self.build(a) for a in raw]
        forms = {
            "AND": lambda: _fold(args, lambda a, b: a & b),
            "OR": lambda: _fold(args, lambda a, b: a | b),
            "NOT": lambda: ~args[0],
            "IF": lambda: F.when(args[0], args[1]).otherwise(args[2]) if len(args) > 2 else F.when(args[0], args[1]),
            "COALESCE": lambda: F.coalesce(*args),
            "IN": lambda: _fold([args[0] == a for a in args[1:]], lambda a, b: a | b),
            "IS_NULL": lambda: args[0].isNull(),
            "NULL_IF": lambda: F.nullif(args[0], args[1]),
            "BETWEEN": lambda: args[0].between(args[1], args[2]),
            "ROW_CONSTRUCTOR": lambda: F.struct(*[a.alias(f"field{i}") for i, a in enumerate(args)]),
        }
        if form not in forms:
            raise NotSupported(f"unknown special form {form!r}")
        return forms[form]()

    def _switch(self, raw):
        """A value, then WHEN forms of a value (or a condition, for a value TRUE) and a result, then the rest."""
        out, value = F, None if raw[0] is True else self.build(raw[0])
        rest = None
        for a in raw[1:]:
            if isinstance(a, dict) and a.get("form", "").upper() == "WHEN":
                when, then = (self.build(x) for x in a["arguments"])
                out = out.when(when if value is None else value == when, then)
            else:
                rest = self.build(a)
        if out is F:
            return rest
        return out if rest is None else out.otherwise(rest)


def to_column(df: DataFrame, node: dict | str) -> Column:
    """The column of a declared expression over ``df``."""
    return _Builder(df).build(node)
