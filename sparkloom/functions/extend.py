"""Functions of one's own by name, and what is known of a name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .collected import COLLECTED
from .dialect import SCALARS
from .library import AGGREGATE, SCALAR, WINDOW
from .registry import AGGREGATES, OPERATORS, normalise

_RANDOM = {"random", "rand", "shuffle"}
_OWN: dict[str, Signature] = {}


@dataclass(frozen=True)
class Signature:
    """A resolved function. ``kind`` is SCALAR, AGGREGATE, WINDOW or TABLE."""

    name: str
    kind: str
    deterministic: bool = True
    null_on_null: bool = True
    returns: str | None = None


def resolve(name: str) -> Signature:
    """What a name, qualified or not, stands for; KeyError for an unknown one."""
    name = normalise(name)
    if name in _OWN:
        return _OWN[name]
    if name in WINDOW.split():
        return Signature(name, "WINDOW")
    if name in COLLECTED or name in AGGREGATES or name in AGGREGATE.split():
        return Signature(name, "AGGREGATE", null_on_null=name not in ("count", "checksum"))
    if name in OPERATORS or name in SCALARS or any(name in names.split() for names in SCALAR.values()):
        return Signature(name, "SCALAR", name not in _RANDOM, name not in ("is_distinct_from", "distinct_from", "coalesce", "is_null", "if", "switch", "and", "or", "concat_ws", "equal_null"))
    raise KeyError(f"no function {name!r}")


def register_scalar(name: str, f: Callable, returns: str, deterministic: bool = True) -> None:
    """A function of pandas series (sent in Arrow batches) under a name."""
    udf = F.pandas_udf(f, returns)
    SCALARS[normalise(name)] = udf if deterministic else udf.asNondeterministic()
    _OWN[normalise(name)] = Signature(normalise(name), "SCALAR", deterministic, False, returns)


def register_aggregate(name: str, f: Callable, returns: str) -> None:
    """A function of pandas series, annotated to give one value, under a name."""
    udf = F.pandas_udf(f, returns)
    COLLECTED[normalise(name)] = lambda where, *a: udf(*[x if where is None else F.when(where, x) for x in a])
    _OWN[normalise(name)] = Signature(normalise(name), "AGGREGATE", True, False, returns)


def register_table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A class whose ``eval`` yields rows, for use in FROM under a name."""
    spark.udtf.register(normalise(name), F.udtf(handler, returnType=returns))
    _OWN[normalise(name)] = Signature(normalise(name), "TABLE", True, False, returns)


def forget(name: str) -> None:
    """Takes a registered name back."""
    if normalise(name) in _OWN:
        del _OWN[normalise(name)]
        SCALARS.pop(normalise(name), None)
        COLLECTED.pop(normalise(name), None)
