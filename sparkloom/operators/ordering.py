"""Sort keys with explicit direction and null placement."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Order(Enum):
    ASC_NULLS_FIRST = "ASC_NULLS_FIRST"
    ASC_NULLS_LAST = "ASC_NULLS_LAST"
    DESC_NULLS_FIRST = "DESC_NULLS_FIRST"
    DESC_NULLS_LAST = "DESC_NULLS_LAST"

    @classmethod
    def of(cls, text: str | Order) -> Order:
        if isinstance(text, Order):
            return text
        try:
            return cls(text.upper().replace(" ", "_"))
        except ValueError:
            raise ValueError(f"unknown sort order {text!r}; one of {[o.value for o in cls]}") from None

    @property
    def descending(self) -> bool:
        return self.value.startswith("DESC")

    @property
    def nulls_first(self) -> bool:
        return self.value.endswith("FIRST")


Keys = list[tuple[str, "str | Order"]]


def sort_columns(keys: Keys) -> list[Column]:
    """Sort keys are names of columns, each with one of the four orders."""
    return [getattr(F.col(name), Order.of(order).value.lower())() for name, order in keys]


def comparator(keys: Keys, left: str = "l", right: str = "r") -> str:
    """SQL of a three-way comparison of two structs by the keys."""
    out = "0"
    for name, order in reversed(keys):
        o = Order.of(order)
        a, b = f"{left}.{name}", f"{right}.{name}"
        null = "-1" if o.nulls_first else "1"
        other = "1" if o.nulls_first else "-1"
        less, more = ("1", "-1") if o.descending else ("-1", "1")
        out = f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN {out} WHEN {a} IS NULL THEN {null} WHEN {b} IS NULL THEN {other} WHEN {a} < {b} THEN {less} WHEN {a} > {b} THEN {more} ELSE {out} END"
    return out
