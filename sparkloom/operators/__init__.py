"""Relational operators over DataFrames."""

from .aggregates import Agg
from .domains import Domain, Range, domain_to_column, tuple_domain_to_column
from .ordering import Order, sort_columns
from .relation import Relation

__all__ = ["Agg", "Domain", "Order", "Range", "Relation", "domain_to_column", "sort_columns", "tuple_domain_to_column"]
