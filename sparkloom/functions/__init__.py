"""Functions by name: operators, scalars and aggregates."""

from . import library
from .collected import COLLECTED
from .dialect import SCALARS
from .extend import Signature, forget, register_aggregate, register_scalar, register_table, resolve
from .registry import AGGREGATES, OPERATORS, attempt, call, normalise

__all__ = ["AGGREGATES", "COLLECTED", "OPERATORS", "SCALARS", "Signature", "attempt", "call", "forget", "library", "normalise", "register_aggregate", "register_scalar", "register_table", "resolve"]
