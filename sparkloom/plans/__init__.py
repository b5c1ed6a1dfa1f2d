"""Declared plans."""

from .fragment import build

__all__ = ["build"]
