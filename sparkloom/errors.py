"""Error classes of the engine and the mapping from Spark's conditions."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException, PySparkException

USER, INTERNAL, RESOURCES, EXTERNAL = "USER_ERROR", "INTERNAL_ERROR", "INSUFFICIENT_RESOURCES", "EXTERNAL"


class NotSupported(Exception):
    """A declared feature that cannot be run."""


_CODES = (
    ("UNSUPPORTED", USER, "NOT_SUPPORTED"),
    ("NOT_SUPPORTED", USER, "NOT_SUPPORTED"),
    ("DIVIDE_BY_ZERO", USER, "GENERIC_USER_ERROR"),
    ("ARITHMETIC_OVERFLOW", USER, "GENERIC_USER_ERROR"),
    ("CAST_", USER, "GENERIC_USER_ERROR"),
    ("INVALID_", USER, "GENERIC_USER_ERROR"),
    ("SCALAR_SUBQUERY_TOO_MANY_ROWS", USER, "GENERIC_USER_ERROR"),
    ("USER_RAISED_EXCEPTION", USER, "GENERIC_USER_ERROR"),
    ("UNABLE_TO_ACQUIRE_MEMORY", RESOURCES, "GENERIC_INSUFFICIENT_RESOURCES"),
    ("PATH_NOT_FOUND", EXTERNAL, "GENERIC_EXTERNAL"),
    ("FAILED_READ_FILE", EXTERNAL, "GENERIC_EXTERNAL"),
)


def classify(error: BaseException) -> tuple[str, str]:
    """(class, code) of an exception."""
    if isinstance(error, NotSupported):
        return USER, "NOT_SUPPORTED"
    if isinstance(error, MemoryError) or "OutOfMemoryError" in str(error):
        return RESOURCES, "GENERIC_INSUFFICIENT_RESOURCES"
    if isinstance(error, PySparkException):
        condition = error.getCondition() or ""
        for start, kind, code in _CODES:
            if condition.startswith(start) or f".{start}" in condition:
                return kind, code
        if isinstance(error, (AnalysisException, ParseException)):
            return USER, "GENERIC_USER_ERROR"
    if isinstance(error, (ValueError, TypeError, KeyError)):
        return USER, "GENERIC_USER_ERROR"
    return INTERNAL, "GENERIC_INTERNAL_ERROR"
