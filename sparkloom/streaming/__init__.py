"""Streaming (an extension): windows, late data and state on unbounded input."""

from .windows import deduplicate, keep_latest, run_available, session_counts, windowed

__all__ = ["deduplicate", "keep_latest", "run_available", "session_counts", "windowed"]
