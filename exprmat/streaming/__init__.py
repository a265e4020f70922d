"""Fitted matrix transforms applied to Structured Streaming DataFrames."""

from .apply import log_normalize_stream, scale_stream  # noqa: F401
