"""Files that keep arriving: each micro-batch scores what the cache table lacks and appends it."""

from .incremental import score_stream  # noqa: F401
