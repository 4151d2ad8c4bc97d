"""Source text to cleaned text, scopes and functions (u02): approximate scanners, no parsers."""

from .scanners import LANGUAGES, Prepared, prepare, prepare_files  # noqa: F401
