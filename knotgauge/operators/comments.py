"""Comment removal as expressions (i07)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_html_comments(html: Column, keep_lines: bool = True) -> Column:
    """Text without <!-- --> comments. With keep_lines, a comment's line ends stay, so that line numbers hold."""
    if not keep_lines:
        return F.regexp_replace(html, "(?s)<!--.*?-->", "")
    pieces = F.regexp_extract_all(html, F.lit("(?s)<!--.*?-->|(?:(?!<!--).)+|<!--"), F.lit(0))
    is_comment = lambda x: x.startswith("<!--") & x.endswith("-->")
    return F.array_join(F.transform(pieces, lambda x: F.when(is_comment(x), F.regexp_replace(x, "[^\n]", "")).otherwise(x)), "")
