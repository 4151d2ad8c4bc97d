"""Scalar expressions with the null rules of the reports: ratios, deltas, digests, escapes, formats."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0 or null."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def coverage(measured: Column, supported: Column) -> Column:
    """1.0 for nothing of nothing."""
    return F.coalesce(ratio(measured, supported), F.lit(1.0))


def delta(base: Column, head: Column) -> Column:
    """{base, head, absolute, percent}: null if a side is null, percent also if base is 0."""
    change = head - base
    return F.struct(base.alias("base"), head.alias("head"), change.alias("absolute"), (F.lit(100.0) * ratio(change, base)).alias("percent"))


def extension(path: Column) -> Column:
    """The last segment's final .ext in lower case, '' if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def is_digest(x: Column) -> Column:
    return F.coalesce(x.rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False))


def joined_key(*parts: Column) -> Column:
    """SHA-256 of parts joined by NUL, so that no two lists of parts are alike."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def blob_id(content: Column) -> Column:
    """SHA-1 of "blob <length>\\0" and the bytes: what version control calls a file's content."""
    body = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(body).cast("string"), F.lit("\0")).cast("binary"), body))


def set_digest(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(parts), "\0"), 256)


def decode_hex(x: Column) -> Column:
    """Bytes, or null for an odd length or a wrong digit."""
    return F.when(F.length(x) % 2 == 0, F.try_to_binary(x, F.lit("hex")))


def utc_time(x: Column) -> Column:
    """A strict YYYY-MM-DDTHH:MM:SSZ, else null."""
    return F.when(x.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def format_utc(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def truthy(x: Column, kind: str) -> Column:
    """False for null, false, 0, "", [] and {}."""
    if kind == "string":
        full = x != ""
    elif kind in ("array", "map"):
        full = F.size(x) > 0
    elif kind == "boolean":
        full = x
    else:
        full = x != 0
    return F.coalesce(full, F.lit(False))


def saturating_add(a: Column, b: Column, most: int) -> Column:
    return F.when(a > F.lit(most) - b, F.lit(most)).otherwise(a + b)


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


# -- for sinks on the driver


def escape_bytes(raw: bytes) -> str:
    """Printable text: what is not UTF-8, a control character or a backslash becomes \\xHH."""
    out = []
    for c in raw.decode("utf-8", "surrogateescape"):
        n = ord(c)
        if 0xDC80 <= n <= 0xDCFF:
            out.append(f"\\x{n - 0xDC00:02x}")
        elif n < 32 or n == 127 or c == "\\":
            out.append("".join(f"\\x{b:02x}" for b in c.encode()))
        else:
            out.append(c)
    return "".join(out)


def code_span(text: str) -> str:
    """Markdown code span that survives back quotes, bars and line ends in the text."""
    flat = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\x{ord(m.group()):02x}", text).replace("|", "\\|")
    longest = max((len(m) for m in re.findall("`+", flat)), default=0)
    fence = "`" * (longest + 1)
    pad = " " if flat[:1] == "`" or flat[-1:] == "`" else ""
    return f"{fence}{pad}{flat}{pad}{fence}"


def terminal_safe(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f-\x9f\u202a-\u202e\u2066-\u2069]", "\ufffd", text)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def short_number(x: float | None) -> str:
    return "n/a" if x is None else "%.6g" % x


def signed_number(x: float | None, digits: int = 1) -> str:
    return "n/a" if x is None else f"%+.{digits}f" % x


def signed_percent(x: float | None) -> str:
    return "n/a" if x is None else "%+.3g%%" % x
