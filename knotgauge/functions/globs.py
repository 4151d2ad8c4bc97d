"""Path globs as regular expressions that Java and RE2 read alike (p06): no look-around, anchored, segment-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PATTERNS, MOST_LENGTH = 512, 256


class BadGlob(ValueError):
    """An empty, absolute, oversized or malformed pattern."""


def _segment(text: str) -> str:
    """One path segment: runs of *, ?, [sets], \\escapes and literals."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "*":
            while i < len(text) and text[i] == "*":
                i += 1
            out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(text):
                raise BadGlob("it ends in a backslash")
            out.append(_literal(text[i]))
        elif c == "[":
            body, i = _set(text, i + 1)
            out.append(body)
            continue
        else:
            out.append(_literal(c))
        i += 1
    return "".join(out)


def _literal(c: str) -> str:
    return "\\" + c if c in r"\.^$|()[]{}*+?-/&~#" and c not in "/-&~#" else c


def _set(text: str, i: int) -> tuple[str, int]:
    negated = i < len(text) and text[i] in "!^"
    i += negated
    members, first = [], True
    while i < len(text) and (text[i] != "]" or first):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            c = text[i]
            members.append("\\" + c)
        elif c == "-" and not first and i + 1 < len(text) and text[i + 1] != "]":
            members.append("-")
        else:
            members.append("\\" + c if c in r"[]^&~\-" else c)
        first, i = False, i + 1
    if i >= len(text):
        raise BadGlob("a set is not closed")
    return ("[^/" if negated else "[") + "".join(members) + "]", i + 1


def glob_regex(pattern: str) -> str:
    """^...$ for a glob: ** stands for any segments where it is one itself; at the end it needs one at least."""
    if not pattern or len(pattern) > MOST_LENGTH or pattern.startswith("/") or "\0" in pattern:
        raise BadGlob(f"empty, absolute or over {MOST_LENGTH} characters")
    parts = pattern.split("/")
    if any(p in ("", ".", "..") for p in parts):
        raise BadGlob("an empty, . or .. segment")
    if parts[-1] == "**":
        parts[-1:] = ["*", "**"]
    out = []
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out.append("(?:/[^/]+)*" if last else "(?:[^/]+/)*")
            continue
        out.append("[^/]+" if part == "*" else _segment(part))
        if not last and not (k == len(parts) - 2 and parts[-1] == "**"):
            out.append("/")
    return "^" + "".join(out) + "$"


def any_glob_regex(patterns: list[str] | tuple[str, ...]) -> str:
    if len(patterns) > MOST_PATTERNS:
        raise BadGlob(f"over {MOST_PATTERNS} patterns")
    return "|".join(map(glob_regex, patterns)) or "^[^\\s\\S]$"


def matches_any(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    return path.rlike(any_glob_regex(patterns)) if patterns else F.lit(False)


def prunes_directory(directory: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """p05: some pattern ends in /** and its prefix matches the directory or an ancestor."""
    prefixes = [p[:-3] for p in patterns if p.endswith("/**") and p != "/**"]
    if not prefixes:
        return F.lit(False)
    inner = "|".join(glob_regex(p)[1:-1] for p in prefixes)
    return directory.rlike(f"^(?:{inner})(?:/.*)?$")
