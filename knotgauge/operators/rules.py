"""Path rules: language, category, exclusion, and why a snapshot's file is not scored."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import MOST_PATTERNS, BadGlob, any_glob_regex, glob_regex, matches_any
from ..functions.scalars import extension, is_digest, joined_key

# The default rules and the built-in languages by extension.
EXCLUDE = (
    "**/.hg/**", "**/.svn/**", "**/target/**", "**/node_modules/**", "**/.gradle/**", "**/.venv/**", "**/__pycache__/**",
    "**/.tox/**", "**/.nox/**", "**/.mypy_cache/**", "**/.pytest_cache/**", "**/.ruff_cache/**", "**/vendor/**",
    "**/third_party/**", "**/build/**", "**/build-out/**", "**/.nuget/**", "**/dist/**", "**/deps/**", "**/_build/**",
    "**/cmake-build-debug/**", "**/cmake-build-release/**", "**/bazel-*/**", "out/**", "**/bin/**/*.cs", "**/obj/**/*.cs",
)
TESTS = ("**/test/**", "**/tests/**", "**/testdata/**", "**/fixtures/**", "**/fuzz/**", "**/fuzzers/**", "**/*_test.*", "**/test_*.*")
TOOLING = ("tools/**", "examples/**", "example/**", "scripts/**", "benchmarks/**")
EXTENSIONS = {
    "rust": (".rs",),
    "c": (".c", ".h"),
    "cpp": (".cc", ".cpp", ".cxx", ".c++", ".cu", ".hpp", ".hh", ".hxx", ".h++", ".cuh"),
    "java": (".java",),
    "python": (".py", ".pyw", ".pyi"),
    "go": (".go",),
    "javascript": (".js", ".mjs", ".cjs"),
    "csharp": (".cs", ".csx"),
}
MOST_BYTES = 64 << 10
KEYS = ("exclude", "tests", "tooling", "extensions", "paths")
ALWAYS_EXCLUDED = (".git", ".kg-cache")


class BadRules(ValueError):
    """A rules file that is too large, not JSON, or has an unknown key, a value of a wrong type, or a bad pattern."""


#: Fixed value: how a configured extension is written.
_extension = re.compile(r"\.[a-z0-9_+-]{1,16}").fullmatch


def _patterns(name: str, value: object) -> list[str]:
    """A list of globs that compile, else BadRules."""
    if not isinstance(value, list) or not all(isinstance(p, str) and p for p in value):
        raise BadRules(f"{name} is a list of globs")
    try:
        for p in value:
            glob_regex(p)
    except BadGlob as e:
        raise BadRules(f"{name}: {e}") from e
    return value


@dataclass(frozen=True)
class Rules:
    exclude: tuple[str, ...] = EXCLUDE
    tests: tuple[str, ...] = TESTS
    tooling: tuple[str, ...] = TOOLING
    extensions: dict[str, str] = field(default_factory=dict)
    paths: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, raw: bytes | None) -> Rules:
        """Rules from a file's bytes (None: the defaults) (s16, v10). What a file does not name keeps its default."""
        if raw is None:
            return cls()
        if len(raw) > MOST_BYTES:
            raise BadRules(f"over {MOST_BYTES} bytes")
        try:
            given = json.loads(raw)
        except ValueError as e:
            raise BadRules(str(e)) from e
        if not isinstance(given, dict) or set(given) - set(KEYS):
            raise BadRules("not an object, or unknown keys")
        lists = {k: tuple(_patterns(k, given[k])) for k in ("exclude", "tests", "tooling") if k in given}
        paths = given.get("paths", [])
        if not isinstance(paths, list) or not all(isinstance(p, dict) and set(p) == {"pattern", "language"} for p in paths):
            raise BadRules("paths is a list of objects of a pattern and a language")
        _patterns("paths", [p["pattern"] for p in paths])
        if sum(map(len, lists.values())) + len(paths) > MOST_PATTERNS:
            raise BadRules(f"over {MOST_PATTERNS} patterns")
        extensions = given.get("extensions", {})
        if not isinstance(extensions, dict) or not all(_extension(e) for e in extensions):
            raise BadRules("extensions is an object with keys like .ext, in lower case")
        if bad := [x for x in [*extensions.values(), *(p["language"] for p in paths)] if not isinstance(x, str) or x not in EXTENSIONS]:
            raise BadRules(f"unknown language {bad[0]!r}")
        return cls(**lists, extensions=dict(extensions), paths=tuple((p["pattern"], p["language"]) for p in paths))

    def language(self, path: Column) -> Column:
        """The first matching path rule, else a configured extension, else the built-in table (p01)."""
        ext = extension(path)
        tried = [F.when(path.rlike(glob_regex(p)), F.lit(x)) for p, x in self.paths]
        tried += [F.when(ext == e.lower(), F.lit(x)) for e, x in self.extensions.items()]
        tried += [F.when(ext.isin(*es), F.lit(x)) for x, es in EXTENSIONS.items()]
        return F.coalesce(*tried)

    def category(self, path: Column) -> Column:
        return F.when(matches_any(path, self.tests), "tests").when(matches_any(path, self.tooling), "tooling").otherwise("runtime")

    def excluded(self, path: Column) -> Column:
        return matches_any(path, self.exclude)


def always_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ALWAYS_EXCLUDED)))


def in_virtualenv(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Files below a directory that holds a marker file (p08); markers: (side, directory), '' for the root."""
    depth = F.size(F.split("path", "/"))
    above = files.select("side", "path", F.explode(F.expr("transform(sequence(0, size(split(path, '/')) - 1), k -> array_join(slice(split(path, '/'), 1, k), '/'))")).alias("directory")).where(depth > 0)
    inside = above.join(markers, ["side", "directory"], "left_semi").select("side", "path").distinct().withColumn("in_venv", F.lit(True))
    return files.join(inside, ["side", "path"], "left").withColumn("in_venv", F.coalesce("in_venv", F.lit(False)))


def inventory(files: DataFrame, rules: Rules, fingerprint: str, most_bytes: int = 1 << 30) -> DataFrame:
    """(side, mode, type, path, blob_id, size, in_venv) -> language, category, reason, scorable, key (p09, p10).

    The first reason that holds: submodule, symlink, unsupported (no blob), excluded, unsupported (no language), oversized.
    """
    path = F.col("path")
    out = files.withColumn("language", rules.language(path)).withColumn("category", rules.category(path))
    gone = rules.excluded(path) | always_excluded(path) | F.col("in_venv")
    reason = F.when(F.col("mode") == "160000", "submodule").when(F.col("mode") == "120000", "symlink").when(F.col("type") != "blob", "unsupported").when(gone, "excluded").when(F.col("language").isNull(), "unsupported").when(F.coalesce("size", F.lit(0)) > most_bytes, "oversized")
    out = out.withColumn("reason", reason).withColumn("scorable", F.col("reason").isNull())
    return out.withColumn("key", F.when(F.col("scorable"), joined_key(F.lit("kg-item"), F.col("blob_id"), F.col("language"), F.lit(fingerprint))))


def supported() -> Column:
    return F.col("scorable") | (F.col("language").isNotNull() & F.coalesce(F.col("reason") == "oversized", F.lit(False)))


__all__ = ["BadRules", "Rules", "always_excluded", "any_glob_regex", "in_virtualenv", "inventory", "is_digest", "supported"]
