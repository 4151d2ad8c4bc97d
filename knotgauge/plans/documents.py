"""Queries of readers, scanners and plan documents that need more than one operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import extension
from ..lang import prepare_files
from ..sources.discovery import read_sources
from .registry import query, sql_over, table


@query("s03_file_walk")
def file_walk(spark, sf_dir):
    """Files below the tables' folder with their sizes: the listing is filtered before any byte is read."""
    admitted, _ = read_sources(spark, sf_dir)
    return admitted.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "size", extension(F.col("path")).alias("ext"))


# A source in each language around the whole text of a document, whose lines are comments: (head, start of a comment, tail).
_SOURCES = {
    "rust": ("fn f{id}(a: i32) -> i32 {{\n", "//", "    if a > 0 {{ return 1; }}\n    0\n}}\n"),
    "c": ("int f{id}(int a) {{\n", "//", "    if (a) {{ return 1; }}\n    return 0;\n}}\n"),
    "cpp": ("int N::f{id}(int a) const {{\n", "//", "    auto g = [&](int b) {{ return b; }};\n    return g(a);\n}}\n"),
    "java": ("class C {{\n  int f{id}(int a) {{\n", "//", "    return a;\n  }}\n}}\n"),
    "python": ("@d\ndef f{id}(a):\n    pass\n", "#", "    def inner(b):\n        return b\n    return [inner(x) for x in a]\n"),
    "go": ("func f{id}(a int) int {{\n", "//", "    if a > 0 {{ return 1 }}\n    return 0\n}}\n"),
    "javascript": ("function f{id}(a) {{\n", "//", "    const g = (b) => {{ return b }}\n    return g(a)\n}}\n"),
    "csharp": ("class C {{\n  int f{id}(int a) {{\n", "//", "    return a;\n  }}\n}}\n"),
}


def _sources(part: str) -> str:
    """SQL of one part of the sources by document."""
    quoted = {x: v for x, v in zip(_SOURCES, (parts[("head", "mark", "tail").index(part)] for parts in _SOURCES.values()))}
    text = lambda v: "concat('" + v.format(id="', CAST(doc_id AS STRING), '").replace("\n", "', chr(10), '") + "')"
    return "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {text(v)}" for k, v in enumerate(quoted.values())) + " END"


_LANG = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SOURCES)) + " END"
_NAME = "concat(CASE WHEN doc_id % 8 = 2 THEN 'N::' ELSE '' END, 'f', CAST(doc_id AS STRING))"
_TEXT = "replace(coalesce(text, ''), chr(13), ' ')"


@query("u02_language_preprocessing", f"SELECT doc_id AS file_id, {_LANG} AS language, {_NAME} AS function, CAST(1 AS INT) AS n_functions, CAST(octet_length(encode({_sources('head')})) + length({_TEXT}) - length(replace({_TEXT}, chr(10), '')) + 1 + octet_length(encode({_sources('tail')})) AS BIGINT) AS n_left, TRUE AS clean, CAST(NULL AS VARCHAR) AS error FROM documents")
def preprocessing(spark, sf_dir):
    """A source around each whole text, in eight languages: the text's lines are comments and go, line ends stay, the outermost function is found."""
    docs = table(spark, sf_dir, "documents")
    mark = f"concat({_sources('mark')}, ' ')"
    sql = f"SELECT doc_id AS file_id, {_LANG} AS language, concat({_sources('head')}, {mark}, replace({_TEXT}, chr(10), concat(chr(10), {mark})), chr(10), {_sources('tail')}) AS text FROM {{docs}}"
    sources = sql_over(spark, sql, docs=docs)
    out = prepare_files(sources).select("file_id", F.col("functions")[0]["name"].alias("function"), F.size("functions").alias("n_functions"), F.octet_length("text").cast("long").alias("n_left"), (~F.col("text").contains("//") & ~F.col("text").contains("#")).alias("clean"), "error")
    return out.join(sources.select("file_id", "language"), "file_id")


_LEVELS = """deep AS (SELECT user_id AS file_id, CAST(floor(value) AS BIGINT) % 8 AS depth, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
lists AS (SELECT file_id, list(depth ORDER BY seq) AS d FROM deep GROUP BY file_id),
lv AS (SELECT file_id, unnest(range(1, len(d) + 1)) AS i, d FROM lists),
nodes AS (SELECT file_id, i - 1 AS seq, 2 + len(list_filter(range(1, i), lambda j: d[j] < list_min(d[j + 1 : i]))) AS level, (i - 1) * 7 + d[i] AS e FROM lv),
below AS (SELECT n.file_id, n.seq, n.level, (SELECT coalesce(min(m.seq), 1000000000) FROM nodes m WHERE m.file_id = n.file_id AND m.seq > n.seq AND m.level <= n.level) AS stop FROM nodes n),
full_nodes AS (SELECT b.file_id, b.seq, b.level, max(n.e) AS node_end, count(*) FILTER (n.level = b.level + 1) AS branching FROM below b JOIN nodes n ON n.file_id = b.file_id AND n.seq >= b.seq AND n.seq < b.stop GROUP BY b.file_id, b.seq, b.level),
parts AS (SELECT *, lead(level) OVER (PARTITION BY file_id ORDER BY seq) AS nx FROM full_nodes)"""


@query("k04_tree_document", f"""WITH {_LEVELS} SELECT file_id, '{{"level":1,"branching":' || CAST(count(*) FILTER (level = 2) AS VARCHAR) || ',"children":[' || string_agg('{{"seq":' || CAST(seq AS VARCHAR) || ',"level":' || CAST(level AS VARCHAR) || ',"branching":' || CAST(branching AS VARCHAR) || ',"node_end":' || CAST(node_end AS VARCHAR) || ',"children":[' || CASE WHEN nx > level THEN '' WHEN nx IS NULL THEN repeat(']}}', CAST(level - 1 AS INT)) ELSE repeat(']}}', CAST(level - nx + 1 AS INT)) || ',' END, '' ORDER BY seq) || ']}}' AS document FROM parts GROUP BY file_id""")
def tree_document(spark, sf_dir):
    """Each tree as one nested JSON document."""
    from ..operators.hierarchy import nested_json
    from ..operators.units import unit_nodes
    from .scoring import deep_units

    return nested_json(unit_nodes(deep_units(spark, sf_dir)))
