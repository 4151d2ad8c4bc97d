"""Comment and scope scanners for eight languages.

Brace languages are scanned by character: comments and literals are told apart, braces open
scopes, and a scope whose head looks like a definition is a function. Python is read with its
own tokenizer and syntax tree. Comments go, their line ends stay; a space is put where two
tokens would run together. Offsets are bytes of the cleaned text; `kept` maps them back.
"""

from __future__ import annotations

import ast
import io
import re
import time
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

LANGUAGES = ("rust", "c", "cpp", "java", "python", "go", "javascript", "csharp")
MOST_DEPTH = 1024
SECONDS = 300.0
_NOT_FUNCTIONS = {"if", "for", "while", "switch", "catch", "else", "do", "try", "match", "loop", "unsafe", "struct", "class", "enum", "union", "namespace", "interface", "impl", "trait", "mod", "extern", "select", "using", "lock", "return", "new", "record"}
_HEAD = {
    "rust": re.compile(r"\bfn\s+(\w+)"),
    "go": re.compile(r"\bfunc\s*(?:\([^)]*\)\s*)?(\w+)"),
    "javascript": re.compile(r"(?:\bfunction\s*\*?\s*(\w+)|(\w+)\s*(?:=\s*(?:async\s*)?(?:function\b[^{]*|\([^)]*\)\s*=>)|\([^)]*\)))\s*$"),
}
_CALL = re.compile(r"([~\w:]+)\s*\([^;{}]*\)[^;{}()=]*(?:->[^;{}]*)?$", re.S)


class TooDeep(ValueError):
    """Scopes nest beyond MOST_DEPTH."""


class TooLong(ValueError):
    """A file takes longer than its budget."""


class Budget:
    """The time that one file may take (v08): loops tick, and the clock is read now and then."""

    def __init__(self, seconds: float = SECONDS, every: int = 4096):
        self.end, self.every, self.ticks = time.monotonic() + seconds, every, 0

    def tick(self) -> None:
        self.ticks += 1
        if self.ticks % self.every == 0:
            self.check()

    def check(self) -> None:
        if time.monotonic() > self.end:
            raise TooLong("the file takes too long")


@dataclass
class Prepared:
    text: str
    scopes: list[tuple[int, int, int]] = field(default_factory=list)
    functions: list[tuple[str, int, int]] = field(default_factory=list)
    kept: list[tuple[int, int, int]] = field(default_factory=list)


def _comment_spans(text: str, language: str, budget: Budget) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(comments, literals) of a brace language, in characters."""
    comments, literals, i, n = [], [], 0, len(text)
    quotes = "\"'`" if language in ("javascript", "go") else "\"'"
    while i < n:
        budget.tick()
        two = text[i : i + 2]
        if two == "//":
            end = text.find("\n", i)
            end = n if end < 0 else end
            comments.append((i, end))
            i = end
        elif two == "/*":
            depth, j = 1, i + 2
            while j < n and depth:
                if text.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                elif language == "rust" and text.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
            comments.append((i, j))
            i = j
        elif language == "rust" and text[i] == "'" and not re.match(r"'(\\.|[^\\'])'", text[i : i + 4]) and not text.startswith("'\\", i):
            i += 1  # a lifetime
        elif language in ("rust", "cpp") and (m := re.compile(r'(?:b|br|R|u8R|LR)?r?(#*)"' if language == "rust" else r'(?:u8|L|u|U)?R"([^()\\ ]*)\(').match(text, i)) and (language == "cpp" or m.group(1)):
            close = f'"{m.group(1)}' if language == "rust" else f"){m.group(1)}\""
            end = text.find(close, m.end())
            end = n if end < 0 else end + len(close)
            literals.append((i, end))
            i = end
        elif text[i] in quotes:
            q, j = text[i], i + 1
            while j < n and text[j] != q:
                if q != "`" and text[j] == "\n":
                    break
                j += 2 if text[j] == "\\" and not (q == "`" and language == "go") else 1
            literals.append((i, min(n, j + 1)))
            i = min(n, j + 1)
        else:
            i += 1
    return comments, literals


def _python_spans(text: str, budget: Budget) -> list[tuple[int, int]]:
    """Comments and docstrings of Python, in characters."""
    lines = text.split("\n")  # as the tokenizer counts them: other line ends are characters
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    spans = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            budget.tick()
            if t.type == tokenize.COMMENT:
                a = starts[t.start[0] - 1] + t.start[1]
                spans.append((a, a + len(t.string)))
        budget.check()
        for node in ast.walk(ast.parse(text)):
            budget.tick()
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(v := node.body[0].value, ast.Constant) and isinstance(v.value, str):
                at = lambda row, col: starts[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore"))
                spans.append((at(v.lineno, v.col_offset), at(v.end_lineno, v.end_col_offset)))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass
    return sorted(spans)


def _remove(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """Text without spans (line ends kept; a later span that overlaps is skipped), and kept spans (byte in the new, byte in the old, 1)."""
    out, kept, at, new, old = [], [], 0, 0, 0

    def add(piece: str, original: bool) -> None:
        nonlocal new
        if piece:
            if original:
                kept.append((new, old, 1))
            out.append(piece)
            new += len(piece.encode())

    for a, b in spans:
        if a < at:
            continue
        piece = text[at:a]
        add(piece, True)
        old += len(piece.encode())
        ends = re.sub(r"[^\n]", "", text[a:b])
        joins = not ends and a and b < len(text) and re.match(r"\w", text[a - 1]) and re.match(r"\w", text[b])
        add(ends or (" " if joins else ""), False)
        old += len(text[a:b].encode())
        at = b
    add(text[at:], True)
    return "".join(out), kept


def _brace_scopes(text: str, language: str, budget: Budget) -> tuple[list, list]:
    _, literals = _comment_spans(text, language, budget)
    masked = list(text)
    for a, b in literals:
        masked[a:b] = [c if c == "\n" else "_" for c in text[a:b]]
    masked = "".join(masked)
    at, size = [0] * (len(text) + 1), 0
    for i, c in enumerate(text):
        at[i] = size
        size += len(c.encode())
    at[len(text)] = size
    stack, scopes, functions, head = [], [], [], 0
    for i, c in enumerate(masked):
        budget.tick()
        if c == "{":
            name, before = "", masked[head:i].strip()
            found = _HEAD[language].search(before) if language in _HEAD else _CALL.search(before)
            if found:
                name = next((g for g in found.groups() if g), "")
            if name in _NOT_FUNCTIONS or any(s[1] for s in stack):
                name = ""
            if len(stack) >= MOST_DEPTH:
                raise TooDeep(language)
            lead = len(masked[head:i]) - len(masked[head:i].lstrip())
            stack.append((i, name, head + lead))
            head = i + 1
        elif c == "}":
            if stack:
                a, name, start = stack.pop()
                scopes.append((at[a], at[i + 1], len(stack)))
                if name:
                    functions.append((name, at[start], at[i + 1]))
            head = i + 1
        elif c == ";":
            head = i + 1
    return sorted(scopes), sorted(functions, key=lambda f: f[1])


def _python_scopes(text: str, budget: Budget) -> tuple[list, list]:
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return [], []
    lines = text.encode().split(b"\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    at = lambda row, col: starts[row - 1] + col
    scopes, functions = [], []

    def visit(node: ast.AST, depth: int, inside: bool) -> None:
        if depth > MOST_DEPTH:
            raise TooDeep("python")
        for child in ast.iter_child_nodes(node):
            budget.tick()
            deeper, in_function = depth, inside
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)):
                first = child.body[0] if getattr(child, "body", None) else child
                a = at(first.lineno, first.col_offset)
                scopes.append((a, at(child.end_lineno, child.end_col_offset), depth))
                deeper = depth + 1
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) and not inside:
                    top = min([child, *child.decorator_list], key=lambda n: (n.lineno, n.col_offset))
                    start = at(top.lineno, top.col_offset) - (1 if top is not child else 0)
                    functions.append((child.name, start, at(child.end_lineno, child.end_col_offset)))
                    in_function = True
            elif isinstance(child, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                scopes.append((at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset), depth))
                deeper = depth + len(child.generators)
            visit(child, deeper, in_function)

    visit(tree, 0, False)
    return sorted(scopes), sorted(functions, key=lambda f: f[1])


def prepare(text: str, language: str, seconds: float = SECONDS) -> Prepared:
    """Comments removed, scopes and functions found; TooDeep or TooLong beyond a file's limits."""
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language}")
    budget = Budget(seconds)
    spans = _python_spans(text, budget) if language == "python" else _comment_spans(text, language, budget)[0]
    clean, kept = _remove(text, spans)
    budget.check()
    scopes, functions = _python_scopes(clean, budget) if language == "python" else _brace_scopes(clean, language, budget)
    return Prepared(clean, scopes, functions, kept)


SCHEMA = "file_id long, text string, scopes array<struct<scope_start:bigint,byte_offset:bigint,depth:bigint>>, functions array<struct<name:string,start_byte:bigint,end_byte:bigint>>, error string"


def prepare_files(files: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """(file_id, text, language) -> cleaned text, scopes and functions, or an error; one file's fault is its own row's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, text, language in zip(batch["file_id"], batch["text"], batch["language"]):
                try:
                    p = prepare(text or "", language, seconds)
                    rows.append((file_id, p.text, [dict(zip(("scope_start", "byte_offset", "depth"), s)) for s in p.scopes], [dict(zip(("name", "start_byte", "end_byte"), f)) for f in p.functions], None))
                except (ValueError, RecursionError) as e:
                    rows.append((file_id, None, [], [], str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["file_id", "text", "scopes", "functions", "error"])

    return files.select("file_id", "text", "language").mapInPandas(run, SCHEMA)
