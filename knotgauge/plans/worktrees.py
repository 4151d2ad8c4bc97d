"""Queries of what the driver does by itself: discovery, version control, rules files, reports. They run over a small tree that each
query makes for itself, and their twins are what is known of that tree."""

from __future__ import annotations

import hashlib
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

from ..sources import discovery, git, sinks
from .registry import query

#: Path -> content at the first commit; the second changes, moves and adds.
FIRST = {"a.py": "x = 1\n", "vendor/v.py": "y\n", "docs/n.txt": "n\n", "env/pyvenv.cfg": "", "env/z.py": "z\n", "src/b.rs": "fn b() {}\n", "t/deep/u_test.go": "package u\n", "tools/k.java": "class K {}\n", ".gitignore": "ignored.py\n", "ignored.py": "i\n"}
SECOND = {"a.py": "x = 2\n", "src/c.rs": "fn b() {}\n", "new.cc": "int n;\n"}
GONE = ("src/b.rs",)
RULES = '{"tests": ["t/**"], "tooling": ["new.*"], "paths": [{"pattern": "docs/**", "language": "c"}]}'


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({names})"


def _in_tree(act: Callable[[Path], list[tuple]]) -> list[tuple]:
    """What `act` returns of a worktree with two commits."""
    with tempfile.TemporaryDirectory() as folder:
        root = Path(folder).resolve()
        run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t.example", *a], check=True, capture_output=True, timeout=60)
        write = lambda files: [((root / name).parent.mkdir(parents=True, exist_ok=True), (root / name).write_text(body)) for name, body in files.items()]
        run("init", "-q")
        write(FIRST)
        run("add", "-A")
        run("commit", "-qm", "one")
        for name in GONE:
            (root / name).unlink()
        write(SECOND)
        run("add", "-A")
        run("commit", "-qm", "two")
        return act(root)


def _found(root: Path, inputs: list[str], **options: bool) -> list[tuple]:
    return [(v[3], v[1], v[4]) for v in discovery.discover(inputs, **options).files.values()]


_PROJECT = [("a.py", "python", "runtime"), ("new.cc", "cpp", "runtime"), ("src/c.rs", "rust", "runtime"), ("t/deep/u_test.go", "go", "tests"), ("tools/k.java", "java", "tooling")]


@query("s01_project_discovery", _values(_PROJECT, "path, language, category"))
def project(spark, sf_dir):
    return spark.createDataFrame(_in_tree(lambda root: _found(root, [str(root), str(root / "src")])), "path string, language string, category string")


_NOW = sorted({*FIRST, *SECOND} - set(GONE))


@query("s02_worktree_scan", _values([(p, p == "ignored.py") for p in _NOW], "path, ignored"))
def worktree(spark, sf_dir):
    """All paths, and which of them are ignored."""

    def act(root: Path) -> list[tuple]:
        known = discovery.worktree_paths(root)
        return [(p, p not in known) for p in discovery.worktree_paths(root, no_ignore=True)]

    return spark.createDataFrame(_in_tree(act), "path string, ignored boolean")


@query("s04_explicit_files", _values([("vendor/v.py", "python", "runtime"), ("env/z.py", "python", "runtime")], "path, language, category"))
def explicit(spark, sf_dir):
    """Files that no walk would take, given by name; one of no language is an error."""

    def act(root: Path) -> list[tuple]:
        out = _found(root, [str(root / "vendor/v.py"), str(root / "env/z.py")])
        try:
            return [*out, *_found(root, [str(root / "docs/n.txt")])]
        except discovery.Unsupported:
            return out

    return spark.createDataFrame(_in_tree(act), "path string, language string, category string")


_TREE = sorted({**{k: v for k, v in FIRST.items() if k not in GONE and k != "ignored.py"}, **SECOND}.items())


@query("s07_blob_reader", _values([(p, len(body.encode()), hashlib.md5(body.encode()).hexdigest(), True) for p, body in _TREE], "path, n_bytes, digest, id_holds"))
def blobs(spark, sf_dir):
    """Contents of the second commit in the order asked for, in batches of a few bytes."""

    def act(root: Path) -> list[tuple]:
        tree = [r for r in git.commit_tree(spark, str(root), git.resolve(str(root), "HEAD")).collect() if r.type == "blob"]
        got = git.read_blobs(str(root), [(r.object_id, r.size) for r in tree], batch_bytes=9)
        return [(r.path, len(body), hashlib.md5(body).hexdigest(), i == r.object_id and git.blob_digest(body) == i) for r, (i, body) in zip(tree, got, strict=True)]

    return spark.createDataFrame(_in_tree(act), "path string, n_bytes long, digest string, id_holds boolean")


_AT = [("HEAD~1", "a.py", "x = 1\n"), ("HEAD", "a.py", "x = 2\n"), ("HEAD", "src/b.rs", None), ("HEAD~1", "src/b.rs", "fn b() {}\n"), ("HEAD", "src", None)]


@query("s08_file_at_revision", _values(_AT, "revision, path, content"))
def file_at(spark, sf_dir):
    def act(root: Path) -> list[tuple]:
        read = lambda revision, path: git.file_at(str(root), git.resolve(str(root), revision), path)
        return [(revision, path, None if (body := read(revision, path)) is None else body.decode()) for revision, path, _ in _AT]

    return spark.createDataFrame(_in_tree(act), "revision string, path string, content string")


@query("s09_revisions", _values([("HEAD", True), ("HEAD~1", True), ("--all", False), ("no-such", False)], "revision, known"))
def revisions(spark, sf_dir):
    """Which revisions there are; a known one's merge base with HEAD is itself here."""

    def act(root: Path) -> list[tuple]:
        head, out = git.resolve(str(root), "HEAD"), []
        for revision in ("HEAD", "HEAD~1", "--all", "no-such"):
            try:
                own = git.resolve(str(root), revision)
                out.append((revision, git.merge_base(str(root), head, own) == own))
            except git.GitError:
                out.append((revision, False))
        return out

    return spark.createDataFrame(_in_tree(act), "revision string, known boolean")


@query("s16_rules_file", _values([("a.py", "python", "runtime"), ("docs/n.txt", "c", "runtime"), ("new.cc", "cpp", "tooling"), ("src/c.rs", "rust", "runtime"), ("t/deep/u_test.go", "go", "tests"), ("tools/k.java", "java", "runtime")], "path, language, category"))
def rules_file(spark, sf_dir):
    """The worktree's own rules replace the defaults that they name."""

    def act(root: Path) -> list[tuple]:
        (root / "rules.json").write_text(RULES)
        return _found(root, [str(root)])

    return spark.createDataFrame(_in_tree(act), "path string, language string, category string")


@query("s19_response_file", _values([(0, "--tau"), (1, "0.5"), (2, "a b.py"), (3, "c#d.py")], "place, argument"))
def response_file(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        (Path(folder) / "args").write_text("--tau\n0.5\n\n  # a comment\n  a b.py  \nc#d.py\n")
        return spark.createDataFrame(list(enumerate(discovery.response_file(f"{folder}/args"))), "place long, argument string")


@query("i08_section_budget", _values([(100, "first\n\nsecond\n\nthird\n"), (20, "first\n\nsecond\n"), (10, "first\n"), (3, "")], "budget, text"))
def sections(spark, sf_dir):
    """The least important section goes first; the last that stays is cut at a line."""
    parts = [(0, "first\n"), (1, "second\n"), (2, "third\n")]
    return spark.createDataFrame([(n, sinks.fit_sections(parts, n)) for n in (100, 20, 10, 3)], "budget long, text string")


@query("k02_text_report", _values([(0, "b.py: 12.5 (7 tokens)"), (1, "  line 3: max 2.25"), (2, "a.py: 3 (5 tokens)"), (3, "total: 15.5 in 2 files")], "place, line"))
def text_report(spark, sf_dir):
    files = [{"path": "a.py", "tree_score": 3.0, "token_count": 5}, {"path": "b.py", "tree_score": 12.5, "token_count": 7, "hotspots": [{"line": 3, "max_entropy": 2.25}]}]
    return spark.createDataFrame(list(enumerate(sinks.text_report(files, {"tree_score": 15.5, "analyzed": 2}).splitlines())), "place long, line string")
