import datetime as dt
import subprocess

import pytest

from knotgauge.functions import scalars as sc
from knotgauge.functions.globs import BadGlob, glob_regex
from knotgauge.lang import prepare, prepare_files
from knotgauge.operators.compare import pack_longest_first
from knotgauge.operators.hierarchy import nest
from knotgauge.operators.rules import BadRules, Rules
from knotgauge.operators.stats import softmax_statistics
from knotgauge.sources import discovery, git, providers, sinks
from knotgauge.sources.stores import CacheTable

import re


@pytest.mark.parametrize(
    "pattern,path,matches",
    [
        ("a/**", "a/b", True), ("a/**", "a", False), ("**/a", "a", True), ("**/a", "x/y/a", True), ("a*c", "abc", True), ("a*c", "a/c", False),
        ("a?c", "abc", True), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[]a]", "]", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
        ("\\*", "*", True), ("*", "ab", True), ("*", "a/b", False), ("A", "a", False), ("a.b", "axb", False), ("x**y", "xzzy", True),
    ],
)
def test_globs(pattern, path, matches):
    assert bool(re.search(glob_regex(pattern), path)) is matches


@pytest.mark.parametrize("pattern", ["", "/a", "a//b", "a/../b", "[a", "a\\", "x" * 300])
def test_bad_globs(pattern):
    with pytest.raises(BadGlob):
        glob_regex(pattern)


@pytest.mark.parametrize("raw", [b"[]", b"{", b'{"other": 1}', b'{"exclude": ["/a"]}', b'{"extensions": {".x": "cobol"}}', b" " * 70000])
def test_bad_rules(raw):
    with pytest.raises(BadRules):
        Rules.parse(raw)


def test_rules_keep_defaults():
    r = Rules.parse(b'{"tests": ["t/**"], "paths": [{"pattern": "old/**", "language": "c"}]}')
    assert r.tests == ("t/**",) and r.exclude == Rules().exclude
    assert discovery.language_of("old/x.rs", r) == "c" and discovery.category_of("t/x", r) == "tests"


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t.example", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, body in {"a.py": "x = 1\n", "vendor/v.py": "y\n", "docs/n.txt": "n\n", "env/pyvenv.cfg": "", "env/z.py": "z\n", "src/b.rs": "fn b() {}\n", ".gitignore": "ignored.py\n", "ignored.py": "i\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "src/b.rs").rename(tmp_path / "src/c.rs")
    (tmp_path / "a.py").write_text("x = 2\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    return tmp_path


def test_discovery(spark, repo, tmp_path_factory):
    found = discovery.discover([str(repo), str(repo / "nothing")])
    assert sorted(v[3] for v in found.files.values()) == ["a.py", "src/c.rs"] and len(found.warnings) == 1
    assert discovery.discovered(spark, found).count() == 2
    assert "ignored.py" in {v[3] for v in discovery.discover([str(repo)], no_ignore=True).files.values()}
    plain = tmp_path_factory.mktemp("plain")
    (plain / "build").mkdir()
    (plain / "build/x.py").write_text("x")
    (plain / "y.go").write_text("y")
    assert [v[3] for v in discovery.discover([str(plain)]).files.values()] == ["y.go"]
    with pytest.raises(discovery.Unsupported):
        discovery.discover([str(repo / "docs/n.txt")])
    small, large = discovery.read_sources(spark, str(plain), 1)
    assert small.count() == 2 and large.count() == 0


def test_git(spark, repo):
    head, base = git.resolve(str(repo), "HEAD"), git.resolve(str(repo), "HEAD~1")
    assert git.merge_base(str(repo), head, base) == base
    tree = {r.path: r for r in git.commit_tree(spark, str(repo), head).collect()}
    assert tree["a.py"].size == 6 and tree["a.py"].type == "blob"
    assert {tuple(r) for r in git.commit_changes(spark, str(repo), base, head).collect()} == {("M", "a.py", "a.py"), ("R100", "src/b.rs", "src/c.rs")}
    wanted = [(r.object_id, r.size) for r in tree.values()]
    got = list(git.read_blobs(str(repo), wanted, batch_bytes=7))
    assert [i for i, _ in got] == [i for i, _ in wanted] and all(git.blob_digest(b) == i for i, b in got)
    assert git.file_at(str(repo), base, "a.py") == b"x = 1\n" and git.file_at(str(repo), base, "none") is None
    with pytest.raises(git.GitError):
        git.resolve(str(repo), "--all")


def test_cache_table(spark, tmp_path):
    cache = CacheTable(spark, str(tmp_path / "c"), "v long")
    day = lambda n: dt.datetime(2024, 1, n)
    items = spark.createDataFrame([("a",), ("b",)], "key string")
    assert cache.probe(items, day(1))[1].count() == 2
    cache.put(spark.createDataFrame([("a", 1)], "key string, v long"), day(1))
    cache.put(spark.createDataFrame([("a", 2)], "key string, v long"), day(2))
    hits, misses = cache.probe(items, day(10))
    assert [(r.key, r.v, r.state) for r in hits.collect()] == [("a", 2, "hit")] and [r.key for r in misses.collect()] == ["b"]
    assert [r.state for r in cache.probe(items, day(25))[0].collect()] == ["refresh"]
    assert cache.probe(items, dt.datetime(2024, 2, 20))[0].count() == 0


def test_cache_gives_up_the_oldest(spark, tmp_path):
    cache = CacheTable(spark, str(tmp_path / "c"), "n long, v string")
    day = lambda n: dt.datetime(2024, 1, n)
    row = lambda *rows: spark.createDataFrame(list(rows), "key string, n long, v string")
    assert cache.get("a") is None
    assert cache.put(row(("a", 40, "x"), ("b", 30, "y")), day(1), "n", 100) == 0
    assert cache.put(row(("c", 30, "z")), day(2), "n", 100) == 0
    assert cache.put(row(("d", 35, "w")), day(3), "n", 100) == 1 and cache.get("a") is None and cache.get("b")["v"] == "y"
    assert cache.put(row(("e", 500, "w")), day(4), "n", 100) == 0 and cache.get("e") is None
    assert cache.put(row(("b", 31, "new")), day(5), "n", 100) == 0 and cache.get("b")["v"] == "new"
    assert sorted(r.key for r in cache.latest().collect()) == ["b", "c", "d"]
    with pytest.raises(ValueError):
        cache.get("b", "n", 30)


def test_provider_registry(spark):
    made = []
    providers.register("bytes", lambda: made.append(1) or providers.from_scorer(lambda b: [(b[i : i + 1], float(i)) for i in range(len(b))]))
    files = spark.createDataFrame([(1, "ab"), (2, None)], "file_id long, text string")
    assert providers.provider("bytes")(files).count() == 2 and providers.provider("bytes") and made == [1]

    def fails():
        made.append(2)
        raise RuntimeError("no model")

    providers.register("broken", fails)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            providers.provider("broken")
    assert made == [1, 2]


def test_packing_is_lpt(spark):
    rows = spark.createDataFrame([("g", str(i), s) for i, s in enumerate([9, 7, 6, 5])], "group string, key string, size long")
    assert sorted(r.bytes for r in pack_longest_first(rows, 2).collect()) == [13, 14]
    assert pack_longest_first(rows, 9).count() == 4


def test_softmax(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 2), (2, [0.0] * 4, 0), (3, [1000.0, float("-inf")], 0), (4, [float("nan")], 0)], "i int, x array<double>, t int")
    got = {r.i: r for r in rows.select("i", *softmax_statistics("x", "t")).collect()}
    assert round(got[1].probability, 10) == 0.6652409558 and round(got[1].entropy, 10) == 0.8323955818
    assert round(got[2].entropy, 12) == round(1.3862943611198906, 12) and got[3].probability == 1.0 and got[4].entropy is None


def test_sinks(spark, tmp_path):
    listed = sinks.write_report_files(tmp_path / "r", {"report.md": "x"})
    assert listed["report.md"]["bytes"] == 1 and (tmp_path / "r/publication.json").exists()
    entry = sinks.envelope({"a": 1}, "2024-01-01T00:00:00Z")
    assert sinks.open_envelope(entry) == {"a": 1} and sinks.open_envelope(entry.replace('"a":1', '"a":2')) is None and sinks.open_envelope("{") is None
    assert sinks.fit_sections([(0, "aa"), (1, "bb")], 3) == "aa" and sinks.fit_sections([(0, "a\nbcd")], 3) == "a\n"
    table = sinks.markdown_table([{"path": "a|`b", "base": 0.0, "head": 1.0, "absolute": 1.0}] * 30)
    assert "5 more" in table and "\\|" in table
    assert "total: 1" in sinks.text_report([{"path": "a", "tree_score": 1.0, "token_count": 3}], {"tree_score": 1.0, "analyzed": 1})
    files = spark.createDataFrame([("a", None, 1), ("b", "bad", 2)], "path string, error string, result int")
    kinds = [r.line.split('"')[3] for r in sinks.event_lines(files, {}, files.limit(1).select("result")).orderBy("ord").collect()]
    assert kinds == ["start", "configuration", "file_start", "file", "file_start", "error", "totals"]


def test_formats():
    assert sc.signed_number(2.55) == "+2.5" and sc.short_number(100.0) == "100" and sc.signed_percent(12.345) == "+12.3%"
    assert sc.escape_bytes(b"a\xff\n\\") == "a\\xff\\x0a\\x5c" and sc.code_span("a`b") == "``a`b``"
    assert sc.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'


def test_nest():
    tree = nest([{"seq": 0, "parent_seq": None, "level": 2}, {"seq": 1, "parent_seq": 0, "level": 3}])
    assert tree["branching"] == 1 and tree["children"][0]["children"][0]["level"] == 3


def test_scanners(spark):
    p = prepare('def f(a):\n    """doc"""\n    # c\n    return [x for x in a if x]\n', "python")
    assert "doc" not in p.text and "# c" not in p.text and p.text.count("\n") == 4 and [f[0] for f in p.functions] == ["f"]
    p = prepare('int f(int a) { /* x */ if (a) { return "}//"[0]; } return a; }\nint g;', "c")
    assert [f[0] for f in p.functions] == ["f"] and [d for *_, d in p.scopes] == [0, 1] and '"}//"' in p.text
    assert prepare("int/*x*/a;", "c").text == "int a;"
    p = prepare("fn a<'x>(v: &'x str) { /* /* n */ */ let c = '{'; }", "rust")
    assert [f[0] for f in p.functions] == ["a"] and "n" not in p.text.split("{", 1)[1].replace("let", "").split("=")[0]
    files = spark.createDataFrame([(1, "func g() { }", "go"), (2, "x", "cobol"), (3, "{" * 1100, "c")], "file_id long, text string, language string")
    rows = {r.file_id: r for r in prepare_files(files).collect()}
    assert rows[1].functions[0].name == "g" and rows[2].error and rows[3].error


def test_stream(spark, tmp_path):
    from knotgauge.operators import tokens as tk
    from knotgauge.streaming.incremental import RESULT, score_stream

    def parts(files):
        from pyspark.sql import functions as F

        lines = tk.line_starts(files)
        scopes = files.select("file_id", F.lit(0).cast("long").alias("scope_start"), F.octet_length("text").cast("long").alias("byte_offset"), F.lit(0).cast("long").alias("depth"))
        return tk.deterministic_tokens(files), lines, scopes, tk.meaningful_ranges(lines), files.select("file_id", F.lit(1.0).alias("tau"))

    cache = CacheTable(spark, str(tmp_path / "cache"), RESULT)
    for k in range(2):
        spark.createDataFrame([(k, "same text\nof two lines"), (10 + k, f"text {k} " * 9)], "file_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("file_id long, text string").parquet(str(tmp_path / "in"))
        score_stream(stream, cache, parts, str(tmp_path / "cp"), lambda: dt.datetime(2024, 1, 1)).awaitTermination(120)
    assert cache.latest().count() == 3 and spark.read.parquet(str(tmp_path / "cache")).count() == 3
