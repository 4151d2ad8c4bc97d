"""Hand-computed scoring cases, and the declarative plan against a sequential reading on random input."""

import hashlib
import random

import pytest

from knotgauge.operators import units as un

TOKENS = "file_id long, idx long, start_byte long, end_byte long, entropy double"


def sequential(tokens, scopes, lines, ranges, tau, mode, starts):
    """The same blocks by loops over one file."""
    if not tokens:
        return []
    first_of, line_of = {}, []
    for i, (s, _, _) in enumerate(tokens):
        line = max((x for x in lines if x <= s), default=0)
        line_of.append(line)
        first_of.setdefault(line, i)
    ms, me = (min(a for a, _ in ranges), max(b for _, b in ranges)) if ranges else (tokens[0][0], tokens[-1][1])
    ss, se = sum(e <= ms for _, e, _ in tokens), sum(s < me for s, _, _ in tokens)
    hot = {max(first_of[line_of[i]], ss) for i in range(ss + starts, se) if i < len(tokens) and tokens[i][2] is not None and tokens[i][2] >= tau}
    cuts = {ss, se} | {c for c in hot if ss < c < se}
    if mode == "structural":
        cuts |= {c for _, b, _ in scopes if ss < (c := sum(s < b for s, _, _ in tokens)) < se}
    cuts = sorted(cuts)
    pairs = list(zip(cuts, cuts[1:]))
    if mode == "reference" and ss not in hot:
        pairs = pairs[1:]
    units = []
    for a, z in pairs:
        start = tokens[a][0]
        if ranges:
            near = next((r for r in sorted(ranges) if r[1] > start), None)
            if near is None or near[0] >= tokens[z - 1][1]:
                continue
            start = max(start, near[0])
        depth = max((d for x, y, d in scopes if x <= start < y), default=0)
        units.append((start, min(tokens[z - 1][1], me), depth))
    return [] if mode == "structural" and len(units) == 1 else units


def levels(depths):
    stack, out = [], []
    for d in depths:
        while stack and stack[-1] >= d:
            stack.pop()
        out.append(2 + len(stack))
        stack.append(d)
    return out


def frames(spark, cases):
    t, li, sc, ra = [], [], [], []
    for k, (tokens, scopes, lines, ranges) in enumerate(cases):
        t += [(k, i, s, e, h) for i, (s, e, h) in enumerate(tokens)]
        li += [(k, n + 1, x) for n, x in enumerate(lines)]
        sc += [(k, *x) for x in scopes]
        ra += [(k, *x) for x in ranges]
    return (
        spark.createDataFrame(t, TOKENS),
        spark.createDataFrame(li, "file_id long, line long, line_start long"),
        spark.createDataFrame(sc, "file_id long, scope_start long, byte_offset long, depth long"),
        spark.createDataFrame(ra, "file_id long, start_byte long, end_byte long"),
    )


def one_byte(entropies):
    return [(i, i + 1, h) for i, h in enumerate(entropies)]


@pytest.mark.parametrize("mode", ["structural", "reference"])
@pytest.mark.parametrize("starts", [True, False])
def test_units_match_sequential(spark, mode, starts):
    rng = random.Random(3)
    cases = []
    for _ in range(150):
        tokens, at = [], 0
        for i in range(rng.randrange(1, 14)):
            at += rng.choice([0, 0, 0, 2])
            n = rng.randrange(1, 4)
            tokens.append((at, at + n, None if i == 0 else rng.choice([0.0, 0.0, 2.0])))
            at += n
        size = at
        lines = sorted({0} | {rng.randrange(size + 1) for _ in range(rng.randrange(4))})
        scopes = [(a, rng.randrange(a, size + 1), rng.randrange(4)) for a in (rng.randrange(size + 1) for _ in range(rng.randrange(5)))]
        cuts = sorted(rng.sample(range(size + 1), 2 * min(rng.randrange(3), (size + 1) // 2)))
        cases.append((tokens, scopes, lines, list(zip(cuts[::2], cuts[1::2]))))
    t, li, sc, ra = frames(spark, cases)
    tau = t.select("file_id").distinct().selectExpr("file_id", "1.0D as tau")
    got = {}
    for r in un.detect_units(t, li, sc, ra, tau, mode, starts).collect():
        got.setdefault(r.file_id, []).append((r.start_byte, r.end_byte, r.depth))
    for k, case in enumerate(cases):
        assert sorted(got.get(k, [])) == sorted(sequential(*case, 1.0, mode, int(starts))), case


def score(spark, tokens, scopes=(), ranges=(), tau=1.0, alpha=0.8, mode="structural", lines=(0,)):
    t, li, sc, ra = frames(spark, [(tokens, list(scopes), list(lines), list(ranges))])
    return un.analyze(t, li, sc, ra, t.select("file_id").distinct().selectExpr("file_id", f"{tau}D as tau"), alpha, mode).collect()


def test_undivided_is_its_root(spark):
    assert [round(r.tree_score, 9) for r in score(spark, one_byte([None, 0.0, 0.0]), ranges=[(0, 3)])] == [0.2]


def test_empty(spark):
    assert score(spark, []) == []


def test_worked_example(spark):
    depths = [0, 1, 0, 1, 2, 3, 4, 5, 1]
    units = spark.createDataFrame([(1, i, d) for i, d in enumerate(depths)], "file_id long, seq long, depth long")
    r = un.score_trees(units).first()
    assert (r.n_units, r.total_level, round(r.tree_score, 9)) == (9, 35, 14.4)


def test_deep_nesting(spark):
    units = spark.createDataFrame([(1, d, d) for d in range(64)], "file_id long, seq long, depth long")
    assert un.score_trees(units).first().max_level == 65


def test_metrics(spark):
    t, *_ = frames(spark, [(one_byte([None, 0.5, 1.0]), [], [0], [])])
    m = un.token_metrics(t, t.select("file_id").distinct().selectExpr("file_id", "1.0D as tau")).first()
    assert (m.token_count, m.high_entropy_tokens, m.entropy_sum) == (2, 1, 1.5)


def test_percentile(spark):
    t, *_ = frames(spark, [(one_byte([0.0, 10.0]), [], [0], [])])
    assert round(un.percentile_tau(t, 67).first().tau, 9) == 6.7


def test_same_on_any_partitioning(spark):
    tokens = one_byte([None, 0.0, 2.0, 0.0, 2.0, 0.0])
    t, li, sc, ra = frames(spark, [(tokens, [(0, 6, 0), (4, 6, 1)], [0, 2, 4], [])] * 5)
    tau = t.select("file_id").distinct().selectExpr("file_id", "1.0D as tau")
    a = sorted(un.analyze(t, li, sc, ra, tau).collect())
    b = sorted(un.analyze(t.repartition(7), li.repartition(3), sc.repartition(2), ra, tau.coalesce(1)).collect())
    assert a == b


def test_levels_fold(spark):
    rng = random.Random(1)
    runs = [[rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    units = spark.createDataFrame([(k, i, d) for k, run in enumerate(runs) for i, d in enumerate(run)], "file_id long, seq long, depth long")
    got = {}
    for r in sorted(un.unit_nodes(units.withColumn("end_byte", units.seq)).collect(), key=lambda r: (r.file_id, r.seq)):
        got.setdefault(r.file_id, []).append(r.level)
    assert got == {k: levels(run) for k, run in enumerate(runs)}
    assert {r.file_id: (r.total_level, r.max_level) for r in un.score_trees(units).collect()} == {k: (sum(v), max(v)) for k, v in got.items()}


def test_bootstrap_takes_all_rows(spark):
    """Each run of the whole table has an interval of 2,000 resamples; drawn ranks are those of the plain method."""
    import numpy as np
    import pandas as pd

    from knotgauge.operators import stats as st
    from knotgauge.plans import PLANS

    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet").toPandas()
    got = PLANS["a20_bootstrap_interval"](spark, sf).toPandas()
    assert sorted(got["g"]) == sorted((part["p_partkey"] % 100).unique())
    varies = part.groupby(part["p_partkey"] % 100)[["p_size", "p_retailprice"]].nunique().min(axis=1) > 1
    assert ((got.set_index("g")["n"] > 0).sort_index() == varies.sort_index()).all() and got["n"].max() <= 2000
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"g": 1, "x": rng.integers(0, 9, 30), "y": rng.random(30)})
    one = st.bootstrap_interval(spark.createDataFrame(rows), "x", "y", ["g"]).first()
    assert one.n == 2000 and one.low < rows["x"].rank().corr(rows["y"].rank()) < one.high
    drawn = rng.integers(0, 30, (5, 30))
    times = np.array([np.bincount(d, minlength=30) for d in drawn])
    ranks = st._centred_ranks(rows["x"].to_numpy(), times)
    for d, r in zip(drawn, ranks):
        assert np.allclose(r[d], rows["x"][d].rank().to_numpy() - 15.5)


def test_hex_takes_whole_texts(spark, monkeypatch):
    """A decoder that loses all after 80 bytes is seen in each longer text."""
    from knotgauge.plans import PLANS, statistics

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    digest = lambda raw: hashlib.md5(raw.hex().upper().encode()).hexdigest()
    assert all(r.back and r.odd_is_null and r.digits == 2 * len(docs[r.doc_id]) and r.encoded == digest(docs[r.doc_id]) for r in PLANS["f01_hex"](spark, sf).collect())
    decode = statistics.sc.decode_hex
    monkeypatch.setattr(statistics.sc, "decode_hex", lambda e: decode(e.substr(1, 160)))
    assert all(r.back == (len(docs[r.doc_id]) <= 80) for r in PLANS["f01_hex"](spark, sf).collect())
