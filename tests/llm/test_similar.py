"""The pipeline's near copies against all pairs."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from knotgauge.llm import simhash, similar
from knotgauge.llm.common import read_table
from knotgauge.llm.similar import LEAST, shingles

SF = "/root/testdata/sf0.01"


def brute_kept(rows):
    sets = [(i, set(shingles(t or "").tolist())) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        shared = len(a & b)
        if shared >= LEAST * (len(a) + len(b) - shared):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return sorted(i for i in root if top(i) == i)


def test_stage_leaves_one_of_all_similar_texts(spark):
    docs = read_table(spark, SF, "documents")
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.select("doc_id").collect()) == brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_no_rows(spark):
    none = read_table(spark, SF, "documents").limit(0)
    assert corpus_pipeline.near_duplicates(spark, none, SF).count() == 0


def clusters(seed, sizes, words=60):
    """Texts in clusters of near copies: each changes one word of its cluster's text or, rarely, two; clusters share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared, rows = [word() for _ in range(words // 2)], []
    for size in sizes:
        own = shared + [word() for _ in range(words)]
        for _ in range(size):
            text = list(own)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("group", [1000, 4])
def test_large_groups_are_dealt_out(spark, monkeypatch, group):
    """With groups of at most four nodes, pivots and blocks must find the same links."""
    monkeypatch.setattr(similar, "GROUP", group)
    rows = clusters(3, [1, 2, 9, 40, 25]) + [(900, None), (901, ""), (902, " "), (None, "a b c"), (903, "a b c")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in similar.drop_similar(table).collect())
    assert got == brute_kept([r for r in rows if r[0] is not None])


def test_names_of_columns_do_not_matter(spark):
    rows = [(i, "one two three four five six", i, "k", 3, "dot", 7) for i in range(4)] + [(9, "other words here", 9, "k", 3, "dot", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row int, _kept string, key int, `a.b` string, root long")
    for drop in (similar.drop_similar, simhash.drop_near_duplicates):
        assert sorted(map(tuple, drop(table).collect())) == [rows[0], rows[4]] and drop(table).columns == table.columns


def test_fingerprint_candidates_alone_find_texts_that_bands_miss(spark, monkeypatch):
    """Without min-hash bands, what balls of fingerprints find is still found and checked."""
    monkeypatch.setattr(similar, "bands", lambda hashes: [])
    rng = random.Random(5)
    own = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = [(0, " ".join(own)), (1, " ".join([*own[:200], "changed", *own[201:]])), (2, " ".join(own[::-1]))]
    near = [r for r in rows if (simhash.fingerprint(r[1], 5) ^ simhash.fingerprint(rows[0][1], 5)).bit_count() <= 4]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.drop_similar(table).collect()) == ([0, 2] if len(near) == 2 else [0, 1, 2])
