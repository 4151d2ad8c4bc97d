"""Queries that analyse whole texts in one pass, against their SQL twins on odd texts: blank ones, line ends and spaces of other kinds, texts of a few bytes, no text."""

import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from knotgauge.plans import PLANS, TWINS
from test_queries import plain

ODD = ["", None, " ", "\n\n\n", "  \n \n\t\n ", "a", "abcd", ". . . ", "a. b. c\n", "\n a. b\n\n", "é. ü\n ß.   x  ", "abc. zz \u0085", "\r\n\r\n a \r\n b. c \r\n", " \x0b\x0c a. ", "漢字. かな\n" * 20, "a\n" * 50]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    rng, at = random.Random(7), tmp_path_factory.mktemp("odd")
    texts = ODD + ["".join(rng.choice(["z", "a", " ", "\n", ". ", "zz", "\t", "~~", "}{", "\r", "漢"]) for _ in range(rng.choice([3, 8, 20, 60, 200]))) for _ in range(200)]
    ids = range(len(texts))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([("en", "de", None)[i % 3] for i in ids]), "source": pa.array(["web"] * len(texts))}), at / "documents.parquet")
    return str(at)


def twin(odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet'")
    return con.execute(TWINS[name]).df()


def holds(spark, odd, name):
    """The twin's rows, by a plan that deals out no row of a token."""
    frame = PLANS[name](spark, odd)
    got, want = frame.toPandas(), twin(odd, name)
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Window|Generate.*regexp_extract_all|RepartitionByExpression", plan)


def test_a02(spark, odd):
    holds(spark, odd, "a02_lm_cc")


def test_a06(spark, odd):
    holds(spark, odd, "a06_function_metrics")


def test_a07(spark, odd):
    holds(spark, odd, "a07_project_totals")


def test_a28(spark, odd):
    holds(spark, odd, "a28_per_token_ratio")


def test_j04(spark, odd):
    holds(spark, odd, "j04_unit_depth")


def test_o07(spark, odd):
    holds(spark, odd, "o07_top_documents")


def test_o07_order(spark, tmp_path):
    """Rows in the twin's order, where equal texts stand on both sides of place 20; no row is dealt out but the top ones of each task."""
    texts = ["a. b" + ". zz" * (i % 4) + "\n~~ }{. c\n" * 5 for i in range(60)]
    pq.write_table(pa.table({"doc_id": pa.array(range(59, -1, -1), pa.int64()), "text": texts, "lang": ["en"] * 60, "source": ["web"] * 60}), tmp_path / "documents.parquet", row_group_size=7)
    frame, want = PLANS["o07_top_documents"](spark, str(tmp_path)), twin(tmp_path, "o07_top_documents")
    assert [tuple(r) for r in frame.select(*want.columns).collect()] == list(want.itertuples(index=False, name=None))
    assert want["tree_score"].nunique() == 2  # 15 of the first kind, 5 of the 15 of the next
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    assert "TakeOrderedAndProject" in plan and not re.search("Exchange|Window|Generate|Join", plan)


def test_p18(spark, odd):
    holds(spark, odd, "p18_score_mode")
