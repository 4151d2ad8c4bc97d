"""Some of the registered queries against their SQL twins on the smallest tables; the rest are compared by the driver."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from knotgauge.plans import PLANS, TWINS

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SOME = ["a01_token_metrics", "i04_tree_levels", "j17_parent_links", "p02_category", "p03_excluded", "p07_extension", "w07_inference_windows", "a18_spearman", "i05_longest_first_packing", "w10_lru_eviction", "a15_softmax_statistics", "j09_changes", "p21_tau_resolution", "a02_lm_cc", "i01_boundaries", "k04_tree_document", "s10_jsonl_reader", "s11_entry_reader", "v03_byte_cover", "v06_artifact_report", "v07_blob_digest", "i09_publication_order", "p22_settings_validation", "a22_promotion_gate", "u02_language_preprocessing", "s01_project_discovery", "s02_worktree_scan", "s04_explicit_files", "s07_blob_reader", "s08_file_at_revision", "s09_revisions", "s16_rules_file", "s19_response_file", "i08_section_budget", "k02_text_report"]


def plain(value):
    if value is None or value is pd.NA or isinstance(value, (float, np.floating)) and value != value:
        return ""
    if isinstance(value, (float, np.floating)) and float(value).is_integer():
        return str(int(value))
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([plain(x) for x in value])
    if isinstance(value, (float, np.floating)):
        return repr(float(value))
    return str(int(value)) if isinstance(value, (int, np.integer)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, duck, name):
    got, want = PLANS[name](spark, SF).toPandas(), duck.execute(TWINS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_registry():
    assert set(TWINS) <= set(PLANS) and set(entry.oracle_sql()) <= set(entry.queries()) and len(PLANS) > 120


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0].tree_score >= rows[-1].tree_score
