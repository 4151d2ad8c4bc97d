"""Plans that must not send to the driver, or sum in any order, what grows with a table."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from knotgauge.plans import PLANS, TWINS
from test_queries import SF, plain


def test_j19_sides_are_not_broadcast(spark):
    frame = PLANS["j19_suffix_pairing"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    want = con.execute(TWINS["j19_suffix_pairing"]).df()
    assert sorted((r.p_partkey, r.short) for r in frame.collect()) == sorted(want[["p_partkey", "short"]].itertuples(index=False, name=None))
    assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()


def test_a01_sums_whole_numbers(spark, tmp_path):
    """Means that are no tie at the sixth digit but look like one, and a text without a scored token."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF.replace('0.001', '0.1')}/documents.parquet' WHERE doc_id IN (3178, 4981, 5446, 9670, 3533)")
    pq.write_table(pa.Table.from_pandas(con.execute("SELECT * FROM documents").df(), preserve_index=False), tmp_path / "documents.parquet")
    got, want = PLANS["a01_token_metrics"](spark, str(tmp_path)).toPandas(), con.execute(TWINS["a01_token_metrics"]).df()
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert len(got) == 5 and rows(got) == rows(want)
