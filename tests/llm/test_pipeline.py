"""The pipeline's stages against brute-force versions of their operators."""

import pytest

import corpus_pipeline
from knotgauge.llm import pii
from knotgauge.llm.common import read_table
from knotgauge.llm.line_crf import fit_line_crf, quality_rules
from knotgauge.llm.mixing import mix_sources
from test_similar import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, stages):
    docs = read_table(spark, SF, "documents")
    good, near, clean, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    verdict = quality_rules(docs, fit_line_crf(docs, read_table(spark, SF, "labels")))
    assert ids(good) == ids(verdict.where("kept"))
    assert ids(near) == brute_kept([(r.doc_id, r.text) for r in good.collect()])
    before = {r.doc_id: r.text for r in near.collect()}
    assert {r.doc_id: r.text for r in clean.collect()} == {i: pii.redact(t) for i, t in before.items()}
    copies = {r.doc_id: r.copies for r in mix_sources(clean).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    lengths = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in lengths) <= 2048 and ids(packed.where("piece = 0")) == ids(mixed)


def test_stages_take_nulls_repeats_and_no_rows(spark):
    """A stage's edge cases are those of the operator that it calls; all but the last keep columns, names and types."""
    docs = read_table(spark, SF, "documents")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("doc_id + 100000 AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars").select(*docs.columns))
    for rows in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns and out.count() <= 3 * max(1, rows.count())
        assert (corpus_pipeline.packing(spark, rows, SF).count() == 0) == (rows.count() == 0)


def test_names_are_apart():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packing"] and corpus_pipeline.ORACLE_SQL is None
