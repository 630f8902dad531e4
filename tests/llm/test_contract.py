"""Registered queries and the pipeline."""

import duckdb
import pandas as pd
import pytest

from geocadence.llm import registry


def test_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    order = sorted(want.columns)
    a, b = (x[order].fillna("-").sort_values(order).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").quality
    for k, (name, stage) in enumerate(c.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        if k + 1 < len(c.STAGES):
            assert docs.columns == columns
        if name == "quality classifier":
            left = {r.doc_id for r in docs.collect()}
            good = labels[labels == 1].index
            assert len(left & set(good)) >= 0.95 * len(good) and len(left & set(labels[labels == 0].index)) <= 0.2 * (labels == 0).sum()
        if name == "near dedup":
            from tests.llm.test_operators import brute_near

            want = {i for i, (_, root) in brute_near([tuple(r) for r in before.collect()]).items() if i == root}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    pieces = docs.toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, sf_dir, empty, nulls, clash, k):
    """Every stage with no rows, with nulls, and with columns of any name."""
    import corpus_pipeline as c

    name, stage = c.STAGES[k]
    assert stage(spark, empty, sf_dir).count() == 0
    assert stage(spark, nulls, sf_dir).count() <= 3
    out = stage(spark, clash, sf_dir).cache()
    assert out.count() > 20
    if k + 1 < len(c.STAGES):
        assert out.columns == clash.columns
        assert out.where("spans <> 1 OR _score <> 1 OR _row <> 1 OR _text <> 1").count() == 0
