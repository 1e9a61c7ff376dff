"""Every query against DuckDB, over whole tables."""

import oracle
import pytest

from residua.plans import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert oracle.difference(catalog.QUERIES[name](spark, oracle.DATA), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, oracle.DATA).count() > 0


def test_first_regression_values(spark):
    found = {r["subject"]: r["dice"] for r in catalog.QUERIES["dice"](spark, oracle.DATA).collect()}
    assert found == {7: 0.515213, 8: 0.510424, 9: 0.525413}


@pytest.mark.parametrize("parts", [1, 16])
def test_partitioning_does_not_matter(spark, parts):
    from pyspark.sql import functions as F

    from residua.operators import metrics, thresholds
    from residua.plans import frames

    rows = frames.full(spark, oracle.DATA).filter("subject >= 7").repartition(parts)
    mask = thresholds.absolute_mask(F.col("residual"), 0.15)
    found = {r["subject"]: round(r["dice"], 6) for r in metrics.overlap(rows, ["subject"], mask, F.col("gt") > 0).collect()}
    assert found == {7: 0.515213, 8: 0.510424, 9: 0.525413}


def test_metrics_read_only_the_columns_they_need(spark):
    plan = frames_plan(spark)
    assert "ReadSchema: struct<n_chars:bigint,doc_id" not in plan
    assert "text" not in plan


def frames_plan(spark):
    frame = catalog.QUERIES["roc_pr_auc"](spark, oracle.DATA)
    return frame._jdf.queryExecution().executedPlan().toString()
