import pytest

import __spark_entry__ as entry
from orrery.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_ivf_recall(spark, sf_dir):
    assert catalog.QUERIES["ann_ivf_recall"](spark, sf_dir).first()[0] >= 0.9


def test_entry(spark):
    assert entry.entry(spark).columns == ["vec_id", "score"]
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_topk_plan_keeps_top_rows_per_task(spark, sf_dir):
    plan = catalog.QUERIES["exact_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["filter_only_search"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,fr)" in plan
    plan = catalog.QUERIES["filtered_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan
    plan = catalog.QUERIES["filtered_topk_or"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(label,3),EqualTo(label,5))" in plan
