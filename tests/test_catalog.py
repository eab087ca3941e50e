"""Registered queries against their SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from strandline.functions import fuzzy
from strandline.plans import catalog

from conftest import SF


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_sql(same, name):
    same(driver.queries()[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert driver.queries()[name](spark, SF).count() > 0


def test_fuzzy_names_scores_whole_nations(spark, duck):
    """Every customer with a supplier in its nation, with the closest of all of them."""
    pairs = duck.sql("SELECT c_custkey, s_name, lower(s_name), lower(c_name), lower(c_mktsegment) FROM customer JOIN supplier ON c_nationkey = s_nationkey").fetchall()
    scores = {(key, name): (fuzzy.partial_ratio(v, n) + fuzzy.partial_ratio(v, o)) / 2 for key, name, v, n, o in pairs}
    best = {key: max(s for (k, _), s in scores.items() if k == key) for key, _ in scores}
    want = {(key, name): round(s, 6) for (key, name), s in scores.items() if s == best[key]}
    got = {(r.c_custkey, r.s_name): r.score for r in catalog.QUERIES["fuzzy_names"](spark, SF).collect()}
    assert got == pytest.approx(want) and {k for k, _ in got} == {p[0] for p in pairs}


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_order_of_rows_does_not_matter(spark, tmp_path):
    for name in ("events", "pages", "orders", "customer"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(5).sortWithinPartitions(F.rand(1)).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("mode_per_key", "latest_per_key", "landing_pick", "upsert_conflicts", "top_links", "ordered_distinct", "progress_state"):
        rows = lambda d: sorted(map(str, catalog.QUERIES[name](spark, d).collect()))
        assert rows(SF) == rows(str(tmp_path)), name
