"""Every registered query against its comparison SQL, and the shape of its plan."""

import os

import pytest

from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from salesflow.catalog.registry import ORACLES, QUERIES
from salesflow.schemas import FEATURES
from tools.check import canon, rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"
COMPARED = sorted(ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("NestedLoop", "CartesianProduct", "EvalPython"):
        assert bad not in plan
    want = sql_rows(duck, oracle_sql()[name])
    assert rows_of(df.toArrow()) == rows_of(want)


@pytest.mark.parametrize("name, keys", [
    ("quantile_forecast", ["user_id", "sku", "date"]), ("recursive_forecast", ["user_id", "sku"]),
    ("nightly_run", ["user_id", "sku", "forecast_date", "model_run_id"])])
def test_forecasts_have_one_ordered_band_a_day(spark, name, keys):
    """Model values have no SQL; what must hold of any of them does."""
    rows = queries()[name](spark, FOLDER)
    day = next(c for c in rows.columns if c in ("date", "forecast_date"))
    keys = list(dict.fromkeys([*keys, day]))
    rows = rows.select(*keys, *[F.col(c).cast("double") for c in ("yhat", "yhat_lower", "yhat_upper")]).toPandas()
    assert len(rows) and not rows.duplicated(keys).any()
    assert ((0 <= rows.yhat_lower) & (rows.yhat_lower <= rows.yhat) & (rows.yhat <= rows.yhat_upper)).all()


def test_importances_are_shares_of_all_features(spark):
    rows = queries()["feature_importance"](spark, FOLDER)
    per = rows.groupBy("user_id", "sku").agg(F.sum("importance").alias("all"), F.collect_set("factor").alias("f")).collect()
    assert per and all(abs(r["all"] - 1) < 1e-6 and set(r["f"]) == set(FEATURES) for r in per)


def test_queries_without_sql_are_the_models():
    assert set(QUERIES) - set(ORACLES) == {"nightly_run", "recursive_forecast", "quantile_forecast", "feature_importance"}


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert canon(float("nan")) == "nan"


def test_entry(spark):
    assert entry(spark).limit(5).count() == 5


def test_features_need_one_shuffle_per_key_for_lags(spark):
    """Lags, means and gap flags share one window and so one exchange on the series."""
    plan = queries()["rolling_means"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["sales_span"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line)
    assert "l_tax" not in scan and "l_extendedprice" not in scan and "PushedFilters: [IsNotNull" in scan
