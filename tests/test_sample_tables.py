from datetime import datetime

from rows import table
from salesflow.operators import silver
from salesflow.session import scratch_path
from salesflow.sources.sample_tables import SALES_ORDER, TABLES, Sample

T1, T2 = datetime(2026, 7, 1), datetime(2026, 7, 2)
DAY = datetime(2026, 7, 5)
ROWS = {
    "nation": [(0, "N", 3)], "supplier": [(1, "S", 0, 1.0), (2, "T", 0, 1.0)],
    "part": [(1, "big", "B#1", "PROMO", 1, 5.0), (2, "small", "B#1", "STD", 1, 6.0), (3, "odd", None, "STD", 1, 7.0),
             (4, "twice", "B#2", "STD", 1, 8.0), (4, "twice", "B#3", "STD", 1, 9.0)],
    "orders": [(1, 1, "O", 1.0, T1, "p"), (2, 1, "O", 1.0, T2, "p"), (3, 1, "O", 1.0, None, "p")],
    "lineitem": [
        (1, 1, 1, 1, 10.0, 100.0, 0.5, 0.0, "N", "O", DAY), (2, 2, 2, 1, 20.0, 100.0, 0.0, 0.0, "N", "O", DAY),
        (2, 2, 1, 1, 21.0, 100.0, 0.0, 0.0, "N", "O", DAY),  # the same line again with more
        (2, 1, 1, 1, 99.0, 100.0, 0.0, 0.0, "N", "O", datetime(2026, 7, 6)), (2, 3, 1, None, 5.0, 1.0, 0.0, 0.0, "N", "O", None),
        (3, 4, 1, 2, -7.0, 1.0, 0.0, 0.0, "N", "O", DAY), (9, 1, 1, 1, 50.0, 1.0, 0.0, 0.0, "N", "O", DAY)],
}


def sample(spark):
    folder = scratch_path(spark, "sample")
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return Sample(spark, folder)


def test_newest_rows_by_keys_are_those_of_all_rows(spark):
    s = sample(spark)
    raw = s.sales_raw().drop("product_name", "category", "part_key")
    want = table(silver.dedupe_latest(raw, SALES_ORDER))
    assert len(want) == 5 and table(silver.dedupe_latest(s.sales_newest(), SALES_ORDER)) == want
    assert table(s.silver_sales()) == table(silver.to_silver(raw, SALES_ORDER))
    assert table(s.products(), "user_id", "sku", "product_name", "sales_days") == [
        ("r3", "B#1", "big", 2), ("r3", "B#2", "twice", 1), ("r3", "B#3", "twice", 1), ("r3", None, "odd", 0)]
    plan = s.sales_newest()._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan  # values are looked up for the newest lines only, orders are not met again
