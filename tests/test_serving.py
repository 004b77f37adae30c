import pytest
from pyspark.sql import functions as F

from rows import table
from salesflow.plans import serving


def as_of():
    return F.lit("2026-07-26").cast("date")


@pytest.fixture
def tables(frame):
    def fc(run, day, yhat, sku="MUG", made="2026-07-26", version="boosted:1", user="u1"):
        return (user, sku, day, run, version, yhat, yhat - 1, yhat + 1, 11.5, made)

    return {
        "products": frame([("u1", "MUG", "Ceramic Mug", 120), ("u1", "TEE", "Logo Tee", 120), ("u1", "NEW", "New Cup", 30),
                           ("u2", "MUG", "Other Mug", 120)],
                          "user_id string, sku string, product_name string, sales_days int"),
        "forecasts": frame([fc("nightly-20260725", "2026-07-27", 99.0, made="2026-07-25"), fc("nightly-20260726", "2026-07-27", 42.0),
                            fc("nightly-20260726", "2026-07-28", 43.0), fc("nightly-20260726", "2026-08-20", 44.0),
                            fc("nightly-20260726", "2026-07-27", 7.0, user="u2")],
                           "user_id string, sku string, forecast_date date, model_run_id string, model_version string, yhat double, "
                           "yhat_lower double, yhat_upper double, mape_backtest double, generated_at timestamp"),
        "forecast_factors": frame([("u1", "MUG", "nightly-20260726", f"f{i}", i / 10, "up") for i in range(7)],
                                  "user_id string, sku string, model_run_id string, factor string, importance double, direction string"),
        "signal_status": frame([("weather", "live"), ("trends", "live")], "signal string, status string"),
        "sales_daily": frame([("u1", "MUG", f"2026-07-{d:02d}", 1.0) for d in range(1, 11)] + [("u2", "MUG", "2026-07-01", 9.0)],
                             "user_id string, sku string, date date, quantity double"),
    }


def ask(frame, tables, *requests, **options):
    rows = frame([(i, u, list(k), h) for i, (u, k, h) in enumerate(requests)], "request_id int, user_id string, skus array<string>, horizon int")
    return {r["request_id"]: r for r in serving.forecast_responses(rows, tables, as_of(), **options).collect()}


def test_only_the_newest_run_is_served(tables, frame):
    got = ask(frame, tables, ("u1", ["MUG"], 7))[0]
    series = got["series"][0]
    assert got["outcome"] == "ok" and got["generated_at"] is not None and [p["yhat"] for p in series["points"]] == [42.0, 43.0]
    assert series["degraded"] is False and series["model_version"] == "boosted:1" and series["mape_backtest"] == 11.5
    assert [f["factor"] for f in series["factors"]] == ["f6", "f5", "f4", "f3", "f2"]
    assert [h["status"] for h in got["signal_health"]] == ["live"] * len(got["signal_health"]) != []


def test_requested_order_and_series_without_points(tables, frame):
    got = ask(frame, tables, ("u1", ["TEE", " ", "MUG"], 30), ("u1", ["MUG"], 7))
    series = got[0]["series"]
    assert [r["sku"] for r in series] == ["TEE", "MUG"] and len(got[1]["series"]) == 1
    assert series[0]["points"] == [] and series[0]["degraded"] is True and series[0]["model_version"] == "seasonal-naive"
    assert len(series[1]["points"]) == 3


def test_series_are_made_once_however_many_requests_name_them(tables, frame, monkeypatch):
    sizes, keep = {}, serving.materialize

    def counted(df, name, *more):
        out = keep(df, name, *more)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(serving, "materialize", counted)
    got = ask(frame, tables, *[("u1", ["MUG", "TEE", "MUG"], h) for h in (7, 30)] * 20)
    assert sizes["series"] == 4 and len(got) == 40
    for i, r in got.items():
        assert [x["sku"] for x in r["series"]] == ["MUG", "TEE", "MUG"] and [x["position"] for x in r["series"]] == [0, 1, 2]
        assert [len(x["points"]) for x in r["series"]] == ([2, 0, 2] if i % 2 == 0 else [3, 0, 3])


def test_outage_degrades(tables, frame):
    tables["signal_status"] = frame([("trends", "stale")], "signal string, status string")
    assert ask(frame, tables, ("u1", ["MUG"], 7))[0]["series"][0]["degraded"] is True


def test_refusals(tables, frame):
    got = ask(frame, tables, ("u1", [], 7), ("u1", [str(i) for i in range(11)], 7), ("u1", ["MUG"], 21), ("u1", ["B", "MUG", "A"], 7),
              ("u1", ["NEW", "MUG"], 7), ("u3", ["MUG"], 7))
    assert [(got[i]["outcome"], got[i]["named"]) for i in range(6)] == [
        ("sku_count", None), ("sku_count", None), ("horizon", None), ("sku_not_found", ["B", "A"]), ("insufficient_history", ["NEW"]),
        ("sku_not_found", ["MUG"])]
    assert all(r["series"] is None and r["signal_health"] is None for r in got.values())


def test_no_run_yet(tables, frame):
    tables["forecasts"] = tables["forecasts"].filter("user_id = 'u2'")
    assert ask(frame, tables, ("u1", ["MUG"], 7))[0]["outcome"] == "no_run"


def test_products(tables):
    assert table(serving.products(tables, "u1"), "sku", "has_forecast") == [("MUG", True), ("NEW", False), ("TEE", False)]
    assert table(serving.products(tables, "u1", search="mUg"), "sku") == [("MUG",)]
    assert table(serving.products(tables, "u1", limit=1, offset=1), "sku") == [("NEW",)]


def test_sales_range(tables):
    got = serving.sales(tables, "u1", "MUG", F.lit("2026-07-03").cast("date"), F.lit("2026-07-08").cast("date"), 4)
    assert table(got, "date") == [("2026-07-03",), ("2026-07-04",), ("2026-07-05",), ("2026-07-06",)]


def test_one_tenant_never_sees_another(tables, frame):
    for name in ("products", "forecasts", "forecast_factors", "sales_daily"):
        seen = serving.tenant_view(tables[name], "u2").select("user_id").distinct().collect()
        assert [r[0] for r in seen] in ([], ["u2"])
    assert serving.sales(tables, "u2", "MUG").count() == 1
    assert serving.products(tables, "u2").count() == 1
    assert ask(frame, tables, ("u2", ["MUG"], 7), min_days=0)[0]["series"][0]["points"][0]["yhat"] == 7.0


def test_settings_patch_ignores_missing_values(frame):
    schema = "user_id string, signal string, enabled boolean"
    got = serving.signal_settings(frame([("u", "trends", True), ("u", "macro", True)], schema),
                                  frame([("u", "trends", False), ("u", "macro", None)], schema))
    assert table(got) == [("u", "macro", True), ("u", "trends", False)]


def test_profile_save_keeps_other_columns_and_seeds(frame):
    profiles = frame([("a", "US", "UTC", False)], "id string, country_code string, timezone string, onboarding_complete boolean")
    changed = frame([("a", "IN"), ("b", "DE")], "id string, country_code string")
    saved, toggles = serving.upsert_profile(profiles, frame([], "user_id string, signal string, enabled boolean"), changed)
    assert table(saved) == [("a", "IN", "UTC", True), ("b", "DE", None, True)]
    assert toggles.count() == 12 and toggles.filter("signal = 'marketplace' and enabled").count() == 0


def test_picker_and_quota(frame):
    products = frame([("u", "A1", "Mug"), ("u", "B2", "tee a"), ("u", "C3", "cup")], "user_id string, sku string, product_name string")
    chosen = frame([("u", "A1")], "user_id string, sku string")
    assert table(serving.sku_picker(products, chosen, " A "), "sku") == [("B2",)]
    assert table(serving.asin_quota(frame([("u", "x"), ("u", "y")], "user_id string, asin string")), "label") == [("2 of 10 used",)]
