"""Declared schemas, as DDL: serving tables, medallion layers and feed payloads."""

from __future__ import annotations

SERIES = ["user_id", "sku"]
SERIES_DAY = ["user_id", "sku", "date"]

# Serving tables
PROFILES = ("id string, country_code string, city string, latitude double, longitude double, "
                 "timezone string, currency string, onboarding_complete boolean")
PRODUCTS = ("user_id string, sku string, product_name string, category string, "
                 "sales_days int, last_sale_date date")
SALES_DAILY = ("user_id string, sku string, date date, quantity decimal(12,2), "
                    "revenue decimal(14,2), price decimal(12,2), promo_flag boolean, source string")
UPLOADS = ("id string, user_id string, kind string, file_path string, status string, row_count int, "
                "error_report array<struct<row:int,field:string,message:string>>, created_at timestamp")
CALENDAR_EVENTS = ("id bigint, user_id string, label string, start_date date, end_date date")
SIGNAL_SETTINGS = ("user_id string, signal string, enabled boolean")
TRACKED_ASINS = ("user_id string, asin string, created_at timestamp")
FORECASTS = ("user_id string, sku string, forecast_date date, model_run_id string, model_version string, "
                  "yhat decimal(14,2), yhat_lower decimal(14,2), yhat_upper decimal(14,2), "
                  "mape_backtest decimal(6,2), generated_at timestamp")
FORECAST_FACTORS = ("user_id string, sku string, model_run_id string, factor string, "
                         "importance decimal(6,4), direction string")
SIGNAL_STATUS = ("signal string, status string, last_success_at timestamp, last_error string, "
                      "calls_today int, quota_note string")
SIGNAL_EVENTS = ("source string, entity_key string, observed_at date, ingested_at timestamp, payload string")

# Bronze, Silver, Gold
ENVELOPE = ("source string, entity_key string, observed_at string, ingested_at string, "
                 "schema_version int, payload string")
BRONZE = ("source string, entity_key string, observed_at date, ingested_at timestamp, "
               "schema_version int, payload string, seq bigint")
SALES_RAW = ("user_id string, sku string, date date, quantity double, revenue double, price double, "
                  "promo_flag boolean, ingested_at timestamp, seq bigint")
SILVER_SALES = ("user_id string, sku string, date date, quantity double, revenue double, price double, "
                     "promo_flag boolean, gap_flag boolean")
SILVER_CALENDAR = ("user_id string, date date, is_holiday boolean, days_to_holiday int, is_school_break boolean")
SILVER_EVENTS = ("user_id string, date date, event_count bigint, large_event_count bigint, "
                      "categories array<string>")
SILVER_WEATHER = ("user_id string, date date, temp_avg double, precip_mm double")
SILVER_TRENDS = ("user_id string, date date, interest double")
SILVER_MACRO = ("series string, date date, value double")
SILVER_MARKETPLACE = ("user_id string, asin string, date date, price double, bsr bigint")
GOLD_FEATURES = (
    "user_id string, sku string, date date, quantity double, dow int, month int, is_weekend boolean, "
    "promo_flag boolean, gap_flag boolean, lag_1 double, lag_7 double, lag_14 double, lag_28 double, "
    "roll_mean_7 double, roll_mean_28 double, is_holiday boolean, days_to_holiday int, is_school_break boolean, "
    "temp_avg double, precip_mm double, trends_interest double, event_count bigint, large_event_count bigint")
GOLD_METRICS = (
    "model_run_id string, user_id string, sku string, model_version string, mape_backtest double, "
    "mape_baseline double, chosen string, external_null_frac double, artifact_path string, trained_at timestamp, "
    "factors array<struct<factor:string,importance:double,direction:string>>")

# Payloads of the six feeds, as carried inside the envelope
PAYLOADS = {
    "weather": "user_id string, temp_max double, temp_min double, temp_avg double, precip_mm double, "
               "snowfall_mm double, weather_code int, stale boolean",
    "holidays": "country_code string, local_name string, name string, global boolean, counties array<string>, "
                "stale boolean",
    "trends": "user_id string, category string, keyword string, interest double, stale boolean",
    "macro": "series string, value double, stale boolean",
    "events": "user_id string, event_id string, name string, category string, large_venue boolean, stale boolean",
    "marketplace": "user_id string, asin string, price double, bsr bigint, title string, stale boolean",
    "sales_csv": "user_id string, upload_id string, sku string, date date, quantity double, revenue double, "
                 "price double, promo_flag boolean",
    "health": "source string, signal string, status string, last_success_at timestamp, error string, "
              "reported_at timestamp",
}

# The model features, in the order that breaks ties between equal importances.
FEATURES = [
    "lag_1", "lag_7", "lag_14", "lag_28",
    "roll_mean_7", "roll_mean_28",
    "dow", "month", "is_weekend", "promo_flag",
    "is_holiday", "days_to_holiday", "is_school_break",
    "temp_avg", "precip_mm", "trends_interest", "event_count", "large_event_count",
]
MOMENTUM_FEATURES = FEATURES[:6]
EXTERNAL_FEATURES = ["temp_avg", "trends_interest", "days_to_holiday", "event_count"]

# The toggles a tenant starts with.
SIGNALS = ["weather", "holidays", "trends", "macro", "events", "marketplace"]
OFF_BY_DEFAULT = ["marketplace"]

# Hours a feed stays fresh, and hours its last values may be replayed after that.
FEED_LIMITS = {
    "weather": (26, 24),
    "holidays": (30 * 24, 365 * 24),
    "trends": (12, 7 * 24),
    "macro": (2 * 24, 90 * 24),
    "events": (26, 7 * 24),
    "marketplace": (26, 7 * 24),
}
