"""Read queries over the serving tables, for one tenant or for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesflow.operators.health import seed_settings
from salesflow.operators.keyed import flag_exists, missing_keys, page, page_per_key, top_n
from salesflow.operators.merge import upsert
from salesflow.operators.search import matches
from salesflow.plans.selection import BASELINE
from salesflow.schemas import SERIES
from salesflow.session import materialize

MIN_HISTORY_DAYS = 60
HORIZONS = (7, 14, 30)
MAX_REQUESTED = 10
ASIN_CAP = 10


def tenant_view(df: DataFrame, tenant: str, column: str = "user_id") -> DataFrame:
    """Rows of one tenant."""
    return df.filter(F.col(column) == tenant)


def visible_to(df: DataFrame, viewers: DataFrame, column: str = "user_id") -> DataFrame:
    """Rows owned by any of the viewing tenants."""
    return df.join(viewers.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def latest_run(forecasts: DataFrame) -> DataFrame:
    """Newest run of each tenant; equal times are decided by the run id."""
    newest = forecasts.groupBy("user_id").agg(F.max(F.struct("generated_at", "model_run_id")).alias("_r"))
    return newest.select("user_id", "_r.model_run_id", "_r.generated_at")


def any_degraded(health: DataFrame) -> Column:
    """Whether any feed is stale or degraded, as a scalar subquery."""
    return health.agg(F.coalesce(F.bool_or(F.col("status").isin("stale", "degraded")), F.lit(False))).scalar()


def insufficient(products: DataFrame, min_days: int = MIN_HISTORY_DAYS) -> DataFrame:
    return products.filter(F.coalesce("sales_days", F.lit(0)) < min_days)


def current_points(forecasts: DataFrame, requests: DataFrame, as_of: Column, newest: DataFrame) -> DataFrame:
    """Points of the newest run of each requesting tenant up to the requested horizon."""
    wanted = requests.join(newest, "user_id")
    points = forecasts.drop("generated_at").join(wanted, ["user_id", "sku", "model_run_id"])
    return points.filter(F.col("forecast_date") <= F.date_add(as_of, F.col("horizon")))


def series_flat(requests: DataFrame, forecasts: DataFrame, health: DataFrame, as_of: Column, newest: DataFrame | None = None) -> DataFrame:
    """One row per requested series and forecast day; a series without points keeps one row.

    ``requests``: user_id, position, sku, horizon, and whatever else tells requests apart. ``newest`` is ``latest_run`` of the
    forecasts where the caller has it already.
    """
    newest = latest_run(forecasts) if newest is None else newest
    keys = [c for c in requests.columns if c != "horizon"]
    points = current_points(forecasts, requests, as_of, newest).select(
        *keys, "forecast_date", "yhat", "yhat_lower", "yhat_upper", "model_version", "mape_backtest")
    rows = requests.join(points, keys, "left").join(newest, "user_id")
    version = F.coalesce("model_version", F.lit(BASELINE))
    return rows.withColumn("_outage", any_degraded(health)).select(
        *keys, "model_run_id", "generated_at", version.alias("model_version"), "mape_backtest",
        (F.col("_outage") | F.startswith(version, F.lit(BASELINE))).alias("degraded"),
        "forecast_date", "yhat", "yhat_lower", "yhat_upper")


def assemble_series(requests: DataFrame, forecasts: DataFrame, factors: DataFrame, health: DataFrame,
                    as_of: Column, newest: DataFrame | None = None) -> DataFrame:
    """One row per requested series with nested points and factors.

    Points of a series are bounded by the horizon and factors by five, so the arrays stay short. They are made once for a series and
    horizon, however many requests name it.
    """
    newest = latest_run(forecasts) if newest is None else newest
    asked = requests.select(*SERIES, "horizon", F.col("horizon").alias("_days")).distinct()
    flat = series_flat(asked, forecasts, health, as_of, newest)
    point = F.when(F.col("forecast_date").isNotNull(), F.struct(
        F.col("forecast_date").alias("date"), "yhat", "yhat_lower", "yhat_upper"))
    series = flat.groupBy(*SERIES, "_days", "model_run_id", "generated_at").agg(
        F.max_by("model_version", "forecast_date").alias("_version"), F.max("model_version").alias("_any"),
        F.max_by("mape_backtest", "forecast_date").alias("mape_backtest"), F.bool_or("degraded").alias("degraded"),
        F.array_sort(F.collect_list(point)).alias("points"))
    series = series.withColumn("model_version", F.coalesce("_version", "_any")).drop("_version", "_any")
    wanted = requests.select(*SERIES).distinct().join(newest.select("user_id", "model_run_id"), "user_id")
    shown = top_n(factors.join(wanted, [*SERIES, "model_run_id"]), [*SERIES, "model_run_id"],
                  [F.desc("importance"), F.col("factor")], 5)
    lists = shown.groupBy(*SERIES, "model_run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "factor", "importance", "direction"))),
        lambda x: F.struct(x["factor"].alias("factor"), x["importance"].alias("importance"),
                           x["direction"].alias("direction"))).alias("factors"))
    # Written, so that its size is known: a small table is broadcast and requests stay where they are.
    series = materialize(series.join(lists, [*SERIES, "model_run_id"], "left"), "series")
    q, a = requests.alias("q"), series.alias("a")
    met = F.expr("q.user_id = a.user_id AND q.sku <=> a.sku AND q.horizon <=> a._days")
    return q.join(a, met).select(*[f"q.{c}" for c in requests.columns if c != "horizon"], *[
        f"a.{c}" for c in series.columns if c not in (*SERIES, "_days")])


def judge_requests(requests: DataFrame, products: DataFrame, forecasts: DataFrame, min_days: int = MIN_HISTORY_DAYS) -> DataFrame:
    """Requests (request_id, user_id, skus, horizon) with ``outcome`` and ``named``, the SKUs it is about.

    ``forecasts`` tells which tenants have any, so the newest runs do. The outcome is ``ok`` or the first of: ``sku_count`` (blank ones left out, none or more than ten), ``horizon``,
    ``sku_not_found``, ``insufficient_history``, ``no_run``. Only lists within the bound are taken apart.
    """
    asked = requests.withColumn("skus", F.filter(F.transform("skus", lambda c: F.trim(c)), lambda c: c != ""))
    form = F.when(~F.size("skus").between(1, MAX_REQUESTED), "sku_count").when(~F.col("horizon").isin(*HORIZONS), "horizon")
    asked = asked.withColumn("_form", form)
    each = asked.filter("_form is null").select("request_id", "user_id", F.posexplode("skus").alias("_at", "sku"))
    facts = each.join(products.select(*SERIES, F.coalesce("sales_days", F.lit(0)).alias("_days")), SERIES, "left")
    named = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("_at", "sku")))), lambda x: x["sku"])
    lacks = facts.groupBy("request_id").agg(
        named(F.col("_days").isNull()).alias("_unknown"), named(F.col("_days") < min_days).alias("_short"))
    ran = forecasts.select("user_id").distinct().withColumn("_ran", F.lit(True))
    rows = asked.join(lacks, "request_id", "left").join(ran, "user_id", "left")
    outcome = F.coalesce("_form", F.when(F.size("_unknown") > 0, "sku_not_found"), F.when(F.size("_short") > 0, "insufficient_history"),
                         F.when(F.col("_ran").isNull(), "no_run"), F.lit("ok"))
    return rows.select(
        "request_id", "user_id", "skus", "horizon", outcome.alias("outcome"),
        F.when(outcome == "sku_not_found", F.col("_unknown")).when(outcome == "insufficient_history", F.col("_short")).alias("named"))


def forecast_responses(requests: DataFrame, tables: dict[str, DataFrame], as_of: Column, min_days: int = MIN_HISTORY_DAYS) -> DataFrame:
    """One row per request: its outcome, and for good ones the run, when it was made, the series in the order asked for, and
    the health of all feeds. Tables of other tenants take no part: every join is on the tenant.
    """
    newest = materialize(latest_run(tables["forecasts"]), "runs")  # a row per tenant
    requests = materialize(requests, "requests")  # read twice by the judgement, and that by what follows
    judged = materialize(judge_requests(requests, tables["products"], newest, min_days), "judged").repartition("request_id")
    good = judged.filter("outcome = 'ok'").select(
        "request_id", "user_id", "horizon", F.posexplode("skus").alias("position", "sku"))
    series = assemble_series(good, tables["forecasts"], tables["forecast_factors"], tables["signal_status"], as_of, newest)
    answers = series.groupBy("request_id", "model_run_id", "generated_at").agg(F.array_sort(F.collect_list(F.struct(
        "position", "sku", "model_version", "mape_backtest", "degraded", "points", F.coalesce(
            "factors", F.array().cast(series.schema["factors"].dataType)).alias("factors")))).alias("series"))
    status = tables["signal_status"]
    known = {"signal": "string", "status": "string", "last_success_at": "timestamp", "quota_note": "string"}
    fields = [(F.col(c) if c in status.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items()]
    feeds = status.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("h")).scalar()
    return judged.select("request_id", "user_id", "outcome", "named").join(answers, "request_id", "left").withColumn(
        "signal_health", F.when(F.col("outcome") == "ok", feeds))


def search_products(products: DataFrame, text: str | None) -> DataFrame:
    """Products whose name contains the pattern, in any case; ``search.search_names`` does it by an index."""
    return products.filter(matches("product_name", text)) if text else products


def products(tables: dict[str, DataFrame], tenant: str, search: str | None = None, limit: int = 50,
             offset: int = 0) -> DataFrame:
    """One page of a tenant's products with has_forecast."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    own = search_products(tenant_view(tables["products"], tenant), search)
    shown = page(own, [F.col("sku")], offset, limit)
    return flag_exists(shown, tenant_view(tables["forecasts"], tenant), SERIES, "has_forecast").orderBy("sku")


def products_all(product_table: DataFrame, forecast_table: DataFrame, search: str | None = None, limit: int = 50,
                 offset: int = 0) -> DataFrame:
    """The same page for every tenant at once."""
    shown = page_per_key(search_products(product_table, search), ["user_id"], [F.col("sku")], offset, limit)
    return flag_exists(shown, forecast_table, SERIES, "has_forecast")


def sales(tables: dict[str, DataFrame], tenant: str, sku: str, start: Column | None = None, end: Column | None = None,
          limit: int = 200) -> DataFrame:
    """Sales days of one product in a range, oldest first."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    rows = tenant_view(tables["sales_daily"], tenant).filter(F.col("sku") == sku)
    return sales_between(rows, start, end).orderBy("date").limit(limit)


def sales_between(rows: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    if start is not None:
        rows = rows.filter(F.col("date") >= start)
    if end is not None:
        rows = rows.filter(F.col("date") <= end)
    return rows


def uploads(tables: dict[str, DataFrame], tenant: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest uploads first."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    return page(tenant_view(tables["uploads"], tenant), [F.desc("created_at"), F.col("id")], offset, limit)


def upload(tables: dict[str, DataFrame], tenant: str, upload_id: str) -> DataFrame:
    """One upload of a tenant by id; no row when it is another tenant's."""
    return tenant_view(tables["uploads"], tenant).filter(F.col("id") == upload_id)


def calendar_list(tables: dict[str, DataFrame], tenant: str) -> DataFrame:
    return tenant_view(tables["calendar_events"], tenant).orderBy("start_date", "id")


def asin_list(tables: dict[str, DataFrame], tenant: str) -> DataFrame:
    return tenant_view(tables["tracked_asins"], tenant).orderBy("created_at", "asin")


def signal_settings(settings: DataFrame, patch: DataFrame | None = None) -> DataFrame:
    """Toggles after a patch of (user_id, signal, enabled); missing values change nothing."""
    if patch is None:
        return settings
    return upsert(settings, patch.filter("enabled is not null"), ["user_id", "signal"])


def signal_status(status: DataFrame) -> DataFrame:
    """Health of all feeds; readable by every tenant."""
    return status.select("signal", "status", "last_success_at", "last_error")


def health_summary(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if(F.col("status") == "live").alias("live"), F.count(F.lit(1)).alias("feeds"))


def upsert_profile(profiles: DataFrame, settings: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles after an onboarding save, and the toggles seeded for those tenants."""
    saved = upsert(profiles, changed.withColumn("onboarding_complete", F.lit(True)), ["id"])
    return saved, seed_settings(changed.select(F.col("id").alias("user_id")), settings)


def sku_picker(product_table: DataFrame, selected: DataFrame, query: str = "", n: int = 20) -> DataFrame:
    """First products per tenant whose SKU or name contains the text and that are not selected yet."""
    word = query.strip().lower()
    rows = missing_keys(product_table, selected, SERIES)
    if word:
        rows = rows.filter(F.contains(F.lower("sku"), F.lit(word)) | F.contains(F.lower("product_name"), F.lit(word)))
    return top_n(rows, ["user_id"], [F.col("sku")], n)


def asin_quota(asins: DataFrame, cap: int = ASIN_CAP) -> DataFrame:
    used = asins.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    return used.withColumns({"cap": F.lit(cap).cast("bigint"),
                             "label": F.concat(F.col("used").cast("string"), F.lit(f" of {cap} used"))})
