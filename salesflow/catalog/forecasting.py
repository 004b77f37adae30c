"""Queries: baseline, backtest, selection, factors, context and forecast rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesflow.catalog.features import gold, rounded
from salesflow.catalog.registry import query
from salesflow.functions.scalars import batch_id, middle_of_three
from salesflow.operators import calendar
from salesflow.operators.keyed import top_n
from salesflow.plans import baseline, factors, forecast, selection
from salesflow.plans.nightly import run_summary
from salesflow.schemas import FEATURES, MOMENTUM_FEATURES, SERIES

BANDS = ["yhat", "yhat_lower", "yhat_upper"]

# Holdout views: the newest sixty rows of each series, and the baseline fitted on the rows before them.
BACKTEST = {
    "held": "SELECT r.*, g.* EXCLUDE (user_id, sku, date, quantity) FROM ranked r JOIN gold g USING (user_id, sku, date)",
    "bt_stats": """
        SELECT user_id, sku, count(*) FILTER (rd > 60) AS n, coalesce(avg(quantity) FILTER (rd > 60 AND rd <= 88), 0) AS t,
               least(count(*), 60) AS m FROM ranked GROUP BY user_id, sku""",
    "bt_points": """
        SELECT h.user_id, h.sku, h.quantity AS actual,
               greatest(coalesce(r.quantity, s.t), 0) AS yhat
        FROM ranked h JOIN bt_stats s USING (user_id, sku)
        LEFT JOIN ranked r ON r.user_id = h.user_id AND r.sku = h.sku AND r.rd > 60
             AND r.rn = CASE WHEN s.n >= 7 THEN s.n - 7 + (s.m - h.rd) % 7 + 1 ELSE (s.n + s.m - h.rd) % 7 + 1 END
        WHERE h.rd <= 60""",
    "bt_nulls": """
        SELECT user_id, sku, sum(CAST(temp_avg IS NULL AS INTEGER) + CAST(trends_interest IS NULL AS INTEGER)
               + CAST(days_to_holiday IS NULL AS INTEGER)) / (4.0 * count(*)) AS nf
        FROM held WHERE rd <= 60 GROUP BY user_id, sku""",
    "bt": """
        SELECT p.user_id, p.sku, max(s.n) AS train_rows,
               100 * avg(abs(actual - yhat) / abs(actual)) FILTER (actual <> 0) AS mape_baseline,
               CAST(any_value(b.nf) AS DOUBLE) AS external_null_frac
        FROM bt_points p JOIN bt_stats s USING (user_id, sku) JOIN bt_nulls b USING (user_id, sku)
        GROUP BY p.user_id, p.sku""",
}

# Importance table: rows of a series on which the feature is present and not zero.
WEIGHTS = {
    "weights": " UNION ALL ".join(
        f"""SELECT user_id, sku, '{f}' AS factor, {i} AS pos,
            CAST(count(*) FILTER (coalesce(CAST({f} AS DOUBLE), 0) <> 0) AS DOUBLE) AS importance
            FROM gold GROUP BY user_id, sku""" for i, f in enumerate(FEATURES)),
    "dirs": " UNION ALL ".join(
        f"""SELECT user_id, sku, '{f}' AS factor,
            CASE WHEN count(x) < 10 THEN 'neutral'
                 WHEN var_pop(x) = 0 OR var_pop(y) = 0 THEN 'neutral'
                 WHEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) > 0.05 THEN 'up'
                 WHEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) < -0.05 THEN 'down' ELSE 'neutral' END AS direction
            FROM (SELECT user_id, sku, CAST({f} AS DOUBLE) AS x, CASE WHEN {f} IS NOT NULL THEN quantity END AS y FROM gold)
            GROUP BY user_id, sku""" for f in FEATURES),
}


def daily(s):
    return s.silver_sales().select(*SERIES, "date", "quantity")


def start(s):
    return F.date_add(s.as_of(), 1)


def stored_gold(s):
    """Gold features on storage, for plans that read them twice."""
    return s.stored("gold", lambda: gold(s))


def importances(s, rows=None):
    """Stand-in importance table with one weight per series and feature."""
    rows = gold(s) if rows is None else rows
    wide = rows.groupBy(*SERIES).agg(*[
        F.count_if(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) != 0).cast("double").alias(f)
        for f in FEATURES])
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("importance")) for f in FEATURES])
    return wide.select(*SERIES, F.explode(entries).alias("e")).select(*SERIES, "e.factor", "e.importance")


@query("tail_mean", "SELECT user_id, sku, round(tail_mean, 4) AS tail_mean FROM naive_stats")
def _(s):
    return rounded(baseline.tail_mean(daily(s)), "tail_mean")


@query("weekly_sigma", "SELECT user_id, sku, round(sigma, 4) AS sigma FROM naive_stats")
def _(s):
    return rounded(baseline.weekly_sigma(daily(s)), "sigma")


@query("seasonal_naive", """
    SELECT user_id, sku, date, round(yhat, 4) AS yhat, round(yhat_lower, 4) AS yhat_lower,
           round(yhat_upper, 4) AS yhat_upper FROM naive""")
def _(s):
    return rounded(baseline.seasonal_naive(daily(s), start(s), 30), *BANDS)


@query("train_test_split", """
    SELECT user_id, sku, date, quantity, rd <= 60 AS holdout FROM ranked""")
def _(s):
    return selection.split_holdout(daily(s)).drop("back")


def week_echo(s):
    """Each sales day with the quantity of seven rows earlier as its prediction."""
    rows = baseline.newest_first(daily(s))
    return rows.select(*SERIES, "quantity", F.col("_week_ago").alias("predicted")).filter("predicted is not null")


@query("mape", """
    SELECT user_id, sku, round(100 * avg(abs(quantity - week_ago) / abs(quantity)) FILTER (quantity <> 0), 4) AS mape
    FROM ranked WHERE week_ago IS NOT NULL GROUP BY user_id, sku""")
def _(s):
    return rounded(selection.mape(week_echo(s), SERIES, "quantity", "predicted"), "mape")


@query("rmse", """
    SELECT user_id, sku, round(sqrt(avg((quantity - week_ago) * (quantity - week_ago))), 4) AS rmse
    FROM ranked WHERE week_ago IS NOT NULL GROUP BY user_id, sku""")
def _(s):
    return rounded(selection.rmse(week_echo(s), SERIES, "quantity", "predicted"), "rmse")


@query("external_null_fraction", """
    SELECT user_id, sku, round(CAST(sum(CAST(temp_avg IS NULL AS INTEGER) + CAST(trends_interest IS NULL AS INTEGER)
           + CAST(days_to_holiday IS NULL AS INTEGER) + CAST(event_count IS NULL AS INTEGER)) AS DOUBLE)
           / (4.0 * count(*)), 4) AS external_null_frac FROM gold GROUP BY user_id, sku""")
def _(s):
    return rounded(selection.null_fraction(gold(s), SERIES), "external_null_frac")


@query("backtest", """
    SELECT user_id, sku, train_rows, round(mape_baseline, 4) AS mape_baseline,
           round(external_null_frac, 4) AS external_null_frac FROM bt""", BACKTEST)
def _(s):
    return rounded(selection.backtest_baseline(gold(s)), "mape_baseline", "external_null_frac")


def trial_errors(s):
    """Baseline error beside a trial model that is right to the tail mean of the history."""
    scored = selection.backtest_baseline(gold(s))
    trial = F.when(F.col("train_rows") >= 60, F.round(F.col("mape_baseline"), 0))
    return scored.select(*SERIES, F.round("mape_baseline", 4).alias("mape_baseline"), trial.alias("mape_boosted"),
                         F.round(F.col("external_null_frac") / 1.5, 4).alias("external_null_frac"))


@query("choose_model", """
    SELECT *, CASE WHEN external_null_frac > 0.5 THEN 'seasonal-naive' WHEN mape_boosted IS NULL THEN 'seasonal-naive'
                   WHEN mape_baseline IS NULL THEN 'boosted' WHEN mape_boosted < mape_baseline THEN 'boosted'
                   ELSE 'seasonal-naive' END AS chosen
    FROM (SELECT user_id, sku, round(mape_baseline, 4) AS mape_baseline,
                 CASE WHEN train_rows >= 60 THEN round(mape_baseline, 0) END AS mape_boosted,
                 round(external_null_frac / 1.5, 4) AS external_null_frac FROM bt)""", BACKTEST)
def _(s):
    return trial_errors(s).withColumn("chosen", selection.choose_model(
        F.col("mape_baseline"), F.col("mape_boosted"), F.col("external_null_frac")))


@query("factor_direction", "SELECT user_id, sku, factor, direction FROM dirs", WEIGHTS)
def _(s):
    return factors.directions(gold(s))


TOP = {**WEIGHTS, "top5": """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sku ORDER BY importance DESC, pos) AS rank
    FROM weights WHERE importance > 0 AND pos >= 6) WHERE rank <= 5"""}


@query("top_factors", """
    SELECT t.user_id, t.sku, t.factor,
           round(CAST(importance / sum(importance) OVER (PARTITION BY t.user_id, t.sku) AS DOUBLE), 4) AS importance,
           d.direction, CAST(rank AS INTEGER) AS rank
    FROM top5 t JOIN dirs d USING (user_id, sku, factor)""", TOP)
def _(s):
    rows = stored_gold(s)
    return factors.top_factors(importances(s, rows), rows)


@query("top_factors_per_sku", """
    SELECT user_id, sku, factor, round(CAST(importance AS DOUBLE), 4) AS importance, CAST(rank AS INTEGER) AS rank
    FROM top5""", TOP)
def _(s):
    shown = importances(s).filter((F.col("importance") > 0) & ~F.col("factor").isin(MOMENTUM_FEATURES))
    ranked = top_n(shown, SERIES, [F.desc("importance"), factors.feature_position(F.col("factor"))], 5, "rank")
    return rounded(ranked, "importance")


@query("factor_normalise", """
    SELECT user_id, sku, factor, round(CAST(importance / CASE WHEN total = 0 THEN 1 ELSE total END AS DOUBLE), 4)
           AS importance
    FROM (SELECT *, sum(importance) OVER (PARTITION BY user_id, sku) AS total FROM weights)""", WEIGHTS)
def _(s):
    return factors.normalise(importances(s), SERIES)


@query("crossing_guard", """
    SELECT user_id, sku, date, list_sort(a)[1] AS yhat_lower, list_sort(a)[2] AS yhat, list_sort(a)[3] AS yhat_upper
    FROM (SELECT user_id, sku, date, [greatest(quantity, 0.0), CAST(floor(revenue / 1000) AS DOUBLE), price / 50] AS a
          FROM silver)""")
def _(s):
    trio = middle_of_three(F.greatest("quantity", F.lit(0.0)), F.floor(F.col("revenue") / 1000).cast("double"),
                           F.col("price") / 50)
    rows = s.silver_sales().withColumn("t", trio)
    return rows.select(*SERIES, "date", F.get("t", F.lit(0)).alias("yhat_lower"), F.get("t", F.lit(1)).alias("yhat"),
                       F.get("t", F.lit(2)).alias("yhat_upper"))


@query("sales_span", "SELECT user_id, sku, min(date) AS first_date, max(date) AS last_date FROM sales_raw GROUP BY 1, 2")
def _(s):
    return s.sales_raw().groupBy(*SERIES).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("history_arrays", """
    SELECT user_id, sku, count(*) AS n, string_agg(CAST(CAST(quantity AS INTEGER) AS VARCHAR), ',' ORDER BY date)
           AS history FROM silver GROUP BY user_id, sku""")
def _(s):
    arrays = forecast.history_arrays(daily(s))
    text = F.array_join(F.transform("history", lambda q: q.cast("int").cast("string")), ",")
    return arrays.select(*SERIES, F.size("history").cast("bigint").alias("n"), text.alias("history"))


# Window of sixty days that starts in the middle of the sales, so that all signals have days in it.
WINDOW = {
    "begin": "SELECT CAST((SELECT d FROM as_of) - 1200 AS DATE) AS d",
    "ctx": """
        SELECT coalesce(a.user_id, e.user_id) AS user_id, coalesce(a.date, e.date) AS date, is_holiday, days_to_holiday,
               is_school_break, temp_avg, precip_mm, event_count, large_event_count
        FROM (SELECT coalesce(c.user_id, w.user_id) AS user_id, coalesce(c.date, w.date) AS date, is_holiday,
                     days_to_holiday, is_school_break, temp_avg, precip_mm
              FROM (SELECT * FROM calendar WHERE isodow(date) <> 7 AND date BETWEEN (SELECT d FROM begin)
                    AND (SELECT d FROM begin) + 59) c
              FULL JOIN (SELECT * FROM weather WHERE date BETWEEN (SELECT d FROM begin) AND (SELECT d FROM begin) + 59) w
              ON c.user_id = w.user_id AND c.date = w.date) a
        FULL JOIN (SELECT * FROM events_daily WHERE date BETWEEN (SELECT d FROM begin) AND (SELECT d FROM begin) + 59) e
             ON a.user_id = e.user_id AND a.date = e.date""",
    "carried": """
        SELECT c.*, t.interest AS trends_interest FROM ctx c LEFT JOIN (
            SELECT user_id, interest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rn
            FROM trends) WHERE rn = 1) t USING (user_id)""",
}


def begin(s):
    return F.date_sub(s.as_of(), 1200)


def workdays(s):
    """Calendar without Sundays, so that other signals add days of their own."""
    cal = calendar.calendar_daily(s.spans(), s.profiles(), s.holidays(), s.calendar_events())
    return cal.filter(F.weekday("date") != 6)


def context(s):
    return forecast.future_context(workdays(s), s.weather(), s.events_daily(), s.trends(), begin(s), 60)


@query("future_context", "SELECT * FROM carried", WINDOW)
def _(s):
    return context(s)


@query("future_window", """
    SELECT user_id, date, temp_avg FROM weather WHERE date BETWEEN (SELECT d FROM begin) AND (SELECT d FROM begin) + 29
    """, WINDOW)
def _(s):
    return forecast.in_window(s.weather(), begin(s)).select("user_id", "date", "temp_avg")


@query("context_merge", "SELECT * FROM ctx", WINDOW)
def _(s):
    return forecast.merge_context(*[forecast.in_window(d, begin(s), 60)
                                    for d in (workdays(s), s.weather(), s.events_daily())])


@query("trends_carry", "SELECT user_id, date, trends_interest FROM carried", WINDOW)
def _(s):
    return context(s).select("user_id", "date", "trends_interest")


GRID = {**WINDOW, "grid": """
    SELECT p.user_id, p.sku, CAST((SELECT d FROM begin) + CAST(k AS INTEGER) AS DATE) AS date
    FROM products p CROSS JOIN (SELECT unnest(range(0, 30)) AS k) r""",
    "tails": """
        SELECT user_id, sku, max(quantity) FILTER (rd = 1) AS lag_1, max(quantity) FILTER (rd = 7) AS lag_7,
               max(quantity) FILTER (rd = 14) AS lag_14, max(quantity) FILTER (rd = 28) AS lag_28,
               avg(quantity) FILTER (rd <= 7) AS roll_mean_7, avg(quantity) FILTER (rd <= 28) AS roll_mean_28
        FROM ranked GROUP BY user_id, sku"""}


def grid(s):
    """Thirty days for every series from the start of the window."""
    first = s.products().select(*SERIES).withColumn("_d", begin(s))
    return first.select(*SERIES, F.explode(F.sequence("_d", F.date_add("_d", 29))).alias("date"))


@query("context_join", """
    SELECT g.user_id, g.sku, g.date, coalesce(is_holiday, false) AS is_holiday, days_to_holiday,
           coalesce(is_school_break, false) AS is_school_break, temp_avg, precip_mm, trends_interest,
           coalesce(event_count, 0) AS event_count, coalesce(large_event_count, 0) AS large_event_count
    FROM grid g LEFT JOIN carried c USING (user_id, date)""", GRID)
def _(s):
    return forecast.with_context(grid(s), context(s))


@query("inference_row", """
    SELECT g.user_id, g.sku, g.date, lag_1, lag_7, lag_14, lag_28, round(roll_mean_7, 4) AS roll_mean_7,
           round(roll_mean_28, 4) AS roll_mean_28, CAST(isodow(g.date) - 1 AS INTEGER) AS dow,
           CAST(month(g.date) AS INTEGER) AS month, isodow(g.date) >= 6 AS is_weekend, false AS promo_flag,
           coalesce(is_holiday, false) AS is_holiday, days_to_holiday,
           coalesce(is_school_break, false) AS is_school_break, temp_avg, precip_mm, trends_interest,
           coalesce(event_count, 0) AS event_count, coalesce(large_event_count, 0) AS large_event_count
    FROM grid g JOIN tails USING (user_id, sku) LEFT JOIN carried c USING (user_id, date)""", GRID)
def _(s):
    tails = forecast.history_arrays(daily(s)).withColumn("history", forecast.tail(F.col("history"), 28))
    days = grid(s).join(tails, SERIES)
    return rounded(forecast.inference_rows(days, context(s)), "roll_mean_7", "roll_mean_28")


METRICS = {**BACKTEST, "metrics": """
    SELECT user_id, sku, 'seasonal-naive' AS chosen, 'seasonal-naive' AS model_version, mape_baseline AS mape_backtest,
           mape_baseline, round(external_null_frac, 4) AS external_null_frac FROM bt"""}


def metrics(s, rows=None):
    scored = selection.backtest(gold(s) if rows is None else rows)
    return scored.select(
        *SERIES, "chosen", F.col("chosen").alias("model_version"), F.col("mape_baseline").alias("mape_backtest"),
        "mape_baseline", F.round("external_null_frac", 4).alias("external_null_frac"))


@query("train_metrics", """
    SELECT * REPLACE (round(mape_backtest, 4) AS mape_backtest, round(mape_baseline, 4) AS mape_baseline) FROM metrics
    """, METRICS)
def _(s):
    return rounded(metrics(s), "mape_backtest", "mape_baseline")


@query("latest_model", """
    SELECT user_id, sku, model_run_id, generated_at AS trained_at, model_version FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, sku ORDER BY generated_at DESC, model_run_id DESC,
               forecast_date DESC) AS rn FROM forecasts) WHERE rn = 1""")
def _(s):
    runs = s.forecasts().select(*SERIES, "model_run_id", F.col("generated_at").alias("trained_at"), "model_version")
    return forecast.latest_models(runs)


@query("model_history_join", """
    SELECT m.user_id, m.sku, m.chosen, h.n FROM metrics m
    JOIN (SELECT user_id, sku, count(*) AS n FROM silver WHERE date > (SELECT d FROM as_of) - 30 GROUP BY 1, 2) h
    USING (user_id, sku)""", METRICS)
def _(s):
    rows = stored_gold(s)
    recent = rows.select(*SERIES, "date", "quantity").filter(F.col("date") > F.date_sub(s.as_of(), 30))
    joined = forecast.with_history(metrics(s, rows).select(*SERIES, "chosen"), forecast.history_arrays(recent))
    return joined.select(*SERIES, "chosen", F.size("history").cast("bigint").alias("n"))


@query("forecast_dispatch", """
    SELECT n.user_id, n.sku, n.date, round(CASE WHEN m THEN 7.0 ELSE yhat END, 4) AS yhat,
           round(CASE WHEN m THEN 5.0 ELSE yhat_lower END, 4) AS yhat_lower,
           round(CASE WHEN m THEN 9.0 ELSE yhat_upper END, 4) AS yhat_upper
    FROM naive n JOIN (SELECT user_id, sku, sales_days % 2 = 0 AND sku <> 'Brand#2' AS m FROM products) p USING (user_id, sku)
    """)
def _(s):
    """Even series choose the model; one brand has no model points and falls back."""
    chosen = F.when(F.col("sales_days") % 2 == 0, selection.BOOSTED).otherwise(selection.BASELINE)
    models = s.products().select(*SERIES, chosen.alias("chosen"))
    stats = s.stored("stats", lambda: baseline.history_stats(daily(s)))
    finished = baseline.points(stats, start(s), 30).filter("sku != 'Brand#2'").select(
        *SERIES, "date", F.lit(7.0).alias("yhat"), F.lit(5.0).alias("yhat_lower"), F.lit(9.0).alias("yhat_upper"))
    return rounded(forecast.dispatch(models, stats, start(s), 30, finished), *BANDS)


@query("infer_rows", """
    SELECT user_id, sku, date AS forecast_date, strftime((SELECT d FROM as_of), 'nightly-%Y%m%d') AS model_run_id,
           model_version, round(yhat, 2) AS yhat, round(yhat_lower, 2) AS yhat_lower, round(yhat_upper, 2) AS yhat_upper,
           round(mape_backtest, 2) AS mape_backtest
    FROM naive JOIN metrics USING (user_id, sku)""", METRICS)
def _(s):
    rows = stored_gold(s)
    models = s.stored("models", lambda: rounded(metrics(s, rows), "mape_backtest", digits=2))
    pts = forecast.dispatch(models, baseline.history_stats(rows.select(*SERIES, "date", "quantity")), start(s))
    rows = forecast.forecast_rows(pts, models, batch_id(s.as_of()), s.as_of().cast("timestamp"))
    return rows.drop("generated_at")


@query("run_summary", """
    SELECT model_run_id AS batch, 'ok' AS status, count(DISTINCT (user_id, sku)) AS skus, count(*) AS forecasts
    FROM forecasts GROUP BY model_run_id""")
def _(s):
    return run_summary(s.forecasts()).drop("factors")
