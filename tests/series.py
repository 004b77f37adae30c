"""Made-up daily series for tests: a weekday pattern, a slow wave and a little hash noise."""

from pyspark.sql import functions as F

WEEK = [0.8, 0.9, 1.0, 1.0, 1.3, 1.6, 1.4]


def daily_sales(products, last, days):
    """The last ``days`` days up to ``last`` of each (user_id, sku, product_name, base)."""
    rows = products.withColumn("date", F.explode(F.sequence(F.date_sub(last, days - 1), last)))
    weekday = F.element_at(F.array(*[F.lit(w) for w in WEEK]), F.weekday("date") + 1)
    wave = 1 + F.cos(F.datediff("date", F.lit("2020-01-01")) / 15.0) / 5
    noise = F.pmod(F.xxhash64("user_id", "sku", "date"), F.lit(7)) - 3
    quantity = F.greatest(F.round(F.col("base") * weekday * wave + noise), F.lit(0.0))
    return rows.select("user_id", "sku", "product_name", "date", quantity.alias("quantity"), (quantity * 4.5).alias("revenue"),
                       F.lit(4.5).alias("price"), (F.pmod(F.xxhash64("sku", "date"), F.lit(19)) == 0).alias("promo_flag"))
