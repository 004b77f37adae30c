"""Column functions: text, dates, numbers, arrays and JSON rules used by validation, parsing and serving."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings of the promo flag, decimal numbers, ASINs, and error tones.
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no", ""]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ASIN = r"^[A-Z0-9]{10}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def clean(c: Column) -> Column:
    """Trimmed text, NULL read as empty."""
    return F.trim(F.coalesce(c, F.lit("")))


def or_default(c: Column, default: Column) -> Column:
    """``default`` where the text is empty or missing."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def after_first(c: Column, sep: str = ":") -> Column:
    """Text behind the first separator; the whole text when there is none."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(c)


def before_first(c: Column, sep: str = ":") -> Column:
    return F.element_at(F.split(c, sep, 2), 1)


def entity_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def number(c: Column) -> Column:
    """Plain decimal or scientific number; anything else (also nan and inf) is NULL."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def flag(c: Column) -> Column:
    """true / false words; NULL for any other text."""
    word = F.lower(clean(c))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def iso_date(c: Column) -> Column:
    return F.when(c.rlike(ISO_DATE), F.try_to_date(c, "yyyy-MM-dd"))


def ics_date(c: Column) -> Column:
    """First eight digits of a calendar stamp as a date."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))


def batch_id(day: Column) -> Column:
    """Nightly run id; sorts by run day."""
    return F.date_format(day, "'nightly-'yyyyMMdd")


def dow(day: Column) -> Column:
    """Day of week, Monday = 0."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def clamp(c: Column, low: float, high: float | None = None) -> Column:
    """The value held between two bounds; a missing one stays missing."""
    held = F.greatest(c, F.lit(low).cast("double"))
    return F.when(c.isNotNull(), held if high is None else F.least(held, F.lit(high).cast("double")))


def middle_of_three(a: Column, b: Column, c: Column) -> Column:
    """The three values in ascending order."""
    return F.array_sort(F.array(a, b, c))


def mape_tone(c: Column) -> Column:
    return F.when(c <= 15, "green").when(c <= 25, "amber").when(c.isNotNull(), "red")


def label_of(factor: Column) -> Column:
    return F.replace(factor, F.lit("_"), F.lit(" "))


def month_day(day: Column) -> Column:
    """MM-DD axis label."""
    return F.substring(day.cast("string"), 6, 5)


def any_hint(text: Column, hints: list[str]) -> Column:
    """Whether any of the words occurs in the text, case-insensitive."""
    lowered = F.lower(text)
    found = F.lit(False)
    for hint in hints:
        found = found | F.contains(lowered, F.lit(hint))
    return F.coalesce(found, F.lit(False))


def last_of(series: Column) -> Column:
    """Last element of a series with at least two elements."""
    return F.when(F.size(series) >= 2, F.try_element_at(series, F.lit(-1)))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")
