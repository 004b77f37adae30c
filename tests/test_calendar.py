from rows import table
from salesflow.operators import calendar

SPAN = "user_id string, start_date date, end_date date"


def build(frame, start, end, holidays, breaks, profiles=(("u1", "US"),)):
    return calendar.calendar_daily(
        frame([("u1", start, end)], SPAN), frame(list(profiles), "id string, country_code string"),
        frame([("US", h) for h in holidays], "country_code string, date date"),
        frame([("u1", *b) for b in breaks], SPAN))


def test_holidays_and_breaks(frame):
    rows = build(frame, "2026-12-23", "2026-12-26", ["2026-12-25"], [("2026-12-24", "2026-12-31")])
    assert table(rows) == [
        ("u1", "2026-12-23", False, 2, False), ("u1", "2026-12-24", False, 1, True),
        ("u1", "2026-12-25", True, 0, True), ("u1", "2026-12-26", False, None, True)]


def test_lookahead_ends_after_thirty_days(frame):
    rows = table(build(frame, "2026-11-24", "2026-11-26", ["2026-12-25"], []), "date", "days_to_holiday")
    assert rows == [("2026-11-24", None), ("2026-11-25", 30), ("2026-11-26", 29)]


def test_nearest_holiday_and_overlapping_breaks(frame):
    rows = table(build(frame, "2026-12-20", "2026-12-20", ["2026-12-25", "2026-12-22"],
                       [("2026-12-01", "2026-12-31"), ("2026-12-19", "2026-12-21")]))
    assert rows == [("u1", "2026-12-20", False, 2, True)]


def test_a_range_over_centuries_is_cut_to_the_span(frame):
    rows = build(frame, "2026-12-20", "2026-12-21", [], [("1900-01-01", "9999-12-31")])
    assert table(rows, "date", "is_school_break") == [("2026-12-20", True), ("2026-12-21", True)]


def test_tenant_without_profile_has_no_holidays(frame):
    rows = build(frame, "2026-12-25", "2026-12-25", ["2026-12-25"], [], profiles=[("other", "US")])
    assert table(rows, "is_holiday") == [(False,)]
