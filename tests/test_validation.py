import pytest
from pyspark.sql import functions as F

from rows import table
from salesflow.operators import validation
from salesflow.sources import files

COLUMNS = "upload_id string, row_no int, date string, sku string, product_name string, quantity string, revenue string, " \
          "price string, promo_flag string"


def row(no, date="2026-07-01", sku="A", name="Mug", qty="3", rev="9.5", price="", promo=""):
    return ("u", no, date, sku, name, qty, rev, price, promo)


def errors(frame, rows, **caps):
    checked = validation.validate_sales(frame(rows, COLUMNS), **caps)
    return table(validation.error_rows(checked), "row", "field", "message")


def test_valid_rows(frame):
    checked = validation.validate_sales(frame([row(2), row(3, sku="B", name="", promo=" TRUE "), row(4, rev="")], COLUMNS))
    assert table(validation.valid_sales(checked), "sku", "date", "product_name", "quantity", "revenue", "promo_flag") == [
        ("A", "2026-07-01", "Mug", 3.0, 9.5, False), ("A", "2026-07-01", "Mug", 3.0, None, False),
        ("B", "2026-07-01", "B", 3.0, 9.5, True)]


@pytest.mark.parametrize("change, field, message", [
    (dict(date="3.7.2031"), "date", "date must be ISO YYYY-MM-DD"),
    (dict(date="20260701"), "date", "date must be ISO YYYY-MM-DD"),
    (dict(date="2026-02-30"), "date", "date must be ISO YYYY-MM-DD"),
    (dict(qty="-1"), "quantity", "quantity must be >= 0"),
    (dict(qty="5d"), "quantity", "quantity could not convert string to float: '5d'"),
    (dict(qty="nan"), "quantity", "quantity could not convert string to float: 'nan'"),
    (dict(qty=""), "quantity", "quantity could not convert string to float: ''"),
    (dict(rev="oops"), "revenue", "revenue could not convert string to float: 'oops'"),
    (dict(price="-2"), "price", "price must be >= 0"),
    (dict(promo="maybe"), "promo_flag", "must be true/false/0/1"),
    (dict(sku="  "), "sku", "sku is required"),
    (dict(sku="", date="bad", qty="-1"), "sku", "sku is required"),
])
def test_first_broken_rule_is_reported(frame, change, field, message):
    assert errors(frame, [row(2, **change)]) == [(2, field, message)]


def test_sku_cap_counts_first_appearances_even_of_rejected_rows(frame):
    rows = [row(2, sku="bad", qty="-1"), row(3, sku="A"), row(4, sku="B"), row(5, sku="A")]
    assert errors(frame, rows, max_skus=2) == [
        (2, "quantity", "quantity must be >= 0"), (4, "sku", "SKU limit exceeded (2 per file)")]


def test_row_cap_reports_once(frame):
    rows = frame([row(i) for i in range(2, 8)], COLUMNS)
    within, beyond = validation.row_cap(rows, 3)
    assert within.count() == 3 and table(beyond) == [("u", 5, "file", "Row limit exceeded (3)")]
    assert errors(frame, [row(i, qty="-1" if i == 3 else "3") for i in range(2, 8)], max_rows=3) == [
        (3, "quantity", "quantity must be >= 0"), (5, "file", "Row limit exceeded (3)")]
    assert errors(frame, [row(i) for i in range(2, 8)]) == []


def test_status_and_report(frame):
    checked = validation.validate_sales(frame([row(2), row(3), row(4, qty="x"), ("v", *row(2, sku="")[1:])], COLUMNS))
    assert table(validation.upload_status(checked)) == [("u", "loaded", 2, 1), ("v", "failed", 0, 1)]
    report = dict(table(validation.error_report(validation.error_rows(checked))))
    assert [tuple(e) for e in report["v"]] == [(2, "sku", "sku is required")]


def test_product_stats(frame):
    sales = frame([("u1", "A", "2026-07-01"), ("u1", "A", "2026-07-02")], "user_id string, sku string, date date")
    assert table(validation.product_stats(sales)) == [("u1", "A", 2, "2026-07-02")]


def test_calendar_rules(frame):
    rows = frame([(2, "Break", "2026-06-01", ""), (3, "", "2026-06-01", ""), (4, "X", "2026-13-01", ""),
                  (5, "X", "2026-06-02", "2026-06-01"), (6, "X", "2026-06-02", "soon")],
                 "row_no int, label string, start_date string, end_date string")
    got = validation.validate_calendar(rows)
    assert table(got.filter("error is not null"), "error.row", "error.field") == [
        (3, "label"), (4, "start_date"), (5, "end_date"), (6, "end_date")]
    assert table(got.filter("error is null"), "label", "start_date", "end_date") == [("Break", "2026-06-01", "2026-06-01")]


def test_profiles(frame):
    rows = frame([("a", "us", 10.0, 20.0, "usd"), ("b", "usa", 91.0, -181.0, "us"), ("c", "in", None, None, "inr")],
                 "id string, country_code string, latitude double, longitude double, currency string")
    assert table(validation.validate_profiles(rows), "id", "country_code", "invalid") == [
        ("a", "US", []), ("b", "USA", ["country_code", "latitude", "longitude", "currency"]), ("c", "IN", [])]


def test_asin_rules_follow_the_order_of_requests(frame):
    proposed = [("u", f"B{i:09d}", i) for i in range(12)] + [("u", "short", 3), ("u", "B000000000", 4), ("u", "B000000001", 50)]
    existing = frame([("u", "B000000002")], "user_id string, asin string")
    got = validation.validate_asins(frame(proposed, "user_id string, asin string, created_at int"), existing)
    outcome = {(r["asin"], r["created_at"]): r["outcome"] for r in got.collect()}
    assert outcome[("short", 3)] == "invalid" and outcome[("B000000000", 4)] == "duplicate"
    assert outcome[("B000000002", 2)] == "duplicate" and outcome[("B000000009", 9)] == "accepted"
    assert outcome[("B000000010", 10)] == "cap_reached" and outcome[("B000000001", 50)] == "cap_reached"
    assert sum(v == "accepted" for v in outcome.values()) == 9


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_files_with_their_own_headers(spark, tmp_path):
    one = write(tmp_path / "one.csv", "﻿ Date ,SKU,Product_Name,quantity,revenue\n2026-07-01,A,\"Mug, big\nblue\",3,9\n\n2026-07-02,A,Mug,4\n")
    two = write(tmp_path / "two.csv", "revenue,quantity,product_name,sku,date,promo_flag,extra\n5,1,Tee,B,2026-07-03,yes,zzz,over\n")
    rows, broken = files.read_sales_csv(spark, [one, two])
    assert broken.count() == 0
    checked = validation.validate_sales(rows)
    assert table(validation.valid_sales(checked), "row_no", "sku", "product_name", "quantity", "revenue", "promo_flag") == [
        (2, "A", "Mug, big\nblue", 3.0, 9.0, False), (2, "B", "Tee", 1.0, 5.0, True), (3, "A", "Mug", 4.0, None, False)]


def test_broken_files_are_reported_and_not_loaded(spark, tmp_path):
    bad = write(tmp_path / "bad.csv", "sku,price,date,quantity\nA,1,2026-07-01,3\n")
    (tmp_path / "latin.csv").write_bytes("date,sku,product_name,quantity,revenue\n2026-07-01,A,Caf\xe9,3,1\n".encode("latin-1"))
    rows, broken = files.read_sales_csv(spark, [bad, str(tmp_path / "latin.csv")])
    assert rows.count() == 0
    assert table(broken, "row", "field", "message") == [
        (0, "file", "File is not valid UTF-8 text"), (1, "header", "Missing required columns: product_name, revenue")]


def test_calendar_csv(spark, tmp_path):
    good = write(tmp_path / "c.csv", "label,start_date,end_date\nBreak,2026-06-01,2026-06-05\nBad,2026-13-01,\n")
    rows, broken = files.read_calendar_csv(spark, good)
    got = validation.validate_calendar(rows)
    assert broken.count() == 0
    assert table(got.filter("error is null"), "label", "start_date", "end_date") == [("Break", "2026-06-01", "2026-06-05")]
    assert table(got.filter("error is not null"), "error.row", "error.field") == [(3, "start_date")]


def test_ics(spark, tmp_path):
    text = ("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Carnival\r\nDTSTART;VALUE=DATE:20310219\r\n"
            "DTEND;VALUE=DATE:20310224\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:One day: off\r\n"
            "DTSTART:20310505;VALUE=DATE\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:No start\r\nEND:VEVENT\r\n"
            "BEGIN:VEVENT\r\nSUMMARY:Odd\r\nDTSTART:soon\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    got = validation.validate_calendar(files.read_ics(spark, write(tmp_path / "c.ics", text)))
    assert table(got.filter("error is null"), "row_no", "label", "start_date", "end_date") == [
        (10, "One day: off", "2031-05-05", "2031-05-05"), (6, "Carnival", "2031-02-19", "2031-02-23")]
    assert table(got.filter("error is not null"), "error.row", "error.field") == [(17, "start_date")]


def test_secret_scan_keeps_context_between_close_matches(frame):
    from salesflow.operators.scan import secret_scan

    key = "AKIA" + "Q" * 16
    docs = frame([(1, f"x {key} {key}"), (2, f"this is an example {key}"), (3, "é" * 70 + key + "tail"), (4, "nothing")],
                 "doc_id int, text string")
    got = table(secret_scan(docs), "doc_id", "pattern", "start")
    assert got == [(1, "aws_access_key", 2), (1, "aws_access_key", 23), (3, "aws_access_key", 70)]
    third = secret_scan(docs).filter("doc_id = 3").first()["context"]
    assert third == ("é" * 60 + key + "tail")[:80]
    second = secret_scan(docs).filter(F.col("start") == 23).first()["context"]
    assert second == f"x {key} {key}"


def test_every_file_ends_in_a_status(spark, tmp_path):
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "blank.csv", "\n \n")
    wide = ",".join(f"c{i}" for i in range(60))
    write(tmp_path / "wide.csv", f"{wide},date,sku,product_name,quantity,revenue\n{wide},2031-01-02,A,\ufffd,1,2\n")
    rows, broken = files.read_sales_csv(spark, str(tmp_path))
    checked = validation.validate_sales(rows)
    assert table(broken, "row", "message") == [(0, "Empty file"), (1, "Missing required columns: date, sku, product_name, quantity, revenue")]
    got = validation.upload_status(checked, broken)
    assert table(got.withColumn("f", F.regexp_extract("upload_id", "([a-z]+).csv", 1)), "f", "status", "row_count", "rejected") == [
        ("blank", "failed", 0, 1), ("empty", "failed", 0, 1), ("wide", "loaded", 1, 0)]


def test_ics_lines_count_as_a_whole(spark, tmp_path):
    text = ("BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:about BEGIN:VEVENT and END:VEVENT\nDTSTART:20310101\nEND:VEVENT\n"
            "BEGIN:VEVENT\nSUMMARY:no day\nDTSTART:\nEND:VEVENT\nSUMMARY:outside\nDTSTART:20310102\nEND:VEVENT\n")
    write(tmp_path / "a.txt", text)
    (tmp_path / "b.ics").write_bytes(b"BEGIN:VCALENDAR\xff")
    write(tmp_path / "c.csv", "label,start_date,end_date\nBreak,2031-03-01,\n")
    rows, broken = files.read_calendar(spark, str(tmp_path))
    good = validation.validate_calendar(rows)
    assert table(good, "row_no", "label", "start_date") == [(2, "Break", "2031-03-01"), (5, "about BEGIN:VEVENT and END:VEVENT", "2031-01-01")]
    assert table(broken, "row", "message") == [(0, "File is not valid UTF-8 text")]


def test_texts_and_records_stay_in_their_tasks(spark, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    entries = plan(files.read_ics(spark, write(tmp_path / "c.ics", "BEGIN:VEVENT\nSUMMARY:a\nDTSTART:20260701\nEND:VEVENT\n")))
    assert "Window" not in entries and "hashpartitioning(upload_id" not in entries
    folder = tmp_path / "csv"
    folder.mkdir()
    write(folder / "a.csv", "date,sku,product_name,quantity,revenue\n2026-07-01,A,Mug,1,2\n")
    rows, _ = files.read_sales_csv(spark, str(folder))
    assert "Aggregate" not in plan(rows) and rows.count() == 1  # headers are read from storage, records meet them where they are
