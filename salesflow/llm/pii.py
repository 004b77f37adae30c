"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Base kinds: email, ip (parts up to 255), card (13 to 19 digits, Luhn) and phone (9 to 15 digits after a +); they
always stay. The method adds account numbers (iban, mod-97), and national ids (ssn) and phone numbers without + (local)
if words nearby raise their score to LEAST. A span's score is its kind's, raised by a confirmed checksum and by a
word of its kind within NEAR characters on either side.

Null and empty texts have no spans. Every row gives one row, repeated rows alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesflow.llm.spans import marked, matches, overlaps, written

EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
BYTE = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IBAN = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = "(?<![0-9+-])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[.\\x20-])[0-9]{3}[.\\x20-][0-9]{4}(?![0-9-])"
KINDS = {  # kind: (score, words nearby that raise it)
    "email": (0.8, "e-?mail|contact|write|courriel|correo"), "ip": (0.5, "\\bip\\b|host|server|address|adresse"),
    "card": (0.6, "card|visa|credit|karte|carte|tarjeta"), "phone": (0.6, "phone|tel|call|fax|mobile|telefon"),
    "iban": (0.6, "iban|account|bank|konto|compte|cuenta"), "ssn": (0.3, "ssn|social security|national id"),
    "local": (0.3, "phone|\\btel\\b|call|fax|mobile|telefon"),
}
CHECKED, NEARBY, NEAR, LEAST = 0.3, 0.3, 40, 0.6


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    turned = F.reverse(digits(value))

    def add(n: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return n + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end."""
    bare = F.regexp_replace(value, "\\x20", "")
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def add(n: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (n * 10 + c.cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), add) == 1


def scored(text: Column, kind: str, spans: Column, checked: bool = False) -> Column:
    base, words = KINDS[kind]

    def near(s: Column) -> Column:
        low = F.greatest(s.start - NEAR, F.lit(0))
        return F.concat(F.substring(text, low + 1, s.start - low), F.lit(" "), F.substring(text, s.end + 1, F.lit(NEAR)))

    return F.transform(spans, lambda s: F.struct(
        s.start.alias("start"), s.order.alias("order"), s.end.alias("end"), s.kind.alias("kind"), s.value.alias("value"),
        (F.lit(base + CHECKED * checked) + F.when(near(s).rlike("(?i:" + words + ")"), NEARBY).otherwise(0.0)).alias("score")))


def pii_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _email, _ip, _card, _phone and ``added``: arrays of (start, order, end, kind, value, score)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = lambda s: F.length(digits(s.value))
    found = {
        "email": matches(body, EMAIL, F.contains(body, F.lit("@"))),
        "ip": F.filter(matches(body, IP, body.rlike("[0-9]\\.[0-9]")), lambda s: s.value.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$")),
        "card": F.filter(matches(body, CARD, body.rlike("[0-9](?:[\\x20-]?[0-9]){12}")), lambda s: F.when(n(s).between(13, 19), luhn(s.value)).otherwise(False)),
        "phone": F.filter(matches(body, PHONE, body.rlike("\\+[0-9]")), lambda s: n(s).between(9, 15)),
        "iban": F.filter(matches(body, IBAN, body.rlike("[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}")), lambda s: mod97(s.value)),
        "ssn": matches(body, SSN, body.rlike("[0-9]-[0-9]{2}-[0-9]")),
        "local": matches(body, LOCAL, body.rlike("[0-9][.\\x20-][0-9]{4}")),
    }
    out = docs.withColumns({f"_{k}": marked(k, i, v) for i, (k, v) in enumerate(found.items())})
    out = out.withColumns({f"_{k}": scored(body, k, F.col(f"_{k}"), k in ("card", "iban")) for k in found})
    base = F.concat(*(F.col(f"_{k}") for k in ("email", "ip", "card", "phone")))
    added = F.filter(F.concat("_iban", "_ssn", "_local"), lambda s: (s.score >= LEAST - 1e-9) & ~overlaps(s, F.col("base")))
    return out.withColumn("base", base).withColumn("added", added)


def pii_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and scores (in the order of spans) for each row."""
    found = pii_spans(docs.select(docs[key].alias(key), docs[text].alias("text")), "text")
    every = F.concat("base", "added")
    return found.select(
        key, *(F.size("_" + k).cast("long").alias("n_" + k) for k in ("email", "ip", "card", "phone")),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"), F.transform(every, lambda s: F.round(s.score, 2)).alias("scores"))
