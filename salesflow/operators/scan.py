"""Scan of whole texts for secrets and for forbidden hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Secret patterns, words that mark a harmless match, context around a match, paid hosts.
SECRET_PATTERNS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key_block": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "stripe_live": r"[sr]k_live_[0-9a-zA-Z]{16,}",
    "supabase_service_jwt": r"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9\.eyJ[a-zA-Z0-9_-]{20,}",
    "generic_secret_assignment": r"(?i)(?:password|secret|api[_-]?key)\s*[:=]\s*['\"][^'\"]{12,}['\"]",
}
HARMLESS = ["your-", "change-me", "test-secret", "integration-secret", "dev-anon-key", "dev-jwt-secret", "example",
            "placeholder", "SUPABASE_JWT_SECRET", "JWT_SECRET", "API_KEY"]
BEFORE, AFTER, SHOWN = 60, 20, 80
PAID_HOSTS = ["api.bloomberg.com", "refinitiv", "api.predicthq.com", "poligon.io-paid", "sp-api.amazon.com"]


def total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, part: n + F.length(part))


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per secret found, with its pattern and the text around it.

    The start of a match is the length of all pieces and matches before it, so every match gets its
    full context even when two lie close together.
    """
    body = F.col(text)
    tried = F.array(*[
        F.when(body.rlike(pattern), F.struct(
            F.lit(name).alias("pattern"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("matches"),
            F.split(body, pattern, -1).alias("pieces")))
        for name, pattern in SECRET_PATTERNS.items()])
    found = docs.select(key, body.alias("_text"), F.explode(F.array_compact(tried)).alias("_p")).select(
        key, "_text", "_p.pattern", "_p.pieces", "_p.matches", F.posexplode("_p.matches").alias("_at", "_match"))
    start = total_length(F.slice("pieces", F.lit(1), F.col("_at") + 1)) + total_length(
        F.slice("matches", F.lit(1), F.col("_at")))
    low = F.greatest(start - BEFORE, F.lit(0))
    around = F.substring(F.col("_text"), low + 1, start + F.length("_match") + AFTER - low)
    hits = found.select(key, "pattern", start.alias("start"), around.alias("context"))
    harmless = F.lit(False)
    for word in HARMLESS:
        harmless = harmless | F.contains("context", F.lit(word))
    return hits.filter(~harmless).withColumn("context", F.substring(F.trim("context"), 1, SHOWN))


def host_scan(docs: DataFrame, key: str, *texts: str, hosts: list[str] = PAID_HOSTS) -> DataFrame:
    """One row per document and forbidden host it names."""
    named = F.array_compact(F.array(*[
        F.when(sum((F.contains(t, F.lit(h)).cast("int") for t in texts[1:]), F.contains(texts[0], F.lit(h)).cast("int")) > 0, h)
        for h in hosts]))
    return docs.select(key, F.explode(named).alias("host"))
