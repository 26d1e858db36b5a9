"""Redaction of addresses and secrets in free text (built-in regex replacement)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and replacement tokens, applied in this order.
IPV4_PATTERN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
SECRET_PATTERN = r"(?i)(bearer\s+[a-zA-Z0-9\-._~+/=]+|api[_-]?key\s*[:=]\s*\S+)"
IP_TOKEN = "[REDACTED-IP]"
EMAIL_TOKEN = "[REDACTED-EMAIL]"
SECRET_TOKEN = "[REDACTED-SECRET]"


def redact(text: Column) -> Column:
    """IPv4 addresses, then e-mail addresses, then bearer tokens / API keys replaced.

    Digit and word-boundary classes are ASCII here (Java regex), a declared
    difference from Unicode-aware engines. Texts without an ``@``, or without
    the words that a secret begins with, skip the pattern that needs them.
    """
    low = F.lower(text)
    t = F.regexp_replace(text, IPV4_PATTERN, IP_TOKEN)
    t = F.when(text.contains("@"), F.regexp_replace(t, EMAIL_PATTERN, EMAIL_TOKEN)).otherwise(t)
    return F.when(low.contains("bearer") | low.contains("api"),
                  F.regexp_replace(t, SECRET_PATTERN, SECRET_TOKEN)).otherwise(t)


def redact_lines(lines: Column) -> Column:
    """``redact`` over every element of an ``array<string>``."""
    return F.transform(lines, redact)


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), 0))


def redaction_counts(df: DataFrame, col: str, key: str) -> DataFrame:
    """Per row: how many matches of each kind the redaction replaces (in order)."""
    t = F.col(col)
    after_ip = F.regexp_replace(t, IPV4_PATTERN, IP_TOKEN)
    after_mail = F.regexp_replace(after_ip, EMAIL_PATTERN, EMAIL_TOKEN)
    return df.select(key, _count(t, IPV4_PATTERN).alias("ips"),
                     _count(after_ip, EMAIL_PATTERN).alias("emails"),
                     _count(after_mail, SECRET_PATTERN).alias("secrets"))


def redaction_report(df: DataFrame, col: str, key: str) -> DataFrame:
    """Totals: rows touched and matches per kind (one aggregation, partial before shuffle)."""
    c = redaction_counts(df, col, key)
    return c.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("ips") > 0).alias("rows_with_ip"),
                 F.count_if(F.col("emails") > 0).alias("rows_with_email"),
                 F.count_if(F.col("secrets") > 0).alias("rows_with_secret"),
                 F.sum("ips").alias("ips"), F.sum("emails").alias("emails"),
                 F.sum("secrets").alias("secrets"))
