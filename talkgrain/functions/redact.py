"""Redaction of personal data and secrets, as chains of regular-expression replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lookaround-free, so that other engines agree: the neighbours are kept by groups.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
LONG_DIGITS = r"(^|[^0-9])[0-9]{7,16}($|[^0-9])"
SECRET = r"(?i)(password|passwd|secret|token|api[_-]?key|authorization)[ \t]*[:=][ \t]*[^\s,;]+"
QUOTED_SECRET = r"""(?i)(password|passwd|secret|token|api[_-]?key|authorization)(["'])[ \t]*[:=][ \t]*("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^\s,;}"']+)"""
CREDENTIAL = r"(?i)\b(?:sk-[A-Za-z0-9_-]{12,}|gsk_[A-Za-z0-9_-]{12,}|tvly-[A-Za-z0-9_-]{12,}|AIza[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})"
BEARER = r"(?i)\bbearer[ \t]+[A-Za-z0-9._~+/=-]+"
JWT = r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
QUERY = r"(?i)(https?://[^\s?]+)\?[^\s]+"
URL_CREDENTIALS = r"(?i)(https?://)[^\s/@]+@"


def _where(test: Column, text: Column, pattern: str, by: str) -> Column:
    """Replaces only where a cheap test says that the pattern can match at all."""
    return F.when(test, F.regexp_replace(text, pattern, by)).otherwise(text)


def _has(text: Column, *parts: str) -> Column:
    """Contains one of the parts (in lower case), whatever the case."""
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in parts])


def secrets(text: Column) -> Column:
    t = _where(_has(text, "bearer"), text, BEARER, "Bearer [REDACTED]")
    t = _where(F.contains(t, F.lit("eyJ")), t, JWT, "[REDACTED_TOKEN]")
    assigned = F.contains(t, F.lit(":")) | F.contains(t, F.lit("="))
    named = assigned & _has(t, "passw", "secret", "token", "api", "authorization")
    t = F.when(named, F.regexp_replace(F.regexp_replace(t, QUOTED_SECRET, "$1$2=[REDACTED]"), SECRET, "$1=[REDACTED]")).otherwise(t)
    return _where(_has(t, "sk-", "gsk_", "tvly-", "aiza", "akia"), t, CREDENTIAL, "[REDACTED_CREDENTIAL]")


def urls(text: Column) -> Column:
    link = F.contains(text, F.lit("://"))
    return F.when(link, F.regexp_replace(F.regexp_replace(text, URL_CREDENTIALS, "$1"), QUERY, "$1?[REDACTED_QUERY]")).otherwise(text)


def personal(text: Column) -> Column:
    t = _where(F.contains(text, F.lit("@")), text, EMAIL, "[REDACTED_EMAIL]")
    # Twice, as two runs may share the character between them.
    twice = F.regexp_replace(F.regexp_replace(t, LONG_DIGITS, "$1[REDACTED_NUMBER]$2"), LONG_DIGITS, "$1[REDACTED_NUMBER]$2")
    return F.when(t.rlike("[0-9]{7}"), twice).otherwise(t)


def redacted(text: Column, limit: int | None = None) -> Column:
    """Secrets, address queries, e-mail addresses and runs of 7 to 16 digits of the whole text. Null stays null.

    limit: where a record has room for so many characters only (event details: 4000).
    """
    t = personal(urls(secrets(text)))
    return F.substring(t, 1, limit) if limit else t


def masked(value: Column, shown: int = 4) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit("***"), F.right(value, F.lit(shown))))


def scrubbed(text: Column, private: str) -> Column:
    """text without any occurrence of one private value, whatever its case."""
    quoted = "\\Q" + private.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, "(?iu)" + quoted, "[PRIVATE]") if private else text


def capped_json(json: Column, limit: int) -> Column:
    preview = F.to_json(F.struct(F.lit(True).alias("truncated"), F.substring(json, 1, limit).alias("preview")))
    return F.when(F.length(json) > limit, preview).otherwise(json)
