"""Text as columns: cleaning, tokens, hashes, classification. Built-in expressions only, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word with inner hyphens or apostrophes, else one mark. Letters and digits of all scripts.
TOKEN = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"
#: Search terms: letters, digits, underscore and hyphen.
TERM = r"[\p{L}\p{N}_-]+"


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def terms(text: Column) -> Column:
    """Distinct lower-case terms of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)), lambda t: F.length(t) > 1))


def telling_terms(text: Column) -> Column:
    """The terms of four characters or more, or all where there is none, sorted."""

    def choose(all_: Column) -> Column:
        long = F.filter(all_, lambda t: F.length(t) >= 4)
        return F.array_sort(F.when(F.size(long) > 0, long).otherwise(all_))

    return F.get(F.transform(F.array(terms(text)), choose), F.lit(0))


def ascii_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1))


def plain(markdown: Column) -> Column:
    """Markdown links become their label, other addresses go, as do the markers of headings, lists and emphasis."""
    t = F.coalesce(markdown, F.lit(""))
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"https?://[^\s]+", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]{0,3}(#{1,6}|[-*+]|[0-9]{1,3}[.)])[ \t]+", "")
    t = F.regexp_replace(t, r"[*_`~|]+", " ")
    return collapse(t)


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by NUL; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(f, F.lit("")) for f in fields]), 256)


def answer_fingerprint(text: Column) -> Column:
    return F.sha2(F.lower(collapse(text)), 256)


def squeezed(text: Column) -> Column:
    """Letters, digits and underscores only, lower-case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def normalized_subject(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def title_of(text: Column, words: int = 6) -> Column:
    return F.array_join(F.slice(F.split(collapse(text), " "), 1, words), " ")


def first_line(text: Column) -> Column:
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def version_base(key: Column) -> Column:
    return F.regexp_replace(key, r"\.v[0-9]+$", "")


def stable_key(url: Column, title: Column, kind: Column) -> Column:
    short = lambda c: F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 16)
    return F.concat_ws(".", F.lit("web"), short(url), short(F.concat_ws("\0", F.coalesce(title, F.lit("")), kind)))


def truncated(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last sentence end or space of the second half, with an ellipsis."""
    clean = collapse(text)
    head = F.substring(clean, 1, max(1, limit - 1))
    least = max(40, limit // 2)
    # What follows the last boundary; the cut must not be before `least`.
    tail = F.regexp_extract(head, r"[^ ]*$", 0)
    at = F.length(head) - F.length(tail) - 1
    cut = F.when((at >= least) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def safe_metadata(text: Column) -> Column:
    """Length, words and a short digest of a text that must not be logged."""
    t = F.coalesce(text, F.lit(""))
    return F.format_string("chars=%d,words=%d,sha256=%s", F.length(t), F.regexp_count(t, F.lit(r"\S+")), F.substring(F.sha2(t, 256), 1, 12))


def estimated_chunks(text: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((token_count(text) - overlap) / (size - overlap)).cast("int"))
