"""Between written and spoken text: display text made speakable, spoken digits and addresses made written, form fields checked.

Column expressions, but for Unicode's compatibility forms and what keeps state from left to right (aliases). Dictated addresses are in `spans`.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spoken digits (English, Hindi) and multipliers.
DIGITS = {
    "zero": "0", "oh": "0", "o": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "shunya": "0", "ek": "1", "do": "2", "teen": "3", "char": "4", "chaar": "4", "paanch": "5", "panch": "5", "chhe": "6", "che": "6", "saat": "7", "aath": "8", "nau": "9",
}
TIMES = {"double": 2, "triple": 3, "dabal": 2, "tripal": 3}
#: What is said for a bare address and for signs.
LINK, AND, PERCENT = "the provided link", " and ", " percent"


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _without_marks(line: Column) -> Column:
    """A line as said: no list or heading marks before it, link texts for links, no emphasis or code marks."""
    line = F.regexp_replace(line, r"^(?:\s*(?:[•◦▪‣]|(?:#{1,6}|[*+-]|\d{1,3}[.)])\s))+", "")
    line = F.regexp_replace(line, r"\[([^\[\]]+)\]\(\s*(?i:https?://|www\.)[^()]*\)", "$1")
    line = F.regexp_replace(line, r"(?i)\b(?:https?://|www\.)[^\s<>]+", LINK)
    line = F.regexp_replace(line, r"^\s*`{3}[\w+-]*|[*~_]{2}|`", "")
    return F.trim(F.regexp_replace(F.replace(F.replace(line, F.lit("&"), F.lit(AND)), F.lit("%"), F.lit(PERCENT)), r"[^\S\n]+", " "))


def speakable(text: Column, lexicon: list[tuple[str, str]] = ()) -> Column:
    """A text as it should be spoken: its lines without markup, as sentences. Null gives an empty text.

    lexicon: (written, spoken) pairs, applied in order to whole words whatever their case; at most 500, as each is a
    column expression.
    """
    if len(lexicon) > 500:
        raise ValueError("the lexicon is too large to apply entry by entry")
    plain = F.translate(F.coalesce(_compatible(text), F.lit("")), "\u2018\u2019\u201c\u201d\u200b", "''\"\"")
    plain = F.regexp_replace(plain, "[\u2013\u2014]", ", ")
    said = F.array_join(F.filter(F.transform(F.split(plain, "\n"), _without_marks), lambda line: line != ""), ". ")
    for written, spoken in lexicon:
        said = F.regexp_replace(said, rf"(?iU)(?<!\w){re.escape(written)}(?!\w)", spoken.replace("\\", r"\\").replace("$", r"\$"))
    said = F.regexp_replace(F.regexp_replace(said, r"\s+(?=[,.;:!?])", ""), r"\.(?:\s*\.)++\s*", ". ")
    return F.trim(F.regexp_replace(said, r"\s+", " "))


@F.pandas_udf(T.MapType(T.StringType(), T.LongType()))
def category_counts(text: pd.Series) -> pd.Series:
    """Unicode general categories of a text's characters; none of a null."""
    return text.map(lambda t: pd.Series([unicodedata.category(c) for c in t or ""], dtype=object).value_counts().to_dict())


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def digit_runs(text: Column) -> Column:
    """The runs of spoken or written digits, in order, as strings of digits; none of a null.

    Each token says what it adds: digits themselves, as often as a multiplier right before says; a multiplier nothing; any other
    word, and a second multiplier in a row, a break between runs.
    """
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), F.lower)

    def adds(token: Column, i: Column) -> Column:
        before = F.when(i > 0, _lookup(TIMES, F.get(tokens, i - 1)))
        digits = F.when(token.rlike("^[0-9]"), token).otherwise(_lookup(DIGITS, token))
        again = F.repeat(digits, F.coalesce(before, F.lit(1)))
        return F.when(_lookup(TIMES, token).isNull(), F.coalesce(again, F.lit("|"))).otherwise(F.when(before.isNotNull(), "|").otherwise(""))

    return F.filter(F.split(F.array_join(F.transform(tokens, adds), ""), r"\|+"), lambda run: run != "")


def only_of_length(runs: Column, n: int) -> Column:
    """The only distinct one of digit_runs' values with n digits, else null."""
    fit = F.array_distinct(F.filter(runs, lambda r: F.length(r) == n))
    return F.when(F.size(fit) == 1, F.get(fit, F.lit(0)))


@dataclass(frozen=True)
class Field:
    """What a form field must look like."""

    kind: str  # identifier, phone, email or text
    label: str
    prefix: str = ""
    digits: int | None = None
    first: str = ""
    shortest: int = 0

    def canonical(self, value):
        """Column: digits after the prefix, an address without spaces, or a collapsed text."""
        clean = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
        if self.kind in ("identifier", "phone"):
            return F.concat(F.lit(self.prefix), F.regexp_replace(clean, "[^0-9]", ""))
        return F.lower(F.replace(clean, F.lit(" "), F.lit(""))) if self.kind == "email" else clean

    def state(self, value):
        """Column: missing, incomplete_speech, invalid_format or unverified (well-formed)."""
        c = self.canonical(value)
        out = F.when(F.coalesce(value, F.lit("")) == "", "missing")
        if self.digits is not None:
            n = F.length(c) - len(self.prefix)
            out = out.when(n < self.digits, "incomplete_speech").when(n > self.digits, "invalid_format")
            if self.first:
                out = out.when(~F.substring(c, len(self.prefix) + 1, 1).isin(*self.first), "invalid_format")
        if self.shortest:
            out = out.when(F.length(c) < self.shortest, "incomplete_speech")
        if self.kind == "email":
            out = out.when(~c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "invalid_format")
        return out.otherwise("unverified")

    def masked(self, value):
        """Column: what may be shown; null for nothing."""
        c = self.canonical(value)
        if self.kind == "email":
            shown = F.when(F.contains(c, F.lit("@")), F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))).otherwise("***")
        elif self.kind in ("identifier", "phone"):
            shown = F.concat(F.lit("***"), F.when(F.length(c) >= 4, F.right(c, F.lit(4))).otherwise(F.right(c, F.lit(1))))
        else:
            shown = F.lit("[provided]")
        return F.when(F.coalesce(value, F.lit("")) != "", shown)


#: What is taken for an identifier, where the form names no prefixes of its own: a long run of letters and digits.
IDENTIFIER = r"[A-Z0-9]{10,}"


def with_aliases(text: str | None, aliases: list[tuple[str, str]], identifier: str = IDENTIFIER) -> tuple[str, list[str]]:
    """Replaces whole-word aliases by their canonical form, in order, except inside identifiers; and the canonical forms that were used.

    aliases: (alias, canonical), by falling priority. Each sees what the ones before it made. identifier: a pattern, whatever the case.
    """
    held_back = re.compile(rf"\b(?:{identifier})\b", re.I)
    now, used = " ".join((text or "").split()), []
    for alias, canonical in aliases:
        pattern = re.compile(rf"(?<!\w){re.escape(alias)}(?!\w)", re.I)
        parts, at = [], 0
        for held in held_back.finditer(now):
            # Only the text between identifiers is rewritten; words next to one are whole there, too.
            parts += [pattern.sub(lambda _, c=canonical: c, now[at : held.start()]), held[0]]
            at = held.end()
        new = " ".join("".join([*parts, pattern.sub(lambda _, c=canonical: c, now[at:])]).split())
        if new != now:
            now = new
            if canonical not in used:
                used.append(canonical)
    return now, used


def aliases_udf(aliases: list[tuple[str, str]]):
    """A column function: struct(text, used). Aliases go to the tasks with it; at most 10,000."""
    if len(aliases) > 10_000:
        raise ValueError("too many aliases to apply one by one")
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("used", T.ArrayType(T.StringType()))])

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([with_aliases(t, aliases) for t in s], columns=["text", "used"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, kind)
