"""Where things stand in a text, and what a dictation says. Column expressions only.

A dictated address is found in the kinds of its tokens: each token is a letter of a short string, so that a pattern over kinds gives the tokens, and these
the places in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bound(x: Column, f) -> Column:
    """f of x, with x computed once, however often f reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running_sum(x: Column) -> Column:
    """Sums of an array's elements up to each; blocks first, so that long arrays don't take the square of their length."""
    add, zero = (lambda a, b: a + b), F.lit(0)
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
    each = lambda c: F.zip_with(
        c["blocks"],
        bound(F.transform(c["blocks"], lambda b: F.aggregate(b, zero, add)), lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), zero, add))),
        lambda b, before: F.transform(b, lambda _, j: F.aggregate(F.slice(b, F.lit(1), j + 1), before, add)),
    )
    some = bound(x, lambda x: F.when(F.size(x) > 0, F.flatten(bound(F.struct(cut(x).alias("blocks")), each))))
    return F.coalesce(some, F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that matches no empty text: array of (start, end, text), in code points from 0, the end exclusive."""

    def placed(p: Column) -> Column:
        lengths = F.transform(F.arrays_zip(p["gaps"].alias("g"), p["hits"].alias("h")), lambda x: F.length(x["g"]) + F.length(x["h"]))
        ends = running_sum(F.slice(lengths, F.lit(1), F.size(p["hits"])))
        return F.zip_with(ends, p["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("text")))

    text = F.coalesce(text, F.lit(""))
    return bound(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)


#: What is said for the signs of an address.
AT_WORDS, DOT_WORDS = ("at",), ("dot", "point")
_TOKEN = r"[A-Za-z0-9_%+-]+|[^\sA-Za-z0-9_%+-]"


def _kinds(tokens: Column) -> Column:
    """A letter for each token: a for at, s for the words that may follow a spoken at, d for a dot, w for a word, x for all else.

    A written dot counts between two words that touch it only, so that the end of a sentence isn't one.
    """

    def kind(t: Column, i: Column) -> Column:
        word = lambda k: F.lower(F.get(tokens, i + k)["text"])
        at, glued = word(0).isin(*AT_WORDS), (F.get(tokens, i - 1)["end"] == t["start"]) & (F.get(tokens, i + 1)["start"] == t["end"])
        follows = (word(0).isin("the", "sign") & word(-1).isin(*AT_WORDS) & ((word(0) == "sign") | (word(1) == "rate"))) | ((word(0) == "rate") & (word(-1) == "the") & word(-2).isin(*AT_WORDS))
        said = F.when(follows, "s").when(at | (t["text"] == "@"), "a").when(word(0).isin(*DOT_WORDS) | ((t["text"] == ".") & glued), "d")
        return said.when(t["text"].rlike("^[A-Za-z0-9_%+-]"), "w").otherwise("x")

    return F.array_join(F.transform(tokens, kind), "")


def _written(tokens: Column, kinds: Column, start: Column, end: Column) -> Column:
    """The tokens from start to end as an address is written."""
    part = F.transform(F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0))), lambda t, i: bound(F.substring(kinds, start + i + 1, F.lit(1)), lambda k: F.when(k == "a", "@").when(k == "d", ".").when(k == "s", "").otherwise(F.lower(t["text"]))))
    return F.array_join(part, "")


def addresses(text: Column) -> Column:
    """The e-mail addresses that a dictation spells or writes: array of (value, start, end) by their places.

    Strictly, words and dots, an at, words and dots. A text that speaks of an e-mail but has none so, is read loosely: for each at the word before it and the
    first dotted words after it, whatever is between.
    """
    tokens = matches(text, _TOKEN)

    def found(p: Column) -> Column:
        t, k = p["tokens"], p["kinds"]
        spot = lambda i, j, value: F.struct(value.alias("value"), F.get(t, i)["start"].alias("start"), F.get(t, j - 1)["end"].alias("end"))
        strict = F.transform(matches(k, "w(?:dw)*as*w(?:dw)+"), lambda m: spot(m["start"], m["end"], _written(t, k, m["start"], m["end"])))

        def loose(m: Column) -> Column:
            rest = F.substring(k, m["start"] + 2, F.length(k))
            gap, domain = F.length(F.regexp_extract(rest, "^(.*?)w(?:dw)+", 1)), F.length(F.regexp_extract(rest, "^.*?(w(?:dw)+)", 1))
            local = F.length(F.regexp_extract(F.substring(k, F.lit(1), m["start"]), "^(.*w)", 1)) - 1
            at = bound(F.struct((m["start"] + 1 + gap).alias("from"), (m["start"] + 1 + gap + domain).alias("to"), local.alias("local")), lambda s: F.when((s["local"] >= 0) & (domain > 0), spot(s["local"], s["to"], F.concat(F.lower(F.get(t, s["local"])["text"]), F.lit("@"), _written(t, k, s["from"], s["to"])))))
            return at

        mentions = F.exists(t, lambda x: F.lower(x["text"]).isin("email", "e-mail"))
        loosely = F.when(mentions, F.filter(F.transform(F.filter(matches(k, "a"), lambda m: m["start"] > 0), loose), lambda x: x.isNotNull()))
        return F.when(F.size(strict) > 0, strict).otherwise(F.coalesce(loosely, F.slice(strict, 1, 0)))

    return bound(tokens, lambda t: bound(F.struct(t.alias("tokens"), _kinds(t).alias("kinds")), found))


def only_value(spans: Column) -> Column:
    """The value of spans that all say the same, else null."""
    return bound(F.array_distinct(F.transform(spans, lambda s: s["value"])), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))
