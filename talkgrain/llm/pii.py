"""Personal data by weak supervision. DataFrame functions only.

Strict patterns give the base spans, wider ones further candidates. Labelers of three sorts vote on every candidate or abstain: patterns (the strict
form, a check of its numbers), gazetteers (top-level domains, card issuers, calling codes, address ranges) and context (cue words before, what adjoins).
Expectation-maximisation (Dawid and Skene 1979) over the counts of vote patterns estimates, without labels, how reliable each labeler is for each kind.
Its soft labels train the span classifier, a log-linear one over votes and shape. Base spans stay; candidates that the classifier is sure of join them.

Texts are never shuffled: spans are found, placed and voted on in arrays within a row, in time proportional to a text but for its number of matches / 256
times that number. What is shuffled are counts of vote patterns, at most some thousand rows whatever the corpus; the driver gets sums of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The kinds' patterns, written so that a match never backtracks over what it has read and no start inside a failed run is tried again; they match what
#: name@label.label, four dotted numbers, digits with single spaces or hyphens, and + with digits, spaces, dots, hyphens and parentheses match greedily.
STRICT = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be worth a try.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_DOT = r"(?:\.|\x20?[\[({<](?i:dot)[\])}>]\x20?|\x20(?i:dot)\x20)"
#: Addresses with written signs or spaces, and runs of digits with up to three separators between two of them.
WIDE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++(?:\x20?@\x20?|\x20?[\[({{<](?i:at)[\])}}>]\x20?|\x20(?i:at)\x20(?={LABEL}++\x20(?i:dot)\x20)){LABEL}++(?:{_DOT}{LABEL}++)++",
    "number": r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./_\[\]-]{0,3}+[0-9])++",
}
WIDE_HINT = {"email": r"@|[\[({<](?i:at)[\])}>]|\x20(?i:dot)\x20", "number": r"[0-9](?:[\x20()./_\[\]-]{0,3}+[0-9]){8}|[0-9](?:[\[(]?\.[\])]?[0-9]{1,3}){3}"}
#: A number of more characters isn't a candidate: 19 digits with three separators between two have 73.
LONGEST = 80
DOMAINS = "com org net edu gov mil int info biz name io co app dev ai me tv de fr es it uk ie at ch nl be dk se no fi pl cz pt gr ru ua us ca mx br ar cl au nz jp cn kr in za eu".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 421 971 972".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9])"
CUES = {
    "email": r"(?:e-?mail|mail|contact|write|reach|correo|courriel)",
    "ip": r"(?:\bip\b|ipv4|addr|host|server|login|client|serveur|servidor)",
    "card": r"(?:card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta)",
    "phone": r"(?:phone|tel|call|mobile|cell|fax|whatsapp|sms|ruf|handy|appel|llam)",
}
#: Words that announce other numbers.
OTHERS = r"(?:version|release|build|isbn|issn|order|invoice|serial|ticket|sku|chapter|section|art|nr|no|id|ref|#)[\x20.:#=]*$"
CONTEXT = 32
LABELERS = ("form", "check", "gazetteer", "cue", "edge")
SHAPE = ("length", "signs")
#: The classifier must be so sure of a span that the base doesn't have.
SURE = 0.9
ROUNDS, SETTLED = 40, 1e-3

SPAN = "struct<kind:int,start:bigint,end:bigint,text:string,before:string,after:string>"


def let(x: Column, f) -> Column:
    """f of x, with x computed once, however often and in whatever lambdas f reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(x: Column, add, zero: Column) -> Column:
    """For each element of an array, that and all before it combined. Blocks of 256, then the blocks: no element is read more than 256 + n / 256 times."""
    block = 256

    def of(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block)))

    def joined(cut: Column, whole: Column) -> Column:
        before = F.transform(whole, lambda _, i: F.aggregate(F.slice(whole, F.lit(1), i), zero, add))
        return F.flatten(F.zip_with(cut, before, lambda b, s: F.transform(b, lambda _, j: F.aggregate(F.slice(b, F.lit(1), j + 1), s, add))))

    found = let(x, lambda x: F.when(F.size(x) > 0, let(of(x), lambda cut: let(F.transform(cut, lambda b: F.aggregate(b, zero, add)), lambda whole: joined(cut, whole)))))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def matches(df: DataFrame, name: str, pattern: str, hint: str, kind: Column | None = None) -> DataFrame:
    """df(text, ...) with a column of all matches in the text: where they start and end, themselves, what is before and the character after.

    Splitting at a pattern gives what is between its matches, from the same search as the matches themselves; their lengths give the places.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_gaps", F.when(F.col("text").rlike(hint), F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("_hits", F.when(F.size("_gaps") > 1, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    both = F.zip_with("_hits", "_gaps", lambda h, g: (F.length(h) + F.length(g)).cast("bigint"))
    df = df.withColumn("_ends", running(F.when(F.size("_hits") > 0, F.slice(both, F.lit(1), F.size("_hits"))).otherwise(F.array().cast("array<bigint>")), lambda a, b: a + b, F.lit(0).cast("bigint")))
    parts = F.zip_with("_hits", F.zip_with("_gaps", F.slice("_gaps", F.lit(2), F.greatest(F.size("_gaps"), F.lit(1))), lambda g, n: F.struct(g.alias("g"), n.alias("n"))), lambda h, g: F.struct(h.alias("h"), g.alias("g")))
    parts = F.filter(F.zip_with("_ends", parts, lambda e, x: F.struct(e.alias("end"), x["h"].alias("h"), x["g"]["g"].alias("gap"), x["g"]["n"].alias("next"))), lambda x: x["h"].isNotNull())

    def one(x: Column) -> Column:
        return F.struct(
            (kind if kind is not None else F.lit(KINDS.index(name) if name in KINDS else -1)).alias("kind"),
            (x["end"] - F.length(x["h"])).alias("start"),
            x["end"].alias("end"),
            x["h"].alias("text"),
            F.substring(x["gap"], -CONTEXT, CONTEXT).alias("before"),
            F.substring(x["next"], 1, 1).alias("after"),
        )

    return df.withColumn(f"_{name}", F.transform(parts, one)).drop("_gaps", "_hits", "_ends")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits, not too long, passes the check that card numbers pass."""
    r = F.reverse(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(r, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def octets(m: Column) -> Column:
    """Whether four numbers, whatever their separators, are at most 255 each."""
    parts = F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")
    small = lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int") <= 255).otherwise(False)
    return (F.size(parts) == 4) & F.forall(parts, small)


def valid(kind: str):
    """Whether a match of the strict pattern is a base span."""

    def test(s: Column) -> Column:
        m = s["text"]
        n = F.length(digits(m))
        if kind == "card":
            return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)
        return {"email": F.lit(True), "ip": octets(m), "phone": n.between(9, 15)}[kind]

    return test


def kind_of_number(m: Column) -> Column:
    """The kind that a run of digits could be, or null."""
    d = digits(m)
    n = F.length(d)
    dotted = m.rlike(r"^[0-9]{1,3}(?:[\[(]?\.[\])]?[0-9]{1,3}){3}$")
    kind = F.when(dotted, KINDS.index("ip")).when(d.startswith("00") & n.between(11, 17), KINDS.index("phone")).when(n.between(13, 19), KINDS.index("card")).when(n.between(9, 12), KINDS.index("phone"))
    return F.when(F.length(m) <= LONGEST, kind)


def _by_kind(kind: Column, cases: dict) -> Column:
    out = F.when(kind == -1, F.lit("-"))
    for k, c in cases.items():
        out = out.when(kind == KINDS.index(k), c)
    return out.otherwise("-")


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, 0 or - for none; without `no` whatever isn't yes is no."""
    return F.when(yes, "1").when(F.lit(True) if no is None else no, "0").otherwise("-")


def votes(s: Column, strict: bool) -> Column:
    """A span with its labelers' votes and its shape, all as short strings."""
    kind, m, d = s["kind"], s["text"], digits(s["text"])
    before, low = F.lower(s["before"]), F.lower(s["text"])
    top = F.regexp_extract(low, "([a-z0-9-]+)$", 1)
    first = F.regexp_replace(F.regexp_extract(m, "([0-9]+)", 1), "^0+(?=.)", "")
    local = F.regexp_extract(low, r"^([a-z0-9._%+-]+)", 1)
    abroad = F.when(m.startswith("+"), d).when(d.startswith("00"), F.substring(d, 3, 20))
    check = {
        "email": _vote(top.rlike("^[a-z]{2,}$") & ~local.rlike(r"^\.|\.\.|\.$")),
        "ip": _vote(octets(m)),
        "card": _vote(F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)),
        "phone": _vote((F.length(d).between(9, 15) | (d.startswith("00") & F.length(d).between(11, 17))) & ~d.rlike(r"^(.)\1*$")),
    }
    gazetteer = {
        "email": _vote(top.isin(DOMAINS)),
        "ip": _vote((F.length(first) <= 3) & F.concat(F.lit("0"), F.substring(first, 1, 3)).cast("int").between(1, 223)),
        "card": _vote(d.rlike(ISSUERS)),
        "phone": _vote(abroad.rlike(f"^(?:{'|'.join(CALLING)})"), abroad.isNotNull()),
    }
    cue = {k: _vote(before.rlike(c), before.rlike(OTHERS)) for k, c in CUES.items()}
    near = lambda c: c.rlike(r"[\p{L}\p{N}_$%&*€£]")
    edge = _vote(~near(F.substring(s["before"], -1, 1)) & ~near(s["after"]))
    signs = F.when(m.rlike(r"[(\[{<]"), "b").when(m.rlike(r"\x20"), "s").when(m.rlike("[-/_]"), "h").when(m.rlike(r"\."), "d").otherwise("n")
    made = {"form": F.lit("1" if strict else "-"), "check": _by_kind(kind, check), "gazetteer": _by_kind(kind, gazetteer), "cue": _by_kind(kind, cue), "edge": edge}
    length = F.least(F.lit(9), F.floor(F.length(m) / 4)).cast("string")
    return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[v.alias(k) for k, v in made.items()], length.alias("length"), signs.alias("signs"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base, more: arrays of voted spans; `more` are candidates that overlap no base span."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k in KINDS:
        df = matches(df, k, STRICT[k], HINT[k])
        df = df.withColumn(f"_{k}", F.filter(f"_{k}", valid(k)))
    df = matches(df, "spelled", WIDE["email"], WIDE_HINT["email"], F.lit(KINDS.index("email")))
    df = matches(df, "number", WIDE["number"], WIDE_HINT["number"])
    numbers = F.transform("_number", lambda s: F.struct(kind_of_number(s["text"]).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "text", "before", "after")]))
    df = df.withColumn("_base", F.concat(*[F.col(f"_{k}").cast(f"array<{SPAN}>") for k in KINDS]))
    df = df.withColumn("_wide", F.concat(F.col("_spelled").cast(f"array<{SPAN}>"), F.filter(numbers, lambda s: s["kind"].isNotNull()).cast(f"array<{SPAN}>")))
    df = df.select("doc_id", "_base", "_wide")
    # Of all spans by start: the furthest end of a base span before, the nearest start of one after.
    far = F.lit(2**62)
    place = lambda base: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), s.alias("span"))
    df = df.withColumn("_all", F.when(F.size("_wide") > 0, F.array_sort(F.concat(F.transform("_base", place(True)), F.transform("_wide", place(False))))).otherwise(F.slice(F.transform("_base", place(True)), 1, 0)))
    df = df.withColumn("_until", running(F.transform("_all", lambda a: F.when(a["base"], a["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint")))
    df = df.withColumn("_from", F.reverse(running(F.reverse(F.transform("_all", lambda a: F.when(a["base"], a["start"]).otherwise(far))), lambda a, b: F.least(a, b), far)))
    # Zipped, as a column that a lambda refers to by index would be computed anew for each element.
    bounds = F.zip_with("_until", "_from", lambda u, f: F.struct(u.alias("until"), f.alias("next")))
    each = F.zip_with("_all", bounds, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    free = F.filter(each, lambda x: ~x["a"]["base"] & (x["b"]["until"] <= x["a"]["start"]) & (x["b"]["next"] >= x["a"]["end"]))
    return df.select("doc_id", F.transform("_base", lambda s: votes(s, True)).alias("base"), F.transform(free, lambda x: votes(x["a"]["span"], False)).alias("more"))


def cells(found: DataFrame) -> DataFrame:
    """How many spans have the same kind, votes and shape."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s")).select("s.kind", *[f"s.{c}" for c in (*LABELERS, *SHAPE)])
    return spans.groupBy("kind", *LABELERS, *SHAPE).agg(F.count("*").alias("n"))


def log_odds(kind: Column, features: dict, weights: dict) -> Column:
    """The sum of a span's weights, those of its kind alone and of each of its features."""
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, float(w))])
    get = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    return sum((get(F.concat_ws("|", kind.cast("string"), F.lit(f), v)) for f, v in features.items()), get(F.concat_ws("|", kind.cast("string"), F.lit("all"), F.lit("1"))))


def soft_counts(table: DataFrame, odds: Column, features: tuple) -> dict:
    """(kind, feature, value) to the numbers of spans that are and aren't personal data, by the odds given; some hundred rows."""
    p = 1 / (1 + F.exp(-odds))
    each = F.array(F.struct(F.lit("all").alias("f"), F.lit("1").alias("v")), *[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features])
    rows = table.select("kind", "n", p.alias("p"), F.explode(each).alias("e")).groupBy("kind", "e.f", "e.v").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    return {(r["kind"], r["f"], r["v"]): (r["yes"], r["no"]) for r in rows.collect()}


def reliabilities(counts: dict, trust: float = 4.0) -> dict:
    """(kind, labeler) to the probabilities that it votes yes on personal data and on other spans, if it votes.

    Smoothed as if it had judged five spans of either sort before, `trust` of them rightly.
    """
    out = {}
    for k, f in {(k, f) for k, f, _ in counts if f != "all"}:
        (a, c), (b, d) = (counts.get((k, f, v), (0.0, 0.0)) for v in "10")
        out[k, f] = ((a + trust) / (a + b + 5), (c + 5 - trust) / (c + d + 5))
    return out


def label_weights(rates: dict, counts: dict) -> dict:
    """Log-odds of each vote; an abstention says nothing."""
    out = {f"{k}|all|1": math.log((yes + 1) / (no + 1)) for (k, f, _), (yes, no) in counts.items() if f == "all"}
    for (k, f), (p, q) in rates.items():
        out |= {f"{k}|{f}|1": math.log(p / q), f"{k}|{f}|0": math.log((1 - p) / (1 - q))}
    return out


def label_model(table: DataFrame) -> tuple[dict, dict]:
    """Expectation-maximisation: the labelers' reliabilities and the weights of their votes. The first odds take each labeler to be right four times of five."""
    features = {f: F.col(f) for f in LABELERS}
    weights = {f"{k}|{f}|{v}": s * math.log(4) for k in range(len(KINDS)) for f in LABELERS for v, s in (("1", 1), ("0", -1))}
    rates: dict = {}
    for _ in range(ROUNDS):
        counts = soft_counts(table, log_odds(F.col("kind"), features, weights), LABELERS)
        new = reliabilities(counts)
        weights = label_weights(new, counts)
        settled = rates.keys() == new.keys() and all(abs(x - y) < SETTLED for k in new for x, y in zip(new[k], rates[k], strict=True))
        rates = new
        if settled:
            break
    return rates, weights


def classifier(table: DataFrame, weights: dict) -> dict:
    """Log-odds weights of votes (abstentions included) and shape, from the label model's soft labels; smoothed by one span of either sort for each value."""
    counts = soft_counts(table, log_odds(F.col("kind"), {f: F.col(f) for f in LABELERS}, weights), (*LABELERS, *SHAPE))
    out, values = {}, {}
    for k, f, v in counts:
        values.setdefault((k, f), set()).add(v)
    for (k, f, v), (yes, no) in counts.items():
        all_yes, all_no = counts[k, "all", "1"]
        m = len(values[k, f]) + 1
        out[f"{k}|{f}|{v}"] = math.log((yes + 1) / (no + 1)) if f == "all" else math.log((yes + 1) / (all_yes + m)) - math.log((no + 1) / (all_no + m))
    return out


def sure(s: Column, model: dict, labels: dict, least: float = SURE) -> Column:
    """Whether label model and classifier both take a candidate for personal data. Its numbers must pass their check, and a gazetteer or a cue must speak for it,
    a cue if it is an unbroken number, which could be a count or a key of anything."""
    at = math.log(least / (1 - least))
    votes_ = {f: s[f] for f in LABELERS}
    backed = (s["check"] == "1") & ((s["gazetteer"] == "1") | (s["cue"] == "1")) & (s["cue"] != "0") & (s["edge"] == "1") & ((s["signs"] != "n") | (s["cue"] == "1"))
    return backed & (log_odds(s["kind"], votes_, labels) >= at) & (log_odds(s["kind"], votes_ | {f: s[f] for f in SHAPE}, model) >= at)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: a row for each row of docs(doc_id, text).

    The counts and the hash are of base spans, `spans` has all, n_added those that the method adds. Offsets are code points from 0, the end exclusive.
    A null text is empty and has no spans. Other columns are ignored, whatever their names; null and repeated doc_ids are rows as any other.
    Spans of one kind don't overlap; those of two kinds may, in the base. A table without candidates adds nothing, an empty one gives an empty result.
    """
    found = scratch.write(candidates(docs), "found")
    table = scratch.write(cells(found).coalesce(1), "cells")
    _, labels = label_model(table)
    model = classifier(table, labels)
    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    added = F.filter("more", lambda s: sure(s, model, labels))
    out = found.withColumn("_added", F.transform(added, place)).withColumn("_base", F.transform("base", place))
    of = lambda i: lambda s: s["kind"] == i
    count = [F.size(F.filter("_base", of(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = F.array_sort(F.concat("_base", "_added"))
    return out.select("doc_id", *count, F.sha2(spelled(F.col("_base")), 256).alias("base_sha256"), spelled(spans).alias("spans"), F.size("_added").cast("bigint").alias("n_added"))
