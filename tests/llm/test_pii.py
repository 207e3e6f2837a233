import math
import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch
from talkgrain.llm.pii import KINDS, LABELERS, SHAPE, candidates, cells, classifier, label_model, personal_data, running
from tests.llm.fixtures import documents, empty, rows, with_null_id

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else None, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if ok(k, m[0])]


def same(docs, texts, base=base):
    got = rows(personal_data(docs, Scratch(docs.sparkSession, "t")))
    want = Counter()
    for i, t in texts:
        b = base(t)
        n = [sum(x.startswith(k) for x in b) for k in KINDS]
        want[i, *n, sha256(",".join(b).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], *(r[f"n_{k}"] for k in KINDS), r["base_sha256"]) for r in got) == want
    for r in got:
        assert len(r["spans"].split(",") if r["spans"] else []) == sum(r[f"n_{k}"] for k in KINDS) + r["n_added"]
    return got


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, _base int, spans string").repartition(3)


def test_base_against_plain_patterns(spark):
    r = random.Random(3)
    parts = ["a", "b.c", "@", "@x", ".", "..", "-", "+", "+1", "1", "23", "255", "256", "0007", " ", "  ", "(", ")", "é", "😀", "\n", "_%", "4111111111111111", "4111 1111-1111 1111", "555", "@x.yy", "\x01", "\x02"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(2500)]
    texts += ["@".join("a.b_c@d.e-f" for _ in range(5)), "1.2.3.4.5.6.7.8.9", "1.2.3.4.1.2.3.4 1.2.3.4.300.1.1.1", "+1 (504) 555-2652+1 (504) 555-2652", "a@b.c_d@e.f", "+123 . - 4567890 -", "0" * 13, ""]
    same(frame(spark, texts), list(enumerate(texts)))


def test_long_texts(spark):
    """Runs that a backtracking search would take for ever over, or fall over, and more matches than a block."""
    known = {"x" * 300_000: [], "a" * 200_000 + "@": [], "a@b" + ".c" * 100_000: ["email:0:200003"], "1 " * 150_000: [], "9" * 300_000: [], "+1" + " " * 200_000: [], "1-" * 90_000 + "a": []}
    known["1." * 100_000] = [f"ip:{8 * i}:{8 * i + 7}" for i in range(25_000)]
    texts = [*known, "+1 (504) 555-2652, ann@site.org 10.0.0.1; " * 4000, " ( 1 at . dot " * 20_000, " at a dot" * 30_000, "@" * 100_000]
    same(frame(spark, texts), list(enumerate(texts)), lambda t: known[t] if t in known else base(t))


def test_odd_tables(spark):
    docs = with_null_id(spark).unionByName(documents(spark))
    same(docs, [(r["doc_id"], r["text"]) for r in rows(docs)])
    assert personal_data(empty(spark), Scratch(spark, "t")).collect() == []
    lonely = frame(spark, ["nothing here", None])
    assert [r["spans"] for r in same(lonely, [(0, "nothing here"), (1, None)])] == ["", ""]


EVIDENCE = [f"Call me, phone +1 (2{i:02}) 555-7{i:03}, or mail to ann{i}@site{i}.org" for i in range(10, 40)]
EVIDENCE += [f"card 4{i:014}{next(c for c in range(10) if luhn(f'4{i:014}{c}'))} of server 11.{i}.7.9" for i in range(10, 40)]
EVIDENCE += [f"order 9{i:014}{next(c for c in range(10) if not luhn(f'9{i:014}{c}'))} version 7.{i}.900.1" for i in range(10, 40)]
HIDDEN = [
    ("write to jane.roe [at] mail [dot] org now", "email", "jane.roe [at] mail [dot] org"),
    ("write to jane at mail dot org now", "email", "jane at mail dot org"),
    ("Tel: (504) 555-2652.", "phone", "(504) 555-2652"),
    ("mobile 0044 20 7946 0958", "phone", "0044 20 7946 0958"),
    ("call 00445550123457 now", "phone", "00445550123457"),
    ("my card 4111.1111.1111.1111 ok", "card", "4111.1111.1111.1111"),
    ("login at host 10[.]1[.]2[.]3 today", "ip", "10[.]1[.]2[.]3"),
]
CLEAN = ["than of nt 0054994038693466 the", "a 5551234567 b", "look at the dot on it", "order 4111.1111.1111.1112", "the year 2024 1012 3344 was", "isbn 978-3-16-148410-0", "see version 10[.]1[.]2[.]3", "at 12.10.2024 they met", "a @ b", "chapters 1. 2. 3. 4 of it", "x" * 50 + " 123456789", "call 12345", "phone a1234567890"]


def test_method_adds_what_is_written_otherwise(spark):
    texts = EVIDENCE + [t for t, *_ in HIDDEN] + CLEAN
    got = {r["doc_id"]: r for r in same(frame(spark, texts), list(enumerate(texts)))}
    for i, t in enumerate(texts):
        want = base(t)
        for h, kind, m in HIDDEN:
            if h == t:
                want.append(f"{kind}:{t.index(m)}:{t.index(m) + len(m)}")
        order = lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1]))
        assert got[i]["spans"] == ",".join(sorted(want, key=order)), t


def test_no_candidate_overlaps_the_base(spark):
    text = "".join(f"+1 (504) 555-{i:04}; 4111 1111 1111 1111; {i % 250}.1.2.3; a@b.co; c [at] d [dot] com, ({i:03}) 555 1234; " for i in range(600))
    found = rows(candidates(frame(spark, [text])))[0]
    taken = set()
    for s in found["base"]:
        taken.update(range(s["start"], s["end"]))
    assert len(found["base"]) >= 600 * 4
    assert [text[s["start"] : s["end"]] for s in found["more"]] == [m for i in range(600) for m in ("c [at] d [dot] com", f"({i:03}) 555 1234")]
    assert not any(set(range(s["start"], s["end"])) & taken for s in found["more"])


def test_estimates_against_a_plain_computation(spark):
    table = cells(candidates(frame(spark, EVIDENCE + [t for t, *_ in HIDDEN] + CLEAN))).coalesce(1)
    spans = rows(table)
    logit = lambda p: math.log(p / (1 - p))
    rates = {(k, f): (0.8, 0.2) for k in range(4) for f in LABELERS}
    prior = dict.fromkeys(range(4), 0.0)
    for step in range(41):
        for s in spans:
            odds = prior[s["kind"]]
            for f in LABELERS:
                p, q = rates[s["kind"], f]
                odds += {"1": math.log(p / q), "0": math.log((1 - p) / (1 - q)), "-": 0}[s[f]]
            s["p"] = 1 / (1 + math.exp(-odds))
        old, rates, prior = rates, {}, {}
        total = lambda k, test, yes: sum(s["n"] * (s["p"] if yes else 1 - s["p"]) for s in spans if s["kind"] == k and test(s))
        for k in {s["kind"] for s in spans}:
            prior[k] = math.log((total(k, lambda s: True, True) + 1) / (total(k, lambda s: True, False) + 1))
            for f in LABELERS:
                rates[k, f] = tuple((total(k, lambda s: s[f] == "1", y) + (4 if y else 1)) / (total(k, lambda s: s[f] != "-", y) + 5) for y in (True, False))
        if step and all(abs(a - b) < 1e-3 for r in rates for a, b in zip(rates[r], old[r], strict=True)):
            break
    got, weights = label_model(table)
    for r in got:
        assert got[r] == pytest.approx(rates[r], abs=2e-3)
    assert got[KINDS.index("card"), "check"][0] > 0.9 > 0.2 > got[KINDS.index("card"), "check"][1]
    model = classifier(table, weights)
    assert all(f"{k}|{f}|{s[f]}" in model for s in spans for k in [s["kind"]] for f in (*LABELERS, *SHAPE))


def test_running(spark):
    r = random.Random(1)
    cases = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000, 5000)]
    df = spark.createDataFrame([(c,) for c in cases], "x array<bigint>")
    got = df.select("x", running(F.col("x"), lambda a, b: a + b, F.lit(0).cast("bigint")).alias("s")).collect()
    for g in got:
        assert g.s == [sum(g.x[: i + 1]) for i in range(len(g.x))]
