import re

import pytest
from pyspark.sql import functions as F

from talkgrain.functions import spans
from talkgrain.operators import memory, provenance


def test_matches_against_plain_search(spark):
    texts = ["", None, "a1b22", "😀 12 é 3", "7" * 5, "x " + "9 y " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", spans.matches(F.col("t"), "[0-9]+").alias("m")).collect():
        assert [tuple(m) for m in r.m] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", r.t or "")]


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("john at example dot com", ["john@example.com"]),
        ("it's j dot doe at the rate mail dot example point org ok", ["j.doe@mail.example.org"]),
        ("x at sign y dot z", ["x@y.z"]),
        ("see A.B+c@Example.co.uk.", ["a.b+c@example.co.uk"]),
        ("look at home. Then dot", []),
        ("we met at noon", []),
        ("a@b.com, c@d.com", ["a@b.com", "c@d.com"]),
        ("email kim at uh the domain example dot in", ["kim@example.in"]),
        ("email kim at uh a dot b or lee at um a dot b", ["kim@a.b", "lee@a.b"]),
        ("my e mail is nothing at all", []),
        ("😀 é x@y.zz", ["x@y.zz"]),
        ("", []),
        (None, []),
        ("at at dot dot . @ .", []),
    ],
)
def test_addresses(spark, said, found):
    got = spark.createDataFrame([(said,)], "t string").select(spans.addresses(F.col("t")).alias("a")).first().a
    assert [a.value for a in got] == found
    for a in got:
        part = said[a.start : a.end]
        assert part[0].lower() == a.value[0] and part[-1].lower() == a.value[-1] and part == part.strip()


def test_provenance(spark):
    turns = spark.createDataFrame([(1, 0, "My number is 12-34."), (1, 2, "it is Green, or green"), (1, 5, None), (1, 7, "the number 12 again: greens"), (1, 9, "GREEN"), (2, 0, "green")], "c int, turn int, text string")
    values = [(1, 7, "green"), (1, 9, "green"), (1, 9, "12-34"), (1, 7, "12-34"), (1, 7, "number"), (1, 2, "the"), (1, 9, None), (1, 9, "!"), (2, 0, "green"), (2, 5, "green"), (1, 7, "green"), (1, 7, "Is Green")]
    df = spark.createDataFrame([(*v, i) for i, v in enumerate(values)], "c int, at int, value string, turn_ int")
    got = {r.turn_: (r.status, r.n_turns, r.turn, r.start, r.end) for r in provenance.said_in(df, turns, "c").collect()}
    none = (None, None, None)
    assert got == {
        0: ("found", 1, 2, 6, 11), 1: ("ambiguous", 2, *none), 2: ("missing", 0, *none), 3: ("found", 1, 0, 13, 18), 4: ("ambiguous", 2, *none), 5: ("missing", 0, *none),
        6: ("missing", 0, *none), 7: ("missing", 0, *none), 8: ("found", 1, 0, 0, 5), 9: ("missing", 0, *none), 10: ("found", 1, 2, 6, 11), 11: ("found", 1, 2, 3, 11),
    }


def test_budget_against_one_pass(spark):
    import random

    r = random.Random(5)
    said = ["aa bb", "AA  bb", "c" * 30, "xx " + "c" * 30 + " yy", "d" * 7, "", None, "e f g"]
    rows = [(k, i, r.choice(["developer", "user", None]), r.choice(said)) for k in range(40) for i in range(r.randint(0, 9))]
    want = []
    for k in range(40):
        mine = [m for m in rows if m[0] == k]
        norm = lambda t: " ".join((t or "").split()).lower()
        seen, used, lead = set(), 0, []
        for m in [m for m in mine if m[2] == "developer"] + [m for m in mine[::-1] if m[2] != "developer"]:
            n = norm(m[3])
            told = m[2] != "developer" and len(n) >= 24 and n in " ".join(lead)
            if n and n not in seen and used < 20 + k and not told:
                want.append((k, m[1], m[2], m[3][: 20 + k - used]))
                used += len(want[-1][3])
                seen.add(n)
                if m[2] == "developer":
                    lead.append(norm(want[-1][3]))
    df = spark.createDataFrame(rows, "k int, o int, role string, content string")
    got = [tuple(x) for b in (0, 17, 39) for x in memory.within_budget(df.filter(F.col("k") == b), "k", "o", 20 + b).collect()]
    assert sorted(got, key=str) == sorted((w for w in want if w[0] in (0, 17, 39)), key=str)
