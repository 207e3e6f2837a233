from datetime import datetime

import pytest
from pyspark.sql import functions as F

from talkgrain.functions import facts
from talkgrain.operators import memory, tables

C = F.col


def test_facts(spark):
    df = spark.createDataFrame([("What did I say in my last call? In a previous call.", " Pref. Name! ", "kim lee. And more", "name"), ("this call", "A--b", " \"Tea, mostly\" ", "likes"), (None, None, None, None)], "t string, k string, v string, kind string")
    r = df.select(facts.asks_to_recall(C("t")).alias("a"), facts.fact_key(C("k")).alias("k"), facts.fact_value(C("v"), C("kind")).alias("v")).collect()
    assert [tuple(x) for x in r][:2] == [(True, "pref_name", "Kim"), (False, "a_b", "Tea, mostly")] and not r[2].a
    v = spark.createDataFrame([("active", "name", "Unknown"), ("active", "name", "Kim"), ("old", "x", "y"), ("active", "x", ""), (None, None, None)], "s string, k string, v string")
    assert [x[0] for x in v.select(facts.valid_fact(C("s"), C("k"), C("v"), ["unknown"])).collect()] == [False, True, False, False, False]
    t = spark.createDataFrame([(0.9, None), (0.9, True), (0.8, False), (None, None)], "c double, t boolean")
    assert [x[0] for x in t.select(facts.trusted(C("c"), C("t"))).collect()] == [True, False, False, False]


def test_json(spark):
    m = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"c": 1}), ({"a": 1}, None)], "o map<string,int>, n map<string,int>")
    assert [r[0] for r in m.select(facts.merged_maps(C("o"), C("n"))).collect()] == [{"a": 1, "b": 3}, {"c": 1}, {"a": 1}]
    j = spark.createDataFrame([('x ```json\n{"a": {"b": 1}}\n``` y',), ("none",), ("{broken",), (None,)], "t string")
    assert [r[0] for r in j.select(F.to_json(facts.fenced_json(C("t")))).collect()] == ['{"a":{"b":1}}', None, None, None]
    deep = '{"a": {"API-Key": "x", "list": [1, {"my_password": 2}]}, "ok": null}'
    s = spark.createDataFrame([(deep,), ("no",), (None,)], "t string").select(facts.sanitized_json("t")).collect()
    assert [r[0] for r in s] == ['{"a": {"API-Key": "[REDACTED]", "list": [1, {"my_password": "[REDACTED]"}]}, "ok": null}', None, None]
    assert facts.sanitized([[[[[[[[1]]]]]]]]) == [[[[[[["[TRUNCATED_DEPTH]"]]]]]]]


def test_budget(spark):
    ms = [{"role": "developer", "content": "You know that the customer likes green tea."}, {"role": "user", "content": "hi"}, {"role": "user", "content": "the customer likes green tea."}, {"role": "assistant", "content": "Hello there"}, {"role": "user", "content": "hello  THERE"}]
    df = spark.createDataFrame([(1, i, m["role"], m["content"]) for i, m in enumerate(ms)] + [(2, 0, "user", None), (2, 1, None, "x")], "k int, o int, role string, content string")
    got = sorted((r.k, r.o, r.content) for r in memory.within_budget(df, "k", "o", 54).collect())
    assert got == [(1, 0, ms[0]["content"]), (1, 4, "hello  THERE"[: 54 - len(ms[0]["content"])]), (2, 1, "x")]
    assert sorted((r.k, r.o) for r in memory.within_budget(df, "k", "o", 1000).collect()) == [(1, 0), (1, 1), (1, 4), (2, 1)]
    hits = [{"title": "T", "source": "s", "score": 0.5, "answer": "a" * 500}] * 3
    cut = facts.context_lines(hits, 200, 600, lambda t, n: t[:n])
    assert len(cut) <= 600 and cut.startswith("[1] T | source=s | score=0.500\naaa") and "[3]" in cut


def test_tables(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1), (3, "e", 1)], "k int, v string, seq int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.insert_missing(cur, new, ["k"])) == [(3, "e", 1)]
    assert rows(tables.upsert(cur, new, ["k"], "seq")) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert rows(tables.replace_group(cur, new, ["k"])) == [(1, "a", 1), (2, "c", 2), (2, "d", 3), (3, "e", 1), (3, "e", 1)]
    stay, gone = tables.purge(cur, C("k") == 1, "k")
    assert rows(stay) == [(2, "b", 1)] and rows(gone) == [(1,)]
    assert rows(tables.forget_owner(cur, "k", spark.createDataFrame([(2,)], "k int"))) == [(1, "a", 1)]
    log = spark.createDataFrame([(1, "delete", datetime(2024, 1, 1), 1), (1, "restore", datetime(2024, 1, 2), 2), (2, "delete", datetime(2024, 1, 1), 1), (3, "delete", datetime(2023, 1, 1), 1)], "k int, kind string, at timestamp, seq int")
    assert rows(tables.deletion_state(log, "k", "seq", F.lit(datetime(2024, 1, 3)), 7)) == [(1, False, False), (2, True, True), (3, True, False)]
    r = tables.rolling(spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, o int, v double"), "k", "o", "v", 3).orderBy("o").collect()[-1]
    assert (r.min, r.max, r.avg, r["last"]) == (2.0, 4.0, 3.0, 4.0)


def test_releases(spark):
    u = spark.createDataFrame([(1, "draft"), (2, "draft"), (3, "retired")], "unit_id int, status string")
    c = spark.createDataFrame([(2, 9, "open"), (1, 9, "resolved")], "left_id int, right_id int, status string")
    done = tables.approve(u, F.lit(True), c)
    assert {r.unit_id: r.status for r in done.collect()} == {1: "approved", 2: "draft", 3: "retired"}
    ru = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "version int, unit_id int")
    e = spark.createDataFrame([(1,)], "unit_id int")
    assert tables.release_report(ru, done, e, c, 1).first().valid and tuple(tables.release_report(ru, done, e, c, 2).first()) == (2, 1, 1, 1, False)
    rel = spark.createDataFrame([(1, "superseded"), (2, "published")], "version int, status string")
    assert {r.version: r.status for r in tables.rollback(rel, 1).collect()} == {1: "published", 2: "superseded"}
    with pytest.raises(ValueError, match="superseded"):
        tables.rollback(rel, 2)
