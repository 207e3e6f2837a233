"""Streams against their batch twins, with events shuffled over micro-batches."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talkgrain.streaming import joins, ordered, run, sketches
from talkgrain.streaming import machines as m
from tests.test_streaming import KINDS, SCHEMA, events

BASE = 1_704_067_200_000  # 2024-01-01 in milliseconds


def dealt(tmp_path, name, parts):
    (tmp_path / name).mkdir()
    for i, part in enumerate(parts):
        (tmp_path / name / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        os.utime(tmp_path / name / f"{i}.json", (1_700_000_000 + i,) * 2)
    return str(tmp_path / name)


def drained(spark, df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert q.exception() is None and not q.isActive
    return spark.read.parquet(str(tmp_path / f"{name}-out")).select(*df.columns)


@pytest.mark.parametrize("machine", [m.TURNS, m.rate_limit(2, 86_400)])
def test_shuffled_events_give_the_rows_of_the_batch(spark, tmp_path, machine):
    e = events(spark, KINDS).withColumn("at", F.col("at") + BASE)
    rows = [r.asDict() for r in e.collect()]
    random.Random(2).shuffle(rows)
    last = max(r["at"] for r in rows) + 400 * 86_400_000
    flush = [[{"key": 99, "id": 1, "at": last + i, "kind": "text", "text": ""}] for i in range(2)]
    src = dealt(tmp_path, "in", [rows[i::4] for i in range(4)] + flush)
    out = drained(spark, ordered.ordered(run.event_stream(spark, src, SCHEMA, 1), machine, "200 days"), tmp_path, "m")
    got = sorted(repr(r) for r in out.filter("key <> 99").collect())
    assert got == sorted(map(repr, run.batch(e, machine).select(*out.columns).collect())) and got


def test_outer_join_of_two_streams(spark, tmp_path):
    r = random.Random(3)
    at = lambda s: (datetime(2024, 1, 1) + timedelta(seconds=s)).isoformat()
    starts = [{"key": i % 3, "tool_call_id": f"c{i}", "at": at(20 * i)} for i in range(30)]
    results = [{"tool_call_id": f"c{i}", "at": at(20 * i + r.choice([1, 50, 299, 300, 301, 900])), "status": r.choice(["ok", "failed", None, "timeout"])} for i in range(30) if i % 4]
    results += [results[2], {"tool_call_id": "c0", "at": at(-5), "status": "ok"}, {"tool_call_id": "none", "at": at(9), "status": "ok"}]
    kinds = "key long, tool_call_id string, at timestamp", "tool_call_id string, at timestamp, status string"
    batch = [spark.read.schema(k).json(dealt(tmp_path, f"b{i}", [rows])) for i, (rows, k) in enumerate(zip((starts, results), kinds, strict=True))]
    want = sorted(map(repr, joins.outcomes_within(*batch, 300, "1 hour").collect()))
    for rows in (starts, results):
        r.shuffle(rows)
    later = [at(9000), at(9001), at(9002)]
    parts = [starts[i::3] for i in range(3)] + [[{"key": 9, "tool_call_id": f"z{t}", "at": t}] for t in later]
    ends = [results[i::3] for i in (1, 2, 0)] + [[{"tool_call_id": f"y{t}", "at": t, "status": "ok"}] for t in later]
    sides = [run.event_stream(spark, dealt(tmp_path, f"s{i}", p), k, 1) for i, (p, k) in enumerate(zip((parts, ends), kinds, strict=True))]
    out = drained(spark, joins.outcomes_within(*sides, 300, "1 hour"), tmp_path, "j")
    got = sorted(repr(x) for x in out.filter("key <> 9").collect())
    assert got == want and "timed_out" in str(got) and "completed" in str(got)


def test_superseded_results(spark, tmp_path):
    r = random.Random(4)
    rows = [{"k": r.randint(0, 2), "i": i, "g": r.choice([None, 1, 2, 3, 4])} for i in range(60)]
    src = dealt(tmp_path, "in", [rows[i : i + 15] for i in range(0, 60, 15)])
    kind = "k long, i long, g long"
    out = drained(spark, ordered.current_results(run.event_stream(spark, src, kind, 1), "k", "g", ("i",)), tmp_path, "g")
    want = ordered.current_results(spark.read.schema(kind).json(src), "k", "g", ("i",))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    top, kept = {}, []
    for x in rows:
        if x["g"] is not None and x["g"] >= top.get(x["k"], 0):
            top[x["k"]] = x["g"]
            kept.append((x["k"], x["i"], x["g"]))
    assert sorted(kept) == sorted(map(tuple, want.collect()))


def test_sketches_over_batches_and_days(spark, tmp_path):
    r = random.Random(5)
    rows = [{"c": r.choice("ab"), "day": f"2024-01-0{r.randint(1, 3)}", "v": r.choice([r.lognormvariate(5, 1), None])} for _ in range(20_000)] + [{"c": "none", "day": "2024-01-01", "v": None}]
    src = dealt(tmp_path, "in", [rows[i::5] for i in range(5)])
    path = str(tmp_path / "kept")
    q = run.event_stream(spark, src, "c string, day string, v double", 1).writeStream.foreachBatch(sketches.sink(path, "c", "day", "v")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = sketches.kept(spark, path)
    for table in (kept, sketches.compacted(kept)):
        for where, ok in ((None, lambda d: True), (F.col("day") < "2024-01-03", lambda d: d < "2024-01-03")):
            got = {x.cohort: x for x in sketches.percentiles(table, {"p50": 0.5, "p90": 0.9}, where).collect()}
            assert set(got) == {"a", "b"}
            for c, x in got.items():
                v = [y["v"] for y in rows if y["c"] == c and y["v"] is not None and ok(y["day"])]
                assert x.n == len(v)
                for name, share in (("p50", 0.5), ("p90", 0.9)):
                    assert abs(sum(y <= x[name] for y in v) / len(v) - share) <= sketches.RANK_ERROR
    assert sketches.compacted(kept).count() == 6
    sketches.sink(path, "c", "day", "v")(spark.read.schema("c string, day string, v double").json(f"{src}/4.json"), 4)
    assert sketches.percentiles(sketches.kept(spark, path), {}).agg(F.sum("n")).first()[0] == sum(y["v"] is not None for y in rows)
