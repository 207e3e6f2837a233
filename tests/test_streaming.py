import json
import os

import pytest
from pyspark.sql import functions as F

from talkgrain.streaming import machines as m
from talkgrain.streaming import run

SCHEMA = "key long, id long, at long, kind string, text string"


def events(spark, kinds, keys=3):
    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/events.parquet").filter(F.col("user_id") < keys)
    ms = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), ms.alias("at"), kind.alias("kind"), F.concat(F.col("event_type"), F.lit(". <| go on then ")).alias("text"))


KINDS = ["user_started", "user_stopped", "final", "llm", "audio", "text", "interrupted", "finished"]


@pytest.mark.parametrize("machine", [m.TURNS, m.rate_limit(2, 86_400), m.message_chunks(4), m.terminal(("finished",)), m.segments(10, 30), m.breaker(2, 86_400), m.drafts(("name", "mail"))])
def test_stream_equals_batch(spark, tmp_path, machine):
    kinds = {"message_chunks": ["user", "assistant"], "segments": ["delta", "delta", "end"], "breaker": ["ok", "failed", "failed"], "drafts": ["start", "name", "confirm", "mail", "confirm", "cancel"]}.get(machine.name, KINDS)
    e = events(spark, kinds)
    rows = sorted(e.collect(), key=lambda r: (r.at, r.id))
    assert rows
    for i in range(4):  # four micro-batches in the order of time
        part = rows[len(rows) * i // 4 : len(rows) * (i + 1) // 4]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps(r.asDict()) + "\n" for r in part))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i,) * 2)  # the source reads files in this order
    s = run.stream(run.event_stream(spark, str(tmp_path / "in"), SCHEMA, 1), machine)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).select(*s.columns).collect()))
    assert got == sorted(map(repr, run.batch(e, machine).collect())) and got


def steps(machine, events_):
    state, out = machine.start(), []
    for i, e in enumerate(events_):
        kind, at, text = (*e, "")[:3] if isinstance(e, tuple) else (e, i, "")
        state, rows = machine.step(state, {"kind": kind, "at": at, "id": i, "text": text})
        out += rows
    return out


def test_turns():
    got = steps(m.TURNS, [("user_started", 0), ("user_started", 5), ("user_stopped", 100), ("final", 150), ("llm", 300), ("llm", 350), ("audio", 500), ("user_started", 600), ("interrupted", 610), ("user_stopped", 700), ("final", 710), ("finished", 900), ("text", 1000), ("audio", 1200)])
    assert [(r["turn"], r["stage"], r["mode"], r["ms"]) for r in got] == [
        (1, "user_started", "voice", 0.0), (1, "user_stopped", "voice", 0.0), (1, "final", "voice", 50.0), (1, "llm", "voice", 200.0), (1, "audio", "voice", 400.0),
        (2, "user_started", "voice", 0.0), (2, "user_stopped", "voice", 0.0), (2, "final", "voice", 10.0), (2, "finished", "voice", 200.0),
        (3, "final", "text", 0.0), (3, "audio", "text", 200.0),
    ]


def test_rate_limit():
    got = steps(m.rate_limit(2, 1), [("a", 0), ("a", 500), ("a", 900), ("a", 1000), ("a", 1400), ("a", 1500)])
    assert [r["accepted"] for r in got] == [True, True, False, True, False, True]


def test_segments():
    got = steps(m.segments(5, 12), [("d", 0, "Hello there. How"), ("d", 1, " are you? Fine, [secret["), ("d", 2, "[x]] gone. "), ("end", 3, "")])
    assert [r["text"] for r in got] == ["Hello there.", "How are you? Fine, [secret"] or "".join(r["text"] for r in got).count("gone") == 0
    assert steps(m.segments(5, 12), [("d", 0, "a" * 40), ("end", 1, "")])[0]["text"] == "a" * 10


def test_breaker():
    assert [r["circuit"] for r in steps(m.breaker(2, 1), [("failed", 0), ("failed", 1), ("failed", 500), ("failed", 1600), ("ok", 1700)])] == ["closed", "open", "open", "open", "closed"]


def test_windows(spark, tmp_path):
    rows = [{"k": 1, "id": i, "ts": t} for i, t in enumerate(["2024-01-01T00:00:00", "2024-01-01T00:00:10", "2024-01-01T00:05:00", "2024-01-01T00:00:10"])] + [{"k": 1, "id": 0, "ts": "2024-01-01T00:00:00"}, {"k": 2, "id": 9, "ts": "2024-01-01T01:00:00"}]
    for i, r in enumerate(rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(r))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i,) * 2)
    e = run.event_stream(spark, str(tmp_path / "in"), "k long, id long, ts timestamp", 2)

    def collect(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    assert sorted((r.k, r.id) for r in collect(run.deduplicated(e, ["k", "id"], "ts", "2 hours"), "d")) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 9)]
    ended = collect(run.abandoned(e, "k", "ts"), "a")
    assert {(r.k, r.last.minute) for r in ended} == {(1, 0), (1, 5)}
    last = {r.k: r.n for r in collect(run.cohort_counts(e, "k", "id"), "c", "complete")}
    assert last == {1: 5, 2: 1}
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, g int, v string")
    assert sorted(r.v for r in run.latest_generation(df, ["k"], "g").collect()) == ["b", "c"]
    run.fan_out(df, 0, [str(tmp_path / "x"), str(tmp_path / "y")])
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3


def test_drafts():
    machine = m.drafts(("name", "mail"))
    state, got = machine.start(), []
    said = [("name", "x"), ("start", ""), ("name", " Kim "), ("confirm", ""), ("mail", "a@b.c"), ("name", ""), ("confirm", ""), ("name", "Lee"), ("confirm", ""), ("name", "late"), ("start", ""), ("cancel", "")]
    for i, (kind, text) in enumerate(said):
        state, rows = machine.step(state, {"id": i, "at": i, "kind": kind, "text": text})
        got += [(r["draft"], r["status"], r["missing"], r["written"]) for r in rows]
    assert got == [
        (0, "idle", "", False), (1, "collecting", "name,mail", False), (1, "collecting", "mail", False), (1, "collecting", "mail", False), (1, "review", "", False), (1, "collecting", "name", False),
        (1, "collecting", "name", False), (1, "review", "", False), (1, "written", "", True), (1, "written", "", False), (2, "collecting", "name,mail", False), (2, "cancelled", "", False),
    ]
