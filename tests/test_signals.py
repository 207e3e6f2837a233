import pytest
from pyspark.sql import functions as F

from talkgrain.operators import knowledge, retrieval, signals


def test_recognizer_events(spark):
    rows = [(1, "Error", None, None), (2, "LineCompleted", " a ", True), (3, "LineTextChanged", "b", None), (4, "LineTextChanged", "b", True), (5, "LineCompleted", "  ", True), (6, "LineStarted", "x", False), (7, None, "x", None)]
    got = signals.recognizer_events(spark.createDataFrame(rows, "i int, name string, text string, complete boolean")).orderBy("i").collect()
    assert [(r.i, r.kind, r.text) for r in got] == [(1, "error", ""), (2, "final", "a"), (3, "interim", "b")]


def test_ends_of_turns(spark):
    log = [(1, 1, "analysis", "incomplete", 0.2), (1, 2, "silence", None, None), (1, 3, "silence", None, None), (1, 4, "analysis", "incomplete", 0.3), (1, 5, "analysis", "complete", 0.9), (1, 6, "analysis", None, None), (2, 1, "silence", None, None), (3, 1, "analysis", "complete", 1.0)]
    got = signals.ends_of_turns(spark.createDataFrame(log, "k int, o int, kind string, state string, probability double"), "k", "o").orderBy("k", "o").collect()
    forced, model = "forced_silence_timeout", "model_prediction"
    assert [tuple(r) for r in got] == [(1, 1, False, model, 0.2), (1, 4, True, forced, 0.3), (1, 5, True, model, 0.9), (1, 6, False, model, None), (3, 1, True, model, 1.0)]


def test_usage(spark):
    said = ['{"usage": {"prompt_tokens": 5, "total_tokens": null, "completion_tokens_details": {"reasoning_tokens": 2}, "queue_time": 0.5}}', "{}", "no json", None, '{"usage": null}']
    df = spark.createDataFrame([(s,) for s in said], "p string")
    assert [r[0] for r in df.select(signals.usage_figures(F.col("p"))).collect()] == [{"prompt_tokens": 5.0, "reasoning_tokens": 2.0, "queue_time": 0.5}, {}, {}, {}, {}]
    f = spark.createDataFrame([(1, 1, "llm", 5, 6), (1, 2, "tts", 9, None), (1, 3, "llm", 7, None), (2, 4, "x", 1, 1)], "t int, o int, kind string, first int, second int")
    assert {r.t: tuple(r)[1:] for r in signals.usage_of_turns(f, ["t"], "o").collect()} == {1: (7, 6, 9), 2: (None, None, None)}


def test_last_recovered(spark):
    rows = [(1, 1, "event", "recovered", "a", 1), (1, 1, "event", "recovered", "b", 2), (1, 1, "event", "raised", "c", 3), (1, 1, "transcript", "recovered", "d", 4), (1, None, "event", "recovered", "e", 5)]
    got = signals.last_recovered(spark.createDataFrame(rows, "c int, t int, item string, kind string, event string, o int"), "c", "t", "o")
    assert [tuple(r) for r in got.collect()] == [(1, 1, "b")]


def test_session_starts(spark):
    sessions = spark.createDataFrame([(1, "x" * 50), (2, None), (None, "web")], "user int, transport string")
    held = spark.createDataFrame([(1, "p", "b", "2"), (1, "p", "a", "1"), (3, "p", "a", "1")], "user int, type string, key string, value string")
    got = {r.user: r for r in signals.session_starts(sessions, held, "user", 8).collect()}
    assert set(got) == {1, 2}
    assert (got[1].transport, got[1].facts, got[2].transport, got[2].facts) == ("x" * 32, "p.a: 1\np", "webrtc", "")


@pytest.mark.parametrize("data", [b"plain", "é日😀".encode(), b"\xff", b"a\xc3", b"\xe6\x97x", b"\xf0\x9f\x98", b"\xc0\xaf", b"", b"\xed\xa0\x80"])
def test_decoded(spark, data):
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(signals.decoded(F.col("b"))).first()[0] == data.decode("utf-8", "replace")


def test_narrow_release(spark):
    rows = [(1, "draft", "https://A.b/x/y"), (2, "approved", "https://a.b/x"), (3, "draft", "https://a.b/xy"), (4, "draft", "https://c.a.b/x/y"), (5, "retired", "https://a.b/x/z"), (6, "draft", None), (7, "draft", "https://a.b/x?q")]
    units = spark.createDataFrame(rows, "unit_id int, status string, source_uri string")
    none = spark.createDataFrame([(1,)], "version int")
    done, release = knowledge.narrow_release(units, none, 2, "a.b", "/x/")
    assert {r.unit_id: r.status for r in done.collect()} == {1: "approved", 2: "approved", 3: "draft", 4: "draft", 5: "retired", 6: "draft", 7: "approved"}
    assert sorted(map(tuple, release.collect())) == [(2, 1), (2, 2), (2, 7)]
    again, nothing = knowledge.narrow_release(units, none, 1, "a.b", "/x/")
    assert again.collect() == units.collect() and nothing.collect() == []


def test_report(spark):
    cases = [("ok", "ok", True, 1, "hybrid", 10.0), ("ok", "no_answer", True, None, "none", 20.0), ("ok", "ok", True, 4, "lexical", 30.0), ("no_answer", "no_answer", False, None, "none", 40.0), ("no_answer", "ok", False, 2, "hybrid", 50.0)]
    kind = "expected_status string, status string, expects boolean, rank int, mode string, latency_ms double"
    r = retrieval.report(spark.createDataFrame(cases, kind)).first()
    assert (r.cases, r.status_accuracy, r.recall, r.mrr, r.no_answer_accuracy) == (5, 0.6, pytest.approx(2 / 3), pytest.approx(1.25 / 3), 0.5)
    assert (r.p50_ms, r.p95_ms, r.max_ms, r.failures, r.modes) == (30.0, 50.0, 50.0, 2, "hybrid=2,lexical=1,none=2")
    e = retrieval.report(spark.createDataFrame([], kind)).first()
    assert (e.cases, e.status_accuracy, e.recall, e.p95_ms) == (0, None, None, None)
    one = retrieval.report(spark.createDataFrame([("ok", "ok", False, None, "x", 1.0)], kind)).first()
    assert (one.recall, one.mrr, one.no_answer_accuracy) == (None, None, None)
