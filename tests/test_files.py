import pytest

from talkgrain.operators import corpus, latency
from talkgrain.sources import files


def write(tmp_path, name, text, mode="w"):
    (tmp_path / name).write_bytes(text.encode()) if isinstance(text, str) else (tmp_path / name).write_bytes(text)
    return str(tmp_path / name)


def test_telemetry_lines(spark, tmp_path):
    good = '{"user_id": 1, "session_id": "s", "turn_id": "1", "category": "rag", "stt_finalization_ms": {"fallback_forced": 1}, "llm_ms": 5}\n\n[1]\n7\n'
    df = files.json_lines(spark, write(tmp_path, "a", good), files.TELEMETRY)
    (r,) = df.collect()
    assert r.llm_ms == 5.0 and r.stt_finalization_ms["fallback_forced"] == 1.0 and set(latency.METRICS) <= set(df.columns)
    with pytest.raises(Exception, match="(?i)json|malformed"):
        files.json_lines(spark, write(tmp_path, "b", good + "{broken\n"), files.TELEMETRY).collect()
    ok, bad = files.split_broken(spark, str(tmp_path / "b"), files.TELEMETRY)
    assert ok.count() == 1 and sorted(r.line for r in bad.collect()) == ["7", "[1]", "{broken"]
    valid, rejected = files.checked(df, {"llm_ms": (0, 1)}, {"category": ("rag",)})
    assert valid.count() == 0 and rejected.first().problems == ["llm_ms"]


def test_cases(spark, tmp_path):
    line = '{"id": "1", "query": "q", "expected_status": "ok", "expected_unit_keys": ["a"]}\n'
    assert files.evaluation_cases(spark, write(tmp_path, "a", "# note\n\n" + line)).first().expected_unit_keys == ["a"]
    with pytest.raises(Exception, match="invalid evaluation case"):
        files.evaluation_cases(spark, write(tmp_path, "b", line.replace('"ok"', '"maybe"'))).collect()


def test_taxonomy(spark, tmp_path):
    csv = b"\xef\xbb\xbfTicket Code,Ticket Sub Code,Ticket Remarks,Status\nA,b,x  y,Active\nA,b,x y,Active\nA,b,z,Blocked\nA,,z,Active\n"
    entries, report = corpus.taxonomy_import(files.taxonomy(spark, write(tmp_path, "t.csv", csv)), "row")
    assert [tuple(r)[:3] for r in entries.collect()] == [("A", "b", "x y")] and tuple(report.first()) == (4, 1, 2, 1)


def test_lexicon_and_append(spark, tmp_path):
    p = write(tmp_path, "l.json", '{"version": "2", "entries": [{"written": " P  OS", "spoken": "pee oh ess"}]}')
    assert tuple(files.lexicon(spark, p).first()) == ("2", "P OS", "pee oh ess", 0)
    with pytest.raises(Exception, match="lacks a side"):
        files.lexicon(spark, write(tmp_path, "m.json", '{"entries": [{"written": "x"}]}')).collect()
    for _ in range(2):
        files.append_lines(spark.range(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["id", "recorded_at", "schema_version"] and spark.read.json(str(tmp_path / "out")).count() == 2


def test_corpus(spark, tmp_path):
    import hashlib
    import json

    body = "# One\ntext é"
    good = hashlib.sha256(body.encode()).hexdigest()
    write(tmp_path, f"{good}.md", body)
    write(tmp_path, "bad.md", "other")
    write(tmp_path, "manifest.json", json.dumps({"pages": [{"hash": good, "url": "u", "title": "One"}, {"hash": "bad", "url": "v"}, {"hash": "none", "url": "w"}]}))
    got = {r.url: (r.text, r.intact) for r in files.corpus(spark, str(tmp_path)).collect()}
    assert got == {"u": (body, True), "v": ("other", False), "w": (None, False)}
