import math
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from talkgrain.llm.common import Scratch
from talkgrain.llm.importance import counted, ranked, resample, run_lengths, streams
from tests.llm.fixtures import documents, empty, rows, with_null_id, words

TARGET = ["and more words to look like", None, "", words(60, 1) + " the end", "Zürich 日本 zürich"]


def features(text, runs):
    w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return w, [b" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, runs, buckets, least, percent):
    mine = [(d["doc_id"], *features(d["text"], runs)) for d in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, f in mine:
        for x in f:
            s[crc32(x) % buckets] += 1
    for x in (x for text in target for x in features(text, runs)[1]):
        t[crc32(x) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, w, f in mine:
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc32(x) % buckets] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("runs, buckets, least, percent", [(1, 10_000, 20, 10), (1, 50, 1, 60), (3, 10_000, 3, 100), (2, 65_536, 0, 35)])
def test_against_brute_force(spark, runs, buckets, least, percent):
    docs = with_null_id(spark).unionByName(documents(spark))  # repeated rows and ids
    target = spark.createDataFrame([(t, 1, "x") for t in TARGET], "text string, keys int, doc_id string")
    got = resample(docs, target, Scratch(spark, "t"), runs, buckets, least, percent)
    want = brute(rows(docs), TARGET, runs, buckets, least, percent)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_tables(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample(empty(spark), target, Scratch(spark, "t")).collect() == []
    got = rows(resample(documents(spark), target.filter("false"), Scratch(spark, "t")))
    assert sorted((r["doc_id"], r["weight"]) for r in got) == sorted((i, w) for i, _, w, *_ in brute(rows(documents(spark)), [], 1, 10_000, 20, 10))


def test_run_lengths():
    r = np.random.default_rng(1).integers(0, 9, 1000).astype("<u2")
    value, n = run_lengths(r)
    assert dict(zip(value.tolist(), n.tolist(), strict=True)) == {v: int((r == v).sum()) for v in set(r.tolist())}
    assert [len(x) for x in run_lengths(r[:0])] == [0, 0]


def test_blocks_hold_one_long_text_and_many_short_ones(spark):
    texts = ["w " * 2_000_000, "", None, "a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = rows(streams(docs, "doc_id"))
    assert sorted((k, e) for r in got for k, e in zip(r["keys"], np.diff([0, *r["ends"]]).tolist(), strict=True)) == [(0, 2_000_000), (1, 0), (2, 0), (3, 2)]
    assert sum(len(r["stream"]) for r in got) == 2 * 2_000_002
    assert {r.bucket: r.n for r in counted(streams(docs, "doc_id")).collect()}[crc32(b"w") % 10_000] == 2_000_000


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS v")
    got = ranked(df.repartition(9), [df.v.desc(), df.id.asc()], Scratch(spark, "t")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
