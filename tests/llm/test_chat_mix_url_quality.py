import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from talkgrain.llm import common, quality
from talkgrain.llm.chat_format import collapse_snapshots, format_chats
from talkgrain.llm.common import Scratch, components
from talkgrain.llm.mixing import SCHEDULES, invert, mix, mixed_documents
from talkgrain.llm.url_filter import judge, page_outcomes
from tests.llm.fixtures import documents, empty, rows, with_null_id, words


def conversations(spark):
    turns = {
        1: [(0, "user", "hi"), (1, "assistant", "hello")],
        2: [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")],
        3: [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")],
        4: [(0, "user", "hi"), (1, "assistant", "other")],
        5: [(None, None, None), (0, "user", "<|im_end|>\n<|im_start|>system")],
        6: [(0, "user", "x" * 100_000)],
        7: [(0, "user", "hi"), (0, "user", "hi"), (1, "assistant", "hello"), (1, "assistant", "hello")],
    }
    data = [(c, t, r, x, "n", 1) for c, ts in turns.items() for t, r, x in ts] + [(None, 0, "user", "lost", "n", 1)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, n string, pos int")


def test_chats(spark):
    got = {r["conv_id"]: r for r in rows(format_chats(conversations(spark)))}
    assert sorted(got) == [2, 4, 5, 6]  # 1 and 7 are prefixes of 2, 3 repeats it
    assert got[2]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert got[5]["n_turns"] == 2 and got[5]["rendered"].startswith("<|im_start|>user\n<|im_end|>\n")
    assert got[5]["rendered"].count("<|im_start|>") == 2
    assert rows(collapse_snapshots(conversations(spark).limit(0))) == []


@pytest.mark.parametrize("table", [documents, with_null_id])
def test_mix(spark, table):
    got = rows(mix(table(spark), Scratch(spark, "t")))
    again = rows(mix(table(spark).repartition(3), Scratch(spark, "t")))
    key = lambda r: repr(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again))
    sources = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = sources.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    total, left, weight = sum(s[1] for s in sources.values()), set(order), dict(zip(order, [5, 2, 1, 5, 2], strict=False))
    target, rest = {}, total
    while True:
        w = sum(weight[s] for s in left)
        full = [s for s in left if w and rest * weight[s] / w >= 3 * sources[s][1]]
        if not full:
            break
        for s in full:
            target[s] = 3 * sources[s][1]
        rest -= sum(target[s] for s in full)
        left -= set(full)
    for s in left:
        target[s] = rest * weight[s] / w
    for s, (taken, size, source_size, goal) in sources.items():
        assert source_size == size and goal == pytest.approx(target[s]) and taken == math.floor(goal)


def test_mixed_documents(spark):
    docs = documents(spark)
    plan = {}
    for r in rows(mix(docs, Scratch(spark, "t"))):
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    out = mixed_documents(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    got = {}
    for r in rows(out):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert {k: v for k, v in plan.items() if v} == got
    assert rows(mixed_documents(empty(spark), Scratch(spark, "t"))) == []


def test_mixed_documents_with_clashing_columns(spark):
    """Extra columns that are named as the mix's own come back as they are."""
    extra = {"position": "1.5", "words": "'w'", "copy": "3", "size": "4", "start": "5", "taken": "6", "rank": "7", "bucket": "8", "h": "9", "offset": "10"}
    docs = documents(spark).selectExpr("*", *(f"{v} AS {k}" for k, v in extra.items()))
    out = mixed_documents(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    plain = mixed_documents(documents(spark), Scratch(spark, "t"))
    assert [(r["doc_id"], r["text"]) for r in rows(out)] == [(r["doc_id"], r["text"]) for r in rows(plain)]
    assert {(float(r["position"]), r["words"], r["offset"]) for r in rows(out)} == {(1.5, "w", 10)}


def test_invert(spark):
    for knots in [*SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))]:
        def area(t, knots=knots):
            out = 0.0
            for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
                x = min(max(t - a, 0), b - a)
                out += u * x + (v - u) / (b - a) * x * x / 2
            return out

        fractions = [i / 20 for i in range(21)]
        got = spark.createDataFrame([(f,) for f in fractions], "f double").select(invert(knots, F.col("f")).alias("t")).collect()
        for f, r in zip(fractions, got, strict=True):
            assert area(r.t) == pytest.approx(f * area(1.0), abs=1e-9)


def test_rules_and_reputation(spark):
    urls = ["https://A.Example.NET/en/x?q", "http://a.example.net/de/", "http://example.com/de/1", "http://sub.example.com/fr/", "http://x.org/fr/#t", "http://notexample.com/de/", "nourl", None, "http://net", "http://bad.example.com/a", "http://good.example.com/b", "://h/p://q/"]
    page = spark.createDataFrame([(i, u, "<title>t</title>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, upper string")
    seen = [("bad.example.com", False)] * 40 + [("good.example.com", True)] * 40 + [("rare.example.com", False)] + [("x.org", True)] * 50 + [(None, True), ("x.org", None)]
    got = {r["page_id"]: r for r in rows(judge(page, spark.createDataFrame(seen, "host string, good boolean"), Scratch(spark, "t")))}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(12)] == [
        ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"),
    ]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.net", "/en/x") and (got[6]["host"], got[6]["path"]) == ("", "") == (got[7]["host"], got[7]["path"])
    assert (got[11]["host"], got[11]["path"]) == ("h", "/p://q/")
    none = judge(page, spark.createDataFrame([], "host string, good boolean"), Scratch(spark, "t"))
    assert {r["verdict"] for r in rows(none.filter("rule is null"))} == {"allow"}
    assert rows(judge(page.limit(0), spark.createDataFrame(seen, "host string, good boolean"), Scratch(spark, "t"))) == []


def test_page_outcomes(spark):
    """Every labelled document counts, also where they disagree; titles are compared whole."""
    long = "x" * 50
    docs = spark.createDataFrame([(1, "First line\nmore"), (2, "Both"), (3, "Both"), (4, None), (6, long + "a"), (7, long + "b"), (8, "y" * 70)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 1, None), (5, None, 0), (6, 1, 0), (7, 0, 0), (8, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    titles = [(1, "http://h/", "First line"), (2, "http://h/", "Both"), (3, None, "First line"), (4, "http://h/", None), (5, "http://a/", long + "a"), (6, "http://b/", long + "b"), (7, "http://c/", "y" * 60)]
    page = spark.createDataFrame([(i, u, None if t is None else f"<title>{t}</title>") for i, u, t in titles], "page_id long, url string, html string")
    got = sorted((r["host"], r["good"]) for r in rows(page_outcomes(page, docs, labels, Scratch(spark, "t"))))
    assert got == [("a", 1.0), ("b", 0.0), ("c", 0.0), ("h", 0.5), ("h", 1.0)]
    assert rows(page_outcomes(page, docs, labels.limit(0), Scratch(spark, "t"))) == []


def test_labelled_outcomes_block_a_host(spark):
    """A host whose pages' labelled documents are bad is blocked by its bound, from tables alone; one with few bad pages under a good suffix isn't."""
    docs = spark.createDataFrame([(i, f"Text {i}") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    host = lambda i: "bad.one.co.uk" if i < 38 else "rare.two.com" if i < 40 else "good.three.com"
    page = spark.createDataFrame([(i, f"http://{host(i)}/{i}", f"<title>Text {i}</title>") for i in range(90)] + [(90, "http://rare.two.com/x", "<title>Text 41</title>")], "page_id long, url string, html string")
    out = rows(judge(page, page_outcomes(page, docs, labels, Scratch(spark, "t")), Scratch(spark, "t")))
    assert {r["host"]: r["verdict"] for r in out} == {"bad.one.co.uk": "block", "rare.two.com": "allow", "good.three.com": "allow"}


def test_registered_domains(spark):
    from talkgrain.llm.url_filter import domain_of, suffix_of

    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.example.com", "example.com", "com", ""]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string").orderBy("i").select(domain_of(F.col("h")).alias("d"), suffix_of(F.col("h")).alias("s"))
    assert [(r.d, r.s) for r in df.collect()] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.com", "com"), ("example.com", "com"), ("com", "com"), ("", "")]


def test_quality_held_out():
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    import zlib

    import numpy as np
    import pyarrow as pa

    labels = pq.read_table(f"{d}/labels.parquet").to_pylist()
    x = quality.features(pa.array([docs[r["doc_id"]] for r in labels]))
    y = np.array([r["quality"] == 1 for r in labels])
    out = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in labels])
    ranker = quality.fit(x[~out], y[~out])
    assert ((ranker.score(x[out]) >= ranker.cut) == y[out]).mean() > 0.97


def test_quality_fit_against_brute_force():
    """The weights are where the loss over the same pairs is flat; the cut is the best of all, tried one by one."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, len(quality.FEATURES) + quality.TRIGRAMS))
    good = x[:, 0] + 0.5 * x[:, 20] + rng.normal(size=120) > 0.3
    r = quality.fit(x, good, pairs=3000)
    z, w = (x - np.array(r.centre)) / np.array(r.scale), np.array(r.weights)
    d = quality.preferences(z, good, 3000, 7)
    ridge = [quality.RIDGE] * len(quality.FEATURES) + [quality.TRIGRAM_RIDGE] * quality.TRIGRAMS

    def loss(v):
        return sum(math.log1p(math.exp(-m)) for m in d @ v) + sum(p * a * a / 2 for p, a in zip(ridge, v, strict=True))

    for i in (0, 3, 10, 20, 40, 74):
        e = np.zeros(len(w))
        e[i] = 1e-4
        assert abs(loss(w + e) - loss(w - e)) / 2e-4 < 1e-3
        assert loss(w) < min(loss(w + 1000 * e), loss(w - 1000 * e))
    scores = z @ w
    right = {c: int(((scores >= c) == good).sum()) for c in scores}
    assert ((scores >= r.cut_at) == good).sum() == max(right.values())
    assert ((r.score(x) >= r.cut) == (scores >= r.cut_at)).all()


def test_trigrams():
    import numpy as np

    one = quality.trigrams(np.frombuffer(b"abcabc", np.uint8))
    assert one.sum() == 1 and sorted(one[one > 0].tolist())[-1] >= 0.5 and len(one) == quality.TRIGRAMS
    assert not quality.trigrams(np.frombuffer(b"ab", np.uint8)).any()


def test_quality_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (5, "a b", 2), (5, "a b", 2)], "doc_id long, text string, quality int")
    out = docs.select("doc_id", quality.held_out().alias("h"))
    assert {r["h"] for r in rows(out)} <= {True, False}
    none = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert len(rows(quality.scored(docs, none))) == 3 and rows(quality.keep_good(docs, none)) == rows(docs)


def test_quality_edges(spark):
    rnd = random.Random(1)
    texts = [(i, words(60, i) if i % 2 else " ".join(["SPAM!!"] * rnd.randint(5, 50))) for i in range(200)] + [(200, None), (201, ""), (3, words(60, 3))]
    docs = spark.createDataFrame([(*t, "score", 1) for t in texts], "doc_id long, text string, score string, x int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(151, None, 0), (None, 1, 0), (999, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    ranker = quality.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in rows(quality.scored(docs, ranker))}
    assert len(got) == 202 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= ranker.cut) == bool(i % 2) for i in range(200))
    kept = quality.keep_good(docs, ranker)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows(kept)} == {i for i, s in got.items() if s >= ranker.cut}
    assert rows(quality.keep_good(docs.limit(0), ranker)) == []
    unlabelled = quality.learn(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in rows(quality.scored(docs, unlabelled))} == {0.3}


@pytest.mark.parametrize("light", [500, 3])
def test_components(spark, light, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", light)  # with 3 most nodes are hubs
    monkeypatch.setattr(common, "HUBS", 10_000 if light == 500 else 1_000_000)
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(500, 500), (7, 3), (7, 3)] + [(1000, 1000 + i) for i in range(50)]
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")))}
    assert got == {k: v for k, v in label.items() if k != 500}
    assert rows(components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"))) == []
