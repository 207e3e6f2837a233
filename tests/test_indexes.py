import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.operators import matches, retrieval, text_index as ti, vector_index as vi
from talkgrain.session import shared_dir

TERM = re.compile(r"[\w-]+")


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{random.Random().getrandbits(60):x}"


def parse(q):
    """[(alternative, [(terms, excluded)])]"""
    out, alt = {0: []}, 0
    for t in re.findall(r'-?"[^"]*"|[^\s"]+', q.lower()):
        if t == "or":
            alt += 1
            out[alt] = []
        elif terms := TERM.findall(t.removeprefix("-")):
            out[alt].append((terms, t.startswith("-")))
    return {a: items for a, items in out.items() if any(not x for _, x in items)}


def plain_rank(text, q):
    """Covers by trying every stretch of the text."""
    w = [t.lower() for t in TERM.findall(text or "")]
    at = lambda terms: [(i, i + len(terms) - 1) for i in range(len(w) - len(terms) + 1) if w[i : i + len(terms)] == terms]
    alts = [[(at(t), x) for t, x in items] for items in parse(q).values()]
    alts = [[p for p, x in a if not x] for a in alts if not any(p for p, x in a if x)]
    alts = [a for a in alts if all(a)]
    fits = lambda lo, hi: any(all(any(lo <= b and e <= hi for b, e in p) for p in a) for a in alts)
    asked = {k for a in alts for p in a for b, e in p for k in range(b, e + 1)}
    covers = [(lo, hi) for lo in range(len(w)) for hi in range(lo, len(w)) if fits(lo, hi) and not (lo < hi and (fits(lo + 1, hi) or fits(lo, hi - 1)))]
    return sum(0.1 / (1 + hi - lo + 1 - len(asked & set(range(lo, hi + 1)))) for lo, hi in covers), len(covers)


QUERIES = ["a", "a b", "b a c", '"a b"', '"a b" c', "a or b", "a b or c", "a -c", 'a -"b c"', "a -b or c -a", '"a b" or "b c" d', "a a", '"a a"', "-a", "", '"', "or", "a or", '"a b c" a', "A B", "x-y a", "nothing"]


def test_cover_density_against_every_stretch(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("aabbcd") for _ in range(r.randint(0, 14))) for _ in range(60)] + [None, "", "A, b! C x-y a", "a " * 300]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "id long, text string, unit int, term string")
    index = ti.TextIndex(spark, folder(spark, "cover"))
    index.write(docs, 0, "id", F.col("text"))
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "qid int, q string")
    got = {(r.qid, r.unit): (round(r["rank"], 9), r.covers) for r in ti.search(index, queries, "qid", F.col("q"), 1000).collect()}
    short = [(i, t) for i, t in enumerate(texts) if len(t or "") < 100]
    want = {(k, i): (round(rank, 9), n) for k, q in enumerate(QUERIES) for i, t in short for rank, n in [plain_rank(t, q)] if n}
    assert {k: v for k, v in got.items() if k[1] != len(texts) - 1} == want
    assert got[0, len(texts) - 1] == (30.0, 300)


def test_places_are_found_only_in_matching_folders(spark):
    index = ti.TextIndex(spark, folder(spark, "pruned"))
    index.write(spark.createDataFrame([(i, f"word{i} common") for i in range(200)], "id long, text string"), 0, "id", F.col("text"))
    p = index.postings(spark.createDataFrame([("word7",)], "term string"))
    assert [(r.unit, r.term, r.positions) for r in p.collect()] == [(7, "word7", [0])]
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters")[1][:80]


def state(index):
    return sorted((r.unit, r.term, r.positions) for r in index.postings().collect())


def anew(spark, rows):
    index = ti.TextIndex(spark, folder(spark, "anew"))
    index.write(spark.createDataFrame([(i, t) for i, t in rows.items()] or [], "id long, text string"), 0, "id", F.col("text"))
    return state(index)


def test_deltas_from_a_stream_equal_an_index_built_anew(spark, tmp_path):
    r = random.Random(8)
    rows = {i: " ".join(r.choice("abcdef") for _ in range(r.randint(0, 9))) for i in range(40)}
    index = ti.TextIndex(spark, folder(spark, "deltas"))
    index.write(spark.createDataFrame(list(rows.items()), "id long, text string"), 0, "id", F.col("text"))
    (tmp_path / "in").mkdir()
    for b in range(4):
        changes = {i: (f"new{b} " + r.choice("xyz"), r.random() < 0.4) for i in r.sample(range(60), 15)}
        (tmp_path / "in" / f"{b}.json").write_text("".join(json.dumps({"id": i, "text": t, "gone": g}) + "\n" for i, (t, g) in changes.items()))
        os.utime(tmp_path / "in" / f"{b}.json", (1_700_000_000 + b,) * 2)
        for i, (t, g) in changes.items():
            if g:
                rows.pop(i, None)
            else:
                rows[i] = t
    src = spark.readStream.schema("id long, text string, gone boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = src.writeStream.foreachBatch(index.sink("id", F.col("text"), F.col("gone"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = anew(spark, rows)
    assert state(index) == want and index.generations() == [0, 1, 2, 3, 4]
    last = [json.loads(x) for x in (tmp_path / "in" / "3.json").read_text().splitlines()]
    index.write(spark.createDataFrame([(x["id"], x["text"], x["gone"]) for x in last], "id long, text string, gone boolean"), 4, "id", F.col("text"), F.col("gone"))
    assert state(index) == want  # a batch that is run again
    index.compact()
    assert state(index) == want and index.generations() == [4]
    index.write(spark.createDataFrame([(1, None), (None, "x")], "id long, text string"), 5, "id", F.col("text"))
    assert state(index) == [x for x in want if x[0] != 1]


def test_an_empty_index_finds_nothing(spark):
    index = ti.TextIndex(spark, folder(spark, "empty"))
    assert index.live().collect() == [] and index.postings().collect() == []
    index.write(spark.createDataFrame([], "id long, text string"), 0, "id", F.col("text"))
    assert ti.search(index, spark.createDataFrame([(1, "a")], "q int, t string"), "q", F.col("t")).collect() == []


def test_lexical_search_by_index_equals_search_by_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    index = ti.TextIndex(spark, folder(spark, "lex"))
    index.write(docs, 0, "doc_id", F.col("text"))
    args = (items, docs, "item_id", F.col("text"), "doc_id", F.col("text"))
    got, want = (sorted(map(tuple, retrieval.lexical(*args, index=i).collect())) for i in (index, None))
    assert got == want and got


def clusters(n, d=12, k=20, seed=1):
    r = np.random.default_rng(seed)
    return (r.normal(size=(k, d))[r.integers(0, k, n)] + 0.2 * r.normal(size=(n, d))).astype(np.float32)


def test_vectors_found_by_lists(spark):
    x = clusters(3000)
    x[1000:2000] = x[1000] * (1 + np.arange(1000)[:, None] % 7)  # a third of all in one direction
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(9001, None, 0), (9002, [0.0] * 12, 0), (9003, [float("nan")] * 12, 0), (9004, [1.0, 2.0], 0), (9005, [2.0, 4.0], 1)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, model int")
    probes = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 20)] + [(9004, [1.0, 2.0]), (9001, None), (9002, [0.0] * 12)], "q long, probe array<float>")
    index = vi.build(v, "id", folder(spark, "ivf"), keep=("model",))
    index = vi.load(spark, index.path)
    assert index.rows(spark).select("id").distinct().count() == 3002
    got = {(r.q, r.id): r.similarity for r in vi.search(index, probes, "q").collect()}
    want = {(r.q, r.id): r.similarity for r in retrieval.dense(probes, v.filter(vi.usable(F.col("embedding"))), "q", "id").collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got.keys() & want.keys())
    assert {(9004, 9004), (9004, 9005)} <= got.keys() and not any(q in (9001, 9002) for q, _ in got)
    read = vi.rows_read(index, probes, "q").filter("q < 9000 and (q < 1000 or q >= 2000)").agg(F.avg("rows")).first()[0]
    assert read < 1500  # half of all but for the large list
    one = vi.search(index, probes, "q", where=F.col("model") == 1)
    assert {r.id % 2 for r in one.collect() if r.id < 9000} == {1}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(model), EqualTo(model,1)" in plan and "list" in plan.split("PartitionFilters")[1][:40]
    everything = {(r.q, r.id) for r in vi.search(index, probes, "q", read=len(index.centroids)).collect()}
    assert everything == want.keys()  # all lists: the exact search


def test_empty_vector_table(spark):
    v = spark.createDataFrame([], "id long, embedding array<float>")
    index = vi.build(v, "id", folder(spark, "none"))
    assert vi.search(index, spark.createDataFrame([(1, [1.0])], "q long, probe array<float>"), "q").collect() == []


def test_covers_of_many_places_take_linear_time(spark):
    index = ti.TextIndex(spark, folder(spark, "long"))
    index.write(spark.createDataFrame([(1, "a x b " * 5000)], "id long, text string"), 0, "id", F.col("text"))
    got = ti.search(index, spark.createDataFrame([(1, "a b")], "q int, t string"), "q", F.col("t")).first()
    assert got.covers == 9999 and got["rank"] == pytest.approx(5000 * 0.05 + 4999 * 0.1)


def moved(spark, name, run):
    """Records that the stages of run() wrote for shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s))


def test_no_word_is_shuffled_to_build_an_index_and_no_place_to_search_it(spark):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 40)}" for _ in range(300))) for i in range(60)], "id long, text string").localCheckpoint()
    index = ti.TextIndex(spark, folder(spark, "moved"))
    assert moved(spark, "build", lambda: index.write(docs, 0, "id", F.col("text"))) <= 3 * 60  # before, each of over 2,000 terms of documents, twice
    queries = spark.createDataFrame([(0, "w1 w2"), (1, '"w3 w4"')], "qid int, q string")
    got = []
    assert moved(spark, "search", lambda: got.extend(ti.search(index, queries, "qid", F.col("q"), 1000).collect())) <= 4 * 60 + 120 + 40  # hits, ranks, and what parses two queries
    assert {r.unit for r in got if r.qid == 0} == set(range(60))


def test_units_that_repeat_and_long_ones_among_others(spark):
    rows = [(1, "a b"), (1, "b c"), (2, "c a " * 40), (3, ""), (4, None), (5, "b"), (5, None)]
    index = ti.TextIndex(spark, folder(spark, "twice"))
    index.write(spark.createDataFrame(rows, "id long, text string").coalesce(1), 0, "id", F.col("text"))
    assert state(index) == [(1, "a", [0]), (1, "b", [0, 1]), (1, "c", [1]), (2, "a", list(range(1, 80, 2))), (2, "c", list(range(0, 80, 2))), (5, "b", [0])]
    assert {(r.unit, r.term, r.tf) for r in index.postings(places=False).collect()} == {(u, t, len(p)) for u, t, p in state(index)}


def test_texts_are_inverted_a_few_words_at_a_time(monkeypatch):
    import pyarrow as pa

    texts = [["a", "b", "a"], [], ["b"] * 7, ["c", "a"], [], ["a"]]
    monkeypatch.setattr(ti, "WORDS", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9, 15)), pa.array([["z"], *texts[1:]])], names=["unit", "words"])
    whole = pa.RecordBatch.from_arrays([pa.array(range(9, 15)), pa.array(texts)], names=["unit", "words"])
    for b, want in ((whole, texts), (batch.slice(1), texts[1:])):
        parts = [p.to_pylist() for p in ti._inverted([b])]
        got = {(u, r["term"]): p for rows in parts for r in rows for u, p in zip(r["units"], r["positions"], strict=True)}
        units = b.column("unit").to_pylist()
        assert got == {(u, t): [i for i, x in enumerate(w) if x == t] for u, w in zip(units, want, strict=True) for t in set(w)} and len(parts) > 1
        assert all(r["tfs"] == [len(p) for p in r["positions"]] for rows in parts for r in rows)


def test_a_unit_whose_hits_are_in_two_batches(spark):
    r = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcd") for _ in range(20))) for i in range(30)], "id long, text string")
    index = ti.TextIndex(spark, folder(spark, "batches"))
    index.write(docs, 0, "id", F.col("text"))
    queries = spark.createDataFrame([(0, 'a b "c d"'), (1, "a -b or c d")], "qid int, q string")
    run = lambda: sorted(tuple(x) for x in ti.search(index, queries, "qid", F.col("q"), 100).withColumn("rank", F.round("rank", 9)).collect())
    want = run()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert run() == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_probe_goes_to_few_cells_of_lists(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(3000, 8)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>").localCheckpoint()
    index = vi.build(df, "vec_id", folder(spark, "cells"))
    probes = df.filter("vec_id % 30 = 0").select((F.col("vec_id") % 1500).alias("q"), F.col("embedding").alias("probe"))  # each q is that of two probes
    got = {}
    n = moved(spark, "cells", lambda: got.update(one=vi.search(index, probes, "q", 10).collect()))
    assert n < 3000 + 4 * 100 + 5 * 1000 + 500  # before, each probe with each of some hundred lists, and its hits there
    monkeypatch.setattr(vi, "CELL", 300)
    many = vi.search(index, probes, "q", 10).collect()
    key = lambda rows: sorted((r.q, r.dense_pos, r.vec_id, round(r.similarity, 9)) for r in rows)
    assert key(many) == key(got["one"]) and len(many) == 50 * 10
    every = vi.search(index, probes, "q", 10, read=len(index.centroids)).collect()
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1500, 30):
        best = np.maximum(u @ u[q], u @ u[q + 1500])
        assert [r.vec_id for r in sorted(every, key=lambda r: r.dense_pos) if r.q == q] == np.argsort(-np.round(best, 9), kind="stable")[:10].tolist()


def test_lexical_search_shuffles_no_pairs_of_queries_and_units(spark):
    docs = spark.createDataFrame([(i, f"common words everywhere unit{i} {'again ' * (i % 7)}") for i in range(2000)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"common again everywhere words unit{i}") for i in range(50)], "item_id long, text string")
    index = ti.TextIndex(spark, folder(spark, "pairs"))
    index.write(docs, 0, "doc_id", F.col("text"))
    got = []
    args = (items, docs, "item_id", F.col("text"), "doc_id", F.col("text"))
    rows = moved(spark, "lexical", lambda: got.extend(retrieval.lexical(*args, n=3, index=index).collect()))
    want = {(i, d) for i in range(50) for d in sorted(range(2000), key=lambda d: (-(d % 7 + (d == i)), d))[:3]}
    assert {(r.item_id, r.doc_id) for r in got} == want
    assert rows < 50 * 2000 / 10  # before, each query with each unit once a task


def test_fusing_shuffles_candidates_only(spark):
    units = spark.range(5000).select("id", *[F.concat(F.lit("text "), "id").alias(c) for c in ("body", "identity", "retrieval_text", "product", "answer")], F.lit(3).alias("authority"))
    lex = spark.createDataFrame([(1, 7, 0.1, 1), (2, 4999, 0.1, 1)], "q long, id long, rank double, lex_pos int")
    vec = spark.createDataFrame([(1, 8, 0.5, 1)], "q long, id long, similarity double, dense_pos int")
    queries = spark.createDataFrame([(1, "text 7", ["text 7"]), (2, "none", [])], "q long, query string, aliases array<string>")
    got, least = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = moved(spark, "fuse", lambda: got.extend(retrieval.fuse(lex, vec, queries, units, "q", "id").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert {(r.q, r.id, *r.matched_by) for r in got} == {(1, 7, "lexical", "alias"), (1, 8, "dense"), (2, 4999, "lexical")}
    assert rows < 1000  # before, all 5,000 texts


def test_matches_by_tiles(spark, monkeypatch):
    r = random.Random(3)
    asked = [(q, r.choice("abcdefgh")) for q in [None, *range(30)] for _ in range(r.randint(1, 6))]  # terms of a query may come twice
    docs = [(f"u{u}" if u else None, t, r.randint(1, 4)) for u in range(60) for t in r.sample("abcdefghxyz", r.randint(1, 9))]
    rows = [(hash(u) % 9, t, [u], [tf]) for u, t, tf in docs] + [(99, "a", ["v1", "v2", "v1"], [1, 5, 2]), (99, "b", [], [])]
    docs += [("v1", "a", 1), ("v2", "a", 5), ("v1", "a", 2)]
    total = {}
    for q, t in asked:
        for u, term, tf in docs:
            if t == term:
                total[q, u] = total.get((q, u), 0) + tf
    asked = spark.createDataFrame(asked, "query long, term string")
    blocks = spark.createDataFrame(rows, "block long, term string, units array<string>, tfs array<int>")
    monkeypatch.setattr(matches, "ASKED", 10)
    monkeypatch.setattr(matches, "POSTINGS", 40)
    assert {(m.query, m.unit): m.matched for m in matches.matches(asked, blocks).collect()} == total
    first = lambda rows, n: {q: sorted(((-s, u or "", u) for (p, u), s in rows.items() if p == q))[:n] for q, _ in rows}
    found = matches.matches(asked, blocks, 4).collect()
    assert first({(m.query, m.unit): m.matched for m in found}, 4) == first(total, 4)
    assert matches.matches(asked, blocks.limit(0), 4).collect() == matches.matches(asked.limit(0), blocks).collect() == []
    monkeypatch.setattr(matches, "CELLS", 100)
    whole = matches._sums(asked.toArrow(), blocks.toArrow(), 4).to_pylist()
    assert len(whole) == len({(m["query"], m["unit"]) for m in whole}) and first({(m["query"], m["unit"]): m["matched"] for m in whole}, 9) == first(total, 4)


def test_blocks_hold_all_postings_of_a_unit(spark):
    index = ti.TextIndex(spark, folder(spark, "blocks"))
    index.write(spark.createDataFrame([(i, f"a b{i % 3} b{i % 3} c") for i in range(50)] + [(7, "d")], "id long, text string").repartition(3), 0, "id", F.col("text"))
    asked = spark.createDataFrame([(t,) for t in ("a", "b0", "b1", "d", "none")], "term string")

    def held():
        rows = index.blocks(asked).select("block", "term", F.inline(F.arrays_zip("units", "tfs"))).collect()
        assert len({(r.block, r.units) for r in rows}) == len({r.units for r in rows})
        assert sorted((r.units, r.term, r.tfs) for r in rows) == sorted(map(tuple, index.postings(asked, places=False).collect()))
        return len(rows)

    assert held() == 50 + 17 + 17 + 1
    index.write(spark.createDataFrame([(1, "b0", False), (2, "", True)], "id long, text string, gone boolean"), 1, "id", F.col("text"), F.col("gone"))
    assert held() == 48 + 18 + 16 + 1
    index.compact()
    assert held() == 48 + 18 + 16 + 1
