"""Queries against their SQL on rows that the small tables lack."""

from __future__ import annotations

from pathlib import Path

import duckdb

from talkgrain import catalog
from tests.oracle import D, TABLES, assert_same


def _tables(folder: Path, **own: str) -> str:
    """The small tables, but those named, which are made by SQL."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if t in own:
            con.sql(f"COPY ({own[t].format(D=D)}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{D}/{t}.parquet")
    return str(folder)


def test_words_that_are_operators(spark, tmp_path):
    """An item that starts or ends with the word `or` asks for that word."""
    d = _tables(
        tmp_path,
        benchmark="SELECT * FROM (VALUES (1, 'or two three'), (2, 'one or two'), (3, 'one two or'), (4, 'or zebra')) t(item_id, text)",
        documents="SELECT i AS doc_id, CASE i WHEN 0 THEN 'one or two' WHEN 1 THEN 'or two' WHEN 2 THEN 'one two three' WHEN 3 THEN 'two or one or three' WHEN 4 THEN 'zebra x or' ELSE 'zebra' END AS text, 'en' AS lang, 's' AS source, 1 AS n_chars FROM range(6) t(i)",
    )
    for name in ("either_without_topk", "cover_density_topk"):
        assert_same(spark, catalog.QUERIES[name], catalog.ORACLE[name], d)


def test_recovered_turns_round_seconds(spark, tmp_path):
    """The last half second of a day counts for the next day, as the SQL's cast rounds it."""
    rows = "(0, '2024-01-01 23:59:59.4'), (2, '2024-01-01 23:59:59.6'), (4, '2024-01-02 23:59:59.5'), (6, '2024-01-03 12:00:00.5')"
    d = _tables(tmp_path, events=f"SELECT CAST(k AS BIGINT) AS event_id, CAST(t AS TIMESTAMP) AS ts, CAST(1 AS BIGINT) AS user_id, 'error' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM (VALUES {rows}) v(k, t)")
    assert_same(spark, catalog.QUERIES["recovered_turns"], catalog.ORACLE["recovered_turns"], d)


def test_tool_without_a_result(spark, tmp_path):
    """The last event is a call that no event follows: it is pending, its duration 0."""
    d = _tables(tmp_path, events="SELECT * FROM '{D}/events.parquet' WHERE event_id <= (SELECT max(event_id) FROM '{D}/events.parquet' WHERE event_type = 'click')")
    assert_same(spark, catalog.QUERIES["tool_outcomes"], catalog.ORACLE["tool_outcomes"], d)
    assert [r.duration_ms for r in catalog.QUERIES["tool_outcomes"](spark, d).filter("status = 'pending'").collect()] == [0]


def test_means_that_end_in_a_five(spark, tmp_path):
    """Sums in the order of events, as the SQL adds on one thread, whatever the order of rows and however many files and tasks read them."""
    made = "SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i % 400 AS user_id, CASE WHEN hash(i, 5) % 2 = 0 THEN 'purchase' ELSE 'view' END AS event_type, CAST(hash(i) % 20000 AS DOUBLE) / 100 AS value, '' AS props FROM range(8000) t(i) ORDER BY i"
    d = _tables(tmp_path, events=made)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    want = {r[0]: r[1:] for r in con.sql(catalog.ORACLE["fallback_latency"]).fetchall()}
    spark.read.parquet(f"{d}/events.parquet").repartition(7, "value").write.parquet(f"{d}/dealt/events.parquet")
    got = {r.user_id: (r.client_n, r.avg_ms, r.p50_ms) for r in catalog.QUERIES["fallback_latency"](spark, f"{d}/dealt").collect()}
    assert got == want


def test_near_duplicates_broadcast_nothing(spark):
    """Tenfold rows of the hashes, that look small in their file, are merged, not sent to the driver."""
    from talkgrain.operators.corpus import near_duplicates

    u = spark.range(40).selectExpr("id AS unit_id", "'t' AS unit_type", "repeat(concat('w', id % 30, ' x y z '), 8) AS answer")
    plan = near_duplicates(u)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_tickets_by_classes(spark):
    """Classes of equal terms give the rows that all pairs give, ties and repeated descriptions included; as many pairs as classes have are scored."""
    from pyspark.sql import functions as F

    from talkgrain.operators import retrieval

    words = ["ab", "cd", "ef", "gh"]
    entries = [(i, words[i % 2], words[i % 3], f"{words[i % 4]} {words[(i // 4) % 4]}") for i in range(96)]
    texts = [(1, "ab cd"), (2, "cd ab"), (3, "ef"), (3, "gh ab"), (4, ""), (5, None), (6, "zz"), (7, "ab cd")]
    e = spark.createDataFrame(entries, "k long, c string, s string, r string")
    d = spark.createDataFrame(texts, "q_id int, t string")
    out = retrieval.tickets(d, e, "q_id", F.col("t"), "k", F.col("c"), F.col("s"), F.col("r"))
    want = []
    for q_id in {q for q, _ in texts}:
        rows = []
        for t in [set((t or "").split()) for q, t in texts if q == q_id]:
            for k, c, s, r in entries:
                w = (len(t & {c}) + 1.5 * len(t & {s}) + 2.0 * len(t & set(r.split()))) / max(1, len(t) + len({s} | set(r.split())))
                rows += [(-round(w, 6), k)] if w > 0 else []
        want += [(q_id, k, -w, i + 1) for i, (w, k) in enumerate(sorted(rows)[:5])]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [q#" in plan  # each set of terms is asked for once


def test_nearest_in_tiles(spark, monkeypatch):
    """Many tiles, copies, opposite vectors (all 0), two lengths, zero and null vectors: as all pairs give, scored without a join of single pairs."""
    import numpy as np
    from pyspark.sql import functions as F

    from talkgrain.functions import scoring as sc
    from talkgrain.operators import memory, nearest, retrieval

    monkeypatch.setattr(nearest, "PROBES", 7)
    monkeypatch.setattr(nearest, "VECTORS", 11)
    rng = np.random.default_rng(5)
    base = [[float(x) for x in np.float32(rng.normal(size=4))] for _ in range(40)]
    vectors = [(i, base[i % 40]) for i in range(120)] + [(i, [-x for x in base[0]]) for i in range(120, 140)] + [(140, [1.0, 2.0]), (141, [2.0, 1.0]), (142, [0.0] * 4), (143, None)]
    v = spark.createDataFrame(vectors, "id long, embedding array<float>")
    p = v.filter("id % 5 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("probe"))
    pairs = p.join(v, F.size("probe") == F.size("embedding")).filter("id <> 142 and q <> 142 and probe is not null")
    want = {}
    for r in pairs.select("q", "id", sc.clamp(sc.cosine(F.col("embedding"), F.col("probe"))).alias("s")).collect():
        want.setdefault(r.q, []).append((-round(r.s, 9), r.id, r.s))
    want = {(q, x[1], x[2], n + 1) for q, rows in want.items() for n, x in enumerate(sorted(rows)[:6])}
    out = retrieval.dense(p, v, "q", "id", 6)
    assert {tuple(r) for r in out.collect()} == want
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    probes = p.filter("size(probe) = 4 and q <> 142").select(F.col("q").alias("probe_conv"), (F.col("q") % 3).alias("probe_user"), "probe")
    chunks = v.filter("size(embedding) = 4 and id <> 142").select(F.col("id").alias("conv_id"), F.lit(0).alias("chunk"), (F.col("id") % 3).alias("user"), "embedding")
    want = {}
    near = chunks.join(probes, (F.col("user") == F.col("probe_user")) & (F.col("conv_id") != F.col("probe_conv")))
    for r in near.select("probe_conv", "conv_id", sc.cosine(F.col("embedding"), F.col("probe")).alias("s")).collect():
        want.setdefault(r.probe_conv, []).append((-r.s, r.conv_id))
    want = {(q, k, -s) for q, rows in want.items() for s, k in sorted(rows)[:5] if -s >= 0.3}
    assert {(r.probe_conv, r.conv_id, r.similarity) for r in memory.recall(probes, chunks, least=0.3).collect()} == want


def test_pages_are_python_objects_a_few_at_a_time(spark):
    """Pages and documents of one Arrow batch are parsed and packed in slices."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from talkgrain.operators import chunking
    from talkgrain.sources import html

    batch = pa.RecordBatch.from_pydict({"i": list(range(html.SLICE * 2 + 5))})
    assert [len(s) for s in html.slices([batch, batch.slice(0, 0)])] == [html.SLICE, html.SLICE, 5]
    pages = spark.range(0, 300, 1, 1).select(F.col("id").alias("page_id"), F.lit("https://a.b/c").alias("url"), F.concat(F.lit("<main><h1>T</h1><p>"), F.repeat(F.concat(F.lit("w"), "id", F.lit(" ")), 30), F.lit("</p></main>")).alias("html"))
    out = chunking.chunked(html.page_documents(pages))
    assert sorted(r.page_id for r in out.collect()) == list(range(300))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_greedy_clusters_broadcast_nothing(spark, monkeypatch):
    """Neither in a round nor at the end."""
    from talkgrain.operators import corpus

    plans = []
    seen = lambda df: str(df._jdf.queryExecution().sparkPlan().toString())
    settled = corpus.settled
    monkeypatch.setattr(corpus, "settled", lambda df: plans.append(seen(df)) or settled(df))
    out = corpus.greedy_clusters(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "left_id long, right_id long"))
    assert {tuple(r) for r in out.collect()} == {(2, 1), (5, 1), (4, 3)}
    assert plans and not any("Broadcast" in p for p in [*plans, seen(out)])


def test_late_writes_join_once(spark, tmp_path):
    """One join for accepted and rejected writes; orders that repeat or lack a status as in the SQL."""
    d = _tables(
        tmp_path,
        orders="SELECT * FROM '{D}/orders.parquet' UNION ALL SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN 'O' END AS o_orderstatus) FROM '{D}/orders.parquet' WHERE o_orderkey % 5 = 1",
        lineitem="SELECT * FROM '{D}/lineitem.parquet' UNION ALL SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN NULL ELSE -7 END AS l_orderkey) FROM '{D}/lineitem.parquet' WHERE l_linenumber < 3",
    )
    assert_same(spark, catalog.QUERIES["late_writes"], catalog.ORACLE["late_writes"], d)
    plan = catalog.QUERIES["late_writes"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_memories_without_a_source_are_not_dealt_by_their_null(spark, tmp_path):
    """Orders that repeat, or whose customer is missing; the memories meet one shuffled join, with their transcripts' keys only."""
    d = _tables(
        tmp_path,
        orders="SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 1 THEN NULL WHEN o_orderkey % 9 = 2 THEN -1 ELSE o_custkey END AS o_custkey) FROM '{D}/orders.parquet' UNION ALL SELECT * FROM '{D}/orders.parquet' WHERE o_orderkey % 5 = 1",
        lineitem="SELECT * REPLACE (CASE WHEN l_orderkey % 11 = 3 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey) FROM '{D}/lineitem.parquet'",
    )
    assert_same(spark, catalog.QUERIES["memory_sources"], catalog.ORACLE["memory_sources"], d)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = catalog.QUERIES["memory_sources"](spark, D)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 4
    dealt = memory_partitions(spark)
    assert max(dealt) < 2 * sum(dealt) / len(dealt)


def memory_partitions(spark):
    """Rows by partition of the join, of memories most of which name no transcript."""
    from pyspark.sql import functions as F

    from talkgrain.operators import memory

    m = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("transcript_id"), "id")
    t = spark.range(4000).select(F.col("id").alias("transcript_id"), F.col("id").alias("t"), F.col("id").alias("call_id"))
    c = spark.range(4000).select(F.col("id").alias("call_id"), F.lit(False).alias("deleted"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = memory.with_live_source(m, t, c, F.lit(True))
        assert out.count() == 4000
        return [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_percentiles_of_large_groups(spark, tmp_path):
    """A group's values are in many ranges, none of them whole in one task; groups without a value, without a name, of one value."""
    from pyspark.sql import functions as F

    from talkgrain.operators import latency

    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 4001 / 8).alias("a"), F.when(F.col("id") % 50 > 0, F.col("id") % 9).alias("b"))
    rows = rows.union(spark.createDataFrame([(7, None, 3), (7, None, None), (8, 1.5, None)], "g long, a double, b long"))
    got = latency.percentiles(rows, "g", {"a": "x", "b": "y"}, [0, 50, 90, 99, 100])
    want = rows.groupBy("g").agg(*[latency.percentile(F.col(c), s / 100).alias(f"{n}_p{s}") for c, n in (("a", "x"), ("b", "y")) for s in (0, 50, 90, 99, 100)])
    key = lambda df: sorted((tuple(r) for r in df.select(want.columns).collect()), key=str)
    assert key(got) == key(want)
    d = _tables(tmp_path, lineitem="SELECT * REPLACE (CASE WHEN l_orderkey % 4 > 0 THEN l_discount END AS l_discount, CASE WHEN l_orderkey % 5 > 0 THEN l_returnflag END AS l_returnflag) FROM '{D}/lineitem.parquet'")
    assert_same(spark, catalog.QUERIES["component_percentiles"], catalog.ORACLE["component_percentiles"], d)
    plan = catalog.QUERIES["component_percentiles"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan  # which has a map of all of a group's values in one task
