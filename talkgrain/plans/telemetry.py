"""Telemetry queries over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.operators import calls, latency
from talkgrain.plans.registry import query
from talkgrain.session import table


@query("""SELECT event_type AS category, count(value) AS n, avg(value) AS avg_ms, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.9) AS p90_ms
FROM events WHERE value >= 0 AND event_type IN ('click', 'purchase', 'view') GROUP BY event_type""")
def latency_cohorts(spark, d):
    e = table(spark, d, "events").filter((F.col("value") >= 0) & F.col("event_type").isin("click", "purchase", "view"))
    return latency.cohorts(e, "event_type", "value")


@query("""WITH e AS (SELECT event_type, CASE WHEN CAST(props->>'$.k' AS INT) >= 50 THEN 'warm' ELSE 'cold' END AS warmth, value FROM events)
SELECT event_type || ':' || coalesce(warmth, 'all') AS grp, 'value' AS metric, count(value) AS n, min(value) AS min, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90,
       quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max FROM e GROUP BY GROUPING SETS ((event_type), (event_type, warmth))""")
def latency_report_grouping_sets(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("category"), (F.get_json_object("props", "$.k").cast("int") >= 50).alias("llm_connection_warmed"), "value")
    return latency.report(e, ["value"])


@query("""SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
ORDER BY CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_wins_dedup(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("rank"))
    return latency.latest_wins(e, ["user_id", "day"], [F.col("rank"), F.col("event_id")]).drop("rank")


@query("""SELECT l_returnflag AS flag, quantile_cont(l_quantity, 0.5) AS quantity_p50, quantile_cont(l_quantity, 0.9) AS quantity_p90,
quantile_cont(l_extendedprice, 0.5) AS price_p50, quantile_cont(l_extendedprice, 0.9) AS price_p90,
quantile_cont(l_discount, 0.5) AS discount_p50, quantile_cont(l_discount, 0.9) AS discount_p90 FROM lineitem GROUP BY l_returnflag""")
def component_percentiles(spark, d):
    names = {"l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount"}
    return latency.percentiles(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", names, [50, 90])


@query("""SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 6) AS s_click,
round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 6) AS s_purchase FROM events GROUP BY user_id""")
def filtered_sums(spark, d):
    s = latency.sums_by_type(table(spark, d, "events"), "user_id", "event_type", "value", ["click", "purchase"])
    return s.select("user_id", F.round("s_click", 6).alias("s_click"), F.round("s_purchase", 6).alias("s_purchase"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_err,
CAST(count(*) FILTER (WHERE event_type = 'error') * 100 AS DOUBLE) / nullif(count(*) FILTER (WHERE event_type IN ('error', 'view')), 0) AS rate FROM events GROUP BY user_id""")
def finalization_rates(spark, d):
    forced = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "view", 0.0)
    e = table(spark, d, "events").select("user_id", F.struct(forced.alias("fallback_forced"), F.lit(None).cast("double").alias("final_shorter_than_interim")).alias("stt_finalization_ms"))
    return latency.finalization(e, "user_id").select("user_id", "n", F.col("fallback").alias("n_err"), F.col("rate_pct").alias("rate"))


@query("""SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
AND (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 10000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""")
def list_calls_keyset(spark, d):
    owner = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    mine = table(spark, d, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_orderdate")
    return calls.page(mine, "o_orderdate", "o_orderkey", 50, (F.to_timestamp(F.lit("1997-01-01 00:00:00")), 10000))


@query("""SELECT 'transcript' AS item_type, conv_id AS call_id, turn AS seq, text FROM conversations
UNION ALL SELECT 'event', user_id, event_id, event_type FROM events""")
def timeline_union(spark, d):
    c = table(spark, d, "conversations").select(F.lit("transcript").alias("item_type"), F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), "text")
    e = table(spark, d, "events").select(F.lit("event").alias("item_type"), F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    return calls.timeline(c, e).orderBy("call_id", "seq", "item_type")


@query("""SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
AND p.user_id = e.user_id AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE))""")
def not_exists_tool_events(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("call_id"), F.to_date("ts").alias("request_id"), "event_type")
    errors = e.filter("event_type = 'error'").withColumn("component", F.lit("tool"))
    return calls.without_represented(errors, e.filter("event_type = 'purchase'")).select("event_id")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def owned_left_join_filter(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").filter("o_orderstatus = 'F'").select("c_custkey", "o_orderkey")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, max(ts) AS last_ts FROM s GROUP BY user_id, session HAVING max(ts) < TIMESTAMP '2024-01-15'""")
def stale_watchdog(spark, d):
    s = calls.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 1800)
    return s.groupBy("user_id", "session").agg(F.max("ts").alias("last_ts")).filter(F.col("last_ts") < F.to_timestamp(F.lit("2024-01-15 00:00:00")))


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type""")
def coalesced_turn_upsert(spark, d):
    return calls.last_known(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n60 FROM events""")
def rate_limit_sliding(spark, d):
    return calls.attempts_within(table(spark, d, "events"), "user_id", "ts", "event_id", 60).select("event_id", F.col("n").alias("n60"))


@query("""SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate <= TIMESTAMP '1996-01-01' OR (c_acctbal < 0 AND o_orderdate <= TIMESTAMP '1997-01-01')""")
def retention_due(spark, d):
    now = F.to_timestamp(F.lit("1999-01-01 00:00:00"))
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("call_id"), (F.col("o_orderdate") + F.expr("INTERVAL 3 YEARS")).alias("retention_until"), F.col("o_orderdate"))
    r = r.withColumn("purge_at", F.col("o_orderdate") + F.expr("INTERVAL 2 YEARS"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("call_id"), F.when(F.col("c_acctbal") < 0, now).alias("deleted_at"))
    j = r.join(c, "call_id", "left")
    return j.filter((F.col("retention_until") <= now) | (F.col("deleted_at").isNotNull() & (F.col("purge_at") <= now))).select("o_orderkey")


@query("""WITH t AS (SELECT user_id AS call_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup') AS warnings,
count(*) FILTER (WHERE event_type = 'purchase') AS tools FROM events GROUP BY user_id) SELECT * FROM t""")
def call_counters(spark, d):
    e = table(spark, d, "events").withColumn("call_id", F.col("user_id"))
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").otherwise("info")
    turns = e.select("call_id", F.col("event_id").alias("sequence"), F.lit(False).alias("interrupted"))
    out = calls.counters(turns, e.select("call_id", severity.alias("severity")), e.filter("event_type = 'purchase'").select("call_id"))
    return out.select("call_id", "errors", "warnings", "tools")


@query("""WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS a, min(ts) FILTER (WHERE event_type = 'click') AS b, min(ts) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(greatest(0, (epoch_us(b) - epoch_us(a)) // 1000) AS DOUBLE) END AS view_to_click_ms, CASE WHEN b IS NOT NULL AND c IS NOT NULL THEN CAST(greatest(0, (epoch_us(c) - epoch_us(b)) // 1000) AS DOUBLE) END AS click_to_purchase_ms FROM f""")
def stage_deltas(spark, d):
    m = table(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), "ts")
    return latency.stage_deltas(m, ["user_id"], ["view", "click", "purchase"])


@query("""WITH s AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, l_quantity AS p95 FROM s WHERE r - 1 = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)""")
def nearest_rank_p95(spark, d):
    """The exact order statistic from a count of each value, which is what tasks exchange, instead of all values of a group in one array."""
    from pyspark.sql import Window as W

    v = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))
    w = W.partitionBy("l_returnflag")
    v = v.withColumn("until", F.sum("c").over(w.orderBy("l_quantity"))).withColumn("at", F.bround((F.sum("c").over(w) - 1) * F.lit(0.95)).cast("long"))
    return v.filter((F.col("until") > F.col("at")) & (F.col("until") - F.col("c") <= F.col("at"))).select("l_returnflag", F.col("l_quantity").alias("p95"))


@query("""WITH m AS (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations),
g AS (SELECT conv_id, grp, count(*) AS n, sum(length(coalesce(text, ''))) AS c FROM m GROUP BY conv_id, grp),
b AS (SELECT *, sum(n) OVER w > 6 OR sum(c) OVER w > 4000 AS over, grp = max(grp) OVER (PARTITION BY conv_id) AS newest FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY grp DESC)),
k AS (SELECT conv_id, grp, newest, bool_or(over) OVER (PARTITION BY conv_id ORDER BY grp DESC) AS broken FROM b)
SELECT m.conv_id, m.turn FROM m JOIN k ON m.conv_id = k.conv_id AND m.grp = k.grp WHERE newest OR NOT broken""")
def recent_context_budget(spark, d):
    c = table(spark, d, "conversations")
    return calls.recent_context(c, "conv_id", "turn", "role", "text", 6, 4000).select("conv_id", "turn")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system'),
g AS (SELECT conv_id, (n - 1) // 8 AS chunk, count(*) AS c, min(turn) AS s, max(turn) AS e, arg_max(role, turn) AS last,
string_agg(CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Assistant' ELSE role END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM m GROUP BY ALL)
SELECT conv_id, s AS start_turn, e AS end_turn, left(t, 1200) AS text FROM g WHERE c = 8 AND last = 'assistant'""")
def memory_chunks_every_8(spark, d):
    from talkgrain.operators.memory import chunks

    c = table(spark, d, "conversations").filter("role <> 'system'")
    return chunks(c, "conv_id", "turn", {"user": "You", "assistant": "Assistant"}).select("conv_id", F.col("start").alias("start_turn"), F.col("end").alias("end_turn"), "text")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(trim(event_type)) ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, event_type, event_id FROM x WHERE n = 1 AND value >= 10""")
def active_facts(spark, d):
    from talkgrain.operators.memory import active_facts as held

    f = table(spark, d, "events").select(F.col("user_id").alias("user"), F.lit("t").alias("type"), F.lit("k").alias("key"), F.col("event_type").alias("value"), F.when(F.col("value") >= 10, "set").otherwise("remove").alias("op"), F.col("event_id").alias("seq"))
    return held(f, []).select(F.col("user").alias("user_id"), F.col("value").alias("event_type"), F.col("seq").alias("event_id"))


@query("""SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior FROM orders""")
def prior_conversation(spark, d):
    from talkgrain.operators.memory import prior_conversation as prior

    return prior(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", "prior")


@query(r"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, left(string_agg(role || ': ' || left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 180), ' | ' ORDER BY turn), 1200) AS lines FROM m WHERE n <= 8 GROUP BY conv_id""")
def last_lines(spark, d):
    from talkgrain.operators.memory import last_lines as lines

    return lines(table(spark, d, "conversations"), "conv_id", "turn")
