"""The batch sides of streaming operators; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.plans.lifecycle import _tools
from talkgrain.plans.registry import query
from talkgrain.session import settled, table
from talkgrain.streaming import joins, ordered, sketches


@query("""WITH s AS (SELECT user_id AS key, event_id AS id, ts FROM events WHERE event_type = 'click'),
r AS (SELECT event_id - 1 AS id, ts, CASE WHEN value < 5 THEN 'timeout' WHEN value < 20 THEN 'failed' WHEN value < 30 THEN 'unavailable' WHEN value < 40 THEN 'completed' ELSE 'ok' END AS status FROM events),
j AS (SELECT s.key, s.id, s.ts, r.ts AS done, status FROM s LEFT JOIN r ON s.id = r.id AND r.ts BETWEEN s.ts AND s.ts + INTERVAL 7 DAYS)
SELECT key, id AS tool_call_id, ts AS at, coalesce(status, 'timed_out') AS status,
CASE coalesce(status, 'timed_out') WHEN 'timeout' THEN 'tool.execution_timeout' WHEN 'timed_out' THEN 'tool.execution_timeout' WHEN 'failed' THEN 'tool.execution_failed' WHEN 'unavailable' THEN 'tool.unavailable' END AS error_code,
(epoch_us(done) - epoch_us(ts)) // 1000 AS duration_ms FROM j""")
def tool_outcomes_within(spark, d):
    """Tool calls with the result that came within a week, else timed out."""
    return joins.outcomes_within(*_tools(spark, d), seconds=7 * 86_400)


@query("""WITH g AS (SELECT user_id, event_id, CAST(event_id % 7 AS BIGINT) AS generation, ts FROM events)
SELECT user_id, event_id, generation FROM (SELECT *, max(generation) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM g) WHERE generation = top""")
def unsuperseded_results(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 7).cast("long").alias("generation"), "ts")
    return ordered.current_results(e, "user_id", "generation", ("ts", "event_id")).drop("ts")


@query("""SELECT event_type AS cohort, count(value) AS n, true AS p50_near, true AS p90_near FROM events GROUP BY event_type""")
def cohort_percentiles(spark, d):
    """Whether each cohort's percentiles, from a sketch for each day, have ranks within the stated error."""
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    p = settled(sketches.percentiles(sketches.sketched(e, "event_type", "day", "value"), {"p50": 0.5, "p90": 0.9}))
    near = lambda c, s: (F.abs(F.avg((F.col("value") <= F.col(c)).cast("double")) - s) <= sketches.RANK_ERROR + 1 / F.count("*")).alias(f"{c}_near")
    return e.join(p, e["event_type"] == p["cohort"]).groupBy("cohort", "n").agg(near("p50", 0.5), near("p90", 0.9))
