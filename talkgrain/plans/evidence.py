"""Queries on what was said where, and on what of it a budget holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions import spans
from talkgrain.functions.text import TERM
from talkgrain.operators import memory, provenance
from talkgrain.plans.registry import query
from talkgrain.session import table


@query("""WITH x AS (SELECT c_custkey, 'user' || c_custkey || '@example.com' AS v FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'a@b.com' ELSE v END AS address, CAST(CASE c_custkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 6 ELSE 0 END AS BIGINT) AS first,
CAST(CASE c_custkey % 3 WHEN 0 THEN 9 + length(v) + 7 WHEN 1 THEN 6 + length(v) ELSE 7 END AS BIGINT) AS until FROM x""")
def spoken_address_spans(spark, d):
    """The first address that a dictation says, with its place in the text."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("write to user"), k, F.lit(" at example dot com"))).when(k % 3 == 1, F.concat(F.lit("it is USER"), k, F.lit("@Example.com please"))).otherwise(F.concat(F.lit("a@b.com or c@d.com "), k))
    first = F.get(spans.addresses(said), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", first["value"].alias("address"), first["start"].cast("long").alias("first"), first["end"].cast("long").alias("until"))


@query(rf"""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_extract_all(lower(coalesce(text, '')), '{TERM}')[-1] AS v,
' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_-]', ' ', 'g') || ' ' AS s FROM conversations WHERE role = 'user'),
h AS (SELECT a.conv_id, a.turn AS value_turn, a.v, b.turn, CASE WHEN a.v IS NULL THEN 0 ELSE strpos(b.s, ' ' || a.v || ' ') END AS p FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 3 AND a.n),
g AS (SELECT conv_id, value_turn, any_value(v) AS value, count(*) FILTER (p > 0) AS n_turns, max(turn) FILTER (p > 0) AS turn, max(p) FILTER (p > 0) AS p FROM h GROUP BY conv_id, value_turn)
SELECT conv_id, value_turn, value, n_turns, CASE WHEN n_turns = 1 THEN 'found' WHEN n_turns > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
CASE WHEN n_turns = 1 THEN turn END AS turn, CASE WHEN n_turns = 1 THEN p - 1 END AS first, CASE WHEN n_turns = 1 THEN p - 1 + length(value) END AS until FROM g""")
def value_provenance(spark, d):
    """Where among the last four user turns the last word of each turn is said, if in one of them only."""
    turns = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    value = F.element_at(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)), -1)
    values = turns.select("conv_id", F.col("turn").alias("at"), F.when(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)) > 0, value).alias("value"))
    out = provenance.said_in(values, turns, "conv_id")
    return out.select("conv_id", F.col("at").alias("value_turn"), "value", "n_turns", "status", "turn", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("until"))


_NORM = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"


@query(rf"""WITH m AS (SELECT conv_id, turn, role, text, {_NORM} AS n, role = 'system' AS lead FROM conversations),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY lead DESC, CASE WHEN lead THEN turn ELSE -turn END) AS k FROM m WHERE n <> '') WHERE k = 1),
a AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS before FROM f WHERE lead),
dev AS (SELECT conv_id, turn, role, left(text, CAST(1500 - before AS BIGINT)) AS text FROM a WHERE before < 1500),
s AS (SELECT conv_id, sum(length(text)) AS used, string_agg({_NORM}, ' ' ORDER BY turn) AS said FROM dev GROUP BY conv_id),
b AS (SELECT f.*, coalesce(used, 0) + sum(length(text)) OVER (PARTITION BY f.conv_id ORDER BY turn DESC) - length(text) AS before FROM f LEFT JOIN s ON s.conv_id = f.conv_id
      WHERE NOT lead AND NOT (length(n) >= 24 AND contains(coalesce(said, ''), n)))
SELECT conv_id, turn, role, text AS content FROM dev UNION ALL SELECT conv_id, turn, role, left(text, CAST(1500 - before AS BIGINT)) FROM b WHERE before < 1500""")
def budgeted_messages(spark, d):
    """What of each conversation a budget of 1500 characters holds."""
    m = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return memory.within_budget(m, "conv_id", "turn", 1500, "system")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT p.vec_id AS q, v.vec_id, list_cosine_similarity(v.e, p.e) AS s FROM v, v p WHERE p.vec_id % 20 = 0 AND v.label = p.label AND v.vec_id <> p.vec_id)
SELECT q, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS n FROM s) WHERE n <= 5 AND s >= 0.25""")
def memory_recall_near(spark, d):
    """memory_recall with a floor that chunks of these vectors reach; the floor comes after the limit."""
    e = table(spark, d, "embeddings")
    probes = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe_conv"), F.col("label").alias("probe_user"), F.col("embedding").alias("probe"))
    held = e.select(F.col("vec_id").alias("conv_id"), F.lit(0).alias("chunk"), F.col("label").alias("user"), "embedding")
    return memory.recall(probes, held, least=0.25).select(F.col("probe_conv").alias("q"), F.col("conv_id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))
