"""Latency telemetry: which turns count, which record of a turn wins, cohorts and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.functions.times import millis_between
from talkgrain.session import settled

CATEGORIES = ("direct", "rag", "tool")
METRICS = (
    "answer_audio_ms user_stop_to_playback_ms stt_latency_ms llm_latency_ms response_preparation_ms server_endpointing_ms "
    "turn_release_ms pre_llm_ms llm_ttft_ms tts_latency_ms llm_ms tts_aggregation_ms tts_provider_ms endpointing_ms rtt_ms"
).split()


def percentile(value: Column, share: float) -> Column:
    """Exact, by linear interpolation; null values are left out."""
    return F.percentile(value.cast("double"), F.lit(share))


def nearest_rank(value: Column, share: float) -> Column:
    """The value whose index is (n - 1) * share, rounded half to even."""
    ordered = F.array_sort(F.collect_list(value))
    return F.get(ordered, F.bround((F.size(ordered) - 1) * F.lit(share)).cast("int"))


def eligible(categories=CATEGORIES) -> Column:
    """A complete, uninterrupted voice turn measured by the client. Missing flags never count as true."""
    true = lambda c: F.coalesce(F.col(c) == F.lit(True), F.lit(False))
    return (
        (F.col("user_stop_to_playback_ms") >= 0)
        & (F.col("measurement_source") == "client")
        & true("latency_complete")
        & (F.col("input_mode") == "voice")
        & F.col("category").isin(*categories)
        & ~true("interrupted")
        & (F.coalesce("outcome", F.lit("")) != "cancelled")
    )


def cohorts(samples: DataFrame, category: str = "category", value: str = "user_stop_to_playback_ms") -> DataFrame:
    """category, n, avg_ms, p50_ms, p90_ms. One partial aggregation and one shuffle on the category, whatever the number of rows."""
    v = F.col(value)
    return samples.groupBy(F.col(category).alias("category")).agg(
        F.count(v).alias("n"), F.avg(v).alias("avg_ms"), percentile(v, 0.5).alias("p50_ms"), percentile(v, 0.9).alias("p90_ms")
    )


def finalization(samples: DataFrame, by: str = "category") -> DataFrame:
    """Counts of turns with finalization figures, of forced fallbacks and shortened finals. The rate is null without any."""
    m = F.col("stt_finalization_ms")
    had = m["fallback_forced"].isNotNull()
    forced = had & (m["fallback_forced"] >= 0.5)
    shorter = had & (F.coalesce(m["final_shorter_than_interim"], F.lit(0.0)) >= 0.5)
    n, f = F.count_if(had), F.count_if(forced)
    return samples.groupBy(by).agg(
        n.alias("n"), (n - f).alias("native"), f.alias("fallback"), (f * 100 / F.nullif(n, F.lit(0))).alias("rate_pct"), F.count_if(shorter).alias("shorter")
    )


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`; rows that lack a part of their key are all kept."""
    lacking = F.lit(False)
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*[o.desc() for o in order]))
    keyed = rows.filter(~lacking).withColumn("_nth", first).filter("_nth = 1").drop("_nth")
    return keyed.unionByName(rows.filter(lacking))


def one_record_a_turn(records: DataFrame, position: str = "position") -> DataFrame:
    """The client's record of a turn before the server's; of equal ones the later. Records without a session or turn are all kept."""
    rank = F.when(F.col("measurement_source") == "client", 2).otherwise(1)
    rows = records.withColumn("_user", F.coalesce(F.col("user_id").cast("string"), F.lit("-")))
    return latest_wins(rows, ["session_id", "turn_id", "_user"], [rank, F.col(position)]).drop("_user")


def report(records: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """grp, metric, n, min, p50, p90, p95, p99, max. Every turn counts in its category's `all` and in its `warm` or `cold`."""
    metrics = [m for m in (metrics or METRICS) if m in records.columns]
    warmth = F.when(F.coalesce("llm_connection_warmed", F.lit(False)), "warm").otherwise("cold")
    long = records.select(F.coalesce("category", F.lit("unknown")).alias("category"), warmth.alias("warmth"), *metrics).unpivot(["category", "warmth"], metrics, "metric", "value")
    v = F.col("value")
    grouped = long.filter("value is not null").groupingSets([["category", "metric"], ["category", "warmth", "metric"]], "category", "warmth", "metric")
    figures = [F.count(v).alias("n"), F.min(v).alias("min"), *[percentile(v, p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)], F.max(v).alias("max")]
    return grouped.agg(*figures).select(F.concat_ws(":", "category", F.coalesce("warmth", F.lit("all"))).alias("grp"), "metric", "n", "min", "p50", "p90", "p95", "p99", "max")


def sums_by_type(rows: DataFrame, key: str, type_: str, value: str, types: list[str]) -> DataFrame:
    """One conditional sum for each type, 0 where there is none."""
    return rows.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col(type_) == t, F.col(value))), F.lit(0.0)).alias(f"s_{t}") for t in types])


def stage_deltas(marks: DataFrame, key: list[str], stages: list[str]) -> DataFrame:
    """Per turn the first time of each stage, and the milliseconds between successive stages, 0 at least. marks: key, stage, ts."""
    first = marks.groupBy(*key).pivot("stage", stages).agg(F.min("ts"))
    gaps = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), millis_between(F.col(a), F.col(b))).cast("double").alias(f"{a}_to_{b}_ms") for a, b in zip(stages, stages[1:], strict=False)]
    return first.select(*key, *gaps)


def percentiles(rows: DataFrame, by: str, values: dict[str, str], shares: list[int]) -> DataFrame:
    """by, and of each column in values its name_pN: exact percentiles by linear interpolation as percentile() has them, for groups of any size.

    Equal values are counted, sorted by ranges over all tasks and numbered by the counts of the ranges before them; of a group only the values at the
    asked positions come together.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for c, n in values.items()]))
    counted = rows.select(F.col(by).alias("by"), each.alias("x")).select("by", "x.*").groupBy("by", "name", "value").agg(F.count("value").alias("c"))
    ranged = settled(counted.repartitionByRange("by", "name", "value").withColumn("range", F.spark_partition_id()))
    group = W.partitionBy("by", "name")
    totals = ranged.groupBy("range", "by", "name").agg(F.sum("c").alias("c"))  # a row for each range and group in it
    totals = totals.select(
        F.col("range").alias("_range"), F.col("by").alias("_by"), F.col("name").alias("_name"), F.sum("c").over(group).alias("n"),
        (F.sum("c").over(group.orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("before"),
    )
    here = W.partitionBy("range", "by", "name").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    same = (F.col("range") == F.col("_range")) & F.col("by").eqNullSafe(F.col("_by")) & (F.col("name") == F.col("_name"))
    placed = ranged.withColumn("_to", F.sum("c").over(here)).join(totals, same)
    placed = placed.withColumn("last", F.col("before") + F.col("_to") - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    figures = {}
    wanted = F.col("n") == 0
    for s in shares:
        at = (F.col("n") - 1) * F.lit(s / 100)
        ends = F.floor(at), F.ceil(at)
        holds = [(F.col("first") <= e) & (e <= F.col("last")) for e in ends]
        wanted = wanted | holds[0] | holds[1]
        for name in values.values():
            figures[name, s] = [F.max(F.when((F.col("name") == name) & h, F.col("value"))) for h in holds] + [F.max(F.when(F.col("name") == name, at))]
    cols = [f.alias(f"{n}_{s}_{i}") for (n, s), fs in figures.items() for i, f in enumerate(fs)]
    found = placed.filter(wanted).groupBy("by").agg(*cols)

    def between(n: str, s: int) -> Column:
        low, high, at = (F.col(f"{n}_{s}_{i}") for i in range(3))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(f"{n}_p{s}")

    return found.select(F.col("by").alias(by), *[between(n, s) for n in values.values() for s in shares])
