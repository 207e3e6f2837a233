"""Percentiles a cohort that go on over batches and days: quantile sketches, kept as rows and merged when asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch (KLL): some kilobytes, whatever it has seen.
K = 400
#: With that size a percentile's rank is off by less than this share of the values, at 99 % of times.
RANK_ERROR = 0.01


def sketched(rows: DataFrame, cohort: str, day: str, value: str) -> DataFrame:
    """cohort, day, n, sketch: a row for each cohort and day. Null values count nowhere."""
    v = F.col(value).cast("double")
    return rows.filter(v.isNotNull()).groupBy(F.col(cohort).alias("cohort"), F.col(day).alias("day")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, K).alias("sketch"))


def sink(path: str, cohort: str, day: str, value: str):
    """For foreachBatch: adds a micro-batch's sketches; a batch that is run again replaces its own."""
    return lambda batch, batch_id: sketched(batch, cohort, day, value).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("cohort", "day", "n", "sketch")


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """n and one sketch for each group; merging in any order and in steps keeps the error's bound."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def compacted(sketches: DataFrame) -> DataFrame:
    """One row for each cohort and day, for a table that holds many batches."""
    return merged(sketches, "cohort", "day")


def percentiles(sketches: DataFrame, shares: dict[str, float], where: Column | None = None) -> DataFrame:
    """cohort, n and a column for each share, over the days that `where` lets through."""
    rows = sketches if where is None else sketches.filter(where)
    m = merged(rows, "cohort")
    return m.select("cohort", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(name) for name, s in shares.items()])
