"""Sources, snapshots, releases and reports of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_snapshots(snapshots: DataFrame, url: Column, order: str) -> DataFrame:
    """The last snapshot of each canonical address, as its whole row. A maximum of a struct: tasks exchange one row an address."""
    row = F.struct(*snapshots.columns)
    return snapshots.filter(url.isNotNull()).groupBy(url.alias("_url")).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def units_of_source(units: DataFrame, documents: DataFrame, snapshots: DataFrame, source: Column) -> DataFrame:
    """Units with the document and snapshot that they come from, of one source."""
    s = snapshots.filter(source)
    return units.join(documents, "document_id").join(s, "snapshot_id")


def released(units: DataFrame, release_units: DataFrame, releases: DataFrame) -> DataFrame:
    """The units of the published release."""
    live = releases.filter("status = 'published'").select("release_id")
    return units.join(release_units.join(live, "release_id", "left_semi").select("unit_id").distinct(), "unit_id", "left_semi")


def histogram(rows: DataFrame, *by: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, value: Column, n: int, first: str) -> DataFrame:
    """The n most frequent values; of equally frequent ones those seen first."""
    g = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return g.orderBy(F.col("n").desc(), "first").limit(n)


def kinds_of(parts: DataFrame, key: str, kind: str, known: dict[str, str], default: Column) -> DataFrame:
    """key, unit_type: by the only structured kind of a chunk's parts if `known` names it, else the default."""
    g = parts.groupBy(key).agg(F.collect_set(kind).alias("_kinds"), F.first(default).alias("_default"))
    only = F.when(F.size("_kinds") == 1, F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.get("_kinds", F.lit(0))))
    return g.select(key, F.coalesce(only, F.col("_default")).alias("unit_type"))


def listed(rows: DataFrame, tests: list[Column], order: list[Column], size: int, page: int) -> DataFrame:
    """One page (numbered from 1) of the rows that pass all tests, at most 200 rows long."""
    for t in tests:
        rows = rows.filter(t)
    size = max(1, min(size, 200))
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def checked_vectors(rows: DataFrame, size: int, provider: str) -> DataFrame:
    """An error where a vector has another length or provider than asked for."""
    good = (F.size("embedding") == size) & (F.col("provider") == provider)
    return rows.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(F.lit(f"not a vector of length {size} by {provider}"))))


def crawl_report(outcomes: DataFrame) -> DataFrame:
    """One row with the number of each outcome."""
    kinds = ("indexed", "duplicate", "skipped_policy", "skipped_asset", "failed")
    return outcomes.agg(F.count("*").alias("pages"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def decided(units: DataFrame, flag: str, by: str) -> DataFrame:
    """by, any, all, none of a flag; a missing flag is false."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return units.groupBy(by).agg(F.bool_or(f).alias("any"), F.bool_and(f).alias("all"), (~F.bool_or(f)).alias("none"))


def newest_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(o).desc() for o in order]))
    return rows.withColumn("pos", nth)


def narrow_release(units: DataFrame, releases: DataFrame, version: int, host: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(units, release): the drafts of units(unit_id, status, source_uri) under one host and path prefix approved, and rows (version, unit_id) of all approved units there.

    A version that releases(version) has already isn't made again: units stay as they are, and the release has no rows. The prefix ends at a path's part.
    """
    uri = F.lower(F.coalesce("source_uri", F.lit("")))
    path = F.regexp_extract(F.coalesce("source_uri", F.lit("")), "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    base = prefix.rstrip("/")
    inside = (F.regexp_extract(uri, "^[a-z]+://([^/?#]*)", 1) == host.lower()) & ((path == base) | path.startswith(base + "/"))
    if not releases.filter(F.col("version") == version).isEmpty():
        return units, units.select(F.lit(version).alias("version"), "unit_id").filter("false")
    done = units.withColumn("status", F.when(inside & (F.col("status") == "draft"), "approved").otherwise(F.col("status")))
    return done, done.filter(inside & (F.col("status") == "approved")).select(F.lit(version).alias("version"), "unit_id")
