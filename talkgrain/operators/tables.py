"""Writes as functions: what a table becomes. Spark tables on plain files have no row-level updates, so each gives the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def insert_missing(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key current lacks, each key once; append them."""
    once = new.dropDuplicates(keys)
    return once.join(current.select(*keys).distinct(), keys, "left_anti")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: of new the last by order, else current's."""
    last = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def replace_group(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys that new has are replaced by its rows."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def purge(rows: DataFrame, due: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, the keys that go)."""
    gone = F.coalesce(due, F.lit(False))
    return rows.filter(~gone), rows.filter(gone).select(key)


def forget_owner(rows: DataFrame, owner: str, who: DataFrame) -> DataFrame:
    return rows.join(who.select(owner).distinct(), owner, "left_anti")


def deletion_state(log: DataFrame, key: str, order: str, now: Column, days: int) -> DataFrame:
    """key, deleted, restorable from a log of deletes and restores (kind): the last entry decides, and a delete can be undone for so many days."""
    last = log.groupBy(key).agg(F.max_by("kind", order).alias("kind"), F.max_by("at", order).alias("at"))
    deleted = F.col("kind") == "delete"
    return last.select(key, deleted.alias("deleted"), (deleted & (now < F.col("at") + F.make_dt_interval(F.lit(days)))).alias("restorable"))


def approve(units: DataFrame, which: Column, conflicts: DataFrame) -> DataFrame:
    """Drafts chosen by `which` become approved, except those with an open conflict."""
    open_ = conflicts.filter("status = 'open'").select(F.explode(F.array("left_id", "right_id")).alias("unit_id")).distinct().withColumn("_open", F.lit(True))
    u = units.join(open_, "unit_id", "left")
    go = (F.col("status") == "draft") & which & F.col("_open").isNull()
    return u.withColumn("status", F.when(go, "approved").otherwise(F.col("status"))).drop("_open")


def release_report(release_units: DataFrame, units: DataFrame, embeddings: DataFrame, conflicts: DataFrame, version: int) -> DataFrame:
    """One row: units, those not approved, without embedding, open conflicts; `valid` if nothing but units is above 0."""
    mine = release_units.filter(F.col("version") == version).select("unit_id")
    u = mine.join(units.select("unit_id", "status"), "unit_id", "left").join(embeddings.select("unit_id", F.lit(True).alias("has")).distinct(), "unit_id", "left")
    bad = conflicts.filter("status = 'open'")
    touched = bad.select(F.xxhash64("left_id", "right_id").alias("c"), F.explode(F.array("left_id", "right_id")).alias("unit_id")).join(mine, "unit_id", "left_semi")
    n = touched.agg(F.countDistinct("c").alias("open_conflicts")).first()[0]
    out = u.agg(F.count("*").alias("units"), F.count_if(F.coalesce(F.col("status") != "approved", F.lit(True))).alias("not_approved"), F.count_if(F.col("has").isNull()).alias("not_embedded")).withColumn("open_conflicts", F.lit(n))
    return out.withColumn("valid", (F.col("units") > 0) & (F.col("not_approved") + F.col("not_embedded") + F.col("open_conflicts") == 0))


def rollback(releases: DataFrame, version: int) -> DataFrame:
    """A superseded release is published again; the published one is superseded."""
    ok = releases.filter((F.col("version") == version) & (F.col("status") == "superseded"))
    if ok.isEmpty():
        raise ValueError("only a superseded release can be published again")
    return releases.withColumn("status", F.when(F.col("version") == version, "published").when(F.col("status") == "published", "superseded").otherwise(F.col("status")))


def rolling(rows: DataFrame, key: str, order: str, value: str, n: int = 64) -> DataFrame:
    """Adds min, max, avg and last of the latest n values of each key."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    v = F.col(value)
    return rows.select("*", F.min(v).over(w).alias("min"), F.max(v).over(w).alias("max"), F.avg(v).over(w).alias("avg"), F.last(v, ignorenulls=True).over(w).alias("last"))
