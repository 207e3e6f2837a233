"""Files as DataFrames: telemetry and evaluation lines, taxonomies, lexicons, journals."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The typed part of a telemetry record; fields that aren't named here are ignored.
TELEMETRY = (
    "user_id int, session_id string, turn_id string, category string, measurement_source string, latency_complete boolean, input_mode string, interrupted boolean, outcome string, "
    "llm_connection_warmed boolean, stt_finalization_ms map<string,double>, answer_audio_ms double, user_stop_to_playback_ms double, stt_latency_ms double, llm_latency_ms double, "
    "response_preparation_ms double, server_endpointing_ms double, turn_release_ms double, pre_llm_ms double, llm_ttft_ms double, tts_latency_ms double, llm_ms double, "
    "tts_aggregation_ms double, tts_provider_ms double, endpointing_ms double, rtt_ms double"
)
STATUSES = ("ok", "no_answer", "unavailable")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line. Blank lines are skipped and lines that hold something else than an object dropped; a broken line is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind = F.schema_of_variant(F.parse_json("value"))  # fails on a broken line
    objects = lines.filter(kind.startswith("OBJECT"))
    return objects.select(F.from_json("value", schema).alias("r")).select("r.*")


def split_broken(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines): as json_lines, but broken lines go aside, as a journal's replay does."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    v = F.try_parse_json("value")
    good = v.isNotNull() & F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return lines.filter(good).select(F.from_json("value", schema).alias("r")).select("r.*"), lines.filter(~good).withColumnRenamed("value", "line")


def checked(records: DataFrame, ranges: dict[str, tuple[float, float]], enums: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with their problems): numbers within ranges and values of enums, nulls allowed."""
    bad = [F.when(F.col(c).isNotNull() & ~F.col(c).between(lo, hi), c) for c, (lo, hi) in ranges.items()]
    bad += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*vs), c) for c, vs in enums.items()]
    with_ = records.withColumn("problems", F.array_compact(F.array(*bad)))
    return with_.filter(F.size("problems") == 0).drop("problems"), with_.filter(F.size("problems") > 0)


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, query, expected_status, expected_unit_keys, expected_source_contains, answer_type, requires_live_data. Lines that begin with # are comments.

    A case without id or query, or with an unknown status, is an error.
    """
    schema = "id string, query string, expected_status string, expected_unit_keys array<string>, expected_source_contains array<string>, answer_type string, requires_live_data boolean"
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    r = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "value").select("r.*", "value")
    good = F.coalesce((F.trim("id") != "") & (F.trim("query") != "") & F.col("expected_status").isin(*STATUSES), F.lit(False))
    query = F.when(good, F.col("query")).otherwise(F.raise_error(F.concat(F.lit("invalid evaluation case: "), F.col("value"))))
    return r.withColumn("query", query).drop("value")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """code, subcode, remark, status, row of a CSV with a byte-order mark or not, whatever the spelling of its headers."""
    names = {"code": ("ticketcode", "code"), "subcode": ("ticketsubcode", "subcode"), "remark": ("remarks", "remark", "ticketremarks"), "status": ("status",)}
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    found = {re.sub("[^a-z0-9]", "", c.lower()): c for c in raw.columns}
    cols = [next((F.col(f"`{found[n]}`") for n in ns if n in found), F.lit("")).alias(k) for k, ns in names.items()]
    return raw.select(*cols, F.monotonically_increasing_id().alias("row"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """version, written, spoken, pos of a pronunciation lexicon; an entry that lacks a side is an error."""
    doc = spark.read.json(path, multiLine=True, schema="version string, entries array<struct<written:string,spoken:string>>")
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    e = doc.select(F.coalesce("version", F.lit("unversioned")).alias("version"), F.posexplode("entries").alias("pos", "e")).select("version", clean(F.col("e.written")).alias("written"), clean(F.col("e.spoken")).alias("spoken"), "pos")
    whole = (F.col("written") != "") & (F.col("spoken") != "")
    return e.withColumn("written", F.when(whole, F.col("written")).otherwise(F.raise_error(F.lit("a lexicon entry lacks a side"))))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """hash, url, title, text, intact: the pages of a manifest (manifest.json with `pages`) with the file <hash>.md of each.

    intact tells whether the file's SHA-256 is the hash; a page without a file has a null text.
    """
    m = spark.read.json(f"{folder}/manifest.json", multiLine=True, schema="pages array<struct<hash:string,url:string,title:string>>")
    pages = m.select(F.explode("pages").alias("p")).select("p.*")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    texts = files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("hash"), F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("_sha"))
    return pages.join(texts, "hash", "left").select("hash", "url", "title", "text", F.coalesce(F.col("_sha") == F.col("hash"), F.lit(False)).alias("intact"))


def append_lines(rows: DataFrame, path: str, version: int = 1) -> None:
    """Appends rows as JSON lines, keys sorted, with schema_version and recorded_at."""
    stamped = rows.withColumn("schema_version", F.lit(version)).withColumn("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    stamped.select(*sorted(stamped.columns)).write.mode("append").json(path)
