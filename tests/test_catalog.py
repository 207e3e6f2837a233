import pytest

import __spark_entry__ as entry
from talkgrain import catalog
from tests.oracle import D, assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", ["corrected_event_time", "event_fingerprints", "local_times", "turn_ends", "unsuperseded_results", "value_provenance"])
def test_oracle_on_more_rows(spark, name):
    """Times, hashes and orders, of which the small tables have few odd cases."""
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLE[name], "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() >= 0


def test_near_dup_pairs_are_all_found(spark):
    """Against all pairs."""
    from pyspark.sql import functions as F

    from talkgrain.functions.simhash import simhashes

    rows = simhashes(spark.read.parquet(f"{D}/documents.parquet"), ["doc_id", "lang"], "text").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        if r.tokens >= 12:
            first.setdefault((r.lang, r.hash, r.tokens), r)
    kept = list(first.values())
    close = lambda a, b: a.lang == b.lang and bin((a.hash ^ b.hash) & (2**64 - 1)).count("1") <= 6 and min(a.tokens, b.tokens) >= 0.9 * max(a.tokens, b.tokens)
    want = {(a.doc_id, b.doc_id) for a in kept for b in kept if a.doc_id < b.doc_id and close(a, b)}
    from talkgrain.operators.corpus import near_pairs

    u = spark.read.parquet(f"{D}/documents.parquet").select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("unit_type"), F.col("text").alias("answer"))
    assert {(r.left_id, r.right_id) for r in near_pairs(u, radius=6).collect()} == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["item_id", "doc_id", "score", "matched_by", "pos"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
