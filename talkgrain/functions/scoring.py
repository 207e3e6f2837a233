"""Scores of retrieval, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the fused score.
WEIGHTS = {"vector": 0.28, "lexical": 0.19, "overlap": 0.08, "field": 0.35, "rrf": 0.10, "alias": 0.08, "authority": 0.025}
RRF_K = 60
MIN_CONFIDENCE = 0.42


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def share(query_terms: Column, unit_terms: Column) -> Column:
    """The part of the query's terms that the unit has; 0 for a query without terms.

    Both arrays are bound to a lambda's variable first, so that each is computed once.
    """
    part = lambda p: F.when(F.size(p["q"]) > 0, F.size(F.array_intersect(p["q"], p["u"])) / F.size(p["q"])).otherwise(F.lit(0.0))
    return F.get(F.transform(F.array(F.struct(query_terms.alias("q"), unit_terms.alias("u"))), part), F.lit(0))


def lexical_rank(matching_occurrences: Column) -> Column:
    """Of a disjunction of single words, each at the default weight: 0.1 for each occurrence."""
    return matching_occurrences * F.lit(0.1)


def rrf(*positions: Column) -> Column:
    """Sum of 1 / (60 + position) of the lists that hold a unit, as a share of the best possible for two lists."""
    total = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), 1.0 / (RRF_K + p)).otherwise(F.lit(0.0)) for p in positions])
    return F.least(F.lit(1.0), total / (2.0 / (RRF_K + 1)))


def fused(vector: Column, rank: Column, overlap: Column, field: Column, rrf_: Column, alias: Column, authority: Column) -> Column:
    w = WEIGHTS
    parts = (
        w["vector"] * F.coalesce(vector, F.lit(0.0))
        + w["lexical"] * F.least(F.lit(1.0), F.coalesce(rank, F.lit(0.0)) * 4.0)
        + w["overlap"] * overlap
        + w["field"] * field
        + w["rrf"] * rrf_
        + F.when(alias, F.lit(w["alias"])).otherwise(F.lit(0.0))
        + F.greatest(F.lit(0.0), (authority - 3) * w["authority"])
    )
    return F.round(F.least(F.lit(1.0), parts), 6)


def ticket_score(query: Column, code: Column, subcode: Column, remark: Column) -> Column:
    """Weighted matches of a description's terms with a taxonomy entry's, by the number of terms that could match."""
    hits = lambda t: F.size(F.array_intersect(query, t))
    weighted = 1.0 * hits(code) + 1.5 * hits(subcode) + 2.0 * hits(remark)
    return F.round(weighted / F.greatest(F.lit(1.0), F.size(query) + F.size(F.array_union(subcode, remark))), 6)
