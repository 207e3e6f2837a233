"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule, a piecewise-linear density of its demand over training time
t in [0, 1]. Integrating the schedule gives the source's cumulative token demand D(t), scaled to end at
its target. The documents of a source, in a seeded hash order, form a token stream that repeats when
it ends; the copy that starts at token c of that stream is trained on at t = D^-1(c). Copies that
would start at or after the target aren't taken, and the one that crosses it is cut there. Documents are
range-sorted by position.

Order within a source needs a running sum. Rows are dealt into hash-prefix buckets, bucket totals
are summed per source (a table of sources x buckets), and each bucket then runs its own short window, so
that one source holding most rows still spreads over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from talkgrain.llm.common import WORD, Scratch

WEIGHTS = (5, 2, 1)
#: Knots (t, density) by weight class: steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    """A 60-bit hash as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))), 1, 15), 16, 10).cast("long")


def invert(knots, fraction: Column) -> Column:
    """The t at which the integral of the piecewise-linear density over [0, t] is this fraction of the whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    if any(b[0] <= a[0] for a, b in zip(knots, knots[1:], strict=False)) or min(k[1] for k in knots) < 0 or sum(areas) <= 0:
        raise ValueError("knots must rise in t and have a density of at least 0, above 0 somewhere")
    whole, out, before = sum(areas), None, 0.0
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        slope = (w1 - w0) / (t1 - t0)
        rest = fraction * whole - before
        under = w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest))
        t = F.least(F.lit(t1), t0 + F.coalesce(2 * rest / F.nullif(under, F.lit(0.0)), F.lit(0.0)))
        out = F.when(fraction * whole <= before + area, t) if out is None else out.when(fraction * whole <= before + area, t)
        before += area
    return out.otherwise(F.lit(float(knots[-1][0])))


def targets(totals: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """From (source, source_size): rank, weight and target of each source, by water-filling.

    Sources share the sum of all sizes by weight; what a source can't take, as most copies of it don't
    reach its share, is shared again among the others. In the order of most * size / weight the full
    ones come first, so running sums find them. The table has one row a source. Sources of size 0 get 0.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    wide = T.DecimalType(38, 0)
    d = lambda c: F.col(c).cast(wide)
    order = W.orderBy(F.col("ratio"), F.col("rank"))
    t = (
        totals.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("whole", F.sum("source_size").over(W.partitionBy()))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("full", d("cap") * d("weight_left") <= d("weight") * (d("whole") - d("full_before")))
    )
    open_ = F.col("full") == F.lit(False)
    every = W.partitionBy()
    t = t.withColumn("left", F.col("whole") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
    t = t.withColumn("open_weight", F.sum(F.when(open_, F.col("weight"))).over(every))
    share = (d("weight") * d("left")).cast("double") / F.col("open_weight").cast("double")
    return t.select("source", "source_size", "rank", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, scratch: Scratch, carry: tuple = (), weights=WEIGHTS, most: int = 3, schedules=SCHEDULES, seed: str = "mix-1", rows_a_bucket: int = 20_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, start (where it begins in its source's stream), position, and the columns to carry.

    docs: doc_id, text, source; other columns are ignored unless carried. Size is the number of words
    (null or empty text: 0). taken is between 0 and most * size; the sum of a source's taken words is the
    floor of its target. position is that of the first copy, null where none is taken. Rows that repeat a doc_id
    are separate documents with tied order, in which they swap places without effect on the rows returned.
    An empty table gives an empty result.
    """
    buckets = 1 << max(8, math.ceil(math.log2(max(1, docs.count() / rows_a_bucket))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("h"), *carry)
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - int(math.log2(buckets))).cast("int"))
    sums = scratch.write(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("offset"))
    g = goal.withColumnRenamed("source", "gs")
    places = s.join(g, F.col("s").eqNullSafe(F.col("gs"))).drop("gs")
    run = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("until", F.sum("size").over(run))
    rows = rows.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.floor("target")
    size = F.nullif(F.col("source_size"), F.lit(0))
    rows = rows.withColumn("start", F.col("offset") + F.col("until") - F.col("size"))
    base, rem = F.coalesce(F.floor(whole / size), F.lit(0)), F.coalesce(whole % size, F.lit(0))
    rows = rows.withColumn("taken", (base * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rem - F.col("start")))).cast("long"))
    return rows.withColumn("position", F.when(F.col("taken") > 0, _position(F.col("start"), schedules))).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "start", "position", "rank", *carry
    )


def _position(start: Column, schedules) -> Column:
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        out = F.when(F.col("rank") % len(schedules) == k, invert(knots, F.least(F.lit(1.0), start / F.col("target")))).otherwise(out)
    return out


def first_words(n: Column, text: Column) -> Column:
    """text up to the end of its n-th word (n at least 1)."""

    @F.pandas_udf("string")
    def cut(k, t):
        import re

        word = re.compile(WORD)

        def one(n, s):
            end = 0
            for i, m in enumerate(word.finditer(s)):
                if i >= n:
                    break
                end = m.end()
            return s[:end]

        return t.combine(k, lambda s, n: one(int(n), s))

    return cut(n, text)


def mixed_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents as trained on: each taken copy is a row of the columns of docs, the copy at the target's end cut after its
    last word, all range-sorted by position.

    Documents without words are never taken. Other columns are carried along, whatever their names. An empty table gives an empty result.
    """
    cols = docs.columns
    schedules = options.get("schedules", SCHEDULES)
    plan = mix(docs.withColumn("_row", F.struct(*cols)).select("doc_id", "text", "source", "_row"), scratch, carry=("_row",), **options).filter("taken > 0")
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    n = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    at = _position(F.col("start") + F.col("copy") * F.col("source_size"), schedules)
    copies = copies.select("size", "_row", n.alias("_n"), at.alias("_at"))
    row = [F.col(f"_row.`{c}`").alias(c) for c in cols]
    place = F.struct(F.col("_at").alias("at"), F.col("_row.doc_id").alias("id"))
    whole = copies.filter("_n = size").select(place.alias("_place"), *row)
    cut = first_words(F.col("_n"), F.col("_row.text"))
    part = copies.filter("_n < size").select(place.alias("_place"), *[cut.alias(c) if c == "text" else x for c, x in zip(cols, row, strict=True)])
    if "n_chars" in cols:
        part = part.withColumn("n_chars", F.length("text").cast("long"))
    return whole.unionByName(part).orderBy("_place.at", "_place.id").select(*cols)
