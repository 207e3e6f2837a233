"""Where a value was said: as-of alignment of values with the recent turns of their conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.session import settled


def apart(text: Column) -> Column:
    """Lower-case text between spaces, with a space for each character that is in no word: places stay, but for the space before."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_-]", " "), F.lit(" "))


def said_in(values: DataFrame, turns: DataFrame, key: str, recent: int = 4) -> DataFrame:
    """The values with n_turns, status, turn, start, end: the only one of the last `recent` turns, up to the value's own, that says the value as whole words.

    values: key, at (a turn), value and what else; turns: key, turn, text, one row a turn. Status is found, ambiguous (several turns) or missing; without
    the only turn turn, start and end are null. Start and end are those of its first mention there, in code points from 0, the end exclusive.
    Turns are numbered, so that a value meets at most `recent` rows by an equality of key and number, however long a conversation is. A null or empty value is missing.
    """
    numbered = turns.select(key, "turn", "text").withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("turn")))
    rows = settled(values.withColumn("_row", F.monotonically_increasing_id()))  # values may repeat; written, so that the numbers stay
    until = rows.select(key, "at", "_row").join(numbered.select(key, F.col("turn").alias("at"), "_n"), [key, "at"])
    wanted = until.select("_row", key, F.explode(F.sequence(F.greatest(F.lit(1), F.col("_n") - recent + 1), "_n")).alias("_n"))
    what = F.concat(F.lit(" "), F.trim(apart(F.col("value"))), F.lit(" "))
    near = wanted.join(numbered, [key, "_n"]).join(rows.select("_row", what.alias("_what")), "_row")
    hit = near.withColumn("_p", F.when(F.length("_what") > 2, F.instr(apart(F.col("text")), F.col("_what"))).otherwise(0)).filter("_p > 0")
    hits = hit.groupBy("_row").agg(F.count("*").alias("n_turns"), F.min("turn").alias("turn"), (F.min("_p") - 1).alias("start"), (F.min("_p") - 1 + F.min(F.length("_what") - 2)).alias("end"))
    out = rows.join(hits, "_row", "left").drop("_row").withColumn("n_turns", F.coalesce("n_turns", F.lit(0)).cast("long"))
    only = F.col("n_turns") == 1
    status = F.when(only, "found").when(F.col("n_turns") > 1, "ambiguous").otherwise("missing")
    return out.withColumn("status", status).withColumns({c: F.when(only, F.col(c)) for c in ("turn", "start", "end")})
