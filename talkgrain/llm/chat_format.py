"""Chat formatting: collapse logged snapshots of growing conversations, then render what is left.

DataFrame functions only. A conversation's turns are ordered by (turn, role, text). The rolling
hash of a turn prefix is the running XOR of two position-tagged 64-bit hashes, so equal prefixes have
equal 128-bit hashes and no array of turns is built to compute them. A conversation whose whole hash
equals a proper prefix hash of another is dropped by an anti-join; of equal ones the smallest
conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds pos (1, 2, ...), h1 and h2 (of the prefix that ends there) and n (turns of the conversation)."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn"), F.col("role"), F.col("text"))
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("conv_id")
    out = turns.withColumn("pos", F.row_number().over(order))
    return (
        out.withColumn("h1", F.bit_xor(_hash(1, F.col("pos"), F.col("role"), F.col("text"))).over(running))
        .withColumn("h2", F.bit_xor(_hash(2, F.col("pos"), F.col("role"), F.col("text"))).over(running))
        .withColumn("n", F.count("*").over(whole))
    )


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, n) of the maximal conversations.

    conversations: conv_id, turn, role, text; other columns are ignored. Rows without conv_id are
    dropped; a null turn sorts first, a null role is 'user', a null text is empty. Turns that repeat an
    equal (conv_id, turn, role, text) count once. Of conversations with equal turns the smallest
    conv_id is kept. An empty table gives an empty result.
    """
    hashed = prefix_hashes(_clean(conversations)).select("conv_id", "pos", "n", "h1", "h2")
    ends = hashed.filter("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = hashed.filter("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", "n")


def _clean(conversations: DataFrame) -> DataFrame:
    return (
        conversations.filter("conv_id is not null")
        .select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
    )


def render(turns: DataFrame, opening: str = OPEN, middle: str = MIDDLE, closing: str = CLOSE) -> DataFrame:
    """conv_id, n_turns, rendered: the turns in order, each as opening, role, middle, text, closing.

    A text that holds the opening or closing marker has it broken by a space after '<', so that no turn can
    forge another's boundary.
    """
    safe = lambda c: F.replace(F.replace(c, F.lit(opening), F.lit(opening[:1] + " " + opening[1:])), F.lit(closing.rstrip("\n")), F.lit(closing[:1] + " " + closing.rstrip("\n")[1:]))
    one = lambda t: F.concat(F.lit(opening), safe(t["role"]), F.lit(middle), safe(t["text"]), F.lit(closing))
    return (
        _clean(turns)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
        .select(
            "conv_id",
            F.size("t").cast("long").alias("n_turns"),
            F.array_join(F.transform(F.concat(F.filter("t", lambda x: x["turn"].isNull()), F.filter("t", lambda x: x["turn"].isNotNull())), one), "").alias("rendered"),
        )
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, rendered. See collapse_snapshots and render."""
    kept = collapse_snapshots(conversations).select("conv_id")
    return render(conversations.join(kept, "conv_id", "left_semi"))
