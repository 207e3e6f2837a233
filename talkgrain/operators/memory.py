"""Long-term memory of conversations: chunks of messages, recall, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.functions import text as tx
from talkgrain.operators.nearest import candidates

CHUNK = 8
#: Markup that no remembered text may hold.
RESERVED = ("<tool_call", "</tool_call", "<function", "</function", "<|", "|>", "[INST]", "[/INST]", "<system", "</system")
FILLERS = ("tool_filler", "system_filler", "greeting")


def free_of_markup(text):
    return ~F.coalesce(F.lower(text).rlike("|".join("\\Q" + m.lower() + "\\E" for m in RESERVED)), F.lit(False))


def remembered(messages: DataFrame) -> DataFrame:
    """What is worth keeping: text without reserved markup; assistant text that isn't filler."""
    return messages.filter(free_of_markup(F.col("text")) & ((F.col("role") != "assistant") | ~F.coalesce("source", F.lit("")).isin(*FILLERS)))


def chunks(messages: DataFrame, key: str, order: str, names: dict[str, str], size: int = CHUNK, chars: int = 1200) -> DataFrame:
    """key, chunk, start, end, text: each complete run of `size` messages whose last is the assistant's. names: role to speaker."""
    m = messages.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order)))
    m = m.withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long"))
    who = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    line = F.concat(F.coalesce(who[F.col("role")], F.col("role")), F.lit(": "), F.coalesce("text", F.lit("")))
    g = m.groupBy(key, "chunk").agg(
        F.count("*").alias("_c"), F.min(order).alias("start"), F.max(order).alias("end"), F.max_by("role", order).alias("_last"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_l")
    )
    text = F.substring(F.array_join(F.transform("_l", lambda s: s["l"]), "\n"), 1, chars)
    return g.filter((F.col("_c") == size) & (F.col("_last") == "assistant")).select(key, "chunk", "start", "end", text.alias("text"))


def recall(probes: DataFrame, chunks_: DataFrame, n: int = 5, least: float = 0.72) -> DataFrame:
    """Of each probe's n nearest chunks (not of its own conversation) those above the floor, without their vectors. The floor comes after the limit.

    A user's chunks and probes are dealt into tiles, so one user's very many chunks are no single task's.
    """
    query, unit = F.struct(*[c for c in probes.columns if c != "probe"]), F.struct(*[c for c in chunks_.columns if c != "embedding"])
    asked = probes.filter("probe_conv is not null").select(F.col("probe_user").alias("key"), query.alias("query"), F.col("probe").alias("vector"), F.col("probe_conv").cast("string").alias("own"))
    held = chunks_.filter("conv_id is not null").select(F.col("user").alias("key"), unit.alias("unit"), F.struct("conv_id", "chunk").alias("order"), F.col("embedding").alias("vector"), F.col("conv_id").cast("string").alias("own"))
    j = candidates(asked, held, n).select("query.*", "unit.*", "similarity")
    nth = F.row_number().over(W.partitionBy("probe_conv").orderBy(F.col("similarity").desc(), "conv_id", "chunk"))
    return j.withColumn("pos", nth).filter((F.col("pos") <= n)).filter(F.col("similarity") >= least)


def active_facts(facts: DataFrame, single_valued: list[str]) -> DataFrame:
    """The facts that hold now. facts: user, type, key, value, op (set, remove), seq.

    Of equal values (case apart) the last event decides; a key with one value only has its last.
    """
    value = F.lower(F.trim("value"))
    last = F.row_number().over(W.partitionBy("user", "type", "key", value).orderBy(F.col("seq").desc()))
    held = facts.withColumn("_n", last).filter("_n = 1 and op = 'set'").drop("_n")
    newest = F.row_number().over(W.partitionBy("user", "type", "key").orderBy(F.col("seq").desc()))
    return held.withColumn("_n", newest).filter((F.col("_n") == 1) | ~F.col("key").isin(*single_valued)).drop("_n")


def profile(facts: DataFrame, chars: int = 2000) -> DataFrame:
    """One text a user: `type.key: value` lines in order."""
    line = F.concat_ws("", "type", F.lit("."), "key", F.lit(": "), "value")
    g = facts.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("type", "key", "seq", line.alias("l")))).alias("x"))
    return g.select("user", F.substring(F.array_join(F.transform("x", lambda s: s["l"]), "\n"), 1, chars).alias("profile"))


def prior_conversation(conversations: DataFrame, key: str, user: str, order: str) -> DataFrame:
    """Adds prior, the user's conversation before each."""
    return conversations.withColumn("prior", F.lag(key).over(W.partitionBy(user).orderBy(order, key)))


def last_lines(messages: DataFrame, key: str, order: str, n: int = 8, line_chars: int = 180, chars: int = 1200) -> DataFrame:
    """key, lines: the last n messages, each cut, joined by bars, oldest first."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    last = messages.withColumn("_n", nth).filter(F.col("_n") <= n)
    line = F.concat_ws(": ", "role", F.substring(tx.collapse(F.col("text")), 1, line_chars))
    g = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return g.select(key, F.substring(F.array_join(F.transform("x", lambda s: s["l"]), " | "), 1, chars).alias("lines"))


def with_live_source(memories: DataFrame, transcripts: DataFrame, calls: DataFrame, ended) -> DataFrame:
    """Memories without a source, and those whose transcript's call exists, isn't deleted and has `ended`.

    What is told of a transcript is found first, so that memories are joined once; those that name no transcript aren't dealt by their null.
    """
    told = transcripts.join(calls, "call_id", "left").withColumn("_live", F.coalesce(~F.col("deleted"), F.lit(False)) & ended)
    named = memories.filter("transcript_id is not null").join(told, "transcript_id", "left").filter(F.col("t").isNull() | F.col("_live")).drop("_live")
    return named.unionByName(memories.filter("transcript_id is null"), allowMissingColumns=True)


def cascade(turns: DataFrame, prior: DataFrame, chunks_: DataFrame, key: str, chars: int = 3000) -> DataFrame:
    """Adds source (prior, chunk or none) and context. turns: key, immediate, recall; prior: key, prior; chunks_: key, chunk, one row a key each.

    A turn that refers to the call just before reads it; others read the recalled chunk, or for want of one, if they ask to recall, the call before.
    """
    j = turns.join(prior, key, "left").join(chunks_, key, "left")
    has = F.col("prior").isNotNull()
    source = F.when(F.col("immediate") & has, "prior").when(F.col("chunk").isNotNull(), "chunk").when(F.col("recall") & has, "prior").otherwise("none")
    context = F.when(source == "prior", F.col("prior")).when(source == "chunk", F.col("chunk"))
    return j.withColumn("source", source).withColumn("context", F.substring(context, 1, chars))


def dispatched(messages: DataFrame) -> DataFrame:
    """What each stored message sets off: facts of a user's, chunks of an assistant's."""
    return messages.withColumn("job", F.when(F.col("role") == "user", "facts").when(F.col("role") == "assistant", "chunks")).filter("job is not null")


def marked(messages: DataFrame, key: str, order: str, marker: str) -> DataFrame:
    """key, summary: of the first user message that opens with the marker what follows it."""
    m = messages.filter((F.col("role") == "user") & F.col("text").startswith(marker))
    return m.groupBy(key).agg(F.min_by(F.trim(F.substring("text", len(marker) + 1, 1_000_000_000)), order).alias("summary"))


def within_budget(messages: DataFrame, key: str, order: str, chars: int, lead: str = "developer", told: int = 24) -> DataFrame:
    """The rows (key, order, role, content) that a budget of characters holds for each key: those of the leading role first, then the newest others.

    Of rows that say the same, case and white space apart, the first in that order counts; a row of `told` characters or more that the leading rows say
    already goes, as do empty ones. The row that crosses the budget is cut. Rows are numbered from both ends by running lengths, so no key's rows are
    gathered in a list.
    """
    squeezed = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    m = messages.select(key, order, "role", "content").withColumn("_norm", squeezed(F.col("content"))).filter("_norm <> ''").withColumn("_lead", F.coalesce(F.col("role") == lead, F.lit(False)))
    place = [F.when(F.col("_lead"), F.col(order)).asc(), F.col(order).desc(), F.col("content")]
    once = m.withColumn("_nth", F.row_number().over(W.partitionBy(key, "_norm").orderBy(F.col("_lead").desc(), *place))).filter("_nth = 1").drop("_nth")
    length = F.length("content")

    def cut(rows: DataFrame, by: list, used) -> DataFrame:
        before = F.sum(length).over(W.partitionBy(key).orderBy(*by, "content").rowsBetween(W.unboundedPreceding, 0)) - length + used
        return rows.withColumn("_before", before).filter(F.col("_before") < chars).withColumn("content", F.left("content", (chars - F.col("_before")).cast("int")))

    first = cut(once.filter("_lead"), [F.col(order).asc()], F.lit(0)).select(key, order, "role", "content")
    said = first.groupBy(key).agg(F.sum(length).alias("_used"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda s: squeezed(s["content"])), " ").alias("_said"))
    rest = once.filter("not _lead").join(said, key, "left").filter(~((F.length("_norm") >= told) & F.contains(F.coalesce("_said", F.lit("")), F.col("_norm"))))
    return first.unionByName(cut(rest, [F.col(order).desc()], F.coalesce("_used", F.lit(0))).select(key, order, "role", "content"))
