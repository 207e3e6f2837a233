"""The corpus of knowledge units: duplicates, contradictions, audit, releases."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.functions import text as tx
from talkgrain.functions.simhash import BITS, hamming, simhashes
from talkgrain.session import settled

#: Fixed values.
UNIT_TYPES = (
    "faq", "procedure", "troubleshooting", "product_spec", "policy", "definition", "error_code",
    "escalation_rule", "contact_information", "ticket_taxonomy", "developer_reference",
)


def preference(uri: Column, key: Column) -> list[Column]:
    """Sort order of equal answers: support pages first, then short plain addresses."""
    path = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return [
        F.when(F.regexp_replace(path, "/+$", "") == "/support", 0).otherwise(1),
        F.contains(uri, F.lit("?")),
        F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        F.length(uri),
        key,
    ]


def keep_best(units: DataFrame, answer: str, approved: Column, order: list[Column]) -> DataFrame:
    """hash, kept_id, n for each answer (white space and case apart): an approved unit before all others, then by order.

    The best is a minimum of a struct: map tasks send one row for each answer, so a very frequent answer is no hot spot.
    """
    rank = F.struct((~approved).alias("o"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    return units.groupBy(tx.answer_fingerprint(F.col(answer)).alias("hash")).agg(F.min_by("unit_id", rank).alias("kept_id"), F.count("*").alias("n"))


def _hashed(units: DataFrame, least_tokens: int) -> DataFrame:
    """unit_id, unit_type, hash, tokens of the units that are long enough."""
    return simhashes(units, ["unit_id", "unit_type"], "answer").filter(F.col("tokens") >= least_tokens)


def near_pairs(units: DataFrame, radius: int = 2, least_tokens: int = 12, ratio: float = 0.9) -> DataFrame:
    """left_id, right_id, dist: units of one type whose SimHash differs in at most `radius` bits.

    Of radius + 3 blocks of the bits any two hashes within the radius agree in three at least (pigeonhole), so only hashes that agree in three blocks
    are joined: 38 bits at a radius of 2. Beyond a radius of 6 that would be too many threes; there one of radius + 1 blocks must agree. Equal hashes are collapsed first and only their smallest unit stands for them, as copies would
    pair quadratically; near_members has the others.
    """
    return _pairs(_hashed(units, least_tokens), radius, ratio)


def _pairs(h: DataFrame, radius: int, ratio: float) -> DataFrame:
    h = h.groupBy("unit_type", "hash", "tokens").agg(F.min("unit_id").alias("unit_id"))
    agree = 3 if radius <= 6 else 1
    blocks = radius + agree
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    masks = [sum((1 << b) - (1 << a) for a, b in some) for some in combinations(list(zip(edges, edges[1:], strict=False)), agree)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.col("hash").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])
    b = h.withColumn("part", F.explode(parts))
    left, right = b.alias("l"), b.alias("r")
    same = (F.col("l.unit_type") == F.col("r.unit_type")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.unit_id") < F.col("r.unit_id"))
    d = hamming(F.col("l.hash"), F.col("r.hash"))
    close = (d <= radius) & (F.least("l.tokens", "r.tokens") >= ratio * F.greatest("l.tokens", "r.tokens"))
    # Merged, as Spark takes the tenfold rows for no larger than the hashes' file and would send them to the driver and on to every task.
    return left.join(right.hint("merge"), same & close).select(F.col("l.unit_id").alias("left_id"), F.col("r.unit_id").alias("right_id"), d.alias("dist")).distinct()


def near_members(units: DataFrame, least_tokens: int = 12) -> DataFrame:
    """left_id, right_id, dist: the unit that near_pairs compares for each unit that it collapses, at a distance of 0.

    With near_pairs these are all near duplicates: two units are near if their representatives are the same or a pair.
    One row for each collapsed unit, however large its group. Null types are no type, as in near_pairs.
    """
    return _members(_hashed(units, least_tokens))


def near_duplicates(units: DataFrame, radius: int = 2, least_tokens: int = 12, ratio: float = 0.9) -> DataFrame:
    """near_pairs and near_members in one, of hashes taken once."""
    h = settled(_hashed(units, least_tokens))
    return _pairs(h, radius, ratio).unionByName(_members(h))


def _members(h: DataFrame) -> DataFrame:
    key = ["unit_type", "hash", "tokens"]
    h = h.filter(F.col("unit_type").isNotNull())
    low = h.groupBy(*key).agg(F.min("unit_id").alias("left_id"), F.max("unit_id").alias("_last")).filter("left_id < _last").drop("_last")
    return h.join(low.hint("merge"), key).filter("unit_id > left_id").select("left_id", F.col("unit_id").alias("right_id"), F.lit(0).alias("dist")).distinct()


def greedy_clusters(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """left_id absorbs right_id unless it was absorbed itself, in the order of ids: (member, keeper).

    A unit is a keeper if none of its smaller partners is one. Settled in rounds: each fixes the units all of whose smaller
    partners are settled; chains of near pairs are short, so there are few rounds. An error if a round settles none (pairs in a circle).
    All joins are merges: a round's states look small in their files, and would be sent to the driver whole.
    """
    edges = pairs.select(F.col(left).alias("a"), F.col(right).alias("b"))
    nodes = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    state = nodes.withColumn("keeper", F.lit(None).cast("boolean"))
    left_open = None
    while True:
        smaller = edges.join(state.withColumnRenamed("v", "a").hint("merge"), "a").groupBy("b").agg(
            F.bool_or(F.coalesce("keeper", F.lit(False))).alias("absorbed"), F.bool_or(F.col("keeper").isNull()).alias("open")
        )
        nxt = state.join(smaller.hint("merge"), F.col("v") == F.col("b"), "left").select(
            "v", F.when(F.coalesce("absorbed", F.lit(False)), False).when(F.coalesce("open", F.lit(False)), F.lit(None)).otherwise(True).alias("keeper")
        )
        state = settled(nxt)
        was, left_open = left_open, state.filter("keeper is null").count()
        if not left_open:
            break
        if was == left_open:
            raise RuntimeError("clusters did not settle")
    keepers = state.filter("keeper").select(F.col("v").alias("a"))
    return edges.join(keepers.hint("merge"), "a", "left_semi").groupBy(F.col("b").alias("member")).agg(F.min("a").alias("keeper"))


def contradictions(units: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """left_id, right_id of units on one subject, from different documents, whose answers differ.

    units: unit_id, subject, product, topic, unit_type, document_id, content_hash, answer. An equi-join on the
    subject's key; units without a subject are left out, as are pairs in `known`.
    """
    key = [tx.normalized_subject(F.col(c)) for c in ("subject", "product", "topic")]
    u = units.select("unit_id", "unit_type", "document_id", "content_hash", *[k.alias(f"k{i}") for i, k in enumerate(key)], tx.normalized_subject(F.col("answer")).alias("said"))
    u = u.filter("k0 <> ''")
    left, right = u.alias("l"), u.alias("r")
    same = (F.col("l.unit_id") < F.col("r.unit_id")) & (F.col("l.unit_type") == F.col("r.unit_type"))
    for i in range(3):
        same = same & (F.col(f"l.k{i}") == F.col(f"r.k{i}"))
    apart = ~F.coalesce(F.col("l.document_id") == F.col("r.document_id"), F.lit(False))
    differ = (F.col("l.content_hash") != F.col("r.content_hash")) & (F.col("l.said") != F.col("r.said"))
    out = left.join(right, same & apart & differ).select(F.col("l.unit_id").alias("left_id"), F.col("r.unit_id").alias("right_id"))
    return out if known is None else out.join(known, ["left_id", "right_id"], "left_anti")


def contradiction_counts(units: DataFrame) -> DataFrame:
    """unit_id, subject_id (the smallest unit on its subject), n_conflicts: how many units contradictions() would pair each with.

    Counted from the sizes of groups instead of pairs, so a subject that very many units share costs no more than others: of the units on a subject
    those count that say something else in another document. Units without a subject are left out; units of no document conflict with all others.
    """
    key = [tx.normalized_subject(F.col(c)).alias(f"k{i}") for i, c in enumerate(("subject", "product", "topic"))]
    u = units.select("unit_id", "unit_type", "document_id", *key, F.xxhash64(tx.normalized_subject(F.col("answer"))).alias("said")).filter("k0 <> ''")
    on = ["k0", "k1", "k2", "unit_type"]

    def sizes(name: str, *more: str) -> DataFrame:
        g = u.groupBy(*on, *more).agg(F.count("*").alias(name), *([F.min("unit_id").alias("subject_id")] if not more else []))
        return g.select(*[F.col(c).alias(f"_{c}") for c in (*on, *more)], name, *(["subject_id"] if not more else []))

    out = u
    for name, more in (("all", ()), ("alike", ("said",)), ("near", ("document_id",)), ("both", ("document_id", "said"))):
        g = sizes(name, *more)
        same = F.lit(True)
        for c in (*on, *more):
            same = same & (F.col(c) == F.col(f"_{c}"))
        out = out.join(g, same, "left").drop(*[f"_{c}" for c in (*on, *more)])
    n = F.col("all") - F.col("alike") - F.coalesce("near", F.lit(0)) + F.coalesce("both", F.lit(0))
    return out.filter("all is not null").select("unit_id", "subject_id", n.alias("n_conflicts"))


def corpus_hash(units: DataFrame, key: str = "stable_key", digest: str = "content_hash") -> DataFrame:
    """One row: SHA-256 over all keys and hashes, as a tree over the keys' own hashes.

    Its leaves are the million keys' hash prefixes of five digits, each hashed in key order; 4096 of them make up a branch, 256 branches the root.
    So no task holds more than a leaf's keys or 4096 digests.
    """

    def joined(rows: DataFrame, by, part: str, line: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.col(line).alias("l"))))
        return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["l"]), "\n"), 256).alias("h"))

    name = F.col(key).cast("string")
    lines = units.select(F.substring(F.sha2(name, 256), 1, 5).alias("leaf"), F.concat(name, F.lit("\0"), F.col(digest)).alias("line"))
    leaves = joined(lines, ["leaf"], "line", "line")
    branches = joined(leaves.withColumn("branch", F.substring("leaf", 1, 2)), ["branch"], "leaf", "h")
    return joined(branches, [], "branch", "h").select(F.col("h").alias("corpus_hash"))


def audit(units: DataFrame, answer: str, group: list[str]) -> DataFrame:
    """metric, value: units, distinct answers, exact surplus, empty answers, average length, groups."""
    h = tx.answer_fingerprint(F.col(answer))
    one = units.agg(
        F.count("*").cast("double").alias("units"),
        F.countDistinct(h).cast("double").alias("distinct_answers"),
        (F.count("*") - F.countDistinct(h)).cast("double").alias("exact_surplus"),
        F.count_if(tx.collapse(F.col(answer)) == "").cast("double").alias("empty"),
        F.avg(F.length(F.coalesce(answer, F.lit("")))).alias("avg_chars"),
        F.countDistinct(*group).cast("double").alias("groups"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def invalid(units: DataFrame) -> DataFrame:
    """Units that break a rule, with the rules' names in `problems`."""
    blank = lambda c: tx.collapse(F.col(c)) == ""
    rules = {
        "unit_type": ~F.coalesce(F.col("unit_type").isin(*UNIT_TYPES), F.lit(False)),
        "stable_key": ~F.coalesce(F.col("stable_key").rlike(r"^[a-z0-9][a-z0-9._/-]{2,254}$"), F.lit(False)),
        "required": blank("title") | blank("answer") | blank("retrieval_text"),
        "authority": ~F.coalesce(F.col("authority").between(1, 5), F.lit(False)),
        "dates": F.coalesce(F.col("expires_at") <= F.col("effective_at"), F.lit(False)),
    }
    problems = F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))
    return units.withColumn("problems", problems).filter(F.size("problems") > 0)


def valid_at(units: DataFrame, now: Column) -> DataFrame:
    """Within their half-open validity; a null bound is open."""
    return units.filter((F.col("effective_at").isNull() | (F.col("effective_at") <= now)) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def staged_upsert(current: DataFrame, staged: DataFrame) -> DataFrame:
    """What importing does to each key: action is unchanged, new, in_place or new_version, with the version that results.

    current: stable_key, content_hash, status, version; staged: stable_key, content_hash. Keys' versions are counted over all
    that share a base.
    """
    base = lambda c: tx.version_base(F.col(c))
    top = current.groupBy(base("stable_key").alias("base")).agg(F.max("version").alias("top"))
    c = current.select(F.col("stable_key").alias("ck"), F.col("content_hash").alias("ch"), "status", "version")
    j = staged.join(c, F.col("stable_key") == F.col("ck"), "left").join(top, base("stable_key") == F.col("base"), "left")
    action = F.when(F.col("ck").isNull(), "new").when(F.col("ch") == F.col("content_hash"), "unchanged").when(F.col("status").isin("approved", "retired"), "new_version").otherwise("in_place")
    version = F.when(action == "new_version", F.coalesce("top", "version") + 1).otherwise(F.coalesce("version", F.lit(1)))
    key = F.when(action == "new_version", F.concat(base("stable_key"), F.lit(".v"), version)).otherwise(F.col("stable_key"))
    return j.select("stable_key", action.alias("action"), version.alias("version"), key.alias("result_key"))


def snapshot_sync(current: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Keys of both, active if the new snapshot has them: absent ones become inactive, none is deleted."""
    f = fresh.select(*key).distinct().withColumn("_new", F.lit(True))
    return current.drop("active").join(f, key, "full").withColumn("active", F.coalesce("_new", F.lit(False))).drop("_new")


def publish(releases: DataFrame, version: Column, open_conflicts: DataFrame, release_units: DataFrame) -> DataFrame:
    """Releases with `version` published and the one published before superseded; an error if its units have an open conflict."""
    mine = release_units.filter(F.col("version") == version).select("unit_id")
    bad = open_conflicts.filter("status = 'open'").select(F.explode(F.array("left_id", "right_id")).alias("unit_id")).join(mine, "unit_id", "left_semi")
    if not bad.isEmpty():
        raise ValueError("the release has units with open conflicts")
    status = F.when(F.col("version") == version, "published").when(F.col("status") == "published", "superseded").otherwise(F.col("status"))
    return releases.withColumn("status", status)


def taxonomy_import(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(entries, report) of taxonomy rows with code, subcode, remark, status: the first of each active, complete triple is an entry."""
    r = rows.select(F.trim("code").alias("code"), F.trim("subcode").alias("subcode"), tx.collapse(F.col("remark")).alias("remark"), F.lower(F.trim("status")).alias("status"), order)
    usable = F.coalesce((F.col("status") == "active") & (F.col("code") != "") & (F.col("subcode") != "") & (F.col("remark") != ""), F.lit(False))
    nth = F.row_number().over(W.partitionBy("code", "subcode", "remark", usable).orderBy(order))
    r = r.withColumn("usable", usable).withColumn("nth", nth)
    report = r.agg(
        F.count("*").alias("total"), F.count_if(F.col("usable") & (F.col("nth") == 1)).alias("active"), F.count_if(~F.col("usable")).alias("blocked"), F.count_if(F.col("usable") & (F.col("nth") > 1)).alias("duplicate")
    )
    return r.filter("usable and nth = 1").select("code", "subcode", "remark", tx.content_hash(F.col("code"), F.col("subcode"), F.col("remark")).alias("content_hash")), report
