"""Hybrid retrieval: a lexical and a dense arm per query, fused, deduplicated, cut by confidence. Any number of queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.functions import scoring as sc
from talkgrain.functions import text as tx
from talkgrain.operators.matches import matches
from talkgrain.operators.nearest import candidates
from talkgrain.operators.text_index import TextIndex
from talkgrain.session import settled

CANDIDATES = 30
#: Bits of what `mostly_among` tells all tasks, 2 MB.
MARKS = 1 << 24


def _top(rows: DataFrame, query: str, order: list[Column], n: int, position: str) -> DataFrame:
    """The first n rows of each query. Spark cuts each task's rows to n a query before the shuffle (window group limit)."""
    return rows.withColumn(position, F.row_number().over(W.partitionBy(query).orderBy(*order))).filter(F.col(position) <= n)


def mostly_among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids(key) and, by a bit for each hash, a small part of the others, so that few rows go into the join that follows."""
    h = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(MARKS))
    word, bit = F.shiftright(h, 6), F.pmod(h, F.lit(64)).cast("int")
    marks = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return rows.join(F.broadcast(marks), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")


def postings(units: DataFrame, unit_id: str, text: Column) -> DataFrame:
    """unit_id, term, tf: the inverted index of the units."""
    t = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(tx.TERM), F.lit(0))
    return units.select(unit_id, F.explode(t).alias("term")).groupBy(unit_id, "term").agg(F.count("*").alias("tf"))


def lexical(queries: DataFrame, units: DataFrame, query_id: str, query: Column, unit_id: str, text: Column, n: int = CANDIDATES, tie: list[Column] | None = None, index: TextIndex | None = None) -> DataFrame:
    """query_id, unit_id, rank, lex_pos: the units with any of a query's telling terms, by matching occurrences.

    Only postings of the queries' terms count, summed by tiles (`matches`). With an index of the units their texts aren't read. With ties all matches leave their tile.
    """
    q = queries.select(F.col(query_id).alias("query"), F.explode(tx.telling_terms(query)).alias("term"))
    wanted = q.select("term").distinct()
    if index is None:
        p = postings(units, unit_id, text).join(wanted, "term", "left_semi")
        p = p.select(F.xxhash64(unit_id).alias("block"), "term", F.array(unit_id).alias("units"), F.array("tf").alias("tfs"))
    else:
        p = index.blocks(wanted)
    scored = matches(q, p, None if tie else n).select(F.col("query").alias(query_id), F.col("unit").alias(unit_id), sc.lexical_rank(F.col("matched")).alias("rank"))
    if tie:
        scored = scored.join(units.select(unit_id, *[t.alias(f"_tie{i}") for i, t in enumerate(tie)]), unit_id)
    order = [F.col("rank").desc(), *[F.col(f"_tie{i}") for i in range(len(tie or []))], F.col(unit_id)]
    return _top(scored, query_id, order, n, "lex_pos").select(query_id, unit_id, "rank", "lex_pos")


def dense(probes: DataFrame, vectors: DataFrame, query_id: str, unit_id: str, n: int = CANDIDATES) -> DataFrame:
    """query_id, unit_id, similarity, dense_pos: exact nearest vectors of each probe by cosine.

    probes: a stated set of query vectors (query_id, probe). Tiles of probes meet tiles of vectors, and each such task passes on about n a probe. Probes of a
    length that no vector has, null and zero ones find nothing, and such vectors aren't found.
    """
    few = probes.select(F.lit(0).alias("key"), F.struct(query_id).alias("query"), F.col("probe").alias("vector"))
    every = vectors.select(F.lit(0).alias("key"), F.struct(unit_id).alias("unit"), F.struct(unit_id).alias("order"), F.col("embedding").alias("vector"))
    near = candidates(few, every, n, slack=2e-9, clamp=True).select(f"query.{query_id}", f"unit.{unit_id}", "similarity").withColumn("_key", F.round("similarity", 9))
    return _top(near, query_id, [F.col("_key").desc(), F.col(unit_id)], n, "dense_pos").select(query_id, unit_id, "similarity", "dense_pos")


def fuse(lex: DataFrame, vec: DataFrame, queries: DataFrame, units: DataFrame, query_id: str, unit_id: str) -> DataFrame:
    """The candidates of both arms: what is said (a digest of the answer), score and what matched.

    queries: query_id, query, aliases (array, may be null); units: unit_id, body (all searched fields), identity (the curated ones),
    retrieval_text, product, answer, authority.
    """
    both = settled(lex.join(vec, [query_id, unit_id], "full"))  # both arms are searched once
    # Terms are taken once a query, and once a unit that is any query's candidate; texts stay behind, for ranked() needs but a digest of the answer.
    q = queries.select(query_id, "aliases", tx.terms(F.col("query")).alias("_terms"), tx.telling_terms(F.col("query")).alias("_telling"))
    u = mostly_among(units, both, unit_id).select(
        unit_id, tx.terms(F.col("body")).alias("_body"), tx.terms(F.col("identity")).alias("_identity"), F.lower("retrieval_text").alias("_searched"),
        F.lower(F.coalesce("product", F.lit(""))).alias("_product"), F.md5(tx.squeezed(F.col("answer"))).alias("said"), "authority",
    )
    j = both.join(q, query_id).join(u, unit_id)
    overlap, field = sc.share(F.col("_terms"), F.col("_body")), sc.share(F.col("_telling"), F.col("_identity"))
    named = lambda a: F.contains("_searched", F.lower(a)) | (F.lower(a) == F.col("_product"))
    alias = F.coalesce(F.exists("aliases", named), F.lit(False))
    score = sc.fused(F.col("similarity"), F.col("rank"), overlap, field, sc.rrf(F.col("lex_pos"), F.col("dense_pos")), alias, F.col("authority"))
    by = F.array_compact(F.array(F.when(F.col("lex_pos").isNotNull(), "lexical"), F.when(F.col("dense_pos").isNotNull(), "dense"), F.when(alias, "alias")))
    return j.select(query_id, unit_id, "said", score.alias("score"), by.alias("matched_by"))


def ranked(scored: DataFrame, query_id: str, unit_id: str, top_k: int = 5) -> DataFrame:
    """The best top_k (1 to 10) distinct answers of each query; of equal answers (by `said`, fuse's digest) the best unit."""
    order = [F.col("score").desc(), F.size("matched_by").desc(), F.col(unit_id)]
    once = scored.withColumn("_nth", F.row_number().over(W.partitionBy(query_id, "said").orderBy(*order))).filter("_nth = 1").drop("_nth")
    return _top(once, query_id, order, max(1, min(top_k, 10)), "pos")


def of_type(hits: DataFrame, kind: str, metadata: Column) -> DataFrame:
    """Hits that can answer a quantity (flagged, or with a number) or a comparison (flagged); all hits for a fact."""
    flag = lambda name: F.coalesce(metadata[name] == F.lit(True), F.lit(False))
    if kind == "quantity":
        return hits.filter(flag("answers_quantity") | F.col("answer").rlike(r"(^|[^\p{L}\p{N}_])[0-9]+([.,][0-9]+)?($|[^\p{L}\p{N}_])"))
    return hits.filter(flag("answers_comparison")) if kind == "comparison" else hits


def decide(queries: DataFrame, hits: DataFrame, query_id: str, least: float = sc.MIN_CONFIDENCE) -> DataFrame:
    """query_id, status, confidence, reason: ok if the best hit reaches the confidence."""
    best = hits.groupBy(query_id).agg(F.max("score").alias("confidence"))
    c = F.coalesce("confidence", F.lit(0.0))
    ok = c >= least
    return queries.select(query_id).join(best, query_id, "left").select(
        query_id, F.when(ok, "ok").otherwise("no_answer").alias("status"), c.alias("confidence"), F.when(~ok, "below_confidence_threshold").alias("reason")
    )


def tickets(descriptions: DataFrame, entries: DataFrame, query_id: str, text: Column, entry_id: str, code: Column, subcode: Column, remark: Column, n: int = 5) -> DataFrame:
    """query_id, entry_id, score, pos: the taxonomy entries that share terms with a description, best first.

    Joined on shared terms, not crossed: an entry without a common term has score 0 and is none. Entries of equal terms score alike, so they are one class in the join, as are
    descriptions of equal terms. No more than the n smallest entries of a class can be among the n best, nor any of a class that n others precede by score and smallest entry.
    """
    n, kind = max(1, min(n, 10)), ["c", "s", "r"]
    d = descriptions.select(query_id, F.array_sort(tx.ascii_terms(text)).alias("q"))
    e = entries.select(entry_id, *[F.array_sort(tx.ascii_terms(t)).alias(k) for k, t in zip(kind, (code, subcode, remark), strict=True)])
    first = F.row_number().over(W.partitionBy(*kind).orderBy(entry_id))
    kept = e.withColumn("_nth", first).filter(F.col("_nth") <= n)
    classes = kept.filter("_nth = 1").withColumnRenamed(entry_id, "_first").withColumn("_all", F.array_distinct(F.concat(*kind))).drop("_nth")
    asked = d.select("q").distinct().select("q", F.explode("q").alias("term"))
    pairs = asked.join(classes.withColumn("term", F.explode("_all")).hint("merge"), "term")
    pairs = pairs.filter(F.get(F.array_intersect("q", "_all"), F.lit(0)) == F.col("term"))  # once, by the first term that they share
    scored = pairs.withColumn("score", sc.ticket_score(F.col("q"), *map(F.col, kind))).filter("score > 0").select("q", *kind, "score", "_first")
    best = _top(scored, "q", [F.col("score").desc(), F.col("_first")], n, "_class").select("q", *kind, "score")
    order = [F.col("score").desc(), F.col(entry_id)]
    of_class = _top(best.join(kept.drop("_nth"), kind), "q", order, n, "_pos").select("q", entry_id, "score")
    return _top(d.join(of_class, "q"), query_id, order, n, "pos").select(query_id, entry_id, "score", "pos")


def evaluate(first_rank: DataFrame, k: int) -> DataFrame:
    """n, recall_at_k, mrr over cases(case_id, rank: null if nothing expected was found). Null where there is no case."""
    r = F.col("rank")
    n = F.nullif(F.count("*"), F.lit(0))
    return first_rank.agg(F.count("*").alias("n"), (F.count_if(r <= k) / n).alias("recall_at_k"), (F.sum(F.coalesce(1.0 / r, F.lit(0.0))) / n).alias("mrr"))


def report(cases: DataFrame, share: float = 0.95) -> DataFrame:
    """One row over cases(expected_status, status, expects: whether a hit is expected, rank: of the first expected hit, mode, latency_ms).

    status_accuracy, recall, mrr and no_answer_accuracy are null where no case counts for them; p95 is the latency of the nearest rank, half to even; modes
    has `mode=cases`, sorted; failures are cases of another status, or without the hit expected.
    """
    right, asked, silent = F.col("expected_status") == F.col("status"), F.col("expects"), F.col("expected_status") == "no_answer"
    part = lambda hit, of: F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0))
    n = F.count("*")
    ordered = F.array_sort(F.collect_list("latency_ms"))
    figures = cases.agg(
        n.alias("cases"),
        part(right, F.lit(True)).alias("status_accuracy"),
        part(F.col("rank").isNotNull(), asked).alias("recall"),
        (F.sum(F.when(asked, F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))) / F.nullif(F.count_if(asked), F.lit(0))).alias("mrr"),
        part(F.col("status") != "ok", silent).alias("no_answer_accuracy"),
        F.median("latency_ms").alias("p50_ms"),
        F.get(ordered, F.bround((F.size(ordered) - 1) * F.lit(share)).cast("int")).alias("p95_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.count_if(~right | (asked & F.col("rank").isNull())).alias("failures"),
    )
    modes = cases.groupBy("mode").agg(F.count("*").alias("c")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "mode", "c"))), ",").alias("modes"))
    return figures.join(F.broadcast(modes), F.lit(True), "left")
