"""Retrieval queries: benchmark passages searched in documents, with embeddings as their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions import text as tx
from talkgrain.operators import retrieval
from talkgrain.plans.indexes import document_index
from talkgrain.plans.registry import query
from talkgrain.session import settled, table

TERM = r"[\p{L}\p{N}_-]+"

_VECTORS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT p.vec_id AS {q}, v.vec_id AS {u}, greatest(0, least(1, list_cosine_similarity(v.e, p.e))) AS similarity FROM v, v p WHERE {n})"""


@query(f"WITH {_VECTORS.format(q='q', u='vec_id', n='p.vec_id % 20 = 0')}" + """
SELECT q, vec_id, round(similarity, 6) AS sim, pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(similarity, 9) DESC, vec_id) AS pos FROM near) WHERE pos <= 30""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    probes = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("probe"))
    out = retrieval.dense(probes, e, "q", "vec_id")
    return out.select("q", "vec_id", F.round("similarity", 6).alias("sim"), F.col("dense_pos").cast("long").alias("pos"))


_LEXICAL = rf"""q0 AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{TERM}'), lambda t: length(t) > 1)) AS a FROM benchmark),
q1 AS (SELECT item_id, unnest(CASE WHEN len(list_filter(a, lambda t: length(t) >= 4)) > 0 THEN list_filter(a, lambda t: length(t) >= 4) ELSE a END) AS term FROM q0),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
lx AS (SELECT item_id, doc_id, CAST(sum(tf) AS DOUBLE) * 0.1 AS rank FROM q1 JOIN tf USING (term) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, doc_id) AS lex_pos FROM lx) WHERE lex_pos <= 30)"""


@query(f"WITH {_LEXICAL} SELECT item_id, doc_id, rank, lex_pos AS pos FROM lex")
def lexical_topk(spark, d):
    out = retrieval.lexical(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", F.col("text"), "doc_id", F.col("text"), index=document_index(spark, d))
    return out.select("item_id", "doc_id", "rank", F.col("lex_pos").cast("long").alias("pos"))


def _search(spark, d):
    """Scored candidates. An item's vector is the embedding of its id, a document's likewise; authority is 1 + doc_id mod 5."""
    docs, items, e = table(spark, d, "documents"), table(spark, d, "benchmark"), table(spark, d, "embeddings")
    lex = retrieval.lexical(items, docs, "item_id", F.col("text"), "doc_id", F.col("text"), index=document_index(spark, d))
    known = e.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("doc_id"), "embedding")
    probes = e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("probe"))
    vec = retrieval.dense(probes, known, "item_id", "doc_id")
    queries = items.select("item_id", F.col("text").alias("query"), F.array(tx.first_line(F.col("text"))).alias("aliases"))
    units = docs.select("doc_id", F.col("text").alias("body"), F.concat_ws(" ", tx.first_line(F.col("text")), "source").alias("identity"), F.coalesce("text", F.lit("")).alias("retrieval_text"), F.col("source").alias("product"), F.col("text").alias("answer"), (1 + F.col("doc_id") % 5).alias("authority"))
    return retrieval.fuse(lex, vec, queries, units, "item_id", "doc_id")


_T = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{TERM}'), lambda t: length(t) > 1))"
_FUSED = rf"""{_LEXICAL}, {_VECTORS.format(q='item_id', u='doc_id', n='p.vec_id IN (SELECT item_id FROM benchmark)')},
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, doc_id) AS dense_pos FROM near WHERE doc_id IN (SELECT doc_id FROM documents) AND item_id IN (SELECT item_id FROM benchmark)) WHERE dense_pos <= 30),
qs AS (SELECT item_id, text AS query, split_part(text, chr(10), 1) AS alias, a, CASE WHEN len(list_filter(a, lambda t: length(t) >= 4)) > 0 THEN list_filter(a, lambda t: length(t) >= 4) ELSE a END AS telling FROM q0 JOIN benchmark USING (item_id)),
us AS (SELECT doc_id, text, source, {_T('text')} AS body, {_T("split_part(text, chr(10), 1) || ' ' || source")} AS ident, 1 + doc_id % 5 AS authority FROM documents),
j AS (SELECT item_id, doc_id, rank, lex_pos, similarity, dense_pos, qs.*, us.* FROM lex FULL JOIN vec USING (item_id, doc_id) JOIN qs USING (item_id) JOIN us USING (doc_id)),
sc AS (SELECT item_id, doc_id, text AS answer, (contains(lower(coalesce(text, '')), lower(alias)) OR lower(alias) = lower(coalesce(source, ''))) AS al, lex_pos, dense_pos,
0.28 * coalesce(similarity, 0) + 0.19 * least(1.0, coalesce(rank, 0) * 4.0) + 0.08 * CASE WHEN len(a) > 0 THEN len(list_intersect(a, body)) / len(a) ELSE 0 END
+ 0.35 * CASE WHEN len(telling) > 0 THEN len(list_intersect(telling, ident)) / len(telling) ELSE 0 END
+ 0.10 * least(1.0, (CASE WHEN lex_pos IS NULL THEN 0 ELSE 1.0 / (60 + lex_pos) END + CASE WHEN dense_pos IS NULL THEN 0 ELSE 1.0 / (60 + dense_pos) END) / (2.0 / 61)) AS base, authority FROM j),
scored AS (SELECT item_id, doc_id, answer, round(least(1.0, CAST(base + CASE WHEN al THEN 0.08 ELSE 0 END + greatest(0, (authority - 3) * 0.025) AS DOUBLE)), 6) AS score,
list_filter([CASE WHEN lex_pos IS NOT NULL THEN 'lexical' END, CASE WHEN dense_pos IS NOT NULL THEN 'dense' END, CASE WHEN al THEN 'alias' END], lambda x: x IS NOT NULL) AS m FROM sc),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, regexp_replace(lower(coalesce(answer, '')), '[^\p{{L}}\p{{N}}_]+', '', 'g') ORDER BY score DESC, len(m) DESC, doc_id) AS nth FROM scored) WHERE nth = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, len(m) DESC, doc_id) AS pos FROM once) WHERE pos <= 5)"""


@query(f"WITH {_FUSED} SELECT item_id, doc_id, score, array_to_string(m, ',') AS matched_by, pos FROM best")
def hybrid_rrf_search(spark, d):
    out = retrieval.ranked(_search(spark, d), "item_id", "doc_id")
    return out.select("item_id", "doc_id", "score", F.array_join("matched_by", ",").alias("matched_by"), F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {_FUSED}, c AS (SELECT item_id, max(score) AS confidence FROM best GROUP BY item_id)
SELECT b.item_id, CASE WHEN coalesce(confidence, 0) >= 0.42 THEN 'ok' ELSE 'no_answer' END AS status, coalesce(confidence, 0.0) AS confidence,
CASE WHEN coalesce(confidence, 0) >= 0.42 THEN NULL ELSE 'below_confidence_threshold' END AS reason FROM benchmark b LEFT JOIN c USING (item_id)""")
def threshold_answers(spark, d):
    hits = retrieval.ranked(_search(spark, d), "item_id", "doc_id")
    return retrieval.decide(table(spark, d, "benchmark"), hits, "item_id")


@query(f"""WITH {_FUSED}, r AS (SELECT b.item_id, min(pos) AS rank FROM benchmark b LEFT JOIN best ON best.item_id = b.item_id AND contains(coalesce(best.answer, ''), b.text) GROUP BY b.item_id)
SELECT count(*) AS n, CAST(count(*) FILTER (WHERE rank <= 5) AS DOUBLE) / count(*) AS recall_at_k, round(sum(coalesce(1.0 / rank, 0)) / count(*), 9) AS mrr FROM r""")
def eval_recall_mrr(spark, d):
    hits = settled(retrieval.ranked(_search(spark, d), "item_id", "doc_id").select("item_id", "doc_id", "pos"))
    items = table(spark, d, "benchmark").select("item_id", "text")
    answers = retrieval.mostly_among(table(spark, d, "documents").select("doc_id", F.col("text").alias("answer")), hits, "doc_id")
    found = items.join(hits.join(answers, "doc_id"), "item_id", "left").groupBy("item_id").agg(F.min(F.when(F.contains(F.coalesce("answer", F.lit("")), F.col("text")), F.col("pos"))).alias("rank"))
    return retrieval.evaluate(found, 5).withColumn("mrr", F.round("mrr", 9))


_A = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: length(t) > 1))"


@query(f"""WITH q AS (SELECT p_partkey + 0 AS item_id, {_A('p_name')} AS q FROM part WHERE p_partkey % 20 = 0),
e AS (SELECT p_partkey, {_A('p_brand')} AS c, {_A('p_type')} AS s, {_A('p_name')} AS r FROM part),
sc AS (SELECT item_id, p_partkey, round((1.0 * len(list_intersect(q, c)) + 1.5 * len(list_intersect(q, s)) + 2.0 * len(list_intersect(q, r))) / greatest(1.0, len(q) + len(list_distinct(list_concat(s, r)))), 6) AS score FROM q, e)
SELECT item_id, p_partkey, CAST(score AS DOUBLE) AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, p_partkey) AS pos FROM sc WHERE score > 0) WHERE pos <= 5""")
def ticket_candidates(spark, d):
    p = table(spark, d, "part")
    descriptions = p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))
    out = retrieval.tickets(descriptions, p, "item_id", F.col("text"), "p_partkey", F.col("p_brand"), F.col("p_type"), F.col("p_name"))
    return out.withColumn("pos", F.col("pos").cast("long"))
