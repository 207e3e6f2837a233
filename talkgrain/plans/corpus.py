"""Queries over documents, labels and pages as a knowledge corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions import redact, urls
from talkgrain.functions import text as tx
from talkgrain.operators import corpus
from talkgrain.plans.registry import query
from talkgrain.session import table

_TOKEN = r"""[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"""
_COLLAPSE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_TOKEN}')) AS value FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_count(F.col("text")).cast("long").alias("value"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
'https?://[^\s]+', ' ', 'g'), '(?m)^[ \t]{0,3}(#{1,6}|[-*+]|[0-9]{1,3}[.)])[ \t]+', '', 'g'), '[*_`~|]+', ' ', 'g'), '\s+', ' ', 'g')) AS value FROM documents""")
def plain_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.plain(F.col("text")).alias("value"))


@query("""SELECT doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(split_part(text, chr(10), 1), '') || chr(0) || coalesce(text, '') || chr(0) || coalesce(source, '')) AS value FROM documents""")
def content_hash(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("lang"), tx.first_line(t), t, F.col("source")).alias("value"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bbearer[ \t]+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'),
'\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[REDACTED_TOKEN]', 'g'), '(?i)(password|passwd|secret|token|api[_-]?key|authorization)[ \t]*[:=][ \t]*[^\s,;]+', '\1=[REDACTED]', 'g') AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)(https?://)[^\s/@]+@', '\1', 'g'), '(?i)(https?://[^\s?]+)\?[^\s]+', '\1?[REDACTED_QUERY]', 'g') AS t FROM s),
p AS (SELECT doc_id, regexp_replace(t, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g') AS t FROM u)
SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])[0-9]{7,16}($|[^0-9])', '\1[REDACTED_NUMBER]\2', 'g'), '(^|[^0-9])[0-9]{7,16}($|[^0-9])', '\1[REDACTED_NUMBER]\2', 'g') AS redacted FROM p""")
def redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", redact.redacted(F.col("text")).alias("redacted"))


@query(r"""WITH p AS (SELECT page_id, trim(url) AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h,
rtrim(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS qs FROM p),
f AS (SELECT *, array_to_string(list_sort(list_transform(list_filter(string_split(qs, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')
AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') AS query FROM q)
SELECT page_id, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canon FROM f""")
def url_canonicalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canon"))


def _units(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").withColumnRenamed("doc_id", "unit_id")


@query(rf"""SELECT sha256(lower({_COLLAPSE})) AS hash, min(doc_id) AS kept_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_dup_groups(spark, d):
    groups = corpus.keep_best(_units(spark, d), "text", F.lit(False), [F.col("unit_id")])
    return groups.filter("n > 1").select("hash", "kept_id", "n")


@query(rf"""WITH u AS (SELECT doc_id, text, coalesce(quality = 1, false) AS ok, length(source) AS l, source FROM documents LEFT JOIN labels USING (doc_id))
SELECT sha256(lower({_COLLAPSE})) AS hash, arg_min(doc_id, (NOT ok, l, source, doc_id)) AS kept_id, count(*) AS n FROM u GROUP BY 1""")
def keep_best(spark, d):
    approved = F.coalesce(F.col("quality") == 1, F.lit(False))
    return corpus.keep_best(_units(spark, d), "text", approved, [F.length("source"), F.col("source"), F.col("unit_id")])


_TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+')"
_ONES = ", ".join(f"sum((h >> {i}) & 1) AS s{i}" for i in range(64))
_HASH = " + ".join(f"CASE WHEN 2 * s{i} >= n THEN CAST({1 << i} AS UHUGEINT) ELSE 0 END" for i in range(64))


@query(f"""WITH t AS (SELECT doc_id, lang, {_TERMS} AS w FROM documents WHERE lang IS NOT NULL),
g AS (SELECT doc_id, lang, len(w) AS tokens, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) ELSE w END) AS g FROM t WHERE len(w) >= 12),
b AS (SELECT doc_id, lang, tokens, CAST('0x' || left(md5(g), 16) AS UBIGINT) AS h FROM g), c AS (SELECT doc_id, lang, any_value(tokens) AS tokens, count(*) AS n, {_ONES} FROM b GROUP BY doc_id, lang),
u AS (SELECT doc_id, lang, tokens, CAST({_HASH} AS UBIGINT) AS hash FROM c), r AS (SELECT lang, hash, tokens, min(doc_id) AS doc_id FROM u GROUP BY lang, hash, tokens)
SELECT a.doc_id AS left_id, z.doc_id AS right_id, CAST(bit_count(xor(a.hash, z.hash)) AS INT) AS dist FROM r a JOIN r z ON a.lang = z.lang AND a.doc_id < z.doc_id
AND bit_count(xor(a.hash, z.hash)) <= 2 AND least(a.tokens, z.tokens) >= 0.9 * greatest(a.tokens, z.tokens)
UNION ALL SELECT r.doc_id, u.doc_id, 0 FROM u JOIN r USING (lang, hash, tokens) WHERE u.doc_id > r.doc_id""")
def near_dup_pairs(spark, d):
    """Pairs of representatives, and each other unit of an equal hash with its representative."""
    u = _units(spark, d).select("unit_id", F.col("lang").alias("unit_type"), F.col("text").alias("answer"))
    return corpus.near_duplicates(u)


@query(r"""WITH u AS (SELECT doc_id, lang, source, trim(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^\p{L}\p{N}_]+', ' ', 'g')) AS k,
trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g')) AS said, sha256(coalesce(text, '')) AS h FROM documents)
SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM u a JOIN u b ON a.k = b.k AND a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id
WHERE a.k <> '' AND a.h <> b.h AND a.said <> b.said""")
def contradiction_pairs(spark, d):
    u = table(spark, d, "documents").select(
        F.col("doc_id").alias("unit_id"), tx.first_line(F.col("text")).alias("subject"), F.lit("").alias("product"), F.col("source").alias("topic"), F.col("lang").alias("unit_type"),
        F.col("doc_id").alias("document_id"), tx.content_hash(F.col("text")).alias("content_hash"), F.col("text").alias("answer"),
    )
    return corpus.contradictions(u)


@query(rf"""WITH u AS (SELECT *, {_COLLAPSE} AS c FROM documents), a AS (SELECT count(*) AS units, count(DISTINCT lower(c)) AS dis, count(*) FILTER (WHERE c = '') AS empty,
avg(length(coalesce(text, ''))) AS chars, count(DISTINCT (lang, source)) FILTER (WHERE lang IS NOT NULL AND source IS NOT NULL) AS groups FROM u)
SELECT unnest(['units', 'distinct_answers', 'exact_surplus', 'empty', 'avg_chars', 'groups']) AS metric,
unnest([CAST(units AS DOUBLE), dis, units - dis, empty, chars, groups]) AS value FROM a""")
def corpus_audit(spark, d):
    return corpus.audit(table(spark, d, "documents"), "text", ["lang", "source"])


@query(r"""WITH u AS (SELECT doc_id, lang, source, trim(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^\p{L}\p{N}_]+', ' ', 'g')) AS k,
trim(regexp_replace(lower(coalesce(source, '')), '[^\p{L}\p{N}_]+', ' ', 'g')) AS topic, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g')) AS said FROM documents)
SELECT a.doc_id, min(b.doc_id) AS subject_id, count(*) FILTER (WHERE a.said <> b.said) AS n_conflicts FROM u a JOIN u b ON a.k = b.k AND a.lang = b.lang AND a.topic = b.topic WHERE a.k <> '' GROUP BY a.doc_id""")
def contradiction_counts(spark, d):
    u = table(spark, d, "documents").select(
        F.col("doc_id").alias("unit_id"), tx.first_line(F.col("text")).alias("subject"), F.lit("").alias("product"), F.col("source").alias("topic"), F.col("lang").alias("unit_type"),
        F.col("doc_id").alias("document_id"), F.col("text").alias("answer"),
    )
    return corpus.contradiction_counts(u).withColumnRenamed("unit_id", "doc_id")


@query("""WITH l AS (SELECT left(sha256(CAST(doc_id AS VARCHAR)), 5) AS leaf, CAST(doc_id AS VARCHAR) || chr(0) || sha256(coalesce(text, '')) AS line FROM documents),
p AS (SELECT leaf, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY leaf), b AS (SELECT left(leaf, 2) AS branch, sha256(string_agg(h, chr(10) ORDER BY leaf)) AS h FROM p GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY branch)) AS corpus_hash FROM b""")
def corpus_hash(spark, d):
    u = table(spark, d, "documents").select(F.col("doc_id").alias("stable_key"), tx.content_hash(F.col("text")).alias("content_hash"))
    return corpus.corpus_hash(u)


@query("""SELECT p_partkey, CASE WHEN p_size > 25 AND n > 1 THEN 'duplicate' WHEN p_size > 25 THEN 'active' ELSE 'blocked' END AS state FROM
(SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size > 25 ORDER BY p_partkey) AS n FROM part)""")
def taxonomy_states(spark, d):
    from pyspark.sql import Window as W

    p = table(spark, d, "part").withColumn("ok", F.col("p_size") > 25)
    nth = F.row_number().over(W.partitionBy("p_brand", "p_type", "ok").orderBy("p_partkey"))
    return p.select("p_partkey", F.when(F.col("ok") & (nth > 1), "duplicate").when(F.col("ok"), "active").otherwise("blocked").alias("state"))


@query("""SELECT doc_id, CASE WHEN chars >= 3000 AND quality = 1 THEN 'publish' WHEN quality = 0 THEN 'retire' ELSE 'review' END AS action FROM
(SELECT doc_id, length(coalesce(text, '')) AS chars, quality FROM documents LEFT JOIN labels USING (doc_id))""")
def review_gate(spark, d):
    u = _units(spark, d)
    long = F.length(F.coalesce("text", F.lit(""))) >= 3000
    action = F.when(long & (F.col("quality") == 1), "publish").when(F.col("quality") == 0, "retire").otherwise("review")
    return u.select(F.col("unit_id").alias("doc_id"), action.alias("action"))


@query(r"""SELECT doc_id, CASE WHEN n <= 200 THEN c WHEN pos >= 100 AND pos > 0 THEN rtrim(left(h, pos)) || '…' ELSE rtrim(h) || '…' END AS value FROM
(SELECT doc_id, c, length(c) AS n, left(c, 199) AS h, length(left(c, 199)) - length(regexp_extract(left(c, 199), '[^ ]*$')) - 1 AS pos FROM
(SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents))""")
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncated(F.col("text"), 200).alias("value"))
