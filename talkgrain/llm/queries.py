"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.chat_format import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE["op10_chat_format"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(md5(role || chr(1) || text), ',') OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
ends AS (SELECT n, prefix, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY n, prefix),
kept AS (SELECT conv_id FROM ends ANTI JOIN (SELECT DISTINCT prefix FROM p WHERE pos < n) q USING (prefix))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
                  || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10),
                  '' ORDER BY turn NULLS FIRST, role, text) AS rendered
FROM t SEMI JOIN kept USING (conv_id) GROUP BY conv_id
"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


ORACLE["op4_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix-1'), 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM r),
f AS (SELECT *, sum(source_size) OVER () AS whole,
             coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM w),
g AS (SELECT *, cap * weight_left <= weight * (whole - full_before) AS is_full FROM f),
o AS (SELECT *, whole - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS rest, sum(weight) FILTER (NOT is_full) OVER () AS open_weight FROM g),
t AS (SELECT source, source_size, rank, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(open_weight AS DOUBLE) END AS target FROM o),
c AS (SELECT d.*, t.source_size, t.rank, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size
                 + greatest(0, least(size, goal % source_size - start)) END AS taken, least(1.0, start / target) AS u FROM c)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN CASE rank % 3 WHEN 0 THEN least(1.0, 2 * u / (1.0 + sqrt(1.0)))
            WHEN 1 THEN least(1.0, 2 * u / (0.5 + sqrt(0.5 * 0.5 + 2 * 1.0 * u)))
            ELSE least(1.0, 2 * u / (1.5 + sqrt(greatest(0.0, 1.5 * 1.5 + 2 * -1.0 * u)))) END END AS position
FROM k
"""


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.spotsigs import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def _spotsigs_sql() -> str:
    from talkgrain.llm.spotsigs import ANCHORS

    common = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER w AS after,
                  first_value(coalesce(text, '')) OVER w AS first_text FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, text, coalesce(after, first_text) AS after, length(text) AS n, length(text) // 3 AS k FROM d),
x AS (SELECT *, left(text, n - k) || left(after, k) AS edited FROM e),
texts AS (SELECT doc_id, 'o' AS kind, text AS t FROM x UNION ALL SELECT doc_id, 'e', edited FROM x),
tok AS (SELECT doc_id, kind, unnest(words) AS word, generate_subscripts(words, 1) AS i
        FROM (SELECT doc_id, kind, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS words FROM texts)),
flag AS (SELECT *, word IN ({common}) AS common FROM tok),
num AS (SELECT *, sum(CASE WHEN common THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY i) AS c FROM flag),
content AS (SELECT doc_id, kind, c, word, lead(word) OVER (PARTITION BY doc_id, kind ORDER BY i) AS second FROM num WHERE NOT common),
chain AS (SELECT a.doc_id, a.kind, a.word || ' ' || b.word || ' ' || b.second AS s FROM num a JOIN content b
          ON a.doc_id = b.doc_id AND a.kind = b.kind AND b.c = a.c + 1 WHERE a.common AND b.second IS NOT NULL),
sig AS (SELECT doc_id, kind, list_sort(list(DISTINCT left(md5(s), 8))) AS s FROM chain GROUP BY doc_id, kind),
one AS (SELECT t.doc_id, t.kind, CASE WHEN sig.s IS NOT NULL THEN sig.s WHEN t = '' THEN CAST([] AS VARCHAR[])
               WHEN len(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) = 0 THEN [left(md5(t), 8)]
               ELSE [left(md5(array_to_string(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'), ' ')), 8)] END AS s
        FROM texts t LEFT JOIN sig USING (doc_id, kind)),
p AS (SELECT x.doc_id, x.n, sha256(x.edited) AS sha, o.s AS o, e.s AS e,
             coalesce(lead(o.s) OVER w, first_value(o.s) OVER w) AS nx
      FROM x JOIN one o ON o.doc_id = x.doc_id AND o.kind = 'o' JOIN one e ON e.doc_id = x.doc_id AND e.kind = 'e'
      WINDOW w AS (ORDER BY x.doc_id DESC))
SELECT doc_id, n AS n_chars, sha AS edited_sha256, array_to_string(o, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint,
       CASE WHEN len(o) = 0 AND len(e) = 0 THEN 1.0 ELSE CAST(len(list_intersect(o, e)) AS DOUBLE) / (len(o) + len(e) - len(list_intersect(o, e))) END AS near_edited,
       CASE WHEN len(o) = 0 AND len(nx) = 0 THEN 1.0 ELSE CAST(len(list_intersect(o, nx)) AS DOUBLE) / (len(o) + len(nx) - len(list_intersect(o, nx))) END AS near_next
FROM p
"""


ORACLE["op1_fingerprints"] = _spotsigs_sql()


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by held-out accuracy, the loss's gradient and all possible cuts: SQL can't express the fit."""
    from talkgrain.llm.quality import held_out, learn, scored

    docs = table(spark, sf_dir, "documents")
    ranker = learn(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, ranker)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ranker.cut).cast("int").alias("predicted"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.url_filter import judge, page_outcomes

    pages, scratch = table(spark, sf_dir, "pages"), Scratch(spark, "op3")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch)
    return judge(pages, outcomes, scratch)


def _level_sql(name: str, rows: str, key: str) -> str:
    return f"""
{name}_m AS (SELECT round(greatest(1.0, least(1000.0, p * (1 - p) / greatest(1e-6, seen - noise) - 1)), 6) AS m FROM (
  SELECT sum(base * n) / sum(n) AS p, sum(n * power(CAST(good AS DOUBLE) / 1e6 / n - base, 2)) / sum(n) AS seen, sum(base * (1 - base)) / sum(n) AS noise FROM {rows})),
{name} AS (SELECT {key}, n, m, round((CAST(good AS DOUBLE) / 1e6 + m * base) / (n + m), 9) AS rate FROM {rows}, {name}_m)"""


def _suffix_labels(more: int) -> str:
    from talkgrain.llm.url_filter import SUFFIXES

    known = ", ".join(f"'{x}'" for x in SUFFIXES)
    last = lambda n: f"array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
    return f"CASE WHEN {last(2)} IN ({known}) THEN {last(2 + more)} ELSE {last(1 + more)} END"


ORACLE["op3_url_filter"] = rf"""
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
  nullif(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '') AS title FROM pages),
marked AS (SELECT nullif(left(split_part(text, chr(10), 1), 60), '') AS title, quality = 1 AND coalesce(toxic, 0) = 0 AS good
           FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
titles AS (SELECT title, CAST(sum(CAST(good AS INT)) AS DOUBLE) / count(*) AS good FROM marked WHERE title IS NOT NULL GROUP BY title),
hosts AS (SELECT host, {_suffix_labels(1)} AS domain, {_suffix_labels(0)} AS suffix,
                 count(*) AS n, sum(CAST(round(good * 1e6) AS BIGINT)) AS good FROM u JOIN titles USING (title) WHERE host <> '' GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT CAST(sum(good) AS DOUBLE) / 1e6 / sum(n) FROM hosts) AS base FROM hosts GROUP BY suffix),
{_level_sql('s', 's0', 'suffix')},
d0 AS (SELECT domain, h.n, h.good, s.rate AS base FROM (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix) h JOIN s USING (suffix)),
{_level_sql('d', 'd0', 'domain')},
h0 AS (SELECT host, hosts.n, hosts.good, d.rate AS base FROM hosts JOIN d USING (domain)),
{_level_sql('h', 'h0', 'host')},
known AS (SELECT host, round(least(1.0, rate + 1.645 * sqrt(rate * (1 - rate) / (n + m + 1))), 6) AS upper FROM h),
r AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict, upper FROM r LEFT JOIN known ON r.host = known.host
"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.substring_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), texts=False)


ORACLE["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS gram FROM x WHERE i + 12 <= len(w)),
first AS (SELECT gram, min(doc_id) AS lo FROM g GROUP BY gram HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i FROM g JOIN first USING (gram) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, (SELECT unnest(range(0, 13)) AS j)),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(x.w[x.i], ' ' ORDER BY x.i) AS t FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), texts=False)


ORACLE["op5_suffix_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, i, b[i + 1 : i + 1] AS c, CASE WHEN i + 400 <= n THEN md5_number_lower(b[i + 1 : i + 400]) END AS h, CASE WHEN i + 400 <= n THEN hash(b[i + 1 : i + 400]) END AS k FROM (SELECT r, n, b, unnest(range(CAST(n AS BIGINT))) AS i FROM d)),
rep AS (SELECT h, k FROM p WHERE h IS NOT NULL GROUP BY h, k HAVING count(*) > 1),
lines AS (SELECT r, i, c, coalesce(max(CASE WHEN rep.h IS NOT NULL THEN i END) OVER (PARTITION BY r ORDER BY i) > i - 400, false) AS gone FROM p LEFT JOIN rep USING (h, k)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM lines),
bytes AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, sha256(unhex(coalesce(string_agg(hex(c), '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept FROM runs GROUP BY r),
x AS MATERIALIZED (SELECT r, i, CASE WHEN i + 50 <= len(w) THEN md5(array_to_string(w[i : i + 50], ' ')) END AS h FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
again AS (SELECT h FROM x WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
cov AS (SELECT r, count(*) FILTER (WHERE m) AS n FROM (SELECT r, coalesce(max(CASE WHEN again.h IS NOT NULL THEN i END) OVER (PARTITION BY r ORDER BY i) > i - 51, false) AS m FROM x LEFT JOIN again USING (h)) GROUP BY r)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(bytes.n_removed, 0) AS n_removed, coalesce(bytes.n_spans, 0) AS n_spans, coalesce(bytes.kept, sha256('')) AS kept_sha256, coalesce(cov.n, 0) AS n_passage_words
FROM d LEFT JOIN bytes USING (r) LEFT JOIN cov USING (r)
"""


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.embedding_dedup import links

    return links(table(spark, sf_dir, "embeddings"), Scratch(spark, "op9"))


ORACLE["op9_embedding_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM v LEFT JOIN cnt ON cnt.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


@query
def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by exact round trip and against enumerated posteriors: SQL can't express the lattice."""
    from talkgrain.llm.piece_sampling import encoded, load

    return encoded(table(spark, sf_dir, "documents"), load())


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


ORACLE["op8_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS g FROM d),
rep AS (SELECT md5(array_to_string(g, '|')) AS h, min(doc_id) AS rep, count(*) AS copies, any_value(g) AS g, any_value(len(g)) AS n FROM s GROUP BY h),
x AS (SELECT rep, n, copies, unnest(g) AS g FROM rep),
pair AS (SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep
         GROUP BY a.rep, b.rep, a.n, b.n HAVING CAST(count(*) AS DOUBLE) / (a.n + b.n - count(*)) >= 0.8),
reach AS (SELECT a, b FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
cnt AS (SELECT a, CAST(sum(copies) AS BIGINT) AS add FROM pair GROUP BY a)
SELECT s.doc_id, coalesce(cnt.add, 0) + rep.copies - 1 AS n_links, least(rep.rep, coalesce(low.b, rep.rep)) AS class_id
FROM s JOIN rep ON rep.h = md5(array_to_string(s.g, '|')) LEFT JOIN cnt ON cnt.a = rep.rep LEFT JOIN low ON low.a = rep.rep
"""


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op11"))


ORACLE["op11_importance"] = r"""
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
x AS (SELECT row_number() OVER () AS r, doc_id, text, true AS raw FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
w AS (SELECT r, doc_id, raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT r, raw, unnest(w) AS w FROM w),
h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM f)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
             lambda c, y: xor(c >> 8, t.t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, t),
c AS (SELECT bucket, count(*) FILTER (WHERE raw) AS s, count(*) FILTER (WHERE NOT raw) AS t FROM f JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM c),
q AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
d AS (SELECT w.r, w.doc_id, CAST(len(w.w) AS BIGINT) AS n_features, coalesce(q.weight, 0) AS weight,
             coalesce(q.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM w LEFT JOIN q USING (r) WHERE raw),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM d WHERE n_features >= 20)
SELECT d.doc_id, d.n_features, d.weight, d.score, CASE WHEN k.rank <= 10 * k.n // 100 THEN k.rank END AS rank FROM d LEFT JOIN k USING (r)
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a plain eigendecomposition: SQL can't express the rotations."""
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a plain search and a plain estimate: SQL can't express the labelers' model."""
    from talkgrain.llm.common import Scratch
    from talkgrain.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))
