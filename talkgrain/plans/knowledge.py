"""Queries over the knowledge base: writes as new states, sources, releases, reports, addresses and fields. Parts, pages and documents stand for its tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions import facts, redact, rules, spans, speech, urls
from talkgrain.functions import text as tx
from talkgrain.operators import corpus, knowledge, memory, tables
from talkgrain.plans.registry import query
from talkgrain.session import table


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def insert_missing(spark, d):
    held = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return tables.insert_missing(held, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""WITH n AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v, max(o_orderkey) AS seq FROM orders GROUP BY 1)
SELECT c_custkey AS k, c_acctbal AS v, CAST(-1 AS BIGINT) AS seq FROM customer WHERE c_custkey NOT IN (SELECT k FROM n) UNION ALL SELECT k, v, seq FROM n""")
def upserted(spark, d):
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(-1).cast("long").alias("seq"))
    return tables.upsert(held, table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq")), ["k"], "seq")


@query("""SELECT p_partkey AS k, 'old' AS model FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) UNION ALL SELECT l_partkey, 'new' FROM lineitem WHERE l_quantity > 48""")
def replaced_groups(spark, d):
    new = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("k"), F.lit("new").alias("model"))
    return tables.replace_group(table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("old").alias("model")), new, ["k"])


@query("""WITH c AS (SELECT 'part/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.v2' ELSE '' END AS key, p_name AS h, ['approved', 'draft', 'retired', 'review'][p_partkey % 4 + 1] AS status, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM part WHERE p_partkey % 7 <> 0),
s AS (SELECT 'part/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.v2' ELSE '' END AS key, CASE WHEN p_size > 25 THEN p_type ELSE p_name END AS h FROM part WHERE p_partkey % 2 = 0),
j AS (SELECT s.key, CASE WHEN c.key IS NULL THEN 'new' WHEN c.h = s.h THEN 'unchanged' WHEN status IN ('approved', 'retired') THEN 'new_version' ELSE 'in_place' END AS action, version FROM s LEFT JOIN c USING (key))
SELECT key AS stable_key, action, CASE WHEN action = 'new_version' THEN version + 1 ELSE coalesce(version, 1) END AS version,
CASE WHEN action = 'new_version' THEN regexp_replace(key, '\\.v[0-9]+$', '') || '.v' || (version + 1) ELSE key END AS result_key FROM j""".replace("\\\\", "\\"))
def draft_versions(spark, d):
    p = table(spark, d, "part")
    key = F.concat(F.lit("part/"), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, ".v2").otherwise(""))
    status = F.element_at(F.array(*map(F.lit, ("approved", "draft", "retired", "review"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    held = p.filter("p_partkey % 7 <> 0").select(key.alias("stable_key"), F.col("p_name").alias("content_hash"), status.alias("status"), F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(1).alias("version"))
    return corpus.staged_upsert(held, p.filter("p_partkey % 2 = 0").select(key.alias("stable_key"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name")).alias("content_hash")))


@query("""SELECT coalesce(c_custkey, k) AS k, k IS NOT NULL AS active FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') ON c_custkey = k""")
def snapshot_sync(spark, d):
    held = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return corpus.snapshot_sync(held, table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), ["k"])


_CONFLICTS = """c AS (SELECT l_partkey AS l, l_suppkey AS r FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 47)"""


def _conflicts(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity > 47")
    return li.select(F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id"), F.when(F.col("l_linestatus") == "O", "open").otherwise("dismissed").alias("status"))


@query(f"""WITH {_CONFLICTS} SELECT p_partkey AS unit_id, CASE WHEN p_size % 3 <> 0 THEN 'approved' WHEN p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT l FROM c UNION SELECT r FROM c) THEN 'approved' ELSE 'draft' END AS status FROM part""")
def approvals(spark, d):
    u = table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.when(F.col("p_size") % 3 == 0, "draft").otherwise("approved").alias("status"))
    return tables.approve(u, F.col("unit_id") % 2 == 0, _conflicts(spark, d))


@query(f"""WITH {_CONFLICTS}, u AS (SELECT p_partkey, p_size % 3 = 0 AS draft FROM part WHERE p_partkey % 5 = 1), x AS (SELECT DISTINCT l, r FROM c WHERE l % 5 = 1 OR r % 5 = 1)
SELECT count(*) AS units, count(*) FILTER (WHERE draft) AS not_approved, count(*) FILTER (WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)) AS not_embedded,
(SELECT count(*) FROM x WHERE l IN (SELECT p_partkey FROM part) OR (r IN (SELECT p_partkey FROM part) AND r % 5 = 1)) AS open_conflicts, false AS valid FROM u""")
def release_check(spark, d):
    p = table(spark, d, "part")
    units = p.select(F.col("p_partkey").alias("unit_id"), F.when(F.col("p_size") % 3 == 0, "draft").otherwise("approved").alias("status"))
    mine = p.select(F.col("p_partkey").alias("unit_id"), (F.col("p_partkey") % 5).alias("version"))
    return tables.release_report(mine, units, table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id")), _conflicts(spark, d), 1)


@query("""SELECT r_regionkey AS version, CASE r_regionkey WHEN 3 THEN 'published' WHEN 1 THEN 'superseded' WHEN 2 THEN 'superseded' ELSE 'draft' END AS status FROM region""")
def published_releases(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("version"), F.when(F.col("r_regionkey") == 1, "superseded").when(F.col("r_regionkey") == 2, "published").otherwise("draft").alias("status"))
    none = _conflicts(spark, d).filter("false")
    return corpus.publish(r, F.lit(3), none, table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.lit(3).alias("version")))


@query("""SELECT r_regionkey AS version, CASE r_regionkey WHEN 1 THEN 'published' WHEN 2 THEN 'superseded' ELSE 'draft' END AS status FROM region""")
def rolled_back_releases(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("version"), F.when(F.col("r_regionkey") == 1, "superseded").when(F.col("r_regionkey") == 2, "published").otherwise("draft").alias("status"))
    return tables.rollback(r, 1)


@query("""SELECT p_partkey AS unit_id, l_orderkey, l_linenumber, o_custkey FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def units_of_source(spark, d):
    docs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("document_id"), F.col("l_orderkey").alias("snapshot_id"), "l_orderkey", "l_linenumber")
    units = table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("document_id"))
    snaps = table(spark, d, "orders").select(F.col("o_orderkey").alias("snapshot_id"), "o_custkey", F.col("o_orderpriority").alias("source"))
    return knowledge.units_of_source(units, docs, snaps, F.col("source") == "1-URGENT").select("unit_id", "l_orderkey", "l_linenumber", "o_custkey")


@query("""SELECT p_partkey AS unit_id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_quantity > 45)""")
def released_units(spark, d):
    ru = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("unit_id"), F.col("l_orderkey").alias("release_id"))
    rel = table(spark, d, "orders").select(F.col("o_orderkey").alias("release_id"), F.when(F.col("o_orderstatus") == "P", "published").otherwise("draft").alias("status"))
    return knowledge.released(table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), "p_name"), ru, rel)


@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages) SELECT host, max(page_id) AS page_id FROM u GROUP BY host""")
def latest_snapshots(spark, d):
    p = table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return knowledge.latest_snapshots(p, F.col("host"), "page_id").select("host", "page_id")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def status_histogram(spark, d):
    return knowledge.histogram(table(spark, d, "documents"), F.col("lang"), F.col("source"))


@query("""SELECT value, n FROM (SELECT split_part(coalesce(text, ''), chr(10), 1) AS value, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1 ORDER BY n DESC, f LIMIT 15)""")
def most_common_titles(spark, d):
    return knowledge.most_common(table(spark, d, "documents"), tx.first_line(F.col("text")), 15, "doc_id").select("value", "n")


@query("""SELECT source, round(avg(CAST(n_chars AS DOUBLE)), 4) AS mean_chars, min(n_chars) AS least_chars, count(*) FILTER (WHERE n_chars < 200) AS with_warnings FROM documents GROUP BY source""")
def source_quality(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("n_chars").alias("least_chars"), F.count_if(F.col("n_chars") < 200).alias("with_warnings"))


@query("""SELECT source, bool_or(coalesce(quality = 1, false)) AS any, bool_and(coalesce(quality = 1, false)) AS all, NOT bool_or(coalesce(quality = 1, false)) AS none FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def source_gates(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("good", F.col("quality") == 1)
    return knowledge.decided(j, "good", "source")


@query("""WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS k FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN k = ['A'] THEN 'faq' WHEN k = ['N'] THEN 'procedure' WHEN k = ['R'] THEN 'product_spec' ELSE 'definition' END AS unit_type FROM g""")
def structured_kinds(spark, d):
    return knowledge.kinds_of(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", {"A": "faq", "N": "procedure", "R": "product_spec"}, F.lit("definition"))


@query("""SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%THE%' AND source IN ('src0', 'src1', 'src2', 'src3') AND lang NOT IN ('fr') ORDER BY source DESC, lang NULLS LAST, doc_id LIMIT 20 OFFSET 20""")
def admin_page(spark, d):
    """One page of a filtered and sorted list: the limit is the feature."""
    t = [F.col("text").ilike("%THE%"), F.col("source").isin("src0", "src1", "src2", "src3"), ~F.col("lang").isin("fr")]
    order = [F.col("source").desc(), F.col("lang").asc_nulls_last(), F.col("doc_id")]
    return knowledge.listed(table(spark, d, "documents"), t, order, 20, 2).select("doc_id", "lang", "source")


@query("SELECT vec_id, len(embedding) AS size FROM embeddings")
def checked_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("provider", F.lit("p"))
    return knowledge.checked_vectors(e, 64, "p").select("vec_id", F.size("embedding").alias("size"))


_HOST = r"lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(rf"""SELECT page_id, NOT regexp_matches(url_decode({_PATH} || '?' || regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1)), '[\[\]{{}}]') AS concrete,
regexp_matches({_PATH}, '(?i)\.(avif|css|csv|doc|docx|gif|ico|jpeg|jpg|js|json|mp3|mp4|pdf|png|svg|webp|woff|woff2|xls|xlsx|xml|zip)$') AS asset,
regexp_replace(url_decode({_PATH}), '/+$', '') = '/fr' OR starts_with(regexp_replace(url_decode({_PATH}), '/+$', ''), '/fr/') AS excluded,
{_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') AS allowed,
lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {_HOST} || {_PATH} AS shown FROM pages""")
def address_rules(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.concrete(u).alias("concrete"), urls.is_asset(u).alias("asset"), urls.under_prefix(u, ["/fr"]).alias("excluded"), urls.allowed(u, ["example.com"]).alias("allowed"), urls.without_query(u).alias("shown"))


_OUTCOME = rf"""CASE WHEN NOT ({_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com')) THEN 'skipped_policy' WHEN starts_with({_PATH}, '/de/') THEN 'skipped_asset'
WHEN row_number() OVER (PARTITION BY {_HOST}, {_PATH} ORDER BY page_id) > 1 THEN 'duplicate' ELSE 'indexed' END"""


@query(f"SELECT count(*) AS pages, count(*) FILTER (WHERE o = 'indexed') AS indexed, count(*) FILTER (WHERE o = 'duplicate') AS duplicate, count(*) FILTER (WHERE o = 'skipped_policy') AS skipped_policy, count(*) FILTER (WHERE o = 'skipped_asset') AS skipped_asset, count(*) FILTER (WHERE o = 'failed') AS failed FROM (SELECT {_OUTCOME} AS o FROM pages)")
def crawl_counters(spark, d):
    from pyspark.sql import Window as W

    u = F.col("url")
    nth = F.row_number().over(W.partitionBy(urls.host(u), urls.path(u)).orderBy("page_id"))
    outcome = F.when(~urls.allowed(u, ["example.com"]), "skipped_policy").when(urls.path(u).startswith("/de/"), "skipped_asset").when(nth > 1, "duplicate").otherwise("indexed")
    return knowledge.crawl_report(table(spark, d, "pages").select(outcome.alias("outcome")))


@query(r"""SELECT page_id, 'web.' || left(sha256(coalesce(url, '')), 16) || '.' || left(sha256(coalesce(html, '') || chr(0) || 'faq'), 16) AS key, regexp_replace(url || '.v' || page_id, '\.v[0-9]+$', '') AS base FROM pages""")
def stable_keys(spark, d):
    key = F.concat("url", F.lit(".v"), "page_id")
    return table(spark, d, "pages").select("page_id", tx.stable_key(F.col("url"), F.col("html"), F.lit("faq")).alias("key"), tx.version_base(key).alias("base"))


@query(r"""SELECT page_id, kind, CASE WHEN kind IN ('website', 'pdf') THEN regexp_matches(u, '^https?://[^/\s]+') ELSE kind IN ('internal', 'api') AND regexp_matches(u, '^[a-z]+://[a-z0-9][a-z0-9._/-]+$') AND split_part(u, '://', 1) = kind END AS safe
FROM (SELECT page_id, ['website', 'internal', 'api', 'pdf', 'other'][page_id % 5 + 1] AS kind, lower(trim(CASE WHEN page_id % 5 = 1 THEN 'internal://' || split_part(url, '://', 2) ELSE url END)) AS u FROM pages)""")
def safe_sources(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("website", "internal", "api", "pdf", "other"))), (F.col("page_id") % 5 + 1).cast("int"))
    uri = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("internal://"), F.get(F.split("url", "://"), F.lit(1)))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", kind.alias("kind"), rules.safe_source(kind, uri).alias("safe"))


@query("""SELECT p_partkey, p_size > 10 AND p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_name <> '' AND p_type <> 'ECONOMY' AS direct FROM part""")
def direct_answers(spark, d):
    m = F.create_map(F.lit("voice_answer_approved"), F.col("p_size") > 10, F.lit("atomic_answer"), F.col("p_partkey") % 2 == 0, F.lit("answerability_reviewed"), F.col("p_partkey") % 3 == 0)
    return table(spark, d, "part").select("p_partkey", rules.direct_answer(m, F.col("p_name"), F.col("p_type") == "ECONOMY").alias("direct"))


@query(r"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'unit_type' END, CASE WHEN NOT regexp_matches(p_name, '^[a-z0-9][a-z0-9._/-]{2,254}$') THEN 'stable_key' END,
CASE WHEN p_size < 5 THEN 'required' END, CASE WHEN NOT p_size BETWEEN 1 AND 5 THEN 'authority' END, CASE WHEN p_retailprice > 1000 THEN 'dates' END], lambda x: x IS NOT NULL), ',') AS problems
FROM part WHERE problems <> ''""")
def invalid_units(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, "faq").alias("unit_type"), F.col("p_name").alias("stable_key"), F.lit("t").alias("title"), F.when(F.col("p_size") >= 5, "a").alias("answer"), F.lit("r").alias("retrieval_text"),
        F.col("p_size").alias("authority"), F.lit(1000.5).alias("effective_at"), F.when(F.col("p_retailprice") > 1000, 1.0).alias("expires_at"),
    )
    return corpus.invalid(p).select("p_partkey", F.array_join("problems", ",").alias("problems"))


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_orderdate <= TIMESTAMP '1996-01-01') AND (o_orderpriority = '5-LOW' OR o_orderdate > TIMESTAMP '1994-01-01')""")
def valid_units(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("effective_at"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate") + F.expr("INTERVAL 2 YEARS")).alias("expires_at"))
    return corpus.valid_at(o, F.to_timestamp(F.lit("1996-01-01 00:00:00"))).select("o_orderkey")


@query(r"""SELECT doc_id, NOT regexp_matches(lower(coalesce(text, '')), '<tool_call|</tool_call|<function|</function|<\||\|>|\[inst\]|\[/inst\]|<system|</system') AS clean FROM documents""")
def reserved_markup(spark, d):
    return table(spark, d, "documents").select("doc_id", memory.free_of_markup(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\[([^\[\]]*)\]\([^()]*\)')) AS links, length(regexp_replace(coalesce(text, ''), '\[([^\[\]]*)\]\([^()]*\)', '\1', 'g')) AS chars FROM documents""")
def link_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.plain_chars(F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.links", "x.chars")


@query(rf"""SELECT doc_id, greatest(1, CAST(ceil((len(regexp_extract_all(coalesce(text, ''), '{tx.TOKEN.replace("'", "''")}')) - 40) / (400.0 - 40)) AS INT)) AS n FROM documents""")
def estimated_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.estimated_chunks(F.col("text"), 400, 40).alias("n"))


@query(r"""SELECT doc_id, CASE WHEN length(j) > 200 THEN '{"truncated":true,"preview":"' || replace(left(j, 200), '"', '\"') || '"}' ELSE j END AS shown FROM (SELECT doc_id, '{"lang":"' || lang || '","chars":' || n_chars || ',"pad":"' || repeat('x', CAST(doc_id % 300 AS INT)) || '"}' AS j FROM documents WHERE lang IS NOT NULL)""")
def capped_payloads(spark, d):
    j = F.format_string('{"lang":"%s","chars":%d,"pad":"%s"}', "lang", "n_chars", F.repeat(F.lit("x"), (F.col("doc_id") % 300).cast("int")))
    return table(spark, d, "documents").filter("lang is not null").select("doc_id", redact.capped_json(j, 200).alias("shown"))


@query("""SELECT c_custkey, '***' || right(c_name, 4) AS masked, replace(c_name, 'Customer', '[PRIVATE]') AS scrubbed FROM customer""")
def masked_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", redact.masked(F.col("c_name")).alias("masked"), redact.scrubbed(F.col("c_name"), "CUSTOMER").alias("scrubbed"))


@query(r"""SELECT p_partkey, left(trim(regexp_replace(lower(trim(p_brand || ' - ' || p_type)), '[^a-z0-9]+', '_', 'g'), '_'), 64) AS key, array_to_string(list_slice(string_split(trim(regexp_replace(split_part(p_name || '. more', '.', 1), '\s+', ' ', 'g')), ' '), 1, 16), ' ') AS value FROM part""")
def fact_fields(spark, d):
    key = F.concat_ws(" - ", "p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", facts.fact_key(key).alias("key"), facts.fact_value(F.concat("p_name", F.lit(". more")), F.lit("k")).alias("value"))


@query("""SELECT event_id FROM events WHERE value >= 0.85 * 40 AND event_id % 4 <> 0 AND event_type NOT IN ('view', 'click')""")
def trusted_facts(spark, d):
    e = table(spark, d, "events")
    ok = facts.trusted(F.col("value") / 40, F.when(F.col("event_id") % 4 == 0, F.lit(True))) & facts.valid_fact(F.lit("active"), F.lit("name"), F.col("event_type"), ["view", "click"])
    return e.filter(ok).select("event_id")


@query(r"""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 3 <> 0""")
def fenced_objects(spark, d):
    """The object in a fenced answer; texts that hold none are left out."""
    t = F.when(F.col("event_id") % 3 == 0, "none [1]").otherwise(F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```")))
    v = facts.fenced_json(t)
    return table(spark, d, "events").select("event_id", F.variant_get(v, "$.k", "string").alias("k"), v.isNotNull().alias("ok")).filter("ok").drop("ok")


@query(r"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k": ' || (props->>'$.k') || ', "token": "[REDACTED]"}' ELSE '{"k": ' || (props->>'$.k') || '}' END AS clean FROM events""")
def sanitized_payloads(spark, d):
    j = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", ', "token": "abc"}')).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", facts.sanitized_json(j).alias("clean"))


_SPOKEN = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


@query(f"""WITH x AS (SELECT o_orderkey, list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c: CAST(c AS INT)) AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN repeat(CAST(c[1] AS VARCHAR), 2) || substr(CAST(o_orderkey AS VARCHAR), 2) ELSE CAST(o_orderkey AS VARCHAR) END AS digits,
CASE WHEN o_orderkey % 3 <> 0 AND length(CAST(o_orderkey AS VARCHAR)) = 4 OR o_orderkey % 3 = 0 AND length(CAST(o_orderkey AS VARCHAR)) = 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN repeat(CAST(c[1] AS VARCHAR), 2) || substr(CAST(o_orderkey AS VARCHAR), 2) ELSE CAST(o_orderkey AS VARCHAR) END END AS of_four FROM x""")
def spoken_digits(spark, d):
    words = F.transform(F.split(F.col("o_orderkey").cast("string"), ""), lambda c: F.element_at(F.array(*map(F.lit, _SPOKEN)), c.cast("int") + 1))
    said = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "my number is double ").otherwise("it is "), F.array_join(words, " "), F.lit(" thanks"))
    runs = speech.digit_runs(said)
    return table(spark, d, "orders").select("o_orderkey", F.get(runs, F.lit(0)).alias("digits"), speech.only_of_length(runs, 4).alias("of_four"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'user' || c_custkey || '@example.com' END AS address FROM customer""")
def spoken_addresses(spark, d):
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("write to user"), k, F.lit(" at example dot com"))).when(k % 3 == 1, F.concat(F.lit("it is USER"), k, F.lit("@Example.com please"))).otherwise(F.concat(F.lit("a@b.com or c@d.com "), k))
    return table(spark, d, "customer").select("c_custkey", spans.only_value(spans.addresses(said)).alias("address"))


@query("""WITH x AS (SELECT c_custkey, replace(c_name, 'Customer#', '') AS n FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'unverified' ELSE 'incomplete_speech' END AS state, '***' || right(CASE WHEN c_custkey % 2 = 0 THEN n ELSE left(n, 5) END, 4) AS shown FROM x""")
def form_fields(spark, d):
    f = speech.Field("identifier", "number", prefix="C", digits=9)
    said = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.substring("c_name", 1, 14))
    return table(spark, d, "customer").select("c_custkey", f.state(said).alias("state"), f.masked(said).alias("shown"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\bring\b', 'Band', 'g'), '\bred\b', 'Crimson', 'g') AS text, CAST(regexp_matches(p_name, '\bring\b') AS INT) + CAST(regexp_matches(p_name, '\bred\b') AS INT) AS n FROM part""")
def alias_rewrites(spark, d):
    a = speech.aliases_udf([("ring", "Band"), ("red", "Crimson")])
    return table(spark, d, "part").select("p_partkey", a("p_name").alias("x")).select("p_partkey", "x.text", F.size("x.used").alias("n"))


@query(r"""WITH c AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c FROM documents) SELECT doc_id, count(*) FILTER (WHERE regexp_matches(c, '\p{Lu}')) AS upper, count(*) FILTER (WHERE regexp_matches(c, '\p{Ll}')) AS lower,
count(*) FILTER (WHERE regexp_matches(c, '\p{Nd}')) AS digits FROM c GROUP BY doc_id HAVING count(*) FILTER (WHERE c <> '') > 0""")
def character_classes(spark, d):
    m = F.col("m")
    n = lambda k: F.coalesce(m[k], F.lit(0)).alias
    docs = table(spark, d, "documents").filter("text <> ''").select("doc_id", speech.category_counts("text").alias("m"))
    return docs.select("doc_id", n("Lu")("upper"), n("Ll")("lower"), n("Nd")("digits"))


@query(r"""SELECT event_id, array_to_string(list_filter([CASE WHEN event_type <> 'click' THEN 'tool' END, CASE WHEN NOT contains(props, '7') THEN 'missing: 7' END, CASE WHEN event_id % 2 = 0 AND NOT contains(props, '1') THEN 'clarification' END], lambda x: x IS NOT NULL), ';') AS problems FROM events""")
def capability_cases(spark, d):
    clarify = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", F.array_join(rules.case_problems(F.col("event_type"), F.lit("click"), F.col("props"), F.array(F.lit("7")), clarify), ";").alias("problems"))


@query("""WITH w AS (SELECT p_partkey AS b, p_partkey - row_number() OVER (ORDER BY p_partkey) AS g FROM part WHERE p_partkey > 0 AND p_size % 3 <> 0),
i AS (SELECT b, row_number() OVER (PARTITION BY g ORDER BY b) AS n FROM w) SELECT b AS member, b - 1 AS keeper FROM i WHERE n % 2 = 1""")
def greedy_members(spark, d):
    """Chains of neighbours: every second unit is absorbed by the one before it."""
    pairs = table(spark, d, "part").filter("p_partkey > 0 and p_size % 3 <> 0").select((F.col("p_partkey") - 1).alias("left_id"), F.col("p_partkey").alias("right_id"))
    return corpus.greedy_clusters(pairs)


@query(r"""SELECT doc_id FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) >= 40""")
def long_enough(spark, d):
    return table(spark, d, "documents").filter(F.length(tx.collapse(F.col("text"))) >= 40).select("doc_id")


@query("""SELECT item_id, doc_id FROM (SELECT p_partkey AS item_id, p_size AS doc_id, p_partkey % 2 = 0 AND p_name LIKE '%ring%' OR p_partkey % 3 = 0 AS hit FROM part) WHERE hit""")
def typed_hits(spark, d):
    """Hits that can answer for a quantity: flagged, or with a number in the answer."""
    from talkgrain.operators import retrieval

    answer = F.when((F.col("p_partkey") % 2 == 0) & F.contains("p_name", F.lit("ring")), "about 12,5 of them").otherwise("some")
    h = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("doc_id"), answer.alias("answer"), F.create_map(F.lit("answers_quantity"), F.col("p_partkey") % 3 == 0).alias("m"))
    return retrieval.of_type(h, "quantity", F.col("m")).select("item_id", "doc_id")
