"""Queries of the text functions over documents, pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table


def _q(s: str) -> str:
    return s.replace("'", "''")


TOKENS = f"list_transform(regexp_extract_all(text, '{T.CODE_TOKEN}'), lambda x: lower(x))"


@query("x1_code_tokens", f"SELECT doc_id, len({TOKENS}) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS tokens_md5 FROM documents")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", T.code_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("x17_keyterms", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{T.KEYTERM}'), lambda x: lower(x)))), ' ') AS terms FROM documents")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.keyterms(F.col("text")), " ").alias("terms"))


@query("x18_memory_tokens", f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '{T.MEMORY_WORD}'), lambda x: length(x) >= 3) || regexp_extract_all(text, '{T.HAN}'))) AS n_tokens FROM documents")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.memory_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("x19_preview_tokens", r"SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9_/-]+'), lambda x: regexp_replace(x, '^[-_/]+|[-_/]+$', '', 'g')), lambda x: length(x) >= 2 AND x NOT IN ('the', 'and', 'for')))) AS n_tokens FROM documents")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.preview_tokens(F.col("text"), ("the", "and", "for"))).cast("long").alias("n_tokens"))


PLAN_SQL = r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS o FROM documents),
a AS (SELECT doc_id, o, list_distinct(regexp_extract_all(o, '\b[A-Z][A-Za-z0-9_]*(?:Error|Exception)\b')) AS e,
  list_distinct(regexp_extract_all(o, '\b(?:[A-Za-z_][A-Za-z0-9_-]*/)+[A-Za-z_][A-Za-z0-9_-]*\.py\b') || regexp_extract_all(o, '\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){2,}\b')) AS p,
  regexp_extract_all(o, '`([A-Za-z_][A-Za-z0-9_.]*)`', 1) AS q, regexp_extract_all(o, '\b[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+\b') AS c,
  regexp_extract_all(o, '\b[A-Za-z_][A-Za-z0-9_]*\b') AS i FROM t)
SELECT doc_id, len(e) AS n_errors, len(p) AS n_paths, len(list_distinct(list_filter(q || c || i, lambda x: (contains(x, '_') OR list_contains(q, x) OR list_contains(c, x)) AND NOT list_contains(p, x) AND NOT list_contains(e, x)))) AS n_identifiers, md5(o) AS original_md5 FROM a
"""


@query("x2_query_plan", PLAN_SQL)
def x2(spark: SparkSession, sf: str) -> DataFrame:
    d = T.query_plan(table(spark, sf, "documents").select("doc_id", "text"), "text")
    n = lambda c: F.size(c).cast("long")
    return d.select("doc_id", n("errors").alias("n_errors"), n("paths").alias("n_paths"), n("identifiers").alias("n_identifiers"), F.md5("original").alias("original_md5"))


X11 = "lower(text)"
for _pattern, _mask in T.MASKS:
    X11 = f"regexp_replace({X11}, '{_pattern}', '{_mask}', 'g')"


@query("x11_failure_signature", rf"SELECT page_id, sha256(trim(regexp_replace({X11.replace('lower(text)', 'lower(html)')}, '\s+', ' ', 'g'))) AS signature FROM pages")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.failure_signature(F.col("html")).alias("signature"))


FAILURE_TEXT = "CASE event_id % 9 WHEN 0 THEN 'Test timed out' WHEN 1 THEN 'PermissionError: no' WHEN 2 THEN 'SyntaxError: bad' WHEN 3 THEN 'error collecting x' WHEN 4 THEN 'No module named y' WHEN 5 THEN 'FAILED test_a' WHEN 6 THEN 'timeout' WHEN 7 THEN 'boom' ELSE 'AssertionError' END"
CATEGORY_SQL = f"""CASE WHEN user_id % 7 = 0 THEN 'passed' WHEN contains(lower({FAILURE_TEXT}), 'timed out') OR lower({FAILURE_TEXT}) = 'timeout' THEN 'timeout'
 WHEN contains(lower({FAILURE_TEXT}), 'permissionerror') THEN 'permission' WHEN contains(lower({FAILURE_TEXT}), 'syntaxerror') THEN 'syntax' WHEN contains(lower({FAILURE_TEXT}), 'error collecting') THEN 'collection'
 WHEN contains(lower({FAILURE_TEXT}), 'no module named') THEN 'dependency' WHEN contains(lower({FAILURE_TEXT}), 'assertionerror') OR contains(lower({FAILURE_TEXT}), 'failed ') THEN 'assertion' ELSE 'internal' END"""


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("failure", F.expr(FAILURE_TEXT)).withColumn("category", T.failure_category(F.col("failure"), F.col("user_id") % 7))


@query("x12_failure_category", f"SELECT event_id, {CATEGORY_SQL} AS category, {CATEGORY_SQL} IN ('timeout', 'provider', 'structured_output') AS retryable FROM events")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    return _failures(spark, sf).select("event_id", "category", F.col("category").isin("timeout", "provider", "structured_output").alias("retryable"))


@query("x13_recovery", f"""
WITH f AS (SELECT event_id, {CATEGORY_SQL} AS c, CASE event_id % 5 WHEN 0 THEN 'plan' WHEN 1 THEN 'execute' WHEN 2 THEN 'verify' WHEN 3 THEN 'repair' ELSE 'analyze' END AS p, event_id % 11 = 0 AS r, CASE WHEN event_id % 13 = 0 THEN 'token_budget_exhausted' END AS x FROM events)
SELECT event_id, CASE WHEN x IS NOT NULL THEN 'stop' WHEN c = 'permission' THEN 'stop' WHEN r THEN 'replan' WHEN c = 'timeout' THEN 'retry' WHEN c = 'syntax' AND p IN ('execute', 'repair') THEN 'repair' WHEN c = 'assertion' AND p = 'verify' THEN 'repair' ELSE 'stop' END AS action,
 CASE WHEN x IS NOT NULL OR c = 'permission' THEN NULL WHEN r THEN 'replan' WHEN c = 'timeout' THEN p WHEN c = 'syntax' AND p IN ('execute', 'repair') THEN 'repair' WHEN c = 'assertion' AND p = 'verify' THEN 'repair' END AS next_phase,
 CASE WHEN x IS NOT NULL THEN x WHEN c = 'permission' THEN 'unsafe_permission' WHEN r OR c = 'timeout' OR (c = 'syntax' AND p IN ('execute', 'repair')) OR (c = 'assertion' AND p = 'verify') THEN NULL ELSE 'unrecoverable_' || c END AS terminal_reason FROM f
""")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    phase = F.expr("CASE event_id % 5 WHEN 0 THEN 'plan' WHEN 1 THEN 'execute' WHEN 2 THEN 'verify' WHEN 3 THEN 'repair' ELSE 'analyze' END")
    r = T.recovery(F.col("category"), phase, F.col("event_id") % 11 == 0, F.when(F.col("event_id") % 13 == 0, "token_budget_exhausted"))
    return _failures(spark, sf).select("event_id", r.alias("r")).select("event_id", "r.action", "r.next_phase", "r.terminal_reason")


SECRET_HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{_q(p)}') THEN '{n}' END" for n, p in T.SECRETS)


@query("x15_secrets", f"SELECT doc_id, array_to_string(list_filter([{SECRET_HITS}], lambda x: x IS NOT NULL), ',') AS rules FROM documents")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.found_secrets(F.col("text")), ",").alias("rules"))


X14 = rf"regexp_replace(regexp_replace(regexp_replace(text, '{T.ASSIGNED_SECRET}', '\1\2[REDACTED]', 'g'), '{T.BEARER_SECRET}', 'Bearer [REDACTED]', 'g'), '{T.PREFIXED_SECRET}', '[REDACTED]', 'g')"


@query("x14_redacted", f"SELECT doc_id, md5(CASE WHEN length({X14}) > 4000 THEN substr({X14}, 1, 4000) || '...[TRUNCATED]' ELSE {X14} END) AS redacted_md5 FROM documents")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.redacted(F.col("text"))).alias("redacted_md5"))


FACT_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS type, regexp_replace(trim(unnest(regexp_extract_all(text, '{_q(p)}', 1))), '[.,;:)]+$', '') AS value FROM documents" for k, _, p in T.FACTS
)


@query("x16_facts", f"SELECT DISTINCT doc_id, type || ':' || value AS key, type, value, CAST(0.7 AS DOUBLE) AS confidence FROM ({FACT_SQL}) WHERE length(value) >= 3 AND NOT (type = 'ip_address' AND (starts_with(value, '0.') OR starts_with(value, '255.') OR starts_with(value, '127.0.0.1')))")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.explode(T.facts(F.col("text"))).alias("f"))
    return d.select("doc_id", "f.key", "f.type", "f.value", F.col("f.confidence").cast("double").alias("confidence"))


@query("x20_token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END AS tokens FROM documents")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


COLLAPSED = r"CASE WHEN length({c}) > 2400 THEN regexp_replace(substr({c}, 1, 900), '\s+$', '') || chr(10) || '...[collapsed ' || (length({c}) - 1400) || ' chars]...' || chr(10) || regexp_replace(right({c}, 500), '^\s+', '') ELSE {c} END"


@query("x21_collapsed", f"SELECT doc_id, md5({COLLAPSED.format(c='text')}) AS collapsed_md5 FROM documents")
def x21(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.collapse_text(F.col("text"))).alias("collapsed_md5"))


@query("x24_shorten", r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substr(t, 1, 77), '\s+$', '') || '...' END AS brief FROM t")
def x24(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.shorten(F.col("text"), 80).alias("brief"))


@query("x26_parse_datetime", "SELECT event_id, try_cast(CASE WHEN event_id % 10 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS at FROM events")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    written = F.when(F.col("event_id") % 10 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", F.try_to_timestamp(written).cast("timestamp_ntz").alias("at"))


@query("x27_age_label", "WITH a AS (SELECT event_id, greatest(0, floor((1706745600 - epoch(ts)) / 86400))::BIGINT AS d FROM events) SELECT event_id, d AS days, CASE d WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE d || ' days ago' END AS label FROM a")
def x27(spark: SparkSession, sf: str) -> DataFrame:
    then = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").select("event_id", T.age_days(then, F.lit(1706745600)).alias("days"), T.age_label(then, F.lit(1706745600)).alias("label"))


@query("x29_token_cost", "SELECT l_orderkey, l_linenumber, CAST((CAST(l_quantity * 100 - least(l_suppkey, l_quantity * 100) AS BIGINT) * 300 + CAST(least(l_suppkey, l_quantity * 100) AS BIGINT) * 30 + CAST(l_partkey AS BIGINT) * 1500) AS DOUBLE) / 100000000 AS cost FROM lineitem")
def x29(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("l_quantity") * 100).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.token_cost(n, F.col("l_suppkey"), F.col("l_partkey"), "3.0", "0.3", "15.0").alias("cost"))


@query("x31_stratum", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' END AS difficulty FROM events")
def x31(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("CASE event_id % 4 WHEN 0 THEN '<15 min  fix' WHEN 1 THEN '15 MIN – 1 hour' WHEN 2 THEN ' >4 hours' ELSE 'other' END")
    return table(spark, sf, "events").select("event_id", T.stratum(label).alias("difficulty"))


@query("x32_paths", r"WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '\\', '/', 'g') AS p FROM pages) SELECT page_id, regexp_replace(p, '^(?:[ab]/)', '') AS path, regexp_matches(p, '(^|/)tests?/|(^|/)test_[^/]*$|_test\.py$') AS is_test FROM p")
def x32(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages").select("page_id", T.normal_path(path).alias("path"), T.is_test_path(path).alias("is_test"))


@query("x42_session_key", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'fixed' ELSE event_type || ':' || user_id || CASE WHEN event_id % 3 = 0 THEN ':t' || event_id % 5 ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ':s' || user_id % 4 ELSE '' END END AS session FROM events")
def x42(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    s = lambda x: F.expr(x).cast("string")
    return e.select("event_id", T.session_key(F.when(F.col("user_id") % 10 == 0, "fixed"), F.col("event_type"), s("user_id"), F.when(F.col("event_id") % 3 == 0, s("concat('t', event_id % 5)")).otherwise(""), s("concat('s', user_id % 4)"), F.col("event_id") % 2 == 0).alias("session"))


@query("x43_stable_seed", "SELECT doc_id, substr(sha256('7:' || source), 1, 16) AS hex FROM documents")
def x43(spark: SparkSession, sf: str) -> DataFrame:
    seed = T.stable_seed(F.lit(7), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.lower(F.lpad(F.conv(seed.cast("string"), 10, 16), 16, "0")).alias("hex"))


@query("m13_script_majority", r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z]')) = 0 THEN NULL WHEN len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) >= len(regexp_extract_all(text, '[A-Za-z]')) THEN 'cjk' ELSE 'latin' END AS script FROM documents")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.script_majority(F.col("text")).alias("script"))


@query("m15_without_thoughts", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("<think>a\nb</think>"), F.col("text"), F.lit("<think></think>"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.without_thoughts(marked)).alias("text_md5"))


@query("m19_json_object", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS found FROM events")
def m19(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE event_id % 3 WHEN 0 THEN concat('Here: ```json\n', props, '\n``` done') WHEN 1 THEN concat('It is ', props, ' so') ELSE 'none {' END")
    return table(spark, sf, "events").select("event_id", T.json_object(text).alias("found"))


@query("m20_last_chars", "SELECT doc_id, md5(right(text, 12000)) AS tail_md5 FROM documents")
def m20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.last_chars(F.col("text"), 12000)).alias("tail_md5"))


@query("d2_memory_signature", r"SELECT doc_id, sha256(trim(translate(regexp_replace(lower(text), '\s+', ' ', 'g'), '" + _q(T.PUNCTUATION) + "', '')) || '|' || lower(lang) || '|' || lower(source)) AS signature FROM documents")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.memory_signature(F.col("text"), F.col("lang"), F.col("source")).alias("signature"))


@query("d5_fingerprint", "SELECT page_id, 'page:' || substr(sha1(CASE WHEN page_id % 2 = 0 THEN url ELSE url || chr(10) || html END), 1, 16) AS fingerprint FROM pages")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.lit(" "))
    return table(spark, sf, "pages").select("page_id", T.fingerprint(F.lit("page"), ref, F.col("url"), F.col("html")).alias("fingerprint"))


@query("d12_chunk_id", "SELECT doc_id, substr(sha256(source || ':1:' || n_chars || '::' || text), 1, 20) AS chunk_id FROM documents")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.chunk_id(F.col("source"), F.lit(1), F.col("n_chars"), F.lit(""), F.col("text")).alias("chunk_id"))


@query("f3_grep", "WITH l AS (SELECT source AS path, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT path || '/' || doc_id || ':' || line || ':' || t AS hit FROM l WHERE regexp_matches(t, '(?i)licen[sc]e|password') ORDER BY path, doc_id, line LIMIT 200")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scan import grep

    files = table(spark, sf, "documents").select(F.col("source").alias("path"), "doc_id", "text")
    hits = grep(files, "licen[sc]e|password", ["path", "doc_id"], case_sensitive=False, limit=200)
    return hits.select(F.concat_ws(":", F.concat_ws("/", "path", "doc_id"), "line", "text").alias("hit"))


@query("s13_read_lines", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE NOT contains(text, chr(0))) SELECT doc_id, line, md5(t) AS line_md5 FROM l WHERE line > 2 AND line <= 5")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scan import line_slice

    out = line_slice(table(spark, sf, "documents").select("doc_id", "text"), offset=2, limit=3)
    return out.select("doc_id", F.col("line").cast("long").alias("line"), F.md5("text").alias("line_md5"))


@query("f11_tool_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al')")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scan import search_names

    return search_names(table(spark, sf, "part"), "AL", ["p_name", "p_type"]).select("p_partkey", "p_name")


@query("f12_file_list", "SELECT url, n FROM (SELECT url, count(*) OVER () AS n FROM (SELECT DISTINCT url FROM pages WHERE contains(lower(url), 'blog'))) ORDER BY url LIMIT 30")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scan import list_files

    return list_files(table(spark, sf, "pages").select("url").distinct(), "url", "Blog", 30)


@query("s12_glob", r"SELECT url FROM pages WHERE regexp_matches(url, '^https://.*\.example\.com/.*$') ORDER BY url, page_id LIMIT 100")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scan import glob_paths

    return glob_paths(table(spark, sf, "pages"), "url", "https://*.example.com/*", 100, ["page_id"]).select("url")
