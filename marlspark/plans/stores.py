"""Mailboxes, sessions, hooks, previews, reports and further stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from ..operators import conversation as C
from ..operators import evaluation as E
from ..operators import records as R
from ..operators import retrieval as Q
from ..operators import stats as S
from .evaluation import PAIRS, _pairs
from .registry import query, table


@query("s8_mailbox_unread", "SELECT event_id FROM events WHERE user_id = 5 AND event_id % 2 = 1 ORDER BY ts, event_id")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("user_id = 5 and event_id % 2 = 1").orderBy("ts", "event_id").select("event_id")


@query("s9_pending_permissions", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'error'").orderBy("ts", "event_id").limit(100).select("event_id")


@query("s10_sessions", "WITH f AS (SELECT conv_id, min(CASE WHEN role = 'user' AND trim(text) <> '' THEN turn END) AS t, max(turn) AS last FROM conversations GROUP BY 1) SELECT f.conv_id, last, substr(trim(c.text), 1, 80) AS summary FROM f LEFT JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.t ORDER BY last DESC, f.conv_id LIMIT 20")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.struct("turn", "text"))
    got = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.min(said).alias("first"))
    return got.select("conv_id", "last", F.substring(F.trim("first.text"), 1, 80).alias("summary")).orderBy(F.desc("last"), "conv_id").limit(20)


@query("s16_issue_labels", "SELECT p_partkey, array_to_string(string_split(p_type, ' '), ',') AS labels FROM part")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.to_json(F.struct(F.transform(F.split("p_type", " "), lambda x: F.struct(x.alias("name"))).alias("labels")))
    names = F.transform(F.from_json(payload, "labels array<struct<name:string>>")["labels"], lambda x: x["name"])
    return table(spark, sf, "part").select("p_partkey", F.array_join(names, ",").alias("labels"))


@query("s15_vector_cache", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id").join(wanted, "vec_id", "left_semi")


@query("s14_duplicate_ids", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("f10_hooks", "SELECT event_id, h AS hook FROM events CROSS JOIN (VALUES ('all', '%'), ('clicks', 'click%'), ('views', '%view%')) v(h, p) WHERE event_type LIKE p")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scan import glob_pattern

    hooks = [("all", None), ("clicks", "click*"), ("views", "*view*")]
    hit = lambda g: F.lit(True) if g is None else F.col("event_type").rlike(glob_pattern(g))
    found = F.filter(F.array(*[F.when(hit(g), n) for n, g in hooks]), lambda x: x.isNotNull())
    return table(spark, sf, "events").select("event_id", F.explode(found).alias("hook"))


@query("f1_public_columns", "SELECT doc_id, lang FROM documents")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang")


@query("j7_unknown_keys", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return E.pending(table(spark, sf, "lineitem").select("l_orderkey").distinct(), known, "l_orderkey")


@query("j16_tool_results", "SELECT o_orderkey AS conv, l_linenumber AS turn, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("id", F.monotonically_increasing_id().cast("string"))
    block = lambda **k: F.struct(*[F.lit(k.get(c)).cast("string").alias(c) if not hasattr(k.get(c), "alias") else k[c].alias(c) for c in ("type", "text", "id", "name", "tool_use_id", "content")], F.lit(None).cast("boolean").alias("is_error"))
    m = rows.select(F.col("l_orderkey").alias("conv"), F.col("l_linenumber").alias("turn"), F.array(block(type="tool_use", id=F.col("id"), name="t"), block(type="tool_result", tool_use_id=F.col("id"), content=F.col("l_returnflag"))).alias("blocks"))
    got = C.tool_results(m, "conv", "turn")
    return got.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("conv")), "conv").select("conv", "turn", F.col("content").alias("l_returnflag"))


@query("a14_symbol_counts", "SELECT source, CAST(sum(len(regexp_extract_all(text, '[A-Z][a-z]+'))) AS BIGINT) AS symbols FROM documents GROUP BY 1")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(n).alias("symbols"))


@query("a15_rules_by_type", "SELECT user_id, event_type, '### ' || event_type || chr(10) || string_agg('- ' || event_id, chr(10) ORDER BY event_id) AS section FROM events GROUP BY user_id, event_type")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    """The facts of each owner, a section per type."""
    items = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: F.concat(F.lit("- "), x.cast("string")))
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.concat(F.lit("### "), "event_type", F.lit("\n"), F.array_join(items, "\n")).alias("section"))


@query("a17_ordered_distinct", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS v FROM documents) SELECT doc_id, count(DISTINCT v) AS n FROM w GROUP BY 1")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).cast("long").alias("n"))
    return d.filter("n > 0")


@query("w11_expansion", "WITH a AS (SELECT p_partkey AS id, 0 AS s, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS p FROM part WHERE p_size < 5), b AS (SELECT p_partkey AS id, 1 AS s, row_number() OVER (ORDER BY p_partkey) AS p FROM part WHERE p_size < 9) SELECT id, s AS stream, p AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, p) AS r FROM (SELECT * FROM a WHERE p <= 48 UNION ALL SELECT * FROM b WHERE p <= 48)) WHERE r = 1 ORDER BY s, p, id LIMIT 12")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    got = Q.expanded([(p.filter("p_size < 5"), [F.desc("p_retailprice"), F.col("id")]), (p.filter("p_size < 9"), [F.col("id")])], "id")
    return got.withColumn("place", F.col("place").cast("long"))


@query("w9_symbol_recall", "WITH r AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 10 AS sym, l_linenumber AS rank FROM lineitem), f AS (SELECT q, sym, min(rank) AS f FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY f, sym) AS rank FROM f), g AS (SELECT q, max(3) AS n FROM f GROUP BY 1) SELECT q, sum(CASE WHEN rank <= 5 AND sym IN (1, 2, 3) THEN 1 ELSE 0 END) / max(n) AS recall_5 FROM k JOIN g USING (q) GROUP BY 1")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import metrics as M

    r = table(spark, sf, "lineitem").selectExpr("l_orderkey q", "l_partkey % 10 sym", "l_linenumber rank").distinct()
    gold = r.select("q").distinct().withColumn("sym", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])))
    return M.measured(M.judged(M.file_ranks(r, "q", "sym", "rank"), gold, "q", "sym"), "q").select("q", "recall_5")


@query("w20_preview_candidates", "SELECT p_partkey, CAST(CASE WHEN contains(lower(p_name || ' ' || p_type), 'steel') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_name || ' ' || p_type), 'small') THEN 5 ELSE 0 END AS BIGINT) AS score FROM part WHERE contains(lower(p_name || ' ' || p_type), 'steel') OR contains(lower(p_name || ' ' || p_type), 'small') ORDER BY 2 DESC, p_name, p_partkey LIMIT 5")
def w20(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.preview_tokens(F.lit("Small steel"))
    hay = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    score = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.when(F.contains(hay, t), F.least(F.lit(8), F.greatest(F.lit(2), F.length(t)))).otherwise(0))
    named = F.when(F.contains(F.lit("small steel"), F.lower(F.col("p_name"))), 10).otherwise(0)
    rows = table(spark, sf, "part").withColumn("score", (score + named).cast("long")).filter("score >= 4")
    return rows.orderBy(F.desc("score"), "p_name", "p_partkey").limit(5).select("p_partkey", "score")


@query("w23_recent_files", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 4")
def w23(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(4).select("doc_id")


@query("u1_candidate_union", "SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT vec_id FROM embeddings WHERE label = 3")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("lang = 'fr'").select("doc_id").union(table(spark, sf, "embeddings").filter("label = 3").select("vec_id")).distinct()


@query("d3_soft_delete", "SELECT c_custkey, c_custkey = (SELECT min(c_custkey) FROM customer WHERE contains(c_name, '7')) AS disabled FROM customer")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    first = c.filter(F.col("c_name").contains("7")).agg(F.min("c_custkey").alias("hit"))
    return c.join(F.broadcast(first)).select("c_custkey", (F.col("c_custkey") == F.col("hit")).alias("disabled"))


@query("d11_migration", "SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, 'memory') AS type, coalesce(CASE WHEN event_id % 4 > 0 THEN user_id END, 0) AS importance, event_id % 3 = 0 OR event_id % 4 = 0 AS changed FROM events")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("type"), F.when(F.col("event_id") % 4 > 0, F.col("user_id")).alias("importance"))
    changed = F.col("type").isNull() | F.col("importance").isNull()
    return old.select("event_id", F.coalesce("type", F.lit("memory")).alias("type"), F.coalesce("importance", F.lit(0).cast("long")).alias("importance"), changed.alias("changed"))


@query("x10_render_chunk", "SELECT doc_id, md5('path: ' || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'symbol: s' || doc_id || chr(10) ELSE '' END || text) AS rendered_md5 FROM documents")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    symbol = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("symbol: s"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.concat_ws("\n", F.concat(F.lit("path: "), "source"), symbol, "text")).alias("rendered_md5"))


# texts as index files: three times over, with a line end, so that some break either limit
INDEX = "concat(text, '\n', text, '\n', text, '\n')"
ENTRY = """d AS (SELECT doc_id, text || chr(10) || text || chr(10) || text || chr(10) AS raw FROM documents), l AS (SELECT doc_id, raw, string_split(raw[:-2], chr(10)) AS l FROM d), h AS (SELECT *, array_to_string(l[1:200], chr(10)) AS head FROM l),
b AS (SELECT doc_id, unnest(string_split(head, '')) AS ch, unnest(generate_series(1, length(head))) AS k FROM h WHERE strlen(head) > 25000), r AS (SELECT doc_id, k, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY k) AS bytes FROM b), f AS (SELECT doc_id, max(k) AS k FROM r WHERE bytes <= 25000 GROUP BY 1),
c AS (SELECT h.*, substr(head, 1, k) AS cut FROM h LEFT JOIN f USING (doc_id)), e AS (SELECT *, CASE WHEN cut IS NULL THEN head WHEN strpos(reverse(cut), chr(10)) BETWEEN 1 AND length(cut) - 1 THEN substr(cut, 1, length(cut) - strpos(reverse(cut), chr(10))) ELSE cut END AS body FROM c)
SELECT doc_id, cut IS NOT NULL OR len(l) > 200 AS truncated, md5(CASE WHEN cut IS NULL AND len(l) <= 200 THEN body || chr(10) ELSE regexp_replace(body, '\\s+$', '') || chr(10) || chr(10) || '> WARNING: MEMORY.md is ' || CASE WHEN cut IS NOT NULL THEN strlen(raw) || ' bytes (limit: 25000)' ELSE len(l) || ' lines (limit: 200)' END || '. Only part of it was loaded. Keep index entries one line and move detail into topic notes.' || chr(10) END) AS content_md5 FROM e"""


@query("x25_entrypoint", f"WITH {ENTRY}")
def x25(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "documents").select("doc_id", P.truncated_entrypoint(F.expr(INDEX)).alias("e"))
    return got.select("doc_id", "e.truncated", F.md5("e.content").alias("content_md5"))


@query("m2_safe_filename", "SELECT page_id, substr(trim(regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), 1, 128) AS name FROM pages")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", P.safe_filename(F.col("url")).alias("name"))


@query("m8_nested_mentions", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat_ws(';', '@1/Ann//u' || user_id || '/', CASE WHEN user_id % 3 <> 0 THEN '/' || event_type || '/o' || event_id || '//x' || user_id END, CASE WHEN user_id <> 0 THEN '///' || user_id || '/' END) ELSE '' END AS found FROM events")
def m8(spark: SparkSession, sf: str) -> DataFrame:
    listed = """'"mentions":[{"key":"@1","name":" Ann","id":{"user_id":"u', user_id, '"}},{"key":null},7]'"""
    nested = """'"c":[[{"tag":"at","user_name":"', event_type, '","open_id":"o', event_id, '","id":{"open_id":"z","union_id":"x', user_id, '"}}],{"tag":"b"}]'"""
    twice = """'"d":{"e":[{"tag":"at","user_id":', user_id, '},{"tag":"at","user_id":', user_id, '}]}'"""
    payload = F.expr(f"case when event_id % 2 = 1 then 'no json' when user_id % 3 = 0 then concat('{{', {listed}, ',', {twice}, '}}') else concat('{{', {listed}, ',', {nested}, ',', {twice}, '}}') end")
    record = lambda r: F.concat_ws("/", *[r[k] for k in P.MENTION])
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(P.mention_records(payload), record), ";").alias("found"))


SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("m12_text_preview", f"SELECT doc_id, doc_id % 5 <> 0 AS is_text, CASE WHEN doc_id % 5 <> 0 THEN md5(CASE WHEN length({SQUEEZED}) > 900 THEN substr({SQUEEZED}, 1, 897) || '...' ELSE {SQUEEZED} END) END AS preview_md5 FROM documents")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth document as bytes that are no UTF-8."""
    data = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE")))).otherwise(F.col("text").cast("binary"))
    return table(spark, sf, "documents").select("doc_id", P.is_text(data).alias("is_text"), F.md5(P.previews(data)).alias("preview_md5"))


@query("t7_comparisons", f"WITH {PAIRS}, g AS (SELECT comparison, list(diff ORDER BY diff) AS d FROM d GROUP BY 1), m AS (SELECT comparison, d, unnest(range(CAST(1 << len(d) AS BIGINT))) AS mask FROM g WHERE len(d) <= 20), pv AS (SELECT comparison, avg(CASE WHEN abs(list_sum(list_transform(d, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN x ELSE -x END))) / len(d) + 1e-12 >= abs(list_sum(d)) / len(d) THEN 1 ELSE 0 END) AS p FROM m GROUP BY 1), r AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, comparison) + 1) * p) AS x FROM pv) SELECT comparison, p, max(x) OVER (ORDER BY p, comparison ROWS UNBOUNDED PRECEDING) AS adjusted FROM r")
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return S.holm(S.permutation_exact(_pairs(spark, sf), ["comparison"], "diff"), "p", ["comparison"]).drop("pairs")


@query("k5_report_rows", "SELECT '| ' || o_orderstatus || ' | ' || count(*) || ' |' AS line FROM orders GROUP BY o_orderstatus")
def k5(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.format_string("| %s | %d |", "o_orderstatus", "n").alias("line"))


@query("k6_sealed_rows", "SELECT s_suppkey, sha256('{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}') AS sha256 FROM supplier")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import sealed

    return sealed(table(spark, sf, "supplier"), ["s_suppkey", "s_name"]).select("s_suppkey", "sha256")


@query("k3_prediction_lines", "SELECT o_orderkey, '{\"instance_id\":\"' || o_orderkey || '\",\"model_name_or_path\":\"m\",\"model_patch\":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '\"+' || o_orderpriority || '\"' END || '}' AS line FROM orders")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import PREDICTION

    o = table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderkey as string) instance_id", "'m' model_name_or_path", "if(o_orderstatus = 'P', null, concat('+', o_orderpriority)) model_patch")
    return o.select("o_orderkey", F.to_json(F.struct(*PREDICTION), {"ignoreNullFields": "false"}).alias("line"))


@query("s17_search_results", "SELECT page_id, 'Title ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'https://x.org/' || page_id ELSE 'https://y.org' END AS url, 'some & text' AS snippet FROM pages")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    """Result pages of a search, one result each, half of them behind a redirect."""
    from ..functions.code import flat

    href = "if(page_id % 2 = 0, concat('//d.com/l/?uddg=https%3A%2F%2Fx.org%2F', page_id, '&amp;r=1'), 'https://y.org')"
    page = F.expr(f"""concat('<a class="result__a" href="', {href}, '">Title <b>', page_id, '</b></a><a class="result__snippet">some &amp; text</a>')""")
    rows = table(spark, sf, "pages").select("page_id", page.alias("page"))
    return flat(rows, lambda p: iter(P.search_results(p)), ["page"], "title string, url string, snippet string", ["page_id"])


@query("f4_memory_filter", "SELECT event_id FROM events WHERE contains(lower(event_type || ' ' || props), 'click')")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    hits = R.token_hits(T.memory_tokens(F.lit("click to")), F.lower(F.concat_ws(" ", "event_type", "props")))
    return table(spark, sf, "events").filter(hits > 0).select("event_id")
