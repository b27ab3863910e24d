"""Record-store queries: customers, documents, events and orders stand for records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from .registry import query, table

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


MEM = "m AS (SELECT event_id AS id, event_type AS title, props AS description, event_type || ' ' || user_id AS body, user_id % 3 AS importance, user_id % 9 AS use_count, ts AS updated_at, event_id % 500 AS modified_at FROM events)"
MEMORY = ("event_id id", "event_type title", "props description", "concat(event_type, ' ', user_id) body", "user_id % 3 importance", "user_id % 9 use_count", "ts updated_at", "event_id % 500 modified_at")


@query("w17_memory_ranking", f"""WITH {MEM}, n AS (SELECT * FROM m ORDER BY modified_at DESC, id LIMIT 100), h AS (SELECT *, (SELECT count(*) FROM (VALUES ('purchase'), ('click'), ('the')) q(t) WHERE contains(lower(title || ' ' || description), t)) AS mh, (SELECT count(*) FROM (VALUES ('purchase'), ('click'), ('the')) q(t) WHERE contains(lower(body), t)) AS bh FROM n)
SELECT id, round(mh * 2.0 + bh + importance * 0.4 + least(use_count, 5) * 0.1 + CASE WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(updated_at)) <= 14 * 86400 THEN 0.3 WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(updated_at)) <= 30 * 86400 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM h WHERE mh > 0 OR bh > 0 ORDER BY 2 DESC, modified_at DESC, id LIMIT 5""")
def w17(spark: SparkSession, sf: str) -> DataFrame:
    return R.relevant_memories(table(spark, sf, "events").selectExpr(*MEMORY), "purchase click the", _now()).select("id", F.col("score").cast("double").alias("score"))


@query("f5_expired", f"SELECT event_id, coalesce(user_id % 20 > 0 AND TIMESTAMP '{NOW}' >= ts + to_days(CAST(user_id % 20 AS INT)), false) AS expired FROM events")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", R.expired((F.col("user_id") % 20).cast("int"), F.col("ts"), F.col("ts"), _now()).alias("expired"))


@query("f6_stale", f"WITH {MEM} SELECT id FROM m LEFT JOIN (SELECT event_id AS id, 1 AS u FROM events WHERE event_id % 2 = 0) USING (id) WHERE importance <= 1 AND u IS NULL AND updated_at <= TIMESTAMP '{NOW}' + INTERVAL 40 DAY - INTERVAL 60 DAY")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    usage = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.lit(1).alias("use_count"))
    return R.stale(e.selectExpr(*MEMORY).drop("use_count"), usage, F.timestamp_add("DAY", F.lit(40), _now())).select("id")


@query("j14_usage_default", "SELECT c_custkey AS id, coalesce(n, 0) AS uses FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    usage = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    return R.with_usage(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), usage)


@query("d1_memory_upsert", "WITH o AS (SELECT c_custkey AS k, c_name AS created, c_nationkey AS importance, 'old' AS body FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, 'new' AS created, 5 AS importance, 'n' || c_custkey AS body FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0) SELECT k, coalesce(o.created, n.created) AS created, CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL THEN greatest(o.importance, 1) ELSE coalesce(n.importance, o.importance) END AS importance, coalesce(n.body, o.body) AS body FROM o FULL JOIN n USING (k)")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    old = c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey k", "c_name created", "c_nationkey importance", "'old' body")
    new = c.filter("c_custkey % 2 = 0 or c_custkey % 3 = 0").selectExpr("c_custkey k", "'new' created", "5 importance", "concat('n', c_custkey) body")
    return R.upserted(old, new, "k", ["created"], ("importance", 1))


@query("d4_mark_used", "SELECT user_id, count(*) AS use_count, max(ts) AS last_used FROM events GROUP BY 1")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("use_count"), F.max("ts").alias("last_used"))


@query("d7_checkpoint_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("d6_keyed_replace", "SELECT c_name AS name, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 1 THEN 'b' ELSE 'a' END AS v FROM customer")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return R.replaced(c.filter("c_custkey % 3 <> 1").selectExpr("c_name name", "'a' v"), c.filter("c_custkey % 4 = 0 or c_custkey % 3 = 1").selectExpr("c_name name", "'b' v"), ["name"])


@query("k7_insert_ignore", "SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS v FROM customer")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return R.inserted(c.filter("c_custkey % 3 = 0").selectExpr("c_name name", "'a' v"), c.selectExpr("c_name name", "'b' v"), ["name"])


@query("d8_merge_facts", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC, event_id DESC) = 1")
def d8(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "value", F.floor(F.col("value") / 10).alias("confidence"))
    return R.merged_facts(e, "user_id", "confidence", "event_id").drop("confidence")


@query("d9_retention", "SELECT event_id FROM events WHERE 1706745600 - (1706745600 - event_id * 7 % 9000) < 3600")
def d9(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("at", 1706745600 - F.col("event_id") * 7 % 9000)
    return R.retained(e, "at", F.lit(1706745600)).select("event_id")


@query("d10_dedup_ids", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("s7_last_history", "SELECT event_id FROM (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 50) ORDER BY 1")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    return R.last_rows(table(spark, sf, "events").filter("event_type = 'click'").select("event_id"), ["event_id"], 50)


@query("m3_between_dates", "SELECT event_id FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-09' ORDER BY ts DESC, event_id DESC LIMIT 20")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return R.between_last(table(spark, sf, "events"), "ts", stamp("2024-01-05"), stamp("2024-01-09"), 20, ["ts", "event_id"]).select("event_id")


@query("f8_list_by_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderstatus = 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey")


@query("f7_jobs_due", "SELECT event_id FROM events WHERE user_id % 3 <> 0 AND event_id % 10 <> 0 AND ts <= TIMESTAMP '2024-01-15'")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    written = F.when(F.col("event_id") % 10 == 0, "never").otherwise(F.col("ts").cast("string"))
    jobs = table(spark, sf, "events").withColumn("next_run", F.try_to_timestamp(written))
    return jobs.filter((F.col("user_id") % 3 != 0) & (F.col("next_run") <= F.lit("2024-01-15").cast("timestamp"))).select("event_id")


CARD_SQL = """CASE k WHEN 'direct_request' THEN 110 WHEN 'manual_idea' THEN 90 WHEN 'issue' THEN 75 WHEN 'pull_request' THEN 85 ELSE 50 END
 + CASE WHEN k = 'issue' AND user_id % 4 = 0 THEN 25 ELSE 0 END + CASE WHEN k = 'issue' AND event_type = 'error' THEN 15 ELSE 0 END + CASE WHEN k = 'pull_request' AND user_id % 5 = 0 THEN -30 ELSE 0 END
 + CASE WHEN k = 'pull_request' AND user_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN k = 'pull_request' AND user_id % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN user_id % 7 = 0 THEN 20 ELSE 0 END + greatest(0, 10 - user_id % 15)"""


@query("w18_card_priority", f"WITH c AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'direct_request' WHEN 1 THEN 'manual_idea' WHEN 2 THEN 'issue' WHEN 3 THEN 'pull_request' ELSE 'x' END AS k FROM events) SELECT event_id, CAST({CARD_SQL} AS BIGINT) AS score FROM c")
def w18(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN 'direct_request' WHEN 1 THEN 'manual_idea' WHEN 2 THEN 'issue' WHEN 3 THEN 'pull_request' ELSE 'x' END")
    labels = F.expr("array(if(user_id % 4 = 0, 'Bug', 'a'), if(user_id % 7 = 0, 'P0', 'b'))")
    score = R.card_score(kind, F.col("event_type"), labels, F.col("user_id") % 5 == 0, F.when(F.col("user_id") % 2 == 0, "clean"), F.when(F.col("user_id") % 3 == 0, "approved"), (F.col("user_id") % 15).cast("double"))
    return table(spark, sf, "events").select("event_id", score.alias("score"))


@query("w19_status_order", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50")
def w19(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, sf, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey")


@query("f9_permission", "SELECT event_id, CASE WHEN contains(props, '13') THEN 'deny:sensitive' WHEN event_type = 'error' THEN 'deny:tool' WHEN event_type = 'click' THEN 'allow:tool' WHEN user_id % 5 = 0 THEN 'deny:path' WHEN user_id % 2 = 0 THEN 'allow:read_only' ELSE 'confirm' END AS decision FROM events")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rules = [("deny:sensitive", F.col("props").contains("13")), ("deny:tool", F.col("event_type") == "error"), ("allow:tool", F.col("event_type") == "click"), ("deny:path", F.col("user_id") % 5 == 0), ("allow:read_only", F.col("user_id") % 2 == 0)]
    return e.select("event_id", R.first_rule(e, rules, "confirm").alias("decision"))


@query("f17_budget", "SELECT event_id, CASE WHEN value >= 100 THEN 'wall_clock_budget_exhausted' WHEN event_id % 3 = 0 AND user_id % 10 >= 8 THEN 'phase_call_budget_exhausted' WHEN event_id % 3 = 0 AND user_id % 4 >= 3 THEN 'repair_budget_exhausted' WHEN user_id % 7 > 5 THEN 'changed_file_budget_exhausted' WHEN user_id % 6 >= 5 THEN 'repeated_diff_budget_exhausted' WHEN user_id % 11 >= 10 THEN 'repeated_action_budget_exhausted' WHEN user_id % 10 > 0 AND event_id % 13 = 0 THEN 'usage_unavailable' WHEN event_id % 13 <> 0 AND user_id >= 90 THEN 'token_budget_exhausted' END AS reason FROM events")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    use = {k: F.expr(v) for k, v in {"calls": "user_id % 10", "repairs": "user_id % 4", "replans": "0", "files": "user_id % 7", "diffs": "user_id % 6", "actions": "user_id % 11", "tokens": "if(event_id % 13 = 0, null, user_id)"}.items()}
    limit = {k: F.lit(v) for k, v in {"wall": 100, "calls": 8, "repairs": 3, "replans": 2, "files": 5, "diffs": 5, "actions": 10, "tokens": 90}.items()}
    phase = F.when(F.col("event_id") % 3 == 0, "repair").otherwise("verify")
    return table(spark, sf, "events").select("event_id", R.budget_reason(F.col("value"), phase, use, limit).alias("reason"))


@query("f13_required_servers", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: len(list_filter(['a', 'e', 'i'], lambda s: contains(lower(w), s))) > 0)) = len(string_split(p_name, ' ')) AS ok FROM part")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    has = F.forall(F.split("p_name", " "), lambda w: F.exists(F.array(F.lit("a"), F.lit("e"), F.lit("i")), lambda s: F.contains(F.lower(w), s)))
    return table(spark, sf, "part").select("p_partkey", has.alias("ok"))


@query("f14_sessions_touched", "SELECT DISTINCT user_id FROM events WHERE ts > TIMESTAMP '2024-01-29' AND user_id <> 7")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return R.sessions_since(table(spark, sf, "events"), "user_id", "ts", F.lit("2024-01-29").cast("timestamp_ntz"), F.lit(7))


@query("f15_scope_compliance", "SELECT o_orderkey, count(*) = count(*) FILTER (l_shipmode_ok) AS compliant FROM (SELECT l_orderkey AS o_orderkey, l_returnflag IN ('N', 'A') AS l_shipmode_ok FROM lineitem) GROUP BY 1")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("changed"))
    return files.select("o_orderkey", F.forall("changed", lambda p: F.exists(F.array(F.lit("^N$"), F.lit("^A$")), lambda g: F.rlike(p, g))).alias("compliant"))


@query("f16_automerge", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false WHEN user_id % 3 = 0 THEN true ELSE user_id % 5 = 0 END AS eligible FROM events")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.expr("array(if(user_id % 5 = 0, 'automerge', 'x'))")
    ok = F.when(F.col("event_id") % 4 == 0, False).when(F.col("user_id") % 3 == 0, True).otherwise(F.array_contains(labels, "automerge"))
    return table(spark, sf, "events").select("event_id", ok.alias("eligible"))


@query("u5_label_merge", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' ') || string_split(p_type, ' '), lambda x: x <> ''))), ',') AS labels FROM part")
def u5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(R.merged_labels(F.split("p_name", " "), F.split("p_type", " ")), ",").alias("labels"))


@query("u6_override_merge", "SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'plugin' WHEN c_custkey % 3 = 0 THEN 'user' ELSE 'builtin' END AS origin FROM customer")
def u6(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    layer = lambda cond, name: c.filter(cond).select(F.col("c_name").alias("name"), F.lit(name).alias("origin"))
    return R.overridden([layer("true", "builtin"), layer("c_custkey % 3 = 0", "user"), layer("c_custkey % 5 = 0", "plugin")], "name").drop("layer")


@query("w21_hook_order", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC, s_suppkey) AS place FROM supplier")
def w21(spark: SparkSession, sf: str) -> DataFrame:
    """Hooks of an event by priority, then as they were registered; nations stand for events."""
    s = table(spark, sf, "supplier")
    return R.ranked_names(s, [F.desc(F.floor(F.col("s_acctbal") / 1000)), F.col("s_suppkey")], ["s_nationkey"], 1 << 30).select("s_suppkey", F.col("rank").cast("long").alias("place"))


@query("w24_requested_first", "SELECT c_custkey FROM customer LEFT JOIN (SELECT c_custkey, c_custkey % 7 AS pos FROM customer WHERE c_custkey % 20 = 0) USING (c_custkey) ORDER BY pos NULLS LAST, c_acctbal DESC, c_custkey LIMIT 30")
def w24(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    asked = c.filter("c_custkey % 20 = 0").select("c_custkey", (F.col("c_custkey") % 7).alias("position"))
    return R.requested_first(c, asked, "c_custkey", [F.desc("c_acctbal"), F.col("c_custkey")], 30).select("c_custkey")


@query("w22_last_unique", "SELECT user_id, event_type, seen FROM (SELECT user_id, event_type, max(event_id) AS seen FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC) <= 3")
def w22(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("seen"))
    return R.ranked_names(seen, [F.desc("seen")], ["user_id"], 3).drop("rank")


@query("j15_not_surfaced", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("j17_cache_hits", "SELECT doc_id, vec_id IS NOT NULL AS hit FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    cache = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("h"))
    return table(spark, sf, "documents").select("doc_id").join(cache, "doc_id", "left").select("doc_id", F.col("h").isNotNull().alias("hit"))


@query("m11_group_policy", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN event_type = 'click' WHEN 2 THEN user_id < 50 ELSE event_type = 'click' AND user_id < 50 END AS accepted FROM events")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    policy, mention, managed = F.expr("element_at(array('open', 'mention', 'managed', 'both'), cast(user_id % 4 as int) + 1)"), F.col("event_type") == "click", F.col("user_id") < 50
    ok = F.when(policy == "open", True).when(policy == "mention", mention).when(policy == "managed", managed).otherwise(mention & managed)
    return table(spark, sf, "events").select("event_id", ok.alias("accepted"))


@query("m16_board_filter", "SELECT CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'P' THEN 'doing' ELSE 'done' END AS lane, count(*) AS n FROM orders WHERE contains(lower(o_orderkey || ' ' || o_orderpriority || ' ' || o_custkey), 'high') GROUP BY 1")
def m16(spark: SparkSession, sf: str) -> DataFrame:
    lane = F.when(F.col("o_orderstatus") == "O", "todo").when(F.col("o_orderstatus") == "P", "doing").otherwise("done")
    hit = F.lower(F.concat_ws(" ", "o_orderkey", "o_orderpriority", "o_custkey")).contains("high")
    return table(spark, sf, "orders").filter(hit).groupBy(lane.alias("lane")).agg(F.count(F.lit(1)).alias("n"))


@query("m18_pending_tasks", "SELECT o_orderkey, coalesce(MAX(CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_linestatus IS NOT NULL THEN 'open' END), 'missing') AS state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY 1")
def m18(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "done").otherwise("open").alias("s"))
    both = table(spark, sf, "orders").select("o_orderkey").join(tasks, "o_orderkey", "left")
    return both.groupBy("o_orderkey").agg(F.coalesce(F.max("s"), F.lit("missing")).alias("state"))
