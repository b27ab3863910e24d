"""Evaluation queries: orders, line items and events stand for observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import stats as S
from .registry import query, table

OBS = "o AS (SELECT o_orderkey AS instance_id, o_orderpriority AS difficulty, o_orderstatus AS arm, o_orderkey % 10 <> 0 AS attempted, o_orderkey % 3 <> 0 AS completed, o_custkey % 4 = 0 AS resolved, o_custkey % 5 <> 0 AS scope_compliant, o_custkey AS total_tokens, o_totalprice AS duration_seconds FROM orders)"


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey instance_id", "o_orderpriority difficulty", "o_orderstatus arm", "o_orderkey % 10 <> 0 attempted", "o_orderkey % 3 <> 0 completed", "o_custkey % 4 = 0 resolved", "o_custkey % 5 <> 0 scope_compliant", "o_custkey total_tokens", "o_totalprice duration_seconds")


@query("a1_outcome_by_strategy", "SELECT l_returnflag AS strategy, count(*) AS runs, CAST(sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS verified, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) / count(*) AS success_rate, quantile_cont(l_quantity, 0.5) AS median_duration, CAST(sum(l_partkey) AS BIGINT) AS tokens, round(sum(CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_linenumber AS DOUBLE) END), 4) AS cost, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) / count(*) AS scope_rate FROM lineitem GROUP BY 1")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "strategy")
    cost = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber").cast("double"))
    return E.by_strategy(rows, "strategy", F.col("l_linenumber") == 1, "l_quantity", F.col("l_partkey"), cost, F.col("l_linestatus") == "O")


@query("a1_failure_histogram", "SELECT l_returnflag, array_to_string(list(l_linestatus || '=' || n ORDER BY l_linestatus), ',') AS histogram FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_linestatus <> '' GROUP BY ALL) GROUP BY 1")
def a1h(spark: SparkSession, sf: str) -> DataFrame:
    h = E.histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus")
    return h.select("l_returnflag", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("histogram"))


@query("a2_outcome_grouping_sets", f"WITH {OBS} SELECT arm, difficulty, CAST(sum(attempted::INT) AS BIGINT) AS attempted, CAST(sum(completed::INT) AS BIGINT) AS completed, CAST(sum(resolved::INT) AS BIGINT) AS resolved, sum(resolved::INT) / sum(attempted::INT) AS resolution_rate, sum(scope_compliant::INT) / sum(attempted::INT) AS scope_rate, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, quantile_cont(duration_seconds, 0.5) AS median_duration FROM o GROUP BY GROUPING SETS ((arm), (arm, difficulty))")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return E.outcome_sets(_observations(spark, sf), "arm", "difficulty")


@query("a3_task_success", f"WITH {OBS} SELECT total_tokens AS task, avg(resolved::INT) AS success FROM o WHERE attempted GROUP BY 1")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return E.task_success(_observations(spark, sf).withColumnRenamed("total_tokens", "task"), "task", "resolved", "attempted")


@query("a4_localization_means", "SELECT o_orderpriority AS difficulty, count(*) AS n, round(avg(o_custkey), 6) AS o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY GROUPING SETS ((), (o_orderpriority))")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderpriority", "difficulty")
    return E.means(rows, "difficulty", ["o_custkey"])


@query("a10_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("a11_status_board", "SELECT s AS status, k AS place, count(c_custkey) AS n, coalesce(array_to_string((list(c_name ORDER BY c_acctbal DESC, c_custkey) FILTER (c_custkey IS NOT NULL))[1:20], ','), '') AS items FROM (VALUES (0, 'BUILDING'), (1, 'NONE'), (2, 'MACHINERY')) v(k, s) LEFT JOIN customer ON c_mktsegment = s GROUP BY ALL")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "status")
    b = E.status_board(rows, "status", ["BUILDING", "NONE", "MACHINERY"], [F.desc("c_acctbal"), F.col("c_custkey")], F.col("c_name"))
    return b.select("status", "place", "n", F.array_join("items", ",").alias("items"))


CHECKS = "c AS (SELECT l_orderkey AS pr, l_linenumber AS ordinal, 'check' || l_linenumber AS name, CASE l_suppkey % 9 WHEN 0 THEN 'QUEUED' ELSE 'COMPLETED' END AS status, CASE l_partkey % 5 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'SKIPPED' ELSE 'SUCCESS' END AS conclusion FROM lineitem)"


@query("a12_check_rollup", f"WITH {CHECKS}, s AS (SELECT pr, CASE WHEN bool_or(status = 'QUEUED') THEN 'pending' WHEN bool_or(conclusion = 'FAILURE') THEN 'failed' ELSE 'success' END AS state, list(name || '=' || conclusion ORDER BY ordinal, name || '=' || conclusion) FILTER (conclusion = 'FAILURE') AS bad FROM c GROUP BY 1) SELECT pr, state, CASE WHEN state = 'failed' THEN array_to_string(bad[1:4], '; ') END AS summary FROM s")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").selectExpr("l_orderkey pr", "l_linenumber ordinal", "concat('check', l_linenumber) name", "if(l_suppkey % 9 = 0, 'QUEUED', 'COMPLETED') status", "case l_partkey % 5 when 0 then 'FAILURE' when 1 then 'SKIPPED' else 'SUCCESS' end conclusion")
    return E.check_rollup(c, "pr")


@query("a13_suite_result", "WITH c AS (SELECT l_orderkey AS run, l_linenumber AS ordinal, 'c' || l_linenumber || '_' || l_partkey AS name, l_partkey % 4 <> 0 AS passed, l_suppkey % 3 <> 0 AS required FROM lineitem) SELECT run, bool_and(passed OR NOT required) AS passed, coalesce(array_to_string(list(name ORDER BY ordinal, name) FILTER (NOT passed), ','), '') AS failed, (list(name ORDER BY ordinal, name) FILTER (NOT passed))[1] AS first_failure FROM c GROUP BY 1")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").selectExpr("l_orderkey run", "l_linenumber ordinal", "concat('c', l_linenumber, '_', l_partkey) name", "l_partkey % 4 <> 0 passed", "l_suppkey % 3 <> 0 required")
    return E.suite_result(c, "run").withColumn("failed", F.array_join("failed", ","))


@query("a16_run_batches", "SELECT o_orderstatus AS arm, o_orderkey % 3 AS repetition, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, bit_xor(o_orderkey) AS keys_xor FROM orders GROUP BY ALL")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Pending runs by arm and repetition; what a batch holds is told by numbers that tasks add up, not by a list."""
    rows = table(spark, sf, "orders").selectExpr("o_orderstatus arm", "o_orderkey % 3 repetition", "o_orderkey")
    return rows.groupBy("arm", "repetition").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.bit_xor("o_orderkey").alias("keys_xor"))


@query("a18_quantile", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    got = S.exact_quantiles(table(spark, sf, "events"), ["event_type"], "value", {"low": 0.025, "high": 0.975})
    return got.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("j10_smallest_span", "WITH p AS (SELECT l_suppkey AS f, l_orderkey % 1000 AS line FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), s AS (SELECT DISTINCT l_suppkey AS f, l_partkey % 900 AS lo, l_partkey % 900 + l_quantity::INT AS hi FROM lineitem) SELECT f, line, lo, hi FROM p JOIN s USING (f) WHERE line BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY f, line ORDER BY hi - lo, lo DESC) = 1")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    points = items.filter("l_linenumber = 1").selectExpr("l_suppkey f", "l_orderkey % 1000 line").distinct()
    spans = items.selectExpr("l_suppkey f", "l_partkey % 900 lo", "l_partkey % 900 + cast(l_quantity as int) hi").distinct()
    return E.smallest_span(points, spans, "f", "line", "lo", "hi")


@query("j11_run_matrix", "SELECT s_suppkey, arm, repetition, s_suppkey || '::' || arm || '::' || repetition AS run_key FROM supplier CROSS JOIN (VALUES ('native'), ('full')) a(arm) CROSS JOIN range(1, 4) r(repetition)")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    return E.run_matrix(table(spark, sf, "supplier").select("s_suppkey"), ["native", "full"], 3).withColumn("repetition", F.col("repetition").cast("long"))


@query("j12_pending_runs", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return E.pending(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("j13_resolved_flag", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS resolved FROM orders")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left").select("o_orderkey", F.col("hit").isNotNull().alias("resolved"))


@query("j6_unmatched_keys", "SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return E.unmatched(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("j18_snapshot_diff", "WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 = 0) SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id)")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    after = d.filter("doc_id % 11 <> 0 or doc_id % 7 = 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("h")))
    return E.snapshot_diff(d.filter("doc_id % 7 <> 0"), after, "doc_id", "h")


@query("u2_key_difference", "SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").subtract(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("u3_intersection", "SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderstatus = 'P'").select("o_custkey"))


PAIRS = "p AS (SELECT user_id // 10 AS comparison, user_id, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS c, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS b FROM events GROUP BY ALL), d AS (SELECT *, round(c - b, 6) AS diff FROM p WHERE c IS NOT NULL AND b IS NOT NULL)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.expr("user_id div 10").alias("comparison"), "user_id")
    p = e.agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("c"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return p.filter("c is not null and b is not null").withColumn("diff", F.round(F.col("c") - F.col("b"), 6))


@query("t2_permutation_exact", f"WITH {PAIRS}, g AS (SELECT comparison, list(diff ORDER BY diff) AS d FROM d GROUP BY 1), m AS (SELECT comparison, d, unnest(range(CAST(1 << len(d) AS BIGINT))) AS mask FROM g WHERE len(d) <= 20) SELECT comparison, max(len(d)) AS pairs, avg(CASE WHEN abs(list_sum(list_transform(d, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN x ELSE -x END))) / len(d) + 1e-12 >= abs(list_sum(d)) / len(d) THEN 1 ELSE 0 END) AS p FROM m GROUP BY 1")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return S.permutation_exact(_pairs(spark, sf), ["comparison"], "diff")


@query("t2_permutation_test", f"WITH {PAIRS}, g AS (SELECT comparison, list(diff ORDER BY diff) AS d FROM d GROUP BY 1), m AS (SELECT comparison, d, unnest(range(CAST(1 << least(len(d), 20) AS BIGINT))) AS mask FROM g) SELECT comparison, max(len(d)) AS pairs, max(len(d)) <= 20 AS exact, CASE WHEN max(len(d)) <= 20 THEN avg(CASE WHEN abs(list_sum(list_transform(d, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN x ELSE -x END))) / len(d) + 1e-12 >= abs(list_sum(d)) / len(d) THEN 1 ELSE 0 END) END AS p FROM m GROUP BY 1")
def t2b(spark: SparkSession, sf: str) -> DataFrame:
    """Both branches in one operator; the p of a larger comparison is drawn, and a test holds it against the generator."""
    got = S.permutation_test(_pairs(spark, sf), "comparison", "user_id", "diff", iterations=5000)
    return got.withColumn("p", F.when(F.col("exact"), F.col("p")))


@query("j8_missing_gold", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    return E.missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


WORKFLOW = "s AS (SELECT l_orderkey AS run, l_linenumber AS step, l_returnflag AS phase, CASE WHEN l_linestatus = 'O' THEN 'done' ELSE l_linestatus END AS next_phase, 'd' || l_suppkey AS detail, CASE WHEN l_partkey % 3 = 0 THEN 'why' || l_partkey END AS reason FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_linestatus) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k, count(*) OVER (PARTITION BY run) AS n FROM s)"


@query("c15_workflow_events", f"WITH {WORKFLOW} SELECT run, 0 AS ordinal, 'run_started' AS kind, phase, NULL AS data FROM k WHERE k = 1 UNION ALL SELECT run, k * 4 - 3, 'phase_started', phase, NULL FROM k UNION ALL SELECT run, k * 4 - 2, 'phase_finished', phase, detail FROM k UNION ALL SELECT run, k * 4 - 1, 'transition', phase, phase || '>' || next_phase || coalesce('>' || reason, '') FROM k UNION ALL SELECT run, k * 4, 'checkpoint_saved', next_phase, NULL FROM k UNION ALL SELECT run, n * 4 + 1, 'run_finished', next_phase, coalesce(reason, '') FROM k WHERE k = n")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")).alias("r"))
    steps = steps.selectExpr("run", "step", "r.l_returnflag phase", "if(r.l_linestatus = 'O', 'done', r.l_linestatus) next_phase", "concat('d', r.l_suppkey) detail", "if(r.l_partkey % 3 = 0, concat('why', r.l_partkey), null) reason")
    return E.workflow_events(steps, "run", "step")


@query("t4_mcnemar", f"WITH {PAIRS}, w AS (SELECT comparison, count(*) FILTER (c > 51 AND b <= 51) AS wins, count(*) FILTER (c <= 51 AND b > 51) AS losses FROM d GROUP BY 1) SELECT comparison, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda k: factorial(CAST(wins + losses AS INT)) / factorial(CAST(k AS INT)) / factorial(CAST(wins + losses - k AS INT)) / pow(2, wins + losses)))) END, 9) AS p FROM w")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return S.mcnemar(_pairs(spark, sf), ["comparison"], F.col("c") > 51, F.col("b") > 51)


HOLM = "t AS (SELECT p_brand AS brand, p_partkey AS test, round(p_retailprice / 100000, 8) AS p FROM part), r AS (SELECT *, least(1, (count(*) OVER (PARTITION BY brand) - row_number() OVER (PARTITION BY brand ORDER BY p, test) + 1) * p) AS x FROM t)"


@query("t5_holm", f"WITH {HOLM} SELECT brand, test, p, max(x) OVER (PARTITION BY brand ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS adjusted FROM r")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("test"), F.round(F.col("p_retailprice") / 100000, 8).alias("p"))
    return S.holm(t, "p", ["test"], ["brand"])


@query("t6_claim", "SELECT event_id, CASE WHEN value / 1000 < 0.05 AND user_id > 75 AND event_id % 3 = 1 THEN 'significant_improvement' WHEN value / 1000 < 0.05 AND user_id < 20 AND event_id % 3 = 2 THEN 'significant_regression' WHEN event_id % 3 = 1 THEN 'directional_improvement' WHEN event_id % 3 = 2 THEN 'directional_regression' ELSE 'null_or_inconclusive' END AS claim FROM events")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    effect = F.when(F.col("event_id") % 3 == 1, 1).when(F.col("event_id") % 3 == 2, -1).otherwise(0)
    return table(spark, sf, "events").select("event_id", S.claim(F.col("value") / 1000, F.col("user_id") - 75, F.col("user_id") - 20, effect).alias("claim"))


@query("t1_bootstrap")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    return S.bootstrap(_pairs(spark, sf), "comparison", "user_id", "diff", iterations=2000)


@query("t3_permutation_sampled")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return S.permutation_sampled(_pairs(spark, sf), "comparison", "user_id", "diff", iterations=5000)


@query("w14_round_robin_sample", "WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || doc_id)) AS turn, md5(lang || source) AS r, md5('7:' || doc_id) AS h FROM documents) SELECT doc_id, lang, turn, row_number() OVER (PARTITION BY lang ORDER BY turn, r, h) AS place FROM t QUALIFY place <= 15")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    out = S.round_robin(docs, "lang", "source", [F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), F.md5(F.concat("lang", "source"))], 15)
    return out.select("doc_id", "lang", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@query("w15_pilot", "SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def w15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
