"""Queries of the stateful stream operators in their batch form; tests/test_streams.py holds streams against the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import seen, settle, turns
from .registry import query, table

VISIBLE = r"regexp_replace(split_part(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '<think>', 1), '<(t(h(i(n(k)?)?)?)?)?$', '')"


@query("m15_stream_text", f"WITH m AS (SELECT doc_id, text[:30 + doc_id % 40] || '<think>a<b</think>' || text[31 + doc_id % 40:] || CASE doc_id % 3 WHEN 0 THEN '<thi' WHEN 1 THEN '<think>never over' ELSE '' END AS t FROM documents) SELECT doc_id, md5({VISIBLE}) AS text_md5 FROM m WHERE {VISIBLE} <> ''")
def m15s(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a thought, and ends that wait for more, in chunks of 47 characters: what is shown of them."""
    at = 30 + F.col("doc_id") % 40
    marked = F.concat(F.substr("text", F.lit(1), at), F.lit("<think>a<b</think>"), F.substr("text", at + 1), F.when(F.col("doc_id") % 3 == 0, "<thi").when(F.col("doc_id") % 3 == 1, "<think>never over").otherwise(""))
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.regexp_extract_all(marked, F.lit("(?s).{1,47}"), F.lit(0))).alias("seq", "text"), F.lit(False).alias("done"))
    shown = turns.visible_text(chunks).groupBy(F.col("key").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "visible"))).alias("v"))
    return shown.select("doc_id", F.md5(F.array_join(F.col("v.visible"), "")).alias("text_md5"))


TURNS = r"""e AS (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS turn FROM events),
x AS (SELECT user_id, turn, string_agg(CASE event_id % 6 WHEN 0 THEN '<think>' WHEN 1 THEN 'no</think>' ELSE event_type || ' ' END, '' ORDER BY event_id) AS t FROM e GROUP BY ALL HAVING bool_or(event_type = 'purchase')),
c AS (SELECT user_id, turn, event_id % 3 AS i, max(event_id) FILTER (event_id % 2 = 0) AS id, arg_max('tool' || event_id % 7, event_id) FILTER (event_id % 5 = 0) AS name, string_agg((event_id % 10)::VARCHAR, '' ORDER BY event_id) AS a FROM e WHERE event_id % 4 < 3 GROUP BY ALL),
s AS (SELECT user_id, turn, string_agg(i || ':' || coalesce(id::VARCHAR, '') || ':' || name || ':' || CASE WHEN regexp_matches(a, '^(0|[1-9][0-9]*)$') THEN a ELSE '{}' END, ';' ORDER BY i) AS calls FROM c WHERE name IS NOT NULL GROUP BY ALL)"""


@query("m14_turns", f"WITH {TURNS} SELECT user_id AS key, turn, {VISIBLE} AS text, coalesce(calls, '') AS calls FROM x LEFT JOIN s USING (user_id, turn)")
def m14t(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as deltas, with text, thoughts and fragments of up to three calls; a purchase ends a turn."""
    n = F.col("event_id")
    text = F.when(n % 6 == 0, "<think>").when(n % 6 == 1, "no</think>").otherwise(F.concat("event_type", F.lit(" ")))
    deltas = table(spark, sf, "events").select(
        F.col("user_id").alias("key"), n.alias("seq"), text.alias("text"), F.when(n % 4 < 3, n % 3).cast("int").alias("index"), F.when(n % 2 == 0, n.cast("string")).otherwise("").alias("id"),
        F.when(n % 5 == 0, F.concat(F.lit("tool"), (n % 7).cast("string"))).alias("name"), (n % 10).cast("string").alias("arguments"), (F.col("event_type") == "purchase").alias("done"),
    )
    calls = F.transform("calls", lambda c: F.concat_ws(":", c["index"].cast("string"), c["id"], c["name"], c["arguments"]))
    return turns.turns(deltas).select("key", "turn", "text", F.array_join(calls, ";").alias("calls"))


@query("m21_turn_replies", r"WITH c AS (SELECT *, CAST(coalesce(sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM conversations), r AS (SELECT conv_id AS key, n AS turn, regexp_replace(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END, '' ORDER BY c.turn), '^\s+|\s+$', '', 'g') AS reply FROM c GROUP BY conv_id, n HAVING bool_or(role <> 'assistant')) SELECT * FROM r WHERE reply <> ''")
def m21t(spark: SparkSession, sf: str) -> DataFrame:
    """What the assistant said until somebody else's message, trimmed and joined."""
    own = F.col("role") == "assistant"
    none = F.lit(None).cast("string")
    deltas = table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.when(own, F.col("text")).otherwise("").alias("text"), F.lit(None).cast("int").alias("index"), none.alias("id"), none.alias("name"), none.alias("arguments"), (~own).alias("done"))
    return turns.replies(turns.turns(deltas))


@query("d10_bounded_ids", "WITH RECURSIVE o AS (SELECT event_type AS k, user_id AS id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), r AS (SELECT k, n, event_id, true AS fresh, [id] AS seen FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, o.event_id, NOT list_contains(r.seen, o.id), CASE WHEN list_contains(r.seen, o.id) THEN r.seen ELSE list_append(list_slice(r.seen, greatest(1, len(r.seen) - 38), len(r.seen)), o.id) END FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1) SELECT k AS event_type, event_id FROM r WHERE fresh")
def d10b(spark: SparkSession, sf: str) -> DataFrame:
    """Of each type the events of users that aren't among the last 40 new ones."""
    return seen.unseen(table(spark, sf, "events").select("event_type", "event_id", "user_id"), "event_type", "user_id", "event_id", 40).select("event_type", "event_id")


DAYS = 86_400_000


@query("g9_settled", f"""WITH o AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'pending' END AS state, event_id % 3 AS checks FROM events),
w AS (SELECT *, min(ms) OVER (PARTITION BY key) AS start_ms, lead(ms) OVER x AS until_ms, min(CASE WHEN checks > 0 THEN ms END) OVER (PARTITION BY key ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM o WINDOW x AS (PARTITION BY key ORDER BY ms, event_id)),
k AS (SELECT *, CASE WHEN checks > 0 AND state = 'failed' THEN 1 WHEN checks > 0 AND state = 'success' AND seen + {DAYS} // 2 <= start_ms + 3 * {DAYS} THEN 2 WHEN checks = 0 THEN 3 ELSE 4 END AS rule FROM w),
c AS (SELECT *, greatest(ms, CASE rule WHEN 1 THEN ms WHEN 2 THEN seen + {DAYS} // 2 WHEN 3 THEN start_ms + {DAYS} ELSE start_ms + 3 * {DAYS} END) AS e FROM k),
f AS (SELECT key, arg_min(e, (ms, event_id)) AS ms, arg_min(rule, (ms, event_id)) AS rule FROM c WHERE until_ms IS NULL OR e <= until_ms GROUP BY key)
SELECT key, ms, CASE WHEN rule IN (2, 3) THEN 'success' ELSE 'failed' END AS state, CASE rule WHEN 1 THEN '{settle.FAILED}' WHEN 2 THEN '{settle.SUCCESS}' WHEN 3 THEN '{settle.NONE}' ELSE '{settle.LATE}' END AS summary FROM f""")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as snapshots: settled after half a day, absent after one, timed out after three."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("pending")
    snapshots = table(spark, sf, "events").orderBy("event_id").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), state.alias("state"), (F.col("event_id") % 3).cast("int").alias("checks"))
    got = settle.settled(snapshots, timeout=3 * 86_400, grace=86_400, settle=43_200, poll=3600)
    return got.select("key", F.unix_millis("at").alias("ms"), "state", "summary")
