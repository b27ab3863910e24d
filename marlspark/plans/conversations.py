"""Conversation queries. The driver's table has roles user, assistant and system, and no tool blocks; a system message is
neither a user's nor an assistant's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import conversation as C
from .registry import query, table

TOK = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END"
GROUPS = "s AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN role = 'user' AND trim(text) <> '' THEN 1 ELSE 0 END AS st FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS grp FROM s)"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


@query("c1_prompt_rounds", f'WITH {GROUPS} SELECT conv_id, turn, grp AS "group" FROM g')
def c1(spark: SparkSession, sf: str) -> DataFrame:
    return C.rounds(_messages(spark, sf)).select("conv_id", "turn", "group")


@query("c2_without_oldest", f"WITH {GROUPS}, n AS (SELECT *, max(grp) OVER (PARTITION BY conv_id) + 1 AS n FROM g), k AS (SELECT * FROM n WHERE n >= 2 AND grp >= least(greatest(1, n // 5), n - 1)) SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AND role = 'assistant' THEN '{C.RETRY_MARKER}' END AS marker FROM k")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return C.without_oldest(_messages(spark, sf)).select("conv_id", "turn", "marker")


@query("c3_micro_compact", f"WITH r AS (SELECT conv_id, turn, text, role = 'assistant' AS compactable FROM conversations), k AS (SELECT *, compactable AND row_number() OVER (PARTITION BY conv_id, compactable ORDER BY turn DESC) > 1 AS cleared FROM r) SELECT conv_id, turn, cleared, CASE WHEN cleared THEN {TOK} ELSE 0 END AS saved FROM k")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    r = _messages(spark, sf).select("conv_id", "turn", F.col("text").alias("content"), (F.col("role") == "assistant").alias("compactable"))
    return C.micro_compacted(r, keep=1).select("conv_id", "turn", "cleared", F.col("saved").cast("long").alias("saved"))


LONG = "m AS (SELECT conv_id % 7 AS conv_id, conv_id * 1000 + turn AS turn, role, text || text || text || text AS text FROM conversations)"
COLL = r"CASE WHEN length(text) > 2400 THEN regexp_replace(substr(text, 1, 900), '\s+$', '') || chr(10) || '...[collapsed ' || (length(text) - 1400) || ' chars]...' || chr(10) || regexp_replace(right(text, 500), '^\s+', '') ELSE text END"


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).selectExpr("conv_id % 7 conv_id", "conv_id * 1000 + turn turn", "role", "concat(text, text, text, text) text")


@query("c4_collapse", f"WITH {LONG}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM m), c AS (SELECT *, CASE WHEN back > 12 THEN {COLL} ELSE text END AS t2 FROM b), t AS (SELECT *, sum({TOK}) OVER (PARTITION BY conv_id) AS a, sum({TOK.replace('text', 't2')}) OVER (PARTITION BY conv_id) AS z FROM c) SELECT conv_id, turn, md5(t2) AS text_md5 FROM t WHERE n > 14 AND floor(z * 4 / 3) < floor(a * 4 / 3)")
def c4(spark: SparkSession, sf: str) -> DataFrame:
    return C.collapsed(_long(spark, sf)).select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("a9_token_totals", f"SELECT conv_id, CAST(floor(sum({TOK}) * 4 / 3) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return C.token_totals(_messages(spark, sf))


@query("c7_should_compact", f"SELECT conv_id, floor(sum({TOK}) * 4 / 3) >= 1000 - 0 AND conv_id % 5 < 3 AS compact FROM conversations GROUP BY 1")
def c7(spark: SparkSession, sf: str) -> DataFrame:
    window = 1000 + C.RESERVED_OUTPUT + C.BUFFER
    return C.should_compact(C.token_totals(_messages(spark, sf)), F.col("conv_id") % 5, window).select("conv_id", "compact")


@query("c9_memory_lines", rf"WITH {LONG}, l AS (SELECT conv_id, turn, role || ': ' || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160) AS line FROM m), k AS (SELECT *, row_number() OVER w AS k, sum(length(line) + 1) OVER w AS c FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), f AS (SELECT *, min(CASE WHEN k > 1 AND (k > 48 OR c >= 4000) THEN k END) OVER (PARTITION BY conv_id) AS cut FROM k) SELECT conv_id, turn, CASE WHEN k = cut THEN '... earlier context condensed ...' ELSE line END AS line FROM f WHERE cut IS NULL OR k <= cut")
def c9(spark: SparkSession, sf: str) -> DataFrame:
    return C.memory_lines(_long(spark, sf))


@query("c10_summaries", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, coalesce(string_agg(role || ': ' || substr(trim(text), 1, 300), chr(10) ORDER BY turn) FILTER (trim(text) <> ''), '') AS summary FROM b WHERE back <= 3 GROUP BY 1")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return C.summaries(_messages(spark, sf), last=3)


@query("c11_rewind", "WITH u AS (SELECT *, sum(CASE WHEN role = 'user' AND trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - CASE WHEN role = 'user' AND trim(text) <> '' THEN 1 ELSE 0 END AS later FROM conversations) SELECT conv_id, turn FROM u WHERE later >= 1")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    return C.rewound(_messages(spark, sf), 1).select("conv_id", "turn")


@query("c12_attachments", r"WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS v FROM conversations), f AS (SELECT conv_id, v, min(turn) AS first FROM w GROUP BY ALL) SELECT conv_id, v, first FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY first, v) <= 6")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    found = _messages(spark, sf).select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("v"))
    return C.first_distinct(found, "conv_id", "v", "turn", 6).drop("rank")


@query("c13_next_phase", "WITH v AS (SELECT user_id, event_id, event_type AS sig, CASE event_id % 7 WHEN 0 THEN 'pass' WHEN 1 THEN 'blocked' ELSE 'fail' END AS verdict, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT event_id, CASE verdict WHEN 'pass' THEN 'done' WHEN 'blocked' THEN 'failed' ELSE CASE WHEN p = sig THEN 'replan' ELSE 'repair' END END AS next_phase FROM v")
def c13(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "events").withColumn("verdict", F.expr("CASE event_id % 7 WHEN 0 THEN 'pass' WHEN 1 THEN 'blocked' ELSE 'fail' END"))
    return C.next_phases(v, "user_id", "event_id", "event_type").select("event_id", "next_phase")


@query("c14_repeats", "WITH l AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS n FROM events), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM l) SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1 AS repeated FROM i")
def c14(spark: SparkSession, sf: str) -> DataFrame:
    return C.repeats(table(spark, sf, "events"), "user_id", "event_id", "event_type").select("event_id", F.col("repeated").cast("long").alias("repeated"))


@query("k9_offload", "SELECT doc_id, length(text) > 16000 AS spilled, md5(CASE WHEN length(text) > 16000 THEN substr(text, 1, 3000) ELSE text END) AS shown_md5 FROM documents")
def k9(spark: SparkSession, sf: str) -> DataFrame:
    return C.offloaded(table(spark, sf, "documents"), "text").select("doc_id", "spilled", F.md5("shown").alias("shown_md5"))


@query("k8_transcript", "SELECT conv_id, md5(string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations GROUP BY 1")
def k8(spark: SparkSession, sf: str) -> DataFrame:
    return C.transcript(_messages(spark, sf)).select("conv_id", F.md5("markdown").alias("markdown_md5"))


@query("m14_tool_calls", "SELECT user_id, event_type, arg_max(event_id, event_id) AS id, '{\"n\":' || count(*) || '}' AS arguments FROM events GROUP BY ALL")
def m14(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    sizes = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    f = e.join(sizes, ["user_id", "event_type"]).select("user_id", "event_type", F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.lit("tool").alias("name"), F.when(F.col("event_id") == F.col("last"), F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit("}"))).otherwise("").alias("arguments"))
    return C.assembled_calls(f, ["user_id", "event_type"], "seq").select("user_id", "event_type", F.col("id").cast("long").alias("id"), "arguments")


@query("m21_replies", "SELECT conv_id, trim(string_agg(text, '' ORDER BY turn)) AS reply FROM conversations WHERE role = 'assistant' GROUP BY 1 HAVING trim(string_agg(text, '' ORDER BY turn)) <> ''")
def m21(spark: SparkSession, sf: str) -> DataFrame:
    parts = _messages(spark, sf).filter("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return parts.select("conv_id", F.trim(F.array_join(F.transform("p", lambda r: r["text"]), "")).alias("reply")).filter("reply <> ''")


@query("m7_buffered_body", "SELECT user_id, CASE WHEN count(*) = 1 THEN max(event_type) ELSE string_agg(user_id || ': ' || event_type, chr(10) ORDER BY event_id) END AS body FROM events GROUP BY 1")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    lines = F.array_join(F.transform("e", lambda r: F.concat(F.col("user_id").cast("string"), F.lit(": "), r["event_type"])), "\n")
    return got.select("user_id", F.when(F.size("e") == 1, F.col("e")[0]["event_type"]).otherwise(lines).alias("body"))


# a piece's end within the first 2001 characters: the last line end, else the last space, else 2000
REACH = "substr(rest, 1, 2001)"
PIECES = f"""RECURSIVE s AS (SELECT doc_id, -1 AS part, CAST(NULL AS VARCHAR) AS piece, text AS rest FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, part + 1, CASE WHEN length(rest) <= 2000 THEN rest WHEN p = '' THEN substr(rest, 1, 2000) ELSE p END,
    CASE WHEN length(rest) <= 2000 THEN '' ELSE regexp_replace(substr(rest, 1 + CASE WHEN p = '' THEN 2000 ELSE e END), '^\\s+', '') END
FROM (SELECT *, regexp_replace(substr(rest, 1, e), '\\s+$', '') AS p FROM (SELECT doc_id, part, rest, CASE WHEN strpos(reverse({REACH}), chr(10)) BETWEEN 1 AND 2000 THEN 2001 - strpos(reverse({REACH}), chr(10)) WHEN strpos(reverse({REACH}), ' ') BETWEEN 1 AND 2000 THEN 2001 - strpos(reverse({REACH}), ' ') ELSE 2000 END AS e FROM s WHERE rest <> '')))"""


@query("m1_split_message", f"WITH {PIECES} SELECT doc_id, part, md5(piece) AS piece_md5 FROM s WHERE part >= 0")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return C.message_parts(table(spark, sf, "documents").select("doc_id", "text"), "text", 2000).select("doc_id", "part", F.md5("piece").alias("piece_md5"))


# Events as messages with blocks, by event_id % 4: an assistant's tool use, a user's result for the message before, an
# assistant's turn without content, a user's text with a result for no use.
BLOCKS = "b AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, event_id % 4 AS kind, CASE WHEN event_id % 4 = 0 THEN event_id END AS use, CASE event_id % 4 WHEN 1 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) WHEN 3 THEN -1 END AS res FROM events)"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    kind, before = F.col("event_id") % 4, F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    block = lambda **k: F.struct(*[F.coalesce(k[c].cast("string"), F.lit("none")).alias(c) if c in k else F.lit(None).cast("string").alias(c) for c in ("type", "text", "id", "name", "tool_use_id", "content")], F.lit(None).cast("boolean").alias("is_error"))
    use = F.array(block(type=F.lit("tool_use"), id=F.col("event_id"), name=F.lit("grep")))
    said = F.array(block(type=F.lit("text"), text=F.lit("hi")), block(type=F.lit("tool_result"), tool_use_id=F.lit(-1)))
    blocks = F.when(kind == 0, use).when(kind == 1, F.array(block(type=F.lit("tool_result"), tool_use_id=before))).when(kind == 2, F.array(block(type=F.lit("text"), text=F.lit(" ")))).otherwise(said)
    return table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "assistant").otherwise("user").alias("role"), blocks.alias("blocks"))


@query("c6_sanitized", f"WITH {BLOCKS}, r AS (SELECT *, lead(kind) OVER w AS nk, lead(res) OVER w AS nr, lag(kind) OVER w AS pk, lag(use) OVER w AS pu FROM b WHERE kind <> 2 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, 1 AS n_blocks FROM r WHERE (kind = 0 AND nk = 1 AND nr = use) OR (kind = 1 AND pk = 0 AND res = pu) OR kind = 3")
def c6(spark: SparkSession, sf: str) -> DataFrame:
    return C.sanitized(_blocks(spark, sf), "user_id", "event_id").select("user_id", "event_id", F.size("blocks").alias("n_blocks"))


@query("c5_recent", f"WITH {BLOCKS}, r AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n, coalesce(kind = 1 AND lag(kind) OVER w = 0 AND res = lag(use) OVER w, false) AS pair FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), t AS (SELECT *, max(k) FILTER (NOT pair AND k <= greatest(0, n - 6)) OVER (PARTITION BY user_id) AS edge FROM r) SELECT user_id, event_id, k >= edge AS recent FROM t")
def c5(spark: SparkSession, sf: str) -> DataFrame:
    return C.recent(_blocks(spark, sf), 6, "user_id", "event_id").select("user_id", "event_id", "recent")


CUT = COLL.replace("text", "micro")
CASCADE = rf"""{LONG}, m1 AS (SELECT *, role = 'assistant' AS tool, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) AS newest, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM m),
m2 AS (SELECT *, CASE WHEN tool AND newest > 5 THEN '{C.CLEARED}' ELSE text END AS micro FROM m1), m3 AS (SELECT *, CASE WHEN back > 12 THEN {CUT} ELSE micro END AS short FROM m2),
m4 AS (SELECT *, max(CASE WHEN tool AND newest > 5 THEN 1 ELSE 0 END) OVER v AS cleared, floor(sum({TOK}) OVER v * 4 / 3) AS t0, floor(sum({TOK.replace('text', 'micro')}) OVER v * 4 / 3) AS t1, floor(sum({TOK.replace('text', 'short')}) OVER v * 4 / 3) AS t2 FROM m3 WINDOW v AS (PARTITION BY conv_id)),
m5 AS (SELECT *, n > 14 AND t2 < t1 AS shrinks, CASE WHEN t0 < LIMIT_ THEN 'none' WHEN cleared = 1 AND t1 < LIMIT_ THEN 'micro' WHEN n > 14 AND t2 < t1 AND t2 < LIMIT_ THEN 'collapse' WHEN n > 16 THEN 'memory' ELSE 'summary' END AS step FROM m4),
o AS (SELECT conv_id, turn, role, CASE WHEN shrinks THEN short ELSE micro END AS text FROM m5 WHERE step = 'memory' AND back > 12),
l AS (SELECT conv_id, turn, role || ': ' || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160) AS line FROM o), k AS (SELECT *, row_number() OVER w AS k, sum(length(line) + 1) OVER w AS c FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), f AS (SELECT *, min(CASE WHEN k > 1 AND (k > 48 OR c >= 4000) THEN k END) OVER (PARTITION BY conv_id) AS cut FROM k),
mem AS (SELECT conv_id, min(turn) AS turn, string_agg(CASE WHEN k = cut THEN '{C.STOP_LINE}' ELSE line END, chr(10) ORDER BY turn) AS text FROM f WHERE cut IS NULL OR k <= cut GROUP BY 1)
SELECT conv_id, turn, step, md5(CASE step WHEN 'none' THEN text WHEN 'micro' THEN micro WHEN 'collapse' THEN short ELSE CASE WHEN shrinks THEN short ELSE micro END END) AS text_md5 FROM m5 WHERE step <> 'memory' OR back <= 12 UNION ALL SELECT conv_id, turn, 'memory', md5(text) FROM mem"""


def _cascade(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    m = _long(spark, sf).withColumn("compactable", F.col("role") == "assistant")
    return C.cascade(m, limit).select("conv_id", "turn", "step", F.md5("text").alias("text_md5"))


@query("c8_cascade_micro", f"WITH {CASCADE}".replace("LIMIT_", "170000"))
def c8(spark: SparkSession, sf: str) -> DataFrame:
    """A limit that clearing tool results gets some conversations under."""
    return _cascade(spark, sf, 170_000)


@query("c8_cascade_memory", f"WITH {CASCADE}".replace("LIMIT_", "20000"))
def c8m(spark: SparkSession, sf: str) -> DataFrame:
    """A limit for which most conversations need memory lines."""
    return _cascade(spark, sf, 20_000)


@query("x40_extraction_records", "SELECT event_id, 'memory' AS kind FROM events WHERE event_id % 4 <> 0")
def x40(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.expr("""if(event_id % 4 = 0, 'none', concat('{"records":[{"title":"', event_type, '","body":"b"},{"title":""}]}'))""")
    got = F.from_json(reply, "records array<struct<title:string,body:string,type:string>>")["records"]
    kept = F.filter(F.slice(got, 1, 3), lambda r: (r["title"] != "") & (r["body"] != ""))
    return table(spark, sf, "events").select("event_id", F.explode(kept).alias("r")).select("event_id", F.coalesce("r.type", F.lit("memory")).alias("kind"))


@query("x41_coercions", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS n FROM events")
def x41(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", F.coalesce(raw.try_cast("long"), F.lit(7).cast("long")).alias("n"))


@query("x30_model_cost", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE round(sum(length(text)) * CASE conv_id % 3 WHEN 1 THEN 3.0 ELSE 15.0 END / 1000000, 6)::DOUBLE END AS cost FROM conversations GROUP BY 1")
def x30(spark: SparkSession, sf: str) -> DataFrame:
    model = F.expr("CASE conv_id % 3 WHEN 1 THEN 'small-1' WHEN 2 THEN 'large-2' ELSE 'other' END")
    price = F.when(model.startswith("small-"), 3.0).when(model.startswith("large-"), 15.0)
    n = _messages(spark, sf).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    return n.select("conv_id", F.round(F.col("n") * price / 1000000, 6).alias("cost"))


@query("x39_selectors", "SELECT event_id, 'a,b' AS names FROM events")
def x39(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.expr("""CASE event_id % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '{"paths":["a","b"]}' ELSE 'a\n b \n' END""")
    as_list = F.from_json(reply, "array<string>")
    as_paths = F.from_json(reply, "paths array<string>")["paths"]
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    names = F.when(reply.startswith("["), as_list).when(reply.startswith("{"), as_paths).otherwise(lines)
    return table(spark, sf, "events").select("event_id", F.array_join(names, ",").alias("names"))


@query("x38_notification", "SELECT event_id, event_type AS kind, user_id AS n FROM events")
def x38(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.expr("concat('<task><kind>', event_type, '</kind><n>', user_id, '</n></task>')")
    tag = lambda t: F.regexp_extract(xml, f"(?s)<{t}>(.*?)</{t}>", 1)
    return table(spark, sf, "events").select("event_id", tag("kind").alias("kind"), tag("n").try_cast("long").alias("n"))


