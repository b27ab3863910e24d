"""Queries of file sources, sinks and table functions: what one wrote, read back, or what they make of texts built from rows."""

from __future__ import annotations

from datetime import UTC

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import registry as G
from ..sources import files as S
from .registry import query, table


@query("s2_json_lines", "SELECT p_partkey, p_name, p_size FROM part")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    path = S.scratch(spark, "rows")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.json(path)
    return S.json_rows(spark, path, "p_partkey long, p_name string, p_size int")


@query("s4_event_log", "SELECT CASE WHEN event_id % 10 = 0 THEN 'legacy' ELSE event_type END AS kind, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id::VARCHAR END AS run_id, CASE WHEN event_id % 10 = 0 THEN event_id END AS old_id, CASE WHEN event_id % 10 > 0 THEN event_id END AS n FROM events")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log in two parts; every tenth in an older form."""
    path, e = S.scratch(spark, "log"), table(spark, sf, "events")
    new = e.filter("event_id % 10 > 0").selectExpr("1 schema_version", "cast(user_id as string) run_id", "event_type kind", "named_struct('n', event_id) data")
    S.append_events(new, path)
    S.append_events(e.filter("event_id % 10 = 0").select("event_id"), path)
    field = lambda name: F.try_variant_get("data", f"$.{name}", "long")
    return S.event_log(spark, path).select("kind", "run_id", field("event_id").alias("old_id"), field("n").alias("n"))


@query("s6_frontmatter", "SELECT p_partkey, p_name AS name, p_size::VARCHAR AS size, CASE WHEN p_partkey % 2 = 0 THEN p_type || chr(10) ELSE p_type END AS body FROM part")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""concat('---\\nname: ', p_name, '\\n# note: no\\nsize: "', p_size, '"\\n--- \\n', p_type, if(p_partkey % 2 = 0, '\\n', ''))""")
    got = S.frontmatter(table(spark, sf, "part").select("p_partkey", text.alias("t")), "t")
    return got.select("p_partkey", F.col("fields")["name"].alias("name"), F.col("fields")["size"].alias("size"), "body")


@query("k1_versions", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 0")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    """The second of two versions."""
    root, n = S.scratch(spark, "state"), table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    S.write_version(n.filter("n_regionkey = 0").drop("n_regionkey"), root)
    S.write_version(n.filter("n_regionkey > 0").drop("n_regionkey"), root)
    return S.read_version(spark, root)


@query("d13_manifest_digest", "SELECT sha256('{\"regions\":[' || string_agg('\"' || r_name || '\"', ',' ORDER BY r_name) || '],\"seed\":7}') AS sha256 FROM region")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of the sorted compact JSON of one manifest, which is one row."""
    manifest = table(spark, sf, "region").agg(F.array_sort(F.collect_list("r_name")).alias("regions")).withColumn("seed", F.lit(7))
    return S.sealed(manifest, ["regions", "seed"]).select("sha256")


@query("x28_next_run", "SELECT event_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M') AS quarter, strftime(date_trunc('day', ts) + CASE WHEN ts < date_trunc('day', ts) + INTERVAL 390 MINUTE THEN INTERVAL 390 MINUTE ELSE INTERVAL 1830 MINUTE END, '%Y-%m-%d %H:%M') AS daily FROM events")
def x28(spark: SparkSession, sf: str) -> DataFrame:
    def runs(ts):
        at = ts.to_pydatetime().replace(tzinfo=UTC)
        yield tuple(C.next_run(cron, at).strftime("%Y-%m-%d %H:%M") for cron in ("*/15 * * * *", "30 6 * * *"))

    return C.flat(table(spark, sf, "events").select("event_id", "ts"), runs, ["ts"], "quarter string, daily string", ["event_id"])


SCHEMA = {"type": "object", "properties": {"n": {"type": "integer"}, "word": {"type": "string"}}, "required": ["n"]}


@query("r14_function_by_schema", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 2 * user_id + CASE WHEN event_id % 3 = 0 THEN 0 ELSE length(event_type) END END AS called, CASE WHEN event_id % 5 > 0 THEN user_id END AS n FROM events")
def r14(spark: SparkSession, sf: str) -> DataFrame:
    """A function with a required and an optional argument; every fifth call lacks the required one."""
    known = G.Functions(spark)
    known.register("twice", lambda n, word="": 2 * n + len(word), SCHEMA, "long")
    arguments = F.expr("case when event_id % 5 = 0 then '{\"word\":\"x\"}' when event_id % 3 = 0 then concat('{\"n\":', user_id, '}') else concat('{\"n\":', user_id, ',\"word\":\"', event_type, '\"}') end")
    return table(spark, sf, "events").select("event_id", known.call("twice", arguments).alias("called"), known.arguments("twice", arguments)["n"].alias("n"))


PATCH = "--- a/src/f#.py\n+++ b/src/f#.py\n@@ -1,3 +1,4 @@\n a\n-b\n+c\n+d\n e\n@@ -9 +10,0 @@\n-gone #\n--- /dev/null\n+++ b/new#.py\n@@ -0,0 +1 @@\n+x\n"


@query("x33_changed_lines", "SELECT p_partkey, replace(f, '#', p_partkey::VARCHAR) AS path, s AS side, l AS line FROM part CROSS JOIN (VALUES ('src/f#.py', 'old', 2), ('src/f#.py', 'new', 2), ('src/f#.py', 'new', 3), ('src/f#.py', 'old', 9), ('new#.py', 'new', 1)) v(f, s, l)")
def x33(spark: SparkSession, sf: str) -> DataFrame:
    patch = F.replace(F.lit(PATCH), F.lit("#"), F.col("p_partkey").cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", patch.alias("patch"))
    return C.flat(rows, C.changed_lines, ["patch"], "path string, side string, line int", ["p_partkey"])
