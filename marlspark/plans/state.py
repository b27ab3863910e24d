"""Queries of what is kept between runs: versions with several writers, ordered logs, scheduler ticks, caches and trees. Each
writes its state into a scratch folder and reads it back."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoding
from ..sources import files as S
from ..sources import versioned
from ..streaming import messages as M
from ..streaming import scheduler
from .registry import query, table


def _together(*work: Callable[[], object]) -> None:
    failed: list[BaseException] = []

    def run(f: Callable[[], object]) -> None:
        try:
            f()
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]


@query("k1_two_writers", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 2 WHEN c_custkey % 5 = 1 THEN 3 ELSE 1 END AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 1 OR c_custkey % 3 = 0")
def k1w(spark: SparkSession, sf: str) -> DataFrame:
    """Two upserts at the same time over a third of the customers: of those with even numbers, and of some odd ones."""
    root, c = S.scratch(spark, "state"), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    S.write_version(c.filter("k % 3 = 0").withColumn("n", F.lit(1)), root)
    merge = lambda old, new: old.join(new, "k", "left_anti").unionByName(new)
    upsert = lambda where, n: lambda: S.upsert_version(c.filter(where).withColumn("n", F.lit(n)), root, merge)
    _together(upsert("k % 2 = 0", 2), upsert("k % 2 = 1 and k % 5 = 1", 3))
    return S.read_version(spark, root)


@query("s4_log_order", "SELECT event_id, row_number() OVER (ORDER BY event_type = 'click' DESC, event_type = 'view' DESC, event_id) - 1 AS ordinal FROM events")
def s4o(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended in three parts of different sizes, each in its order: clicks, views, all others."""
    path, e = S.scratch(spark, "log"), table(spark, sf, "events")
    for where in ("event_type = 'click'", "event_type = 'view'", "event_type not in ('click', 'view')"):
        S.append_events(e.filter(where).orderBy("event_id").selectExpr("1 schema_version", "cast(user_id as string) run_id", "event_type kind", "named_struct('n', event_id) data"), path)
    return S.event_log(spark, path).select(F.try_variant_get("data", "$.n", "long").alias("event_id"), "ordinal")


TICKS = (datetime(2024, 1, 1, 2, 10, tzinfo=UTC), datetime(2024, 1, 1, 5, 59, tzinfo=UTC), datetime(2024, 1, 1, 6, 31, tzinfo=UTC))


def _later(at: str) -> str:
    day = f"date_trunc('day', {at})"
    return f"CASE k % 4 WHEN 0 THEN time_bucket(INTERVAL 15 MINUTE, {at}) + INTERVAL 15 MINUTE WHEN 1 THEN {day} + CASE WHEN {at} < {day} + INTERVAL 390 MINUTE THEN INTERVAL 390 MINUTE ELSE INTERVAL 1830 MINUTE END WHEN 2 THEN time_bucket(INTERVAL 2 HOUR, {at}) + INTERVAL 2 HOUR END"


def _tick_sql() -> str:
    parts = [f"t0 AS (SELECT c_custkey AS k, c_custkey % 5 <> 0 AS enabled, {_later('at0')} AS due, 0 AS runs, CAST(NULL AS TIMESTAMP) AS ran FROM (SELECT *, c_custkey AS k, TIMESTAMP '2024-01-01' + to_minutes(c_custkey % 300) AS at0 FROM customer))"]
    for n, at in enumerate(TICKS, 1):
        now = f"TIMESTAMP '{at:%Y-%m-%d %H:%M:%S}'"
        ready = f"(enabled AND due <= {now})"
        parts.append(f"t{n} AS (SELECT k, enabled, CASE WHEN {ready} THEN {_later(now)} ELSE due END AS due, runs + CASE WHEN {ready} THEN 1 ELSE 0 END AS runs, CASE WHEN {ready} THEN {now} ELSE ran END AS ran FROM t{n - 1})")
    return "WITH " + ", ".join(parts) + f" SELECT k, runs, epoch_us(due) // 1000000 AS next_run, epoch_us(ran) // 1000000 AS last_run, CASE WHEN runs > 0 THEN CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'success' END END AS last_status FROM t{len(TICKS)}"


@query("g7_scheduler_ticks", _tick_sql())
def g7s(spark: SparkSession, sf: str) -> DataFrame:
    """A job per customer, of four schedules, one of them invalid, every fifth switched off; three ticks, the second one twice."""
    root = S.scratch(spark, "scheduler")
    k = F.col("k")
    schedule = F.when(k % 4 == 0, "*/15 * * * *").when(k % 4 == 1, "30 6 * * *").when(k % 4 == 2, "0 */2 * * *").otherwise("never")
    at = F.timestamp_add("MINUTE", k % 300, F.lit(datetime(2024, 1, 1, tzinfo=UTC)))
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).withColumns({"schedule": schedule, "timezone": F.lit("UTC"), "at": at})
    jobs = jobs.select(k.cast("string").alias("name"), "schedule", "timezone", (k % 5 != 0).alias("enabled"), scheduler.upcoming(F.col("schedule"), F.col("at"), F.col("timezone")).alias("next_run"), F.lit(None).cast("timestamp").alias("last_run"), F.lit(None).cast("string").alias("last_status"))
    S.write_version(jobs, f"{root}/jobs")
    run = lambda due: due.select("name", (F.col("name").cast("long") % 3 != 0).alias("success"))
    for now in (TICKS[0], TICKS[1], TICKS[1], TICKS[2]):
        scheduler.tick(spark, root, now, run)
    runs = versioned.read(spark, f"{root}/history").groupBy("name").agg(F.count(F.lit(1)).alias("runs"))
    got = versioned.read(spark, f"{root}/jobs").join(runs, "name", "left")
    return got.select(F.col("name").cast("long").alias("k"), F.coalesce("runs", F.lit(0)).cast("int").alias("runs"), F.unix_seconds("next_run").alias("next_run"), F.unix_seconds("last_run").alias("last_run"), "last_status")


def _toy_model() -> Callable[[list[str]], list[list[float]]]:
    """Vectors of a text's length and its numbers of e and of spaces."""
    return lambda texts: [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


@query("s15_read_through", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS e, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS s, (SELECT count(DISTINCT text) FROM documents) AS cached FROM documents")
def s15r(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the English documents fill a cache, those of all documents then find them there."""
    cache, d = f"{S.scratch(spark, 'vectors')}", table(spark, sf, "documents").select("doc_id", "lang", "text")
    encoding.vectors(d.filter("lang = 'en'"), cache, "toy", _toy_model, "doc_id")
    got = encoding.vectors(d, cache, "toy", _toy_model, "doc_id")
    n = versioned.read(spark, cache).agg(F.count(F.lit(1)).alias("cached"))
    return got.select("doc_id", *[F.col("vector")[k].cast("long").alias(c) for k, c in enumerate("nes")]).join(F.broadcast(n))  # one row


class _Counts:
    """A model whose score is how often a query stands in a text."""

    def rank_many(self, queries: list[str], texts: list[str], top_k: int) -> list[tuple[int, float]]:
        scored = sorted(((float(max(t.count(q) for q in queries)), -k) for k, t in enumerate(texts)), reverse=True)
        return [(-k, s) for s, k in scored[:top_k]]


@query("a7_rank_many", "SELECT doc_id, CAST(greatest((length(text) - length(replace(text, 'en', ''))) // 2, (length(text) - length(replace(text, 'an', ''))) // 2) AS DOUBLE) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 100")
def a7r(spark: SparkSession, sf: str) -> DataFrame:
    """The best 100 documents by a model that takes several queries at once, which are stripped."""
    return encoding.ranked(table(spark, sf, "documents"), ["en", " an ", " "], "counts", _Counts, "doc_id")


@query("s15_pair_scores", "SELECT event_id, CAST(length(event_type) * 10 + length(props) AS DOUBLE) AS score FROM events")
def s15p(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of pairs of texts, of which most come again; half of the events fill the cache first."""
    cache, pairs = S.scratch(spark, "scores"), table(spark, sf, "events").select("event_id", F.col("event_type").alias("query"), F.col("props").alias("text"))
    make = lambda: lambda found: [10 * len(q) + len(t) for q, t in found]
    encoding.pair_scores(pairs.filter("event_id % 2 = 0"), cache, "lengths", make)
    return encoding.pair_scores(pairs, cache, "lengths", make).select("event_id", "score")


@query("s1_source_tree", "SELECT source, doc_id FROM documents WHERE source <> (SELECT min(source) FROM documents)")
def s1t(spark: SparkSession, sf: str) -> DataFrame:
    """Ids in a folder of files per source; the first source's folder lies in an ignored one."""
    root, d = S.scratch(spark, "tree"), table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("value"))
    least = d.agg(F.min("source").alias("least"))
    marked = d.join(F.broadcast(least)).withColumn("hidden", F.col("source") == F.col("least"))  # one row
    marked.filter("not hidden").select("source", "value").write.partitionBy("source").text(f"{root}/src")
    marked.filter("hidden").select("source", "value").write.partitionBy("source").text(f"{root}/src/node_modules")
    files = S.source_files(spark, root, ["*.txt"], max_bytes=1 << 40)
    lines = files.select(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line <> ''").select("source", F.col("line").cast("long").alias("doc_id"))


@query("s2_mixed_files", "SELECT p_partkey, p_name FROM part")
def s2m(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of even size as lines, others as arrays, a file each brand, below one folder."""
    path, p = S.scratch(spark, "mixed"), table(spark, sf, "part")
    row = F.to_json(F.struct("p_partkey", "p_name")).alias("value")
    p.filter("p_size % 2 = 0").select(row, F.lit("lines").alias("b")).write.partitionBy("b").text(path)
    arrays = p.filter("p_size % 2 = 1").groupBy(F.col("p_brand").alias("b")).agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("rows"))
    arrays.select("b", F.concat(F.lit("\n "), F.to_json("rows")).alias("value")).write.mode("append").partitionBy("b").text(path)
    return S.json_rows(spark, path, "p_partkey long, p_name string").select("p_partkey", "p_name")


@query("s6_frontmatter_yaml", r"""SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 7 > 0 THEN '["' || p_brand || '", "x y"]' END AS tags, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 3 = 0 THEN '{"n": ' || p_size || '}' END AS deep, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 = 0 THEN p_type || chr(10) || 'end' || chr(10) END AS note, CASE WHEN p_partkey % 7 > 0 THEN p_type || chr(10) ELSE
'name: "' || p_name || '"' || chr(10) || 'tags: ["' || p_brand || '", x y]' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'deep:' || chr(10) || '  n: ' || p_size || chr(10) ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'note: |' || chr(10) || '  ' || p_type || chr(10) || '  end' || chr(10) ELSE '' END || p_type || chr(10) END AS body FROM part""")
def s6y(spark: SparkSession, sf: str) -> DataFrame:
    """Fields with lists, maps and block texts; every seventh text lacks the closing line."""
    nl = F.lit("\n")
    text = F.concat(
        F.lit('---\nname: "'), "p_name", F.lit('"\ntags: ["'), "p_brand", F.lit('", x y]\n'), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("deep:\n  n: "), F.col("p_size").cast("string"), nl)).otherwise(""),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("note: |\n  "), "p_type", F.lit("\n  end\n"))).otherwise(""), F.when(F.col("p_partkey") % 7 > 0, "---\n").otherwise(""), "p_type", nl,
    )
    got = S.frontmatter(table(spark, sf, "part").select("p_partkey", text.alias("t")), "t")
    return got.select("p_partkey", *[F.col("fields")[c].alias(c) for c in ("name", "tags", "deep", "note")], "body")


@query("d13_group_digests", "SELECT r_regionkey, sha256('{\"nations\":[' || coalesce(string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) FILTER (n_name IS NOT NULL), '') || '],\"region\":\"' || r_name || '\"}') AS sha256 FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def d13g(spark: SparkSession, sf: str) -> DataFrame:
    """Of each region the digest of a manifest of its nations."""
    rows = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    manifests = rows.groupBy("r_regionkey", F.col("r_name").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    return S.sealed(manifests, ["nations", "region"]).select("r_regionkey", "sha256")


@query("s3_dataset_shard", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    """The test split at one of two revisions of a data set."""
    root, p = S.scratch(spark, "dataset"), table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    for revision, rows in (("a1", p.filter("p_size <= 10")), ("b2", p.filter("p_size > 10"))):
        rows.write.parquet(f"{root}/{revision}/data/test-00000-of-00001.parquet")
    return S.dataset_shard(spark, root, "test", "b2")


DEFINED = "CASE WHEN s_suppkey % 3 = 0 THEN 'agent-' || s_suppkey ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Does ' || s_suppkey || ': all' ELSE '' END AS description, 'Body of ' || s_suppkey || chr(10) AS body"


@query("s18_definitions", f"SELECT {DEFINED} FROM supplier")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    """A file per supplier, some with a name of their own in their frontmatter, some with a description."""
    k = F.col("s_suppkey")
    number = k.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("name: agent-"), number, F.lit("\n"))).otherwise("")
    told = F.when(k % 2 == 0, F.concat(F.lit('description: "Does '), number, F.lit(': all"\n'))).otherwise("")
    text = F.concat(F.lit("---\nk: v\n"), name, told, F.lit("---\nBody of "), number, F.lit("\n"))
    root = S.scratch(spark, "agents")
    S.write_texts(table(spark, sf, "supplier").select(F.concat("s_name", F.lit(".md")).alias("name"), text.alias("text")), root)
    return S.definitions(spark, root).select("name", "description", "body")


@query("s5_memory_files", "SELECT s_suppkey, s_suppkey % 4 = 0 AS lasts FROM supplier WHERE s_suppkey % 5 <> 0 AND (s_suppkey % 4 = 0 OR DATE '2024-01-01' + to_days(CAST(s_suppkey % 40 AS INT)) + INTERVAL 20 DAY > TIMESTAMP '2024-02-01')")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    """A memory per supplier: every fifth is disabled, every fourth lasts, the others expire after 20 days."""
    k = F.col("s_suppkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")).cast("string")
    text = F.concat(F.lit("---\nid: "), k.cast("string"), F.lit("\nttl_days: "), F.when(k % 4 == 0, "0").otherwise("20"), F.lit("\nupdated_at: "), day, F.lit("T00:00:00Z\ndisabled: "), F.when(k % 5 == 0, "yes").otherwise("no"), F.lit("\n---\nbody\n"))
    root = S.scratch(spark, "memories")
    S.write_texts(table(spark, sf, "supplier").select(F.concat(k.cast("string"), F.lit(".md")).alias("name"), text.alias("text")), root)
    got = S.memory_files(spark, root, most=None, now=F.lit(datetime(2024, 2, 1, tzinfo=UTC)))
    return got.select(F.col("fields")["id"].cast("long").alias("s_suppkey"), (F.col("fields")["ttl_days"] == "0").alias("lasts"))


@query("k4_frozen_manifest", "SELECT sha256('{\"nations\":[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || '],\"seed\":3}') AS sha256, true AS kept FROM nation")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest that is frozen, frozen again with the same content, and refused with another."""
    path = f"{S.scratch(spark, 'manifest')}/manifest.json"
    names = table(spark, sf, "nation").agg(F.array_sort(F.collect_list("n_name")).alias("names")).first()["names"]  # a manifest fits on the driver
    first = S.prepare_manifest(spark, path, {"seed": 3, "nations": names})
    try:
        S.prepare_manifest(spark, path, {"seed": 4, "nations": names})
        kept = False
    except ValueError:
        kept = S.prepare_manifest(spark, path, {"nations": names, "seed": 3}) == first
    return spark.createDataFrame([(first["sha256"], kept)], "sha256 string, kept boolean")


@query("f2_gold_fields", "SELECT event_id, CASE WHEN event_id % 15 = 0 THEN 'hints_text,patch' WHEN event_id % 5 = 0 THEN 'patch' WHEN event_id % 3 = 0 THEN 'hints_text' ELSE '' END AS gold FROM events")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    """Which gold fields stand in public rows that came as JSON."""
    n = F.col("event_id")
    text = F.concat(F.lit('{"instance_id": "'), n.cast("string"), F.lit('", "repo": "patch"'), F.when(n % 5 == 0, ', "patch": null').otherwise(""), F.when(n % 3 == 0, ', "hints_text": {"x": 1}').otherwise(""), F.lit("}"))
    return table(spark, sf, "events").select("event_id", F.array_join(S.gold_keys(text), ",").alias("gold"))


@query("g1_queue", "SELECT event_id, event_type, event_id % 3 AS part FROM events")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    """Events published in three parts; after each a consumer takes what is there, batch by batch."""
    root, e = S.scratch(spark, "queue"), table(spark, sf, "events").select("event_id", "event_type", (F.col("event_id") % 3).alias("part"))
    for k in range(3):
        M.publish(e.filter(F.col("part") == k), f"{root}/queue")
        M.consume(M.queued(spark, f"{root}/queue", "event_id long, event_type string, part long", 4), lambda batch: batch.write.mode("append").parquet(f"{root}/seen"), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/seen")
