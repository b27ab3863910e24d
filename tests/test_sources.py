import json

import pytest
from pyspark.sql import functions as F

from marlspark.sources import files as S
from marlspark.streaming import messages as M


def test_source_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "lib/b.py": b"y", ".git/c.py": b"z", "d.bin": b"\0\1", "e.txt": b"t", "bad.py": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = S.source_files(spark, str(tmp_path), ["*.py"])
    assert sorted(r["path"] for r in got.collect()) == ["a.py", "lib/b.py"]


def test_json_lines_and_array(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "s.json").write_text('"text"')
    for name in ("l.jsonl", "a.json"):
        assert sorted(r["a"] for r in S.json_rows(spark, str(tmp_path / name)).collect()) == [1, 2]
    with pytest.raises(TypeError):
        S.json_rows(spark, str(tmp_path / "s.json"))


def test_event_log_wraps_legacy_rows(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(json.dumps({"schema_version": 1, "run_id": "r", "kind": "started", "data": {"n": 1}}) + "\n\n" + json.dumps({"old": True}) + "\n")
    got = S.event_log(spark, str(tmp_path / "e.jsonl")).select("kind", F.col("data").cast("string").alias("d")).collect()
    assert {r["kind"]: json.loads(r["d"]) for r in got} == {"started": {"n": 1}, "legacy": {"old": True}}


def test_history_skips_corrupt_lines(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"n": 1}\nnot json\n{"n": 2}\n{"n": 3}\n')
    assert [r["n"] for r in S.history(spark, str(tmp_path / "h.jsonl"), "n int", 2).collect()] == [2, 3]


def test_frontmatter(spark, tmp_path):
    (tmp_path / "m.md").write_text("---\nname: x\ndisabled: false\n---\nbody\n")
    (tmp_path / "off.md").write_text("---\ndisabled: true\n---\n")
    (tmp_path / "MEMORY.md").write_text("index")
    got = S.memory_files(spark, str(tmp_path)).collect()
    assert [(r["fields"]["name"], r["body"]) for r in got] == [("x", "body\n")]
    assert S.split_frontmatter("---\nopen") == ({}, "open")


def test_versions_and_digest(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    S.write_version(spark.range(2), root)
    S.write_version(spark.range(5), root)
    assert S.read_version(spark, root).count() == 5
    assert S.canonical_digest({"b": 1, "a": [2]}) == S.canonical_digest({"a": [2], "b": 1})
    rows = spark.createDataFrame([("i", "r", "c", "p", "easy", "gold")], "instance_id string, repo string, base_commit string, problem_statement string, difficulty string, patch string")
    assert S.public_rows(rows).columns == list(S.PUBLIC)
    with pytest.raises(ValueError, match="gold"):
        S.public_rows(rows, strict=True)


def test_streams_agree_with_batch(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS user_id, id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 20 as int)) AS ts, 'x' AS event_type FROM range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    M.drain(M.deduplicated(stream, ["user_id", "event_type"], "ts"), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3
    M.drain(M.windowed_counts(stream, "ts", "1 hour", []), str(tmp_path / "w"), str(tmp_path / "wc"))
    got, want = spark.read.parquet(str(tmp_path / "w")), M.windowed_counts(rows, "ts", "1 hour", [])
    assert got.subtract(want).count() == 0 and got.count() > 5


def test_phase_machine_remembers_the_last_signature(spark, tmp_path):
    for k, part in enumerate(([("r", 1, "fail", "a"), ("r", 2, "fail", "a")], [("r", 3, "fail", "a"), ("r", 4, "pass", "b")])):
        spark.createDataFrame(part, "run string, step long, verdict string, signature string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema("run string, step long, verdict string, signature string").parquet(str(tmp_path / "in/*"))
        M.drain(M.next_phases(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("step").collect()
    assert [r["next_phase"] for r in got] == ["repair", "replan", "replan", "done"]


def entries(spark, rows):
    kind = "key string, at timestamp, id string, author string, label string, body string, mentioned boolean"
    return spark.createDataFrame([(k, __import__("datetime").datetime.fromtimestamp(1_700_000_000 + t), f"{i:03d}", "au", lab, body, m) for i, (k, t, lab, body, m) in enumerate(rows)], kind)


def streamed(spark, tmp_path, parts, make):
    """The rows that a stream gives over the parts, one after another, with one far later entry to move the watermark."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a state store less per batch
    try:
        for n, part in enumerate([*parts, [("late", 10_000_000, "l", "z", False)], [("later", 20_000_000, "l", "z", False)]]):
            entries(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
            stream = spark.readStream.schema(entries(spark, []).schema).parquet(str(tmp_path / "in/*"))
            M.drain(make(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.parquet(str(tmp_path / "out")).filter("key not like 'late%'").orderBy("key", "start", "n")


def test_debounced_stream_flushes_by_timer_and_mention(spark, tmp_path):
    rows = [("a", 0, "x", "one", False), ("a", 5, "y", "two", False), ("a", 7, "x", "hey you", True), ("a", 8, "x", "three", False), ("a", 30, "x", "four", False), ("b", 31, "x", "alone", False)]  # an entry behind the watermark would be late
    got = streamed(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]], lambda s: M.buffered(s, 10)).collect()
    assert [(r["key"], r["n"], r["was_mentioned"], r["body"]) for r in got] == [("a", 3, True, "x: one\ny: two\nx: hey you"), ("a", 1, False, "three"), ("a", 1, False, "four"), ("b", 1, False, "alone")]
    batch = M.buffered(entries(spark, rows), 10).orderBy("key", "start", "n").collect()
    assert [(r["key"], r["n"], r["body"]) for r in batch] == [(r["key"], r["n"], r["body"]) for r in got]


def test_albums_close_a_fixed_time_after_the_first_part(spark, tmp_path):
    rows = [("g", 0.0, "m1", "look", False), ("g", 0.3, "m2", "", False), ("g", 0.5, "m1", "[empty message]", False), ("g", 0.7, "m3", "next", False), ("h", 0.75, "m4", "", False)]
    got = streamed(spark, tmp_path, [rows[:2], rows[2:]], lambda s: M.albums(s, 0.6)).collect()
    assert [(r["key"], r["n"], r["body"], list(r["media"])) for r in got] == [("g", 3, "look", ["m1", "m2"]), ("g", 1, "next", ["m3"]), ("h", 1, "[empty message]", ["m4"])]


def test_queue_hands_each_batch_on_once(spark, tmp_path):
    queue, seen = str(tmp_path / "queue"), []
    handle = lambda batch: seen.append(sorted(r["n"] for r in batch.collect()))
    for n in range(3):
        M.publish(spark.range(n, n + 1).select(F.col("id").alias("n")).coalesce(1), queue)
        M.consume(M.queued(spark, queue, "n long"), handle, str(tmp_path / "cp"))
    M.consume(M.queued(spark, queue, "n long"), handle, str(tmp_path / "cp"))
    assert [x for x in seen if x] == [[0], [1], [2]]


def test_debounced_sessions(spark):
    rows = spark.sql("SELECT 'u' AS u, id AS l, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(if(id < 2, id, id + 50) as int)) AS ts, concat('b', id) AS b FROM range(3)")
    got = M.debounced(rows, "u", "ts", "l", "b").orderBy("start").collect()
    assert [(r["n"], r["body"]) for r in got] == [(2, "0: b0\n1: b1"), (1, "b2")]


def test_events_are_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(2):
        S.append_events(spark.createDataFrame([(1, "r", f"k{k}")], "schema_version int, run_id string, kind string").coalesce(1), path)
    assert sorted(r["kind"] for r in S.event_log(spark, path).collect()) == ["k0", "k1"]


def test_history_of_several_files_is_in_file_order(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/1.jsonl").write_text("".join('{"n": %d}\n' % k for k in range(3)))
    (tmp_path / "h/2.jsonl").write_text("".join('{"n": %d}\n' % k for k in range(3, 900)))
    (tmp_path / "h/3.jsonl").write_text('{"n": 900}\n')
    assert [r["n"] for r in S.history(spark, str(tmp_path / "h"), "n int", 3).collect()] == [898, 899, 900]


def test_manifest_is_frozen(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    first = S.prepare_manifest(spark, path, {"b": 1, "a": ["x"]})
    assert S.prepare_manifest(spark, path, {"a": ["x"], "b": 1}) == first and first["sha256"] == S.canonical_digest({"a": ["x"], "b": 1})
    with pytest.raises(ValueError, match="different manifest"):
        S.prepare_manifest(spark, path, {"a": []})
    assert S.prepare_manifest(spark, path, {"a": []}, force=True)["a"] == [] and json.loads((tmp_path / "m.json").read_text())["a"] == []


def test_predictions_shards_and_definitions(spark, tmp_path):
    rows = spark.createDataFrame([("i", "m", "é\n")], "instance_id string, model_name_or_path string, model_patch string")
    S.write_predictions(rows, str(tmp_path / "p"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()] == ['{"instance_id":"i","model_name_or_path":"m","model_patch":"é\\n"}'] == [r["line"] for r in S.prediction_lines(rows).collect()]
    rows.write.parquet(str(tmp_path / "d/abc/data/test-00000-of-00001.parquet"))
    assert S.dataset_shard(spark, str(tmp_path / "d"), "test", "abc").count() == 1
    (tmp_path / "agents").mkdir()
    (tmp_path / "agents/b.md").write_text("---\nname: Bee\ndescription: buzzes\n---\nDo.")
    (tmp_path / "agents/a.md").write_text("plain")
    assert [(r["name"], r["description"], r["body"]) for r in S.definitions(spark, str(tmp_path / "agents")).collect()] == [("a", "", "plain"), ("Bee", "buzzes", "Do.")]
    assert S.sealed(rows, ["instance_id"]).first()["sha256"] == __import__("hashlib").sha256(b'{"instance_id":"i"}').hexdigest()


def test_functions_by_schema(spark, tmp_path):
    from marlspark.functions import registry as G

    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "s": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "o": {"type": "object"}, "x": 3}, "required": ["n"]}
    assert G.struct_of(schema).simpleString() == "struct<n:bigint,s:string,tags:array<string>,o:string,x:string>" and not G.struct_of(schema)["n"].nullable and G.struct_of({}).fields == []
    assert G.tool_name("my server", "9x") == "mcp__my_server__mcp_9x" and G.tool_name("", "a") == "mcp__tool__a"
    known = G.Functions(spark)
    known.register("again", lambda n: 0, schema, "long")
    known.register("again", lambda n, s="-", tags=(), o=None, x=None: n * 2 + len(s), schema, "long")
    rows = spark.createDataFrame([(1, '{"n": 4, "s": "abc"}'), (2, '{"s": "abc"}'), (3, "no"), (4, '{"n": 1}')], "i int, a string").orderBy("i")
    assert [r["r"] for r in rows.select(known.call("again", F.col("a")).alias("r")).collect()] == [11, None, None, 3]
    assert spark.sql("""SELECT again('{"n": 5}') AS r""").first()["r"] == 11 and rows.select(known.arguments("again", F.col("a")).alias("x")).first()["x"]["n"] == 4
    (tmp_path / "good.py").write_text("TOOLS = [('plus', lambda n: n + 1, {'properties': {'n': {'type': 'integer'}}}, 'long')]")
    (tmp_path / "bad.py").write_text("raise OSError")
    assert known.load(str(tmp_path)) == ["good.py"] and [r["name"] for r in known.names().collect()] == ["again", "plus"]
