"""Versioned tables and logs with several writers, scheduler ticks, caches of models, source trees."""

import threading
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspark.operators import encoding
from marlspark.sources import files as S
from marlspark.sources import tree, versioned
from marlspark.streaming import scheduler


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, n long")


def upsert(old, new):
    return old.join(new, "k", "left_anti").unionByName(new)


def both(*work):
    """Runs functions at the same time; raises what they raised."""
    found = []

    def run(f):
        try:
            f()
        except Exception as e:
            found.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if found:
        raise found[0]


def test_two_upserts_at_once_both_survive(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    S.write_version(rows(spark, [("a", 1), ("b", 1)]), root)
    together = threading.Barrier(2, timeout=60)
    tries = []

    def writer(pairs):
        def merge(old, new):
            tries.append(pairs)
            if len(tries) <= 2:
                together.wait()  # both have read the same version
            return upsert(old, new)

        return lambda: S.upsert_version(rows(spark, pairs), root, merge)

    both(writer([("b", 2), ("c", 2)]), writer([("d", 3)]))
    assert sorted(map(tuple, S.read_version(spark, root).collect())) == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]
    assert len(tries) == 3 and versioned.commits(spark, root) == [0, 1, 2]
    assert sorted(map(tuple, S.read_version(spark, root, 0).collect())) == [("a", 1), ("b", 1)]


def test_a_claim_is_won_once(spark, tmp_path):
    path, won = f"file://{tmp_path}/c.json", []
    both(*[lambda k=k: won.append(k) if versioned._claimed(spark, path, str(k)) else None for k in range(8)])
    assert len(won) == 1 and (tmp_path / "c.json").read_text() == str(won[0])
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["c.json"]


def test_tokens_appends_and_vacuum(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, root)
    add = lambda k, token=None: versioned.commit(spark, root, lambda _: rows(spark, [(k, 1)]), append=True, token=token)
    assert [add("a", "x"), add("b"), add("again", "x")] == [0, 1, 0]
    assert versioned.commit(spark, root, lambda _: None) == 1
    assert sorted(r["k"] for r in versioned.read(spark, root).collect()) == ["a", "b"]
    S.write_version(rows(spark, [("z", 9)]), root)
    S.write_version(rows(spark, [("y", 9)]), root)
    versioned.vacuum(spark, root, keep=1)
    assert versioned.commits(spark, root) == [3] and [r["k"] for r in versioned.read(spark, root).collect()] == ["y"]
    assert sum(p.name.startswith("data-") for p in (tmp_path / "t").iterdir()) == 1


def test_writers_that_always_lose_are_told(spark, tmp_path):
    root = f"file://{tmp_path}/t"

    def update(old):
        S.write_version(rows(spark, [("other", 1)]), root)
        return rows(spark, [("mine", 1)])

    with pytest.raises(versioned.Conflict):
        versioned.commit(spark, root, update, retries=2)


# --- logs


def test_a_log_is_read_in_the_order_of_its_appends(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    parts = [range(3), range(3, 20_003), range(20_003, 20_004), range(0), range(20_004, 20_010)]
    for part in parts:
        S.append_events(spark.range(part.start, part.stop, numPartitions=3).selectExpr("1 schema_version", "'r' run_id", "'k' kind", "named_struct('n', id) data"), path)
    got = S.event_log(spark, path).select("ordinal", F.try_variant_get("data", "$.n", "long").alias("n")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(k, k) for k in range(20_010)]


def test_two_appends_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    one = lambda kind: lambda: S.append_events(spark.range(50).selectExpr("1 schema_version", "'r' run_id", f"'{kind}' kind", "named_struct('n', id) data"), path)
    both(one("a"), one("b"), one("c"))
    got = S.event_log(spark, path).select("ordinal", "kind", F.try_variant_get("data", "$.n", "long").alias("n")).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(150))
    assert sorted({r["kind"] for r in got[:50]} | {r["kind"] for r in got[50:100]} | {r["kind"] for r in got[100:]}) == ["a", "b", "c"]
    assert [r["n"] for r in got] == [*range(50)] * 3


def test_a_log_of_plain_files_is_numbered_by_file(spark, tmp_path):
    (tmp_path / "l").mkdir()
    line = '{"schema_version":1,"run_id":"r","kind":"k","data":{"n":%d}}\n'
    (tmp_path / "l/b.jsonl").write_text("".join(line % n for n in range(2, 5000)))
    (tmp_path / "l/a.jsonl").write_text(line % 0 + "\n  \n" + line % 1)
    got = S.event_log(spark, str(tmp_path / "l")).select("ordinal", F.try_variant_get("data", "$.n", "long").alias("n")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(k, k) for k in range(5000)]


# --- JSON and memory files


def test_arrays_and_lines_in_one_folder(spark, tmp_path):
    (tmp_path / "a 1.json").write_text('\n  [{"n": 1}, {"n": 2}]')
    (tmp_path / "b.jsonl").write_text('\n{"n": 3}\n{"n": 4, "x": "y"}\n')
    (tmp_path / "empty.json").write_text("\n")
    for schema in (None, "n long"):
        assert sorted(r["n"] for r in S.json_rows(spark, str(tmp_path), schema).collect()) == [1, 2, 3, 4]


def test_memories_are_dropped_before_they_are_counted(spark, tmp_path):
    import os

    for k in range(8):
        path = tmp_path / f"{k}.md"
        path.write_text(f"---\nname: m{k}\ndisabled: {'yes' if k < 3 else 'false'}\nttl_days: {5 if k == 3 else 0}\ncreated_at: 2025-01-01T00:00:00Z\nupdated_at: {'2026-01-01T00:00:00Z' if k == 3 else ''}\n---\nbody")
        os.utime(path, (10_000 - k, 10_000 - k))
    now = F.lit(datetime(2026, 1, 6, tzinfo=UTC))
    names = lambda **how: [r["fields"]["name"] for r in S.memory_files(spark, str(tmp_path), now=now, **how).collect()]
    assert names(most=2) == ["m4", "m5"] and names(most=None, with_expired=True) == ["m3", "m4", "m5", "m6", "m7"]
    assert names(with_disabled=True)[:3] == ["m0", "m1", "m2"]


def test_frontmatter_is_yaml(spark):
    text = "---\nname: 'a: b'\ntags: [x, \"y\"]\nnested:\n  deep: {n: 1}\nnote: |\n  two\n  lines\nnone:\nday: 2026-01-02\nyes: true\nsize: 1.50\n---\nbody\n---\n"
    fields, body = S.split_frontmatter(text)
    assert body == "body\n---\n"
    assert fields == {"name": "a: b", "tags": '["x", "y"]', "nested": '{"deep": {"n": 1}}', "note": "two\nlines\n", "none": None, "day": "2026-01-02", "True": "true", "size": "1.5"}
    for bad in ("---\na: b\nno field\n---\nx", "---\n- list\n---\nx", "---\na: [\n---\nx"):
        assert S.split_frontmatter(bad) == ({}, "x")
    assert S.split_frontmatter("---\nopen") == ({}, "open") and S.split_frontmatter("plain") == ({}, "plain")
    got = S.frontmatter(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()
    assert [r["fields"].get("tags") for r in got] == ['["x", "y"]', None]


# --- scheduler

JOBS = [("quarter", "*/15 * * * *", None, True), ("daily", "30 6 * * *", "Europe/Berlin", True), ("off", "* * * * *", None, False), ("bad", "never", None, True), ("fails", "0 * * * *", "", None)]


def test_ticks_run_what_is_due_once(spark, tmp_path):
    root, ran = f"file://{tmp_path}/s", []

    def run(due):
        names = sorted(r["name"] for r in due.collect())
        ran.append(names)
        return spark.createDataFrame([(n, n != "fails") for n in names], "name string, success boolean")

    at = lambda h, m: datetime(2026, 3, 1, h, m, tzinfo=UTC)
    scheduler.add_jobs(spark.createDataFrame(JOBS, "name string, schedule string, timezone string, enabled boolean"), root, at(5, 1))
    spark.createDataFrame([(at(5, 10),)], "at timestamp").write.parquet(f"{tmp_path}/ticks")
    ticks = spark.readStream.schema("at timestamp").parquet(f"{tmp_path}/ticks")
    serve = lambda checkpoint: scheduler.serve(ticks, root, run, f"{tmp_path}/{checkpoint}")
    serve("c")
    for now in (at(5, 20), at(6, 5)):
        spark.createDataFrame([(now,), (at(4, 0),)], "at timestamp").write.mode("append").parquet(f"{tmp_path}/ticks")
        serve("c")
    assert ran == [[], ["quarter"], ["daily", "fails", "quarter"]]
    serve("again")  # a lost checkpoint: the last tick of all comes again
    assert len(ran) == 3
    got = {r["name"]: (r["last_run"], r["last_status"], r["next_run"]) for r in versioned.read(spark, f"{root}/jobs").select("name", *[F.date_format(c, "dd HH:mm").alias(c) for c in ("last_run", "next_run")], "last_status").collect()}
    assert got == {"quarter": ("01 06:05", "success", "01 06:15"), "daily": ("01 06:05", "success", "02 05:30"), "off": (None, None, "01 05:02"), "bad": (None, None, None), "fails": ("01 06:05", "failed", "01 07:00")}
    assert versioned.read(spark, f"{root}/history").count() == 4


def test_a_tick_that_crashed_before_its_write_back_counts_once(spark, tmp_path):
    root, now = f"file://{tmp_path}/s", datetime(2026, 3, 1, 6, tzinfo=UTC)
    scheduler.add_jobs(spark.createDataFrame([("a", "0 * * * *", None, True)], "name string, schedule string, timezone string, enabled boolean"), root, datetime(2026, 3, 1, 5, 1, tzinfo=UTC))
    first = lambda due: due.select("name", F.lit(True).alias("success"))
    versioned.commit(spark, f"{root}/history", lambda _: first(versioned.read(spark, f"{root}/jobs")).withColumn("at", F.lit(now)), append=True, token=now.isoformat())
    scheduler.tick(spark, root, now, lambda due: due.select("name", F.lit(False).alias("success")))
    assert [r["last_status"] for r in versioned.read(spark, f"{root}/jobs").collect()] == ["success"]
    assert versioned.read(spark, f"{root}/history").count() == 1


# --- models and their cache


def counted(folder):
    """A model that leaves a file for each time it is loaded and for each text that it encodes."""

    def make():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def encode(texts):
            for _ in texts:
                open(f"{folder}/text-{uuid.uuid4().hex}", "w").close()
            return np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype=np.float32).reshape(len(texts), 3)

        return encode

    return make


def test_vectors_come_through_the_cache(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    cache, make = f"file://{tmp_path}/cache", counted(str(tmp_path / "calls"))
    model = f"m-{tmp_path.name}"
    seen = lambda: len(list((tmp_path / "calls").glob("text-*")))
    texts = spark.createDataFrame([("1", "aa"), ("2", "aa"), ("3", None), ("4", "b")], "chunk_id string, text string")
    got = {r["chunk_id"]: list(r["vector"]) for r in encoding.vectors(texts, cache, model, make).collect()}
    assert got == {"1": [2, 2, 1], "2": [2, 2, 1], "3": [0, 0, 1], "4": [1, 0, 1]} and seen() == 3
    more = texts.filter("chunk_id < '3'").unionByName(spark.createDataFrame([("9", "new a")], texts.schema))
    assert {r["chunk_id"]: list(r["vector"]) for r in encoding.vectors(more, cache, model, make).collect()} == {"1": [2, 2, 1], "2": [2, 2, 1], "9": [5, 1, 1]}
    assert seen() == 4 and versioned.read(spark, cache).count() == 4
    assert encoding.vectors(more, cache, model, make).count() == 3 and seen() == 4
    encoding.vectors(more.filter("chunk_id = '9'"), cache, model + "-other", make).collect()
    assert seen() == 5 and versioned.read(spark, cache).groupBy("model").count().count() == 2
    loads = [p.name.split("-")[1] for p in (tmp_path / "calls").glob("load-*")]
    assert max(loads.count(pid) for pid in loads) <= 2  # each of both models once a worker
    assert not [p for p in (tmp_path / "cache").iterdir() if p.name.startswith("staged-")]


def test_an_empty_table_leaves_no_cache(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, text string")
    assert encoding.vectors(none, f"file://{tmp_path}/cache", "none", lambda: None).collect() == []


def test_two_that_fill_the_cache_at_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    cache, make = f"file://{tmp_path}/cache", counted(str(tmp_path / "calls"))
    texts = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as string) chunk_id", "repeat('a', cast(id as int)) text")
    out = {}
    both(*[lambda lo=lo, hi=hi: out.update({lo: {r["chunk_id"]: r["vector"][0] for r in encoding.vectors(texts(lo, hi), cache, "both", make).collect()}}) for lo, hi in ((0, 20), (10, 30))])
    assert out[0] == {str(k): k for k in range(20)} and out[10] == {str(k): k for k in range(10, 30)}
    assert versioned.read(spark, cache).count() == 30


def test_pair_scores(spark, tmp_path):
    pairs = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("qa", "", 3), (None, "b", 4)], "query string, text string, n int")
    make = lambda: lambda found: [len(q) * 10 + len(t) for q, t in found]
    for _ in range(2):
        got = encoding.pair_scores(pairs, f"file://{tmp_path}/cache", "pairs", make)
        assert sorted((r["n"], r["score"]) for r in got.collect()) == [(1, 11.0), (2, 11.0), (3, 20.0), (4, 1.0)]
    assert versioned.read(spark, f"file://{tmp_path}/cache").count() == 3


def test_surfaces_of_a_model(spark):
    class Many:
        def rank_many(self, queries, texts, top_k):
            return [(k, float(max(t.count(q) for q in queries))) for k, t in enumerate(texts) if t][:top_k]

        def rank(self, query, texts, top_k):
            raise AssertionError("rank_many comes first")

    class One:
        def rank(self, query, texts, top_k):
            return [(k, float(t.count(query))) for k, t in enumerate(texts) if t][:top_k]

        def __call__(self, texts):
            raise AssertionError("rank comes before a call")

    chunks = spark.createDataFrame([(1, "a a b"), (2, "b b b"), (3, "c"), (4, None), (5, "a a")], "chunk_id int, text string").repartition(3)
    for name, make in (("many", Many), ("one", One)):
        got = encoding.ranked(chunks, ["a", " b ", ""], name, make, top=3).collect()
        assert [(r["chunk_id"], r["score"]) for r in got] == [(2, 3.0), (1, 2.0), (5, 2.0)]
    letters = lambda: lambda texts: [[t.count("a"), t.count("b"), 0.0] for t in texts]
    got = encoding.ranked(chunks, ["a", "b"], "letters", letters, top=10).collect()
    assert [(r["chunk_id"], round(r["score"], 4)) for r in got] == [(2, 1.0), (5, 1.0), (1, 0.8944), (3, 0.0), (4, 0.0)]
    with pytest.raises(ValueError, match="at least one"):
        encoding.ranked(chunks, [" "], "many", Many)


# --- trees


def test_ignored_folders_are_never_listed(spark, tmp_path):
    for name in ("a.py", "lib/b.py", "lib/node_modules/x/c.py", ".git/objects/d.py", "lib/deep/e.txt", "build/f.py", "big.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (300 if name == "big.py" else 10))
    listed = []

    def ls(folder):
        listed.append(folder.removeprefix(f"{tmp_path}/"))
        return tree.listing(folder)

    assert sorted(p for p, _ in tree.walk(str(tmp_path), most=100, ls=ls)) == ["a.py", "lib/b.py", "lib/deep/e.txt"]
    assert sorted(listed) == ["", "lib/", "lib/deep/"]
    got = S.source_files(spark, f"file://{tmp_path}", ["*.py"], max_bytes=100)
    assert sorted(r["path"] for r in got.collect()) == ["a.py", "lib/b.py"] and S.source_files(spark, str(tmp_path), ["none"]).count() == 0
    many = tree.source_tree(spark, str(tmp_path), share=15)
    assert many.rdd.getNumPartitions() == 4 and many.count() == 4


def test_shares_are_of_even_size():
    files = [(f"f{k}", 5) for k in range(7)] + [("large", 100), ("g", 1)]
    assert list(tree.shares(iter(files), 20)) == [["f0", "f1", "f2", "f3"], ["f4", "f5", "f6"], ["large"], ["g"]]
    assert [len(p) for p in tree.shares(iter(files), 1000, 4)] == [4, 4, 1]
