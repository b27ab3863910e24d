"""Stateful streams against their batch forms and plain loops, with batches of any size and restarts."""

import itertools
import random
import time
from collections import OrderedDict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlspark.streaming import messages as M
from marlspark.streaming import seen, settle, turns


def streamed(spark, tmp_path, batches, schema, operator, restart_after=1):
    """Feeds batches one file at a time, and stops and starts the query anew after some of them."""
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame([], schema).write.json(source)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        if k % restart_after == 0 or k == len(batches) - 1:
            M.drain(operator(spark.readStream.schema(schema).json(source)), out, at)
    return spark.read.parquet(out)


def cut(rng, rows, n):
    at = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True)]


# --- visible text

TEXT = "a < b <think>x <th</think>c<think></think> <thinker> d<think>open <think> y</think>e </think> f"


def test_visible_text_wherever_it_is_cut():
    want = "a < b c <thinker> de </think> f"
    text = TEXT + "<thi"  # what may be a tag waits at the end
    assert turns.visible("", text) == (want, "<thi")
    for a, b in itertools.combinations(range(len(text) + 1), 2):
        held, got = "", ""
        for piece in (text[:a], text[a:b], text[b:]):
            shown, held = turns.visible(held, piece)
            assert len(held) <= 14
            got += shown
        assert got == want, (a, b)


CHUNK = "key string, seq long, text string, done boolean"


def chunk_rows(rng):
    rows, at = [], {}
    for k in range(240):
        key = rng.choice(["a", "b", "hot", "hot"])
        at[key] = at.get(key, 0) + 1
        rows.append((key, at[key], rng.choice(["<th", "ink>", "</think>", "<think>", "word ", "x<", "y", None, "</th"]), rng.random() < 0.04))
    return rows


def test_visible_text_on_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = chunk_rows(rng)
    want = sorted(map(tuple, turns.visible_text(spark.createDataFrame(rows, CHUNK)).collect()))
    got = streamed(spark, tmp_path, cut(rng, rows, 4), CHUNK, turns.visible_text)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


# --- turns

DELTAS = "key string, seq long, text string, index int, id string, name string, arguments string, done boolean"


def delta_rows(rng):
    rows, at = [], {}
    for k in range(300):
        key = rng.choice(["a", "b", "hot"])
        at[key] = at.get(key, 0) + 1
        call = rng.random() < 0.6
        rows.append((key, at[key], rng.choice(["say ", "<think>", "no</think>", None, ""]), rng.randrange(3) if call else None, rng.choice(["", f"id{k}", None]), rng.choice(["", "tool", None]), rng.choice(["1", "0", "[", "]", None]), rng.random() < 0.08))
    return rows


def plain_turns(rows):
    out, open_ = [], {}
    number = {}
    for key, _, text, index, id_, name, arguments, done in rows:
        turn = open_.setdefault(key, ["", "", {}])
        shown, turn[0] = turns.visible(turn[0], text or "")
        turn[1] += shown
        if index is not None:
            call = turn[2].setdefault(index, {"id": "", "name": "", "arguments": ""})
            call["id"], call["name"] = id_ or call["id"], name or call["name"]
            call["arguments"] += arguments or ""
        if done:
            calls = [(i, c["id"], c["name"], c["arguments"] if valid(c["arguments"]) else "{}") for i, c in sorted(turn[2].items()) if c["name"]]
            out.append((key, number.get(key, 0), turn[1], calls, True))
            number[key] = number.get(key, 0) + 1
            del open_[key]
    return sorted(out)


def valid(text):
    import json

    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def told(df):
    return sorted((r["key"], r["turn"], r["text"], [tuple(c) for c in r["calls"]], r["complete"]) for r in df.collect())


def test_turns_of_a_table_and_a_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = delta_rows(rng)
    want = plain_turns(rows)
    assert told(turns.turns(spark.createDataFrame(rows, DELTAS))) == want and any(t[3] for t in want)
    got = streamed(spark, tmp_path, cut(rng, rows, 4), DELTAS, turns.turns)
    assert told(got) == want
    said = sorted(map(tuple, turns.replies(got).collect()))
    assert said == sorted((k, n, t.strip()) for k, n, t, *_ in want if t.strip())


def test_a_turn_that_never_ends_expires(spark, tmp_path):
    rows = [("a", 1, "half", 0, "i", "tool", "[", False), ("b", 1, "all", None, None, None, None, True)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, DELTAS).write.json(source)
    query = turns.turns(spark.readStream.schema(DELTAS).json(source), expiry=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="500 milliseconds").start()
    try:
        wait_for(lambda: len(told(spark.read.schema(f"key string, turn long, text string, calls {turns.CALLS}, complete boolean").parquet(out))) == 2)
    finally:
        query.stop()
    assert told(spark.read.parquet(out)) == [("a", 0, "half", [(0, "i", "tool", "{}")], False), ("b", 0, "all", [], True)]


def wait_for(holds, seconds=60):
    end = time.monotonic() + seconds
    while True:
        try:
            if holds():
                return
        except Exception:  # nothing is written yet
            if time.monotonic() > end:
                raise
        assert time.monotonic() < end, "it didn't happen in time"
        time.sleep(0.5)


# --- seen ids

MESSAGES = "key string, seq long, id string, body string"


def plain_unseen(rows, limit):
    sets, out = {}, []
    for row in rows:
        known = sets.setdefault(row[0], OrderedDict())
        if row[2] not in known:
            out.append(row)
            known[row[2]] = True
            if len(known) > limit:
                known.popitem(last=False)
    return sorted(out)


def test_seen_ids_are_bounded_by_count(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "hot", "hot"]), k, f"m{rng.randrange(14)}", f"b{k}") for k in range(250)]
    want = plain_unseen(rows, 5)
    df = spark.createDataFrame(rows, MESSAGES)
    assert sorted(map(tuple, seen.unseen(df, "key", "id", "seq", 5).collect())) == want
    got = streamed(spark, tmp_path, cut(rng, rows, 4), MESSAGES, lambda s: seen.unseen(s, "key", "id", "seq", 5))
    assert sorted(map(tuple, got.collect())) == want
    assert len(plain_unseen(rows, 1000)) < len(want) < len(rows)


# --- settling

SNAPSHOTS = "key string, at timestamp, state string, checks int"
START = pd.Timestamp("2026-01-01T00:00:00Z")


def snapshot(key, seconds, state, checks):
    return key, (START + pd.Timedelta(seconds=seconds)).to_pydatetime(), state, checks


CASES = [
    snapshot("fails", 0, "pending", 1), snapshot("fails", 7, "failed", 2), snapshot("fails", 9, "success", 2),
    snapshot("calm", 0, "success", 1), snapshot("calm", 5, "success", 1), snapshot("calm", 21, "success", 1),
    snapshot("waits", 0, "success", 1),
    snapshot("turns", 0, "success", 1), snapshot("turns", 10, "pending", 1), snapshot("turns", 50, "failed", 1),
    snapshot("none", 0, "pending", 0), snapshot("none", 30, None, None),
    snapshot("appear", 0, "pending", 0), snapshot("appear", 50, "success", 3), snapshot("appear", 80, "success", 3),
    snapshot("late", 0, "pending", 2), snapshot("late", 90, "pending", 2), snapshot("late", 130, "success", 2),
    snapshot("edge", 0, "pending", 1), snapshot("edge", 100, "success", 1),
]
ENDS = {
    "fails": (7, "failed", settle.FAILED), "calm": (20, "success", settle.SUCCESS), "waits": (20, "success", settle.SUCCESS), "turns": (50, "failed", settle.FAILED), "none": (60, "success", settle.NONE),
    "appear": (70, "success", settle.SUCCESS), "late": (100, "failed", settle.LATE), "edge": (100, "failed", settle.LATE),
}


def ends(df):
    return {r["key"]: ((r["at"].timestamp() - START.timestamp()), r["state"], r["summary"]) for r in df.withColumn("at", F.col("at").cast("timestamp")).collect()}


def test_settled_tables(spark):
    assert ends(settle.settled(spark.createDataFrame(CASES, SNAPSHOTS), timeout=100)) == ENDS


def test_settled_streams_by_event_time(spark, tmp_path):
    by_time = sorted(CASES, key=lambda r: r[1])
    batches = [by_time[k : k + 4] for k in range(0, len(by_time), 4)]
    batches += [[snapshot("later", s, "pending", 1)] for s in (900, 901)]  # the watermark passes all timers
    got = ends(streamed(spark, tmp_path, batches, SNAPSHOTS, lambda s: settle.settled(s, timeout=100, clock="eventTime")))
    assert {k: v for k, v in got.items() if k != "later"} == ENDS


def test_settled_by_the_clock(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([snapshot("waits", 0, "success", 1), snapshot("hangs", 0, "pending", 1), snapshot("fails", 0, "failed", 1)], SNAPSHOTS).write.json(source)
    stream = settle.settled(spark.readStream.schema(SNAPSHOTS).json(source), settle=1)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="500 milliseconds").start()
    try:
        wait_for(lambda: spark.read.schema(f"key string, {settle.OUT}").parquet(out).count() == 2)
    finally:
        query.stop()
    got = {r["key"]: r["state"] for r in spark.read.parquet(out).collect()}
    assert got == {"waits": "success", "fails": "failed"}


@pytest.mark.parametrize(("given", "want"), [((1, 1, -5, 1), (30_000, 5_000, 0)), ((1800, 60, 20, 90), (1_800_000, 90_000, 20_000))])
def test_limits_have_floors(given, want):
    assert settle.limits(*given) == want
