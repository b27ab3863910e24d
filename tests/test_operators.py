"""Hand-computed cases of single operators."""

import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from marlspark.functions import code as C
from marlspark.functions import text as T
from marlspark.operators import conversation as V
from marlspark.operators import evaluation as E
from marlspark.operators import metrics as M
from marlspark.operators import records as R
from marlspark.operators import retrieval as Q
from marlspark.operators import scan
from marlspark.operators import stats as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.code_tokens(F.lit("Foo_1 + 23 bar 汉字"))) == ["foo_1", "23", "bar", "汉字"]
    assert one(spark, T.estimate_tokens(F.lit(""))) == 0
    assert one(spark, T.estimate_tokens(F.lit("abcde"))) == 2
    assert one(spark, T.stratum(F.lit(" <15 MIN  fix"))) == "easy"
    assert one(spark, T.stratum(F.lit("weeks"))) is None
    assert one(spark, T.json_object(F.lit('x {"a": 1} y'))) == '{"a": 1}'
    assert one(spark, T.json_object(F.lit("x {a} y"))) is None
    assert one(spark, T.found_secrets(F.lit("AKIA" + "A" * 16 + " password = abcdefghijkl"))) == ["aws-access-key", "generic-secret"]
    assert one(spark, T.redacted(F.lit("token: abc, sk-abcdefgh"))) == "token: [REDACTED], [REDACTED]"


def test_failure_signature_ignores_paths_lines_and_times(spark):
    a = one(spark, T.failure_signature(F.lit("Error in /tmp/a/b.py:12 after 3.2s at 0xAB")))
    b = one(spark, T.failure_signature(F.lit("error in /home/x.py:7  after 1s at 0x12")))
    assert a == b


def test_query_plan(spark):
    p = T.query_plan(spark.createDataFrame([("`load_x` fails with KeyError in src/app/main.py and pkg.mod.fn for DataFrame",)], "t string"), "t").first()
    assert p["errors"] == ["KeyError"] and p["paths"] == ["src/app/main.py", "pkg.mod.fn"]
    assert set(p["identifiers"]) == {"load_x", "DataFrame"} and p["queries"][0] == p["original"]


def test_tfidf_matches_formula(spark):
    docs = spark.createDataFrame([(1, "a a b", "p"), (2, "b c", "a"), (3, "d", "q")], "id int, text string, path string")
    q = spark.createDataFrame([(0, "a b b")], "query_id int, query string")
    got = {r["id"]: r["score"] for r in Q.tfidf(docs, q, "id", "text", path_col="path").collect()}
    idf = lambda df: math.log(4 / (df + 1)) + 1
    assert got[1] == pytest.approx((1 + math.log(2)) * idf(1) + 2 * idf(2), abs=1e-6)
    assert got[2] == pytest.approx(2 * idf(2) + 2, abs=1e-6) and 3 not in got


def test_metrics_closed_form(spark):
    ranking = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "a", 3), ("q", "b", 4)], "q string, f string, rank int")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "q string, f string")
    m = M.measured(M.judged(M.file_ranks(ranking, "q", "f", "rank"), gold, "q", "f"), "q").first()
    assert (m["recall_1"], m["recall_3"], m["mrr"], m["precision_10"]) == (0.0, 1.0, 0.5, 0.2)
    ideal = 1 + 1 / math.log2(3)
    assert m["ndcg_3"] == pytest.approx((1 / math.log2(3) + 1 / 2) / ideal, abs=1e-6)


def test_holm_is_monotone(spark):
    got = S.holm(spark.createDataFrame([(0, 0.04), (1, 0.01), (2, 0.03)], "i int, p double"), "p", ["i"]).orderBy("i").collect()
    assert [r["adjusted"] for r in got] == pytest.approx([0.06, 0.03, 0.06])


def test_exact_tests(spark):
    zero = spark.createDataFrame([("g", 0.0)] * 4, "g string, d double")
    assert S.permutation_exact(zero, ["g"], "d").first()["p"] == 1.0
    pairs = spark.createDataFrame([("g", True, False)] * 5 + [("g", True, True)], "g string, c boolean, b boolean")
    assert S.mcnemar(pairs, ["g"], F.col("c"), F.col("b")).first()["p"] == pytest.approx(2 / 32)


def test_permutation_takes_groups_of_any_size(spark):
    rng = random.Random(1)
    small, large = [rng.gauss(0.3, 1) for _ in range(6)], [rng.gauss(0.1, 1) for _ in range(25)]
    rows = spark.createDataFrame([("s", k, x) for k, x in enumerate(small)] + [("l", k, x) for k, x in enumerate(large)], "g string, k int, d double")
    got = {r["g"]: r for r in S.permutation_test(rows, "g", "k", "d", iterations=400, seed=3).collect()}
    signed = [abs(sum((1 if m >> i & 1 else -1) * x for i, x in enumerate(small)) / 6) for m in range(64)]
    assert got["s"]["exact"] and got["s"]["p"] == pytest.approx(sum(x + 1e-12 >= abs(sum(small) / 6) for x in signed) / 64)
    draw = random.Random(3)
    extreme = sum(abs(sum(draw.choice((-1, 1)) * x for x in large) / 25) + 1e-12 >= abs(sum(large) / 25) for _ in range(400))
    assert not got["l"]["exact"] and got["l"]["pairs"] == 25 and got["l"]["p"] == pytest.approx((extreme + 1) / 401)


def test_exact_quantiles_of_few_and_many_rows(spark):
    import numpy as np

    rng = random.Random(2)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 700 + [1.0], "many": [rng.gauss(0, 1) for _ in range(9000)]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("one", None)], "g string, x double")
    at = {"least": 0.0, "low": 0.025, "half": 0.5, "high": 0.975, "most": 1.0}
    for accuracy in (10_000, 50):
        got = {r["g"]: r for r in S.exact_quantiles(rows, ["g"], "x", at, accuracy).collect()}
        for g, xs in groups.items():
            assert [got[g][n] for n in at] == pytest.approx([float(np.quantile(xs, p)) for p in at.values()])


def test_rows_of_large_groups_stay_where_they_are(spark, monkeypatch):
    """Groups over the bound meet their intervals by broadcast, even where Spark would not choose it; others and null groups by shuffle."""
    monkeypatch.setattr(S, "HEAVY", 200, raising=False)
    rng = random.Random(8)
    groups = {"large": [rng.gauss(0, 1) for _ in range(3001)], "few": [2.0, 4.0, 7.0], None: [float(k) for k in range(500)], "bound": [float(k % 7) for k in range(200)]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = S.exact_quantiles(rows, ["g"], "x", {"low": 0.1, "half": 0.5}, 50)
        got = {r["g"]: (r["low"], r["half"]) for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    quantile = lambda xs, p: S._quantile(sorted(xs), p)
    assert got == {g: pytest.approx((quantile(xs, 0.1), quantile(xs, 0.5))) for g, xs in groups.items()}
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_missing_gold_and_reranking(spark):
    instances = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    patches = spark.createDataFrame([("a", "p"), ("b", None)], "instance_id string, patch string")
    with pytest.raises(ValueError, match="gold patch missing.*b"):
        E.with_patches(instances, patches)
    assert E.with_patches(instances.filter("instance_id = 'a'"), patches).collect()[0]["patch"] == "p"
    c = spark.createDataFrame([("q", 0, 0.5), ("q", 1, 0.9), ("q", 2, 0.9), ("q", 3, 0.1)], "q string, i int, s double")
    assert [r["i"] for r in Q.reranked(c, "q", "s", "i", 3).orderBy("rank").collect()] == [1, 2, 0]


def test_dense_scores_in_blocks(spark):
    rng = random.Random(5)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(40)] + [(99, [0.0] * 4)]
    rows = spark.createDataFrame(vectors, "id int, v array<double>")
    queries = rows.filter("id < 7").select(F.col("v").alias("query_vector"))
    want = {r["id"]: r["dense"] for r in Q.dense_scores(rows, queries, "id", "v").collect()}
    got = {r["id"]: r["dense"] for r in Q.dense_scores(rows, queries, "id", "v", sent_bytes=64).collect()}
    assert got == pytest.approx(want) and want[3] == pytest.approx(1) and want[99] == 0
    assert {r["dense"] for r in Q.dense_scores(rows, queries.limit(0), "id", "v").collect()} == {0.0}
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v]
    assert want == pytest.approx({k: max(sum(a * b for a, b in zip(unit(v), unit(q), strict=True)) for _, q in vectors[:7]) for k, v in vectors})


def test_most_shared_terms(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(k, rng.sample("abcdefghijklmnop", rng.randrange(0, 9))) for k in range(300)] + [(900, None)]
    items = [(k, rng.sample("abcdefghijklmnopqrst", 6)) for k in range(11)] + [(50, []), (51, ["z"])]
    frames = spark.createDataFrame(docs, "d int, terms array<string>").repartition(5), spark.createDataFrame(items, "i int, terms array<string>")
    want = []
    for i, wanted in items:
        found = sorted((-len(set(wanted) & set(terms or [])), d) for d, terms in docs)
        want += [(i, d, -n, r) for r, (n, d) in enumerate(found[:7], 1) if n]
    for entries in (1 << 20, 13):
        monkeypatch.setattr(Q, "INDEXED", entries)
        assert sorted((r["i"], r["d"], r["n"], r["rank"]) for r in Q.most_shared(*frames, "d", "i", 7).collect()) == sorted(want)


def test_symbols_count_alike_for_any_number_of_queries(spark):
    chunks = spark.createDataFrame([(1, "x", "Foo.bar"), (2, "y", "oo.b"), (3, "z", "é"), (4, "w", "none"), (5, "v", "")], "id int, text string, symbol string")
    asked = [(0, "why does foo.bar2 fail"), (1, "É?")]
    few = spark.createDataFrame(asked, "query_id int, query string")
    many = few.unionByName(spark.range(2, 1200).selectExpr("cast(id as int) query_id", "concat('about q', id) query"))
    for q in (few, many):
        got = sorted((r["query_id"], r["id"], r["score"]) for r in Q.tfidf(chunks, q, "id", "text", symbol_col="symbol").collect())
        assert got == [(0, 1, 4.0), (0, 2, 4.0), (1, 3, 4.0)]


def test_null_groups_are_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 6.0), (None, None)], "g string, x double")
    assert {r["g"]: r["m"] for r in S.exact_quantiles(rows, ["g"], "x", {"m": 0.5}).collect()} == {"a": 2.0, None: 5.5}
    one = F.lit(1)
    got = E.by_strategy(rows, "g", F.col("x") > 1, "x", one, one, F.col("x") > 2)
    assert {r["g"]: (r["runs"], r["median_duration"]) for r in got.collect()} == {"a": (2, 2.0), None: (3, 5.5)}
    runs = spark.createDataFrame([(None, None, True, True, True, True, 1, 4.0), (None, "d", True, True, False, True, 1, 8.0)], "arm string, difficulty string, attempted boolean, completed boolean, resolved boolean, scope_compliant boolean, total_tokens long, duration_seconds double")
    assert sorted((r["difficulty"] or "", r["attempted"], r["median_duration"]) for r in E.outcome_sets(runs, "arm", "difficulty").collect()) == [("", 1, 4.0), ("", 2, 6.0), ("d", 1, 8.0)]


def test_terms_and_symbols_by_join_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a load_x", "p", "load_x"), (2, "b c", "q", "é1"), (3, "zz", "r", "")], "id int, text string, path string, symbol string")
    q = spark.createDataFrame([(0, "preload_x2 a b"), (1, "B é12")], "query_id int, query string")
    score = lambda: sorted(map(tuple, Q.tfidf(docs, q, "id", "text", "path", "symbol").collect()))
    few = score()
    monkeypatch.setattr(Q, "FEW_TERMS", 0)
    assert score() == few and len(few) >= 3


def test_workflow_events_of_one_run(spark):
    steps = spark.createDataFrame([("r", 1, "plan", "execute", "ok", None), ("r", 2, "execute", "done", "", "verified")], "run string, step int, phase string, next_phase string, detail string, reason string")
    got = [(r["kind"], r["phase"], r["data"]) for r in E.workflow_events(steps, "run", "step").orderBy("ordinal").collect()]
    assert got == [
        ("run_started", "plan", None), ("phase_started", "plan", None), ("phase_finished", "plan", "ok"), ("transition", "plan", "plan>execute"), ("checkpoint_saved", "execute", None),
        ("phase_started", "execute", None), ("phase_finished", "execute", ""), ("transition", "execute", "execute>done>verified"), ("checkpoint_saved", "done", None), ("run_finished", "done", "verified"),
    ]


def test_symbol_references_are_whole_words(spark):
    from marlspark.operators import symbols as Y

    files = spark.createDataFrame([("a.py", "load(x)\r\nif reload(y):\n  load_x = load\n"), ("b.py", "nothing")], "path string, text string")
    assert [(r["line"], r["text"]) for r in Y.references(files, "load").orderBy("line").collect()] == [(1, "load(x)"), (3, "load_x = load")]
    assert Y.search(C.symbols(files), " ").count() == 0 and [r["name"] for r in Y.search(C.symbols(files), "LOAD_").collect()] == ["load_x"]


def test_seeded_order_follows_the_generator():
    want = ["a", "b", "c"]
    random.Random(4).shuffle(want)
    assert S.seeded_order(["c", "a", "b"], 4) == want


def test_expansion_takes_streams_by_priority(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (0,)], "id int")
    got = Q.expanded([(a, [F.col("id")]), (b, [F.col("id")])], "id", 3).orderBy("stream", "place").collect()
    assert [(r["id"], r["stream"]) for r in got] == [(1, 0), (2, 0), (0, 1)]


def test_bootstrap_uses_the_fixed_generator(spark):
    d = [0.0, 1.0, 0.5]
    rng = random.Random(7)
    want = sorted(sum(rng.choice(d) for _ in d) / 3 for _ in range(50))
    rows = spark.createDataFrame([("g", k, x) for k, x in enumerate(d)], "g string, k int, d double")
    got = S.bootstrap(rows, "g", "k", "d", iterations=50, seed=7).first()
    assert got["difference"] == pytest.approx(0.5) and got["lower"] == pytest.approx(want[1] + (want[2] - want[1]) * 0.225)


def test_evaluation_median_and_histogram(spark):
    rows = spark.createDataFrame([("s", True, 3.0, 100, None, True, "x"), ("s", False, 5.0, 300, None, True, "")], "strategy string, v boolean, d double, t int, c double, ok boolean, failure string")
    got = E.by_strategy(rows, "strategy", F.col("v"), "d", F.col("t"), F.col("c"), F.col("ok")).first()
    assert (got["median_duration"], got["tokens"], got["cost"], got["success_rate"]) == (4.0, 400, None, 0.5)
    assert E.histogram(rows, ["strategy"], "failure").first()["histogram"] == {"x": 1}


def test_budget_packing_cuts_the_first_that_overflows(spark):
    blocks = spark.createDataFrame([("q", 1, "a" * 60), ("q", 2, "b" * 60), ("q", 3, "c" * 10)], "q string, k int, t string")
    got = Q.packed_blocks(blocks, ["q"], [F.col("k")], "t", budget=100, header=5).orderBy("k").collect()
    assert [len(r["taken"]) for r in got] == [60, 40] and got[1]["taken"].endswith(Q.MARKER)


def test_memory_upsert_keeps_creation_and_importance(spark):
    old = spark.createDataFrame([("k", "c0", 0, "x")], "k string, created string, importance int, body string")
    new = spark.createDataFrame([("k", "c1", 9, "y"), ("n", "c2", 3, "z")], old.schema)
    got = {r["k"]: tuple(r)[1:] for r in R.upserted(old, new, "k", ["created"], ("importance", 1)).collect()}
    assert got == {"k": ("c0", 1, "y"), "n": ("c2", 3, "z")}


BLOCKS = "conv int, turn int, role string, blocks array<" + V.BLOCK + ">"


def _text(s):
    return ("text", s, None, None, None, None, None)


def test_sanitize_drops_unmatched_tool_blocks(spark):
    use = lambda i: ("tool_use", None, i, "grep", None, None, None)
    result = lambda i: ("tool_result", None, None, None, i, "out", False)
    rows = [(1, 1, "user", [_text("hi")]), (1, 2, "assistant", [use("a"), use("b")]), (1, 3, "user", [result("a")]), (1, 4, "assistant", [_text(" ")]), (1, 5, "user", [result("z"), _text("ok")])]
    got = V.sanitized(spark.createDataFrame(rows, BLOCKS), "conv", "turn").orderBy("turn").collect()
    # the use of b has no result: the whole turn goes, then the result of a, then the blank turn
    assert [(r["turn"], [b["id"] or b["tool_use_id"] or b["text"] for b in r["blocks"]]) for r in got] == [(1, ["hi"]), (5, ["ok"])]
    whole = [(1, 1, "user", []), (1, 2, "assistant", [use("a"), _text("x")]), (1, 3, "assistant", []), (1, 4, "user", [result("a"), result("q")]), (1, 5, "assistant", [use("c")])]
    got = V.sanitized(spark.createDataFrame(whole, BLOCKS), "conv", "turn").orderBy("turn").collect()
    assert [(r["turn"], len(r["blocks"])) for r in got] == [(1, 0), (2, 2), (4, 2)]  # an empty user turn stays
    joined = V.tool_results(spark.createDataFrame(rows, BLOCKS), "conv", "turn").orderBy("id").collect()
    assert [(r["id"], r["content"]) for r in joined] == [("a", "out"), ("b", None)]


def test_split_keeps_tool_pairs(spark):
    use = lambda i: ("tool_use", None, i, "grep", None, None, None)
    result = lambda i: ("tool_result", None, None, None, i, "out", False)
    rows = [(1, 1, "user", [_text("a")]), (1, 2, "assistant", [use("x")]), (1, 3, "user", [result("x")]), (1, 4, "assistant", [use("y")])]
    messages = spark.createDataFrame(rows, BLOCKS)
    older, newer = V.split_recent(messages, 2, "conv", "turn")
    assert [r["turn"] for r in older.collect()] == [1]
    assert sorted(r["turn"] for r in newer.collect()) == [2, 3]  # the pair stays together, the open use at the end goes
    assert V.split_recent(messages, 9, "conv", "turn")[0].count() == 0


def test_cascade_steps(spark):
    text = "w" * 4000
    long = [(1, k, "assistant" if k % 2 else "user", text, k % 2 == 1) for k in range(30)]
    short = [(2, k, "user", "hi", False) for k in range(3)]
    stubborn = [(3, k, "user", text, False) for k in range(10)]
    rows = spark.createDataFrame(long + short + stubborn, "conv_id int, turn int, role string, text string, compactable boolean")
    steps = lambda limit: {r["conv_id"]: r["step"] for r in V.cascade(rows, limit).collect()}
    assert steps(10**9) == {1: "none", 2: "none", 3: "none"}
    assert steps(30_000)[1] == "micro" and steps(21_000)[1] == "collapse"
    assert steps(5000) == {1: "memory", 2: "none", 3: "summary"}
    got = V.cascade(rows, 5000).filter("conv_id = 1").orderBy("turn").collect()
    assert len(got) == 13 and got[0]["text"].startswith("user: www")


def test_message_parts_by_column_functions(spark):
    """The same pieces as split_message's, without a Python worker that holds texts."""
    rng = random.Random(21)
    texts = ["", None, " ", "\n" * 40, " \n x" + "y" * 30, "\n\n  " + "a" * 25, "a" * 10, "a" * 11, "a" * 10 + "\n", "a b" * 9 + "  ", "a" * 10 + " " * 30, "\x1c\x85" * 9 + "é" * 9, "\U0001f600a" * 30, "x \u3000\u2028" * 9]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for alphabet in ("ab \n", "abcdefg \n", "a \t\n\xa0", "a\U0001f600 \x1d\n", " \nx") for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for most in (1, 3, 10):
        df = V.message_parts(rows, "t", most)
        got = {}
        for r in sorted(df.collect(), key=lambda r: r["part"]):
            got.setdefault(r["k"], []).append(r["piece"])
            assert r["part"] == len(got[r["k"]]) - 1
        assert all(got.get(k, []) == list(V.split_message(t or "", most)) for k, t in enumerate(texts))
        assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    long = "".join(rng.choice(("\U0001f600", "a")) for _ in range(200_000)) + " " + "word\n" * 50_000
    got = [r["piece"] for r in V.message_parts(spark.createDataFrame([(1, long)], "k int, t string"), "t", 2000).orderBy("part").collect()]
    assert got == list(V.split_message(long, 2000))
    with pytest.raises(ValueError):
        V.message_parts(rows, "t", 0)


def test_split_message():
    assert list(V.split_message("aaa bbb\nccc ddd", 9)) == ["aaa bbb", "ccc ddd"]
    assert list(V.split_message("abcdef", 4)) == ["abcd", "ef"] and list(V.split_message("", 4)) == []
    assert list(V.split_message("     abcdefghij", 6)) == ["     a", "bcdefg", "hij"]  # a blank piece is cut at its limit
    with pytest.raises(ValueError, match="character"):
        list(V.split_message("abc", 0))


def test_code_functions():
    src = "import os\n\n@deco\ndef f(x):\n    return x\n\nclass A:\n    def g(self):\n        pass\n"
    rows = list(C.chunk_file("a.py", src))
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [(1, 3, "", "module"), (4, 5, "f", "functiondef"), (7, 9, "A", "classdef")]
    assert rows[0][5] == "import os\n\n@deco\n" and list(C.chunk_file("c.py", "async def g():\n    pass"))[0][4:] == ("asyncfunctiondef", "async def g():\n    pass")
    assert list(C.bounded(["aaa\n", "bb\n", "cccccccccc\n", "d"], 5, 7)) == [(5, 6, "aaa\nbb\n"), (7, 7, "ccccccc"), (8, 8, "d")]
    assert [r[:4] for r in C.document_symbols(src + "x = y = 1\nz: int = 2\n")] == [("f", "function", 4, 1), ("A", "class", 7, 1), ("A.g", "function", 8, 5), ("x", "variable", 10, 1), ("y", "variable", 10, 5)]
    assert list(C.symbol_spans(src)) == [("f", 4, 5), ("A", 7, 9), ("A.g", 8, 9)]
    assert list(C.chunk_file("b.py", "def (:\n"))[0][4] == "text"
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n--- a/y.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    assert list(C.changed_lines(patch)) == [("x.py", "old", 2), ("x.py", "new", 2), ("x.py", "new", 3), ("y.py", "old", 1)]
    assert [C.symbol_at("foo = bar", 1, k) for k in (1, 3, 4, 6, 7, 99, None)] == ["foo", "foo", "foo", "foo", "bar", "bar", "foo"]
    assert C.symbol_at("", 1, 1) is None and C.symbol_at("+", 1, 1) is None and C.symbol_at("a", 2, 1) is None


def test_next_run():
    at = datetime(2024, 1, 31, 23, 50, tzinfo=UTC)
    assert C.next_run("*/15 * * * *", at) == datetime(2024, 2, 1, 0, 0, tzinfo=UTC)
    assert C.next_run("0 9 * * 1", at, "Europe/Berlin") == datetime(2024, 2, 5, 8, 0, tzinfo=UTC)
    assert C.next_run("61 * * * *", at) is None


def test_glob_crosses_folders():
    import re

    assert re.match(scan.glob_pattern("src/*.py"), "src/a/b.py") and not re.match(scan.glob_pattern("src/?.py"), "src/ab.py")


def test_smallest_span_of_any_length(spark):
    rng = random.Random(5)
    spans = [("f", a, a + rng.choice([0, 3, 63, 64, 65, 500, 5000, 10**6])) for a in (rng.randrange(0, 3000) for _ in range(60))] + [("g", 5, 4), ("g", 0, 10**9)]
    points = [("f", rng.randrange(0, 9000)) for _ in range(150)] + [("g", 4), ("g", 10**9), ("h", 1)]
    got = E.smallest_span(spark.createDataFrame(points, "f string, line long").distinct(), spark.createDataFrame(spans, "f string, lo long, hi long"), "f", "line", "lo", "hi").collect()
    want = set()
    for f, n in set(points):
        held = [(hi - lo, -lo, hi) for g, lo, hi in spans if g == f and lo <= n <= hi]
        if held:
            want.add((f, n, -min(held)[1], min(held)[2]))
    assert {(r["f"], r["line"], r["lo"], r["hi"]) for r in got} == want and len(got) == len(want)
