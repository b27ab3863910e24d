"""Operators on documents: brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra
columns of clashing names."""

import collections
import hashlib
import math
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marlspark.llm import common, exact_dedup, mixing, ngram_join, packing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _row string, shard string, kept string, sig string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", None, "y", None, "z") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["w%d" % k for k in range(400)]
    out = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t", "b"), (4, "One two", "b"), (5, "one TWO", "b"), (6, "ÄÖ one", "b"), (7, "äö one", "c"), (8, "Same text", "c"), (8, "Same text", "c"), (None, "no id", None)]
    base = [rng.choice(words) for _ in range(120)]
    for k in range(30):
        copy = list(base)
        for at in rng.sample(range(120), k % 6):
            copy[at] = "new%d" % rng.randrange(1000)
        out.append((100 + k, " ".join(copy), rng.choice("abc")))
    out += [(200 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))), "hot") for k in range(60)]
    out += [(300 + k, " ".join(base[:60] + [rng.choice(words) for _ in range(10 + k)]), "c") for k in range(10)]
    out.append((400, "long " * 50_000, "c"))
    return out


def test_exact_dedup(spark, rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    got = exact_dedup.exact_dedup(make(spark, rows)).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    kept = collections.Counter()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((x for x in ids if x is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup.drop_copies(make(spark, rows)).count() == len(groups)


def test_exact_dedup_with_a_full_filter_gives_the_same(spark, rows):
    few = exact_dedup.exact_dedup(make(spark, rows), bits=exact_dedup.BLOCK)
    tiny = exact_dedup.exact_dedup(make(spark, rows * 2), bits=64)
    assert few.filter("kept").count() == tiny.filter("kept").count()


def brute_components(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, len(sets[k]), least.get(find(k))) for k, (i, _, _) in enumerate(rows))


def test_ngram_components(spark, rows):
    got = ngram_join.components(make(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_ngram_components_of_dense_groups(spark):
    """Near copies of many degrees, so that links exist beside the leader's."""
    rng = random.Random(11)
    base = ["b%d" % k for k in range(80)]
    rows = []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(80), rng.randrange(0, 5)):
            copy[at] = "n%d" % rng.randrange(40)
        rows.append((k, " ".join(copy[: 80 - rng.randrange(0, 12)]), "s"))
    got = ngram_join.components(make(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_shingler_column_equals_single_texts():
    import numpy as np
    import pyarrow as pa

    texts = ["", None, "a b c d e f", "A  B\tc d e\nF", " x ", "é ü ß", "one", "w " * 3000, "a b"]
    s = ngram_join.Shingler()
    for t, x in zip(texts, s.column(pa.array([t or "" for t in texts])), strict=True):
        assert np.array_equal(x, s(t))
    assert np.array_equal(s(texts[2]), s(texts[3])) and not np.array_equal(s("a b"), s("b a"))


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


def test_ngram_words_of_structure_and_long_words_are_told_apart(spark):
    """Words that a polynomial modulo a power of two can't tell apart, alone and inside of shingles, and very long ones."""
    a = thue_morse(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join("w%d" % k for k in range(30))
    long = "x" * 100_000
    rows = [(1, a, "s"), (2, b, "s"), (3, f"{a} {b}", "s"), (4, f"{b} {a}", "s"), (5, f"{a} one two three four five", "s"), (6, f"{b} one two three four five", "s"), (7, f"{rest} {a}", "s"), (8, f"{rest} {b}", "s")]
    rows += [(9, long, "s"), (10, long + "y", "s"), (11, long.upper(), "s"), (12, "y" + long, "s"), (13, a[:512], "s"), (14, b[:512], "s"), (15, a[:16], "s"), (16, b[:16], "s")]
    got = ngram_join.components(make(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (9, 11)} == {9}


def test_a_list_of_many_near_copies_and_others_stays_linear(spark, monkeypatch):
    """Many copies with one more word each share their shingles with two texts that link with none of them."""
    rng = random.Random(8)
    base = ["p%d" % k for k in range(60)]
    rows = [(k, " ".join([*base, "t%d" % k]), "s") for k in range(400)]
    rows += [(1000 + k, " ".join(base[:40] + ["o%d%d" % (k, rng.randrange(9)) for _ in range(25)]), "s") for k in range(2)]
    made = []
    real = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *args: made.append(pairs.count()) or real(pairs, *args))
    got = ngram_join.components(make(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert sum(made) < 6 * len(rows)


def test_operators_leave_only_the_tables_that_their_results_read(spark, rows):
    out = ngram_join.components(make(spark, rows))
    root = common.shared_dir(spark).removeprefix("file://")
    there = set(os.listdir(root))
    mine = common.reads(out)
    again = ngram_join.components(make(spark, rows))
    left = set(os.listdir(root)) - there
    assert mine <= there and left == common.reads(again) and len(left) <= 3
    assert out.count() == again.count() == len(rows)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(15)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.choice([1, 3, 9, 40, 700]))) for _ in range(rng.randrange(1, 30))) + rng.choice(["", " ", "\n\n"]) for _ in range(60)] + ["x" * 300, " " * 100, ""]
    whole = [ngram_join.Shingler()(t) for t in texts]
    for size in (1, 7, 16, 100):
        monkeypatch.setattr(ngram_join, "BYTES", size)
        s = ngram_join.Shingler()
        assert all(np.array_equal(s(t), x) for t, x in zip(texts, whole, strict=True))
        assert all(np.array_equal(a, x) for a, x in zip(s.column(pa.array(texts)), whole, strict=True))


def test_keep_one_keeps_columns_and_groups(spark, rows):
    got = ngram_join.keep_one(make(spark, rows))
    assert got.columns == make(spark, rows).columns
    want = {c for (i, _, c), _ in brute_components(rows).items() if i is not None}
    assert {r["doc_id"] for r in got.collect() if r["doc_id"] is not None} == want


def test_quality_base_counts_and_judgement(spark):
    clean = [(k, ("The quick brown fox %d jumps over a lazy dog, and so on. " % k) + " ".join("word%d%d" % (k, j) for j in range(80)), "a") for k in range(60)]
    junk = [(100 + k, " ".join("ab%d$$$ x%d***" % (j, k) for j in range(60)), "a") for k in range(6)]
    rep = [(200, "same words here " * 60, "a"), (201, "short", "a"), (202, None, "a"), (None, "", "a")]
    docs = make(spark, clean + junk + rep)
    rows = common.staged(quality.features(docs.select("doc_id", "text")), "t")
    got = {r["doc_id"]: r for r in quality.judged(rows, quality.fit_on(rows)).collect()}
    assert all(got[k]["kept"] for k in range(60)) and not any(got[100 + k]["kept"] for k in range(6))
    assert got[200]["n_repeat_words"] == 180 and got[200]["base_failed"] and got[201]["base_failed"] and got[202]["n_words"] == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == 60


def em_rows(patterns):
    """Patterns given as {names of failed rules: count}; all other rules vote 1."""
    return [(tuple(-1 if name in failed.split() else 1 for name in quality.RULES), n) for failed, n in patterns.items()]


def chance(model, failed):
    score, rules = quality._terms(model)
    score += sum(down if name in failed.split() else up for name, (up, down) in zip(quality.RULES, rules, strict=True))
    return 1 / (1 + math.exp(-score))


def test_quality_em_estimates_share_and_rules():
    """A rule that fires on good documents loses its say, and the class share is estimated: votes alone, the start without
    EM, would judge otherwise."""
    rows = em_rows({"": 5500, "digits": 3000, "symbols marks": 500, "capitals shouts": 500, "tables symbols": 500})
    model = quality.fit(rows)
    assert abs(model["good"] - 0.85) < 0.03 and model["rules"]["digits"][0] > 0.25
    assert chance(model, "digits") > 0.9 > 0.5 > chance(quality.start(), "digits")
    assert max(chance(model, x) for x in ("symbols marks", "capitals shouts", "tables symbols")) < 0.05
    mostly_bad = quality.fit(em_rows({"": 2000, "symbols marks": 3000, "capitals shouts": 3000}))
    assert 0.15 < mostly_bad["good"] < 0.35


def test_quality_em_equals_plain_em():
    """The same updates, written per document."""
    rows = em_rows({"": 40, "digits": 9, "symbols marks": 6, "digits marks": 3})
    model = quality.fit(rows, rounds=3)
    docs = [v for v, n in rows for _ in range(n)]
    share, rates = quality.GOOD, [list(quality.START) for _ in quality.RULES]
    for _ in range(3):
        post = []
        for v in docs:
            like = [share, 1 - share]
            for k, x in enumerate(v):
                for c in (0, 1):
                    like[c] *= rates[k][c] if x == -1 else 1 - rates[k][c]
            post.append([like[0] / sum(like), like[1] / sum(like)])
        share = (sum(p[0] for p in post) + quality.PRIOR * quality.GOOD) / (len(docs) + quality.PRIOR)
        for k in range(len(rates)):
            rates[k] = [(sum(p[c] for p, v in zip(post, docs, strict=True) if v[k] == -1) + quality.PRIOR * quality.START[c]) / (sum(p[c] for p in post) + quality.PRIOR) for c in (0, 1)]
            assert rates[k][0] <= rates[k][1]
    assert model["good"] == pytest.approx(share)
    assert [x for r in model["rules"].values() for x in r] == pytest.approx([x for r in rates for x in r])


def test_quality_very_long_texts_and_ties(spark):
    rng = random.Random(6)
    texts = [" ".join("v%d" % rng.randrange(50_000) for _ in range(60_000)), "one line, here.\n" * 20_000, None, ""]
    docs = make(spark, [(k, t, "s") for k, t in enumerate(texts)])
    rows = common.staged(quality.features(docs.select("doc_id", "text")), "t")
    got = {r["doc_id"]: r for r in quality.judged(rows, quality.fit_on(rows)).collect()}
    assert got[0]["n_words"] == 60_000 and not got[0]["base_failed"] and got[1]["n_repeat_words"] == 60_000 and got[1]["base_failed"]
    even = {"good": 0.5, "rules": dict.fromkeys(quality.RULES, (0.1, 0.1))}  # a posterior of 0.5 exactly keeps
    assert {r["doc_id"]: r["kept"] for r in quality.judged(rows, even).collect()} == {0: True, 1: False, 2: False, 3: False}


def test_quality_counts_equal_brute_force(spark):
    import re

    texts = ["a b c a b c", "x\nx\n \n \nx y", "#$ a|b <c> %", "a a a a", "ß Ä é", "one\x0btwo\x1cthree"]
    got = {r["text"]: r for r in quality.features(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[t][c] for c in quality.BASE) == want


def test_pfair_deviation_and_whole_mix(spark):
    counts = {"a": 500, "b": 120, "c": 33, "d": 1}
    weights = {"a": 5, "b": 3, "c": 2, "d": 1}
    cycle = mixing.pfair_cycle(weights)
    total = sum(weights.values())
    for s, w in weights.items():
        for t in range(total + 1):
            assert abs(sum(x < t for x in cycle[s]) - t * w / total) < 1
    docs = [(k, "t", s) for s, n in counts.items() for k in range(n)] + [(None, "t", None)]
    got = mixing.mixed(make(spark, docs), weights=weights, block_rows=4).collect()
    assert sorted(r["position"] for r in got) == list(range(len(docs)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert collections.Counter(r["source"] for r in got) == {**counts, "": 1}
    out = mixing.mix_documents(make(spark, docs))
    assert out.count() == len(docs) and out.columns == make(spark, docs).columns


def test_packing_covers_every_id_once(spark, rows):
    got = packing.packed(make(spark, rows), with_ids=True).collect()
    ids_of = packing.tokenizer()
    want = collections.Counter(tuple([*ids_of(t or ""), packing.END_ID]) for _, t, _ in rows)
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        docs[r["row"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) and len(r["ids"]) == r["length"]
    found = collections.Counter()
    for pieces in docs.values():
        pieces.sort(key=lambda r: r["start"])
        found[tuple(x for r in pieces for x in r["ids"])] += 1
        assert [r["start"] for r in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
    assert found == want
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= packing.MAX_TOKENS
    assert sorted(sequences) == list(range(len(sequences)))


def test_fast_tokenizer_equals_tokenizers():
    import public_tokenizers as files
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(files.path("byte_bpe_50k.json")), packing.tokenizer()

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"])))
    def same(text):
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids

    same()
    assert fast("a<|endoftext|>b") == slow.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_shortest_pack_first_places_all():
    rng = random.Random(3)
    histogram = collections.Counter(rng.randrange(1, 65) for _ in range(3000))
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = collections.Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 64
        for x in lengths:
            placed[x] += n
    assert placed == histogram
    used = sum(k * n for k, n in histogram.items())
    assert used / (64 * sum(n for _, n in patterns)) > 0.97
    assert packing.shortest_pack_first({1: 1000}, 64) == [((1,) * 64, 15), ((1,) * 40, 1)] or sum(n for _, n in packing.shortest_pack_first({1: 1000}, 64)) == 16


def test_shards_are_even_and_keep_copies_together(spark):
    docs = [(k, "text %d" % (k // 3 if k < 90 else k), "a") for k in range(300)] + [(500 + k, "hot copy", "a") for k in range(150)] + [(None, None, None), (7, "text 2", "a")]
    got = sharding.sharded(make(spark, docs), shards=5).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == len(docs)
    for k in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    where = collections.defaultdict(set)
    for r in got:
        where[(r["text_crc32"], r["size"])].add(r["shard"])
    assert len(where[(zlib.crc32(b"hot copy"), 8 + 16)]) <= 3
    cut = sum(len(s) > 1 for key, s in where.items() if key != (zlib.crc32(b"hot copy"), 24))
    assert cut <= 3


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, ngram_join.components, ngram_join.keep_one, quality.quality_filter, mixing.mixed, mixing.mix_documents, packing.packed, sharding.sharded])
def test_empty_tables(spark, f):
    assert f(make(spark, []).filter(F.lit(False))).count() == 0


def cut_groups(rows):
    shards = collections.defaultdict(set)
    for r in rows:
        shards[r["text_crc32"]].add(r["shard"])
    return sum(len(x) > 1 for x in shards.values())


def test_full_shards_swap_until_no_pair_is_cut(spark):
    docs = [(i, f"pair {i // 2}", "s") for i in range(4000)]  # no unique rows: every shard is full from the start
    got = sharding.sharded(make(spark, docs), shards=8).collect()
    assert len(got) == 4000 and set(collections.Counter(r["shard"] for r in got).values()) == {500}
    assert cut_groups(got) == 0


def test_exchange_keeps_the_quotas():
    rng = random.Random(7)
    for _ in range(50):
        room = [rng.choice([0, 0, 1, 3]) for _ in range(6)]
        pairs = [rng.sample(range(6), 2) for _ in range(12)]
        asked = {(min(p), max(p), True) if e else (*p, False): rng.randrange(1, 9) for p in pairs for e in (rng.random() < 0.5,)}
        left = list(room)
        moved = sharding.exchange(asked, left)
        assert all(sum(v) <= asked[k] and (k[2] or v[1] == 0) for k, v in moved.items())
        taken = [sum((v[0] - v[1]) * ((k[1] == s) - (k[0] == s)) for k, v in moved.items()) for s in range(6)]
        assert left == [r - t for r, t in zip(room, taken, strict=True)] and min(left) >= 0
    assert sharding.exchange({(0, 1, False): 2, (1, 2, False): 3, (2, 0, False): 2}, [0, 0, 0]) == {(0, 1, False): (2, 0), (1, 2, False): (2, 0), (2, 0, False): (2, 0)}


def test_mix_schedules_every_one_of_many_sources(spark):
    docs = [(i, "t", f"s{i // 2 % 300:03d}" if i % 2 else f"big{i % 8}") for i in range(6000)]
    weights = {"s299": 40, "big0": 100}
    got = mixing.mixed(make(spark, docs), weights=weights, block_rows=4).collect()
    own = {d[0]: d[2] for d in docs}
    assert len(got) == 6000 and all(own[r["doc_id"]] == r["source"] for r in got)
    assert sorted(r["position"] for r in got) == list(range(6000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert len({(r["source"], r["block"]) for r in got}) == len({r["slot"] for r in got})


def played(phases):
    """slot -> (source, block), phase by phase: (first slot, cycle, {slot: (source, block, weight, block within the phase)})."""
    out = {}
    for s, lo, hi, slot0, _, cycle, w, at in phases:
        for b in range(lo, hi):
            k = b - lo
            out.setdefault((slot0, cycle), {})[slot0 + k // w * cycle + at[k % w]] = (s, b, w, k)
    return out


@pytest.mark.parametrize("n_sources", [3, 40, 1500])
def test_mix_holds_the_pfair_bounds_in_every_phase(n_sources):
    """All slots of the whole schedule, followed one by one: each is filled once, within its block's window, a source's blocks come
    in order, and none is a block or more away from its share; beyond RESOLUTION sources too."""
    rng = random.Random(n_sources)
    counts = {f"s{k}": rng.randrange(1, 60 if n_sources > 100 else 400) for k in range(n_sources)}
    for weights in (mixing.target_weights(counts), {s: rng.randrange(1, 30) for s in counts}):
        block_rows = 4
        phases = played(mixing.schedule(counts, weights, block_rows))
        blocks = {s: -(-n // block_rows) for s, n in counts.items()}
        done, next_slot = dict.fromkeys(counts, 0), 0
        for (slot0, cycle), slots in sorted(phases.items()):
            assert slot0 == next_slot and sorted(slots) == list(range(slot0, slot0 + len(slots)))
            alive = [s for s in counts if done[s] < blocks[s]]
            assert cycle == sum(weights[s] for s in alive)
            have = dict.fromkeys(alive, 0)
            check = alive if n_sources <= 40 else rng.sample(alive, min(8, len(alive)))
            for t in range(slot0, slot0 + len(slots)):
                s, b, w, k = slots[t]
                assert b == done[s] + have[s] and k * cycle // w <= t - slot0 < -(-(k + 1) * cycle // w)
                have[s] += 1
                assert all(abs(have[x] - (t + 1 - slot0) * weights[x] / cycle) < 1 for x in check)
            for s, n in have.items():
                done[s] += n
            next_slot += len(slots)
        assert done == blocks


def test_mix_reads_shuffled_input_once(spark):
    docs = make(spark, [(i, f"t{i}", f"s{i % 3}") for i in range(200)]).repartition(7)
    assert common.settled(make(spark, []), "x") is not docs and common.reads(common.settled(docs, "x"))
    got = mixing.mix_documents(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(200))


def test_propagation_joins_small_groups_of_small_tables(spark, monkeypatch):
    """Cut groups before and after, at a size where a shard holds 20 rows."""
    rng = random.Random(9)
    docs, k = [], 0
    for g in range(150):
        for _ in range(rng.randrange(1, 7)):
            docs.append((k, f"text {g}", "s"))
            k += 1
    rng.shuffle(docs)
    seen = {}
    real = sharding.propagate

    def counted(state, room):
        out = real(state, room)
        seen["before"], seen["after"] = (df.filter(F.size("at") > 1).count() for df in (state, out))
        return out

    monkeypatch.setattr(sharding, "propagate", counted)
    got = sharding.sharded(make(spark, docs), shards=25).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(docs) and max(sizes.values()) - min(sizes.values()) <= 1
    assert seen["before"] > 80 and seen["after"] <= 0.25 * seen["before"] and cut_groups(got) == seen["after"]


def test_ranks_with_more_buckets_than_a_task_adds_up(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKETS", 4)
    rows = common.staged(spark.range(5000).selectExpr("id", "if(id % 3 = 0, null, id % 5) g"), "t")
    for group in ([], ["g"]):
        got = collections.defaultdict(list)
        for r in common.ranked(rows, group, ["id"], "k", 200_000).collect():
            got[r["g"] if group else 0].append(r["k"])
        assert all(sorted(x) == list(range(len(x))) for x in got.values()) and sum(map(len, got.values())) == 5000


def test_mix_deviates_by_less_than_a_block_with_many_sources():
    rng = random.Random(3)
    counts = {f"s{k}": rng.randrange(200, 300) for k in range(400)}
    weights = {s: rng.randrange(1, 9) for s in counts}
    phases = mixing.schedule(counts, weights, 1)
    assert {p[0] for p in phases} == set(counts)
    cycle, first = phases[0][5], [p for p in phases if p[3] == 0]
    end = min(p[3] for p in phases if p[3] > 0)
    by_slot = {}
    for s, lo, hi, _, _, c, w, at in first:
        by_slot.update({b // w * c + at[b % w]: s for b in range(lo, hi)})
    assert sorted(by_slot) == list(range(end)) and cycle == sum(weights.values())
    have = dict.fromkeys(counts, 0)
    for t in range(end):
        have[by_slot[t]] += 1
        if t % 97 == 0:
            assert all(abs(have[s] - (t + 1) * weights[s] / cycle) < 1 for s in counts)


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "a", "7", "́", " \n", "!"])
def test_packing_takes_long_runs(unit):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "start " + unit * (1_000_000 // len(unit)) + " end"
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.tokenizer()(text) == want


def test_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    """Sources written one after another and mixed: their shares of what the first sequences hold are the mix's, not those of the files
    or of lengths; no id is lost, and a file that is larger is not read first."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    monkeypatch.setattr(packing, "WINDOW", 64, raising=False)
    rng = random.Random(12)
    counts, rows = {"a": 500, "b": 300, "c": 100}, []
    for s, n in counts.items():  # the rare sources' texts are longer
        rows += [(len(rows) + k, " ".join("w%d" % rng.randrange(5000) for _ in range(rng.randrange(40, 400) * (1 + (s == "c")))), s) for k in range(n)]
    make(spark, rows).coalesce(2).write.parquet(str(tmp_path / "docs"))
    mixed = stages["mixing sources"](spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
    mixed.write.parquet(str(tmp_path / "mixed"))
    position = {r["doc_id"]: r["position"] for r in mixing.mixed(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    got = stages["packing"](spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).collect()
    assert {r["doc_id"]: r["n"] for r in spark.createDataFrame(got).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {r["doc_id"]: r["doc_tokens"] for r in got} and len(position) == 900
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, pieces in sequences.items():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(q["length"] for q in pieces[:j]) for j in range(len(pieces))] and sum(r["length"] for r in pieces) <= 2048
    first = [min(position[r["doc_id"]] for r in sequences[k]) for k in range(len(sequences))]
    assert first == sorted(first) and all(position[r["doc_id"]] // 64 == first[k] // 64 for k in sequences for r in sequences[k])
    order = sorted(position, key=position.get)
    source = {d: s for d, _, s in rows}
    for k in range(20, len(sequences), 20):  # a prefix of the sequences has the sources of a prefix of the mix, to within a window
        seen = {r["doc_id"] for j in range(k) for r in sequences[j] if r["start"] == 0}
        want = collections.Counter(source[d] for d in order[: len(seen)])
        assert all(abs(n - want[s]) < 64 for s, n in collections.Counter(source[d] for d in seen).items())


def test_places_in_files(spark, tmp_path):
    """Larger files are read first and files are cut; places go by names and rows all the same. Tables without files go by partition."""
    for k, (lo, hi) in enumerate([(0, 10), (10, 5000), (5000, 5001), (5001, 20000)]):
        spark.range(lo, hi, 1, 1).selectExpr("id", "id _file", "'x' _metadata").write.parquet(str(tmp_path / f"t/part={k}"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        docs = spark.read.parquet(str(tmp_path / "t"))
        got = common.in_order(docs, [F.col("id")], "place").collect()
        assert docs.withColumn("read", F.monotonically_increasing_id()).orderBy("read").first()["id"] != 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 20000 and all(r["id"] == r["place"] for r in got)
    for df in (spark.range(50), docs.limit(50), docs.union(docs)):
        got = common.in_order(df, [F.col("id")], "place").collect()
        assert len({r["place"] for r in got}) == len(got) == df.count()


def test_long_runs_go_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    rows = [(1, words(80) + " " * 1_000_000 + words(80), "a"), (2, words(120) + "\n" * 1_000_000 + "end", "b"), (3, words(300), "a")]
    docs = make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    ids = packing.tokenizer()
    assert kept == {i: len(ids(t)) + 1 for i, t, _ in rows if i in kept} and len(kept) >= 2


def test_components_say_when_they_arent_settled(spark):
    from marlspark.llm.components import connected

    chain = spark.range(400).selectExpr("id a", "id + 1 b")
    with pytest.raises(RuntimeError, match="settled"):
        connected(chain, rounds=2)
    assert {r["label"] for r in connected(chain).collect()} == {0}
