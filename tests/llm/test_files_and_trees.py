"""Token files, filter audits and Merkle manifests against brute force, on tables with nulls, empty and long texts, ties,
repeated rows and extra columns of clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlspark.llm import common, filter_audit, merkle, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, row string, mask string, key string, id string, ids string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "k", "i", None) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["w%d" % k for k in range(300)]
    out = [(None, None, None, None), (None, None, None, None), (None, "Same", "en", "a"), (1, None, None, None), (2, "", "en", ""), (3, " \n\t", "de", ""), (4, "Same", "en", "a"), (4, "Same", "en", "a"), (5, "Same", None, "a"), (6, "ÄÖÜ ABC #x", "", "é")]
    out += [(10 + k, " ".join(rng.choices(words, k=rng.randrange(150, 260))) + rng.choice(["", " $", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"]), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", None])) for k in range(400)]
    out += [(500 + k, out[20 + k][1], "fr", "hot") for k in range(30)]  # copies
    out += [(600 + k, "same words " * 120, "fr", "hot") for k in range(300)]
    out.append((7, "Long TEXT " * 60_000, "en", "c"))
    rng.shuffle(out)
    return out


# --- filter audit


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    masks = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        again = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows) if len(t) < 9 else None
        masks.append([lang or "", len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), again, i in good, i in toxic])
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for m, (i, t, *_) in zip(masks, rows, strict=True):
        m[5] = i is not None and i > least[t or ""]
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {m[0] for m in masks}:
            left = [m for m in masks if m[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                k = 1 + "ABCDE".index(f)
                removed = [m for m in left if m[k]]
                redundant = sum(m[k] for m in gone)
                left = [m for m in left if not m[k]]
                gone += removed
                unique = sum(m[k] and sum(m[1:6]) == 1 for m in masks if m[0] == part)
                out[part, order, step] = [len(left), len(removed), redundant, unique, sum(m[6] for m in removed), sum(m[7] for m in removed)]
    total = collections.Counter()
    for (part, order, step), x in out.items():
        total[part, order[step - 1]] += x[1]
    return {(*k, *x, total[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_filter_audit(spark, rows):
    rng = random.Random(8)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, *_ in rows] + [(4, 1, 0), (4, 0, 0), (None, 1, 1), (99_999, 1, 1)]
    got = filter_audit.audit(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * len({lang or "" for _, _, lang, _ in rows})
    assert {tuple(r) for r in got} == brute_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(make(spark, []), none).collect() == []
    one = filter_audit.audit(make(spark, [(1, None, None, None)]), none).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and {r["shapley"] for r in one} == {0, 120}


def test_outcome_matrices_are_whole():
    m = filter_audit.outcome_matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    gone = (m["removed"].reshape(32, 120, 5)).sum(2)
    assert (gone == (np.arange(32) > 0)[:, None]).all()  # what fails any filter goes once in every order


# --- Merkle manifest


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def brute_merkle(rows, change, fanout):
    """Builds every level as lists and walks up from each leaf."""

    def leaf(i, t, lang, s):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, lang, None if t is None else len(t), t)))

    def grow(level):
        levels = [level]
        while len(level) > 1:
            level = [h(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
            levels.append(level)
        return levels

    def walk(levels, at, own, seen):
        for level in levels[:-1]:
            run = level[at // fanout * fanout : at // fanout * fanout + fanout]
            seen += [d for k, d in enumerate(run) if k != at % fanout]
            own, at = h(*run[: at % fanout], own, *run[at % fanout + 1 :]), at // fanout
        return own

    groups = collections.defaultdict(list)
    for i, t, lang, s in rows:
        d = leaf(i, t, lang, s)
        groups[s].append((i is not None, i or 0, d, i, leaf(i, change(i, t), lang, s) if change(i, t) is None or len(change(i, t)) == len(t) else None))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (members := sorted(groups[s]), grow([m[2] for m in members])) for s in names}
    top = grow([trees[s][1][-1][0] for s in names])
    out = collections.Counter()
    for k, s in enumerate(names):
        members, levels = trees[s]
        for at, (_, _, d, i, found) in enumerate(members):
            seen = []
            folded = walk(top, k, walk(levels, at, found, seen), seen)
            out[i, d, levels[-1][0], top[-1][0], h(*seen), folded, folded == top[-1][0]] += 1
    return out


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_merkle(spark, rows, fanout):
    docs = make(spark, rows)
    got = merkle.merkle(docs, now=merkle.tampered(docs), fanout=fanout).collect()
    change = lambda i, t: t if t is None or i is None or zlib.crc32(str(i).encode()) % 5 else low(t)
    assert collections.Counter(map(tuple, got)) == brute_merkle(rows, change, fanout)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [257], [1, 1], [1, 300, 16, 17, 1], [1] * 40])
def test_merkle_of_group_sizes(spark, sizes):
    rows = [(1000 * k + j, "Text", "en", "s%03d" % k) for k, n in enumerate(sizes) for j in range(n)]
    got = merkle.merkle(make(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == brute_merkle(rows, lambda i, t: t, 16)
    assert all(r["verified"] for r in got)


def test_merkle_of_nothing(spark):
    assert merkle.merkle(make(spark, [])).collect() == []


# --- token files


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(cache=500)


def test_encoder_on_every_kind_of_letter(tokenizer, encoder):
    for c in [*range(0x600), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x180E, 0x212A, 0x130, 0x3A3, 0x3C2, 0x1E96, 0x331]:
        x = f"Ab{chr(c)}cd a {chr(c)} b {chr(c)}{chr(c)}'S x{chr(c)}1 H{chr(c)} ab' {chr(c)}'ll'RE <|endoftext|>"[: -13 if c % 2 else None]
        assert np.frombuffer(encoder(x), dtype="<u4").tolist() == plain(tokenizer, x)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB'sS1 \t\né̱H!<|>", max_size=60))
def test_encoder_equals_the_library(tokenizer, encoder, text):
    want = plain(tokenizer, text)[:-1]
    assert np.frombuffer(encoder(text), dtype="<u4").tolist() == want
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.many([text, "", "a " + text, "Ünd " * 200])][0] == want


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "a", "7", "!", "é", "ab cd ", "x1!"])
def test_encoder_on_long_runs(tokenizer, encoder, unit):
    text = "start " + unit * (1_000_000 // len(unit)) + " end"
    assert np.frombuffer(encoder(text), dtype="<u4").tolist() == plain(tokenizer, text)[:-1]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
@pytest.mark.parametrize("levels", [2, 40])
def test_perfect_hash_is_minimal_and_perfect(n, levels):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    a[: n // 4] = 7  # equal first hashes are told apart by the second
    found = token_files.PerfectHash.of(a, b, levels)
    assert sorted(found.slots(a, b)) == list(range(n))
    bits = 64 * len(found.bits)
    assert levels < 40 or bits <= 6 * n + 64 * token_files.LEVELS


def test_token_files(spark, rows, tokenizer):
    docs = make(spark, rows + [(4, "Same <|endoftext|>", "en", "a")] * 40)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in token_files.token_files(docs, shard=4000, shard_docs=7, part_keys=20, with_ids=True).collect())
    want = collections.Counter()
    for i, t in docs.select("doc_id", "text").collect():
        ids = plain(tokenizer, t)
        want[i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), tuple(ids)] += 1
    assert got == want


def test_token_files_are_in_order(spark, rows):
    got = sorted((r["start"], r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in token_files.token_files(make(spark, rows), shard=3000).collect())
    assert [r[1:3] for r in got] == sorted((i is not None, i or 0) for i, *_ in rows)
    assert [r[0] for r in got] == [0, *itertools.accumulate(r[3] for r in got)][:-1]


def test_token_files_by_key(spark, rows, tokenizer):
    docs = make(spark, rows)
    to = f"{common.shared_dir(spark)}/token-files-test"
    files = token_files.write_files(docs, to, shard=5000, shard_docs=5, part_keys=50)
    assert len(files.shards) > 20 and len(files.parts) > 8
    reader = token_files.Reader(files, to)
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(plain(tokenizer, t))
    for i, want in texts.items():
        assert sorted(x.tolist() for x in reader[i]) == sorted(want)
    for absent in (-1, 8, 10**12):
        with pytest.raises(KeyError):
            reader[absent]
    asked = spark.createDataFrame([(4,), (4,), (None,), (-5,)], "doc_id long")
    found = collections.Counter((r["doc_id"], r["n_tokens"]) for r in token_files.lookup(asked, files, to).collect())
    assert found == collections.Counter([(-5, None), *((i, len(x)) for i in (4, None) for x in texts[i])])


def test_a_cut_shard_is_found(spark, tmp_path):
    from pyarrow import fs

    files = token_files.write_files(make(spark, [(1, "a b c", None, None)]), f"file://{tmp_path}")
    path = files.shards[0].path
    with open(path, "rb") as f:
        raw = f.read()
    with open(path, "wb") as f:
        f.write(raw[:20] + raw[22:])
    with pytest.raises(ValueError, match="isn't as long"):
        token_files.OpenShard(path, fs.LocalFileSystem(), files.width)


def test_token_files_of_nothing(spark):
    assert token_files.token_files(make(spark, []), with_ids=True).collect() == []


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["op12_filter_audit", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, query):
    from marlspark.llm import registry

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[query](spark, DATA)
    cursor = con.execute(registry.ORACLES[query])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == collections.Counter(cursor.fetchall())


def test_token_files_of_the_documents(spark, tokenizer):
    got = sorted(map(tuple, token_files.op11_token_files(spark, DATA).collect()))
    start, want = 0, []
    for i, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = plain(tokenizer, t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
