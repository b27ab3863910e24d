"""A Merkle manifest of a table, built and verified by Pregel-style supersteps over RDDs.

Leaves hash a row's fields and stand in order within their group; every `fanout` consecutive nodes become a parent until
one is left, the group's subroot; the subroots in the order of the groups form the tree on top in the same way. A vertex
is (tree, level, index): tree k is that of the k-th group, tree TOP the one above. In each superstep vertices that were
completed in the last one send their digest to their parent; a parent with all its children (`fanout` of them, or as many
as the one that is marked as the last says) hashes and sends in the next superstep, the others wait: subroots of groups
of different heights reach the tree on top at different times. Then the supersteps run in reverse: a vertex sends each
child the siblings on its way to the root, until the leaves have theirs and fold their own digest with them.

Leaves are numbered without a sort in one place: they are range-partitioned by group and order, each task numbers the
groups and rows of its partition, and what lies before a partition is a few numbers each, which the driver adds up: it
holds one row per partition, never one per row or group. Each superstep's vertices and undelivered paths are written
tables, so that no lineage grows and a lost executor costs its tasks alone. No message is for more than `fanout`
vertices, and a path has at most fanout - 1 digests a level; the last one goes once to the block of leaves below a parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, staged, table, tidy

FANOUT, TOP = 16, -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
VERTICES = "tree long, level int, index long, digest binary, last boolean, places array<int>, children array<binary>, levels array<int>, ends array<boolean>"
PATHS = "tree long, level int, index long, subroot binary, places array<int>, siblings array<binary>"
PROOFS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 of the fields one after another, each `-` if null and else its UTF-8 byte count, a colon and its value."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hashed(digests: Iterable[bytes]) -> bytes:
    """Of digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _numbered(leaves: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """leaves(id, group, leaf, other, row) in order -> a table (id, group, leaf, other, part, run, at, ends): the partition
    of a row, the number of its group and of the row among the group's in that partition, and whether the group ends there
    (null for the last row of a partition). And per partition: (part, runs, rows of the first run, of the last, first and last group)."""
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, at, before, held = TaskContext.get().partitionId(), -1, 0, None, None

        def shaped(batch: pa.RecordBatch, runs: list[int], ats: list[int], ends: list[bool | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(ats, pa.int64()), pa.array(ends, pa.bool_())], names=[*batch.schema.names, "part", "run", "at", "ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            runs, ats, ends = [], [], []
            for group in batch.column(1).to_pylist():
                new = run < 0 or group != before
                if ends:
                    ends[-1] = new
                elif held is not None:
                    held[3][-1] = new
                run, at, before = (run + 1, 0, group) if new else (run, at + 1, group)
                runs.append(run)
                ats.append(at)
                ends.append(None)
            if held is not None:
                yield shaped(*held)
            held = (batch, runs, ats, ends)
        if held is not None:
            yield shaped(*held)

    order = ["group", "id", "leaf", "row"]
    placed = leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "group", "leaf", "other")
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in placed.columns)
    out = staged(placed.mapInArrow(number, f"{shape}, part int, run long, at long, ends boolean"), "merkle-leaves")
    parts = out.groupBy("part").agg((F.max("run") + 1).alias("runs"), F.count_if(F.col("run") == 0).alias("first"), (F.max(F.struct("run", "at"))["at"] + 1).alias("last"), F.min_by("group", "run").alias("low"), F.max_by("group", "run").alias("high"))
    return out, sorted(tuple(r) for r in parts.collect())  # a row per partition


def _places(parts: list[tuple]) -> tuple[dict[int, tuple[int, int, bool]], int]:
    """For each partition: the number of its first group, the rows of that group before it, and whether its last group
    ends there; and the number of groups."""
    out, groups, rows, before = {}, 0, 0, None
    for k, (part, runs, first, last, low, high) in enumerate(parts):
        goes_on = before is not None and before[0] == low
        base, offset = (groups - 1, rows) if goes_on else (groups, 0)
        groups = base + runs
        rows = offset + first if runs == 1 else last
        before = (high,)
        out[part] = (base, offset, k + 1 == len(parts) or parts[k + 1][4] != high)
    return out, groups


def _upward(leaves: RDD, groups: int, fanout: int, spark: SparkSession, partitions: int) -> list[DataFrame]:
    """leaves((tree, index), digest, last) -> a table of vertices per superstep; those without a digest wait for children."""

    def to_parent(vertex: tuple) -> tuple | None:
        """(parent, (place, digest, level, last)) of a complete vertex; None of the root."""
        (tree, level, index), digest, last = vertex
        own, end = level, last
        if index == 0 and last:  # one node is left in this tree
            if tree == TOP or groups == 1:
                return None
            tree, level, index, end = TOP, 0, tree, tree + 1 == groups
        return (tree, level + 1, index // fanout), (index % fanout, digest, own, end)

    def gathered(item: tuple) -> tuple:
        (tree, level, index), messages = item
        places, children, levels, ends = zip(*sorted(messages), strict=True)
        complete = len(places) == (places[-1] + 1 if ends[-1] else fanout)
        return tree, level, index, hashed(children) if complete else None, ends[-1], list(places), list(children), list(levels), list(ends)

    def messages(r: tuple) -> list[tuple]:
        key = (r["tree"], r["level"], r["index"])
        if r["digest"] is None:
            return [(key, (p, bytes(d), n, e)) for p, d, n, e in zip(r["places"], r["children"], r["levels"], r["ends"], strict=True)]
        sent = to_parent((key, bytes(r["digest"]), r["last"]))
        return [sent] if sent else []

    sent = leaves.map(lambda v: to_parent(((v[0][0], 0, v[0][1]), v[1], v[2]))).filter(bool)
    steps: list[DataFrame] = []
    while True:
        grouped = sent.combineByKey(lambda m: [m], lambda ms, m: [*ms, m], lambda a, b: a + b, partitions)  # at most fanout
        step = staged(spark.createDataFrame(grouped.map(gathered), VERTICES, verifySchema=False), "merkle-step")
        if step.isEmpty():
            discard(step)
            return steps
        steps.append(step)
        sent = step.rdd.flatMap(messages)


def _downward(steps: list[DataFrame], groups: int, fanout: int, spark: SparkSession, partitions: int) -> DataFrame:
    """Per leaf, or per block of `fanout` leaves below a parent (level 0, index of the block), its way to the root: a
    table PATHS. places[0] and siblings[0] of a block are those of the parent's children: all of them, with place null."""

    def to_children(item: tuple) -> list[tuple]:
        (tree, level, index), (vertices, paths) = item
        vertices, paths = list(vertices), list(paths)
        if not vertices:  # for a vertex of an earlier superstep
            return [(tree, level, index, *p) for p in paths]
        (children, levels), ((subroot, places, siblings),) = vertices[0], paths
        if tree != TOP and level == 1:  # once for all leaves below
            return [(tree, 0, index, subroot, [None, *places], [b"".join(children), *siblings])]
        out = []
        for place, (child, own) in enumerate(zip(children, levels, strict=True)):
            others = b"".join(children[:place] + children[place + 1 :])
            to = (tree, own, index * fanout + place) if tree != TOP or level > 1 else (index * fanout + place, own, 0)
            out.append((*to, child if tree == TOP and level == 1 else subroot, [place, *places], [others, *siblings]))
        return out

    whole = lambda r: ((r["tree"], r["level"], r["index"]), ([bytes(c) for c in r["children"]], r["levels"]))
    pending = lambda df: df.rdd.map(lambda r: ((r["tree"], r["level"], r["index"]), (r["subroot"] and bytes(r["subroot"]), r["places"], [bytes(s) for s in r["siblings"]])))
    if not steps:  # one leaf
        return spark.createDataFrame([(0, 0, 0, None, [], [])], PATHS)
    root = steps[-1].filter("digest is not null").select("tree", "level", "index", F.when(F.col("tree") != TOP, F.col("digest")).alias("subroot"))
    now = staged(root.select("*", F.array().cast("array<int>").alias("places"), F.array().cast("array<binary>").alias("siblings")), "merkle-paths")
    for step in reversed(steps):
        complete = step.filter("digest is not null").select("tree", "level", "index", "children", "levels")
        new = complete.rdd.map(whole).cogroup(pending(now), partitions).flatMap(to_children)
        table_ = staged(spark.createDataFrame(new, PATHS, verifySchema=False), "merkle-paths")
        discard(now)
        now = table_
    return now


def fold(leaf: bytes, places: list[int], siblings: list[bytes]) -> bytes:
    """The root that a leaf and the siblings on its way give."""
    for place, others in zip(places, siblings, strict=True):
        text = others.hex()
        leaf = hashlib.sha256((text[: 64 * place] + leaf.hex() + text[64 * place :]).encode()).digest()
    return leaf


@tidy
def merkle(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", now: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    now: fields as they are found when the manifest is verified, if not as they were hashed; the siblings are those of
    the manifest. Groups are ordered by their UTF-8 bytes, null first and apart from the empty string; the leaves of a
    group by id, null first, then by digest; equal rows have equal digests and a leaf each. A null field differs from an empty
    one. A lone leaf is its own subroot, a lone subroot the root, and a proof without siblings is the hash of nothing. Texts
    are hashed whole. An empty table gives an empty result; columns that aren't named don't matter.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = now or {}
    found = leaf_digest(now.get(f, F.col(f"`{f}`")) for f in fields) if now else F.lit(None).cast("binary")
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(F.col(f"`{id_col}`").alias("id"), group.alias("group"), leaf_digest(F.col(f"`{f}`") for f in fields).alias("leaf"), found.alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = staged(leaves.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))), "merkle-digests")
    ordered, parts = _numbered(leaves)
    discard(leaves)
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    if not parts:
        return spark.createDataFrame([], f"`{id_col}` {kind.simpleString()}, {PROOFS}")
    places, groups = _places(parts)

    def vertex(r: tuple) -> tuple:
        base, offset, ends = places[r["part"]]
        tree, index = base + r["run"], r["at"] + (0 if r["run"] else offset)
        return (tree, index), bytes(r["leaf"]), ends if r["ends"] is None else r["ends"], r["id"], r["other"] and bytes(r["other"])

    placed = ordered.rdd.map(vertex)
    steps = _upward(placed.map(lambda v: v[:3]), groups, fanout, spark, partitions)
    paths = _downward(steps, groups, fanout, spark, partitions)
    root = bytes(steps[-1].filter("digest is not null").first()["digest"]) if steps else None

    def proved(item: tuple) -> Iterator[tuple]:
        _, (own, ((subroot, ways, siblings),)) = item
        for index, leaf, id_, other in own:
            w, s = ways, siblings
            if w and w[0] is None:
                at = index % fanout
                w, s = [at, *w[1:]], [s[0][: 32 * at] + s[0][32 * (at + 1) :], *s[1:]]
            top = root or leaf
            folded = fold(other or leaf, w, s)
            yield id_, leaf.hex(), (subroot or leaf).hex(), top.hex(), hashlib.sha256("".join(x.hex() for x in s).encode()).hexdigest(), folded.hex(), folded == top

    by_block = placed.map(lambda v: ((v[0][0], v[0][1] // fanout), (v[0][1], v[1], v[3], v[4])))
    ways = paths.rdd.map(lambda r: ((r["tree"], r["index"]), (r["subroot"] and bytes(r["subroot"]), r["places"], [bytes(s) for s in r["siblings"]])))
    out = by_block.cogroup(ways, partitions).flatMap(proved)
    return staged(spark.createDataFrame(out, f"`{id_col}` {kind.simpleString()}, {PROOFS}", verifySchema=False), "merkle-proofs")


def tampered(docs: DataFrame) -> dict[str, Column]:
    """A fifth of the texts, by the checksum of the id, with A-Z lower-cased."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return {"text": F.when(picked, ascii_lower(F.col("text"))).otherwise(F.col("text"))}


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle(docs, now=tampered(docs))


def _oracle(fanout: int = FANOUT, levels: int = 6) -> str:
    """SQL with so many levels a tree spelled out: enough for fanout^levels leaves a source, and as many sources."""
    field = lambda f: f"coalesce(octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    step = f"list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT)"
    out = [f"""WITH hashed AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS found, row_number() OVER () AS rid FROM documents),
t0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i FROM hashed),
n0 AS (SELECT tree, i, leaf AS h FROM t0),
w0 AS (SELECT rid, doc_id, leaf, tree, i, found AS folded, '' AS proof FROM t0)"""]

    def grow(node: str, way: str, k: int, name: str) -> None:
        """One level up: trees with one node stay as they are."""
        out.append(f"""s{name}{k} AS (SELECT tree, count(*) AS size FROM {node} GROUP BY tree),
n{name}{k} AS (SELECT tree, i // {fanout} AS i, CASE WHEN max(size) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {node} JOIN s{name}{k} USING (tree) GROUP BY tree, i // {fanout}),
w{name}{k} AS (
    SELECT w.rid, w.doc_id, w.leaf, w.tree, w.i // {fanout} AS i, CASE WHEN max(z.size) = 1 THEN max(w.folded) ELSE sha256(string_agg(CASE WHEN n.i = w.i THEN w.folded ELSE n.h END, '' ORDER BY n.i)) END AS folded,
        max(w.proof) || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i <> w.i), '') AS proof
    FROM {way} w JOIN {node} n ON n.tree = w.tree AND n.i // {fanout} = w.i // {fanout} JOIN s{name}{k} z ON z.tree = w.tree GROUP BY w.rid, w.doc_id, w.leaf, w.tree, w.i)""")

    for k in range(1, levels + 1):
        grow(f"n{'' if k == 1 else 'a'}{k - 1}", f"w{'' if k == 1 else 'a'}{k - 1}", k, "a")
    out.append(f"""ntop AS (SELECT 0 AS tree, tree AS i, h FROM na{levels}), wtop AS (SELECT rid, doc_id, leaf, 0 AS tree, tree AS i, folded, proof FROM wa{levels})""")
    for k in range(1, levels + 1):
        grow("ntop" if k == 1 else f"nb{k - 1}", "wtop" if k == 1 else f"wb{k - 1}", k, "b")
    return ",\n".join(out) + f"""
SELECT w.doc_id, w.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.h AS verified
FROM wb{levels} w JOIN t0 USING (rid) JOIN na{levels} s ON s.tree = t0.tree CROSS JOIN nb{levels} r"""


ORACLE = _oracle()
