"""Sharding by balanced label propagation.

Documents with equal texts are linked. Shards hold floor(N/K) or one more rows each, always. Groups that are large
against a shard, a LARGE-th of its rows and LEAST rows or more, of which there are at most 64*K, are laid out first,
split over shards only where they can't fit.
The members of all other groups start on shards in proportion to the room; then, round after round, each group whose
members are on several shards proposes to move those on the shard with fewest of them to the one with most (either way
if both have as many). The driver adds the proposals up per pair of shards and accepts what keeps the quotas when all
of it moves at once: exchanges between shards, full ones too, longer cycles, and chains that end where room is.
Rounds go on until QUIET of them in a row, each with other ties, have no accepted move. Documents without links fill the shards up to their quotas at the end.

All members of a group are neighbours of one another, so what its members' neighbours hold is one count per shard: the
joins along single links come down to an aggregation per group.

The driver sees the large groups, and per round at most 2*K^2 numbers. A group is one row with at most K (shard,
members) pairs; groups that have come together on one shard take no part in further rounds.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, ranked, staged, table, tidy, with_group

#: QUIET: propagation ends after so many rounds in a row, each with other ties, in which no group can move.
SHARDS, QUIET, BUCKETS = 40, 3, 1024
#: A group of a LARGE-th of a shard's rows is laid out first, but never one of less than LEAST rows.
LARGE, LEAST = 64, 8
OVERHEAD = 16


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def lay_out(groups: list[tuple[str, int]], room: list[int]) -> list[tuple[str, int, int, int]]:
    """(key, lo, hi, shard): members lo to hi of a large group. Largest first, whole where one shard has room for it,
    else over the emptiest shards. Takes from room."""
    out = []
    for key, n in groups:
        lo = 0
        while lo < n:
            whole = [k for k, r in enumerate(room) if r >= n - lo]
            k = min(whole, key=lambda k: room[k]) if whole else max(range(len(room)), key=lambda k: room[k])
            hi = lo + min(room[k], n - lo)
            out.append((key, lo, hi, k))
            room[k] -= hi - lo
            lo = hi
    return out


def _share(rank: Column, sizes: list[int]) -> Column:
    """The shard of a rank when shards take sizes[k] ranks each, one after another."""
    ends = F.array(*[F.lit(e).cast("long") for e in accumulate(sizes)])
    return F.size(F.filter(ends, lambda e: e <= rank)).cast("int")


def _spread(n: int, room: list[int]) -> list[int]:
    """n rows over shards in proportion to their room."""
    total, out, before = sum(room), [], 0
    for e in accumulate(room):
        at = -(-n * e // total) if total else 0
        out.append(at - before)
        before = at
    return [min(a, b) for a, b in zip(out, room, strict=True)] if sum(map(min, zip(out, room, strict=True))) == n else _fill(n, room)


def _fill(n: int, room: list[int]) -> list[int]:
    out = []
    for r in room:
        out.append(min(r, n))
        n -= out[-1]
    return out


def exchange(asked: dict[tuple[int, int, bool], int], room: list[int]) -> dict[tuple[int, int, bool], tuple[int, int]]:
    """What of the proposed moves goes at once without any shard over its quota: cycles of moves between shards, full
    ones too, and chains that end where room is. Takes from room and gives to it.

    asked: (a, b, either way) -> members that groups would move from a to b; either way, or from b to a instead.
    Returns per key the members to move from a to b and from b to a. No cycle or chain is left among the rest.
    """
    left, moved = dict(asked), {k: [0, 0] for k in asked}
    ends, slack = defaultdict(list), len(room)  # (to, key, direction) by shard; slack is the node of free room
    for (a, b, either), _ in sorted(asked.items()):
        ends[a].append((b, (a, b, either), 0))
        if either:
            ends[b].append((a, (a, b, either), 1))

    def push(edges: list, most: int | None = None) -> int:
        uses = Counter(k for k, _ in edges)
        n = min(left[k] // c for k, c in uses.items())
        n = n if most is None else min(n, most)
        for k, way in edges:
            left[k] -= n
            moved[k][way] += n
        return n

    def path(start: int, goal: int, held: tuple) -> list | None:
        """Edges from start to goal; through the node of free room at most once, as (None, shard left, shard entered)."""
        seen, queue = {start: None}, deque([start])
        while queue:
            u = queue.popleft()
            if u == slack:
                steps = [(v, None, 0) for v in range(len(room))]
            else:
                steps = [(v, k, way) for v, k, way in ends[u] if left[k] > (k == held)]
                if room[u] > 0:
                    steps.append((slack, None, 0))
            for v, k, way in steps:
                if v not in seen:
                    seen[v] = (u, k, way)
                    if v == goal:
                        out = []
                        while seen[v] is not None:
                            u, k, way = seen[v]
                            out.append((u, v, k, way))
                            v = u
                        return out[::-1]
                    queue.append(v)
        return None

    for (a, b, either), n in asked.items():  # straight exchanges first
        if either and n > 1:
            push([((a, b, True), 0), ((a, b, True), 1)])
    again = True
    while again:
        again = False
        for a in range(len(room)):
            for b, k, way in ends[a]:
                while left[k] > 0 and (found := path(b, a, k)) is not None:
                    gives, takes = next((u for u, v, *_ in found if v == slack), None), next((v for u, v, *_ in found if u == slack), None)
                    n = push([(k, way), *((x, w) for _, _, x, w in found if x is not None)], None if gives is None else room[gives])
                    if gives is not None:
                        room[gives] -= n
                        room[takes] += n
                    again = True
    return {k: tuple(v) for k, v in moved.items()}


def _proposals(cut: DataFrame, turn: int, any_pair: bool) -> DataFrame:
    """Adds f, t (shards), units (members of f) and either to each cut group: t has most of its members, f fewest, with
    ties broken by hash; any_pair takes two shards of it by hash alone."""
    tie = lambda a: F.xxhash64("key", a["shard"], F.lit(turn))
    by = (lambda a: F.struct(tie(a).alias("tie"), a["n"].alias("n"), a["shard"].alias("shard"))) if any_pair else (lambda a: F.struct(a["n"].alias("n"), tie(a).alias("tie"), a["shard"].alias("shard")))
    sorted_ = cut.withColumn("_o", F.array_sort(F.transform("at", by)))
    sorted_ = sorted_.withColumn("_x", F.element_at("_o", 1)).withColumn("_y", F.element_at("_o", -1))
    either, swap = F.col("_x.n") == F.col("_y.n"), (F.col("_x.n") > F.col("_y.n")) | ((F.col("_x.n") == F.col("_y.n")) & (F.col("_x.shard") > F.col("_y.shard")))
    f, t = F.when(swap, F.col("_y")).otherwise(F.col("_x")), F.when(swap, F.col("_x")).otherwise(F.col("_y"))
    return sorted_.withColumn("f", f["shard"]).withColumn("t", t["shard"]).withColumn("units", f["n"]).withColumn("either", either).drop("_o", "_x", "_y")


def propagate(state: DataFrame, room: list[int]) -> DataFrame:
    """state: key, at array<struct<n, shard>>; room: what each shard may take in all. Returns the last state."""
    loads = {r["shard"]: r["n"] for r in state.select(F.explode("at").alias("a")).groupBy("a.shard").agg(F.sum("a.n").alias("n")).collect()}
    free = [r - loads.get(k, 0) for k, r in enumerate(room)]
    square = F.aggregate("at", F.lit(0).cast("long"), lambda s, a: s + a["n"] * a["n"])
    told = lambda df: df.agg(F.count_if(F.size("at") > 1), F.coalesce(F.sum(F.when(F.size("at") > 1, square)), F.lit(0)), F.coalesce(F.sum(square), F.lit(0))).first()
    whole, cut, turn, quiet = [state.filter(F.size("at") < 2)], state.filter(F.size("at") > 1), 0, 0
    n_cut, before, _ = told(state)
    while n_cut and quiet < QUIET:
        classes = ["f", "t", "either"]
        asks = _proposals(cut, turn, quiet > 0).withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(turn), F.lit("order")), F.lit(BUCKETS)))
        counts = staged(asks.groupBy(*classes, "bucket").agg(F.sum("units").alias("n")), "proposals")
        asked = {(r["f"], r["t"], r["either"]): r["n"] for r in counts.groupBy(*classes).agg(F.sum("n").alias("n")).collect()}  # at most 2 * shards^2
        moved = exchange(asked, free)
        goes = [(*k, fwd, back) for k, (fwd, back) in moved.items() if fwd or back]
        turn += 1
        if not goes:
            discard(counts)
            quiet += 1
            continue
        earlier = Window.partitionBy(*classes).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*classes, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
        accepted = state.sparkSession.createDataFrame(goes, "f int, t int, either boolean, fwd long, back long")
        own = F.sum("units").over(Window.partitionBy(*classes, "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
        lo = asks.join(F.broadcast(accepted), classes, "left").withColumn("_own", F.coalesce(own, F.lit(0))).join(offsets, [*classes, "bucket"]).withColumn("lo", F.col("offset") + F.col("_own"))
        part = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least(F.col("lo") + F.col("units"), b) - F.greatest(F.col("lo"), a))
        fwd, back = F.coalesce("fwd", F.lit(0).cast("long")), F.coalesce("back", F.lit(0).cast("long"))
        net = part(F.lit(0).cast("long"), fwd) - part(fwd, fwd + back)
        shifted = F.transform("at", lambda a: F.struct((a["n"] + F.when(a["shard"] == F.col("t"), F.col("net")).when(a["shard"] == F.col("f"), -F.col("net")).otherwise(F.lit(0).cast("long"))).alias("n"), a["shard"].alias("shard")))
        new = staged(lo.withColumn("net", net).select("key", F.filter(shifted, lambda a: a["n"] > 0).alias("at")), "labels")
        discard(counts)
        whole.append(new.filter(F.size("at") < 2))
        cut = new.filter(F.size("at") > 1)
        n_cut, left, now = told(new)
        quiet, before = 0 if now > before else quiet + 1, left
    return reduce(DataFrame.unionByName, whole, cut)


@tidy
def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per input row: id_col, size (UTF-8 bytes plus 16), text_crc32, law ("rows"), shard, slot, grown_shard.

    Row counts of shards are at most one apart; slots are gapless from 0 in each. A null text is as an empty one;
    null ids and repeated rows are rows like others; an empty table gives an empty result. Of a text only its size and
    digests go on, however long it is; columns that aren't named don't matter, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "shard-rows")
    rows = staged(with_group(rows, ["key"], {"_n": (F.count(F.lit(1)), F.sum)}, ["row"]), "shard-groups")
    n = rows.count()
    room = quotas(n, shards)
    large = max(LEAST, n // shards // LARGE)
    sizes = rows.filter(F.col("_n") >= large).select("key", "_n").groupBy("key").agg(F.max("_n").alias("n")).collect()  # at most n / large
    fixed = lay_out(sorted(((r["key"], r["n"]) for r in sizes), key=lambda x: (-x[1], x[0])), room)

    spark = docs.sparkSession
    small = rows.filter((F.col("_n") > 1) & (F.col("_n") < large))
    n_small = small.count()
    start = ranked(small, [], ["row"], "_rank", n_small).withColumn("shard", _share(F.col("_rank"), _spread(n_small, room)))
    state = start.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "shard"))).alias("at"))
    state = propagate(staged(state, "labels"), room)
    loads = {r["shard"]: r["n"] for r in state.select(F.explode("at").alias("a")).groupBy("a.shard").agg(F.sum("a.n").alias("n")).collect()}
    free = [r - loads.get(k, 0) for k, r in enumerate(room)]

    before = lambda k: F.aggregate(F.slice("at", 1, k), F.lit(0).cast("long"), lambda s, a: s + a["n"])
    parts = state.select("key", "at", F.posexplode("at").alias("k", "a")).select(F.col("key").alias("_key"), before(F.col("k")).alias("lo"), (before(F.col("k")) + F.col("a.n")).alias("hi"), F.col("a.shard").alias("shard"))
    fixed_parts = spark.createDataFrame(fixed, "_key string, lo long, hi long, shard int")
    linked = ranked(rows.filter("_n > 1"), ["key"], ["row"], "_rank", n)
    within = (F.col("key") == F.col("_key")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    kept = ["_id", "size", "text_crc32", "row", "shard"]
    placed = linked.filter(F.col("_n") >= large).join(F.broadcast(fixed_parts), within).select(*kept)
    placed = placed.unionByName(linked.filter(F.col("_n") < large).join(parts, within).select(*kept))
    alone = ranked(rows.filter("_n = 1"), [], ["row"], "_rank", n).withColumn("shard", _share(F.col("_rank"), free)).select(*kept)
    placed = staged(placed.unionByName(alone), "shard-places")
    out = ranked(placed, ["shard"], ["row"], "slot", n)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
