"""Mixing sources to target weights by Pfair scheduling.

The rows of a source form blocks. Block b (from 0) of a source with integer weight w out of a sum D may start at slot
floor(b*D/w), its release, and must be done by ceil((b+1)*D/w), its deadline. Earliest deadline first among the
released blocks fills each slot, and then at any slot t a source has had less than one block more or less than t*w/D.
The schedule repeats every D slots, so the driver works out D slots only, or fewer where the phase ends before, and
each row's place is closed-form arithmetic on its rank within its source. When a source runs out, the rest go on with
their weights: a new phase.

Nothing is dropped, repeated or pooled, however many sources there are. The driver holds one row per source, and per
phase the sources that have a block in it and their slots, together never more than there are blocks.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, settled, staged, table, tidy

RESOLUTION, BLOCK_ROWS = 1000, 16
#: Blocks of a source that meet their phases in one join key, at least, and join keys of one source, at most about.
CHUNK, CHUNKS = 64, 4096
#: Phases that are sent to all executors; more are joined by shuffle.
SENT = 50_000
PLAN = pa.schema([("_s", pa.string()), *((c, pa.int64()) for c in ("_lo", "_hi", "_slot0", "_position0", "_cycle", "_w")), ("_slots", pa.list_(pa.int64()))])


def target_weights(counts: dict[str, int], power: float = 0.5) -> dict[str, int]:
    """Integer weights in proportion to count^power: 1 keeps the natural mix, 0 makes all sources equal."""
    total, resolution = sum(n**power for n in counts.values()), max(RESOLUTION, 4 * len(counts))
    return {s: max(1, round(resolution * n**power / total)) for s, n in counts.items()}


def pfair_cycle(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source within one cycle of sum(weights) slots."""
    cycle, slots = sum(weights.values()), {s: [] for s in weights}
    waiting = [(0, math.ceil(cycle / w), s) for s, w in sorted(weights.items())]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(cycle):
        while waiting and waiting[0][0] <= t:
            _, deadline, s = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if (b := len(slots[s])) < (w := weights[s]):
            heapq.heappush(waiting, (b * cycle // w, -(-(b + 1) * cycle // w), s))
    return slots


def _phase(order: list[tuple[int, str]], cycle: int, left: dict[str, int]) -> tuple[dict[str, list[int]], str | None]:
    """pfair_cycle over order, which is sorted by (-weight, source), up to the first source to use up its blocks:
    (slots of those sources that have any, the source that ran out or None). Costs as much as it fills slots."""
    slots: dict[str, list[int]] = {}
    waiting: list[tuple[int, int, str, int]] = []
    ready: list[tuple[int, str, int]] = []
    head = 0  # the sources from here on wait with their first block: released, the deadlines ascending
    for t in range(cycle):
        while waiting and waiting[0][0] <= t:
            _, deadline, s, w = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, w))
        if head < len(order) and (not ready or -(-cycle // -order[head][0]) <= ready[0][0]):
            w, s = -order[head][0], order[head][1]
            head += 1
        else:
            _, s, w = heapq.heappop(ready)
        own = slots.setdefault(s, [])
        own.append(t)
        if (b := len(own)) == left[s]:
            return slots, s
        if b < w:
            heapq.heappush(waiting, (b * cycle // w, -(-(b + 1) * cycle // w), s, w))
    return slots, None


def schedule(counts: dict[str, int], weights: dict[str, int], block_rows: int = BLOCK_ROWS) -> list[tuple]:
    """Phases: (source, first block, end block, slot and position where the phase starts, cycle, weight, slots)."""
    left = {s: -(-n // block_rows) for s, n in counts.items() if n > 0}
    done, slot, position, phases = dict.fromkeys(left, 0), 0, 0, []
    order, cycle = sorted((-weights[s], s) for s in left), sum(weights[s] for s in left)
    while left:
        at, out = _phase(order, cycle, left)
        if out is None:  # over a cycle: the first source to run out ends the phase with its last block
            ends = {s: (n - 1) // weights[s] * cycle + at[s][(n - 1) % weights[s]] + 1 for s, n in left.items()}
            out = min(ends, key=ends.get)
            end = ends[out]
            used = {s: end // cycle * weights[s] + bisect_left(at[s], end % cycle) for s in left}
        else:
            end, used = at[out][-1] + 1, {s: len(x) for s, x in at.items()}
        for s, n in used.items():
            if n:
                phases.append((s, done[s], done[s] + n, slot, position, cycle, weights[s], at[s]))
                done[s] += n
                left[s] -= n
        slot += end
        position += end * block_rows - (done[out] * block_rows - counts[out])
        del left[out], order[bisect_left(order, (-weights[out], out))]
        cycle -= weights[out]
    return phases


@tidy
def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id_col, source, block, release, deadline, slot, position (gapless from 0), _row.

    A null source counts as the source "". Repeated rows and null ids each take a place of their own; the order
    within a source is by hash. Sources without a weight get 1. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"), F.monotonically_increasing_id().alias("_row"))
    rows = staged(rows, "mix-rows")
    top = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).orderBy("_source").collect()}
    total = sum(top.values())
    given = target_weights(top) if weights is None else weights
    phases = schedule(top, {s: given.get(s, 1) for s in top}, block_rows)
    plan = docs.sparkSession.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*phases, strict=True), PLAN, strict=True)] if phases else [pa.array([], f.type) for f in PLAN], schema=PLAN))
    # a source's phases are found by chunks of blocks: a row meets those of its own chunk only
    chunk = max(CHUNK, total // block_rows // CHUNKS)
    plan = plan.withColumn("_c", F.explode(F.expr(f"sequence(_lo div {chunk}, (_hi - 1) div {chunk})")))
    placed = ranked(rows, ["_source"], ["_id", "_row"], "_rank", total).withColumn("_block", F.floor(F.col("_rank") / block_rows))
    placed = placed.withColumn("_chunk", F.expr(f"_block div {chunk}"))
    within = (F.col("_source") == F.col("_s")) & (F.col("_chunk") == F.col("_c")) & (F.col("_block") >= F.col("_lo")) & (F.col("_block") < F.col("_hi"))
    placed = placed.join(F.broadcast(plan) if len(phases) <= SENT else plan, within)
    placed = placed.withColumn("_b", F.col("_block") - F.col("_lo")).withColumn("_at", F.expr("_b div _w * _cycle + element_at(_slots, cast(_b % _w as int) + 1)"))
    return placed.select(
        F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_block").alias("block"),
        (F.col("_slot0") + F.expr("_b * _cycle div _w")).alias("release"), (F.col("_slot0") + F.expr("((_b + 1) * _cycle + _w - 1) div _w")).alias("deadline"),
        (F.col("_slot0") + F.col("_at")).alias("slot"), (F.col("_position0") + F.col("_at") * block_rows + F.col("_rank") % block_rows).alias("position"), "_row",
    )


@tidy
def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, int] | None = None) -> DataFrame:
    """All documents in mixed order: their own columns, range-partitioned and sorted by position, so that reading the
    written files in order gives the mix. Documents with the same id share a set of places. Rows are told apart by their
    place in docs, which is read twice; what isn't read from files as it is gets written first. Null sources, null ids and
    repeated rows stay, an empty table stays empty, and further columns are carried along whatever their names."""
    docs = settled(docs, "mix-documents")
    places = mixed(docs, id_col, source_col, weights).select(F.col(id_col).alias("_id"), F.col("_row").alias("_place"), "position")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_box"), F.col(id_col).alias("_own"), F.monotonically_increasing_id().alias("_row"))
    joined = boxed.join(staged(places, "mix-places"), (F.col("_row") == F.col("_place")) & F.col("_own").eqNullSafe(F.col("_id")))
    return joined.repartitionByRange("position").sortWithinPartitions("position").select("_box.*")


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source")).drop("_row")
