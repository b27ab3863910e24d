"""Grouped outcome reports, run matrices and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import exact_quantiles, same_group

#: Sizes of buckets of lines.
LEVELS = 12
RUNNING = ("QUEUED", "IN_PROGRESS", "PENDING", "WAITING")
PASSING = ("SUCCESS", "SKIPPED", "NEUTRAL")


def histogram(rows: DataFrame, group: list[str], value: str, name: str = "histogram") -> DataFrame:
    """Per group a map from value to count, over values that are neither null nor empty."""
    counts = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias(name))


def by_strategy(cases: DataFrame, group: str, verified: Column, duration: str, tokens: Column, cost: Column, compliant: Column) -> DataFrame:
    """Counts, rates, exact median and sums per strategy; cost is null where no row has one."""
    n = F.count(F.lit(1))
    sums = cases.groupBy(group).agg(
        n.alias("runs"), F.sum(verified.cast("int")).alias("verified"), (F.sum(verified.cast("int")) / n).alias("success_rate"),
        F.sum(tokens).alias("tokens"), F.round(F.sum(cost), 4).alias("cost"), (F.sum(compliant.cast("int")) / n).alias("scope_rate"),
    )
    return same_group(sums, exact_quantiles(cases, [group], duration, {"median_duration": 0.5}), [group], "left")


def outcome_sets(rows: DataFrame, arm: str, difficulty: str) -> DataFrame:
    """Aggregates per arm and per (arm, difficulty), with exact medians. Rates are over attempted rows; the scope
    count takes all rows, so that its rate may exceed 1. rows: attempted, completed, resolved, scope_compliant,
    total_tokens, duration_seconds."""
    count = lambda c: F.sum(F.col(c).cast("int"))
    rate = lambda c: F.when(count("attempted") == 0, 0.0).otherwise(count(c) / count("attempted"))
    sums = rows.groupingSets([[arm], [arm, difficulty]], arm, difficulty).agg(
        count("attempted").alias("attempted"), count("completed").alias("completed"), count("resolved").alias("resolved"), rate("resolved").alias("resolution_rate"),
        rate("scope_compliant").alias("scope_rate"), F.sum("total_tokens").alias("total_tokens"), F.grouping(difficulty).alias("_all"),
    )
    median = {"median_duration": 0.5}
    by_arm = exact_quantiles(rows, [arm], "duration_seconds", median).select(F.col(arm).alias("_a"), F.lit(None).cast(rows.schema[difficulty].dataType).alias("_d"), F.lit(1).alias("_g"), "median_duration")
    by_both = exact_quantiles(rows, [arm, difficulty], "duration_seconds", median).select(F.col(arm).alias("_a"), F.col(difficulty).alias("_d"), F.lit(0).alias("_g"), "median_duration")
    same = F.col(arm).eqNullSafe(F.col("_a")) & F.col(difficulty).eqNullSafe(F.col("_d")) & (F.col("_all") == F.col("_g"))
    return sums.join(by_arm.unionByName(by_both), same, "left").drop("_a", "_d", "_g", "_all")


def means(rows: DataFrame, difficulty: str, columns: list[str], digits: int = 6) -> DataFrame:
    """Rounded means over all completed rows and per difficulty (null: all)."""
    return rows.groupingSets([[], [difficulty]], difficulty).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in columns])


def task_success(rows: DataFrame, instance: str, resolved: str, attempted: str) -> DataFrame:
    return rows.filter(attempted).groupBy(instance).agg(F.avg(F.col(resolved).cast("int")).alias("success"))


def status_board(rows: DataFrame, status: str, statuses: list[str], order: list[Column], item: Column, shown: int = 20) -> DataFrame:
    """(status, n, items): every known status, also those without rows, with the number of all its rows and the first `shown`
    in order; a task hands on no more than these of a status."""
    first = rows.select(status, F.row_number().over(Window.partitionBy(status).orderBy(*order)).alias("k"), item.alias("item")).filter(F.col("k") <= shown)
    items = first.groupBy(status).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))
    got = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n")).join(items, status)
    known = rows.sparkSession.createDataFrame([(k, s) for k, s in enumerate(statuses)], f"place int, {status} string")
    return F.broadcast(known).join(got, status, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def check_rollup(checks: DataFrame, group: str) -> DataFrame:
    """checks(group, ordinal, name, status, conclusion) -> state and summary: any running check makes it pending, else any
    bad conclusion failed, with the first four named."""
    running = F.col("status").isin(*RUNNING) | ((F.col("conclusion") == "") & (F.col("status") != "COMPLETED"))
    bad = (F.col("conclusion") != "") & ~F.col("conclusion").isin(*PASSING)
    got = checks.groupBy(group).agg(F.bool_or(running).alias("_running"), F.array_sort(F.collect_list(F.when(bad, F.struct("ordinal", F.concat_ws("=", "name", "conclusion").alias("t"))))).alias("_bad"))
    state = F.when(F.col("_running"), "pending").when(F.size("_bad") > 0, "failed").otherwise("success")
    return got.select(group, state.alias("state"), F.when(state == "failed", F.array_join(F.transform(F.slice("_bad", 1, 4), lambda x: x["t"]), "; ")).alias("summary"))


def suite_result(checks: DataFrame, group: str) -> DataFrame:
    """checks(group, ordinal, name, passed, required): passed if every required check passed; failures in order."""
    failed = F.when(~F.col("passed"), F.struct("ordinal", "name"))
    got = checks.groupBy(group).agg(F.bool_and(F.col("passed") | ~F.col("required")).alias("passed"), F.array_sort(F.collect_list(failed)).alias("f"))
    return got.select(group, "passed", F.transform("f", lambda x: x["name"]).alias("failed"), F.when(F.size("f") > 0, F.col("f")[0]["name"]).alias("first_failure"))


def run_matrix(instances: DataFrame, arms: list[str], repetitions: int) -> DataFrame:
    """Every instance in every arm and repetition; the other two are constants, so each row makes its own."""
    out = instances.withColumn("arm", F.explode(F.array(*map(F.lit, arms)))).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    return out.withColumn("run_key", F.concat_ws("::", instances.columns[0], "arm", "repetition"))


def with_patches(instances: DataFrame, patches: DataFrame, key: str = "instance_id") -> DataFrame:
    """instances with their gold patches; raises where one has none, naming the first few."""
    known = patches.filter(F.col("patch").isNotNull())
    lost = [r[key] for r in missing(instances, known, key).orderBy(key).limit(5).collect()]
    if lost:
        raise ValueError(f"gold patch missing for {lost}")
    return instances.join(known.select(key, "patch"), key)


def missing(instances: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    return instances.select(key).join(patches.select(key), key, "left_anti")


def workflow_events(steps: DataFrame, run: str, step: str) -> DataFrame:
    """The events that a workflow emits, from its steps(run, step, phase, next_phase, detail, reason) in order: (run, ordinal,
    kind, phase, data). Before a run's first step it has started; each step starts, finishes and makes a transition, which
    is when its state is saved; after the last one the run has finished, in the phase it went to."""
    w, all_ = Window.partitionBy(run).orderBy(step), Window.partitionBy(run)
    rows = steps.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(all_))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    event = lambda ordinal, kind, phase, data: F.struct(ordinal.cast("long").alias("ordinal"), F.lit(kind).alias("kind"), phase.alias("phase"), data.alias("data"))
    at = (F.col("_k") - 1) * 4 + 1
    none = F.lit(None).cast("string")
    events = F.array(
        F.when(F.col("_k") == 1, event(F.lit(0), "run_started", F.col("phase"), none)),
        event(at, "phase_started", F.col("phase"), none),
        event(at + 1, "phase_finished", F.col("phase"), text("detail")),
        event(at + 2, "transition", F.col("phase"), F.concat_ws(">", "phase", "next_phase", F.when(text("reason") != "", F.col("reason")))),
        event(at + 3, "checkpoint_saved", F.col("next_phase"), none),
        F.when(F.col("_k") == F.col("_n"), event(at + 4, "run_finished", F.col("next_phase"), text("reason"))),
    )
    return rows.select(F.col(run), F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(run, "e.*")


def pending(matrix: DataFrame, finished: DataFrame, key: str = "run_key") -> DataFrame:
    return matrix.join(finished.select(key), key, "left_anti")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side: what a strict 1:1 join must not find."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def smallest_span(points: DataFrame, spans: DataFrame, file: str, line: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """For each point the span of its file that holds it and is shortest, the latest start winning. Buckets of lines make
    the range join an equi join: of sizes bucket, 8 * bucket and so on, each span is dealt to those that it touches of the smallest size
    that is at least its own, two at most, and a point meets one bucket of each size that any span has."""
    length = F.col(end) - F.col(start) + 1
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(length <= bucket * 8**k, k).otherwise(level)
    at = lambda c, k: F.floor(F.col(c) / (F.lit(bucket) * F.pow(F.lit(8.0), k))).cast("long")
    s = spans.withColumn("_k", level).withColumn("_b", F.explode(F.array_distinct(F.array(at(start, F.col("_k")), at(end, F.col("_k"))))))
    levels = [r["_k"] for r in s.select("_k").distinct().collect()]  # at most LEVELS
    p = points.withColumn("_k", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_b", at(line, F.col("_k")))
    hit = p.join(s, [file, "_k", "_b"]).filter(F.col(line).between(F.col(start), F.col(end)))
    cols = [c for c in spans.columns if c != file]
    best = F.min_by(F.struct(*cols), F.struct(F.col(end) - F.col(start), -F.col(start), F.to_json(F.struct(*cols))))
    return hit.groupBy(*points.columns).agg(best.alias("_s")).select(*points.columns, "_s.*")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, changed or same."""
    both = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")).join(after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y")), key, "full")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return both.select(key, change.alias("change"))
