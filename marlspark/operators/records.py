"""Record stores as tables: ranking, expiry, keyed upserts, retention and rule cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import memory_tokens

# Fixed values of the scores.
BASE_SCORES = {"direct_request": 100, "manual_idea": 80, "issue": 75, "pull_request": 85, "candidate": 45}
OTHER_SCORE = 50
BUG_HINTS = ("bug", "fix", "failure", "broken", "regression", "crash", "error", "issue")
BUG_LABELS = ("bug", "regression", "failure")
URGENT_HINTS = ("urgent", "p0", "p1", "high", "critical", "blocker")
STALE_DAYS, RETAIN_SECONDS = 60, 3600


def token_hits(tokens: Column, text: Column) -> Column:
    """How many of the tokens are substrings of the text."""
    return F.size(F.filter(tokens, lambda t: F.contains(text, t)))


def relevant_memories(memories: DataFrame, query: str, now: Column, k: int = 5, newest: int = 100) -> DataFrame:
    """Of the newest memories(id, title, description, body, importance, use_count, updated_at, modified_at) the best:
    2 * hits in title and description + hits in the body + 0.4 * importance + 0.1 * min(uses, 5) + recency."""
    tokens = memory_tokens(F.lit(query))
    meta, body = F.lower(F.concat_ws(" ", "title", "description")), F.lower(F.col("body"))
    age = (now.cast("timestamp").cast("long") - F.col("updated_at").cast("timestamp").cast("long")) / 86400
    recency = F.when(age <= 14, 0.3).when(age <= 30, 0.1).otherwise(0.0)
    rows = memories.orderBy(F.desc("modified_at"), "id").limit(newest).withColumns({"_m": token_hits(tokens, meta), "_b": token_hits(tokens, body)})
    score = F.col("_m") * 2.0 + F.col("_b") + F.col("importance") * 0.4 + F.least(F.col("use_count"), F.lit(5)) * 0.1 + recency
    return rows.filter("_m > 0 or _b > 0").withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.desc("modified_at"), "id").limit(k).drop("_m", "_b")


def expired(ttl_days: Column, created: Column, updated: Column, now: Column) -> Column:
    base = F.coalesce(updated, created).cast("timestamp")
    end = F.timestamp_add("DAY", ttl_days, base)
    return F.coalesce((ttl_days > 0) & (now.cast("timestamp") >= end), F.lit(False))


def stale(memories: DataFrame, usage: DataFrame, now: Column) -> DataFrame:
    """Unused memories of little importance that are at least STALE_DAYS old, least important and oldest first."""
    rows = memories.join(usage.select("id", "use_count"), "id", "left").fillna(0, ["use_count"])
    old = F.col("updated_at").cast("timestamp") <= F.timestamp_add("DAY", F.lit(-STALE_DAYS), now.cast("timestamp"))
    return rows.filter((F.col("importance") <= 1) & (F.col("use_count") == 0) & old)


def with_usage(memories: DataFrame, usage: DataFrame) -> DataFrame:
    return memories.join(usage, "id", "left").fillna(0, [c for c in usage.columns if c != "id"])


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key: one aggregation with a struct, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upserted(old: DataFrame, new: DataFrame, key: str, keep: list[str], raise_to: tuple[str, int] | None = None) -> DataFrame:
    """New rows replace old ones with the same key but keep the old values of `keep`, and the column of raise_to isn't
    lowered below its number."""
    cols = [c for c in new.columns if c != key]
    both = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_old")).join(new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_new")), key, "full")

    def value(c: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if raise_to and c == raise_to[0]:
            return F.when(F.col("_old") & F.col("_new"), F.greatest(o, F.lit(raise_to[1]))).otherwise(F.coalesce(n, o)).alias(c)
        return (F.coalesce(o, n) if c in keep else F.when(F.col("_new"), n).otherwise(o)).alias(c)

    return both.select(key, *[value(c) for c in cols])


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR IGNORE."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR REPLACE."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def merged_facts(facts: DataFrame, key: str, confidence: str, seq: str) -> DataFrame:
    """Per key the fact of the highest confidence, the later one of equals."""
    return latest(facts, [key], [confidence, seq])


def overridden(layers: list[DataFrame], key: str) -> DataFrame:
    """Union of definitions; of one name the one of the last layer."""
    out = layers[0].withColumn("layer", F.lit(0))
    for k, df in enumerate(layers[1:], 1):
        out = out.unionByName(df.withColumn("layer", F.lit(k)))
    return latest(out, [key], ["layer"])


def retained(rows: DataFrame, resolved_at: str, now: Column, seconds: int = RETAIN_SECONDS) -> DataFrame:
    """Rows younger than the limit; rows without a time go."""
    return rows.filter((now - F.col(resolved_at)) < seconds)


def last_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows in their order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def between_last(rows: DataFrame, at: str, start: Column, end: Column, n: int, order: list[str]) -> DataFrame:
    """Rows of [start, end), the last n of them."""
    return last_rows(rows.filter((F.col(at) >= start) & (F.col(at) < end)), order, n)


def card_score(kind: Column, text: Column, labels: Column, draft: Column, merge_state: Column, review: Column, age_days: Column) -> Column:
    t, lower = F.lower(text), F.transform(labels, F.lower)
    hint = lambda words: F.greatest(*[t.contains(w) for w in words])
    labelled = lambda words: F.arrays_overlap(lower, F.array(*map(F.lit, words)))
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BASE_SCORES.items() for x in kv]), kind), F.lit(OTHER_SCORE))
    issue, pull = kind == "issue", kind == "pull_request"
    return (
        base + points(issue & labelled(BUG_LABELS), 25) + points(issue & hint(BUG_HINTS), 15) + points(pull & draft, -30)
        + points(pull & (F.upper(merge_state) == "CLEAN"), 20) + points(pull & (F.upper(review) == "APPROVED"), 20)
        + points(kind.isin("direct_request", "manual_idea"), 10) + points(hint(URGENT_HINTS) | labelled(URGENT_HINTS), 20)
        + F.greatest(F.lit(0), 10 - F.floor(F.greatest(F.lit(0.0), age_days)))
    ).cast("long")


def first_rule(rows: DataFrame, rules: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, cond in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def budget_reason(elapsed: Column, phase: Column, use: dict[str, Column], limit: dict[str, Column]) -> Column:
    """Why a run must stop, by the order of the limits; null if it may go on."""
    model_phases = ("analyze", "plan", "execute", "repair", "replan")
    return (
        F.when(elapsed >= limit["wall"], "wall_clock_budget_exhausted")
        .when(phase.isin(*model_phases) & (use["calls"] >= limit["calls"]), "phase_call_budget_exhausted")
        .when((phase == "repair") & (use["repairs"] >= limit["repairs"]), "repair_budget_exhausted")
        .when((phase == "replan") & (use["replans"] >= limit["replans"]), "replan_budget_exhausted")
        .when(use["files"].isNotNull() & (use["files"] > limit["files"]), "changed_file_budget_exhausted")
        .when(use["diffs"] >= limit["diffs"], "repeated_diff_budget_exhausted")
        .when(use["actions"] >= limit["actions"], "repeated_action_budget_exhausted")
        .when(limit["tokens"].isNotNull() & (use["calls"] > 0) & use["tokens"].isNull(), "usage_unavailable")
        .when(use["tokens"] >= limit["tokens"], "token_budget_exhausted")
    )


def merged_labels(a: Column, b: Column) -> Column:
    clean = lambda x: F.filter(F.transform(x, lambda s: F.trim(s)), lambda s: s != "")
    return F.array_sort(F.array_distinct(F.concat(clean(a), clean(b))))


def requested_first(rows: DataFrame, requested: DataFrame, key: str, score: list[Column], cap: int) -> DataFrame:
    """Rows in the caller's order, then the others by score, at most cap."""
    both = rows.join(requested.select(key, F.col("position")), key, "left")
    return both.orderBy(F.col("position").asc_nulls_last(), *score).limit(cap)


def sessions_since(rows: DataFrame, key: str, at: str, since: Column, current: Column) -> DataFrame:
    return rows.filter((F.col(at) > since) & (F.col(key) != current)).select(key).distinct()


def ranked_names(rows: DataFrame, order: list[Column], partition: list[str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("rank") <= k)
