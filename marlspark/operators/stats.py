"""Paired statistics: exact tests as DataFrame operations, resampling per comparison with a fixed generator."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED, ITERATIONS, DRAWS, EXACT_LIMIT, TOLERANCE = 20260730, 10_000, 100_000, 20, 1e-12
#: Rows of a group that may be dealt to one task.
HEAVY = 500_000


def permutation_exact(pairs: DataFrame, group: list[str], diff: str) -> DataFrame:
    """Two-sided p over all sign vectors, for groups of at most EXACT_LIMIT differences; `permutation_test` takes others too. A group's differences are one
    array; each vector is a bit mask, and its sum is worked out in place, so a group makes 2^n numbers and no join."""
    got = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(diff)).alias("d")).filter(F.size("d") <= EXACT_LIMIT)
    n = F.size("d")
    masks = got.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, size(d)) - 1"))))
    signed = F.expr("abs(aggregate(transform(d, (x, i) -> if((shiftright(mask, i) & 1) = 1, x, -x)), 0D, (s, x) -> s + x) / size(d))")
    observed = F.expr("abs(aggregate(d, 0D, (s, x) -> s + x) / size(d))")
    return masks.groupBy(*group).agg(F.max(n).alias("pairs"), (F.sum((signed + TOLERANCE >= observed).cast("int")) / F.count(F.lit(1))).alias("p"))


def permutation_test(pairs: DataFrame, group: str, order: str, diff: str, iterations: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(group, pairs, p, exact): over all sign vectors for groups of at most EXACT_LIMIT pairs, over random ones beyond."""
    sizes = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    small, large = (pairs.join(sizes.filter(cond).select(group), group, "left_semi") for cond in (F.col("_n") <= EXACT_LIMIT, F.col("_n") > EXACT_LIMIT))
    exact = permutation_exact(small, [group], diff).select(group, F.col("pairs").cast("long").alias("pairs"), "p", F.lit(True).alias("exact"))
    return exact.unionByName(permutation_sampled(large, group, order, diff, iterations, seed).withColumn("exact", F.lit(False)))


def same_group(left: DataFrame, right: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """A join on group columns in which nulls are equal; the columns of left stay."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in group]
    return left.join(named, same, how).drop(*[f"_r_{c}" for c in group])


def with_group_rows(rows: DataFrame, few: DataFrame, group: list[str], n: str) -> DataFrame:
    """rows joined with the rows of their groups in few, where the column n has each group's number of rows. Groups of more than
    HEAVY rows, of which there are few, are sent to where their rows are; only rows of the others are dealt by group."""
    named = few.withColumnsRenamed({c: f"_r_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in group]
    heavy = F.broadcast(named.filter(F.col(n) > HEAVY))
    there = rows.join(heavy, same).drop(*[f"_r_{c}" for c in group])
    return there.unionByName(same_group(rows.join(heavy, same, "left_anti"), few.filter(F.col(n) <= HEAVY), group))


def exact_quantiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Per group one column for each of at: name -> p, the exact quantile, interpolated between neighbours; null values don't
    count, a null in a group column is a group of its own.

    No task gets a large group: a sketch gives an interval around each quantile, the rows below and above it are only counted, and
    those inside, about 4 / accuracy of the group, are counted per distinct value before their running sum is taken.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    names = list(at)
    bounds = [max(0.0, min(1.0, at[n] + side * 2 / accuracy)) for n in names for side in (-1, 1)]
    sketch = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", bounds, accuracy).alias("_q"))
    spans = sketch.select(*group, "_n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(at[n])).alias("p"), F.element_at("_q", 2 * k + 1).alias("lo"), F.element_at("_q", 2 * k + 2).alias("hi")) for k, n in enumerate(names)])).alias("_s")).select(*group, "_n", "_s.*")
    met = with_group_rows(rows, spans, group, "_n") if group else rows.join(F.broadcast(spans))  # without groups a row per quantile
    side = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), 1).otherwise(0)
    sided = met.withColumn("_side", side).withColumn("_in", F.when(F.col("_side") == 0, F.col("_v")))
    counts = sided.groupBy(*group, "k", "p", "_n", "_side", "_in").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    before = F.sum("_c").over(Window.partitionBy(*group, "k").orderBy("_side", "_in").rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("_n") - 1) * F.col("p")
    ranked = counts.withColumn("_end", before).withColumn("_start", F.col("_end") - F.col("_c"))
    # beyond the interval only its neighbours are known: the last row below it and the first one above
    known = lambda r: F.when(F.col("_side") == 0, F.col("_in")).when((F.col("_side") < 0) & (r == F.col("_end") - 1), F.col("_most")).when((F.col("_side") > 0) & (r == F.col("_start")), F.col("_least"))
    value_at = lambda r: F.max(F.when((F.col("_start") <= r) & (r < F.col("_end")), known(r)))
    got = ranked.groupBy(*group, "k").agg(value_at(F.floor(place)).alias("_a"), value_at(F.ceil(place)).alias("_b"), F.max(place - F.floor(place)).alias("_f"))
    return got.groupBy(*group).agg(*[F.max(F.when(F.col("k") == k, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))).alias(n) for k, n in enumerate(names)])


def mcnemar(pairs: DataFrame, group: list[str], candidate: Column, baseline: Column) -> DataFrame:
    """Discordant counts and min(1, 2 * P(Binomial(n, 1/2) <= smaller)); 1 without discordant pairs."""
    got = pairs.groupBy(*group).agg(F.count_if(candidate & ~baseline).alias("wins"), F.count_if(~candidate & baseline).alias("losses"))
    terms = "transform(sequence(0, cast(least(wins, losses) as int)), k -> exp(aggregate(if(k = 0, array(), sequence(1, k)), 0D, (s, i) -> s + ln((wins + losses - k + i) / i)) - (wins + losses) * ln(2D)))"
    p = F.expr(f"if(wins + losses = 0, 1D, least(1D, 2 * aggregate({terms}, 0D, (s, x) -> s + x)))")
    return got.withColumn("p", F.round(p, 9))


def holm(tests: DataFrame, p: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Adds adjusted: the running maximum of min(1, (n - rank) * p) in the order of p. For the tests of one report."""
    w = Window.partitionBy(*(group or [])).orderBy(p, *order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*(group or [])))
    raw = F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("_raw", raw).withColumn("adjusted", F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def claim(adjusted: Column, lower: Column, upper: Column, effect: Column, alpha: float = 0.05) -> Column:
    return (
        F.when((adjusted < alpha) & (lower > 0) & (effect > 0), "significant_improvement")
        .when((adjusted < alpha) & (upper < 0) & (effect < 0), "significant_regression")
        .when(effect > 0, "directional_improvement")
        .when(effect < 0, "directional_regression")
        .otherwise("null_or_inconclusive")
    )


def _quantile(values: list[float], p: float) -> float:
    at = (len(values) - 1) * p
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def bootstrap(pairs: DataFrame, group: str, order: str, diff: str, iterations: int = ITERATIONS, seed: int = SEED, confidence: float = 0.95) -> DataFrame:
    """Mean difference and percentile interval per comparison. The generator makes a comparison's draws depend on one
    another, so each comparison, a few hundred pairs, is one group of Python."""

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        d = [float(x) for x in pdf.sort_values(order)[diff]]
        rng = random.Random(seed)
        got = sorted(sum(rng.choice(d) for _ in d) / len(d) for _ in range(iterations))
        tail = (1 - confidence) / 2
        return pd.DataFrame([(pdf[group].iloc[0], len(d), sum(d) / len(d), _quantile(got, tail), _quantile(got, 1 - tail))], columns=[group, "pairs", "difference", "lower", "upper"])

    return pairs.groupBy(group).applyInPandas(resample, f"{group} {pairs.schema[group].dataType.simpleString()}, pairs long, difference double, lower double, upper double")


def permutation_sampled(pairs: DataFrame, group: str, order: str, diff: str, iterations: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(extreme + 1) / (iterations + 1) over random sign vectors, for groups above the exact limit."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        d = [float(x) for x in pdf.sort_values(order)[diff]]
        rng, observed = random.Random(seed), abs(sum(d) / len(d))
        extreme = sum(abs(sum(rng.choice((-1, 1)) * x for x in d) / len(d)) + TOLERANCE >= observed for _ in range(iterations))
        return pd.DataFrame([(pdf[group].iloc[0], len(d), (extreme + 1) / (iterations + 1))], columns=[group, "pairs", "p"])

    return pairs.groupBy(group).applyInPandas(draw, f"{group} {pairs.schema[group].dataType.simpleString()}, pairs long, p double")


def round_robin(rows: DataFrame, stratum: str, repo: str, shuffle: list[Column], quota: int) -> DataFrame:
    """Stratified sample: within a stratum repositories take turns, each giving its next row in shuffled order, until
    the quota is met. The turn is a row's number within its repository; shuffle gives (row order, repository order)."""
    turn = F.row_number().over(Window.partitionBy(stratum, repo).orderBy(shuffle[0]))
    place = Window.partitionBy(stratum).orderBy("turn", shuffle[1], shuffle[0])
    # a repository can give at most `quota` rows, which bounds what the second window sorts
    first = rows.withColumn("turn", turn).filter(F.col("turn") <= quota)
    return first.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= quota)


def seeded_order(values: Iterator[str], seed: int) -> list[str]:
    """The order that Python's generator gives for one stratum: for manifests, which are small."""
    out = sorted(values)
    random.Random(seed).shuffle(out)
    return out
