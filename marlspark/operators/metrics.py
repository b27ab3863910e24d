"""Information-retrieval metrics over ranked lists and gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)


def file_ranks(ranking: DataFrame, query: str, file: str, rank: str) -> DataFrame:
    """First rank of each file, ranked again from 1."""
    first = ranking.groupBy(query, file).agg(F.min(rank).alias("_first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_first", file))).drop("_first")


def judged(ranks: DataFrame, gold: DataFrame, query: str, item: str) -> DataFrame:
    """Adds rel (1 or 0) and the query's number of gold items, n_gold; queries without gold items are left out. Gold without
    a column `query` holds for all queries."""
    by = [c for c in (query, item) if c in gold.columns]
    marked = gold.select(*by).distinct().withColumn("rel", F.lit(1))
    flagged = ranks.join(marked, by, "left").fillna(0, ["rel"])
    if query in by:
        return flagged.join(marked.groupBy(query).agg(F.count(F.lit(1)).alias("n_gold")), query)
    return flagged.join(F.broadcast(marked.agg(F.count(F.lit(1)).alias("n_gold")))).filter("n_gold > 0")  # one row


def ideal(k: int):
    """Sum of 1 / log2(i + 1) for i up to min(n_gold, k)."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))


def measured(judged_ranks: DataFrame, query: str, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per query: recall, hit, precision and ndcg at each cutoff, and mrr. One aggregation for all."""
    at = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    sums = [x for k in cutoffs for x in (at(k, F.col("rel")).alias(f"_r{k}"), at(k, gain).alias(f"_g{k}"))]
    got = judged_ranks.groupBy(query).agg(F.max("n_gold").alias("n_gold"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), *sums)
    out = [query, "n_gold", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in cutoffs:
        out += [(F.col(f"_r{k}") / F.col("n_gold")).alias(f"recall_{k}"), (F.col(f"_r{k}") > 0).alias(f"hit_{k}"), (F.col(f"_r{k}") / k).alias(f"precision_{k}"), F.round(F.col(f"_g{k}") / ideal(k), 6).alias(f"ndcg_{k}")]
    return got.select(*out)


def context_efficiency(rows: DataFrame, query: str, chars: str, rel: str = "rel") -> DataFrame:
    """Characters, tokens (a quarter, rounded up), share of irrelevant characters and relevant rows per 1000 tokens."""
    got = rows.groupBy(query).agg(F.sum(chars).alias("chars"), F.sum(F.when(F.col(rel) == 0, F.col(chars)).otherwise(0)).alias("_waste"), F.sum(rel).alias("_hits"))
    tokens = F.ceil(F.col("chars") / 4)
    return got.select(query, "chars", tokens.alias("tokens"), F.when(F.col("chars") == 0, 0.0).otherwise(F.round(F.col("_waste") / F.col("chars"), 6)).alias("irrelevant_rate"), F.when(tokens == 0, 0.0).otherwise(F.round(F.col("_hits") * 1000 / tokens, 6)).alias("hits_per_1000_tokens"))
