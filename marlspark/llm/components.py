"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, tidy, with_group


def _least(edges: DataFrame) -> DataFrame:
    """edges(u, v), each with m = the least of u and its neighbours."""
    return with_group(edges, ["u"], {"_m": (F.min("v"), F.min)}, ["v"]).withColumn("m", F.least("u", "_m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


@tidy
def connected(edges: DataFrame, rounds: int = 500) -> DataFrame:
    """edges(a, b) -> (node, label) for every node of an edge; label is the least node of its component.

    Every step is one aggregation and one join with salted keys, and its result a written table, so neither a node
    with very many neighbours nor a long chain gathers in a task or in the lineage. Rounds, about the logarithm of the
    longest chain, go on until one changes nothing; if `rounds` of them don't suffice it raises.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-star")
        small = _least(large)
        new = staged(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct(), "small-star")
        discard(large)
        discard(now)
        now, before = new, mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"the components aren't settled after {rounds} rounds")
    own = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(own)
