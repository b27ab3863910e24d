"""Which filter of a set removes what, in every order: an audit by an incidence matrix product.

Each document has a mask of the filters that it fails. Per part, the documents of each mask are counted: all of them,
the good and the toxic ones. These histograms, stacked as rows of 2^5 numbers, times integer matrices of 2^5 by 600
(all 120 orders, 5 steps each) give every outcome: what is kept after a step, what is removed there, what would have
been but had gone before, and what fails this filter only. So texts are read once, whatever the number of orders.

Masks come from DataFrame functions. Whether a text occurs with a smaller id is worked out on digests: rows are counted
per text, part and label before they meet, so that a group of copies of any size is a few rows by then. Products run in
tasks over batches of parts; a part is at most 32 rows of counts. Nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidy

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
#: Rows with a null id are dealt over so many keys where ids are joined.
NULLS = 1024
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_fails(text: Column) -> list[Column]:
    """The conditions of filters A to D on a text that isn't null."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    times = lambda n, count: n * count.cast("long")
    return [
        F.size(words) < MIN_WORDS,
        times(100, F.size(F.array_distinct(words))) < times(MIN_DISTINCT, F.size(words)),
        times(100, F.regexp_count(text, F.lit("[A-Z]"))) > times(MAX_UPPER, F.length(text)),
        text.rlike(r"[#$%&*|]"),
    ]


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def outcome_matrices(filters: str = FILTERS) -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique_fails: 0/1 matrices, a row per mask, a column per order and step."""
    masks = np.arange(1 << len(filters))[:, None]
    bit = np.array([[1 << filters.index(f) for f in order] for order in orders(filters)])
    before = (np.cumsum(bit, axis=1) - bit).ravel()
    bit = bit.ravel()
    gone, fails = masks & before != 0, masks & bit != 0
    made = {"kept": ~gone & ~fails, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(masks == bit, gone.shape)}
    return {k: m.astype(np.int64) for k, m in made.items()}


def histograms(docs: DataFrame, labels: DataFrame, fails: list[Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and mask. Bit k of a mask is fails[k], the next one says that a
    row with a smaller id has the same text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = rows.groupBy("id", "sha", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(NULLS)) + 1).otherwise(F.lit(0).cast("long"))
    told = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    told = told.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    told = told.withColumn("_spread", F.lit(0).cast("long"))
    rows = rows.withColumn("spread", spread).join(told, (F.col("id") == F.col("_id")) & (F.col("spread") == F.col("_spread")), "left")
    # of each text: per part and label, the smallest id, its rows, those without an id, and all
    none = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    per = rows.groupBy("sha", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    per = per.agg(F.min("id").alias("low"), F.min_by("n", "id").alias("at_low"), none.alias("none"), F.sum("n").alias("n"))
    first = F.col("none") + F.when(F.col("low") == F.min("low").over(Window.partitionBy("sha")), F.col("at_low")).otherwise(0)
    both = per.withColumn("first", first).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + (1 << len(fails))).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.filter(n > 0).groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def outcomes(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Histograms as of `histograms` -> a row per part, order and step."""
    named, matrices, masks = orders(filters), outcome_matrices(filters), 1 << len(filters)
    steps = len(filters)
    columns = len(named) * steps
    own = np.array([filters.index(f) for order in named for f in order])
    same = (own[:, None] == own[None, :]).astype(np.int64)  # sums what a filter removes over all orders
    shape = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in OUTCOMES)])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(np.repeat(named, steps))
        step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(named)))
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stack = np.zeros((3, masks), dtype=np.int64)
                for c in cells:
                    stack[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                x = {k: stack @ m for k, m in matrices.items()}
                out = [*(x[k][0] for k in ("kept", "removed", "redundant", "unique_fails")), x["removed"][1], x["removed"][2], x["removed"][0] @ same]
                yield pa.RecordBatch.from_arrays([pa.array([part] * columns), names, step, *map(pa.array, out)], schema=shape)

    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most a struct per mask
    return stacked.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUTCOMES))


@tidy
def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per part, filter order and step, zeros included: part, filter_order, step and the long columns OUTCOMES.

    A null text is empty, a null part the empty string. Filter E fails a row whose text a row with a smaller id has, so
    rows with the smallest id of a text never fail it, however often that id is repeated; a row with a null id never
    fails it nor makes another fail it, and has no labels. Repeated rows count each; an id labelled several times is good
    (toxic) if one of its labels says so; labels of no document don't matter. No rows give no parts. Long texts are judged
    whole; further columns don't matter, whatever their names.
    """
    return outcomes(histograms(docs, labels, text_fails(F.col("text")), id_col, text_col, part_col))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again FROM texts),
masked AS (
    SELECT part, good, toxic, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * again::INT AS mask
    FROM cut),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM masked GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
named AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, s.step, 1 << (ascii(substr(filter_order, s.step, 1)) - 65) AS own, coalesce(list_sum(list_transform(range(1, s.step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::INT AS before FROM named, (SELECT unnest(range(1, 6))::INT AS step) s),
told AS (
    SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""
