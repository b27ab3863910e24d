"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before it kept and returns the columns of documents; the last returns pieces of
packed sequences. Between stages the table is written as Parquet into the shared folder and read again.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from marlspark.llm import exact_dedup, mixing, ngram_join, packing, quality
from marlspark.llm.common import delete, discard, reads, staged, table, tables_of, tidy

#: By thread and input: the tables that the last stage has made for itself, which its result reads until it's written.
_left: dict[tuple[int, str], list[str]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the one before it has left behind: its result is a table of its own by now."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = (threading.get_ident(), sf_dir)
        used = reads(docs)
        delete(spark, [p for p in _left.pop(run_of, []) if p.rsplit("/", 1)[-1] not in used])
        with tables_of() as made:
            out = f(spark, docs, sf_dir)
        _left[run_of] = list(made)
        return out

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null, empty or very short text is rejected, a very long one judged
    whole; repeated rows are judged alike; an empty table stays empty; further columns pass through, whatever their names."""
    return quality.quality_filter(docs)


@_stage
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, the one with the largest id; null counts as the empty text, so of all null and
    empty texts one stays; of rows with equal id and text one stays; a null id is below all others; an empty table stays
    empty; further columns pass through, whatever their names."""
    return exact_dedup.drop_copies(docs)


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link by word shingles the one with the smallest id stays, with all its rows if that
    id is repeated. Null, empty and wordless texts link with nothing and stay; a row with a null id stays only in a group
    without any other id; an empty table stays empty; further columns pass through, whatever their names."""
    return ngram_join.keep_one(docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves their sources by weight: none goes, repeated rows and null ids
    included; a null source counts as the source ""; an empty table stays empty; further columns pass through."""
    return mixing.mix_documents(docs)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences, which follow the mixed order of the documents: every row's, repeated
    ones included; a null or empty text has its end id alone, a very long one many pieces; no rows give no pieces; further
    columns are left behind."""
    return packing.packed(docs, keep_order=True).drop("row")


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, components and packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each result written and read again as the next one's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
        if before is not None:
            discard(before)
        before = docs
    delete(spark, _left.pop((threading.get_ident(), sf_dir), []))
    return docs
