"""Models on tables: vectors and scores through a cache that fills itself, and ranking by whatever surface a model has.

A model is given by `make`, a function without arguments that loads it; it runs once in each Python worker. Its
surface, the first of these that it has:
* rank_many(queries, texts, top_k) -> [(place of the text, score)], the best score of a text over all queries
* rank(query, texts, top_k) -> the same for one query
* a call: texts -> vectors, compared by cosine.
A text's score must depend on it and the queries only, as it is worked out within batches.

The cache is a versioned table (model, id, and vector or score) to which only misses are added. A text's id is the SHA-256 of
what the model reads, so that the same text under another chunk id or version of a tree is a hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import versioned

BATCH, TOP = 64, 100
#: Models of this Python worker, by name.
_loaded: dict[str, Any] = {}


def loaded(name: str, make: Callable[[], Any]) -> Any:
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


def _through(asked: DataFrame, cache: str, model: str, made: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """asked(id, ...) with distinct ids -> (id, value): from the cache where it has them; the others are made, appended to it,
    and read from there. Of two writers that made the same one, the one who commits later drops its own."""
    spark = asked.sparkSession
    kept = lambda rows: rows.filter(F.col("model") == model)
    known = kept(versioned.read(spark, cache)) if versioned.newest(spark, cache) else None
    missing = asked if known is None else asked.join(known.select("id"), "id", "left_anti")
    # what is made is written before it is committed, so that a conflict doesn't make it again
    fresh = versioned.written(made(missing).select(F.lit(model).alias("model"), "id", value), cache)
    try:
        versioned.commit(spark, cache, lambda old: None if fresh.isEmpty() else fresh if old is None else fresh.join(kept(old).select("id"), "id", "left_anti").select(*old.columns), append=True)
    finally:
        versioned.dropped(fresh, cache)
    if versioned.newest(spark, cache) is None:
        return fresh.sparkSession.createDataFrame([], fresh.schema).select("id", value)
    return kept(versioned.read(spark, cache)).join(asked.select("id"), "id", "left_semi").select("id", value)


def vectors(texts: DataFrame, cache: str, model: str, make: Callable[[], Any], key: str = "chunk_id", text: str = "text", batch: int = BATCH) -> DataFrame:
    """texts(key, text) -> (key, vector): each distinct text is encoded once, ever, for a model's name. A null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(model, make)
        for rows in batches:
            for k in range(0, rows.num_rows, batch):
                part = rows.slice(k, batch)
                found = np.asarray(encoder(part.column(1).to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float32()))], names=["id", "vector"])

    named = texts.select(F.col(key), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_id", F.sha2("_text", 256))
    asked = named.groupBy(F.col("_id").alias("id")).agg(F.first("_text").alias("text"))
    got = _through(asked, cache, model, lambda rows: rows.select("id", "text").mapInArrow(encode, "id string, vector array<float>"), "vector")
    return named.join(got, F.col("_id") == F.col("id")).select(key, "vector")


def pair_scores(pairs: DataFrame, cache: str, model: str, make: Callable[[], Any], batch: int = BATCH) -> DataFrame:
    """pairs(query, text) -> with score, of a model [(query, text)] -> scores, each distinct pair worked out once, ever."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = loaded(model, make)
        for rows in batches:
            for k in range(0, rows.num_rows, batch):
                part = rows.slice(k, batch)
                found = scorer(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([float(x) for x in found], pa.float64())], names=["id", "score"])

    filled = [F.coalesce(c, F.lit("")) for c in ("query", "text")]
    # both lengths are part of the id, so that no other pair runs into the same characters
    named = pairs.withColumn("_id", F.sha2(F.concat(F.octet_length(filled[0]).cast("string"), F.lit(":"), *filled), 256))
    asked = named.groupBy(F.col("_id").alias("id")).agg(*[F.first(c).alias(n) for c, n in zip(filled, ("query", "text"), strict=True)])
    got = _through(asked, cache, model, lambda rows: rows.select("id", "query", "text").mapInArrow(score, "id string, score double"), "score")
    return named.join(got, F.col("_id") == F.col("id")).select(*pairs.columns, "score")


def ranked(chunks: DataFrame, queries: list[str], model: str, make: Callable[[], Any], key: str = "chunk_id", text: str = "text", top: int = TOP) -> DataFrame:
    """The `top` chunks(key, text) for the planned queries of one search, by the model's surface: (key, score), the best
    first, ties by key. Each batch is ranked whole; of it its best `top` go on. Blank queries don't count; none raises."""
    wanted = [q.strip() for q in queries if q and q.strip()]
    if not wanted:
        raise ValueError("at least one query is needed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(model, make)
        asked = None
        for rows in batches:
            if not rows.num_rows:
                continue
            texts, n = rows.column(1).to_pylist(), rows.num_rows
            if hasattr(encoder, "rank_many"):
                found = encoder.rank_many(wanted, texts, top_k=n)
            elif hasattr(encoder, "rank"):
                best: dict[int, float] = {}
                for q in wanted:
                    for k, s in encoder.rank(q, texts, top_k=n):
                        best[k] = max(s, best.get(k, s))
                found = list(best.items())
            else:
                asked = _unit(np.asarray(encoder(wanted), dtype=np.float64)) if asked is None else asked
                found = list(enumerate((_unit(np.asarray(encoder(texts), dtype=np.float64)) @ asked.T).max(axis=1)))
            at, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), pa.array([float(s) for s in scores], pa.float64())], names=[key, "score"])

    kind = chunks.select(key).schema[0].dataType.simpleString()
    scored = chunks.select(F.col(key), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(work, f"`{key}` {kind}, score double")
    return scored.orderBy(F.desc("score"), key).limit(top)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
