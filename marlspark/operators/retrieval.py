"""Ranking of text chunks: TF-IDF, cosine, fusion, blending, structural expansion and budgeted selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens

SYMBOL_BONUS, PATH_BONUS, DIGITS = 4.0, 2.0, 6
LEXICAL_SHARE, DENSE_SHARE = 0.45, 0.55
MARKER = "\n...[truncated]"
#: Up to so many terms of all queries are tested where texts are cut into terms; more meet them in a join.
FEW_TERMS = 1000
#: Bytes of query vectors, and entries and items of an inverted index, that are sent to all tasks at once.
SENT_BYTES, INDEXED, ITEMS = 64 << 20, 1 << 20, 1 << 12
#: Counts of documents and items that are held at once.
CELLS = 1 << 18
#: Characters by which symbols and queries meet, and parts in which an item's best documents are merged first.
GRAM, PARTS = 3, 64


def term_counts(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): counts are combined within each task before terms shuffle."""
    return chunks.select(id_col, F.explode(code_tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df) from `term_counts`, where a term has one row per chunk."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf(chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, path_col: str | None = None, symbol_col: str | None = None) -> DataFrame:
    """(query_id, id, score) for queries(query_id, query): over a query's terms with repetition, (1 + ln tf) *
    (ln((N + 1) / (df + 1)) + 1), plus bonuses for the symbol in the raw query and for a term in the path; only
    positive scores, rounded.

    Only the query terms are kept of a text before anything shuffles.
    """
    terms = queries.select("query_id", F.explode(code_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = terms.select("term").distinct()
    few = [r["term"] for r in wanted.limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        exploded = chunks.select(id_col, F.explode(F.filter(code_tokens(F.col(text_col)), lambda t: t.isin(few))).alias("term"))
    else:
        exploded = chunks.select(id_col, F.explode(code_tokens(F.col(text_col))).alias("term")).join(wanted, "term", "left_semi")
    counts = exploded.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    total = chunks.agg(F.count(F.lit(1)).alias("n"))
    df = document_frequency(counts).join(F.broadcast(total))  # one row
    idf = df.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    score = F.col("qtf") * (1 + F.log("tf")) * F.col("idf")
    out = counts.join(idf, "term").join(terms, "term").groupBy("query_id", id_col).agg(F.sum(score).alias("score"))
    for col, points in ((path_col, PATH_BONUS), (symbol_col, SYMBOL_BONUS)):
        if col is None:
            continue
        if col == path_col:
            paths = chunks.select(id_col, F.explode(F.array_distinct(code_tokens(F.col(col)))).alias("term"))
            hit = paths.join(terms, "term").select("query_id", id_col).distinct()
        else:
            named = chunks.filter(F.col(col) != "").select(id_col, F.lower(col).alias("symbol"))
            hit = contained(named, queries.select("query_id", F.lower("query").alias("query"))).select("query_id", id_col).distinct()
        out = out.unionByName(hit.withColumn("score", F.lit(points)))
    out = out.groupBy("query_id", id_col).agg(F.sum("score").alias("score"))
    return out.filter("score > 0").withColumn("score", F.round("score", DIGITS))


def grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of n characters of a text; none of a shorter one."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def contained(named: DataFrame, queries: DataFrame) -> DataFrame:
    """named(.., symbol) x queries(query_id, query) of which the query holds the symbol, whatever their numbers. They meet by that run of
    GRAM characters of the symbol, or by the symbol itself if it is shorter, which the fewest queries have."""
    said = queries.select("query_id", "query", F.explode(F.concat(*[grams(F.col("query"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    often = said.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    symbols = named.select("symbol").distinct()
    parts = symbols.select("symbol", F.explode(grams(F.col("symbol"), F.least(F.length("symbol"), F.lit(GRAM)))).alias("gram"))
    rarest = parts.join(often, "gram", "left").groupBy("symbol").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(said, "gram").filter(F.col("query").contains(F.col("symbol")))
    return named.join(met.select("symbol", "query_id"), "symbol")


def most_shared(docs: DataFrame, items: DataFrame, id_col: str, item_col: str, k: int) -> DataFrame:
    """docs(id_col, terms), items(item_col, terms), arrays without repeats -> (item_col, id_col, n, rank): of each item the k
    documents that share most of its terms, ties by id; those that share none don't count.

    Items go to all tasks as inverted indices of at most about INDEXED entries and ITEMS items, a pass over the documents each; a
    document's counts are taken in place, and a task hands on no more than k documents of an item.
    """
    spark = docs.sparkSession
    kind = {c: df.select(c).schema[0].dataType.simpleString() for df, c in ((docs, id_col), (items, item_col))}
    entries, n_items = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count(F.lit(1))).first()
    passes = max(1, -(-entries // INDEXED), -(-n_items // ITEMS))
    out = None
    for p in range(passes):
        rows = items.filter(F.pmod(F.xxhash64(item_col), F.lit(passes)) == p).select(item_col, "terms").toArrow().combine_chunks()
        sizes = np.array([len(t or ()) for t in rows.column(1).to_pylist()], dtype=np.int64)
        flat = pa.array([t for terms in rows.column(1).to_pylist() for t in terms or ()], pa.string())
        words = flat.unique()
        order = np.argsort(of := pc.index_in(flat, words).to_numpy(zero_copy_only=False), kind="stable")
        held = np.repeat(np.arange(len(sizes)), sizes)[order]  # the items of each word, word by word
        starts = np.searchsorted(of[order], np.arange(len(words) + 1))
        sent = spark.sparkContext.broadcast((rows.column(0).combine_chunks(), words, held, starts))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            named, words, held, starts = sent.value
            n = len(named)
            found: list[list[tuple]] = [[] for _ in range(n)]  # of (- shared, id)
            least = np.ones(n, dtype=np.int64)  # what a document must share to be among the k
            id_type = None
            for batch in batches if n else ():
                id_type = batch.schema.field(0).type
                for at in range(0, batch.num_rows, step := max(1, CELLS // n)):
                    part = batch.slice(at, step)
                    counts = _shared(part.column(1), words, held, starts, n)
                    ids = part.column(0).to_pylist()
                    for item in np.flatnonzero((counts >= least).any(axis=0)):
                        own = found[item]
                        own += [(-int(counts[r, item]), ids[r]) for r in np.flatnonzero(counts[:, item] >= least[item])]
                        if len(own) >= 2 * k:
                            own.sort()
                            del own[k:]
                            least[item] = -own[-1][0]
            rows = [(item, x, -c) for item, own in enumerate(found) for c, x in sorted(own)[:k]]
            if rows:
                item, ids, shared = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([named.take(pa.array(item)), pa.array(ids, id_type), pa.array(shared, pa.int64())], names=[item_col, id_col, "n"])

        part = docs.select(id_col, "terms").mapInArrow(best, f"`{item_col}` {kind[item_col]}, `{id_col}` {kind[id_col]}, n long")
        out = part if out is None else out.unionByName(part)
    order = [F.desc("n"), id_col]
    # first within a few parts of an item's rows, as there are k of each task
    some = top_k(out.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(PARTS))), k, order, [item_col, "_part"]).drop("_part", "rank")
    return top_k(some, k, order, [item_col])


def _shared(terms: pa.ListArray, words: pa.Array, held: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Documents by items: how many of a document's terms an item has."""
    at = pc.index_in(terms.flatten(), words).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    known = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), dtype=bool)
    row, word = np.repeat(np.arange(len(terms)), sizes)[known], at[known].astype(np.int64)
    lengths = starts[word + 1] - starts[word]
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[word] - ends + lengths, lengths)
    return np.bincount(np.repeat(row, lengths) * n + held[place], minlength=len(terms) * n).reshape(len(terms), n)


def top_k(scores: DataFrame, k: int, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """The first k rows: over all as a bounded heap per task, or per partition by row number (column rank)."""
    if not partition:
        return scores.orderBy(*order).limit(k)
    w = Window.partitionBy(*partition).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero if a vector has norm zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def dense_scores(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Largest cosine of each vector over the planned queries(query_vector): every vector against every query, in blocks of
    queries that are sent to all tasks one after another; a row's largest so far stays with it, so that vectors are neither
    copied nor shuffled, however many queries there are. The driver holds one block, at most about sent_bytes. A vector without
    length has 0, as has every vector without queries."""
    spark = vectors.sparkSession
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("query_vector"))).first()
    blocks = max(1, -(-n * (dims or 0) * 8 // sent_bytes))
    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("_v"), F.lit(None).cast("double").alias("dense"))
    for b in range(blocks if n else 0):
        part = queries.filter(F.pmod(F.xxhash64("query_vector"), F.lit(blocks)) == b).select(F.col("query_vector").cast("array<double>").alias("q")).toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast(_unit(np.array(part.column(0).to_pylist(), dtype=np.float64)))

        def largest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    some = batch.slice(at, 1024)
                    found = (_unit(np.array(some.column(1).to_pylist(), dtype=np.float64)) @ sent.value.T).max(axis=1)
                    before = some.column(2).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.fmax(before, found))], names=[id_col, "_v", "dense"])

        rows = rows.mapInArrow(largest, f"`{id_col}` {kind}, _v array<double>, dense double")
    return rows.select(id_col, F.coalesce("dense", F.lit(0.0)).alias("dense"))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fused(lexical: DataFrame, dense: DataFrame, id_col: str) -> DataFrame:
    """Full outer join of both candidate lists: 0.45 * lexical / max lexical + 0.55 * max(0, dense), rounded."""
    most = lexical.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("most"))
    both = lexical.select(id_col, "score").join(dense.select(id_col, "dense"), id_col, "full").join(F.broadcast(most))
    value = LEXICAL_SHARE * F.coalesce("score", F.lit(0.0)) / F.col("most") + DENSE_SHARE * F.greatest(F.lit(0.0), F.coalesce("dense", F.lit(0.0)))
    return both.select(id_col, F.round(value, DIGITS).alias("score"))


def fused_candidates(lexical: DataFrame, dense: DataFrame, id_col: str) -> DataFrame:
    """Within the lexical candidates only; the cosine keeps its sign, and scores above 0 stay."""
    most = lexical.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("most"))
    both = lexical.select(id_col, "score").join(dense.select(id_col, "dense"), id_col, "left").join(F.broadcast(most))
    value = LEXICAL_SHARE * F.col("score") / F.col("most") + DENSE_SHARE * F.coalesce("dense", F.lit(0.0))
    return both.select(id_col, F.round(value, DIGITS).alias("score")).filter("score > 0")


def blended(candidates: DataFrame, base: str, rerank: str, weight: float) -> DataFrame:
    """(1 - weight) * base + weight * rerank, each min-max normalised over all candidates; no span gives zeros."""
    span = candidates.agg(*[f(c).alias(f"{n}_{c}") for c in (base, rerank) for n, f in (("lo", F.min), ("hi", F.max))])
    both = candidates.join(F.broadcast(span))  # one row

    def unit(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.when(hi == lo, 0.0).otherwise((F.col(c) - lo) / (hi - lo))

    return both.withColumn("blend", (1 - weight) * unit(base) + weight * unit(rerank)).drop(*span.columns)


def references(seeds: DataFrame, chunks: DataFrame, id_col: str, path_col: str, symbol_col: str, text_col: str) -> DataFrame:
    """(symbol, id): chunks of other files that mention a seed's symbol as a whole identifier. Tokens join on equality,
    where a pattern test would compare every seed with every chunk."""
    named = seeds.filter(F.col(symbol_col) != "").select(F.col(symbol_col).alias("symbol"), F.col(path_col).alias("_seed_path"))
    tokens = chunks.select(id_col, path_col, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("symbol"))
    return tokens.join(named, "symbol").filter(F.col(path_col) != F.col("_seed_path")).select("symbol", id_col, path_col).distinct()


def same_file(seeds: DataFrame, chunks: DataFrame, id_col: str, path_col: str, symbol_col: str, text_col: str) -> DataFrame:
    """Chunks of a seed's file of which either mentions the other's symbol: both ways are a join on file and symbol, so that
    chunks of one file don't all meet."""
    words = lambda df: F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    key = ["_path", "_symbol"]
    said = lambda df, name: df.select(F.col(id_col).alias(name), F.col(path_col).alias("_path"), words(df).alias("_symbol"))
    named = lambda df, name: df.filter(F.col(symbol_col) != "").select(F.col(id_col).alias(name), F.col(path_col).alias("_path"), F.col(symbol_col).alias("_symbol"))
    calls = said(seeds, "seed_id").join(named(chunks, id_col), key).select("seed_id", id_col)
    called = said(chunks, id_col).join(named(seeds, "seed_id"), key).select("seed_id", id_col)
    return calls.unionByName(called).filter(F.col("seed_id") != F.col(id_col)).distinct()


def reranked(candidates: DataFrame, query: str, score: str, index: str, k: int) -> DataFrame:
    """The k best candidates of each query by a reranker's scores, which the caller brings; of equal scores the earlier index."""
    return top_k(candidates, k, [F.desc(score), F.col(index)], [query])


def expanded(streams: list[tuple[DataFrame, list[Column]]], id_col: str, limit: int = 12) -> DataFrame:
    """Union of streams by priority, first occurrence of an id wins, at most `limit` rows: (id, stream, place)."""
    parts = []
    for k, (df, order) in enumerate(streams):
        first = df.orderBy(*order).limit(limit * 4).withColumn("place", F.row_number().over(Window.orderBy(*order)))
        parts.append(first.select(id_col, F.lit(k).alias("stream"), "place"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy(id_col).agg(F.min(F.struct("stream", "place")).alias("b")).select(id_col, "b.stream", "b.place")
    return best.orderBy("stream", "place", id_col).limit(limit)


def interleaved(main: DataFrame, extra: DataFrame, every: int = 3) -> DataFrame:
    """main(id, rank from 0) with one row of extra(id, rank) after the first row and then after every third: (id, place)."""
    a = main.select("id", (F.col("rank") * 10).alias("key"))
    b = extra.select("id", (F.col("rank") * every * 10 + 5).alias("key"))
    return a.unionByName(b).withColumn("place", F.row_number().over(Window.orderBy("key", "id")) - 1).drop("key")


def packed_blocks(blocks: DataFrame, group: list[str], order: list[Column], text_col: str, budget: int = 12_000, header: int = 20) -> DataFrame:
    """Greedy packing of ranked blocks into `budget` characters per group: a block that fits is taken whole; one that
    doesn't is cut to what is left, with a marker, if more than `header` characters are left, and ends the packing.
    Adds rank, used (characters up to the block) and taken (the text that goes in).

    A running sum decides all; groups are the candidates of one query, a bounded top-k.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    n = F.length(text_col)
    rows = blocks.withColumn("rank", F.row_number().over(w)).withColumn("_end", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_left", F.lit(budget) - (F.col("_end") - n))
    cut = F.concat(F.substring(F.col(text_col), F.lit(1), F.greatest(F.lit(0), F.col("_left") - len(MARKER)).cast("int")), F.lit(MARKER))
    taken = F.when(F.col("_end") <= budget, F.col(text_col)).when(F.col("_left") > header + len(MARKER), cut)
    return rows.withColumn("taken", taken).filter("taken is not null").withColumn("used", F.least(F.col("_end"), F.lit(budget))).drop("_end", "_left")
