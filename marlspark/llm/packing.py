"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents are tokenised and cut every MAX_TOKENS ids; only the histogram of piece lengths, at most MAX_TOKENS counts,
goes to the driver. There lengths are placed longest first, each time into the pattern that is filled least among
those with room (the shortest pack), and only pattern counts change, so the work does not depend on the corpus. The
result is a table of intervals - of the pieces of a length, ranks lo to hi go to these sequences at this offset - of
at most MAX_TOKENS * 63 * 2 rows, which is broadcast. Pieces get their ranks from bucket counts, without a global sort.

Where the order of the documents is to stay, windows of WINDOW documents are packed like that one by one, each in a task's
memory, and a window's sequences are numbered by their earliest pieces, after those of the windows before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_order, ranked, small_batches, staged, table, tidy

MAX_TOKENS, END_ID = 2048, 1
#: Documents that are packed together where their order is to stay.
WINDOW = 1024
VOCABULARY = "byte_bpe_50k"
LONG_GAP = re.compile(r"(?<!\s)\s{10000}")
PIECES = "doc_id string, row long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer(vocabulary: str = VOCABULARY):
    """text -> ids of the vocabulary's tokenizers file. Its tiktoken file has the same ranks and is several times
    faster; texts with a special token's string go to tokenizers, which alone knows that, and so do those with white space
    of LONG_GAP characters in a row, for which tiktoken's pattern needs a stack as deep as they are many."""
    import base64

    import public_tokenizers as files
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(files.path(f"{vocabulary}.json"))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(files.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(s in text for s in special) or LONG_GAP.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def cut(docs: DataFrame, most: int = MAX_TOKENS, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, row) -> one row per piece of at most `most` ids; a null text is empty and still has the end id."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = tokenizer(vocabulary)
        for batch in batches:
            rows = []
            for doc, text, row in zip(batch["doc_id"], batch["text"], batch["row"], strict=True):
                ids = np.array([*ids_of(text or ""), END_ID], dtype="<u4")
                for start in range(0, len(ids), most):
                    piece = ids[start : start + most]
                    rows.append((doc, row, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([piece.astype("int64")] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
            yield out

    # ids as strings: pandas has no long with nulls
    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(pieces, PIECES + (", ids array<long>" if with_ids else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def shortest_pack_first(histogram: dict[int, int], most: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences follow each."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(most + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        n, room = histogram[length], most
        while n > 0:
            while room >= length and not open_[room]:
                room -= 1
            if room < length:  # none has room: new sequences, each with as many of this length as fit
                full, rest = divmod(n, most // length)
                for copies, count in ((most // length, full), (rest, 1)):
                    if copies and count:
                        open_[most - copies * length].append(((length,) * copies, count))
                break
            lengths, count = open_[room].pop()
            take = min(n, count)
            if count > take:
                open_[room].append((lengths, count - take))
            # several of the same length may go into one pattern: as many as are left for each and fit
            again = max(1, min(room // length, n // take))
            open_[room - again * length].append((lengths + (length,) * again, take))
            n -= take * again
            if again > 1 or room - length >= length:
                room = most
    return [p for at in open_ for p in at]


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, sequences, offset of the first of them) of each run of a pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, count in patterns:
        offset, k = 0, 0
        while k < len(lengths):
            length, run = lengths[k], 1
            while k + run < len(lengths) and lengths[k + run] == length:
                run += 1
            lo = used.get(length, 0)
            out.append((length, lo, lo + run * count, sequence, count, offset))
            used[length] = lo + run * count
            offset, k = offset + run * length, k + run
        sequence += count
    return out


def pack_window(pieces: pd.DataFrame, most: int = MAX_TOKENS) -> pd.DataFrame:
    """Adds sequence_id, from 0 in the order of the sequences' earliest pieces, and offset; of a length earlier pieces go first."""
    pieces = pieces.sort_values(["row", "start"], ignore_index=True)
    of_length = pieces.groupby("length").indices
    sequence, offset = np.zeros(len(pieces), dtype="int64"), np.zeros(len(pieces), dtype="int64")
    for length, lo, hi, first, count, at in intervals(shortest_pack_first({k: len(v) for k, v in of_length.items()}, most)):
        own, k = of_length[length][lo:hi], np.arange(hi - lo)
        sequence[own], offset[own] = first + k % count, at + k // count * length
    _, earliest, sequence = np.unique(sequence, return_index=True, return_inverse=True)
    number = np.empty(len(earliest), dtype="int64")
    number[np.argsort(earliest)] = np.arange(len(earliest))
    return pieces.assign(sequence_id=number[sequence], offset=offset)


def packed_in_order(pieces: DataFrame, most: int) -> DataFrame:
    """pieces with sequence_id and offset: sequences follow the order of row, by windows of WINDOW rows."""
    kind = pieces.schema["doc_id"].dataType
    windows = pieces.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("_window", F.expr(f"row div {WINDOW}"))
    schema = ", ".join(f"{c} {t}" for c, t in [*windows.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])
    placed = staged(windows.groupBy("_window").applyInPandas(lambda w: pack_window(w, most), schema), "windows")
    before = F.sum("_n").over(Window.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy(F.col("_window").alias("_w")).agg((F.max("sequence_id") + 1).alias("_n"))  # a row per window
    starts = starts.select("_w", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(starts), F.col("_window") == F.col("_w")).withColumn("sequence_id", F.col("_before") + F.col("sequence_id"))
    return numbered.withColumn("doc_id", F.col("doc_id").cast(kind)).select(*pieces.columns, "sequence_id", "offset")


@tidy
@small_batches
def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TOKENS, vocabulary: str = VOCABULARY, with_ids: bool = False, keep_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every row of docs is packed, repeated rows and null ids included (their pieces stay apart by the row's number,
    the column row); a null text is empty; no rows give no pieces. With keep_order sequences follow the order of docs
    as it was written, to within WINDOW documents; else pieces of all docs share sequences, with less padding.
    """
    if keep_order:
        return packed_in_order(cut(in_order(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")], "row"), most, vocabulary, with_ids), most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = staged(cut(rows, most, vocabulary, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(intervals(shortest_pack_first(histogram, most)), "_l long, _lo long, _hi long, _sequence long, _count long, _offset long")
    placed = ranked(pieces, ["length"], ["row", "start"], "_rank", sum(histogram.values()))
    placed = placed.join(F.broadcast(plan), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).withColumn("_k", F.col("_rank") - F.col("_lo"))
    return placed.withColumn("sequence_id", F.col("_sequence") + F.col("_k") % F.col("_count")).withColumn("offset", F.expr("_offset + _k div _count * length")).select(*pieces.columns, "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")
