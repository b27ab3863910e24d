"""Exact deduplication by two-pass Bloom filtering.

Pass 1 sets, for each row, two cells of a filter of `bits` cells by the hash of its normalised text, and keeps as a
bitmap the cells that were set more than once. Pass 2 tests each row against that bitmap: a row with a cell that was
set once only has no equal, and passes straight through. Only the others, the repeated texts and the filter's few
false positives, shuffle on their full SHA-256; there groups are salted, so that a group of any size is spread out.

The bitmap takes bits/8 bytes, at most MAX_BITS/8 = 32 MB, which is what makes broadcasting it safe. Beyond about
MAX_BITS/4 rows more and more rows are false positives and shuffle: slower, the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, staged, table, tidy, with_group

MAX_BITS = 1 << 28
BITS_PER_ROW = 16
#: Bits of one bitmap of bitmap_construct_agg.
BLOCK = 32768


def filter_bits(n_rows: int, per_row: int = BITS_PER_ROW, most: int = MAX_BITS) -> int:
    bits = BLOCK
    while bits < n_rows * per_row and bits < most:
        bits *= 2
    return bits


def _cell(sha: str, which: int, bits: int) -> Column:
    return (F.conv(F.substring(sha, 1 + 13 * which, 13), 16, 10).cast("long") % F.lit(bits)).cast("long")


def in_bitmap(bitmap: str, cell: str) -> Column:
    """Whether bit `cell` of its block is set; a missing block has none."""
    return F.expr(f"coalesce(shiftright(cast(conv(hex(substring({bitmap}, cast({cell} % {BLOCK} as int) div 8 + 1, 1)), 16, 10) as int), cast({cell} % 8 as int)) & 1, 0) = 1")


def repeated_cells(hashes: DataFrame, bits: int) -> DataFrame:
    """Pass 1: hashes(_sha) -> (_block, _bits) of the cells set more than once."""
    cells = hashes.select(F.explode(F.array(_cell("_sha", 0, bits), _cell("_sha", 1, bits))).alias("_cell"))
    often = cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return often.groupBy((F.col("_cell") / BLOCK).cast("long").alias("_block")).agg(F.bitmap_construct_agg(F.col("_cell") % BLOCK).alias("_bits"))


@tidy
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), bits: int | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256 and the columns named in carry.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; a null id is below all others, and of rows with the same id and text exactly one stays. An
    empty table gives an empty result; columns that aren't named don't matter.
    """
    bits = bits or filter_bits(docs.count())
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256).alias("_sha")
    blocks = F.broadcast(staged(repeated_cells(docs.select(sha), bits), "bloom"))
    rows = docs.select(F.col(id_col).alias("_id"), sha, F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(c) for c in carry], F.lit(1).alias("_")).alias("_carry"))
    for k in (0, 1):
        rows = rows.withColumn(f"_c{k}", _cell("_sha", k, bits)).withColumn(f"_k{k}", (F.col(f"_c{k}") / BLOCK).cast("long"))
        rows = rows.join(blocks.select(F.col("_block").alias(f"_k{k}"), F.col("_bits").alias(f"_b{k}")), f"_k{k}", "left")
    rows = rows.withColumn("_maybe", in_bitmap("_b0", "_c0") & in_bitmap("_b1", "_c1"))
    plain = ["_id", "_sha", "_row", "_carry"]

    def shaped(df: DataFrame, keep: Column, size: Column, kept: Column) -> DataFrame:
        return df.select(F.col("_id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256"), *[F.col("_carry")[c].alias(c) for c in carry])

    singles = shaped(rows.filter(~F.col("_maybe")), F.col("_id"), F.lit(1), F.lit(True))
    maybe = staged(rows.filter("_maybe").select(*plain), "maybe-repeated")
    grouped = with_group(maybe, ["_sha"], {"_best": (F.max(F.struct("_id", "_row")), F.max), "_size": (F.count(F.lit(1)), F.sum)}, ["_row"])
    return singles.unionByName(shaped(grouped, F.col("_best._id"), F.col("_size"), F.col("_row") == F.col("_best._row")))


@tidy
def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns, whatever their names: of equal texts the one with the largest id, where null counts
    as the empty text and a null id is below all others; of rows equal in both, one. An empty table stays empty."""
    boxed = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_box"))
    return exact_dedup(boxed, "_own", "_text", carry=("_box",)).filter("kept").select("_box.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
