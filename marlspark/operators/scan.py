"""Line and name searches over tables of texts."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HITS = 2000
#: Stands for what was between two text nodes. What is cut there: comments; scripts and styles, open ones to the end; tags, whose quoted
#: values may hold any character, and declarations.
NODE = "\x1e"
COMMENT, UNREAD = r"(?s)<!--.*?(?:-->|\z)", r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\b[^>]*>|\z)"
TAG = r"""</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*>"""
#: References with their semicolons.
CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);|([A-Za-z][A-Za-z0-9]*;))")
#: References that a page wrote twice over, decoded once more, in this order.
LEFT_OVER = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell pattern whose * also crosses /, anchored at both ends."""
    out = []
    for c in glob:
        out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
    return f"^{''.join(out)}$"


def lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line, numbered from 1, in place of the text."""
    others = [c for c in files.columns if c != text_col]
    return files.select(*others, F.posexplode(F.split(text_col, "\n", -1)).alias("line", text_col)).withColumn("line", F.col("line") + 1)


def grep(files: DataFrame, pattern: str, order: list[str], case_sensitive: bool = True, limit: int = 200, text_col: str = "text") -> DataFrame:
    """The first `limit` matching lines, in the order of files and lines. The texts are tested before they are split."""
    p = pattern if case_sensitive else f"(?i){pattern}"
    hits = lines(files.filter(F.col(text_col).rlike(p)), text_col).filter(F.col(text_col).rlike(p))
    return hits.orderBy(*order, "line").limit(min(limit, MAX_HITS))


def line_slice(files: DataFrame, offset: int = 0, limit: int = 200, text_col: str = "text") -> DataFrame:
    """Lines offset+1 to offset+limit of each file; files with a NUL are left out."""
    plain = files.filter(~F.col(text_col).contains("\0"))
    return lines(plain, text_col).filter(F.col("line").between(offset + 1, offset + limit))


def search_names(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    hit = [F.lower(F.col(c)).contains(needle.lower()) for c in columns]
    return rows.filter(F.greatest(*hit) if len(hit) > 1 else hit[0])


def list_files(paths: DataFrame, column: str, needle: str = "", limit: int = 30) -> DataFrame:
    """The first `limit` paths with the needle, each with the number n of all that have it."""
    found = paths.filter(F.lower(F.col(column)).contains(needle.lower())).select(column)
    first = found.orderBy(column).limit(min(limit, 200))
    return first.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("n"))))  # one row


def glob_paths(files: DataFrame, column: str, glob: str, limit: int, ties: list[str]) -> DataFrame:
    return files.filter(F.col(column).rlike(glob_pattern(glob))).orderBy(column, *ties).limit(limit)


def unescape_closed(text: str) -> str:
    """Decodes character references that end in a semicolon; what lacks it, as where a text was cut, stays."""
    return CLOSED.sub(lambda m: html.unescape(m[0]) if m[1] is None else html.entities.html5.get(m[1], m[0]), text)


def html_text(pages: DataFrame, html_col: str, closed_only: bool = False) -> DataFrame:
    """Adds text: the text nodes, stripped and joined by a space, without script and style, runs of blanks squeezed. Markup is cut
    away by column functions; only character references, for which there is a long table, are decoded in Python: as browsers do
    also those old ones that lack their semicolon, or those that have it only."""
    unescape = unescape_closed if closed_only else html.unescape

    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(unescape, na_action="ignore")

    bare = F.translate(F.coalesce(html_col, F.lit("")), NODE, " ")
    for cut in (COMMENT, UNREAD, TAG):
        bare = F.regexp_replace(bare, cut, NODE)
    stripped = lambda x: F.regexp_replace(x, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    rows = pages.withColumn("_nodes", decoded(bare))
    text = F.array_join(F.filter(F.transform(F.split("_nodes", NODE), stripped), lambda x: x != ""), " ")
    for name, character in LEFT_OVER:
        text = F.replace(text, F.lit(name), F.lit(character))
    text = F.replace(F.regexp_replace(text, r"[ \t\r\f\x0b]+", " "), F.lit(" \n"), F.lit("\n"))
    return rows.withColumn("text", stripped(text)).drop("_nodes")


def table_rows(rows: DataFrame, text_col: str) -> DataFrame:
    """One row per body line of a Markdown table: cells, padded or cut to the width of the header."""
    others = [c for c in rows.columns if c != text_col]
    cut = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    got = rows.withColumn("_lines", F.filter(F.split(F.col(text_col), "\n"), lambda x: F.trim(x) != "")).withColumn("header", cut(F.col("_lines")[0]))
    body = got.select(*others, "header", F.posexplode(F.slice("_lines", F.lit(3), F.greatest(F.lit(0), F.size("_lines") - 2))).alias("row", "_line")).withColumn("cells", cut(F.col("_line")))
    width = F.size("header")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return body.withColumn("cells", padded).drop("_line")


def element_groups(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Adds group, from 1: a group ends before a table that would be its (most + 1)-th."""
    seen = F.sum(F.col("is_table").cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("group", F.greatest(F.lit(1), F.ceil(seen / most)))


def porcelain_path(line: Column) -> Column:
    """The path of a status line; of a rename its target."""
    path = F.substring(line, 4, 10_000)
    return F.regexp_replace(F.when(path.contains(" -> "), F.regexp_extract(path, r"^.* -> (.*)$", 1)).otherwise(path), '^"|"$', "")
