"""Questions about the symbols of a source tree: search, definitions, references and hover.

They work on files(path, text) and on its table of symbols, `functions.code.symbols`. Many names at once are a join on
the name; a reference is found by the line's identifiers, not by testing every name on every line.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import lines

ORDER = ["path", "line", "character"]


def search(symbols: DataFrame, needle: str) -> DataFrame:
    """Symbols whose qualified name contains the needle, in any case; an empty needle finds none."""
    wanted = needle.strip().lower()
    return symbols.filter(F.lower("name").contains(wanted)) if wanted else symbols.limit(0)


def definitions(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The symbols with exactly one of the qualified names(name)."""
    return symbols.join(names.select("name").distinct(), "name", "left_semi").select(symbols.columns)


def references(files: DataFrame, name: str) -> DataFrame:
    """(path, line, text) of the lines with the name as a whole word; the texts are tested before they are split."""
    word = rf"\b{re.escape(name)}\b"
    hits = lines(files.filter(F.col("text").rlike(word)).select("path", F.regexp_replace("text", r"\r\n?", "\n").alias("text")))
    return hits.filter(F.col("text").rlike(word)).select("path", "line", F.trim("text").alias("text"))


def references_of(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path, line) for many names(name), which must be identifiers."""
    words = lines(files.select("path", F.regexp_replace("text", r"\r\n?", "\n").alias("text")))
    found = words.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    return found.join(names.select("name").distinct(), "name", "left_semi").select("name", "path", "line")


def hover(symbols: DataFrame, name: str) -> DataFrame:
    """The first definition of a qualified name, by path and place: one row or none."""
    return symbols.filter(F.col("name") == name).orderBy(*ORDER).limit(1)
