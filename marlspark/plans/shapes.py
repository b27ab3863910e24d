"""Source files, patches and tables of many shapes: each part's number picks one and is put into its names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..operators import scan
from .registry import query, table

LONG = "    x = '" + "y" * 1500 + "'\n"
#: (text, chunks, spans, symbols) of a file; # stands for the part's number.
#: chunks: (start, end, symbol, kind); spans: (name, start, end); symbols: (name, kind, line, character, signature, docstring)
FILES: list[tuple[str, list[tuple], list[tuple], list[tuple]]] = [
    ("", [], [], []),
    ("'only a text'\n\nx = #\n", [(1, 3, "", "text")], [], [("x", "variable", 3, 1, "x = ...", "")]),
    ("def broken#(:\n    pass\n", [(1, 2, "", "text")], [], []),
    (
        "import os\nif os:\n    def inner#():\n        pass\n@deco\nasync def go#(a, b):\n    '''Goes #.'''\n    y = z = a\nclass K#(object):\n    n = 1\n    class L:\n        def m#(self): return 1\n",
        [(1, 5, "", "module"), (6, 8, "go#", "asyncfunctiondef"), (9, 12, "K#", "classdef")],
        [("inner#", 3, 4), ("go#", 6, 8), ("K#", 9, 12), ("K#.L", 11, 12), ("K#.L.m#", 12, 12)],
        [
            ("inner#", "function", 3, 5, "def inner#()", ""), ("go#", "function", 6, 1, "def go#(a, b)", "Goes #."), ("go#.y", "variable", 8, 5, "y = ...", ""), ("go#.z", "variable", 8, 9, "z = ...", ""),
            ("K#", "class", 9, 1, "class K#", ""), ("K#.n", "variable", 10, 5, "n = ...", ""), ("K#.L", "class", 11, 5, "class L", ""), ("K#.L.m#", "function", 12, 9, "def m#(self)", ""),
        ],
    ),
    (
        "def long#():\n" + LONG * 5 + "\n\ndef after#(): pass\n",
        [(1, 3, "long#", "functiondef"), (4, 5, "long#", "functiondef"), (6, 6, "long#", "functiondef"), (9, 9, "after#", "functiondef")],
        [("long#", 1, 6), ("after#", 9, 9)],
        [("long#", "function", 1, 1, "def long#()", ""), *[("long#.x", "variable", k, 5, "x = ...", "") for k in range(2, 7)], ("after#", "function", 9, 1, "def after#()", "")],
    ),
    (
        "class Empty#: pass\nfor k in ():\n    v# = k\nwith open('f') as f:\n    class InWith#:\n        '''Doc.\n\n        More.'''\n",
        [(1, 1, "Empty#", "classdef")],
        [("Empty#", 1, 1), ("InWith#", 5, 8)],
        [("Empty#", "class", 1, 1, "class Empty#", ""), ("v#", "variable", 3, 5, "v# = ...", ""), ("InWith#", "class", 5, 5, "class InWith#", "Doc.\n\nMore.")],
    ),
]


def _sql(x: object) -> str:
    return str(x) if isinstance(x, int) else "replace('" + str(x).replace("'", "''") + "', '#', p_partkey::VARCHAR)"


def _expected(cases: list[list[tuple]], columns: list[str], first: str = "'src/m' || p_partkey || '.py' AS path") -> str:
    """The rows of the case that a part's number picks."""
    parts = [f"SELECT {first}, " + ", ".join(f"{_sql(v)} AS {c}" for c, v in zip(columns, row, strict=True)) + f" FROM part WHERE p_partkey % {len(cases)} = {k}" for k, rows in enumerate(cases) for row in rows]
    return " UNION ALL ".join(parts)


def _picked(texts: list[str]) -> Column:
    out = F.lit(texts[0])
    for k, text in enumerate(texts[1:], 1):
        out = F.when(F.col("p_partkey") % len(texts) == k, text).otherwise(out)
    return F.replace(out, F.lit("#"), F.col("p_partkey").cast("string"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), _picked([f[0] for f in FILES]).alias("text"))


@query("x4_chunk_shapes", _expected([f[1] for f in FILES], ["start_line", "end_line", "symbol", "kind"]))
def x4s(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(_files(spark, sf)).select("path", "start_line", "end_line", "symbol", "kind")


@query("x34_span_shapes", _expected([f[2] for f in FILES], ["name", "start_line", "end_line"]))
def x34s(spark: SparkSession, sf: str) -> DataFrame:
    return C.flat(_files(spark, sf), C.symbol_spans, ["text"], "name string, start_line int, end_line int", ["path"])


@query("x35_symbol_shapes", _expected([f[3] for f in FILES], ["name", "kind", "line", "character", "signature", "docstring"]))
def x35s(spark: SparkSession, sf: str) -> DataFrame:
    return C.symbols(_files(spark, sf))


#: (position, symbol there) of texts with tabs, digits in names, letters beyond ASCII, and lines that aren't there.
PLACES: list[tuple[str, int, int, str | None]] = [
    ("a# = b_#(c)\n", 1, 1, "a#"), ("a# = b_#(c)\n", 1, 99, "a#"), ("\tx.y#\n", 1, 4, "y#"), ("1 + _z#", 1, 1, "_z#"), ("é = 2", 1, 1, None), ("one\n\nthree#", 3, 2, "three#"), ("one\n\nthree#", 2, 1, None), ("one", 5, 1, None), ("", 1, 1, None),
]


def _places_sql() -> str:
    parts = [f"SELECT p_partkey, {line} AS line, {character} AS character, {'NULL' if symbol is None else _sql(symbol)} AS symbol FROM part WHERE p_partkey % {len(PLACES)} = {k}" for k, (_, line, character, symbol) in enumerate(PLACES)]
    return " UNION ALL ".join(parts)


@query("x37_symbol_places", _places_sql())
def x37p(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda at: F.element_at(F.array(*[F.lit(p[at]) for p in PLACES]), (F.col("p_partkey") % len(PLACES) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", _picked([p[0] for p in PLACES]).alias("text"), number(1).alias("line"), number(2).alias("character"))
    return C.flat(rows, lambda t, a, b: iter([(C.symbol_at(t, int(a), int(b)),)]), ["text", "line", "character"], "symbol string", ["p_partkey", "line", "character"])


#: (patch, changed lines as (path, side, line)).
PATCHES: list[tuple[str, list[tuple]]] = [
    ("", []),
    ("--- a/m#.py\n+++ b/m#.py\n@@ -3 +3 @@\n-old\n+new\n", [("m#.py", "old", 3), ("m#.py", "new", 3)]),
    ("--- /dev/null\n+++ b/made#.py\n@@ -0,0 +1,2 @@\n+a\n+b\n\\ No newline at end of file\n", [("made#.py", "new", 1), ("made#.py", "new", 2)]),
    ("--- a/gone#.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n", [("gone#.py", "old", 1), ("gone#.py", "old", 2)]),
    ("diff --git a/x b/y#\n--- a/x#\t2026\n+++ b/y#\t2026\n@@ -10,4 +20,5 @@ def f():\n a\n--- b\n+++ c\n+d\n e\n f\n@@ -50,0 +61,1 @@\n+z\n", [("x#", "old", 11), ("y#", "new", 21), ("y#", "new", 22), ("y#", "new", 61)]),
]


@query("x33_patch_shapes", _expected([p[1] for p in PATCHES], ["path", "side", "line"], first="p_partkey"))
def x33s(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", _picked([p[0] for p in PATCHES]).alias("patch"))
    return C.flat(rows, C.changed_lines, ["patch"], "path string, side string, line int", ["p_partkey"])


#: (Markdown, cells joined by a comma per row of its tables).
TABLES: list[tuple[str, list[str]]] = [
    ("no table # | here", []),
    ("| a | b |\n| --- | :-: |\n| 1# | 2 |\n| 3 | |\n", ["1#,2", "3,"]),
    ("| only |\n|---|\n| x# |\n\n  \n y | cut |\n", ["x#", "y"]),
]


def _shape(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = scan.table_rows(table(spark, sf, "part").select("p_partkey", _picked([t[0] for t in TABLES]).alias("t")), "t")
        return rows.select("p_partkey", F.array_join("cells", ",").alias(name))

    return run


query("m9_table_shapes", _expected([[(c,) for c in t[1]] for t in TABLES], ["cells"], first="p_partkey"))(_shape("cells"))
