"""Table functions over source code: chunks, symbols, spans and unified diffs. They need a parser or a state machine, so
they are Python, in Arrow batches of files."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections import namedtuple
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from itertools import accumulate
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHUNK_CHARS = 4000
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
CHUNKS = "path string, start_line int, end_line int, symbol string, kind string, text string"


Node = namedtuple("Node", "name kind type top line end column head doc")


def bounded(lines: list[str], first: int, most: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of runs of lines, with their line ends, as long as `most` characters allow and of one line at
    least; of a longer line the first `most` are kept."""
    kept = [line[:most] for line in lines]
    ends = [0, *accumulate(map(len, kept))]
    at = 0
    while at < len(kept):
        after = max(at + 1, bisect_right(ends, ends[at] + most) - 1)
        yield first + at, first + after - 1, "".join(kept[at:after])
        at = after


def outline(text: str) -> list[Node]:
    """What a Python text defines, in its order: functions and classes at any depth, and names that are assigned to; none of a
    text that doesn't parse. Names are qualified by the definitions around them; top: whether it stands in the module itself."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    found, todo = [], [(module, "", None)]
    while todo:
        node, owner, parent = todo.pop()
        if isinstance(node, DEFINITIONS):
            is_class = isinstance(node, ast.ClassDef)
            head = f"class {node.name}" if is_class else f"def {node.name}({', '.join(a.arg for a in node.args.args)})"
            found.append(Node(owner + node.name, "class" if is_class else "function", type(node).__name__.lower(), parent is module, node.lineno, node.end_lineno, node.col_offset + 1, head, ast.get_docstring(node) or ""))
            owner = f"{owner}{node.name}."
        elif isinstance(node, ast.Assign):
            names = (t for t in node.targets if isinstance(t, ast.Name))
            found += [Node(owner + t.id, "variable", "name", parent is module, t.lineno, t.end_lineno, t.col_offset + 1, f"{t.id} = ...", "") for t in names]
            continue
        todo += [(child, owner, node) for child in reversed(list(ast.iter_child_nodes(node)))]
    return found


def chunk_file(path: str, text: str, most: int = MAX_CHUNK_CHARS) -> Iterator[tuple]:
    """Rows of CHUNKS: top-level definitions of a Python file, without their decorators, and the lines before the first
    one's; what lies between definitions isn't indexed. All other files, and those that don't parse, as bounded text."""
    lines = text.splitlines(keepends=True)
    parts = [(d.line, d.end, d.name, d.type) for d in (outline(text) if path.endswith(".py") else []) if d.top and d.kind != "variable"]
    parts = [(1, parts[0][0] - 1, "", "module"), *parts] if parts else [(1, len(lines), "", "text")]
    for first, last, symbol, kind in parts:
        for a, b, t in bounded(lines[first - 1 : last], first, most):
            yield path, a, b, symbol, kind, t


def symbol_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(qualified name, start, end) of all definitions, nested ones too."""
    return ((n.name, n.line, n.end) for n in outline(text) if n.kind != "variable")


def document_symbols(text: str) -> Iterator[tuple[str, str, int, int, str, str]]:
    """(qualified name, kind, line, character from 1, signature, docstring) of functions, classes and assigned names."""
    return ((n.name, n.kind, n.line, n.column, n.head, n.doc) for n in outline(text))


def symbol_at(text: str, line: int, character: int | None = 1) -> str | None:
    """The identifier that covers a position, both numbers from 1, else the first of the line."""
    rows = text.splitlines()
    if not 1 <= line <= len(rows) or not (row := rows[line - 1]):
        return None
    at = min(max((character or 1) - 1, 0), len(row) - 1)
    found = list(re.finditer(r"[A-Za-z_][A-Za-z0-9_]*", row))
    return next((m[0] for m in found if m.start() <= at < m.end()), found[0][0] if found else None)


HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def changed_lines(patch: str) -> Iterator[tuple[str, str, int]]:
    """(path, side, line) of removed (old) and added (new) lines of a unified diff."""
    old = new = None
    a = b = left_a = left_b = 0
    for line in patch.split("\n"):
        if left_a > 0 or left_b > 0:
            mark = line[:1]
            if mark == "-":
                yield old or new, "old", a
                a, left_a = a + 1, left_a - 1
            elif mark == "+":
                yield new or old, "new", b
                b, left_b = b + 1, left_b - 1
            elif mark != "\\":
                a, b, left_a, left_b = a + 1, b + 1, left_a - 1, left_b - 1
        elif line.startswith("--- "):
            old = None if line[4:].startswith("/dev/null") else re.sub("^[ab]/", "", line[4:].split("\t")[0])
        elif line.startswith("+++ "):
            new = None if line[4:].startswith("/dev/null") else re.sub("^[ab]/", "", line[4:].split("\t")[0])
        elif m := HUNK.match(line):
            a, left_a, b, left_b = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)


def flat(rows: DataFrame, f: Callable[..., Iterator[tuple]], inputs: list[str], schema: str, keep: list[str] | None = None) -> DataFrame:
    """A table function over batches: f(*inputs) gives the rows of `schema`, next to the kept columns."""
    keep = keep or []
    kept = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    names = [*keep, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*k, *got) for k, args in zip(batch[keep].itertuples(index=False, name=None) if keep else [()] * len(batch), batch[inputs].itertuples(index=False, name=None), strict=True) for got in f(*args)]
            yield pd.DataFrame(out, columns=names)

    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, ", ".join([*kept, schema]))


def chunks(files: DataFrame, most: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Code chunks of files(path, text), with ids."""
    from .text import chunk_id

    got = flat(files, lambda p, t: chunk_file(p, t, most), ["path", "text"], CHUNKS)
    return got.withColumn("chunk_id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), F.col("text")))


SYMBOLS = "path string, name string, kind string, line int, character int, signature string, docstring string"


def symbols(files: DataFrame) -> DataFrame:
    """Rows of SYMBOLS of the Python files among files(path, text)."""
    python = files.filter(F.col("path").endswith(".py"))
    return flat(python, lambda p, t: ((p, *row) for row in document_symbols(t or "")), ["path", "text"], SYMBOLS)


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        rng, _, step = part.partition("/")
        a, b = (low, high) if rng == "*" else map(int, rng.split("-")) if "-" in rng else (int(rng), high if step else int(rng))
        if not (low <= a <= high and low <= b <= high):
            raise ValueError(f"{spec} is out of range")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def next_run(expression: str, after: datetime, zone: str = "UTC") -> datetime | None:
    """The next time a five-field cron expression holds in a time zone, in UTC; null for an invalid one."""
    try:
        minute, hour, day, month, week = expression.split()
        minutes, hours, days, months = _field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12)
        weeks = {x % 7 for x in _field(week, 0, 7)}
    except ValueError:
        return None
    local = after.astimezone(ZoneInfo(zone)).replace(second=0, microsecond=0, tzinfo=None) + timedelta(minutes=1)
    for _ in range(366 * 5):
        by_day, by_week = local.day in days, (local.weekday() + 1) % 7 in weeks
        fits = by_day and by_week if day == "*" or week == "*" else by_day or by_week
        if local.month in months and fits:
            for h in sorted(x for x in hours if x >= local.hour):
                for m in sorted(minutes):
                    if h > local.hour or m >= local.minute:
                        return local.replace(hour=h, minute=m, tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC"))
        local = (local + timedelta(days=1)).replace(hour=0, minute=0)
    return None
