"""What a model streams, put together: visible text chunk by chunk, and tool calls and replies once a turn is over.

Deltas are rows (key, seq, text, index, id, name, arguments, done): a piece of text, a fragment of the tool call with that
index, or both; done marks the last one of a turn. They are in the order of seq within each key. A stream and a table of
the same deltas give the same rows, however the stream is cut into batches, and after a restart too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN, CLOSE = "<think>", "</think>"
BLOCK = re.compile(f"{OPEN}.*?{CLOSE}", re.DOTALL)
DELTA = ("seq", "text", "index", "id", "name", "arguments", "done")
CALLS = "array<struct<index: int, id: string, name: string, arguments: string>>"


def visible(held: str, text: str) -> tuple[str, str]:
    """(what of held + text can be shown, what waits for more): thoughts go, an open one and what may be the start of one
    wait. Of an open thought only its tag and what may be the start of its end are held, so that never more than 14 characters wait."""
    rest = BLOCK.sub("", held + text)
    shown, tag, inside = rest.partition(OPEN)
    if tag:
        return shown, OPEN + inside[1 - len(CLOSE) :]
    n = next((n for n in range(len(OPEN) - 1, 0, -1) if rest.endswith(OPEN[:n])), 0)
    return rest[: len(rest) - n], rest[len(rest) - n :]


def assembled(fragments: Iterable[tuple]) -> list[tuple]:
    """Calls (index, id, name, arguments) by index, of fragments (index, id, name, arguments) in their order: the last id and name
    that aren't empty, the arguments joined. A call without a name goes; arguments that aren't JSON become {}."""
    calls: dict[int, list] = {}
    for index, id_, name, arguments in fragments:
        call = calls.setdefault(index, ["", "", []])
        call[0], call[1] = id_ or call[0], name or call[1]
        call[2].append(arguments or "")
    out = []
    for index in sorted(calls):
        id_, name, pieces = calls[index]
        if not name:
            continue
        arguments = "".join(pieces)
        try:
            json.loads(arguments)
        except ValueError:
            arguments = "{}"
        out.append((index, id_, name, arguments))
    return out


def _plain(value: object) -> object:
    return None if pd.isna(value) else value


def _rows(batches: Iterable[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of a key in this batch, by the first column. Frames have NaN for null."""
    for row in pd.concat(list(batches))[list(columns)].sort_values(columns[0], kind="stable").itertuples(index=False, name=None):
        yield tuple(map(_plain, row))


class VisibleText(StatefulProcessor):
    """Per key: the visible text of each chunk, as soon as it is sure. What still waits at a turn's end is never shown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.held.get()[0] if self.held.exists() else ""
        out = []
        for seq, text, done in _rows(rows, ("seq", "text", "done")):
            shown, held = visible(held, text or "")
            if shown:
                out.append((key[0], seq, shown))
            if done:
                held = ""
        self.held.update((held,))
        yield pd.DataFrame(out, columns=["key", "seq", "visible"])

    def close(self) -> None:
        pass


def visible_text(chunks: DataFrame) -> DataFrame:
    """chunks(key, seq, text, done) -> (key, seq, visible), of those that show something. Without a stream the chunks of a
    key are walked through in order, holding a few characters."""
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("key", "seq")}
    shape = f"key {kinds['key']}, seq {kinds['seq']}, visible string"
    if chunks.isStreaming:
        return chunks.groupBy("key").transformWithStateInPandas(VisibleText(), shape, "append", "none")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = object(), ""
        for batch in batches:
            out = []
            for key, seq, text, done in batch[["key", "seq", "text", "done"]].itertuples(index=False, name=None):
                key = _plain(key)
                if key != last:
                    last, held = key, ""
                shown, held = visible(held, _plain(text) or "")
                if shown:
                    out.append((key, seq, shown))
                if _plain(done):
                    held = ""
            yield pd.DataFrame(out, columns=["key", "seq", "visible"])

    return chunks.select("key", "seq", "text", "done").repartition("key").sortWithinPartitions("key", "seq").mapInPandas(walk, shape)


class Turns(StatefulProcessor):
    """Per key: the fragments of the open turn as a list that is only appended to, and what of its text waits. A turn that
    gets nothing for `expiry` seconds of processing time goes on as it is, marked as not complete."""

    columns = ["key", "turn", "text", "calls", "complete"]

    def __init__(self, expiry: float | None):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fragments = handle.getListState("fragments", "index int, id string, name string, arguments string")
        self.shown = handle.getListState("shown", "text string")
        self.at = handle.getValueState("at", "held string, turn long, due long")

    def _ended(self, key: tuple, turn: int, fragments: list, shown: list, complete: bool) -> tuple:
        old = [tuple(r) for r in self.fragments.get()] if self.fragments.exists() else []
        texts = [r[0] for r in self.shown.get()] if self.shown.exists() else []
        self.fragments.clear()
        self.shown.clear()
        calls = [dict(zip(("index", "id", "name", "arguments"), c, strict=True)) for c in assembled([*old, *fragments])]
        return key[0], turn, "".join([*texts, *shown]), calls, complete

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        held, turn, due = tuple(self.at.get()) if self.at.exists() else ("", 0, -1)
        out: list[tuple] = []
        fragments: list[tuple] = []
        shown: list[str] = []
        open_ = False
        for _, text, index, id_, name, arguments, done in _rows(rows, DELTA):
            open_ = True
            piece, held = visible(held, text or "")
            if piece:
                shown.append(piece)
            if index is not None:
                fragments.append((int(index), id_, name, arguments))
            if done:
                out.append(self._ended(key, turn, fragments, shown, True))
                held, turn, fragments, shown, open_ = "", turn + 1, [], [], False
        if fragments:
            self.fragments.appendList(fragments)
        if shown:
            self.shown.appendList([(x,) for x in shown])
        if self.expiry is not None:
            if due >= 0:
                self.handle.deleteTimer(due)
            due = -1
            if open_:
                due = timers.getCurrentProcessingTimeInMs() + int(self.expiry * 1000)
                self.handle.registerTimer(due)
        self.at.update((held, turn, due))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        _, turn, _ = tuple(self.at.get())
        out = [self._ended(key, turn, [], [], False)]
        self.at.update(("", turn + 1, -1))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def turns(deltas: DataFrame, expiry: float | None = None) -> DataFrame:
    """deltas(key, *DELTA) -> (key, turn, text, calls, complete): each turn once it is over, numbered from 0 within its key.
    Of a table the turns that are over; a task walks through the deltas of a turn and holds what is in its row."""
    shape = f"key {deltas.schema['key'].dataType.simpleString()}, turn long, text string, calls {CALLS}, complete boolean"
    if deltas.isStreaming:
        return deltas.groupBy("key").transformWithStateInPandas(Turns(expiry), shape, "append", "none" if expiry is None else "processingTime")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, held, shown, fragments = None, "", [], []
        for batch in batches:
            out = []
            for key, turn, _, text, index, id_, name, arguments, done in batch[["key", "turn", *DELTA]].itertuples(index=False, name=None):
                own = (_plain(key), turn)
                if own != open_:
                    open_, held, shown, fragments = own, "", [], []
                piece, held = visible(held, _plain(text) or "")
                shown.append(piece)
                if not pd.isna(index):
                    fragments.append((int(index), _plain(id_), _plain(name), _plain(arguments)))
                if _plain(done):
                    calls = [dict(zip(("index", "id", "name", "arguments"), c, strict=True)) for c in assembled(fragments)]
                    out.append((*own, "".join(shown), calls, True))
            yield pd.DataFrame(out, columns=Turns.columns)

    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = deltas.withColumn("turn", F.coalesce(F.sum(F.coalesce(F.col("done"), F.lit(False)).cast("long")).over(before), F.lit(0).cast("long")))
    return numbered.select("key", "turn", *DELTA).repartition("key", "turn").sortWithinPartitions("key", "turn", "seq").mapInPandas(walk, shape)


def replies(turned: DataFrame) -> DataFrame:
    """(key, turn, reply) of the turns that say something."""
    reply = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return turned.select("key", "turn", reply.alias("reply")).filter("reply <> ''")
