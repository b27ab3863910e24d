"""Operators on live message streams, with event-time watermarks where the semantics allow.

`deduplicated` bounds the ids that it knows by time, `seen.unseen` by count. Sessions still open when a stream ends stay in its
state.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP, DELAY = "30 minutes", "1 hour"


def timed(messages: DataFrame, at: str) -> DataFrame:
    """The time column as a timestamp with zone, which watermarks need."""
    return messages.withColumn(at, F.col(at).cast("timestamp"))


def debounced(messages: DataFrame, key: str, at: str, label: str, body: str, gap: str = GAP, delay: str = DELAY) -> DataFrame:
    """Messages of a key that follow one another within the gap, merged: (key, start, end, n, body)."""
    rows = timed(messages, at)
    if rows.isStreaming:
        rows = rows.withWatermark(at, delay)
    got = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(label).cast("string").alias("l"), F.col(body).alias("b")))).alias("m"))
    lines = F.array_join(F.transform("m", lambda r: F.concat(r["l"], F.lit(": "), r["b"])), "\n")
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.when(F.col("n") == 1, F.col("m")[0]["b"]).otherwise(lines).alias("body"))


def deduplicated(messages: DataFrame, ids: list[str], at: str, delay: str = DELAY) -> DataFrame:
    """The first message of each id; on a stream within the watermark's delay."""
    rows = timed(messages, at)
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(ids) if rows.isStreaming else rows.dropDuplicates(ids)


def windowed_counts(messages: DataFrame, at: str, width: str, group: list[str], delay: str = DELAY) -> DataFrame:
    rows = timed(messages, at)
    if rows.isStreaming:
        rows = rows.withWatermark(at, delay)
    return rows.groupBy(F.window(at, width).alias("w"), *group).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *group, "n")


class PhaseMachine(StatefulProcessor):
    """Per run: the next phase from a verdict, with the last failure signature as state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "signature string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        seen = self.last.get() if self.last.exists() else None
        last = seen[0] if seen else None
        for pdf in rows:
            for r in pdf.sort_values("step").itertuples(index=False):
                phase = "done" if r.verdict == "pass" else "failed" if r.verdict == "blocked" else "replan" if r.signature == last else "repair"
                last = r.signature
                out.append((key[0], r.step, phase))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["run", "step", "next_phase"])

    def close(self) -> None:
        pass


def next_phases(verdicts: DataFrame) -> DataFrame:
    """verdicts(run, step, verdict, signature) as they come -> (run, step, next_phase)."""
    return verdicts.groupBy("run").transformWithStateInPandas(PhaseMachine(), f"run {verdicts.schema['run'].dataType.simpleString()}, step long, next_phase string", "append", "none")


ENTRY = ("at timestamp", "id string", "author string", "label string", "body string", "mentioned boolean")
MERGED = "start timestamp, end timestamp, n long, body string, was_mentioned boolean, id string, author string"


EMPTY = "[empty message]"
Entry = namedtuple("Entry", [c.split()[0] for c in ENTRY])


def merged_body(entries: list) -> str:
    """One message's body as it is, several as `label: body` lines."""
    return entries[0].body if len(entries) == 1 else "\n".join(f"{e.label}: {e.body}" for e in entries)


class Debouncer(StatefulProcessor):
    """Per key: messages wait until none has come for `gap` seconds, or until one mentions the reader; then they go on as one
    message, with the id and author of the last. Timers run on event time."""

    columns = ["key", *(c.split()[0] for c in MERGED.split(", "))]

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(ENTRY))

    def _due(self, entry: object) -> int:
        return int((entry.at.timestamp() + self.gap) * 1000)

    def _flush(self, key: tuple, entries: list, mention: bool) -> tuple:
        last = entries[-1]
        return key[0], entries[0].at, last.at, len(entries), merged_body(entries), mention, last.id, last.author

    def _entries(self) -> list:
        return [Entry(*row) for row in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        entries, out = self._entries(), []
        if entries:
            self.handle.deleteTimer(self._due(entries[-1]))
        new = pd.concat(list(rows)).sort_values(["at", "id"])
        for row in new[list(Entry._fields)].itertuples(index=False, name=None):
            entry = Entry(*row)
            if entries and (entry.at - entries[-1].at).total_seconds() >= self.gap:  # its timer ran out in between
                out.append(self._flush(key, entries, False))
                entries = []
            entries.append(entry)
            if entry.mentioned:
                out.append(self._flush(key, entries, True))
                entries = []
        self.waiting.clear()
        if entries:
            self.waiting.put([tuple(e) for e in entries])
            self.handle.registerTimer(self._due(entries[-1]))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        entries = self._entries()
        self.waiting.clear()
        out = [self._flush(key, entries, False)] if entries else []
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Album(Debouncer):
    """Per group of media: parts, whose label is the path of a medium, are collected until `gap` seconds after the first
    one, however many come. Parts without a text don't count in the body; the id and author are the first part's."""

    columns = [*Debouncer.columns, "media"]

    def _flush(self, key: tuple, entries: list, mention: bool) -> tuple:
        bodies = [e.body for e in entries if e.body and e.body != EMPTY]
        media = list(dict.fromkeys(e.label for e in entries if e.label))
        return key[0], entries[0].at, entries[-1].at, len(entries), "\n".join(bodies) or EMPTY, False, entries[0].id, entries[0].author, media

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        entries, out = self._entries(), []
        started = bool(entries)
        new = pd.concat(list(rows)).sort_values(["at", "id"])
        for row in new[list(Entry._fields)].itertuples(index=False, name=None):
            entry = Entry(*row)
            if entries and (entry.at - entries[0].at).total_seconds() >= self.gap:
                out.append(self._flush(key, entries, False))
                if started:
                    self.handle.deleteTimer(self._due(entries[0]))
                entries, started = [], False
            entries.append(entry)
        self.waiting.clear()
        self.waiting.put([tuple(e) for e in entries])
        if not started:
            self.handle.registerTimer(self._due(entries[0]))
        yield pd.DataFrame(out, columns=self.columns)


def _stateful(messages: DataFrame, processor: StatefulProcessor, delay: str, more: str = "") -> DataFrame:
    """messages(key, at, id, author, label, body, mentioned), a stream."""
    rows = timed(messages, "at").withWatermark("at", delay)
    kind = messages.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, {MERGED}{more}", "append", "eventTime")


def buffered(messages: DataFrame, gap: float, delay: str = "0 seconds") -> DataFrame:
    """Debounced messages with an early end at a mention: (key, start, end, n, body, was_mentioned, id, author)."""
    if messages.isStreaming:
        return _stateful(messages, Debouncer(gap), delay)
    w = Window.partitionBy("key").orderBy("at", "id")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    fresh = F.coalesce((seconds(F.col("at")) - seconds(F.lag("at").over(w)) >= gap) | F.lag("mentioned").over(w), F.lit(True))
    rows = messages.withColumn("_s", fresh.cast("int")).withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct("at", "id", "author", F.col("label").cast("string").alias("label"), "body", "mentioned")
    got = rows.groupBy("key", "_g").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    last = F.element_at("e", -1)
    lines = F.array_join(F.transform("e", lambda x: F.concat(x["label"], F.lit(": "), x["body"])), "\n")
    body = F.when(F.size("e") == 1, F.col("e")[0]["body"]).otherwise(lines)
    return got.select("key", F.col("e")[0]["at"].alias("start"), last["at"].alias("end"), F.size("e").cast("long").alias("n"), body.alias("body"), last["mentioned"].alias("was_mentioned"), last["id"].alias("id"), last["author"].alias("author"))


def albums(messages: DataFrame, gap: float = 0.6, delay: str = "0 seconds") -> DataFrame:
    """Parts of media groups, merged from the first one on for a fixed time; the columns of `buffered`, and media, the
    distinct paths. Without a stream a group's parts, a few, are walked through in one go."""
    if messages.isStreaming:
        return _stateful(messages, Album(gap), delay, ", media array<string>")
    album = Album(gap)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        entries: list[Entry] = []
        for row in pdf.sort_values(["at", "id"])[list(Entry._fields)].itertuples(index=False, name=None):
            entry = Entry(*row)
            if entries and (entry.at - entries[0].at).total_seconds() >= gap:
                out.append(album._flush((pdf["key"].iloc[0],), entries, False))
                entries = []
            entries.append(entry)
        out.append(album._flush((pdf["key"].iloc[0],), entries, False))
        return pd.DataFrame(out, columns=album.columns)

    kind = messages.schema["key"].dataType.simpleString()
    return timed(messages, "at").groupBy("key").applyInPandas(merged, f"key {kind}, {MERGED}, media array<string>")


def warm_events(payloads: DataFrame, session: str = "session") -> DataFrame:
    """payloads(session, payload, cold, cursor, events array<struct<seq, type, ..>>) -> the added messages, one row each, with
    the cursor to resume at. The first payload of a session that started without a cursor only says where it stands: its events are
    history and go; the cursor is the largest number seen, of the payload or of its events that count."""
    first = F.row_number().over(Window.partitionBy(session).orderBy("payload")) == 1
    rows = payloads.withColumn("_skip", first & F.col("cold"))
    seen = F.when(~F.col("_skip"), F.array_max(F.transform("events", lambda e: e["seq"])))
    w = Window.partitionBy(session).orderBy("payload").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cursor", F.max(F.greatest("cursor", seen)).over(w))
    return rows.filter("not _skip").select(session, "payload", "cursor", F.explode("events").alias("e")).select(session, "payload", "cursor", "e.*").filter("type = 'message.add'")


def publish(messages: DataFrame, queue: str) -> None:
    """Appends messages to a queue, a folder of JSON lines without a bound."""
    messages.write.mode("append").json(queue)


def queued(spark: SparkSession, queue: str, schema: str, at_once: int = 1) -> DataFrame:
    """The queue as a stream, `at_once` files a batch in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).json(queue)


def consume(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Hands all batches that are there now to `handle`, one after another; each one once, also after a restart, unless the
    handler itself was cut off: then its batch comes again."""
    query = stream.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all that is there now into a Parquet folder, resuming from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
