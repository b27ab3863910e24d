"""Deduplication by a set of seen ids that is bounded by count: of each key the ids of the last `limit` messages that were
new. A message whose id is among them goes; a new one enters, and the oldest leaves. An id that comes again doesn't move."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT = 1000


class SeenIds(StatefulProcessor):
    """The set as two maps, from ids to places and from places to ids, so that a message touches a few entries of it."""

    def __init__(self, id_col: str, order: str, limit: int):
        self.id_col, self.order, self.limit = id_col, order, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "id string", "place long")
        self.queue = handle.getMapState("queue", "place long", "id string")
        self.ends = handle.getValueState("ends", "first long, next long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        first, after = tuple(self.ends.get()) if self.ends.exists() else (0, 0)
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        keep = []
        for id_ in new[self.id_col]:
            known = (str(id_),)
            keep.append(not self.places.containsKey(known))
            if not keep[-1]:
                continue
            self.places.updateValue(known, (after,))
            self.queue.updateValue((after,), known)
            after += 1
            if after - first > self.limit:
                self.places.removeKey(tuple(self.queue.getValue((first,))))
                self.queue.removeKey((first,))
                first += 1
        self.ends.update((first, after))
        yield new[keep]

    def close(self) -> None:
        pass


def unseen(messages: DataFrame, key: str, id_col: str, order: str, limit: int = LIMIT) -> DataFrame:
    """The messages of each key that are new, with all their columns, in the order of `order`. A null id is an id. Without a
    stream the messages of a key pass through one task, which holds the seen ids and no more."""
    if messages.isStreaming:
        return messages.groupBy(key).transformWithStateInPandas(SeenIds(id_col, order, limit), messages.schema, "append", "none")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = object(), OrderedDict()
        for batch in batches:
            keep = []
            for own, id_ in zip(batch[key], batch[id_col], strict=True):
                own = None if pd.isna(own) else own
                if own != last:
                    last, seen = own, OrderedDict()
                known = str(id_)
                keep.append(known not in seen)
                if keep[-1]:
                    seen[known] = True
                    if len(seen) > limit:
                        seen.popitem(last=False)
            yield batch[keep]

    return messages.repartition(key).sortWithinPartitions(key, order).mapInPandas(walk, messages.schema)
