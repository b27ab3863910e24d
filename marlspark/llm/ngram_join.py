"""Exact similarity join on word shingles, and its connected components, by set-relation skipping.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Documents with the
same set are one class from the start. Each set's shingles are put in one global order, rare ones first, and the first
n - ceil(0.8 n) + 1 of them are indexed with their position: two sets that link share one of those, and at the first
shared one the positions leave room for the overlap needed, which bounds the sizes of possible partners.

Set relations then save most comparisons (after Wang, Qin, Lin, Zhang, Chang: Leveraging set relations in exact set
similarity join, 2017):
* In each list one set, the one with the smallest relative position, leads; all others are compared with it first, a
  number of pairs that is linear in the list. Links found so join most near copies.
* Only pairs in different components are left. Within a list, entries lie in blocks by size, and an entry's position
  says which blocks can hold partners; the others are skipped. Entries of the label that is most frequent in the list
  meet those of other labels only, so that a list of very many near copies and a few others stays linear.
* A pair is first tested on the two prefixes, which shows most that share a common passage only to be too far apart;
  whole sets are made for what is left.
* An answer that the leader's answers give already isn't computed again: from |a & L| and |b & L| follow an upper and
  a lower bound of |a & b|, and only a pair that neither bound decides is verified.

Orders and filters that are broadcast have fixed sizes (SKETCH bytes, FILTER / 8 bytes). When a corpus outgrows them
they let more through, and results stay the same. Shingles are 64-bit hashes: two given ones meet by chance with a
probability of 2^-64. Sets are told apart by 128 bits of their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, gives_back, small_batches, staged, table, tidy
from .components import connected
from .exact_dedup import in_bitmap

WORDS = 5
SKETCH, CHUNK, FILTER, BLOCK = 1 << 24, 1 << 16, 1 << 26, 32768
#: Size blocks of the index: sizes within a factor of 1.05.
STEP = 1.05
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
#: So many bytes of text are hashed at once; a longer text in parts of about as many, cut between words.
BYTES = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts, ascending; empty without words.

    Works on the UTF-8 bytes of many texts at once, A-Z lower-cased. A word's hash starts from its length and takes in
    its bytes in blocks of eight, each mixed into the state before the next one; the words of one batch go block by
    block together. Words of more than LONG bytes are hashed alone. No sum or product of the bytes is in it, by which
    words of some structure would meet; words of one length up to eight bytes never do.
    """

    LONG = 512

    def __init__(self, words: int = WORDS):
        self.words = words
        self.odd = ODD if words <= len(ODD) else _mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.cut = np.array([*((1 << 8 * k) - 1 for k in range(8)), (1 << 64) - 1], dtype=np.uint64)

    def _words(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words low[begin:end]; eight bytes must follow the last one."""
        blocks = np.ndarray(len(low) - 7, dtype="<u8", buffer=low, strides=(1,))  # the eight bytes from each place on
        size = end - begin
        h = _mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(size <= self.LONG)
        k = 0
        while len(at):
            rest = size[at] - k
            h[at] = _mix(h[at] ^ (blocks[begin[at] + k] & self.cut[np.minimum(rest, 8)]))
            at, k = at[rest > 8], k + 8
        for w in np.flatnonzero(size > self.LONG):
            h[w] = int.from_bytes(hashlib.blake2b(low[begin[w] : end[w]].tobytes(), digest_size=8).digest(), "little")
        return h

    def _in_parts(self, raw: np.ndarray) -> np.ndarray:
        """Hashes of the words of one long text."""
        parts, at = [], 0
        while at < len(raw):
            stop = min(at + BYTES, len(raw))
            gaps = np.flatnonzero(self.space[raw[at:stop]])
            while stop < len(raw) and not len(gaps):  # a word longer than a part
                gaps = np.flatnonzero(self.space[raw[stop : stop + BYTES]]) + stop - at
                stop = min(stop + BYTES, len(raw))
            stop = at + int(gaps[-1]) + 1 if stop < len(raw) else stop
            parts.append(self._hash_words(raw[at:stop], np.zeros(1, dtype=np.int64))[0])
            at = stop
        return np.concatenate(parts)

    def _hash_words(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words of the texts that begin at starts, where the words begin)."""
        gap = self.space[raw]
        first = ~gap
        first[1:] &= gap[:-1]
        at = starts[starts < len(raw)]
        first[at] = ~gap[at]
        begin = np.flatnonzero(first)
        last = ~gap
        last[:-1] &= gap[1:]
        at = at[at > 0] - 1
        last[at] = ~gap[at]
        end = np.flatnonzero(last) + 1
        return self._words(np.r_[self.lower[raw], np.zeros(8, dtype=np.uint8)], begin, end), begin

    def _hashed(self, raw: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """The sets of the texts that begin at starts, the last of them ending with raw."""
        if not len(raw):
            return [np.empty(0, dtype=np.uint64)] * len(starts)
        if len(starts) == 1:
            h = self._in_parts(raw)
            bounds = np.array([0, len(h)])
        else:
            h, begin = self._hash_words(raw, starts)
            bounds = np.r_[np.searchsorted(begin, starts), len(begin)]
        grams = np.full(max(0, len(h) - self.words + 1), self.words, dtype=np.uint64)
        for i in range(self.words):
            grams += h[i : i + len(grams)] * self.odd[i]
        grams = _mix(grams)
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= self.words:
                g = np.sort(grams[lo : hi - self.words + 1])
                keep = np.empty(len(g), dtype=bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                out.append(g[keep])
            elif hi > lo:  # the whole sequence is the one shingle
                out.append(_mix(np.uint64(hi - lo) + (h[lo:hi] * self.odd[: hi - lo]).sum(keepdims=True, dtype=np.uint64)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        return self._hashed(raw, np.zeros(1, dtype=np.int64))[0]

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sets of a column of strings, in order."""
        if len(texts) == 0:
            return
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
        k = 0
        while k < len(texts):
            stop = max(k + 1, int(np.searchsorted(ends, ends[k] + BYTES, side="right")) - 1)
            stop = min(stop, len(texts))
            yield from self._hashed(raw[ends[k] : ends[stop]], ends[k:stop] - ends[k])
            k = stop


def _parts(batch: pa.RecordBatch, column: str, shingler: Shingler, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with their sets, so that only a few sets are held at once."""
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield part, list(shingler.column(part.column(part.schema.get_field_index(column))))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _arrays(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """The arrays of a column of lists of long."""
    lists = batch.column(batch.schema.get_field_index(column))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _numbers(batch: pa.RecordBatch, *columns: str) -> list[list[int]]:
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]


def signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _digests(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, sig) per document, and for each cell of the sketch the logarithm of its shingles' count, as bytes."""

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cells = Shingler(words), np.zeros(SKETCH, dtype=np.uint8)
        for batch in batches:
            for part, sets in _parts(batch, "text", shingler):
                at, times = np.unique(np.concatenate(sets) & np.uint64(SKETCH - 1), return_counts=True)
                at = at.astype(np.int64)
                cells[at] = np.minimum(cells[at] + times, 255)  # saturates; a task's counts only order shingles
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([signature(x) if len(x) else None for x in sets], pa.binary()), none, pa.nulls(part.num_rows, pa.binary())], schema=kind)
        for k in range(0, SKETCH, CHUNK):
            if cells[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k // CHUNK], pa.int64()), pa.array([cells[k : k + CHUNK].tobytes()], pa.binary())], schema=kind)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            logs = np.minimum(255, 6 * np.log2(1 + sums)).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([logs], pa.binary())], names=["chunk", "cells"])

        chunk, sums = None, np.zeros(CHUNK, dtype=np.int64)
        for batch in batches:
            for c, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # the rows of a chunk in a row
                if c != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, sums[:] = c, 0
                sums += np.frombuffer(b.as_buffer(), dtype=np.uint8)
        if chunk is not None:
            yield done()

    kind = pa.schema([("id", pa.string()), ("n", pa.int64()), ("sig", pa.binary()), ("chunk", pa.int64()), ("cells", pa.binary())])
    both = staged(docs.mapInArrow(read, "id string, n long, sig binary, chunk long, cells binary"), "shingle-digests")
    sketch = np.zeros(SKETCH, dtype=np.uint8)
    chunks = both.filter("chunk is not null").select("chunk", "cells").repartition("chunk").sortWithinPartitions("chunk")
    for r in chunks.mapInArrow(total, "chunk long, cells binary").collect():  # SKETCH bytes in all
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["cells"], dtype=np.uint8)
    return both.filter("chunk is null").select("id", "n", "sig"), sketch


def _filter(hashes: DataFrame) -> np.ndarray:
    """hashes(h) -> FILTER bits as bytes, bit h mod FILTER set for each."""
    cell = F.pmod("h", F.lit(FILTER))
    blocks = hashes.select(cell.alias("c")).groupBy(F.expr(f"c div {BLOCK}").alias("b")).agg(F.bitmap_construct_agg(F.col("c") % BLOCK).alias("bits"))
    out = np.zeros(FILTER // 8, dtype=np.uint8)
    for r in blocks.collect():  # at most FILTER / 8 bytes
        out[r["b"] * BLOCK // 8 : (r["b"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    c = (h & np.uint64(FILTER - 1)).astype(np.int64)
    return (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1


def _sig_hash(sig: bytes) -> int:
    return int.from_bytes(sig[:7], "big")


def _prefixes(docs: DataFrame, words: int, order: Broadcast) -> DataFrame:
    """(sig, n, prefix) per class: its first shingles in global order."""

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rank = Shingler(words), order.value
        for batch in batches:
            for _, sets in _parts(batch, "text", shingler):
                rows = {signature(x): x for x in sets if len(x)}
                first = [x[np.lexsort((x, rank[(x & np.uint64(SKETCH - 1)).astype(np.int64)]))[: prefix_length(len(x))]] for x in rows.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([len(x) for x in rows.values()], pa.int64()), _lists(first)], names=["sig", "n", "prefix"])

    found = docs.select("text").mapInArrow(read, "sig binary, n long, prefix array<long>")
    return found.groupBy("sig").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))


def _entries(prefixes: DataFrame) -> DataFrame:
    """(token, sig, pos, n) of the tokens that at least two classes have in their prefix, and of a few more; a table."""
    often = prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("token")
    often = staged(often, "shared-tokens")
    bits = prefixes.sparkSession.sparkContext.broadcast(_filter(often.select(F.col("token").alias("h"))))

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                prefix = part.column(2)
                tokens, sizes = prefix.flatten().to_numpy(), np.diff(prefix.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), sizes)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = np.flatnonzero(_in_filter(bits.value, tokens.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[at]), part.column(0).take(pa.array(row[at])), pa.array(pos[at].astype(np.int64)), part.column(1).take(pa.array(row[at]))], names=["token", "sig", "pos", "n"])

    out = staged(prefixes.select("sig", "n", "prefix").mapInArrow(read, "token long, sig binary, pos long, n long"), "entries")
    bits.destroy()
    discard(often)
    return out


def _sets(docs: DataFrame, words: int, sigs: DataFrame) -> DataFrame:
    """(sig, shingles) of the classes in sigs, and of a few more; a table."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(sigs.select(F.conv(F.hex(F.substring("sig", 1, 7)), 16, 10).cast("long").alias("h"))))

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for _, sets in _parts(batch, "text", shingler):
                rows = {signature(x): x for x in sets if len(x)}
                inside = _in_filter(bits.value, np.array([_sig_hash(x) for x in rows], dtype=np.uint64)) if rows else []
                kept = [x for x, i in zip(rows, inside, strict=True) if i]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), _lists([rows[x] for x in kept])], names=["sig", "shingles"])

    out = staged(docs.select("text").mapInArrow(read, "sig binary, shingles array<long>").groupBy("sig").agg(F.first("shingles").alias("shingles")), "sets")
    bits.destroy()
    return out


def _chosen(prefixes: DataFrame, sigs: DataFrame) -> DataFrame:
    """(sig, prefix) of the classes in sigs, and of a few more; nothing else leaves the scan. A table."""
    bits = prefixes.sparkSession.sparkContext.broadcast(_filter(sigs.select(F.conv(F.hex(F.substring("sig", 1, 7)), 16, 10).cast("long").alias("h"))))

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([_sig_hash(x) for x in batch.column(0).to_pylist()], dtype=np.uint64)
            yield batch.filter(pa.array(_in_filter(bits.value, h)))

    out = staged(prefixes.select("sig", "prefix").mapInArrow(read, "sig binary, prefix array<long>"), "some-prefixes")
    bits.destroy()
    return out


def _likely(pairs: DataFrame, prefixes: DataFrame, order: Broadcast) -> DataFrame:
    """The pairs(a, b, na, nb) that their prefixes don't rule out: up to the place in the global order where the first of
    both prefixes ends, all shared shingles are known; behind it at most what either set has left can be shared."""
    sigs = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    some = _chosen(prefixes, sigs)

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (na, nb, *both) in enumerate(zip(*_numbers(batch, "na", "nb"), _arrays(batch, "x"), _arrays(batch, "y"), strict=True)):
                sides = [(t, rank[(t & np.uint64(SKETCH - 1)).astype(np.int64)]) for t in (p.view(np.uint64) for p in both)]
                r, t = min((int(rs[-1]), int(ts[-1])) for ts, rs in sides)
                known = [ts[(rs < r) | ((rs == r) & (ts <= np.uint64(t)))] for ts, rs in sides]
                most = len(np.intersect1d(*known, assume_unique=True)) + min(na - len(known[0]), nb - len(known[1]))
                keep[k] = 9 * most >= 4 * (na + nb)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    both = pairs.join(some.select(F.col("sig").alias("a"), F.col("prefix").alias("x")), "a").join(some.select(F.col("sig").alias("b"), F.col("prefix").alias("y")), "b")
    out = staged(both.select("a", "b", "na", "nb", "x", "y").mapInArrow(read, "a binary, b binary, na long, nb long"), "likely-pairs")
    discard(some)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, words: int, prefixes: DataFrame, order: Broadcast) -> DataFrame:
    """pairs(a, b, na, nb) that may link, with the exact size of the intersection, o. Whole sets are made again from the
    texts, of the classes in those pairs only."""
    likely = _likely(pairs, prefixes, order)
    if likely.isEmpty():
        return staged(likely.withColumn("o", F.lit(0).cast("long")), "overlaps")
    sets = _sets(docs, words, likely.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
    out = staged(_overlaps(likely, sets), "overlaps")
    discard(sets)
    discard(likely)
    return out


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b, na, nb) with the exact size of the intersection, o."""

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(_arrays(batch, "x"), _arrays(batch, "y"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(["a", "b", "na", "nb"]).columns, pa.array(o, pa.int64())], names=["a", "b", "na", "nb", "o"])

    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(read, "a binary, b binary, na long, nb long, o long")


def linked(o: Column, na: Column, nb: Column) -> Column:
    return 100 * o >= 80 * (na + nb - o)


def _possible(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """Whether sets whose first shared token has these positions can link."""
    return 9 * F.least(na - pa, nb - pb) >= 4 * (na + nb)


def _block(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / float(np.log(STEP)))


@tidy
@small_batches
def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id reachable by links).

    Words are runs of other than ASCII white space, A-Z lower-cased. A text with fewer than `words` words has its
    whole sequence as its one shingle; null, empty and wordless texts have none and link with nothing. Rows with equal
    sets link; null ids never become a component's id, unless it has no other. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    digests, sketch = _digests(docs, words)
    order = docs.sparkSession.sparkContext.broadcast(sketch)  # SKETCH bytes
    classes = digests.filter("sig is not null").groupBy("sig").agg(F.min(F.col("id").cast(id_type)).alias("least"))
    prefixes = staged(_prefixes(docs, words, order), "prefixes")
    entries = _entries(prefixes)

    # first the leader of each list; lists of one are the filter's false positives
    lead = entries.groupBy("token").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("r"), "n", "sig", "pos")).alias("l"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    lead = staged(lead.select("token", F.col("l.sig").alias("leader"), F.col("l.n").alias("nl"), F.col("l.pos").alias("pl"), "sets"), "leaders")
    led = staged(entries.join(lead, "token"), "led")
    discard(entries)
    stars = led.filter((F.col("sig") != F.col("leader")) & _possible(F.col("n"), F.col("pos"), F.col("nl"), F.col("pl"))).select(F.col("sig").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), F.col("nl").alias("nb")).distinct()
    met = staged(stars, "stars")
    stars = _verified(met, docs, words, prefixes, order)
    links = stars.filter(linked(F.col("o"), F.col("na"), F.col("nb"))).select("a", "b")
    labels = staged(connected(links), "star-components")

    # then what is left between components, by blocks, with bounds from the leaders' answers; a list of two is done
    known = stars.select(F.col("a").alias("sig"), F.col("b").alias("leader"), "o")
    full = led.filter("sets > 2").join(known, ["sig", "leader"], "left").join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left")
    full = full.select("token", "sig", "pos", "n", "nl", F.coalesce("label", "sig").alias("label"), F.when(F.col("sig") == F.col("leader"), F.col("n")).otherwise(F.col("o")).alias("o"))
    full = staged(full, "labelled-entries")
    # of a list, the entries of its most frequent label meet those of other labels only: pairs of that label are never made
    usual = full.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "label")).alias("u"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    rest = staged(full.join(staged(usual.select("token", F.col("u.label").alias("usual")), "mixed-tokens"), "token").withColumn("usual", F.col("label") == F.col("usual")), "rest")
    most = F.least(F.col("n"), F.floor((5 * F.col("n") - 9 * F.col("pos")) / 4))  # the largest partner up to its own size
    least = F.ceil(4 * F.col("n") / 5)
    probe = rest.filter(most >= least).select("token", "usual", *[F.col(c).alias(f"{c}_a") for c in ("sig", "pos", "n", "label", "o")], "nl", F.explode(F.sequence(_block(least), _block(most))).alias("block"))
    met_by = F.when(F.col("usual"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))  # by usual probes: unusual entries only
    index = rest.select("token", F.explode(met_by).alias("usual"), *[F.col(c).alias(f"{c}_b") for c in ("sig", "pos", "n", "label", "o")], _block(F.col("n")).alias("block"))
    ordered = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("sig_a") < F.col("sig_b")))
    pairs = probe.join(index, ["token", "block", "usual"]).filter((F.col("label_a") != F.col("label_b")) & ordered & _possible(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b")))
    total = F.col("n_a") + F.col("n_b")
    upper = F.coalesce(F.least(F.col("o_b") + F.col("n_a") - F.col("o_a"), F.col("o_a") + F.col("n_b") - F.col("o_b")), F.col("n_b"))
    lower = F.coalesce(F.col("o_a") + F.col("o_b") - F.col("nl"), F.lit(0))
    pairs = pairs.filter(9 * upper >= 4 * total).groupBy(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")).agg(F.first("n_a").alias("na"), F.first("n_b").alias("nb"), F.max(9 * lower >= 4 * total).alias("sure"))
    done = met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    pairs = staged(pairs.join(done, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti"), "open-pairs")
    found = _verified(pairs.filter("not sure").drop("sure"), docs, words, prefixes, order).filter(linked(F.col("o"), F.col("na"), F.col("nb"))).select("a", "b")
    order.destroy()
    more = staged(found.unionByName(pairs.filter("sure").select("a", "b")), "more-links")
    if not more.isEmpty():
        labels = staged(connected(links.unionByName(more)), "components")

    own = staged(classes.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")), "classes")
    least_of = own.groupBy("label").agg(F.min("least").alias("component"))
    of_class = staged(own.join(staged(least_of, "component-ids"), "label").select("sig", "component"), "class-components")
    plain = digests.filter("sig is null").select(F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), F.col("id").cast(id_type).alias("component_id"))
    rest_rows = digests.filter("sig is not null").join(of_class, "sig")
    return plain.unionByName(rest_rows.select(F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")))


@tidy
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The documents without those that link to one with a smaller id: all their columns, whatever their names, one id per
    component. A document whose id isn't in the filter of the dropped ids passes straight through; only the others shuffle
    with their texts. Texts without words link with nothing and stay; all rows of an id that stays do; a null id stays in a
    component without any other; an empty table stays empty."""
    found = staged(components(docs, id_col, text_col, words).select(F.col(id_col).alias("_id"), F.col(id_col).eqNullSafe(F.col("component_id")).alias("_stays")), "verdicts")
    cell = F.pmod(F.xxhash64("_id"), F.lit(FILTER))
    blocks = found.filter("not _stays").select(cell.alias("_c")).groupBy(F.expr(f"_c div {BLOCK}").alias("_block")).agg(F.bitmap_construct_agg(F.col("_c") % BLOCK).alias("_bits"))
    boxed = docs.select(F.col(id_col).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_box")).withColumn("_cell", cell)
    boxed = boxed.withColumn("_block", F.expr(f"_cell div {BLOCK}")).join(F.broadcast(staged(blocks, "dropped-filter")), "_block", "left")  # at most FILTER / 8 bytes
    boxed = boxed.withColumn("_maybe", in_bitmap("_bits", "_cell")).select("_id", "_box", "_maybe")
    stay = found.filter("_stays").select(F.col("_id").alias("_kept")).distinct()
    maybe = boxed.filter("_maybe").join(stay, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi")
    return boxed.filter("not _maybe").unionByName(maybe).select("_box.*")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))
