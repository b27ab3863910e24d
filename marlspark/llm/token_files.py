"""Token ids in binary shards with a minimal perfect hash index over the documents' keys.

A shard is a header, the ids of its documents one after another as little-endian unsigned integers, and a table of where
each document ends. Shards follow the order of the ids of the documents; a manifest says how many documents and token ids
come before each. The index is split by the hash of the key into parts of about PART_KEYS keys. A part is a minimal
perfect hash in levels (Limasset, Rizk, Chikhi, Peterlongo: Fast and scalable minimal perfect hashing, 2017): in each
level a key that alone falls on a bit keeps it, the others go on to the next level; the number of bits set before a
key's bit is its slot. A slot stores a 32-bit fingerprint of its key, the shard, the document's number and offset
there, its length and how many documents share the key. So a lookup costs a hash, on average fewer than two bits, one
slot and one read of a shard, whatever the size of the corpus; a key that isn't there passes with a chance of 2^-32.

Texts are encoded by the tokenizers library. It cuts a text into pieces that it encodes apart, so texts in Latin letters are
cut by the vocabulary's own pattern, and each distinct piece is encoded once and kept, at most CACHE of them a worker; what
has other letters, combining marks or a special token's string goes to the library as it is.

Documents are range-partitioned by id and row, encoded and written by their tasks under names of their own, and count once
the manifest, a written table, names them: files of tasks that were lost or ran twice are never read. The driver holds one
row per shard and per part of the index.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back, shared_dir, small_batches, staged, table, tidy

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: A shard ends at so many bytes of ids, or documents.
SHARD, SHARD_DOCS = 64 << 20, 1 << 18
#: Keys of a part of the index, about, and parts at least.
PART_KEYS, PARTS = 1 << 16, 16
#: Encoded pieces that a worker keeps, and characters of text that are cut into pieces at once.
CACHE, BYTES = 1 << 19, 1 << 20
MAGIC, INDEX_MAGIC = b"IDSHARD1", b"IDINDEX1"
#: The bits of a level per key that is left, and levels at most; keys beyond them are listed.
GAMMA, LEVELS = 2, 40
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("place", "<u4"), ("length", "<u4"), ("offset", "<u8"), ("copies", "<u8")])
#: Below LATIN there are no combining marks, and a letter in lower case is one letter below LATIN too, but for OTHER.
LATIN, OTHER = 0x180, "\u0130"
_KINDS = {k: "".join(re.escape(chr(c)) for c in range(128, LATIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
_SPACE = "\\t-\\r \\x85\\xa0"
#: The vocabulary's own pattern, for lower-case text below LATIN.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_KINDS['L']}]+|[0-9{_KINDS['N']}]|[^{_SPACE}a-z0-9{_KINDS['L']}{_KINDS['N']}]+")
BEYOND = re.compile(f"[{OTHER}{chr(LATIN)}-\U0010ffff]")
GAP = re.compile("[\\t-\\r ]")


class Encoder:
    """Text -> the bytes of its ids, little-endian unsigned 32-bit, as the library's encode gives them."""

    def __init__(self, vocabulary: str = VOCABULARY, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.cache = cache
        suffix = self.library.model.end_of_word_suffix  # of the last token of each piece
        self.ending = np.zeros(max(self.library.get_vocab().values()) + 1, dtype=bool)
        self.ending[[k for t, k in self.library.get_vocab().items() if t.endswith(suffix)]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        """About BYTES characters at a time, cut at white space."""
        at = 0
        while len(text) - at > BYTES:
            gap = GAP.search(text, at + BYTES)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.end()
        yield text[at:]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes distinct pieces as words of one text; the vocabulary marks the last token of each."""
        for k in range(0, len(pieces), 4096):
            some = pieces[k : k + 4096]
            got = self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype="<u4")
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the library cuts these pieces otherwise")
            raw, at = ids.tobytes(), 0
            for piece, end in zip(some, (4 * ends).tolist(), strict=True):
                self.known[piece] = raw[at:end]
                at = end

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        out = []
        for part in self._parts(text):
            if BEYOND.search(part):
                # a word stands for itself between white space: only those with other letters go to the library
                out += [self._whole(w) if BEYOND.search(w) else self._pieces(w) for w in GAP.split(part)]
            else:
                out.append(self._pieces(part))
        return b"".join(out)

    def many(self, texts: list[str]) -> list[bytes]:
        """Short texts together, so that their new pieces are encoded in one go."""
        plain = [len(t) <= BYTES and not BEYOND.search(t) and not any(s in t for s in self.special) for t in texts]
        cut = [PIECES.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        self._know(set().union(*cut))
        of = self.known.__getitem__
        joined = [b"".join(map(of, pieces)) for pieces in cut]
        return [done if p else self(t) for t, p, done in zip(texts, plain, joined, strict=True)]

    def _know(self, pieces: set[str]) -> None:
        if new := pieces.difference(self.known):
            if len(self.known) + len(new) > self.cache:
                self.known.clear()
                new = pieces
            self._learn(list(new))

    def _pieces(self, text: str) -> bytes:
        pieces = PIECES.findall(text.lower())
        self._know(set(pieces))
        return b"".join(map(self.known.__getitem__, pieces))

    @property
    def width(self) -> int:
        return 2 if self.library.get_vocab_size() <= 1 << 16 else 4


#: Of this Python worker, whose later tasks find the pieces known.
_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def key_of(id_: Column) -> Column:
    """A key as text; null is a key of its own."""
    return F.coalesce(F.concat(F.lit("k"), id_.cast("string")), F.lit("-"))


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def hashes_of(id_: object) -> tuple[int, int]:
    """key_hashes in Python."""
    import xxhash

    key = b"-" if id_ is None else b"k" + str(id_).encode()
    return xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(key, xxhash.xxh64_intdigest(b"second", 42))


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mixed(b, a, 1 << 20) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """A minimal perfect hash of keys given as two 64-bit hashes each; both together must tell them apart."""

    def __init__(self, sizes: list[int], bits: np.ndarray, before: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.before, self.rest = sizes, bits, before, rest
        self.starts = [0, *accumulate(-(-n // 64) for n in sizes)]
        self.listed = {(int(x), int(y)): k for k, (x, y) in enumerate(rest)}

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, levels: int = LEVELS) -> PerfectHash:
        sizes, words = [], []
        while len(a) and len(sizes) < levels:
            size = 64 * -(-GAMMA * len(a) // 64)
            at = (_mixed(a, b, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at]
            a, b = a[left], b[left]
        bits = np.concatenate(words) if words else np.empty(0, dtype="<u8")
        counts = np.bitwise_count(bits).astype(np.int64)
        return cls(sizes, bits, np.cumsum(counts) - counts, np.stack([a, b], axis=1))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; of one that isn't in the set any slot, or -1."""
        out, left = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for level, size in enumerate(self.sizes):
            at = (_mixed(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[self.starts[level] + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[self.starts[level] + (at >> 6)] + below)[hit]
            left = left[~hit]
        if len(self.rest):
            base = int(np.bitwise_count(self.bits).sum())
            for k in left:
                n = self.listed.get((int(a[k]), int(b[k])))
                out[k] = -1 if n is None else base + n
        return out


def _save(stream: object, head: dict, arrays: list[np.ndarray]) -> None:
    text = json.dumps(head | {"arrays": [[x.dtype.str if x.dtype.names is None else "slot", len(x)] for x in arrays]}).encode()
    stream.write(INDEX_MAGIC + len(text).to_bytes(8, "little") + text)
    for x in arrays:
        stream.write(np.ascontiguousarray(x).tobytes())


class IndexPart:
    """One part of the index, in memory."""

    def __init__(self, raw: bytes):
        if raw[:8] != INDEX_MAGIC:
            raise ValueError("no part of an index")
        n = int.from_bytes(raw[8:16], "little")
        head, at, arrays = json.loads(raw[16 : 16 + n]), 16 + n, []
        for kind, count in head["arrays"]:
            dtype = SLOT if kind == "slot" else np.dtype(kind)
            arrays.append(np.frombuffer(raw, dtype=dtype, count=count, offset=at))
            at += dtype.itemsize * count
        bits, before, rest, self.slots = arrays
        self.hash = PerfectHash(head["sizes"], bits, before, rest.reshape(-1, 2))

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its slot's contents)."""
        at = self.hash.slots(a, b)
        if not len(self.slots):
            return np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=SLOT)
        found = self.slots[np.maximum(at, 0)]
        return (at >= 0) & (found["fingerprint"] == _fingerprints(a, b)), found


class Shard(NamedTuple):
    path: str
    docs: int
    ids: int
    first_doc: int
    start: int


class Files(NamedTuple):
    """What open_shard and the index need: all shards in order, the paths of the index's parts, bytes of an id."""

    shards: list[Shard]
    parts: list[str | None]
    width: int


def _write_shards(rows: DataFrame, to: str, vocabulary: str, end_id: int, width: int, shard: int, shard_docs: int) -> DataFrame:
    """rows(key, text) in order, by partition -> a table of entries (key, part, file, place, offset, length, copies),
    one per key and shard, and one per shard with path, docs and ids instead of a key."""
    kind = pa.schema([("key", pa.string()), ("part", pa.int64()), ("file", pa.int64()), ("place", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("copies", pa.int64()), ("path", pa.string())])

    @gives_back
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(to)
        store.create_dir(root, recursive=True)
        part, file, out, path = TaskContext.get().partitionId(), -1, None, None
        ends: list[int] = []
        entries: list[list] = []

        def done() -> pa.RecordBatch:
            table_ = np.array(ends, dtype="<u8")
            out.write(table_.tobytes() + len(ends).to_bytes(8, "little"))
            out.close()
            rows_ = [*entries, [None, part, file, None, ends[-1], None, len(ends), path]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_, strict=True), kind, strict=True)], schema=kind)

        encoder, end = encoder_of(vocabulary), np.array([end_id], dtype=f"<u{width}").tobytes()
        parts = (batch.slice(n, 100) for batch in batches for n in range(0, batch.num_rows, 100))
        for key, found in ((k, f) for part in parts for k, f in zip(part.column(0).to_pylist(), encoder.many([t or "" for t in part.column(1).to_pylist()]), strict=True)):
            ids = np.frombuffer(found, dtype="<u4").astype(f"<u{width}").tobytes() + end
            if out is not None and (ends[-1] * width >= shard or len(ends) >= shard_docs):
                yield done()
                out = None
            if out is None:
                file, ends, entries = file + 1, [], []
                path = f"{root}/shard-{part:06d}-{file:05d}-{uuid.uuid4().hex}.ids"
                out = store.open_output_stream(path, compression=None)
                out.write(MAGIC + width.to_bytes(8, "little"))
            out.write(ids)
            n = len(ids) // width
            if entries and entries[-1][0] == key:
                entries[-1][6] += 1
            else:
                entries.append([key, part, file, len(ends), ends[-1] if ends else 0, n, 1, None])
            ends.append((ends[-1] if ends else 0) + n)
        if out is not None:
            yield done()

    return staged(rows.select("key", "text").mapInArrow(write, "key string, part long, file long, place long, offset long, length long, copies long, path string"), "token-entries")


def _write_index(entries: DataFrame, shards: DataFrame, parts: int, to: str) -> DataFrame:
    """entries of `_write_shards`, shards(part, file, shard) -> (bucket, path, keys) of the parts written."""
    placed = entries.filter("key is not null").join(shards, ["part", "file"])
    first = F.min(F.struct("shard", "place", "offset", "length")).alias("f")
    keys = placed.groupBy("key").agg(first, F.sum("copies").alias("copies")).select("key", "f.*", "copies")  # the documents of a key follow each other
    a, b = key_hashes(F.col("key"))
    keys = keys.select(a.alias("a"), b.alias("b"), "shard", "place", "offset", "length", "copies").withColumn("bucket", F.pmod("a", F.lit(parts)))

    def build(rows: pa.Table) -> pa.Table:
        from pyarrow import fs

        a, b = (rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        hash_ = PerfectHash.of(a, b)
        slots = np.zeros(len(a), dtype=SLOT)
        at = hash_.slots(a, b)
        slots["fingerprint"][at] = _fingerprints(a, b)
        for c in ("shard", "place", "length", "offset", "copies"):
            slots[c][at] = rows.column(c).to_numpy()
        store, root = fs.FileSystem.from_uri(to)
        store.create_dir(root, recursive=True)
        bucket = rows.column("bucket")[0].as_py()
        path = f"{root}/index-{bucket:06d}-{uuid.uuid4().hex}.mph"
        with store.open_output_stream(path, compression=None) as out:
            _save(out, {"sizes": hash_.sizes}, [hash_.bits, hash_.before, hash_.rest.ravel(), slots])
        return pa.table({"bucket": [bucket], "path": [path], "keys": [len(a)]})

    return staged(keys.groupBy("bucket").applyInArrow(build, "bucket long, path string, keys long"), "token-index")


def write_files(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, shard: int = SHARD, shard_docs: int = SHARD_DOCS, part_keys: int = PART_KEYS) -> Files:
    """Writes docs under the folder `to`: all rows, ascending by id, null ids first, rows of one id in the order of docs."""
    spark, width = docs.sparkSession, Encoder(vocabulary).width
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    ready = rows.withColumn("key", key_of(F.col("id"))).repartitionByRange("id", "row").sortWithinPartitions("id", "row")
    entries = _write_shards(ready, to, vocabulary, end_id, width, shard, shard_docs)
    made = entries.filter("path is not null").select("part", "file", "path", F.col("copies").alias("docs"), F.col("offset").alias("ids")).collect()  # a row per shard
    made.sort(key=lambda r: (r["part"], r["file"]))
    docs_before, ids_before = ([0, *accumulate(r[c] for r in made)] for c in ("docs", "ids"))
    shards = [Shard(r["path"], r["docs"], r["ids"], docs_before[k], ids_before[k]) for k, r in enumerate(made)]
    parts = PARTS
    while parts * part_keys < docs_before[-1]:
        parts *= 2
    numbers = spark.createDataFrame([(r["part"], r["file"], k) for k, r in enumerate(made)], "part long, file long, shard long")
    paths: list[str | None] = [None] * parts
    for r in _write_index(entries, numbers, parts, to).collect() if shards else []:  # a row per part
        paths[r["bucket"]] = r["path"]
    return Files(shards, paths, width)


class OpenShard:
    """Reads documents of one shard by number."""

    def __init__(self, path: str, store: object, width: int):
        self.file, self.width = store.open_input_file(path), width
        size = self.file.size()
        self.docs = int.from_bytes(self.file.read_at(8, size - 8), "little")
        if self.file.read_at(16, 0) != MAGIC + width.to_bytes(8, "little"):
            raise ValueError(f"{path} is no shard of ids of {width} bytes")
        ends = np.frombuffer(self.file.read_at(8 * self.docs, size - 8 - 8 * self.docs), dtype="<u8").astype(np.int64)
        self.ends = np.r_[0, ends]
        if 16 + width * self.ends[-1] + 8 * self.docs + 8 != size:
            raise ValueError(f"{path} isn't as long as its table says")

    def ids(self, first: int, end: int) -> np.ndarray:
        """Of the documents first to end, which isn't in it, one after another."""
        lo, hi = int(self.ends[first]), int(self.ends[end])
        return np.frombuffer(self.file.read_at(self.width * (hi - lo), 16 + self.width * lo), dtype=f"<u{self.width}")


class Reader:
    """Keyed access on one machine, as a training process uses it: parts and shards are opened when first asked for."""

    def __init__(self, files: Files, root: str):
        from pyarrow import fs

        self.files, (self.store, _) = files, fs.FileSystem.from_uri(root)
        self.parts: dict[int, IndexPart] = {}
        self.shards: dict[int, OpenShard] = {}

    def __getitem__(self, id_: object) -> list[np.ndarray]:
        """The ids of each document with that key, in order; KeyError if there is none."""
        a, b = hashes_of(id_)
        bucket = (a - (1 << 64) if a >> 63 else a) % len(self.files.parts)
        if (path := self.files.parts[bucket]) is None:
            raise KeyError(id_)
        if bucket not in self.parts:
            with self.store.open_input_file(path) as f:
                self.parts[bucket] = IndexPart(f.read())
        there, found = self.parts[bucket].find(np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64))
        if not there[0]:
            raise KeyError(id_)
        out, (shard, place, copies) = [], (int(found[0][c]) for c in ("shard", "place", "copies"))
        for k, lo, hi in spread(self.files, shard, place, copies):
            if k not in self.shards:
                self.shards[k] = OpenShard(self.files.shards[k].path, self.store, self.files.width)
            out += [self.shards[k].ids(n, n + 1) for n in range(lo, hi)]
        return out


def spread(files: Files, shard: int, place: int, copies: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of so many documents from a place on."""
    while copies > 0:
        n = min(copies, files.shards[shard].docs - place)
        yield shard, place, place + n
        shard, place, copies = shard + 1, 0, copies - n


def lookup(keys: DataFrame, files: Files, root: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """keys(id_col) -> by the index, per document of each distinct key: id_col, start, n_tokens, ids_crc32 (and ids); a key
    that isn't there has one row of nulls. Each task reads one part of the index, then one shard."""
    spark, parts = keys.sparkSession, len(files.parts)
    kind = keys.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    known = spark.sparkContext.broadcast(files)  # a row per shard and part
    a, b = key_hashes(key_of(F.col("id")))
    asked = keys.select(F.col(f"`{id_col}`").alias("id")).distinct().withColumns({"a": a, "b": b}).withColumn("bucket", F.pmod("a", F.lit(parts)))

    def probe(rows: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        path = known.value.parts[rows.column("bucket")[0].as_py()]
        out: list[tuple] = []
        if path is None:
            out = [(k, None, None, None) for k in range(rows.num_rows)]
        else:
            with store.open_input_file(path) as f:
                part = IndexPart(f.read())
            there, found = part.find(*(rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b")))
            for k, (ok, x) in enumerate(zip(there, found, strict=True)):
                out += [(k, *y) for y in spread(known.value, int(x["shard"]), int(x["place"]), int(x["copies"]))] if ok else [(k, None, None, None)]
        at, *rest = zip(*out, strict=True)
        return pa.Table.from_arrays([rows.column("id").take(pa.array(at)), *(pa.array(x, pa.int64()) for x in rest)], names=["id", "shard", "first", "end"])

    def read(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        number = rows.column("shard")[0].as_py()
        entry = known.value.shards[number]
        shard = OpenShard(entry.path, store, known.value.width)
        ids_type = pa.list_(pa.int64())
        for batch in rows.sort_by("first").to_batches(max_chunksize=1000):
            at, cells = [], []
            for k, lo, hi in zip(range(batch.num_rows), batch.column("first").to_pylist(), batch.column("end").to_pylist(), strict=True):
                for n in range(lo, hi):
                    ids = shard.ids(n, n + 1).astype("<u4")
                    at.append(k)
                    cells.append((entry.start + int(shard.ends[n]), len(ids), zlib.crc32(ids.tobytes()), *([ids.astype("int64")] if with_ids else [])))
                    if len(at) >= 1000:
                        yield shaped(batch, at, cells, ids_type)
                        at, cells = [], []
            if at:
                yield shaped(batch, at, cells, ids_type)

    def shaped(batch: pa.RecordBatch, at: list[int], cells: list[tuple], ids_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*cells, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *(pa.array(c, pa.int64()) for c in columns[:3]), *([pa.array(columns[3], ids_type)] if with_ids else [])], names=names)

    names = ["id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    found = staged(asked.groupBy("bucket").applyInArrow(probe, f"id {kind}, shard long, first long, end long"), "token-places")
    whole = lambda rows: pa.Table.from_batches(list(read(rows)))
    shape = f"id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    there = found.filter("shard is not null").groupBy("shard").applyInArrow(whole, shape)
    none = found.filter("shard is null").selectExpr("id", "cast(null as long) start", "cast(null as long) n_tokens", "cast(null as long) ids_crc32", *(["cast(null as array<long>) ids"] if with_ids else []))
    return there.unionByName(none).withColumnRenamed("id", id_col)


@tidy
@small_batches
def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, shard: int = SHARD, shard_docs: int = SHARD_DOCS, part_keys: int = PART_KEYS, with_ids: bool = False) -> DataFrame:
    """Writes docs into the shared folder and reads every document back by its key: id_col, start (ids of all documents
    before it), n_tokens (with the end id), ids_crc32 (and ids, if asked for); a row per input row.

    A null text is empty and has its end id alone; a null id is a key of its own, before all others; the rows of a
    repeated id follow each other in the order of docs, all under their one key, over as many shards as they need. Texts
    are encoded whole. An empty table gives an empty result; columns that aren't named don't matter.
    """
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files = write_files(docs, to, id_col, text_col, vocabulary, end_id, shard, shard_docs, part_keys)
    if not files.shards:
        kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    return staged(lookup(docs.select(F.col(f"`{id_col}`")), files, to, id_col, with_ids), "token-documents")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))
