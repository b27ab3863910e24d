"""File sources and sinks: source trees, JSON lines, Markdown with frontmatter, event logs, versioned state."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import expired
from ..operators.scan import glob_pattern
from . import versioned
from .tree import IGNORED, MAX_FILE_BYTES, source_tree

PREDICTION = ("instance_id", "model_name_or_path", "model_patch")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors both write: in spark.checkpoint.dir; unset, in a temporary folder in
    local mode, where all tasks run in this process, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base}/marlspark-files/{name}-{uuid.uuid4().hex}"


def source_files(spark: SparkSession, root: str, allowed: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, text) of the UTF-8 files under root, paths relative to it. A local root is walked without its ignored folders;
    in other stores name and size filters act on Spark's listing, before a file is read. Files with NUL or invalid UTF-8 are left out."""
    base = root.rstrip("/")
    patterns = [glob_pattern(g) for g in allowed or []]
    if re.match("file:|/", base) or ":" not in base:
        return source_tree(spark, re.sub("^file:(//)?", "", base), patterns, max_bytes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).filter(F.col("length") <= max_bytes)
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    files = files.withColumn("path", relative).filter(~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, IGNORED)) + ")/"))
    if allowed:
        files = files.filter(F.col("path").rlike("|".join(patterns)))
    return files.filter(F.is_valid_utf8(F.col("content").cast("string")) & ~F.col("content").cast("string").contains("\0")).select("path", F.col("content").cast("string").alias("text"))


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, or files that are one JSON array; any other JSON value raises. A folder may hold both kinds: each file is
    read as what its first character says, which is found line by line. The driver holds the files' paths if any is an array."""
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("at"), F.substring(F.regexp_replace("value", "^\\s+", ""), 1, 1).alias("c"))
    first = lines.filter("c <> ''").groupBy("file").agg(F.min_by("c", "at").alias("c"))
    kinds = {r["c"] for r in first.select("c").distinct().collect()}
    if not kinds <= {"{", "["}:
        raise TypeError(f"{path}: neither JSON lines nor an array of objects")
    reader = spark.read.schema(schema) if schema else spark.read
    if "[" not in kinds:
        return reader.json(path)
    files = {c: [] for c in kinds}
    for r in first.collect():
        files[r["c"]].append(unquote(r["file"]))
    parts = [reader.option("multiLine", c == "[").json(own) for c, own in sorted(files.items())]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value) of the lines that aren't blank, from 0 in the order of the files' names and within each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).filter(F.trim("value") != "")
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row per file and block
    base, starts = 0, []
    for r in sorted(blocks, key=lambda r: (r["file"], r["block"])):
        starts.append((r["file"], r["block"], base - r["first"]))
        base += r["n"]
    return lines.join(spark.createDataFrame(starts, "file string, block long, base long"), ["file", "block"]).select((F.col("base") + F.col("at")).alias("ordinal"), "value")


def appended_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value) of a log that `append_events` writes: from 0 in the order of the appends, and of an append's rows."""
    last = versioned.newest(spark, path)
    starts, base = [], 0
    for part, offsets in zip(last["parts"], last["lines"], strict=True):  # a row per append and partition of it
        for number, n in offsets:
            starts.append((part, number, base))
            base += n
    rows = spark.read.schema("value string, at long").parquet(*[f"{path}/{p}" for p in last["parts"]])
    rows = rows.select("value", "at", F.regexp_extract(F.col("_metadata.file_path"), "(data-[0-9a-f]{32})/", 1).alias("part"), F.shiftright("at", 33).alias("number"))
    starts = spark.createDataFrame(starts, "part string, number long, base long")
    return rows.join(starts, ["part", "number"]).select((F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("ordinal"), "value")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, run_id, kind, data) of an event log: JSON lines in plain files, or what `append_events` has written. Rows of
    an older form, without schema_version or run_id, become kind "legacy" with the whole row as data; bad JSON raises."""
    ordered = bool(versioned.commits(spark, path))
    row = (appended_lines if ordered else numbered_lines)(spark, path).withColumn("v", F.parse_json("value"))
    field = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
    legacy = field("schema_version", "int").isNull() | field("run_id").isNull()
    return row.select("ordinal", field("run_id").alias("run_id"), F.when(legacy, "legacy").otherwise(field("kind")).alias("kind"), F.when(legacy, F.col("v")).otherwise(F.try_variant_get("v", "$.data", "variant")).alias("data"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends all rows in their order, or none. The rows of an append follow those of the one that was committed before,
    whatever the names and sizes of files; of two writers at once both succeed, one after the other."""
    spark = events.sparkSession
    rows = events.select(F.to_json(F.struct(*events.columns)).alias("value"), F.monotonically_increasing_id().alias("at"))
    versioned.commit_lines(spark, path, rows)


def history(spark: SparkSession, path: str, schema: str, last: int, where: str | None = None) -> DataFrame:
    """The last rows of a JSON-lines file in file order; corrupt lines are skipped."""
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select("*", *place).withColumn("_k", F.monotonically_increasing_id())
    rows = rows.filter(where) if where else rows
    order = ["_file", "_at", "_k"]  # files by name, their blocks by offset, the rows of a block as they are read
    return rows.orderBy(*map(F.desc, order)).limit(last).orderBy(*order).drop(*order)


def _text_of(value: object) -> str | None:
    """A YAML value as text: scalars as YAML writes them, dates in ISO form, lists and maps as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, dict)):
        return json.dumps(value, ensure_ascii=False, default=lambda x: _text_of(x))
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def yaml_fields(text: str) -> dict[str, str | None]:
    """The top-level fields of YAML, values as text; empty for what isn't a map or doesn't parse. Without a YAML library
    only lines of `key: value` count."""
    try:
        import yaml
    except ImportError:
        pairs = (line.partition(":") for line in text.split("\n") if not line.startswith((" ", "\t", "#", "-")))
        return {k.strip(): v.strip().strip("\"'") for k, sep, v in pairs if sep and k.strip()}
    try:
        loaded = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError):
        return {}
    return {str(k): _text_of(v) for k, v in loaded.items()} if isinstance(loaded, dict) else {}


def split_frontmatter(text: str) -> tuple[dict, str]:
    """(fields, body) of a Markdown text that may begin with YAML between two lines of ---; if the second one is missing, there are no
    fields and all behind the first one is body."""
    lines = text.splitlines(keepends=True)
    if not lines or lines[0].strip() != "---":
        return {}, text
    end = next((k for k, line in enumerate(lines) if k and line.strip() == "---"), None)
    if end is None:
        return {}, "".join(lines[1:])
    return yaml_fields("".join(lines[1:end])), "".join(lines[end + 1 :])


def frontmatter(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds fields (map) and body."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [split_frontmatter(t or "") for t in s]
            yield pd.DataFrame({"fields": [f for f, _ in got], "body": [b for _, b in got]})

    split = F.pandas_udf(read, "fields map<string,string>, body string")
    return rows.withColumn("_s", split(F.col(text_col))).select("*", "_s.fields", "_s.body").drop("_s")


def memory_files(spark: SparkSession, root: str, index: str = "MEMORY.md", most: int | None = 50, now: Column | None = None, with_disabled: bool = False, with_expired: bool = False) -> DataFrame:
    """Markdown files but the index, newest first, with their frontmatter: without disabled ones, and without those whose
    ttl_days have passed since updated_at, or else created_at. `most` counts what is left of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(root).filter(~F.col("path").endswith(f"/{index}"))
    rows = frontmatter(files.select("path", "modificationTime", F.col("content").cast("string").alias("text")), "text").drop("text")
    field = lambda name: F.col("fields")[name]
    if not with_disabled:
        rows = rows.filter(~F.coalesce(F.lower(F.trim(field("disabled"))).isin("true", "1", "yes", "on"), F.lit(False)))
    if not with_expired:
        at = lambda name: F.try_to_timestamp(field(name))
        rows = rows.filter(~expired(field("ttl_days").try_cast("int"), at("created_at"), at("updated_at"), F.current_timestamp() if now is None else now))
    newest = rows.orderBy(F.desc("modificationTime"), "path")
    return newest if most is None else newest.limit(most)


def write_version(df: DataFrame, root: str) -> int:
    """Makes df the next version; readers see all of it or none, and earlier versions stay."""
    return versioned.commit(df.sparkSession, root, lambda _: df)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return versioned.read(spark, root, version)


def upsert_version(df: DataFrame, root: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """The next version: merge(rows of the newest one, df), worked out anew if another writer was first."""
    return versioned.commit(df.sparkSession, root, lambda old: df if old is None else merge(old, df))


def write_texts(rows: DataFrame, root: str) -> int:
    """Writes rows(name, text) as a file each under root, by way of a temporary name, so that readers see all of a file or
    none; of rows with one name one stays. Names are paths below root. Returns how many were written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, last = f"{base}/{name}".rpartition("/")
                if ".." in name.split("/"):
                    raise ValueError(f"{name} lies outside")
                store.create_dir(folder, recursive=True)
                spare = f"{folder}/.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(spare, compression=None) as f:
                    f.write((text or "").encode())
                store.move(spare, f"{folder}/{last}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select("name", "text").mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0


def write_predictions(rows: DataFrame, path: str) -> None:
    """(instance_id, model_name_or_path, model_patch) as one compact JSON object per line, nulls written out."""
    rows.select(*PREDICTION).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def prediction_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*PREDICTION), {"ignoreNullFields": "false"}).alias("line"))


def dataset_shard(spark: SparkSession, root: str, split: str, revision: str) -> DataFrame:
    """One pinned revision of a data set that was copied to root: its split as a single Parquet file."""
    return spark.read.parquet(f"{root.rstrip('/')}/{revision}/data/{split}-00000-of-00001.parquet")


def prepare_manifest(spark: SparkSession, path: str, manifest: dict, force: bool = False) -> dict:
    """Freezes a manifest, which fits on the driver, as JSON with its digest: one that is there already and has the same
    digest stays; a different one raises unless force replaces it, by a rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, spare = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(conf)
    sealed_ = manifest | {"sha256": canonical_digest(manifest)}
    if fs.exists(at):
        there = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
        if there.get("sha256") == sealed_["sha256"]:
            return there
        if not force:
            raise ValueError(f"{path} holds a different manifest")
    out = fs.create(spare, True)
    out.write(bytearray((json.dumps(sealed_, indent=2, ensure_ascii=False) + "\n").encode()))
    out.close()
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(spare, at, array)
    return sealed_


def definitions(spark: SparkSession, root: str) -> DataFrame:
    """Agents or skills: Markdown files with frontmatter under root, by file name: (name, description, fields, body). Without a
    name in its frontmatter one is called as its file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(root)
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    got = frontmatter(files.select(F.col("path"), stem.alias("stem"), F.col("content").cast("string").alias("text")), "text")
    named = got.withColumn("name", F.coalesce(F.nullif(F.col("fields")["name"], F.lit("")), F.col("stem")))
    return named.orderBy("path").select("name", F.coalesce(F.col("fields")["description"], F.lit("")).alias("description"), "fields", "body")


def canonical_digest(value: object) -> str:
    """SHA-256 of sorted compact JSON: for manifests, which fit on the driver."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def sealed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the SHA-256 of the row's JSON."""
    return rows.withColumn("sha256", F.sha2(F.to_json(F.struct(*columns)), 256))


PUBLIC = ("instance_id", "repo", "base_commit", "problem_statement", "difficulty")
GOLD = ("patch", "test_patch", "hints_text", "FAIL_TO_PASS", "PASS_TO_PASS", "environment_setup_commit")


def gold_keys(row: Column) -> Column:
    """The gold fields that a JSON object has; a row that has any is to be rejected. Null and what is no object have none."""
    return F.array_sort(F.array_intersect(F.coalesce(F.json_object_keys(row), F.array().cast("array<string>")), F.array(*map(F.lit, GOLD))))


def public_rows(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The public columns only; strict raises if a gold column is there."""
    if strict and (bad := [c for c in rows.columns if c in GOLD]):
        raise ValueError(f"gold columns in public rows: {bad}")
    return rows.select(*PUBLIC)
