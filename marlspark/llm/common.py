"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The hot groups of `with_group` are spread over so many salts.
SALTS = 1024
#: Buckets of `ranked` at least, and of those that one task adds up at most.
BUCKETS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; unset, the warehouse's parent on a
    cluster and a temporary folder in local mode, where all tasks run in this process."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return f"{base}/marlspark/{spark.sparkContext.applicationId}"
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        return f"file://{base}/marlspark/{spark.sparkContext.applicationId}"
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_marlspark/{spark.sparkContext.applicationId}"


#: The tables made in the innermost `tables_of` around, so that one run never touches another's.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
NAME = re.compile(r"-[0-9a-f]{32}$")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor
    costs only the tasks that ran on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_of() -> Iterator[list[str]]:
    """The paths of the tables that `staged` makes within, as they are made."""
    token = _made.set(made := [])
    try:
        yield made
    finally:
        _made.reset(token)


def settled(df: DataFrame, name: str) -> DataFrame:
    """A table that gives the same rows in the same order and partitions when it is read twice: df itself where it only
    picks, filters and computes on files or local rows, else a copy of it made by `staged`."""
    plain = {*_nodes(df)} <= {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation"}
    return df if plain and df._jdf.queryExecution().analyzed().deterministic() else staged(df, name)


def _nodes(df: DataFrame) -> list[str]:
    """The kinds of node in df's plan."""
    nodes = [df._jdf.queryExecution().analyzed()]
    for node in nodes:
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return [n.getClass().getSimpleName() for n in nodes]


def in_order(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """columns of df and, as `name`, each row's place in it: of a table of Parquet files, from 0 without gaps, by the names of the
    files and by the rows in each, which is the order they were written in; a reader takes files and parts of them in another
    one. Of other tables the place is by partition."""
    if {*_nodes(df)} <= {"Project", "SubqueryAlias", "LogicalRelation"}:
        with suppress(AnalysisException):  # no files, or files without numbered rows
            file = df.metadataColumn("_metadata")
            rows = df.select(*columns, file["file_path"].alias("_file"), file["row_index"].alias("_at"))
            before = F.sum(F.col("_last") + 1).over(Window.orderBy(F.length("_of"), "_of").rowsBetween(Window.unboundedPreceding, -1))
            files = rows.groupBy(F.col("_file").alias("_of")).agg(F.max("_at").alias("_last"))  # a row per file
            files = files.select("_of", F.coalesce(before, F.lit(0)).alias("_before"))
            return rows.join(F.broadcast(files), F.col("_file") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_at")).drop("_file", "_of", "_before", "_at")
    return df.select(*columns, F.monotonically_increasing_id().alias(name))


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def reads(df: DataFrame) -> set[str]:
    """The names of the folders that df reads: those of tables made by `staged`, and of other files."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for leaf in (leaves.apply(k) for k in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(k).getName() for k in range(roots.size())}
    return found


def discard(df: DataFrame) -> None:
    """Deletes a table made by `staged`, once nothing reads it any more."""
    delete(df.sparkSession, [f"{shared_dir(df.sparkSession)}/{name}" for name in reads(df) if NAME.search(name)])


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that deletes the tables it has made, but for those that its result still reads."""

    @wraps(f)
    def run(*args: object, **kwargs: object) -> DataFrame:
        with tables_of() as made:
            out = f(*args, **kwargs)
        used = reads(out)
        delete(out.sparkSession, [p for p in made if p.rsplit("/", 1)[-1] not in used])
        if (outer := _made.get()) is not None:
            outer += [p for p in made if p.rsplit("/", 1)[-1] in used]
        return out

    return run


def small_batches(f: Callable[..., DataFrame], rows: int = 1000) -> Callable[..., DataFrame]:
    """An operator whose jobs send at most so many rows at a time between Spark and Python: a batch of whole texts stands
    in the memory of both. What its result still has to do goes by the session's own setting."""

    @wraps(f)
    def run(df: DataFrame, *args: object, **kwargs: object) -> DataFrame:
        conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
        try:
            return f(df, *args, **kwargs)
        finally:
            conf.set(key, before)

    return run


def gives_back(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that hands freed memory back to the system at its end: its worker stays for later tasks."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        with suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def with_group(rows: DataFrame, keys: list[str], folds: dict[str, tuple[Column, Callable[[str], Column]]], spread: Iterable[str], salts: int = SALTS) -> DataFrame:
    """Adds to each row the folds over all rows with equal keys, without a task that gets a whole group.

    folds: name -> (aggregate over rows, aggregate that merges the partial results in the column of that name).
    spread: columns whose hash deals the rows of one group over the salts. Keys must not be null.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(*[first.alias(name) for name, (first, _) in folds.items()])
    whole = parts.groupBy(*keys).agg(*[merge(name).alias(name) for name, (_, merge) in folds.items()], F.collect_list("_salt").alias("_salts"))
    back = whole.select(*keys, *folds, F.explode("_salts").alias("_salt"))
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def row_buckets(n_rows: int, per_bucket: int = 1000) -> int:
    """Buckets for `ranked`: a power of two that keeps each one near per_bucket rows, at least BUCKETS."""
    n = BUCKETS
    while n * per_bucket < n_rows:
        n *= 2
    return n


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str, n_rows: int) -> DataFrame:
    """Adds a gapless rank from 0 within each group, in an order fixed by the hash of `order`, then `order` itself.

    A group is dealt over hash buckets; their row counts give each bucket its offset, so no task sorts a whole
    group. rows must read the same twice (see `staged`), and `order` must tell its rows apart.
    """
    n = row_buckets(n_rows)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(name)), F.lit(n)).cast("int"))
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", F.expr(f"_bucket div {BUCKETS}"))
    before = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_offset", before([*group, "_part"], "_bucket"))
    if n > BUCKETS:  # in two steps, so that no task gets all buckets
        parts = counts.groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))
        parts = parts.withColumn("_start", before(group, "_part")).select(*[F.col(g).alias(f"_h_{g}") for g in group], F.col("_part").alias("_h_part"), "_start")
        same = [F.col(g).eqNullSafe(F.col(f"_h_{g}")) for g in group] + [F.col("_part") == F.col("_h_part")]
        offsets = offsets.join(parts, same).withColumn("_offset", F.col("_offset") + F.col("_start"))
    offsets = offsets.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_g_bucket"), "_offset")
    own = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_bucket") == F.col("_g_bucket")]
    joined = rows.withColumn("_own", own).join(offsets, same)
    return joined.withColumn(name, (F.col("_own") - 1 + F.col("_offset")).cast("long")).drop("_own", "_offset", "_bucket", "_g_bucket", *[f"_g_{g}" for g in group])
