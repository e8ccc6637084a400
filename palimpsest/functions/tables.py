"""Tables that are used twice, written once in the folder all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Paths of the tables cut inside the innermost `scratch`.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Without that setting, a temporary one on this machine if the executors
    are threads of the driver, as in tests; on a cluster that is an error, since each executor would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="palimpsest-"))
    return "file://" + os.path.abspath(_own_dir[0])


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Of rows of megabytes: a page for each, and small row groups. Parquet's writer looks at its sizes only every hundred rows otherwise, and reader and writer hold them all until then.
#: Without statistics, as the writer keeps the least and the greatest value of each row group whole until the file's end.
_LARGE_ROWS = {"parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(4 << 20), "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


def cut(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: later uses don't recompute it, and lost executors don't
    either. The shuffle files of the write go at once, as nothing reads them again. large_rows: a row has megabytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    passing = _passing.get()
    if passing is not None:
        passing.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **(_LARGE_ROWS if large_rows else {})).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: So many rows of a few keys are broadcast.
MOST_BROADCAST = 2_000_000


def small(keys: DataFrame) -> DataFrame:
    """keys, a table of few narrow columns that `cut` has written: broadcast in a join, so that wide rows needn't be shuffled to meet it, unless it has too many rows for that."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches that go to Python have so many rows, in what is computed inside."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `cut` writes inside go at the end, so that a step's disk is its own. What is needed later is written by the function
    that this yields: it stays, or goes with the scratch around this one."""
    around, paths = _passing.get(), []
    token = _passing.set(paths)

    def keep(df: DataFrame) -> DataFrame:
        outside = _passing.set(around)
        try:
            return cut(df)
        finally:
            _passing.reset(outside)

    try:
        yield keep
    finally:
        _passing.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def drop(df: DataFrame) -> None:
    """Removes a table that `cut` has written, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if "/cut-" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: Distinct inputs that are judged by themselves and broadcast: so many rows, and so many bytes of their texts.
MOST_ONCE, MOST_ONCE_BYTES = 200_000, 32 << 20


def once(rows: DataFrame, inputs: list[str], judge: Callable[[DataFrame], DataFrame], made: list[str]) -> DataFrame:
    """judge(rows), for a judge that adds the columns `made` from the string columns `inputs` of the same row only. Where few inputs recur in many rows, each is
    judged once and meets its rows in a broadcast join; else every row is judged. The estimate decides between two ways to the same rows, the count whether the table is small enough."""
    few, n = rows.agg(F.approx_count_distinct(F.xxhash64(*inputs)), F.count(F.lit(1))).first()
    if few > MOST_ONCE or 4 * few > n:
        return judge(rows)
    different = cut(rows.select(*inputs).distinct())
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in inputs), F.lit(0))
    k, total = different.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if k > 2 * MOST_ONCE or total > MOST_ONCE_BYTES:
        return judge(rows)
    judged = cut(judge(different).select(*[F.col(c).alias(f"_{c}") for c in inputs], *made))
    drop(different)
    same = F.lit(True)
    for c in inputs:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(judged), same, "left").drop(*[f"_{c}" for c in inputs])
