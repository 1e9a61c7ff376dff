"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACES = " \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SPACE_REGEX = r"[\x20\x09-\x0D]+"

#: Rows that one bucket of a distributed running sum holds, about.
BUCKET_ROWS = 50_000
#: Rows of identifiers or digests that may be broadcast: some 20 MB.
BROADCAST_ROWS = 250_000
MIN_BUCKETS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only a local master gets one made where nothing set it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = folder or tempfile.mkdtemp(prefix="residua-checkpoints-")
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, evaluated once into a compressed table of the shared folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow, materialized side of a join: for broadcast if it has at most so many rows, else to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole(name: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it several times in body."""
    return F.transform(F.array(value), body)[0]


def bucket_count(rows: int) -> int:
    return max(MIN_BUCKETS, rows // BUCKET_ROWS)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, buckets: int, weight: str | None = None) -> DataFrame:
    """Add `out`: the sum of `weight` (else the number) of the rows before this one within `keys`.

    The order is that of a hash bucket of `order`, then of `order` itself. Sums of buckets are made
    first and are small, so no task holds all rows of a hot key. `df` must give the same rows each
    time it is evaluated. Rows with equal `order` follow each other in an undefined order.
    """
    amount = F.col(weight) if weight else F.lit(1).cast("bigint")
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    per_bucket = rows.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, [*keys, "_bucket"])
    before = F.coalesce(F.sum(amount).over(within), F.lit(0)) + F.col("_start")
    return placed.withColumn(out, before.cast("bigint")).drop("_bucket", "_start")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt over all cores where fewer tasks than cores hold any.

    A file's row group is one task's however the file is split. Where the scan has several tasks a core
    it is left as it is, unseen; else a job over the footers counts the tasks that have rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    busy = df.select(F.spark_partition_id().alias("_task")).distinct().count()
    return df.repartition(cores) if 0 < busy < cores else df


def limit_batches(spark: SparkSession, rows: int = 512) -> None:
    """For the queries and the pipeline, whose texts may be long: Arrow batches of so many rows at most.

    It changes the session's setting, so the operators leave it to their callers; Spark bounds batches
    in bytes too.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def limit_reads(spark: SparkSession) -> None:
    """For the pipeline, whose texts may be long: Parquet files are read row by row.

    The vectorized reader gathers 4,096 rows whatever their size, so texts of 100 KB fill an executor's
    memory before a row is passed on. It changes the session's setting, as `limit_batches` does.
    """
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, which Spark bounds in bytes, so that few texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
