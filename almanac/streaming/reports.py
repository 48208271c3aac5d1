"""Reports that are taken up as their files arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dml import put_partition
from ..sources.folders import TEXT_FILES
from ..sources.textreport import LineRule, parse_lines

BATCH = "batch"


def follow_reports(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    header: Sequence[tuple[str, bool]],
    rules: Sequence[LineRule],
    trigger: str | int,
    file_rule: str = TEXT_FILES,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Parse the report files below ``path``, in dated folders or not, and put their rows into ``table``; stops when all files present are read.

    Started again it goes on with the files that have come since; ``checkpoint`` remembers which were read, so give each
    table one of its own. Every file is read whole, in one batch, so held values stay within it. ``table`` has a
    partition for each batch, which is the ledger of what is done: a batch that is repeated after a failure replaces its own rows, so each file's
    rows are there once.
    """
    source = spark.readStream.format("text").option("recursiveFileLookup", True)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    lines = source.load(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("text"),
    )

    def put(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("line", F.monotonically_increasing_id()).where(F.col("name").rlike(file_rule))
        rows = parse_lines(placed, header, rules, trigger).withColumn(BATCH, F.lit(number).cast("long"))
        put_partition(rows, table, {BATCH: number})

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """Make a stopped stream take its last batch for unfinished, so that the next start repeats it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = [int(s.getPath().getName()) for s in system.listStatus(folder) if s.getPath().getName().isdigit()]
    if numbers:
        system.delete(jvm.org.apache.hadoop.fs.Path(folder, str(max(numbers))), False)
