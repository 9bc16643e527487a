"""Streams of a solving service: job queue, solved flags, depth batches, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def job_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """Job records that appear as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def solved_state(results: DataFrame, key: str = "field", solved: str = "solved", retry_limit: int = 3) -> DataFrame:
    """Keyed state of each field: solved once is solved for good; (field, solved, tries) after each batch of results.

    Tries stop counting at ``retry_limit``; the state per key is one flag and one number, kept by Spark's own aggregation, rows of a batch
    are added up before they are shuffled. A null flag is no success.
    """

    flag, tries = F.coalesce(F.bool_or(solved), F.lit(False)), F.least(F.lit(retry_limit).cast("long"), F.count(F.lit(1)))
    return results.groupBy(F.col(key).alias("field")).agg(flag.alias("solved"), tries.cast("int").alias("tries"))


def depth_batches(fields: DataFrame, depths: list[tuple[int, int]], solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Anytime solving: each depth range (1-based, both ends in) of the fields not solved by earlier ones.

    ``fields`` has field and rank from 0; ``solve`` returns rows with field. The loop is over a few depth
    ranges, the fields stay in Spark.
    """
    out = None
    for _, last in depths:
        todo = fields.where(F.col("rank") < last)
        if out is not None:
            todo = todo.join(out.select("field"), "field", "left_anti")
        found = solve(todo).withColumn("depth", F.lit(last))
        out = found if out is None else out.unionByName(found)
    return out


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Counts and sums by event-time window with a watermark; works on batch and streaming tables."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return e.groupBy(F.window("__ts", window), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def enqueue_unstarted(submissions: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``write`` on every micro-batch of new submissions, once each; returns the streaming query."""
    return submissions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
