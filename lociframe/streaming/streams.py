"""Structured Streaming over the same row functions the batch readers use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociframe.config import new_path
from lociframe.operators.intervals import assign_interval


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files below ``folder`` as lines."""
    return spark.readStream.text(folder)


def run_available(stream: DataFrame, out: str, name: str = "stream") -> None:
    """Process what is there now into parquet and stop; the checkpoint lies in the shared folder."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_path(stream.sparkSession, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def convert_available(spark: SparkSession, folder: str, convert: Callable[[DataFrame], DataFrame], name: str = "convert") -> DataFrame:
    """Run a stateless conversion over the files below ``folder`` as a stream and read its output."""
    out = new_path(spark, name)
    run_available(convert(text_stream(spark, folder)), out, name)
    return spark.read.parquet(out)


def assign_available(points: DataFrame, intervals: DataFrame, out: str, **options) -> None:
    """Interval lookup for a stream of points against a static interval table.

    An interval table too big to broadcast makes the lookup shuffle and aggregate per point, so each
    micro-batch is a batch job of its own, written under its epoch: a replayed batch overwrites itself.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        assign_interval(batch, intervals, **options).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        points.writeStream.foreachBatch(write)
        .option("checkpointLocation", new_path(points.sparkSession, "assign-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
