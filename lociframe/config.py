"""Session facts the operators need: the shared folder and the parallelism."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_DIR: list[str] = []

# Most rows and bytes of a table that is broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see, taken from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets one scratch
    folder per process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="lociframe-"))
    return _LOCAL_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so that later reads see the same rows and partitions
    even when executors are lost."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is built and run inside loses its shuffle files as soon as it has run, not when the driver
    happens to collect its garbage. For steps that are pinned: to run them again makes the files anew."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def row_bytes(df: DataFrame) -> Column:
    """At least the bytes a row takes in memory. Nested values count by their text: an item of eight
    bytes has two characters or more with its separator."""
    size = F.lit(64).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = size + 64 + 8 * F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0))
        else:
            size = size + 16
    return size


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows, and bytes, that it may be broadcast."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return size["rows"] <= rows and (size["bytes"] or 0) <= most


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that is not to broadcast it. Spark's estimate scales the bytes of a compressed file by the declared width of the columns and knows nothing of
    exploded rows: millions of rows, a gigabyte at the driver, can pass for less than the broadcast threshold."""
    return df.hint("merge")
