"""Plain, gzip and bzip2 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.plans import ranged


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines as ``value``; the codec goes by the file name. A gzip file is one task: spread the rows
    with ``repartition`` before heavy work, or convert to parquet once."""
    return spark.read.text(paths)


def count_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_lines(spark, paths).agg(F.count(F.lit(1)).alias("lines"))


def data_lines(lines: DataFrame) -> DataFrame:
    """Without comments and blank lines."""
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))


def fields(value: str = "value", sep: str = "\t") -> Column:
    return F.split(F.regexp_replace(value, r"\s+$", ""), sep)


def field(f: Column, i: int, cast: str | None = None) -> Column:
    """Field i, NULL when the line is too short or the cast fails."""
    v = F.get(f, F.lit(i))
    return v.try_cast(cast) if cast else v


def lines_in_order(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their file and a key (file, block, line) that sorts them as they stand in the file."""
    return spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their number in their file, from 0: columns file, row, value."""
    rows = ranged.row_index(ranged.range_sorted(lines_in_order(spark, paths), "file", "block", "line"), "_row")
    rows = ranged.carried(ranged.group_edges(rows, ["file"]), F.when(F.col("_starts"), F.col("_row")), "_first")
    return rows.select("file", (F.col("_row") - F.col("_first")).alias("row"), "value")


def file_type(path: Column | str) -> Column:
    """Extension of a file name, not counting .gz and .bz2."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(F.regexp_replace(c, r"\.(gz|bz2)$", ""), r"([^.]*)$", 1)
