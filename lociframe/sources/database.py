"""SNP lookups in a remote table over JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the SNP table.
SNP_COLUMNS = ("name", "chrom", "chromStart", "chromEnd")


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def snp_lookup(snps: DataFrame, chrom: str, positions: Sequence[int] | DataFrame) -> DataFrame:
    """SNPs of one chromosome that start at the given positions.

    A sequence becomes an IN list that the JDBC source pushes to the server with the chromosome; a
    DataFrame with a ``pos`` column is matched by a semi join, for lists too long for that.
    """
    of_chrom = snps.where(F.col("chrom") == chrom)
    if isinstance(positions, DataFrame):
        wanted = positions.select(F.col("pos").alias("chromStart")).distinct()
        return of_chrom.join(wanted, "chromStart", "left_semi").select(*SNP_COLUMNS)
    return of_chrom.where(F.col("chromStart").isin(list(positions))).select(*SNP_COLUMNS)


def list_tables(spark: SparkSession, url: str, prefix: str, schema_view: str = "INFORMATION_SCHEMA.COLUMNS", **options: str) -> DataFrame:
    """Tables whose name starts with ``prefix`` and their columns, from the server's column catalog."""
    rows = jdbc_table(spark, url, schema_view, **options)
    return rows.where(F.col("TABLE_NAME").startswith(prefix)).select(
        F.col("TABLE_NAME").alias("table"), F.col("COLUMN_NAME").alias("column"), F.col("DATA_TYPE").alias("type")
    )
