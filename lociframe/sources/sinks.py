"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.plans import ranged
from lociframe.sources.splits import with_header


def tsv_row(df: DataFrame, float_format: str | None = None) -> DataFrame:
    """All columns as text, doubles by ``float_format`` (such as ``%.3e``)."""
    def text(name: str, kind: str) -> Column:
        if float_format and kind in ("double", "float"):
            return F.when(F.col(name).isNotNull(), F.format_string(float_format, F.col(name)))
        return F.col(name).cast("string")

    return df.select(*[text(n, t).alias(n) for n, t in df.dtypes])


def write_tsv(df: DataFrame, path: str, float_format: str | None = None, header: bool = True, compression: str = "none") -> None:
    tsv_row(df, float_format).write.csv(path, sep="\t", header=header, compression=compression, quote="", emptyValue="", nullValue="")


def fastq_text(df: DataFrame) -> DataFrame:
    """id, seq, qual -> four-line records."""
    return df.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def write_fastq(df: DataFrame, path: str, compression: str = "none") -> None:
    fastq_text(df).write.text(path, compression=compression)


def write_vcf(df: DataFrame, samples: list[str], path: str, version: str = "VCFv4.1", compression: str = "none") -> None:
    """chrom, pos (0-based), id, ref, alt, qual, filter, info, format, gts -> VCF text. Every part is a whole VCF with its header,
    written by Spark's text writer, so that any file system will do and a lost task leaves nothing behind."""
    from lociframe.sources.variants import VCF_COLUMNS

    fixed = [F.col("chrom"), (F.col("pos") + 1).cast("string")] + [
        F.coalesce(F.col(c), F.lit(".")) for c in ("id", "ref", "alt", "qual", "filter", "info", "format")
    ]
    body = df.select(F.concat_ws("\t", *fixed, F.concat_ws("\t", "gts")).alias("value"))
    with_header(body, [f"##fileformat={version}", "\t".join(VCF_COLUMNS + samples)]).write.text(path, compression=compression)


def write_by_chrom(df: DataFrame, path: str, pos: str = "start") -> None:
    """One folder per chromosome. Rows are range-partitioned by (chrom, position, the rest), so a
    chromosome or position that holds most of the rows is written by many tasks."""
    rest = [c for c, t in df.dtypes if c not in ("chrom", pos) and not t.startswith(("map", "array", "struct"))]
    df.repartitionByRange("chrom", pos, *rest).sortWithinPartitions("chrom", pos).write.partitionBy("chrom").parquet(path)


def write_chrom_store(bed: DataFrame, path: str) -> bool:
    """Lay BED rows out for range lookups by chromosome and start; rows without a name are left out.

    An existing store is kept; returns whether one was written.
    """
    spark = bed.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return False
    write_by_chrom(bed.where(F.col("name").isNotNull()).select("chrom", "name", "start", "end"), path)
    return True


def split_parts(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Adds ``part`` (from 1): n near-equal runs of rows in ``order``, rows/n + 1 to a part."""
    rows = ranged.row_index(ranged.range_sorted(df, *order), "_row")
    total = rows.select(F.count(F.lit(1))).scalar()
    size = F.call_function("div", total, F.lit(n).cast("long")) + 1
    return ranged.unsorted(rows.withColumn("part", F.call_function("div", F.col("_row"), size) + 1).drop("_row"))


def write_parts(df: DataFrame, path: str, n: int, *order: str, compression: str = "none") -> None:
    """Write ``split_parts`` as TSV, one file with the header for each part, in the folders ``part=1`` to ``part=n``.

    A part is one file and so one task: choose ``n`` so that a file fits a task's disk.
    """
    rows = split_parts(df, n, *order).repartition(n, "part").sortWithinPartitions("part", *order)
    rows.write.partitionBy("part").csv(path, sep="\t", header=True, compression=compression, quote="", emptyValue="", nullValue="")
