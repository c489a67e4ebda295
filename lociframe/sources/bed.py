"""BED, gene and location readers. ``parse_*`` take a DataFrame of lines and also run on a stream;
rows that do not parse keep their line in ``_corrupt`` instead of failing the job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.chroms import add_chr
from lociframe.sources.text import data_lines, field, fields, read_lines


def _ints(c: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(c, ",$", ""), ","), lambda x: x.try_cast("long"))


def paired(sizes: Column, starts: Column) -> Column:
    """True for lists of equal length in which all are numbers."""
    return (F.size(_ints(sizes)) == F.size(_ints(starts))) & ~F.exists(F.concat(_ints(sizes), _ints(starts)), lambda x: x.isNull())


def exon_blocks(start: Column, sizes: Column, starts: Column) -> Column:
    """Absolute blocks from comma-separated sizes and starts relative to ``start``."""
    return F.transform(
        F.arrays_zip(_ints(starts).alias("starts"), _ints(sizes).alias("sizes")),
        lambda b: F.struct(
            (start + b["starts"]).alias("start"), (start + b["starts"] + b["sizes"]).alias("end")
        ),
    )


def parse_bed(lines: DataFrame, snp: bool = False, base: int = 0) -> DataFrame:
    """BED of 3 to 12 columns, positions 0-based half-open; ``base`` is taken off both of them.

    ``snp``: column 4 is ``ref|alt`` (phased) or ``ref/alt``.
    """
    f = fields()
    start, end = field(f, 1, "long") - base, field(f, 2, "long") - base
    blocks = F.when((F.size(f) > 11) & paired(field(f, 10), field(f, 11)), exon_blocks(start, field(f, 10), field(f, 11)))
    alleles = F.split(field(f, 3), "[|/]")
    count = field(f, 9, "int")
    ok = start.isNotNull() & end.isNotNull() & (F.coalesce(count, F.lit(0)).eqNullSafe(F.coalesce(F.size(blocks), F.lit(0))) | (F.size(f) <= 11))
    if snp:
        ok = ok & (F.size(alleles) == 2)
    return data_lines(lines).select(
        field(f, 0).alias("chrom"),
        start.alias("start"),
        end.alias("end"),
        (F.lit("SNP") if snp else field(f, 3)).alias("name"),
        field(f, 4).alias("score"),
        field(f, 5).alias("strand"),
        field(f, 6, "long").alias("t_start"),
        field(f, 7, "long").alias("t_end"),
        field(f, 8).alias("rgb"),
        blocks.alias("exons"),
        *(
            [
                F.get(alleles, F.lit(0)).alias("ref"),
                F.get(alleles, F.lit(1)).alias("alt"),
                field(f, 3).contains("|").alias("phased"),
            ]
            if snp
            else []
        ),
        F.when(~F.coalesce(ok, F.lit(False)), F.col("value")).alias("_corrupt"),
    )


def read_bed(spark: SparkSession, path: str, snp: bool = False, base: int = 0) -> DataFrame:
    return parse_bed(read_lines(spark, path), snp, base)


def parse_gene_bed(lines: DataFrame) -> DataFrame:
    """BED12 genes, one row per block: chrom, start, end, gene, strand, exon (from 0).

    Rows without valid blocks have none; ``parse_bed`` shows them in ``_corrupt``.
    """
    genes = parse_bed(lines).where(F.col("_corrupt").isNull() & F.col("exons").isNotNull())
    return genes.select(
        add_chr("chrom").alias("chrom"), F.col("name").alias("gene"), "strand", F.posexplode("exons").alias("exon", "_b")
    ).select("chrom", F.col("_b.start").alias("start"), F.col("_b.end").alias("end"), "gene", "strand", "exon")


def read_gene_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_gene_bed(read_lines(spark, path))


def parse_gtf(lines: DataFrame, feature: str | None = "exon") -> DataFrame:
    """GTF rows of one feature as 0-based half-open intervals with gene and transcript ids.

    Lines without nine columns or with other than numbers as start and end keep their line in ``_corrupt``
    and stay whatever ``feature`` is asked for.
    """
    f = fields()
    attrs = field(f, 8)
    ok = field(f, 3, "long").isNotNull() & field(f, 4, "long").isNotNull() & (F.size(f) >= 9)
    rows = data_lines(lines).select(
        add_chr(field(f, 0)).alias("chrom"),
        field(f, 1).alias("source"),
        field(f, 2).alias("feature"),
        (field(f, 3, "long") - 1).alias("start"),
        field(f, 4, "long").alias("end"),
        field(f, 6).alias("strand"),
        F.regexp_extract(attrs, 'gene_id "([^"]+)"', 1).alias("gene"),
        F.regexp_extract(attrs, 'transcript_id "([^"]+)"', 1).alias("transcript"),
        F.when(~ok, F.col("value")).alias("_corrupt"),
    )
    return rows.where((F.col("feature") == feature) | F.col("_corrupt").isNotNull()) if feature else rows


def read_gtf(spark: SparkSession, path: str, feature: str | None = "exon") -> DataFrame:
    return parse_gtf(read_lines(spark, path), feature)


def base_of(path: str) -> int:
    """1 for VCF files, 0 for BED and TSV, by name."""
    return 1 if re.search(r"\.vcf(\.gz|\.bz2)?/?$", path) else 0


def parse_locations(lines: DataFrame, base: int = 0) -> DataFrame:
    """(chrom, 0-based pos); lines without a position keep their line in ``_corrupt``."""
    f = fields()
    pos = field(f, 1, "long")
    return data_lines(lines).select(
        field(f, 0).alias("chrom"), (pos - base).alias("pos"), F.when(pos.isNull(), F.col("value")).alias("_corrupt")
    )


def read_locations(spark: SparkSession, path: str, base: int | None = None) -> DataFrame:
    """(chrom, 0-based pos) of a TSV, BED or VCF; ``base`` overrules the file name."""
    return parse_locations(read_lines(spark, path), base_of(path) if base is None else base)
