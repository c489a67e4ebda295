"""Format conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.plans import ranged
from lociframe.plans.lookups import lookup


def bed12_to_gtf(bed: DataFrame, source: str = "unknown", one_based: bool = False) -> DataFrame:
    """One GTF exon row per block, exon_number from 0. Starts stay as in BED unless ``one_based``."""
    exon = bed.where(F.col("exons").isNotNull()).select("chrom", "name", "strand", F.posexplode("exons").alias("n", "b"))
    return exon.select(
        "chrom",
        F.lit(source).alias("source"),
        F.lit("exon").alias("feature"),
        (F.col("b.start") + (1 if one_based else 0)).alias("start"),
        F.col("b.end").alias("end"),
        F.lit(".").alias("score"),
        "strand",
        F.lit(".").alias("frame"),
        F.format_string('gene_id "%s"; transcript_id "%s"; exon_number "%d"', "name", "name", "n").alias("attributes"),
    )


# Header of the two-sample hybrid VCF and the genotypes of its samples.
HYBRID_HEADER = [
    "##fileformat=VCFv4.0",
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tBxC\tCxB",
]
BXC, CXB = "1|0", "0|1"


def bed_to_vcf(bed: DataFrame) -> DataFrame:
    """SNP BED (ref, alt) -> VCF rows with the two hybrid samples; POS is the BED end."""
    dot = F.lit(".")
    return bed.select(
        "chrom", F.col("end").alias("pos1"), dot.alias("id"), "ref", "alt", dot.alias("qual"), dot.alias("filter"),
        dot.alias("info"), F.lit("GT").alias("format"), F.lit(BXC).alias("BxC"), F.lit(CXB).alias("CxB"),
    )


def vcf_to_alleleseq(vcf: DataFrame) -> DataFrame:
    """VCF sites -> chrom, pos1, ref, maternal (alt alt), paternal (ref ref), child (alt ref), PHASED."""
    return vcf.select(
        "chrom", (F.col("pos") + 1).alias("pos1"), "ref", F.concat("alt", "alt").alias("mat_gt"),
        F.concat("ref", "ref").alias("pat_gt"), F.concat("alt", "ref").alias("child_gt"), F.lit("PHASED").alias("phase"),
    )


def bed_to_cov(bed: DataFrame) -> DataFrame:
    return bed.select(F.col("chrom").alias("chrm"), F.col("start").alias("snppos"), F.col("score").alias("rd"))


# Titles of the export columns.
BIOMART_COLUMNS = ("Chromosome name", "Chromosome position start (bp)", "Chromosome position end (bp)", "Variation Name")


def biomart_to_bed(df: DataFrame, columns: Sequence[str] = BIOMART_COLUMNS) -> DataFrame:
    """Pick columns by title; ``NA`` in the list means there is none. Output: chrom, start, end[, name]."""
    picked = [(n, t) for n, t in zip(("chrom", "start", "end", "name"), columns) if t != "NA"]
    return df.select(*[F.col(f"`{t}`").alias(n) for n, t in picked])


def dosage(cell: Column) -> Column:
    """Alternate alleles of a phased genotype cell; NULL for anything else."""
    gt = F.split_part(cell, F.lit(":"), F.lit(1))
    return F.when(gt == "0|0", 0).when(gt.isin("0|1", "1|0"), 1).when(gt == "1|1", 2)


def vcf_simplify(vcf: DataFrame, on_error: str = "raise") -> DataFrame:
    """Replace genotype cells by dosages. An unknown genotype fails the job, or with
    ``on_error="quarantine"`` leaves a NULL dosage and sets ``_bad``."""
    if on_error == "raise":
        cell = lambda x: F.coalesce(
            dosage(x), F.raise_error(F.concat(F.lit("unknown genotype: "), F.coalesce(x, F.lit("missing")))).cast("int")
        )
        return vcf.withColumn("dosages", F.transform("gts", cell)).drop("gts", "info", "format")
    if on_error != "quarantine":
        raise ValueError("on_error must be raise or quarantine")
    out = vcf.withColumn("dosages", F.transform("gts", dosage)).drop("gts", "info", "format")
    return out.withColumn("_bad", F.exists("dosages", lambda d: d.isNull()))


def vcf_filter(vcf: DataFrame, samples: DataFrame, panel: DataFrame, populations: Sequence[str], cells: str = "gts") -> DataFrame:
    """Keep the cells of samples from the given populations; works on raw and simplified tables.

    ``samples`` is (idx, sample) of the header. The kept indices, one per sample of the file, come in
    as a scalar subquery, so the variants are never shuffled or joined.
    """
    kept = samples.join(panel.where(F.col("population").isin(list(populations))), "sample", "left_semi")
    idx = kept.agg(F.array_sort(F.collect_list("idx")).alias("i")).scalar()
    return vcf.withColumn("_keep", idx).withColumn(cells, F.transform("_keep", lambda i: F.get(F.col(cells), i))).drop("_keep")


#: Most SNPs that get a column each.
WIDE = 1000
BLOCK = 4096


def genotype_matrix(long: DataFrame, snps: Sequence[str], value: str = "dosage") -> DataFrame:
    """One row per sample, one column for each of a few listed SNPs. Larger sets go into ``genotype_blocks``."""
    if len(snps) > WIDE:
        raise ValueError(f"{len(snps)} columns are too many; use genotype_blocks")
    return long.groupBy("sample").pivot("snp", list(snps)).agg(F.max(value))


def genotype_blocks(long: DataFrame, size: int = BLOCK, value: str = "dosage") -> tuple[DataFrame, DataFrame]:
    """The genotype matrix in blocks of SNPs, for any number of them: (sample, block, values) and the index (snp, block, at).

    ``long``: sample, snp, value. SNPs are numbered by name; ``values`` of a block holds one entry for each of its ``size`` SNPs (the last block has what is left), null
    where the sample has none. Of repeated cells the greatest stays. Blocks without any cell of a sample are left out.
    """
    named = long.where(F.col("snp").isNotNull())
    numbered = ranged.unsorted(ranged.row_index(ranged.range_sorted(named.select("snp").distinct(), "snp"), "_row"))
    index = numbered.select("snp", F.expr(f"_row div {size}").alias("block"), F.expr(f"cast(_row % {size} as int)").alias("at"))
    total = index.select(F.count(F.lit(1))).scalar()
    cells = lookup(named.select("sample", "snp", F.col(value).alias("v")), index, ["snp"]).groupBy("sample", "block", "at").agg(F.max("v").alias("v"))
    # At most ``size`` cells.
    rows = cells.groupBy("sample", "block").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("c")).withColumn("n", F.least(F.lit(size), total - F.col("block") * size).cast("int"))
    # Each cell with the gap before it, and the gap after the last one, put together in one go.
    before = lambda i: F.when(i > 0, F.get("c", i - 1)["at"]).otherwise(F.lit(-1))
    empty = F.lit(None).cast(cells.schema["v"].dataType)
    placed = F.transform("c", lambda x, i: F.concat(F.array_repeat(empty, x["at"] - before(i) - 1), F.array(x["v"])))
    rest = F.array(F.array_repeat(empty, F.col("n") - 1 - F.element_at("c", -1)["at"]))
    return rows.select("sample", "block", F.flatten(F.concat(placed, rest)).alias("values")), index


def number_records(df: DataFrame, *order: str) -> DataFrame:
    """Put the running number (from 0) in ``order`` in front of each id."""
    rows = ranged.row_index(ranged.range_sorted(df, *order), "number")
    return ranged.unsorted(rows.withColumn("id", F.concat_ws(":", F.col("number").cast("string"), "id")))


def flip_parents(df: DataFrame) -> DataFrame:
    return df.withColumns({"mat": F.col("pat"), "pat": F.col("mat")})
