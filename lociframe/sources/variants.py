"""VCF, SNP lists, sample panels, base counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.chroms import add_chr, norm_chrom
from lociframe.sources.bed import parse_bed
from lociframe.sources.text import data_lines, field, fields, lines_in_order, read_lines

# The first columns of a VCF header.
VCF_COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def parse_vcf(lines: DataFrame, base: int = 1) -> DataFrame:
    """VCF sites, pos 0-based, and the genotype cells of all samples as the array ``gts``."""
    f = fields()
    return data_lines(lines).select(
        field(f, 0).alias("chrom"),
        (field(f, 1, "long") - base).alias("pos"),
        *[field(f, i + 2).alias(c) for i, c in enumerate(["id", "ref", "alt", "qual", "filter", "info", "format"])],
        F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("gts"),
        F.when(field(f, 1, "long").isNull() | (F.size(f) < 5), F.col("value")).alias("_corrupt"),
    )


def read_vcf(spark: SparkSession, path: str | list[str], base: int = 1) -> DataFrame:
    return parse_vcf(read_lines(spark, path), base)


# Lines at the start of a file that are looked at before the rest of it.
LEADING = 1000


def leading_lines(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The first lines of the first file that has any, by name and in the order of the paths given."""
    for one in [path] if isinstance(path, str) else path:
        for file in sorted(read_lines(spark, one).inputFiles()):
            found = read_lines(spark, file).head(LEADING)
            if found:
                return [r["value"] for r in found]
    return []


def vcf_version(spark: SparkSession, path: str | list[str]) -> str | None:
    """Version in the ``##fileformat=`` line, such as VCFv4.1, or None if the first line is another."""
    first = leading_lines(spark, path)[:1]
    return first[0].strip().split("=", 1)[1] if first and first[0].startswith("##fileformat=") else None


def read_versioned_vcf(spark: SparkSession, path: str | list[str], version: str = "VCFv4.1", base: int = 1) -> DataFrame:
    """``read_vcf`` of files of one version; a file of another version is an error."""
    found = vcf_version(spark, path)
    if found != version:
        raise ValueError(f"{path} is {found or 'without a version'}, not {version}")
    return read_vcf(spark, path, base)


def vcf_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(idx, sample) from the header row, idx from 0; fails on a header that is not VCF's."""
    head = read_lines(spark, path).where(F.col("value").startswith("#CHROM")).limit(1).select(fields().alias("h"))
    fits = F.slice("h", 1, 7) == F.array(*[F.lit(c) for c in VCF_COLUMNS[:7]])
    checked = head.select(F.when(fits, F.slice("h", 10, F.size("h"))).otherwise(F.raise_error(F.lit("not a VCF header"))).alias("s"))
    return checked.select(F.posexplode("s").alias("idx", "sample"))


def parse_alleleseq(lines: DataFrame) -> DataFrame:
    """Seven-column phased SNPs: chrom, pos (0-based), mat, pat = the two letters of the child genotype."""
    f = fields()
    child = field(f, 5)
    ok = field(f, 1, "long").isNotNull() & (F.length(child) == 2)
    return data_lines(lines).select(
        add_chr(field(f, 0)).alias("chrom"),
        (field(f, 1, "long") - 1).alias("pos"),
        F.substring(child, 1, 1).alias("mat"),
        F.substring(child, 2, 1).alias("pat"),
        field(f, 6).alias("phase"),
        F.when(~F.coalesce(ok, F.lit(False)), F.col("value")).alias("_corrupt"),
    )


def read_alleleseq(spark: SparkSession, path: str) -> DataFrame:
    return parse_alleleseq(read_lines(spark, path))


def sniff_snp_format(spark: SparkSession, path: str) -> str:
    """bed, vcf or alleleseq, by the header or the first data line.

    Header and first data line are looked for at the start of the file; the rest is read only where the
    start holds nothing but comments.
    """
    lead = leading_lines(spark, path)
    if any(x.startswith(("##fileformat=VCF", "#CHROM\tPOS\tID")) for x in lead):
        return "vcf"
    data = [x for x in lead if x.strip() and not x.startswith("#")]
    if not data:
        if read_lines(spark, path).where(F.col("value").rlike("^(##fileformat=VCF|#CHROM\tPOS\tID)")).head(1):
            return "vcf"
        data = [r["value"] for r in data_lines(read_lines(spark, path)).head(1)]
    f = data[0].rstrip().split("\t") if data else []
    if len(f) >= 5 and f[2].isdigit():
        if "|" not in f[4]:
            raise ValueError("a BED of SNPs needs ref|alt in column 5")
        return "bed"
    if len(f) >= 6 and len(f[3]) == 2:
        return "alleleseq"
    if len(f) >= 5 and len(f[3]) == 1:
        return "vcf"
    raise ValueError(f"{path} is not a BED, VCF or seven-column SNP file")


def parse_snps(lines: DataFrame, kind: str) -> DataFrame:
    """Any SNP format as (chrom, pos1, name, ref, alt), 1-based; a missing name becomes chrom:pos.

    Lines without position or alleles keep their line in ``_corrupt``.
    """
    f = fields()
    alleles = F.split(field(f, 4), r"\|")
    child = field(f, 5)
    shapes = {
        "bed": (field(f, 1, "long") + 1, field(f, 3), F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))),
        "vcf": (field(f, 1, "long"), field(f, 2), field(f, 3), field(f, 4)),
        "alleleseq": (field(f, 1, "long"), F.lit(None).cast("string"), F.substring(child, 1, 1), F.substring(child, 2, 1)),
    }
    pos1, name, ref, alt = shapes[kind]
    chrom = add_chr(field(f, 0))
    named = F.when(name.isNull() | name.isin("", ".", "NA"), F.concat_ws(":", chrom, pos1.cast("string"))).otherwise(name)
    return data_lines(lines).select(
        chrom.alias("chrom"),
        pos1.alias("pos1"),
        named.alias("name"),
        ref.alias("ref"),
        alt.alias("alt"),
        F.when(pos1.isNull() | ref.isNull() | alt.isNull() | (ref == "") | (alt == ""), F.col("value")).alias("_corrupt"),
    )


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    return parse_snps(read_lines(spark, path), sniff_snp_format(spark, path))


def read_bed_snps(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    return parse_bed(read_lines(spark, path), snp=True, base=base)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Sample panel: sample, population, region, platforms; the first line of a sample counts."""
    f = fields()
    rows = lines_in_order(spark, path).where(F.trim("value") != "").select(
        field(f, 0).alias("sample"),
        F.struct(
            field(f, 1).alias("population"),
            field(f, 2).alias("region"),
            F.transform(F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0))), lambda p: F.regexp_replace(p, ",", "")).alias("platforms"),
        ).alias("info"),
        F.struct("file", "block", "line").alias("at"),
    )
    return rows.groupBy("sample").agg(F.min_by("info", "at").alias("info")).select("sample", "info.*")


# Columns of a called SNP table.
CALL_COLUMNS = [
    "chrm", "pos", "ref", "mat_gtyp", "pat_gtyp", "c_gtyp", "phase", "mat_all", "pat_all", "cA", "cC", "cG", "cT",
    "win", "cls", "pval", "binding_site", "cnv",
]


def parse_calls(lines: DataFrame, style: str = "chr") -> DataFrame:
    """Called SNPs (18 columns, header ``chrm``): chrom, pos (0-based), mat, pat and other counts, win, cls, pval.

    Lines without position or base counts keep their line in ``_corrupt``.
    """
    f = fields()
    at = {name: i for i, name in enumerate(CALL_COLUMNS)}

    def of(allele: str) -> Column:
        letter = field(f, at[allele])
        return F.element_at(F.create_map(*[x for b in "ACGT" for x in (F.lit(b), field(f, at[f"c{b}"], "long"))]), letter)

    rows = data_lines(lines).where(~F.col("value").startswith("chrm"))
    total = field(f, at["cA"], "long") + field(f, at["cC"], "long") + field(f, at["cG"], "long") + field(f, at["cT"], "long")
    return rows.select(
        norm_chrom(field(f, at["chrm"]), style).alias("chrom"),
        (field(f, at["pos"], "long") - 1).alias("pos"),
        of("mat_all").alias("mat_counts"),
        of("pat_all").alias("pat_counts"),
        (total - of("mat_all") - of("pat_all")).alias("other_counts"),
        field(f, at["win"]).alias("win"),
        field(f, at["cls"]).alias("cls"),
        field(f, at["pval"], "double").alias("pval"),
        F.when(field(f, at["pos"], "long").isNull() | total.isNull(), F.col("value")).alias("_corrupt"),
    )


def explode_counts(df: DataFrame, column: str = "counts", *keep: str) -> DataFrame:
    """map<chrom, map<pos, map<base, n>>> -> rows (.., chrom, pos, base, n)."""
    per_chrom = df.select(*keep, F.explode(column).alias("chrom", "_p"))
    per_pos = per_chrom.select(*keep, "chrom", F.explode("_p").alias("pos", "_b"))
    return per_pos.select(*keep, "chrom", "pos", F.explode("_b").alias("base", "n"))
