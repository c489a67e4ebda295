"""Enrichment tables, permutation runs, LD reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names by position.
ENRICHMENT_COLUMNS = {
    "gene": ["gene_set_ID", "gene_set_description", "p_value", "FDR_lt_0.05"],
    "tissue": ["MeSH_term", "MeSH_first_level_term", "MeSH_second_level_term", "p_value", "FDR_lt_0.05"],
}


def read_enrichment(spark: SparkSession, path: str | list[str], kind: str, **literals) -> DataFrame:
    """Gene-set or tissue enrichment table; the file's header is replaced, constants are added."""
    names = ENRICHMENT_COLUMNS[kind]
    schema = ", ".join(f"`{n}` {'double' if n == 'p_value' else 'string'}" for n in names)
    df = spark.read.schema(schema).option("enforceSchema", True).csv(path, sep="\t", header=True)
    return df.withColumns({k: F.lit(v) for k, v in literals.items()}) if literals else df


def read_perm_runs(spark: SparkSession, folder: str, prefix: str, kind: str = "gene") -> DataFrame:
    """Tables of every permutation run below ``folder``, one scan; perm and sample come from the path
    ``<prefix>_perm_<n>_<sample>``. Runs without a table simply add no rows."""
    path = F.col("_metadata.file_path")
    pattern = rf"{prefix}_perm_(\d+)_([^/]+?)(_genesetenrichment|_tissueenrichment)?(\.txt)?/"
    df = read_enrichment(spark, f"{folder}/*{prefix}_perm_*", kind)
    return df.withColumns(
        {"perm": F.regexp_extract(path, pattern, 1).cast("int"), "sample": F.regexp_extract(path, pattern, 2)}
    )


def _after_colon(line: Column) -> Column:
    return F.trim(F.split_part(line, F.lit(":"), F.lit(2)))


def parse_ld_report(df: DataFrame, text: str = "value") -> DataFrame:
    """LD-pair reports, one text per row -> snps, positions, populations, 2x2 table, measures, lookup.

    Numbers that are not numbers become NaN; a p of ``<0.0001`` counts as 0.
    """
    lines = F.split(text, "\n")

    def line(i: int) -> Column:
        return F.trim(F.get(lines, F.lit(i)))

    def number(c: Column) -> Column:
        return F.coalesce(c.try_cast("double"), F.lit(float("nan")))

    snp_line = r"^(\S+) \(?([^:()]+):(\d+)\)?$"
    heads = F.split(line(6), r"\s+")

    def row(i: int) -> Column:
        return F.split(F.regexp_replace(line(i), r"[\s|()]+", " "), " ")

    r1, r2 = row(8), row(10)
    p = _after_colon(line(23))
    linked = r"^(rs[0-9]+)\(([ATGC])\) allele is correlated with (rs[0-9]+)\(([ATGC])\) allele$"
    in_ld = ~line(25).endswith("are in linkage equilibrium")

    def alleles(i: int, g: int) -> Column:
        return F.upper(F.regexp_extract(line(i), linked, g))

    def lookup(a: int, b: int) -> Column:
        return F.when(
            in_ld, F.create_map(alleles(25, a), alleles(25, b), alleles(26, a), alleles(26, b))
        ).otherwise(F.create_map().cast("map<string,string>"))

    return df.select(
        F.regexp_extract(line(1), snp_line, 1).alias("snp1"),
        F.regexp_extract(line(2), snp_line, 1).alias("snp2"),
        F.regexp_extract(line(1), snp_line, 2).alias("chrom"),
        F.regexp_extract(line(1), snp_line, 3).try_cast("long").alias("loc1"),
        F.regexp_extract(line(2), snp_line, 3).try_cast("long").alias("loc2"),
        F.split(F.split_part(line(4), F.lit(" "), F.lit(1)), r"\+").alias("populations"),
        F.array(F.get(r1, F.lit(0)), F.get(r2, F.lit(0))).alias("alleles1"),
        F.slice(heads, 1, 2).alias("alleles2"),
        F.array(
            *[F.get(r, F.lit(i)).try_cast("long") for r in (r1, r2) for i in (1, 2)]
        ).alias("table"),
        number(_after_colon(line(20))).alias("dprime"),
        number(_after_colon(line(21))).alias("r2"),
        number(_after_colon(line(22))).alias("chisq"),
        F.when(p == "<0.0001", 0.0).otherwise(number(p)).alias("p"),
        p.alias("p_text"),
        in_ld.alias("in_ld"),
        lookup(2, 4).alias("lookup1"),
        lookup(4, 2).alias("lookup2"),
    )
