"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The HLA region left out of association tests.
HLA = ("6", 28477797, 33448354)


def drop_n(reads: DataFrame, seq: str = "seq") -> DataFrame:
    return reads.where(~F.contains(seq, F.lit("N")))


def pair_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates joined on the id before ``/``; columns of each side as structs m1 and m2."""
    key = F.split_part("id", F.lit("/"), F.lit(1))
    return first.select(key.alias("pair"), F.struct("*").alias("m1")).join(
        second.select(key.alias("pair"), F.struct("*").alias("m2")), "pair"
    )


def unpaired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads of either side without a mate, with the side they are on."""
    key = F.split_part("id", F.lit("/"), F.lit(1))
    sides = first.select(key.alias("pair"), "id", F.lit(1).alias("side")).unionByName(
        second.select(key.alias("pair"), "id", F.lit(2).alias("side"))
    )
    lone = sides.groupBy("pair").agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.min("id").alias("id"))
    return lone.where("lo = hi").select("pair", "id", F.col("lo").alias("side"))


def drop_n_paired(first: DataFrame, second: DataFrame, how: str = "both") -> DataFrame:
    """Drop pairs with Ns: ``how="both"`` when both mates have one, ``how="any"`` when either has."""
    n1, n2 = F.contains("m1.seq", F.lit("N")), F.contains("m2.seq", F.lit("N"))
    if how not in ("both", "any"):
        raise ValueError("how must be both or any")
    return pair_mates(first, second).where(~(n1 & n2) if how == "both" else ~(n1 | n2))


def drop_region(df: DataFrame, chrom: str = HLA[0], lo: int = HLA[1], hi: int = HLA[2]) -> DataFrame:
    """Rows outside the open interval (lo, hi) of one chromosome, whatever its ``chr`` prefix."""
    bare = chrom.removeprefix("chr")
    inside = F.col("chrom").isin(bare, "chr" + bare) & (F.col("pos") > lo) & (F.col("pos") < hi)
    return df.where(~F.coalesce(inside, F.lit(False)))


def rsid_number(rsid: Column | str) -> Column:
    return F.regexp_extract(rsid, r"(\d+)$", 1).try_cast("long")


def distinct_ids(df: DataFrame, rsid: str = "rsid") -> DataFrame:
    """Distinct ids in the order of their number."""
    return df.select(rsid).distinct().orderBy(rsid_number(rsid), rsid)


def split_by_sign(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, closed): distinct rsids of the rows with sign 1 and -1, by number."""
    return distinct_ids(df.where(F.col("sign") == 1)), distinct_ids(df.where(F.col("sign") == -1))


def maf_filter(df: DataFrame, column: str = "pre", lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    return df.where((F.col(column) > lo) & (F.col(column) < hi))


def mean_genotype_filter(df: DataFrame, genotypes: str = "genotypes", lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Rows whose mean over the genotype array lies in [lo, hi]."""
    total = F.aggregate(genotypes, F.lit(0.0), lambda acc, x: acc + x)
    mean = total / F.size(genotypes)
    return df.where((mean >= lo) & (mean <= hi))


def r2_cutoff(pairs: DataFrame, r2: float) -> DataFrame:
    return pairs.where(F.col("r2") >= r2)


def log_pairs(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with finite log10 of both columns, as lx and ly. log10 is NULL at or below 0."""
    finite = [~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("lx", "ly")]
    return df.withColumns({"lx": F.log10(x), "ly": F.log10(y)}).where(finite[0] & finite[1])


def log_dropped(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: how many rows ``log_pairs`` would drop."""
    ok = (F.col(x) > 0) & (F.col(y) > 0) & ~F.isnan(x) & ~F.isnan(y) & (F.col(x) < float("inf")) & (F.col(y) < float("inf"))
    return df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("dropped"))
