"""Column functions on chromosome names and SNP ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add_chr(chrom: Column | str) -> Column:
    c = _col(chrom)
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def strip_chr(chrom: Column | str) -> Column:
    return F.regexp_replace(_col(chrom), "^chr", "")


def strip_parent(chrom: Column | str) -> Column:
    """Cut a ``_maternal`` / ``_paternal`` suffix."""
    return F.regexp_replace(_col(chrom), "_(maternal|paternal)$", "")


def norm_chrom(chrom: Column | str, style: str = "chr") -> Column:
    """One naming style: ``chr`` adds the prefix, ``num`` removes it; parental suffixes go in both."""
    bare = strip_parent(chrom)
    if style == "chr":
        return add_chr(bare)
    if style == "num":
        return strip_chr(bare)
    raise ValueError(f"style must be chr or num, not {style}")


def chrom_rank(chrom: Column | str) -> Column:
    """Natural sort key: the number, then X, Y, M*, anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(_col(chrom)), "_", ""), "^chr", "")
    # Ranks of the named chromosomes.
    return (
        F.when(bare == "x", 98)
        .when(bare == "y", 99)
        .when(bare.startswith("m"), 100)
        .when(bare.rlike("^[0-9]{1,9}$"), bare.try_cast("int"))
        .otherwise(101)
    )


def order_by_chrom(df: DataFrame, chrom: str = "chrom", *then: str) -> DataFrame:
    return df.orderBy(chrom_rank(chrom), F.col(chrom), *[F.col(c) for c in then])


def snp_id(chrom: Column | str, pos: Column | str) -> Column:
    return F.concat_ws(".", _col(chrom), _col(pos).cast("string"))


def split_snp_id(snp: Column | str) -> tuple[Column, Column]:
    """(chrom, pos) of a ``chrom.pos`` id."""
    return F.split_part(_col(snp), F.lit("."), F.lit(1)), F.split_part(_col(snp), F.lit("."), F.lit(2)).cast("long")
