"""Set sizes, unions and renames."""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def venn(sets: Sequence[DataFrame], column: str = "id") -> DataFrame:
    """Size of every region of two or three id sets: region is one digit per set, such as 110."""
    if len(sets) not in (2, 3):
        raise ValueError("two or three sets")
    tagged = reduce(
        DataFrame.unionByName, [s.select(F.col(column), F.lit(1 << i).alias("bit")) for i, s in enumerate(sets)]
    )
    # One row per id first: copies within a set merge before the shuffle.
    masks = tagged.groupBy(column).agg(F.bit_or("bit").alias("mask"))
    digit = [F.when(F.col("mask").bitwiseAND(1 << i) > 0, "1").otherwise("0") for i in range(len(sets))]
    return masks.groupBy(F.concat(*digit).alias("region")).agg(F.count(F.lit(1)).alias("ids"))


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rename_lookup(df: DataFrame, names: DataFrame, key: str = "snp") -> DataFrame:
    """Adds ``name`` from a (``key``, name) map, NULL where the map has none. The last entry of a
    doubled key counts as in a dictionary; give ``names`` an ``ord`` column for that."""
    if "ord" in names.columns:
        names = names.groupBy(key).agg(F.max_by("name", "ord").alias("name"))
    return df.join(names.select(key, "name"), key, "left")


def join_suffixed(a: DataFrame, b: DataFrame, labels: Sequence[str], key: str) -> DataFrame:
    """Inner join of two frames on ``key``; shared column names get the labels as suffixes."""
    shared = (set(a.columns) & set(b.columns)) - {key}

    def suffix(df: DataFrame, label: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_{label}" for c in df.columns if c in shared})

    return suffix(a, labels[0]).join(suffix(b, labels[1]), key)


def merge_samples(df: DataFrame, s1: str, s2: str, keys: Sequence[str]) -> DataFrame:
    """Rows of two samples side by side on ``keys``: p-values, their log10, and absolute differences."""
    def side(name: str) -> DataFrame:
        return df.where(F.col("sample") == name).select(*keys, F.col("p_value").alias(f"{name}_p_value"))

    p1, p2 = f"{s1}_p_value", f"{s2}_p_value"
    out = side(s1).join(side(s2), list(keys))
    out = out.withColumns({f"log10_{p1}": F.log10(p1), f"log10_{p2}": F.log10(p2)})
    return out.withColumns(
        {"pdiff": F.abs(F.col(p1) - F.col(p2)), "pldiff": F.abs(F.col(f"log10_{p1}") - F.col(f"log10_{p2}"))}
    )


def merge_reads(kept: DataFrame, remapped: DataFrame) -> DataFrame:
    """Untouched and remapped reads together, in coordinate order."""
    return kept.unionByName(remapped).orderBy("chrom", "start", "id")
