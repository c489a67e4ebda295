"""FASTA, FASTQ, SCARF and SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.bases import reverse_when
from lociframe.functions.chroms import strip_parent
from lociframe.operators.intervals import flanked
from lociframe.sources.splits import fixed_records, tiled_sequences
from lociframe.sources.text import field, fields, read_lines


def read_fasta(spark: SparkSession, path: str | list[str], tile: int = 8192, flank: int = 0) -> DataFrame:
    """FASTA files or a folder of them as a tiled genome: chrom, tile, seq; with ``flank`` also before and after, so many bases
    of the sequence on both sides of each tile, as lookups around a position need them.

    Tiles are cut where the lines lie, split by split; only tiles cut by the edge of a split are put together from pieces (``sources.splits``).
    """
    tiles = tiled_sequences(spark, path, tile)
    return flanked(tiles, tile, flank) if flank else tiles


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Four-line FASTQ records: file, record (number in the file), id, seq, qual. Records are put together where they lie, split by split."""
    rec = fixed_records(spark, path, ["id", "seq", None, "qual"])
    return rec.select("file", "record", F.expr("substring(id, 2)").alias("id"), "seq", "qual")


def parse_sam(lines: DataFrame, flip: bool = False) -> DataFrame:
    """SAM text: id, flag, chrom (parental suffix cut), start (0-based), end (last base), seq, reverse.

    ``flip`` complements the bases of reverse reads. Lines without flag, position or sequence keep
    their line in ``_corrupt``.
    """
    f = fields()
    reverse = field(f, 1, "int").bitwiseAND(16) == 16
    seq = field(f, 9)
    ok = field(f, 1, "int").isNotNull() & field(f, 3, "long").isNotNull() & seq.isNotNull()
    rows = lines.where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    return rows.select(
        field(f, 0).alias("id"),
        field(f, 1, "int").alias("flag"),
        strip_parent(field(f, 2)).alias("chrom"),
        (field(f, 3, "long") - 1).alias("start"),
        (field(f, 3, "long") - 1 + F.length(seq) - 1).alias("end"),
        (reverse_when(seq, reverse) if flip else seq).alias("seq"),
        reverse.alias("reverse"),
        F.when(~ok, F.col("value")).alias("_corrupt"),
    )


def read_sam(spark: SparkSession, path: str | list[str], flip: bool = False) -> DataFrame:
    return parse_sam(read_lines(spark, path), flip)


def parse_scarf(lines: DataFrame) -> DataFrame:
    """``id parts:seq:qual`` lines -> id, seq, qual, split from the right; others keep their line in ``_corrupt``."""
    f = F.split(F.regexp_replace("value", r"\s+$", ""), ":")
    ok = F.size(f) >= 3
    return lines.where(F.trim("value") != "").select(
        F.when(ok, F.array_join(F.slice(f, 1, F.greatest(F.size(f) - 2, F.lit(0))), ":")).alias("id"),
        F.when(ok, F.get(f, F.size(f) - 2)).alias("seq"),
        F.when(ok, F.get(f, F.size(f) - 1)).alias("qual"),
        F.when(~ok, F.col("value")).alias("_corrupt"),
    )


