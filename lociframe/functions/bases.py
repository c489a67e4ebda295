"""Column functions on base strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complementary bases, case kept, N to N.
BASES = "ACGTNacgtn"
PARTNERS = "TGCANtgcan"


def complement(seq: Column | str) -> Column:
    return F.translate(seq, BASES, PARTNERS)


def revcomp(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def reverse_when(seq: Column, flag: Column) -> Column:
    """Complement the bases of reads on the reverse strand; their order stays."""
    return F.when(flag, complement(seq)).otherwise(seq)
