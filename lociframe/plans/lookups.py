"""Joins of a big table with one that has a row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.config import BROADCAST_BYTES, BROADCAST_ROWS, by_shuffle, fits, parallelism, pin


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` with the columns of ``small``, which has at most one row for each value of ``keys``; ``how`` is inner or left.

    ``small`` is measured and broadcast if it is at most ``rows`` rows and ``most`` bytes; ``big`` is not moved then. Beyond that, keys with more than an even share of
    ``big``, fewer than there are shuffle partitions, are joined by broadcast, so that no task gets a key that holds much of the table; only the others are
    shuffled by key. Null keys find nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if fits(small, rows, most):
        return big.join(F.broadcast(small), keys, how)
    shares = parallelism(big.sparkSession)
    total = big.select(F.count(F.lit(1))).scalar()
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    often = big.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * shares > total)
    hot = pin(often.select(*keys))
    at_hand = small.join(F.broadcast(hot), keys, "left_semi")  # fewer rows than shares
    columns = [*big.columns, *[c for c in small.columns if c not in keys]]
    there = big.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(at_hand), keys, how)
    # Rows without a key would all meet in one task of an outer join.
    rest = big.where(known).join(F.broadcast(hot), keys, "left_anti").join(by_shuffle(small), keys, how)
    out = there.select(*columns).unionByName(rest.select(*columns))
    if how == "left":
        out = out.unionByName(big.where(~known).select(*columns[: len(big.columns)]), allowMissingColumns=True)
    return out
