"""Order-dependent work over whole tables without a single-task window.

A table is range-sorted once into balanced parts and pinned. Running totals, row numbers and
previous/next rows are then taken inside each part, and the parts are stitched through a table that
has one row per part (at most ``spark.sql.shuffle.partitions`` rows, so it is safe to broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.config import parallelism, pin

PART, AT = "_part", "_at"


def range_sorted(df: DataFrame, *order: str | Column) -> DataFrame:
    """Sort ``df`` over all parts; adds ``_part`` and the place in the part, ``_at``.

    ``order`` should end in a unique column, so that no group of equal keys forces one part to grow.
    """
    parts = parallelism(df.sparkSession)
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(PART, F.spark_partition_id())
        .withColumn(AT, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return pin(placed)


def _stitch(s: DataFrame, per_part: DataFrame) -> DataFrame:
    return s.join(F.broadcast(per_part), PART)


def _totals(s: DataFrame, weight: Column) -> DataFrame:
    over_parts = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return (
        s.groupBy(PART)
        .agg(F.sum(weight).alias("_total"))
        .select(PART, F.coalesce(F.sum("_total").over(over_parts), F.lit(0)).alias("_before"))
    )


def row_index(s: DataFrame, name: str = "row") -> DataFrame:
    """Running number from 0 in sort order."""
    return _stitch(s, _totals(s, F.lit(1).cast("long"))).withColumn(name, F.col("_before") + F.col(AT)).drop("_before")


def running_total(s: DataFrame, weight: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``weight`` in sort order."""
    inside = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _stitch(s.withColumn("_weight", weight), _totals(s, weight))
        .withColumn(name, F.col("_before") + F.sum("_weight").over(inside))
        .drop("_before", "_weight")
    )


def neighbours(s: DataFrame, columns: list[str], prev: str = "prev", next: str = "next") -> DataFrame:
    """Adds structs with ``columns`` of the previous and of the next row, NULL at the ends."""
    inside = Window.partitionBy(PART).orderBy(AT)
    across = Window.orderBy(PART)
    here = F.struct(*columns)
    edges = (
        s.groupBy(PART)
        .agg(F.min_by(here, F.col(AT)).alias("_first"), F.max_by(here, F.col(AT)).alias("_last"))
        .select(
            PART,
            F.lag("_last").over(across).alias("_edge_prev"),
            F.lead("_first").over(across).alias("_edge_next"),
        )
    )
    return (
        _stitch(s, edges)
        .withColumn(prev, F.coalesce(F.lag(here).over(inside), F.col("_edge_prev")))
        .withColumn(next, F.coalesce(F.lead(here).over(inside), F.col("_edge_next")))
        .drop("_edge_prev", "_edge_next")
    )


def group_edges(s: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``_starts`` and ``_ends``: whether a row is the first, the last of its run of equal ``by``."""
    return (
        neighbours(s, by, "_before", "_after")
        .withColumn("_starts", ~F.col("_before").eqNullSafe(F.struct(*by)))
        .withColumn("_ends", ~F.col("_after").eqNullSafe(F.struct(*by)))
        .drop("_before", "_after")
    )


def carried(s: DataFrame, value: Column, name: str, back: bool = False) -> DataFrame:
    """Adds the nearest ``value`` that is not NULL at or before each row, with ``back`` at or after it.

    This is how what is known at the first or last row of a group reaches its other rows. There is no
    join on the group, so one that holds a third of all rows stays spread over the parts it lies in.
    """
    at, part = (F.desc(AT), F.desc(PART)) if back else (F.asc(AT), F.asc(PART))
    inside = Window.partitionBy(PART).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    known = s.withColumn("_value", value)
    outermost = F.min_by if back else F.max_by
    edges = (
        known.groupBy(PART)
        .agg(outermost("_value", F.when(F.col("_value").isNotNull(), F.col(AT))).alias("_end"))
        .select(PART, F.last("_end", ignorenulls=True).over(across).alias("_edge"))
    )
    return (
        _stitch(known, edges)
        .withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_edge"))
        .drop("_value", "_edge")
    )


def unsorted(s: DataFrame) -> DataFrame:
    return s.drop(PART, AT)


def value_counts(df: DataFrame, value: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Distinct values with the number of rows below each: columns by.., value, weight, below.

    Copies are counted before anything is shuffled or sorted, so a value that holds a third of all
    rows costs one row. ``below`` counts within the group when ``by`` is given, and ``total`` then names a
    column for the number of rows of the group.
    """
    by = by or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("weight"))
    s = range_sorted(counted, *by, value)
    cum = running_total(s, F.col("weight"), "_cum").withColumn("below", F.col("_cum") - F.col("weight")).drop("_cum")
    if by:
        cum = carried(group_edges(cum, by), F.when(F.col("_starts"), F.col("below")), "_first")
        cum = cum.withColumn("below", F.col("below") - F.col("_first")).drop("_first", "_starts")
        if total:
            cum = carried(cum, F.when(F.col("_ends"), F.col("below") + F.col("weight")), total, back=True)
        cum = cum.drop("_ends")
    return unsorted(cum)


def quantile_grid(df: DataFrame, value: str, steps: int, by: list[str] | None = None) -> DataFrame:
    """Exact quantiles i/steps for i = 0..steps with linear interpolation: columns by.., i, value."""
    by = by or []
    cum = value_counts(df, value, by, total="_n")
    if not by:
        cum = cum.withColumn("_n", cum.select(F.sum("weight")).scalar())
    span = F.greatest(F.col("_n") - 1, F.lit(1))

    def first_step(rank: Column) -> Column:
        # Smallest i whose lower rank floor(i * (n - 1) / steps) reaches ``rank``.
        return F.call_function("div", rank * F.lit(steps).cast("long") + span - 1, span)

    def steps_between(lo: Column, hi: Column) -> Column:
        a, b = F.greatest(first_step(lo), F.lit(0)), F.least(first_step(hi) - 1, F.lit(steps))
        none = F.array().cast("array<bigint>")
        return F.when(F.col("_n") == 1, F.when(lo == 0, F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).otherwise(none)).otherwise(
            F.when(a <= b, F.sequence(a, b)).otherwise(none)
        )

    lower, upper = F.col("below"), F.col("below") + F.col("weight")
    hits = cum.select(
        *by,
        F.col(value).alias("_v"),
        "_n",
        F.explode(
            F.concat(
                F.transform(steps_between(lower, upper), lambda i: F.struct(i.alias("i"), F.lit(0).alias("side"))),
                F.transform(steps_between(lower - 1, upper - 1), lambda i: F.struct(i.alias("i"), F.lit(1).alias("side"))),
            )
        ).alias("_h"),
    ).select(*by, "_v", "_n", "_h.i", "_h.side")
    ends = hits.groupBy(*by, "i").agg(
        F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("_hi"),
        F.max("_n").alias("_n"),
    )
    frac = F.pmod(F.col("i") * (F.col("_n") - 1), F.lit(steps)) / F.lit(steps)
    lo, hi = F.coalesce("_lo", "_hi"), F.coalesce("_hi", "_lo")
    return ends.select(*by, "i", (lo + (hi - lo) * frac).alias("value"))
