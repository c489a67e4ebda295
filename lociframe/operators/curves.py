"""Tables behind the usual plots: genome-wide positions, quantiles, bins, labels, limits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.config import pin
from lociframe.functions.chroms import chrom_rank
from lociframe.functions.stats import c_log10, c_pow
from lociframe.plans import ranged
from lociframe.plans.lookups import lookup


def manhattan(points: DataFrame, log: bool = True) -> DataFrame:
    """Genome-wide x for (chrom, pos, p): chromosomes in natural order, each after the last position
    of the one before. Adds x, y and the chromosome's label position.

    Only the per-chromosome table, one row per sequence name, is put in order in one task.
    """
    spans = points.groupBy("chrom").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    before = Window.orderBy(chrom_rank("chrom"), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("_offset", F.coalesce(F.sum("_hi").over(before), F.lit(0)))
    offsets = offsets.withColumn("label_x", F.col("_offset") + (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi")
    y = -F.log10("p") if log else F.col("p")
    return lookup(points, offsets, ["chrom"]).withColumns({"x": F.col("_offset") + F.col("pos"), "y": y}).drop("_offset")


def significance_line(points: DataFrame, p: float = 0.05, log: bool = True) -> DataFrame:
    """One row: the threshold divided by the number of tests; null without any."""
    line = F.try_divide(F.lit(p), F.count(F.lit(1)))
    return points.agg((-F.log10(line) if log else line).alias("line"))


def sig_flags(df: DataFrame, p: float = 0.05, x: str = "x", y: str = "y") -> DataFrame:
    """Adds sig: both, either or none of x and y at or below p / number of rows."""
    line = F.try_divide(F.lit(p), df.select(F.count(F.lit(1))).scalar())
    out = df.withColumn("_line", line)
    a, b = F.col(x) <= F.col("_line"), F.col(y) <= F.col("_line")
    return out.withColumn("sig", F.when(a & b, "both").when(a | b, "either").otherwise("none")).drop("_line")


# Largest label limit whose picks are broadcast.
BROADCAST_LABELS = 100_000


def pick_labels(df: DataFrame, limit: int, log: bool = True, label: str = "label") -> DataFrame:
    """The points to label: by smallest x*y (5 % of limit), most interesting (55 %), most above and
    most below the diagonal (20 % each), none twice. Columns label, x, y, rank (1..4).

    A report of at most ``limit`` + 4 rows: each round is a top-k, and takes out what was picked. Whole lines of points have the same score up to the
    last bit, and which of them come first is settled by the functions of the C library (``c_pow``, ``c_log10``), as in a database; points without a score come last.
    """
    x, y = F.col("x"), F.col("y")
    small = x * y
    ratio = c_log10(x) - c_log10(y)
    interesting = F.try_divide(F.lit(1.0), small) * c_pow(F.lit(10.0), F.abs(ratio))
    diff = ratio if log else x - y
    rounds = [(small, True, 0.05), (interesting, False, 0.55), (diff, True, 0.2), (-diff, True, 0.2)]
    keys = [label, "x", "y"]
    picked: list[DataFrame] = []
    for i, (score, rising, share) in enumerate(rounds, 1):
        left = df.select(*keys)
        if picked:
            seen = reduce(DataFrame.unionByName, [p.select(*keys) for p in picked])
            if limit <= BROADCAST_LABELS:
                # At most limit + 4 rows by construction.
                seen = F.broadcast(seen)
            left = left.join(seen, keys, "left_anti")
        # The product keeps its float error out of the ceiling: 20 * 0.55 is 11, not 11.000000000000002.
        rows = max(1, math.ceil(round(limit * share, 9)))
        scored = left.withColumn("_score", score)
        order = F.asc_nulls_last("_score") if rising else F.desc_nulls_last("_score")
        # Pinned, so that a round does not go through the ones before it again.
        picked.append(pin(scored.orderBy(order, *keys).limit(rows).select(*keys, F.lit(i).alias("rank"))))
    return reduce(DataFrame.unionByName, picked)


def uniform_bins(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Distinct edges of bins with near-equal counts: the first value, every len/bins-th, the last."""
    cum = ranged.value_counts(df, value)
    n = cum.select(F.sum("weight")).scalar()
    cum = cum.withColumn("_n", n)
    total, until = F.col("_n"), F.col("below") + F.col("weight")
    # The first edge place at or after ``below`` is place floor(i * n / bins) of the smallest such i.
    i = F.call_function("div", F.col("below") * F.lit(bins) + total - 1, total)
    place = F.call_function("div", i * total, F.lit(bins).cast("long"))
    edge = (F.col("below") == 0) | (until == total) | ((i < bins) & (place < until))
    return cum.where(edge).select(F.col(value).alias("edge"))


def linear_bins(a: DataFrame, b: DataFrame, bins: int, x: str = "x") -> DataFrame:
    """bins + 1 equal-width edges over both series, 1 % of each end wider: i, edge."""
    ends = a.select(F.col(x).alias("v")).unionByName(b.select(F.col(x).alias("v"))).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = F.col("lo") * 0.99, F.col("hi") * 1.01
    return ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins).cast("long"))).alias("i"), lo.alias("lo"), hi.alias("hi")).select(
        "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / bins).alias("edge")
    )


def pp_curve(a: DataFrame, b: DataFrame, edges: DataFrame, x: str = "x") -> DataFrame:
    """Cumulative frequency of two series over shared bins (lo, hi]: bin, mid, cum_a, cum_b.

    ``edges``: a small table with ``edge``. Values outside all bins stay out of the curve but not
    out of the total.
    """
    edge_list = edges.agg(F.array_sort(F.collect_set("edge"))).scalar()

    def hist(df: DataFrame, name: str) -> DataFrame:
        # Values are counted before they are binned: a value that fills the table is one row.
        counted = df.groupBy(F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        binned = counted.withColumn("_e", edge_list).withColumn(
            "bin", F.when(F.col("v") > F.get("_e", F.lit(0)), F.size(F.filter("_e", lambda e: e < F.col("v"))).cast("long"))
        )
        inside = (F.col("bin") >= 1) & (F.col("bin") < F.size("_e"))
        return binned.groupBy(F.when(inside, F.col("bin")).alias("bin")).agg(F.sum("n").alias(name))

    ha, hb = hist(a, "a"), hist(b, "b")
    total_a, total_b = ha.select(F.sum("a")).scalar(), hb.select(F.sum("b")).scalar()
    bins = edges.sparkSession.range(1).select(edge_list.alias("_e")).select(
        F.posexplode(F.arrays_zip(F.slice("_e", 1, F.size("_e") - 1).alias("lo"), F.slice("_e", 2, F.size("_e") - 1).alias("hi"))).alias("i", "e")
    ).select((F.col("i") + 1).cast("long").alias("bin"), ((F.col("e.lo") + F.col("e.hi")) / 2).alias("mid"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return (
        bins.join(ha, "bin", "left")
        .join(hb, "bin", "left")
        .withColumn("cum_a", F.coalesce(F.sum("a").over(upto), F.lit(0)) / total_a)
        .withColumn("cum_b", F.coalesce(F.sum("b").over(upto), F.lit(0)) / total_b)
        .select("bin", "mid", "cum_a", "cum_b")
    )


def theoretical(actual: DataFrame, kind: str, x: str = "x", seed: int = 0) -> DataFrame:
    """A sample of the same size from a theoretical distribution: normal and uniform after the
    series' own moments or range, or p-values from 0 to 1. A draw depends on (seed, key) only, where
    ``key`` is a unique column of ``actual``."""
    u = lambda tag: (F.pmod(F.xxhash64("key", F.lit(f"{seed}{tag}")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    if kind in ("pvalue", "p"):
        return actual.select(u("p").alias(x))
    if kind in ("uniform", "random"):
        lo, hi = actual.select(F.min(x)).scalar(), actual.select(F.max(x)).scalar()
        return actual.select((lo + (hi - lo) * u("u")).alias(x))
    if kind == "normal":
        mean, sd = actual.select(F.avg(x)).scalar(), actual.select(F.stddev_pop(x)).scalar()
        gauss = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * math.pi * u("b"))
        return actual.select((mean + sd * gauss).alias(x))
    raise ValueError("kind must be normal, uniform or pvalue")


def qq_curve(a: DataFrame, b: DataFrame, bins: int, x: str = "x", log: bool = False) -> DataFrame:
    """bins + 1 paired percentiles of two series: i, a, b; ``log`` compares -log10 of both."""
    def grid(df: DataFrame, name: str) -> DataFrame:
        rows = df.select((-F.log10(x) if log else F.col(x)).alias(x))
        return ranged.quantile_grid(rows, x, bins).withColumnRenamed("value", name)

    return grid(a, "a").join(grid(b, "b"), "i")


def limits(df: DataFrame, factor: float = 0.05, x: str = "x", y: str = "y") -> DataFrame:
    """One row: the ranges of x and y widened by ``factor``, and the range that holds both."""
    def widened(lo: Column, hi: Column) -> tuple[Column, Column]:
        # A range that starts above zero is narrowed by the same step: the sign is part of the rule.
        step = F.when(lo > 0, lo - hi).otherwise(hi - lo) * factor
        a, b = lo - step, hi + step
        infinite = lambda c: F.abs(c) == float("inf")
        a = F.when(infinite(a), lo - lo * factor).otherwise(a)
        b = F.when(infinite(b), hi + hi * factor).otherwise(b)
        return F.when(infinite(a), lo).otherwise(a), F.when(infinite(b), hi).otherwise(b)

    ends = df.agg(*[f(c).cast("double").alias(n) for c, k in ((x, "x"), (y, "y")) for f, n in ((F.min, f"_{k}lo"), (F.max, f"_{k}hi"))])
    (xl, xh), (yl, yh) = [
        widened(F.col(f"_{k}lo"), F.col(f"_{k}hi")) if factor else (F.col(f"_{k}lo"), F.col(f"_{k}hi")) for k in "xy"
    ]
    out = ends.select(xl.alias("x_lo"), xh.alias("x_hi"), yl.alias("y_lo"), yh.alias("y_hi"))
    return out.withColumns({"lo": F.least("x_lo", "y_lo"), "hi": F.greatest("x_hi", "y_hi")})


def box_stats(df: DataFrame, label: str, value: str, log: bool = False) -> DataFrame:
    """Per label: quartiles, whisker ends (last values within 1.5 IQR), outliers, n.

    ``log`` works on log10 of the values.
    """
    rows = df.select(F.col(label), (F.log10(value) if log else F.col(value)).cast("double").alias("v"))
    grid = ranged.quantile_grid(rows, "v", 4, [label])
    box = grid.groupBy(label).agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(n) for i, n in ((1, "q1"), (2, "median"), (3, "q3"))])
    counted = rows.groupBy(label, "v").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= lo) & (F.col("v") <= hi)
    box = pin(box)
    ends = lookup(counted, box, [label]).groupBy(label).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        F.sum("n").alias("n"),
    )
    return lookup(ends, box, [label]).select(label, "q1", "median", "q3", "whisker_lo", "whisker_hi", "outliers", "n")


def resampled_medians(df: DataFrame, label: str, value: str, boots: int = 1000, seed: int = 0) -> DataFrame:
    """Medians of ``boots`` resamples of each label's values: label, boot (from 1), median. Null values take no part.

    A resample of n values is n uniform numbers, each standing for the value at its rank, and its median is that of the numbers. So only the middle of n uniform
    numbers is drawn, exactly: for odd n it is Beta distributed with both parameters (n + 1) / 2, which has a closed form in two uniform numbers.
    For even n it is drawn for n - 1, and one more number falls above or below it; the middle pair is then the drawn one and the
    nearest of the n / 2 on that side, which are uniform there. The numbers are bits of a digest of (seed, label, resample). All ranks are
    looked up in one sorted table of values and ranks, without a join on the label.
    """
    cum = ranged.value_counts(df, value, [label])
    sizes = cum.groupBy(label).agg(F.sum("weight").alias("_n"))
    digest = lambda tag: F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), F.coalesce(F.col(label).cast("string"), F.lit("")), F.col("_b").cast("string")))
    part = lambda d, k: (F.conv(F.substring(d, 1 + 13 * k, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    draws = sizes.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(boots)))).withColumns({"_d": digest("a"), "_e": digest("b")})
    n, half = F.col("_n"), F.expr("_n div 2")
    odd = n % 2 == 1
    shape = F.when(odd, half + 1).otherwise(half).cast("double")
    draws = draws.withColumn("_m", 0.5 + 0.5 * F.sqrt(1 - F.pow(part(F.col("_d"), 0), 2 / (2 * shape - 1))) * F.cos(2 * math.pi * part(F.col("_d"), 1)))
    m, side, near = F.col("_m"), part(F.col("_e"), 0), F.pow(part(F.col("_e"), 1), 1 / F.greatest(half, F.lit(1)).cast("double"))
    other = F.when(odd, m).when(side > m, m + (1 - m) * (1 - near)).otherwise(m * near)
    rank = lambda u: F.least(F.floor(n * u).cast("long"), n - 1)
    asked = draws.select(label, "_b", F.explode(F.array(rank(m), rank(other))).alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("double").alias("_v"))
    known = cum.select(label, F.lit(0).alias("_b"), F.col("below").alias("_at"), F.lit(0).alias("_asks"), F.col(value).cast("double").alias("_v"))
    s = ranged.range_sorted(known.unionByName(asked.withColumn("_b", F.col("_b").cast("int"))), label, "_at", "_asks", "_b")
    found = ranged.carried(s, F.when(F.col("_asks") == 0, F.col("_v")), "_found").where("_asks = 1")
    return found.groupBy(label, F.col("_b").alias("boot")).agg(F.avg("_found").alias("median"))


def box_notch(df: DataFrame, label: str, value: str, boots: int = 1000, seed: int = 0) -> DataFrame:
    """Bootstrapped 95 % interval of each label's median (``resampled_medians``): label, lo, hi."""
    # One value a resample.
    ends = resampled_medians(df, label, value, boots, seed).groupBy(label).agg(F.percentile("median", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return ends.select(label, F.get("_q", F.lit(0)).alias("lo"), F.get("_q", F.lit(1)).alias("hi"))
