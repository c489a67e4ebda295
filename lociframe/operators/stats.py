"""Effect sizes, permutation nulls, tests, regression, density, linkage disequilibrium."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.config import BROADCAST_ROWS, by_shuffle, fits, pin
from lociframe.functions.chroms import snp_id
from lociframe.functions.stats import (
    chi2_sf,
    chi2_sf_1df,
    erfc,
    nan,
    student_t_quantile_975,
    student_t_two_sided,
)
from lociframe.operators.filters import maf_filter, mean_genotype_filter
from lociframe.operators.sets import merge_samples, rename_lookup
from lociframe.plans import ranged

# ---- effects ----


def norm_effect(df: DataFrame, by: str = "both") -> DataFrame:
    """Adds norm_effect = (pre - post) over: pre or 1 - pre by the direction (both), the larger of the
    two (max), the smaller (min)."""
    pre, post = F.col("pre"), F.col("post")
    over = {
        "both": F.when(pre > post, pre).otherwise(1 - pre),
        "max": F.greatest(pre, 1 - pre),
        "min": F.least(pre, 1 - pre),
    }
    if by not in over:
        raise ValueError("by must be both, max or min")
    return df.withColumn("norm_effect", F.coalesce(F.try_divide(pre - post, over[by]), nan()))


def effect_stderr(df: DataFrame) -> DataFrame:
    """Adds vari, z, stddev, bvari; NaN where a division has no value."""
    return (
        df.withColumn("vari", F.sqrt(F.col("prevar") + F.col("postvar")))
        .withColumn("z", F.coalesce(F.try_divide(F.col("pre") - F.col("post"), F.col("vari")), nan()))
        .withColumn("stddev", F.abs(F.coalesce(F.try_divide("norm_effect", "z"), nan())))
        .withColumn("bvari", F.sqrt("stddev"))
    )


def normalize_effects(df: DataFrame, names: DataFrame, by: str = "both") -> tuple[DataFrame, DataFrame]:
    """(all rows, betas): frequency filter, ids and names, effect, errors. Betas have a name and a
    stddev. ``df`` carries ``pop``; over files take ``population_of(input file)``."""
    kept = maf_filter(df).withColumn("snp", snp_id("chrom", "pos"))
    full = effect_stderr(norm_effect(rename_lookup(kept, names), by))
    betas = full.where(F.col("name").isNotNull() & ~F.isnan("stddev")).select("name", "pop", "norm_effect", "bvari")
    return full, betas


def population_of(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


# ---- permutations ----


def permute_labels(first: DataFrame, second: DataFrame, perms: int, seed: int = 0, column: str = "id") -> DataFrame:
    """Shuffle the ids of two lists together, ``perms`` times, and split to the original sizes:
    perm, id, sample (1 or 2).

    The shuffle is the order of md5(id, list, perm, seed), so it does not depend on partitions or
    retries. All permutations are sorted together over the whole cluster; each has the same number
    of rows, so the place in a permutation follows from the running number.
    """
    both = first.select(F.col(column), F.lit(1).alias("_list")).unionByName(second.select(F.col(column), F.lit(2).alias("_list")))
    size, n1 = both.select(F.count(F.lit(1))).scalar(), first.select(F.count(F.lit(1))).scalar()
    draws = both.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms)))).withColumn(
        "_key", F.md5(F.concat_ws(":", column, F.col("_list").cast("string"), F.col("perm").cast("string"), F.lit(str(seed))))
    )
    rows = ranged.row_index(ranged.range_sorted(draws, "perm", "_key", column), "_row")
    place = F.col("_row") - (F.col("perm") - 1) * F.col("_size")
    return (
        rows.withColumns({"_size": size, "_n1": n1})
        .select("perm", column, F.when(place < F.col("_n1"), 1).otherwise(2).alias("sample"))
    )


def perm_stats(df: DataFrame, key: str, value: str = "pldiff") -> DataFrame:
    """Per key over its permutations: min, max, mean, median, p95.

    Rows of one (key, perm) are averaged first; the rest of the group is then one value per
    permutation, which the number of permutations bounds.
    """
    per_perm = df.groupBy(key, "perm").agg(F.avg(value).alias("_v"))
    q = F.percentile("_v", F.array(F.lit(0.5), F.lit(0.95)))
    return per_perm.groupBy(key).agg(
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"), q.alias("_q")
    ).withColumns({"median": F.get("_q", F.lit(0)), "p95": F.get("_q", F.lit(1))}).drop("_q")


def perm_matrix(df: DataFrame, key: str, perms: Sequence[int], value: str = "pldiff") -> DataFrame:
    """One row per key, one column per permutation."""
    return df.groupBy(key).pivot("perm", list(perms)).agg(F.avg(value))


def beats_perm(observed: DataFrame, null: DataFrame, key: str, value: str = "pldiff") -> DataFrame:
    """Observed rows with their null statistics and whether they beat the maximum and the 95th percentile."""
    names = {"max": f"max_{value}_perms", "median": f"median_{value}_perms", "mean": f"mean_{value}_perms", "p95": f"p95_{value}_perms"}
    stats = null.select(key, *[F.col(a).alias(b) for a, b in names.items()])
    return observed.join(stats, key).withColumns(
        {"beats_perm": F.col(value) > F.col(names["max"]), "beats_perm95": F.col(value) > F.col(names["p95"])}
    )


def examine(observed: DataFrame, null: DataFrame, key: str, s1: str = "sample_1", s2: str = "sample_2") -> DataFrame:
    """The whole comparison of one table of enrichment p-values with its permutations.

    Both inputs: key, sample, p_value; the null also perm. Adds the Mann-Whitney U and p of observed
    against permuted differences to every row.
    """
    obs = merge_samples(observed, s1, s2, [key])
    perms = merge_samples(null, s1, s2, [key, "perm"])
    test = mannwhitney(obs.select(F.col("pldiff").alias("x")), perms.select(F.col("pldiff").alias("x")))
    out = beats_perm(obs, perm_stats(perms, key), key)
    return out.withColumns({"mannw_u": test.select("u").scalar(), "mannw_p": test.select("p").scalar()})


# ---- tests ----


def mannwhitney(a: DataFrame, b: DataFrame, x: str = "x") -> DataFrame:
    """One row: n1, n2, u (of the first sample), p (two-sided normal, tie and continuity corrected).

    Where one sample has no value there is nothing to compare: u and p are null, n1 and n2 tell why. Ranks come from distinct values and their counts, put in order over all parts.
    """
    sides = a.select(F.col(x).alias("v"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        b.select(F.col(x).alias("v"), F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    )
    counted = sides.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    t = F.col("a") + F.col("b")
    run = ranged.running_total(ranged.range_sorted(counted, "v"), t, "_upto")
    rank = F.col("_upto") - t + (t + 1) / F.lit(2.0)
    td = t.cast("double")
    sums = run.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n1"), F.coalesce(F.sum("b"), F.lit(0)).alias("n2"), F.sum(rank * F.col("a")).alias("r1"), F.sum(td * td * td - td).alias("ties")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    # Without spread (all values tied) nothing can be told apart: p = 1.
    z = F.coalesce(F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd), F.lit(0.0))
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    return sums.select("n1", "n2", F.when(both, u).alias("u"), F.when(both, F.least(F.lit(1.0), erfc(z / F.sqrt(F.lit(2.0))))).alias("p"))


def chisq(df: DataFrame, observed: str = "observed", expected: str = "expected") -> DataFrame:
    """One row: goodness-of-fit statistic, bins, p with bins - 1 degrees of freedom.

    A bin that expects 0 and has 0 says nothing and is left out; one that expects 0 and has some cannot be, so the statistic is infinite and p 0.
    Without two bins p is null, without any the statistic is null.
    """
    d = (F.col(observed) - F.col(expected)).cast("double")
    term = F.when(F.col(expected) == 0, F.when(d != 0, F.lit(float("inf")))).otherwise(F.try_divide(d * d, F.col(expected).cast("double")))
    s = df.select(term.alias("_t")).agg(F.sum("_t").alias("chisq"), F.count("_t").alias("bins"))
    return s.withColumn("p", chi2_sf(F.col("chisq"), (F.col("bins") - 1).cast("double")))


def pearson(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: r, n, two-sided p."""
    s = df.agg(F.corr(x, y).alias("r"), F.count(F.col(x) + F.col(y)).alias("n"))
    dof = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(dof, 1 - F.col("r") * F.col("r")))
    # Points on a line leave nothing to chance.
    return s.withColumn("p", F.when((F.abs("r") >= 1) & ~F.isnan("r") & (dof > 0), F.lit(0.0)).otherwise(student_t_two_sided(t, dof)))


# ---- regression ----


def ols(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row of a least-squares line: n, slope, intercept, r2, standard errors, p of both, and the
    sums the bands need. One aggregation pass. A line through all points has p 0 for a coefficient that
    is not 0; two rows, or a constant ``x``, leave errors and p without a value."""
    a, b = F.col(y), F.col(x)
    s = df.agg(
        F.regr_count(a, b).alias("n"),
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"),
        F.regr_avgx(a, b).alias("x_mean"),
        F.regr_sxx(a, b).alias("sxx"),
        F.regr_syy(a, b).alias("syy"),
        F.min(b).alias("x_min"),
        F.max(b).alias("x_max"),
    )
    dof = (F.col("n") - 2).cast("double")
    mse = F.greatest(F.try_divide(F.col("syy") * (1 - F.col("r2")), dof), F.lit(0.0))
    mse = F.when(dof > 0, mse)
    out = s.withColumn("mse", mse)
    out = out.withColumns(
        {
            "se_slope": F.sqrt(F.try_divide("mse", "sxx")),
            "se_intercept": F.sqrt(F.col("mse") * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.col("x_mean") * F.col("x_mean"), F.col("sxx")))),
        }
    )

    def p(value: str, error: str) -> Column:
        tested = student_t_two_sided(F.try_divide(value, error), dof)
        return F.when((F.col(error) == 0) & (F.col(value) != 0), F.lit(0.0)).otherwise(tested)

    return out.withColumns({"p_slope": p("slope", "se_slope"), "p_intercept": p("intercept", "se_intercept")})


def ols_bands(fit: DataFrame, points: int = 100) -> DataFrame:
    """The fitted line at evenly spaced x with 95 % confidence and prediction bands."""
    t = student_t_quantile_975((F.col("n") - 2).cast("double"))
    xs = fit.withColumn("_t", t).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("i") / (points - 1)
    d = F.col("x") - F.col("x_mean")
    xs = xs.withColumn("x", x).withColumn("y", F.col("intercept") + F.col("slope") * F.col("x"))
    share = 1 / F.col("n") + F.try_divide(d * d, F.col("sxx"))
    xs = xs.withColumns({"_c": F.col("_t") * F.sqrt(F.col("mse") * share), "_p": F.col("_t") * F.sqrt(F.col("mse") * (1 + share))})
    return xs.select(
        "i", "x", "y", (F.col("y") - F.col("_c")).alias("ci_lo"), (F.col("y") + F.col("_c")).alias("ci_hi"),
        (F.col("y") - F.col("_p")).alias("pred_lo"), (F.col("y") + F.col("_p")).alias("pred_hi"),
    )


# Clip of the frequencies in the weights, range of rows that enter the fit.
WEIGHT_CLIP = 0.0001
FIT_RANGE = (0.1, 0.9)
MEAN_RANGE = (0.01, 0.99)


@dataclass(frozen=True)
class PoolFit:
    """Coefficients of all individuals and their covariance, from ``pool_regression``."""

    coefficients: tuple[float, ...]
    covariance: tuple[tuple[float, ...], ...]
    rows: int


def _pool_weight(post: Column, depth: Column) -> Column:
    clipped = F.least(F.lit(1 - WEIGHT_CLIP), F.greatest(post, F.lit(WEIGHT_CLIP)))
    return depth / (clipped * (1 - clipped))


def pool_regression(
    df: DataFrame, genotypes: str = "genotypes", post: str = "post", depth: str = "depth", means: tuple[float, float] | None = None
) -> PoolFit:
    """Weighted regression without intercept of pooled frequencies on the individuals' allele
    frequencies (arrays of 1 - dosage/2); the coefficients sum to one.

    ``means`` (such as ``MEAN_RANGE``) keeps rows with a mean genotype outside it out of the fit. Each task reduces its rows to the k x k normal equations with numpy; only those sums, whose size is
    the number of individuals squared, reach the driver, where the system is solved.
    """
    if means:
        df = mean_genotype_filter(df, genotypes, *means)
    rows = df.where((F.col(post) > FIT_RANGE[0]) & (F.col(post) < FIT_RANGE[1])).select(
        F.col(genotypes).cast("array<double>").alias("g"),
        F.col(post).cast("double").alias("y"),
        _pool_weight(F.col(post), F.col(depth)).cast("double").alias("w"),
    )

    def normal_equations(batches):
        import numpy as np
        import pandas as pd

        total, n = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            g = np.vstack(pdf["g"].to_numpy())
            # Columns: individuals against the last one, then the response against the last one.
            m = np.column_stack([g[:, :-1] - g[:, -1:], pdf["y"].to_numpy() - g[:, -1]])
            part = (m * pdf["w"].to_numpy()[:, None]).T @ m
            total = part if total is None else total + part
            n += len(pdf)
        if total is not None:
            k = total.shape[0]
            i, j = np.divmod(np.arange(k * k), k)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "v": np.append(total.ravel(), float(n))})

    import numpy as np

    sums = rows.mapInPandas(normal_equations, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not sums:
        raise ValueError(f"no row to fit: {post} must be between {FIT_RANGE[0]} and {FIT_RANGE[1]}" + (f", mean genotype within {means}" if means else ""))
    n = int(next(r["v"] for r in sums if r["i"] < 0))
    k = max(r["i"] for r in sums)
    full = np.zeros((k + 1, k + 1))
    for r in sums:
        if r["i"] >= 0:
            full[r["i"], r["j"]] = r["v"]
    xwx, xwy, ywy = full[:k, :k], full[:k, k], full[k, k]
    inverse = np.linalg.inv(xwx)
    beta = inverse @ xwy
    sigma2 = (ywy - beta @ xwy) / (n - k)
    cov = inverse * sigma2
    big = np.zeros((k + 1, k + 1))
    big[:k, :k] = cov
    big[k, :k] = big[:k, k] = -cov.sum(axis=1)
    big[k, k] = cov.sum()
    return PoolFit(tuple(np.append(beta, 1 - beta.sum()).tolist()), tuple(map(tuple, big.tolist())), n)


def pool_effects(df: DataFrame, fit: PoolFit, genotypes: str = "genotypes", post: str = "post", depth: str = "depth") -> DataFrame:
    """Adds pre, pre_var, post_clipped, post_var, z, beta and vari per SNP from a fit. Without reads (depth 0) the variance after is 1, its
    upper bound; without any variance z is null."""
    coefficients, covariance = fit.coefficients, fit.covariance

    @F.pandas_udf("struct<pre: double, var: double>")
    def predict(genotype_arrays: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas

        g = np.vstack(genotype_arrays.to_numpy()).astype(float)
        return pandas.DataFrame({"pre": g @ np.array(coefficients), "var": np.einsum("ij,jk,ik->i", g, np.array(covariance), g)})

    df = df.withColumn("_fit", predict(F.col(genotypes).cast("array<double>")))
    pre, var = F.col("_fit.pre"), F.greatest(F.lit(0.0), F.col("_fit.var"))
    out = df.withColumns(
        {
            "pre": F.least(F.lit(1.0), pre),
            "pre_var": var,
            "post_clipped": F.least(F.lit(1.0), F.col(post).cast("double")),
            "post_var": F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(1.0), _pool_weight(F.col(post), F.col(depth)).cast("double")), F.lit(1.0))),
        }
    )
    out = out.withColumns({"beta": F.col("post_clipped") - F.col("pre"), "vari": F.sqrt(F.col("pre_var") + F.col("post_var"))})
    return out.withColumn("z", F.try_divide("beta", "vari")).drop("_fit")


# ---- two-dimensional density ----


def density(
    df: DataFrame, x: str = "x", y: str = "y", grid: tuple[int, int] = (400, 400), weights: str | None = None, extents: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Gaussian kernel density on a regular grid: ix, iy, density for every cell.

    ``weights`` names a column each point counts with; Scott's factor and the norm go by the number of points all the same. ``extents`` (least and greatest x, least and
    greatest y; default those of the points) is what the grid covers; points outside it, and points without coordinates or weight, take no part.

    The points are reduced to at most nx * ny cell counts; bandwidth after Scott with the full
    covariance. Smoothing runs per output row of the grid, from the cells of the rows its kernel
    reaches, so a task holds at most (kernel height * nx) cells whatever the number of points. Points on
    a line, all in one cell, or none at all have no density: NaN in every cell.
    """
    nx, ny = grid
    cells, p = _cells(df, x, y, grid, weights, extents)
    n, cov_xx, cov_xy, cov_yy = float(p["n"] or 0), p["xx"], p["xy"], p["yy"]
    spread_out = n > 0 and cov_xx is not None and cov_xx > 0 and cov_yy > 0 and cov_xx * cov_yy - cov_xy * cov_xy > 0
    if not spread_out:
        every = df.sparkSession.range(nx * ny).select(F.expr(f"id div {ny}").alias("ix"), (F.col("id") % ny).alias("iy"))
        return every.withColumn("density", nan())
    scott = n ** (-1.0 / 6)
    kx, ky = (int(round(scott * 2 * math.pi * math.sqrt(v))) for v in (cov_xx, cov_yy))
    det = cov_xx * cov_yy - cov_xy * cov_xy
    inv = [v / det / scott**2 for v in (cov_yy, -cov_xy, cov_xx)]
    norm = n * p["dx"] * p["dy"] * 2 * math.pi * scott**2 * math.sqrt(det)

    def smooth(pdf):
        import numpy as np
        import pandas as pd

        oy = int(pdf["oy"].iloc[0])
        u = np.arange(kx) - kx / 2.0
        out = np.zeros(nx)
        for iy, ixs, ws in zip(pdf["iy"], pdf["ixs"], pdf["ws"]):
            if ixs is None:
                continue
            v = (oy - int(iy) + ky // 2) - ky / 2.0
            kernel = np.exp(-(inv[0] * u * u + 2 * inv[1] * u * v + inv[2] * v * v) / 2)
            line = np.zeros(nx)
            line[np.asarray(ixs, dtype=int)] = ws
            out += np.convolve(line, kernel)[kx // 2 : kx // 2 + nx]
        return pd.DataFrame({"ix": np.arange(nx), "iy": oy, "density": out / norm})

    low = F.col("iy") - ky // 2
    # One row per grid row: at most nx cells each.
    lines = cells.groupBy("iy").agg(F.collect_list(F.struct("ix", "w")).alias("c")).select("iy", F.col("c.ix").alias("ixs"), F.col("c.w").alias("ws"))
    reach = lines.withColumn("oy", F.explode(F.sequence(low, low + (ky - 1)))).where((F.col("oy") >= 0) & (F.col("oy") < ny))
    # Every output row exists, also one that no kernel reaches.
    rows = df.sparkSession.range(ny).select(F.col("id").alias("oy")).join(reach, "oy", "left")
    return rows.groupBy("oy").applyInPandas(smooth, "ix long, iy long, density double")


def _pixel(df: DataFrame, x: str, y: str, grid: tuple[int, int], extents: tuple[float, float, float, float] | None) -> DataFrame:
    if extents:
        x0, x1, y0, y1 = (F.lit(float(v)) for v in extents)
        at = df.withColumn("_g", F.struct(x0.alias("x0"), ((x1 - x0) / (grid[0] - 1)).alias("dx"), y0.alias("y0"), ((y1 - y0) / (grid[1] - 1)).alias("dy")))
        inside = F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
    else:
        ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).select(
            F.struct(
                F.col("x0").cast("double").alias("x0"),
                ((F.col("x1") - F.col("x0")) / (grid[0] - 1)).alias("dx"),
                F.col("y0").cast("double").alias("y0"),
                ((F.col("y1") - F.col("y0")) / (grid[1] - 1)).alias("dy"),
            )
        )
        at = df.withColumn("_g", ends.scalar())
        inside = F.lit(True)
    # All values of a constant axis are in its first cell.
    cell = lambda v, k: F.floor(F.when(F.col(f"_g.d{k}") == 0, 0.0).otherwise(F.try_divide(F.col(v) - F.col(f"_g.{k}0"), F.col(f"_g.d{k}")))).cast("long")
    return at.withColumns({"ix": F.when(inside & F.col(y).isNotNull(), cell(x, "x")), "iy": F.when(inside & F.col(x).isNotNull(), cell(y, "y"))})


def _cells(df: DataFrame, x: str, y: str, grid: tuple[int, int], weights: str | None, extents: tuple[float, float, float, float] | None):
    at = _pixel(df, x, y, grid, extents).where("ix IS NOT NULL AND iy IS NOT NULL")
    weight = F.col(weights).cast("double") if weights else F.lit(1.0)
    # Pinned: at most nx * ny rows, read for the moments and again for the smoothing.
    cells = pin(at.where(weight.isNotNull()).groupBy("ix", "iy").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("k"), F.max("_g").alias("_g")))
    w, ix, iy = F.col("w"), F.col("ix"), F.col("iy")
    s = cells.agg(
        F.sum("k").alias("n"), F.sum("w").alias("sw"), F.sum(w * ix).alias("mx"), F.sum(w * iy).alias("my"), F.sum(w * ix * ix).alias("xx"),
        F.sum(w * ix * iy).alias("xy"), F.sum(w * iy * iy).alias("yy"), F.max("_g").alias("g"),
    )
    share = lambda v: F.try_divide(v, F.col("sw"))
    mx, my = F.col("mx"), F.col("my")
    params = s.select(
        "n", "g.dx", "g.dy", share(F.col("xx") - share(mx) * mx).alias("xx"), share(F.col("xy") - share(mx) * my).alias("xy"), share(F.col("yy") - share(my) * my).alias("yy"),
    ).first()
    return cells.select("ix", "iy", "w"), params


# Most grid cells that are broadcast to the points; a finer grid is joined by shuffle.
BROADCAST_CELLS = 1_000_000


def point_density(
    df: DataFrame, x: str = "x", y: str = "y", grid: tuple[int, int] = (400, 400), weights: str | None = None, extents: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """The points with the density of their cell; null for points outside the grid or without coordinates. The grid has nx * ny rows, whatever the data."""
    at = _pixel(df, x, y, grid, extents).drop("_g")
    cells = density(df, x, y, grid, weights, extents)
    if grid[0] * grid[1] <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    return at.join(cells, ["ix", "iy"], "left").drop("ix", "iy")


# ---- linkage disequilibrium ----

# Fixed value: r2 above which two SNPs count as linked.
LD_R2 = 0.1


SAMPLES_A_WORD = 32  # two haplotypes a sample


def haplotype_words(genotypes: DataFrame) -> DataFrame:
    """A row for each SNP and word of 32 samples that holds any of the SNP's: snp, w and the 64-bit words ``zero``, ``one`` and ``seen`` with a bit for each haplotype: whether
    it has allele 0, allele 1, or any known allele. There are never more rows than genotypes, however many samples there are of which a SNP has none.

    ``genotypes``: snp, sample, gt (``0|1``). Samples are numbered in order, the same for all SNPs; the list of names is joined to the genotypes, broadcast when its
    size allows. A haplotype given twice counts once; one with two different alleles is known, but neither 0 nor 1.
    """
    hap = lambda i: F.split_part("gt", F.lit("|"), F.lit(i)).try_cast("int")  # noqa: E731  a missing allele is null
    names = genotypes.where(F.col("sample").isNotNull()).select(F.col("sample").alias("_name")).distinct()
    if fits(names, BROADCAST_ROWS):
        # Few enough for one task.
        listed = F.broadcast(names.withColumn("_n", (F.row_number().over(Window.orderBy("_name")) - 1).cast("long")))
    else:
        listed = ranged.unsorted(ranged.row_index(ranged.range_sorted(names, "_name"), "_n"))
    g = genotypes.select("snp", "sample", hap(1).alias("h1"), hap(2).alias("h2")).join(listed, F.col("sample") == F.col("_name"))
    bit = (2 * (F.col("_n") % SAMPLES_A_WORD)).cast("int")

    def bits(test) -> Column:
        mark = F.coalesce(test(F.col("h1")), F.lit(False)).cast("long") + 2 * F.coalesce(test(F.col("h2")), F.lit(False)).cast("long")
        return F.bit_or(F.call_function("shiftleft", mark, bit))

    per_word = g.groupBy("snp", F.expr(f"cast(_n div {SAMPLES_A_WORD} as int)").alias("w")).agg(
        bits(lambda h: h == 0).alias("z"), bits(lambda h: h == 1).alias("o"), bits(lambda h: h > 1).alias("m")
    )
    clear = F.bitwise_not(F.col("m"))
    zero, one = F.col("z").bitwiseAND(F.bitwise_not("o")).bitwiseAND(clear), F.col("o").bitwiseAND(F.bitwise_not("z")).bitwiseAND(clear)
    return per_word.select("snp", "w", zero.alias("zero"), one.alias("one"), F.col("z").bitwiseOR(F.col("o")).bitwiseOR(F.col("m")).alias("seen"))


def haplotype_rows(genotypes: DataFrame) -> DataFrame:
    """``haplotype_words`` as one row a SNP: snp and the arrays w (rising), zero, one and seen. A row grows with the samples of its SNP."""
    word = F.struct("w", "zero", "one", "seen")
    rows = haplotype_words(genotypes).groupBy("snp").agg(F.sort_array(F.collect_list(word)).alias("at"))
    return rows.select("snp", *[F.col(f"at.{c}").alias(c) for c in ("w", "zero", "one", "seen")])


def ld_pairs(genotypes: DataFrame, pairs: DataFrame, min_r2: float = LD_R2) -> DataFrame:
    """Haplotype table and LD measures of SNP pairs over phased genotypes.

    ``genotypes``: snp, sample, gt (``0|1``); ``pairs``: snp1, snp2. Adds n00, n01, n10, n11, dprime, r2,
    chisq, p, in_ld, same_phase (reference goes with reference). A SNP is a few words of bits (``haplotype_words``); a pair meets in the
    words both SNPs have, and its table sums up counts of common bits; nothing is joined or shuffled by sample and pair.

    A haplotype counts where both alleles are 0 or 1: missing alleles and further ones (``2|2``) are left out. A pair whose table is empty for that reason has counts of 0,
    no measures and ``in_ld`` false; one without any haplotype known for both SNPs is left out. Repeated pairs come out once.
    """
    words = pin(haplotype_words(genotypes).where("seen != 0"))
    parts = ("zero", "one", "seen")
    side = lambda k: by_shuffle(words.select(F.col("snp").alias(f"snp{k}"), "w", *[F.col(c).alias(f"{c}{k}") for c in parts]))
    both = pairs.select("snp1", "snp2").distinct().join(side(1), "snp1").join(side(2), ["snp2", "w"])

    def common(x: str, y: str) -> Column:
        return F.sum(F.bit_count(F.col(f"{x}1").bitwiseAND(F.col(f"{y}2"))).cast("long"))

    tables = [common(x, y).alias(f"n{i}{j}") for i, x in enumerate(("zero", "one")) for j, y in enumerate(("zero", "one"))]
    t = both.groupBy("snp1", "snp2").agg(common("seen", "seen").alias("_seen"), *tables)
    t = t.where("_seen > 0").drop("_seen")
    total = (F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")).cast("double")
    p0, q0 = F.try_divide(F.col("n00") + F.col("n01"), total), F.try_divide(F.col("n00") + F.col("n10"), total)
    d = F.try_divide(F.col("n00"), total) - p0 * q0
    t = t.withColumns({"_p": p0, "_q": q0, "_d": d, "_n": total})
    p, q, d = F.col("_p"), F.col("_q"), F.col("_d")
    bound = F.when(d < 0, F.least(p * q, (1 - p) * (1 - q))).otherwise(F.least(p * (1 - q), (1 - p) * q))
    t = t.withColumns(
        {"dprime": F.try_divide(F.abs(d), bound), "r2": F.try_divide(d * d, p * (1 - p) * q * (1 - q))}
    )
    t = t.withColumn("chisq", F.col("r2") * F.col("_n"))
    return t.withColumns(
        {"p": chi2_sf_1df(F.col("chisq")), "in_ld": F.coalesce(F.col("r2") > min_r2, F.lit(False)), "same_phase": d > 0}
    ).drop("_p", "_q", "_d", "_n")


def linked_allele(pairs: DataFrame, queries: DataFrame, on_error: str = "raise") -> DataFrame:
    """The allele of the partner SNP that goes with an allele: snp, allele, partner, partner_allele.

    ``pairs``: snp1, snp2, ref1, alt1, ref2, alt2, in_ld, same_phase; ``queries``: snp, allele. NULL when
    the pair is not linked. An allele the SNP does not have fails the job, or gets ``_bad`` set.
    """
    def side(a: int, b: int) -> Column:
        own = [F.col(f"ref{a}"), F.col(f"alt{a}")]
        other = [F.col(f"ref{b}"), F.col(f"alt{b}")]
        to_ref = F.when(F.col("same_phase"), other[0]).otherwise(other[1])
        to_alt = F.when(F.col("same_phase"), other[1]).otherwise(other[0])
        return F.struct(
            F.col(f"snp{a}").alias("snp"), F.col(f"snp{b}").alias("partner"), F.create_map(own[0], to_ref, own[1], to_alt).alias("lookup"),
            F.col("in_ld").alias("in_ld"),
        )

    sides = pairs.select(F.inline(F.array(side(1, 2), side(2, 1))))
    hit = queries.join(sides, "snp")
    allele = F.upper("allele")
    valid = F.map_contains_key("lookup", allele)
    found = F.when(F.col("in_ld"), F.element_at("lookup", allele))
    if on_error == "raise":
        bad = F.raise_error(F.concat_ws(" ", F.lit("no such allele:"), "snp", "allele")).cast("string")
        return hit.select("snp", "allele", "partner", F.when(valid, found).otherwise(bad).alias("partner_allele"))
    return hit.select("snp", "allele", "partner", found.alias("partner_allele"), (~valid).alias("_bad"))
