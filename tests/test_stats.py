import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions.stats import chi2_sf, erfc, student_t_quantile_975, student_t_two_sided
from lociframe.operators import curves, filters, sets, stats


def test_erfc(spark):
    df = spark.createDataFrame([(z / 7,) for z in range(-30, 45)], "z double").withColumn("e", erfc(F.col("z")))
    for r in df.collect():
        assert r.e == pytest.approx(math.erfc(r.z), rel=2e-7)


def test_distributions_at_table_values(spark):
    # Textbook quantiles.
    t = {1.0: 12.7062, 2.0: 4.30265, 5.0: 2.57058, 10.0: 2.22814, 30.0: 2.04227, 1000.0: 1.96234}
    df = spark.createDataFrame(list(t.items()), "dof double, want double")
    for r in df.select("want", student_t_quantile_975(F.col("dof")).alias("q"), student_t_two_sided(F.col("want"), F.col("dof")).alias("p")).collect():
        assert r.q == pytest.approx(r.want, abs=2e-4) and r.p == pytest.approx(0.05, abs=1e-5)
    big = spark.createDataFrame([(v,) for v in (1e4, 9e4, 2e5, 1e7, 1e12)], "dof double")
    for r in big.select("dof", student_t_quantile_975(F.col("dof")).alias("q"), student_t_two_sided(student_t_quantile_975(F.col("dof")), F.col("dof")).alias("p")).collect():
        z = 1.959963984540054  # Fixed value: the normal quantile, where t goes as the degrees of freedom grow.
        assert r.q == pytest.approx(z + (z**3 + z) / 4 / r.dof + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / r.dof**2, rel=1e-11)
        assert r.p == pytest.approx(0.05, rel=1e-9)
    chi = {1.0: 3.84146, 4.0: 9.48773, 30.0: 43.77297, 100.0: 124.34211}
    df = spark.createDataFrame(list(chi.items()), "dof double, x double")
    for r in df.select(chi2_sf(F.col("x"), F.col("dof")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-6)


def test_norm_effect_without_a_value_is_nan(spark):
    df = spark.createDataFrame([(0.5, 0.2), (0.2, 0.5), (0.3, 0.3), (1.0, 1.0)], "pre double, post double").withColumns({"prevar": F.lit(0.0), "postvar": F.lit(0.0)})
    both = [r.norm_effect for r in stats.norm_effect(df, "both").collect()]
    assert both[:3] == pytest.approx([0.6, -0.375, 0.0]) and math.isnan(both[3])
    assert [r.norm_effect for r in stats.norm_effect(df, "max").collect()][:2] == pytest.approx([0.6, -0.375])
    assert [r.norm_effect for r in stats.norm_effect(df, "min").collect()][:2] == pytest.approx([0.6, -1.5])
    assert all(math.isnan(r.bvari) for r in stats.effect_stderr(stats.norm_effect(df)).collect())


def _brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_mann_whitney(spark):
    r = random.Random(1)
    a = [r.randrange(12) for _ in range(60)] + [5] * 30
    b = [r.randrange(14) for _ in range(80)]
    to = lambda v: spark.createDataFrame([(x,) for x in v], "x long")
    got = stats.mannwhitney(to(a), to(b)).first()
    assert got.u == _brute_u(a, b)
    n1, n2, n = len(a), len(b), len(a) + len(b)
    ties = sum(c**3 - c for c in (sum(v == x for v in a + b) for x in set(a + b)))
    z = (abs(got.u - n1 * n2 / 2) - 0.5) / math.sqrt(n1 * n2 / 12 * (n + 1 - ties / n / (n - 1)))
    assert got.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)


def test_permutations_keep_sizes_and_do_not_depend_on_partitions(spark):
    one = spark.range(30).select(F.concat(F.lit("rs"), "id").alias("id"))
    two = spark.range(30, 100).select(F.concat(F.lit("rs"), "id").alias("id"))
    rows = stats.permute_labels(one, two, 4, seed=3).collect()
    again = stats.permute_labels(one.repartition(5), two.repartition(3), 4, seed=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for p in range(1, 5):
        first = {r.id for r in rows if r.perm == p and r["sample"] == 1}
        assert len(first) == 30 and first != {f"rs{i}" for i in range(30)}


def test_perm_stats_match_numpy(spark):
    r = random.Random(2)
    rows = [(k, p, r.random()) for k in "abc" for p in range(20)]
    df = spark.createDataFrame(rows, "k string, perm int, pldiff double")
    for x in stats.perm_stats(df, "k").collect():
        v = [q for k, _, q in rows if k == x.k]
        assert (x.min, x.max, x.mean, x.median, x.p95) == pytest.approx((min(v), max(v), np.mean(v), np.median(v), np.percentile(v, 95)))


def test_ols_against_normal_equations(spark):
    r = random.Random(3)
    pts = [(x := r.random() * 10, 3 * x - 2 + r.gauss(0, 1)) for _ in range(40)]
    df = spark.createDataFrame(pts, "x double, y double")
    fit = stats.ols(df)
    got = fit.first()
    X = np.column_stack([np.ones(40), [p[0] for p in pts]])
    y = np.array([p[1] for p in pts])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    cov = np.linalg.inv(X.T @ X) * ((y - X @ beta) ** 2).sum() / 38
    assert (got.intercept, got.slope) == pytest.approx(tuple(beta))
    assert (got.se_intercept, got.se_slope) == pytest.approx(tuple(np.sqrt(np.diag(cov))))
    assert got.p_slope < 1e-10
    band = stats.ols_bands(fit, 5).orderBy("i").collect()
    t = 2.024394  # Fixed value: 97.5 % point at 38 degrees of freedom.
    for b in band:
        v = np.array([1, b.x]) @ cov @ np.array([1, b.x])
        assert b.ci_hi - b.y == pytest.approx(t * math.sqrt(v), rel=1e-5)
        assert b.y - b.pred_lo == pytest.approx(t * math.sqrt(v + got.mse), rel=1e-5)


def test_pool_regression_recovers_mixture(spark):
    r = np.random.default_rng(4)
    k, n = 6, 500
    g = 1 - 0.5 * r.integers(0, 3, (n, k))
    truth = np.array([0.3, 0.25, 0.15, 0.1, 0.1, 0.1])
    post = g @ truth + r.normal(0, 0.01, n)
    rows = [(list(map(float, g[i])), float(post[i]), 50 + i % 30) for i in range(n)]
    df = spark.createDataFrame(rows, "genotypes array<double>, post double, depth long").repartition(5)
    fit = stats.pool_regression(df)
    keep = (post > 0.1) & (post < 0.9)
    w = np.array([x[2] for x in rows]) / (np.clip(post, 1e-4, 1 - 1e-4) * (1 - np.clip(post, 1e-4, 1 - 1e-4)))
    X, Y = (g[:, :-1] - g[:, -1:])[keep], (post - g[:, -1])[keep]
    W = w[keep]
    inv = np.linalg.inv((X * W[:, None]).T @ X)
    beta = inv @ ((X * W[:, None]).T @ Y)
    res = Y - X @ beta
    cov = inv * (W * res * res).sum() / (keep.sum() - k + 1)
    assert fit.rows == keep.sum() and fit.coefficients[:-1] == pytest.approx(tuple(beta)) and sum(fit.coefficients) == pytest.approx(1)
    assert np.array(fit.covariance)[: k - 1, : k - 1] == pytest.approx(cov)
    assert np.array(fit.covariance).sum(axis=1) == pytest.approx(np.zeros(k), abs=1e-12)
    mean = g.mean(axis=1)
    assert stats.pool_regression(df, means=(0.3, 0.7)).rows == (keep & (mean >= 0.3) & (mean <= 0.7)).sum()
    out = stats.pool_effects(df, fit).first()
    gi = np.array(out.genotypes)
    assert out.pre_var == pytest.approx(max(0.0, gi @ np.array(fit.covariance) @ gi))
    assert out.beta == pytest.approx(min(1, out.post) - min(1, gi @ np.array(fit.coefficients)))


@pytest.mark.parametrize("grid", [(15, 11), (40, 30)])
def test_density_against_direct_sum(spark, grid):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, 400)
    y = 0.6 * x + r.normal(0, 0.7, 400)
    df = spark.createDataFrame(list(zip(range(400), map(float, x), map(float, y))), "id long, x double, y double")
    nx, ny = grid
    dx, dy = (x.max() - x.min()) / (nx - 1), (y.max() - y.min()) / (ny - 1)
    ix, iy = np.floor((x - x.min()) / dx).astype(int), np.floor((y - y.min()) / dy).astype(int)
    cov = np.cov(ix, iy, bias=True)
    s = 400 ** (-1 / 6)
    kx, ky = (int(np.round(s * 2 * np.pi * np.sqrt(cov[i, i]))) for i in (0, 1))
    inv = np.linalg.inv(cov * s * s)
    want = np.zeros((ny, nx))
    for a, b in zip(ix, iy):
        for i in range(kx):
            for j in range(ky):
                p, q = a + i - kx // 2, b + j - ky // 2
                if 0 <= p < nx and 0 <= q < ny:
                    d = np.array([i - kx / 2, j - ky / 2])
                    want[q, p] += np.exp(-d @ inv @ d / 2)
    want /= 400 * dx * dy * np.sqrt(np.linalg.det(2 * np.pi * cov * s * s))
    got = np.zeros((ny, nx))
    rows = stats.density(df, grid=grid).collect()
    for c in rows:
        got[c.iy, c.ix] = c.density
    assert len(rows) == nx * ny and got == pytest.approx(want)
    at = {p.id: p.density for p in stats.point_density(df, grid=grid).collect()}
    assert at == pytest.approx({i: want[iy[i], ix[i]] for i in range(400)})


def test_ld_and_linked_alleles(spark):
    # Perfect linkage in opposite phase, and independence.
    rows = []
    for s in range(20):
        a, b = s % 2, (s // 2) % 2
        rows += [("rs1", f"S{s}", f"{a}|{b}"), ("rs2", f"S{s}", f"{1 - a}|{1 - b}"), ("rs3", f"S{s}", f"{(s // 4) % 2}|{(s // 4) % 2}")]
    g = spark.createDataFrame(rows, "snp string, sample string, gt string")
    pairs = spark.createDataFrame([("rs1", "rs2"), ("rs1", "rs3")], "snp1 string, snp2 string")
    ld = {r.snp2: r for r in stats.ld_pairs(g, pairs).collect()}
    assert ld["rs2"].r2 == pytest.approx(1) and ld["rs2"].dprime == pytest.approx(1) and ld["rs2"].in_ld and not ld["rs2"].same_phase
    assert ld["rs2"].chisq == pytest.approx(40) and ld["rs2"].p < 1e-8
    assert not ld["rs3"].in_ld
    table = stats.ld_pairs(g, pairs).withColumns({"ref1": F.lit("A"), "alt1": F.lit("C"), "ref2": F.lit("G"), "alt2": F.lit("T")})
    q = spark.createDataFrame([("rs1", "a"), ("rs2", "T")], "snp string, allele string")
    got = {(r.snp, r.partner): r.partner_allele for r in stats.linked_allele(table, q).collect()}
    assert got == {("rs1", "rs2"): "T", ("rs1", "rs3"): None, ("rs2", "rs1"): "A"}
    wrong = spark.createDataFrame([("rs1", "G")], "snp string, allele string")
    with pytest.raises(Exception, match="no such allele"):
        stats.linked_allele(table, wrong).collect()
    assert all(r._bad for r in stats.linked_allele(table, wrong, on_error="quarantine").collect())


def test_venn_regions_sum_to_distinct_ids(spark):
    s = [spark.createDataFrame([(x,) for x in v], "id long") for v in ([1, 2, 2, 3], [2, 3, 4], [3, 5])]
    got = {r.region: r.ids for r in sets.venn(s).collect()}
    assert got == {"100": 1, "110": 1, "111": 1, "010": 1, "001": 1}
    with pytest.raises(ValueError):
        sets.venn(s[:1])


def test_limits_and_log_filter(spark):
    df = spark.createDataFrame([(2.0, -1.0), (4.0, 1.0)], "x double, y double")
    r = curves.limits(df, 0.1).first()
    assert (r.x_lo, r.x_hi, r.y_lo, r.y_hi) == pytest.approx((2.2, 3.8, -1.2, 1.2)) and (r.lo, r.hi) == pytest.approx((-1.2, 3.8))
    bad = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (-1.0, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (10.0, 100.0)], "x double, y double")
    assert [(r.lx, r.ly) for r in filters.log_pairs(bad).orderBy("x").collect()] == [(0.0, 0.0), (1.0, 2.0)]
    assert filters.log_dropped(bad).first().dropped == 4


def test_mean_genotype_filter(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 1.0],), ([0.5, 0.0],)], "genotypes array<double>")
    assert [r.genotypes for r in filters.mean_genotype_filter(df).collect()] == [[0.5, 0.0]]


def test_degenerate_input(spark):
    from lociframe.operators import stats

    line = spark.createDataFrame([(float(k), 2.0 * k) for k in range(5)], "x double, y double")
    assert stats.pearson(line).first()["p"] < 1e-6
    rows = [("s1", "i1", "0|1"), ("s2", "i1", "0|1"), ("s1", "i2", ".|."), ("s2", "i2", "0|1"), ("s1", "i3", "0|0"), ("s2", "i3", ".|0")]
    found = stats.ld_pairs(spark.createDataFrame(rows, "snp string, sample string, gt string"), spark.createDataFrame([("s1", "s2")], "snp1 string, snp2 string")).first()
    assert (found["n00"], found["n01"], found["n10"], found["n11"]) == (2, 0, 0, 1)


def test_lines_without_errors_or_slopes(spark):
    def fit(points):
        return stats.ols(spark.createDataFrame(points, "x double, y double"))

    exact = fit([(float(i), 2.0 * i + 1) for i in range(8)])
    r = exact.first()
    assert (r.slope, r.intercept) == (2.0, 1.0) and r.p_slope < 1e-12 and stats.ols_bands(exact, 5).count() == 5
    for points in ([(1.0, 1.0), (2.0, 5.0)], [(3.0, 1.0), (3.0, 2.0), (3.0, 4.0)], []):
        r = fit(points).first()
        assert r.p_slope is None or math.isnan(r.p_slope)


@pytest.mark.parametrize("points", [[(1.0, 1.0), (1.0, 3.0)], [(2.0, 2.0)] * 3, []])
def test_density_of_points_without_area(spark, points):
    df = spark.createDataFrame(points, "x double, y double")
    cells = stats.density(df, grid=(6, 5)).collect()
    assert sorted((c.ix, c.iy) for c in cells) == [(i, j) for i in range(6) for j in range(5)] and all(math.isnan(c.density) for c in cells)
    assert stats.point_density(df, grid=(6, 5)).count() == len(points)


def test_ld_with_missing_and_further_alleles(spark):
    r = np.random.default_rng(3)
    cells = ["0|0", "0|1", "1|0", "1|1", "2|1", "0|2", "2|2", ".|0", ".|.", "0/1", None]
    rows = [(f"s{k}", f"P{j:03d}", str(r.choice(np.array(cells[:-1], object)))) for k in range(6) for j in range(150) if r.random() < 0.8]
    rows += [("two", f"P{j:03d}", "2|2") for j in range(40)] + [("none", "P001", ".|."), ("away", "elsewhere", "0|1"), rows[0], ("nil", "P001", None)]
    pairs = [(f"s{k}", f"s{j}") for k in range(6) for j in range(6)] + [("s0", "two"), ("two", "two"), ("s0", "none"), ("s0", "away"), ("s0", "unknown"), ("s0", "s1"), ("s0", "nil")]
    g = spark.createDataFrame(rows, "snp string, sample string, gt string").repartition(3)
    got = {(x.snp1, x.snp2): x for x in stats.ld_pairs(g, spark.createDataFrame(pairs, "snp1 string, snp2 string")).collect()}
    hap = {}
    for snp, sample, gt in rows:
        for i in (0, 1):
            part = (gt or "").split("|")
            hap.setdefault(snp, {})[sample, i] = int(part[i]) if len(part) > i and part[i].isdigit() else None
    for a, b in pairs:
        both = [(hap[a][k], hap[b][k]) for k in hap[a] if k in hap.get(b, {}) and hap[a][k] is not None and hap[b][k] is not None]
        if not both:
            assert (a, b) not in got
            continue
        n = [sum(p == q for p in both) for q in ((0, 0), (0, 1), (1, 0), (1, 1))]
        x = got[a, b]
        assert [x.n00, x.n01, x.n10, x.n11] == n
        if not sum(n):
            assert (x.dprime, x.r2, x.chisq, x.p, x.in_ld, x.same_phase) == (None, None, None, None, False, None)
    assert not any(v.in_ld for k, v in got.items() if "two" in k)
    assert stats.ld_pairs(g.limit(0), spark.createDataFrame(pairs, "snp1 string, snp2 string")).count() == 0


def test_haplotype_rows_are_one_a_snp(spark):
    g = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 4).alias("snp"), F.format_string("P%03d", "id").alias("sample"), F.lit("0|1").alias("gt"))
    rows = stats.haplotype_rows(g).collect()
    assert len(rows) == 4 and all(len(r.zero) == len(r.one) == len(r.seen) == 4 for r in rows)
    assert sum(bin(w & (2**64 - 1)).count("1") for r in rows for w in r.seen) == 200
    plan = stats.ld_pairs(g, spark.createDataFrame([("s0", "s1")], "snp1 string, snp2 string"))._jdf.queryExecution().executedPlan().toString()
    assert "sample" not in plan


def test_haplotype_words_grow_with_genotypes(spark):
    """Each SNP has two of many samples: its words do not grow with all samples."""
    cells = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 2000).alias("snp"), F.format_string("P%05d", "id").alias("sample"), F.lit("0|1").alias("gt"))
    rows = stats.haplotype_rows(cells).collect()
    assert len(rows) == 2000 and sum(len(r.seen) for r in rows) == stats.haplotype_words(cells).count() == 4000
    shared = cells.unionByName(cells.where("snp = 's0'").withColumn("snp", F.lit("t")))
    found = stats.ld_pairs(shared, spark.createDataFrame([("s0", "t"), ("s0", "s1")], "snp1 string, snp2 string")).collect()
    assert [(r.snp2, r.n00, r.n01, r.n10, r.n11) for r in found] == [("t", 2, 0, 0, 2)]


def test_degenerate_tests_have_values(spark):
    x = lambda *v: spark.createDataFrame([(float(i),) for i in v], "x double")
    assert tuple(stats.mannwhitney(x(1), x()).first()) == (1, 0, None, None)
    assert tuple(stats.mannwhitney(x(), x()).first()) == (0, 0, None, None)
    assert tuple(stats.mannwhitney(x(1), x(1)).first()) == (1, 1, 0.5, 1.0)
    bins = lambda *v: stats.chisq(spark.createDataFrame(list(v), "observed double, expected double")).first()
    assert tuple(bins((3.0, 0.0), (1.0, 2.0))) == (math.inf, 2, 0.0)
    assert tuple(bins((0.0, 0.0), (1.0, 2.0))) == (0.5, 1, None)
    assert tuple(bins()) == (None, 0, None)
    got = bins((8.0, 10.0), (12.0, 10.0), (10.0, 10.0))
    assert got.chisq == pytest.approx(0.8) and got.p == pytest.approx(math.exp(-0.4))


def test_pools_without_rows_or_reads(spark):
    df = spark.createDataFrame([([1.0, 0.5, 0.0], 0.95, 10), ([1.0, 0.5, 0.5], 0.5, 0)], "genotypes array<double>, post double, depth long")
    with pytest.raises(ValueError, match="no row to fit"):
        stats.pool_regression(df.where("post > 0.9"))
    fit = stats.PoolFit((0.2, 0.3, 0.5), ((0.0,) * 3,) * 3, 1)
    rows = {r.depth: r for r in stats.pool_effects(df, fit).collect()}
    assert rows[0].post_var == 1.0 and rows[0].z == pytest.approx(rows[0].beta) and rows[10].post_var < 1


def test_a_lookup_is_the_same_either_way(spark, monkeypatch):
    from lociframe.plans import lookups

    big = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(200)] + [(None, 1), (9, 2)], "k int, v int").repartition(4)
    small = spark.createDataFrame([(0, "a"), (1, "b"), (5, "z"), (None, "n")], "k int, name string")
    for how in ("inner", "left"):
        want = sorted(map(repr, big.join(small, "k", how).collect()))
        assert sorted(map(repr, lookups.lookup(big, small, ["k"], how).collect())) == want
        assert sorted(map(repr, lookups.lookup(big, small, ["k"], how, rows=0).collect())) == want
    with pytest.raises(ValueError):
        lookups.lookup(big, small, ["k"], "right")


def test_density_with_weights_and_extents(spark):
    r = np.random.default_rng(8)
    x, y, w = r.normal(0, 1, 300), r.normal(0, 2, 300), r.integers(0, 4, 300).astype(float)
    rows = [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, w))] + [(900, None, 1.0, 1.0), (901, 0.0, None, 1.0), (902, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, w double")
    box, (nx, ny) = (-1.5, 2.0, -3.0, 3.0), (20, 16)
    inside = (x >= -1.5) & (x <= 2) & (y >= -3) & (y <= 3)
    dx, dy = 3.5 / (nx - 1), 6 / (ny - 1)
    ix, iy = np.floor((x + 1.5) / dx).astype(int), np.floor((y + 3) / dy).astype(int)
    cov = np.cov(ix[inside], iy[inside], bias=True, aweights=w[inside])
    n = inside.sum()
    s = n ** (-1 / 6)
    kx, ky = (int(np.round(s * 2 * np.pi * np.sqrt(cov[i, i]))) for i in (0, 1))
    inv, want = np.linalg.inv(cov * s * s), np.zeros((ny, nx))
    for a, b, c in zip(ix[inside], iy[inside], w[inside]):
        for i in range(kx):
            for j in range(ky):
                gx, gy = a + i - kx // 2, b + j - ky // 2
                if 0 <= gx < nx and 0 <= gy < ny:
                    u = np.array([i - kx / 2, j - ky / 2])
                    want[gy, gx] += c * np.exp(-u @ inv @ u / 2)
    want /= n * dx * dy * np.sqrt(np.linalg.det(2 * np.pi * cov * s * s))
    got = {(c.ix, c.iy): c.density for c in stats.density(df, grid=(nx, ny), weights="w", extents=box).collect()}
    assert got == pytest.approx({(i, j): want[j, i] for i in range(nx) for j in range(ny)})
    at = {p.id: p.density for p in stats.point_density(df, grid=(nx, ny), weights="w", extents=box).collect()}
    assert len(at) == 303 and at[900] is None and at[901] is None
    for k in range(300):
        assert at[k] == (pytest.approx(want[iy[k], ix[k]]) if inside[k] else None)
