"""Registered queries: effects, permutations, tests, regression, density, linkage disequilibrium."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.stats import neglog10
from lociframe.operators import filters, sets, stats
from lociframe.plans.catalog_records import _names
from lociframe.plans.fixtures import view
from lociframe.plans.registry import Registry
from lociframe.plans.sql_parts import erfc

_MERGED = """select a.set_id, a.perm, abs(log10(a.p_value)-log10(b.p_value)) pldiff from (select * from {fx_enrich} where sample='sample_1') a
  join (select * from {fx_enrich} where sample='sample_2') b on a.set_id=b.set_id and a.perm=b.perm"""
_OBS = """select set_id, max(p) filter (sample='sample_1') p1, max(p) filter (sample='sample_2') p2,
  abs(log10(max(p) filter (sample='sample_1'))-log10(max(p) filter (sample='sample_2'))) pldiff
  from (select set_id, sample, avg(p_value) p from {fx_enrich} group by 1,2) s group by 1 having count(distinct sample)=2"""
_PSTAT = f"""select set_id, min(pldiff) mn, max(pldiff) mx, avg(pldiff) av, quantile_cont(pldiff,0.5) md, quantile_cont(pldiff,0.95) p95 from ({_MERGED}) m group by 1"""


def mwu(a: str, b: str) -> str:
    """U and p of two one-column (x) selects."""
    z = "(greatest(abs(u-n1*n2/2.0::double)-0.5,0)/sqrt(n1*n2/12.0::double*((n1+n2+1)-ties/((n1+n2)::double*(n1+n2-1))))/sqrt(2.0::double))"
    return f"""select n1, n2, u, least(1.0::double, {erfc(z)}) p from (
      select cast(sum(a) as bigint) n1, cast(sum(1-a) as bigint) n2, sum(rk*a)-sum(a)*(sum(a)+1)/2.0::double u, sum(t::double*t-1) ties from (
        select a, rank() over (order by x) + (count(*) over (partition by x)-1)/2.0::double rk, count(*) over (partition by x) t
        from (select x, 1 a from ({a}) s1 union all select x, 0 from ({b}) s2) u) r) q"""


_GENO = """select g.snp, g.sample, split_part(gt,'|',1)::int h1, split_part(gt,'|',2)::int h2, g.k from {fx_genotypes} g"""
VIEWS = {
    "sq_hap": f"""
select a.snp snp1, b.snp snp2, sum((1-a.h1)*(1-b.h1)+(1-a.h2)*(1-b.h2)) n00, sum((1-a.h1)*b.h1+(1-a.h2)*b.h2) n01,
  sum(a.h1*(1-b.h1)+a.h2*(1-b.h2)) n10, sum(a.h1*b.h1+a.h2*b.h2) n11
from ({_GENO}) a join ({_GENO}) b on b.k=a.k+1 and a.sample=b.sample group by 1,2""",
    "sq_ld": f"""
select *, r2*n chisq, {erfc('sqrt(r2*n/2)')} pv, coalesce(r2>0.1,false) in_ld, d>0 same_phase from (
  select *, case when (case when d<0 then least(p*q,(1-p)*(1-q)) else least(p*(1-q),(1-p)*q) end)=0 then null
      else abs(d)/(case when d<0 then least(p*q,(1-p)*(1-q)) else least(p*(1-q),(1-p)*q) end) end dprime,
    case when p*(1-p)*q*(1-q)=0 then null else d*d/(p*(1-p)*q*(1-q)) end r2 from (
    select *, n00/n-p*q d from (select *, (n00+n01)/n p, (n00+n10)/n q from (select *, (n00+n01+n10+n11)::double n from {{sq_hap}}) a) b) c) e""",
}
register = Registry(VIEWS)


def effects(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_effects")


_KEY = "l_orderkey, l_linenumber"
_FORMULA = {
    "both": "(pre-post)/(case when pre>post then pre else 1-pre end)",
    "max": "(pre-post)/greatest(pre,1-pre)",
    "min": "(pre-post)/least(pre,1-pre)",
}


@register(
    "norm_effect",
    " union all ".join(f"select {_KEY}, '{k}' formula, round({f},9)+0.0::double e from {{fx_effects}}" for k, f in _FORMULA.items()),
)
def norm_effect(spark, sf):
    every = effects(spark, sf)
    parts = [
        stats.norm_effect(every, by).select("l_orderkey", "l_linenumber", F.lit(by).alias("formula"), (F.round("norm_effect", 9) + 0.0).alias("e"))
        for by in ("both", "max", "min")
    ]
    return sets.concat_frames(parts)


_STDERR = f"""select *, sqrt(prevar+postvar) vari, (pre-post)/sqrt(prevar+postvar) z,
  case when pre=post then null else abs({_FORMULA['both']}/((pre-post)/sqrt(prevar+postvar))) end stddev, {_FORMULA['both']} e from {{fx_effects}}"""


@register("effect_stderr", f"select {_KEY}, round(vari,9) vari, round(z,9) z, round(stddev,9) stddev, round(sqrt(stddev),9) bvari from ({_STDERR}) s")
def effect_stderr(spark, sf):
    df = stats.effect_stderr(stats.norm_effect(effects(spark, sf)))
    cols = [F.round(F.nullif(c, F.lit(float("nan"))), 9).alias(c) for c in ("vari", "z", "stddev", "bvari")]
    return df.select("l_orderkey", "l_linenumber", *cols)


@register(
    "normalize_effects",
    f"""select s.l_orderkey, s.l_linenumber, concat(s.chrom,'.',s.pos) snp, n.name, 'POP' pop, round(s.e,9)+0.0::double norm_effect, round(sqrt(stddev),9) bvari,
          n.name is not null and stddev is not null in_betas
        from ({_STDERR} where pre>0.02 and pre<0.98) s left join {{fx_snps}} n on s.chrom=n.chrom and s.pos=n.pos""",
)
def normalize_effects(spark, sf):
    path = F.lit("/data/POP.effects.txt.gz")
    full, betas = stats.normalize_effects(effects(spark, sf).withColumn("pop", stats.population_of(path)), _names(spark, sf))
    out = full.withColumn("in_betas", F.col("name").isNotNull() & ~F.isnan("stddev"))
    return out.select(
        "l_orderkey", "l_linenumber", "snp", "name", "pop", (F.round("norm_effect", 9) + 0.0).alias("norm_effect"),
        F.round(F.nullif("bvari", F.lit(float("nan"))), 9).alias("bvari"), "in_betas",
    )


@register("log10_transform", "select label, round(log10(p),9) l, round(-log10(p),9) nl from (select concat(chrom,'.',pos) label, p from {fx_points}) a")
def log10_transform(spark, sf):
    return view(spark, sf, "fx_points").select(
        F.concat_ws(".", "chrom", "pos").alias("label"), F.round(F.log10("p"), 9).alias("l"), F.round(neglog10("p"), 9).alias("nl")
    )


@register(
    "permute_labels",
    """with u as (select concat('rs',p_partkey) id, 1 l from {part} where p_size<20 union all select concat('rs',p_partkey), 2 from {part} where p_size>=20)
       select perm, id, case when row_number() over (partition by perm order by md5(concat(id,':',l,':',perm,':7')), id)<=(select count(*) from u where l=1) then 1 else 2 end sample
       from u cross join (select unnest(range(1,6))::int perm) pp""",
)
def permute_labels(spark, sf):
    ids = view(spark, sf, "part").select(F.concat(F.lit("rs"), "p_partkey").alias("id"), "p_size")
    return stats.permute_labels(ids.where("p_size < 20"), ids.where("p_size >= 20"), 5, seed=7)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return sets.merge_samples(view(spark, sf, "fx_enrich"), "sample_1", "sample_2", ["set_id", "perm"])


def observed(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_enrich").groupBy("set_id", "sample").agg(F.avg("p_value").alias("p_value"))


@register(
    "perm_pivot_stats",
    f"""select set_id, round(mn,9) "min", round(mx,9) "max", round(av,9) mean, round(md,9) median, round(p95,9) p95, """
    + ", ".join(f'm{i} "{i}"' for i in range(1, 8))
    + f" from ({_PSTAT}) p join (select set_id, "
    + ", ".join(f"round(max(pldiff) filter (perm={i}),9) m{i}" for i in range(1, 8))
    + f" from ({_MERGED}) mm group by 1) w using (set_id)",
)
def perm_pivot_stats(spark, sf):
    m = merged(spark, sf)
    matrix = stats.perm_matrix(m, "set_id", range(1, 8))
    df = stats.perm_stats(m, "set_id").join(matrix, "set_id")
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 9) for c in df.columns if c != "set_id"})


@register(
    "beats_permutation",
    f"""select o.set_id, round(pldiff,9) pldiff, round(mx,9) max_pldiff_perms, round(p95,9) p95_pldiff_perms, pldiff>mx beats_perm, pldiff>p95 beats_perm95
        from ({_OBS}) o join ({_PSTAT}) p on o.set_id=p.set_id""",
)
def beats_permutation(spark, sf):
    obs = sets.merge_samples(observed(spark, sf), "sample_1", "sample_2", ["set_id"])
    df = stats.beats_perm(obs, stats.perm_stats(merged(spark, sf), "set_id"), "set_id")
    cols = [F.round(c, 9).alias(c) for c in ("pldiff", "max_pldiff_perms", "p95_pldiff_perms")]
    return df.select("set_id", *cols, "beats_perm", "beats_perm95")


@register(
    "perm_significance",
    f"""select o.set_id, round(p1,9) sample_1_p_value, round(p2,9) sample_2_p_value, round(o.pldiff,9) pldiff, round(mx,9) max_pldiff_perms, round(md,9) median_pldiff_perms,
          round(av,9) mean_pldiff_perms, round(p95,9) p95_pldiff_perms, o.pldiff>mx beats_perm, o.pldiff>p95 beats_perm95, t.u mannw_u, round(t.p,9) mannw_p
        from ({_OBS}) o join ({_PSTAT}) p on o.set_id=p.set_id,
          ({mwu(f'select pldiff x from ({_OBS}) w', f'select pldiff x from ({_MERGED}) v')}) t""",
)
def perm_significance(spark, sf):
    df = stats.examine(observed(spark, sf), view(spark, sf, "fx_enrich"), "set_id")
    rounded = [c for c, t in df.dtypes if t == "double" and c != "mannw_u" and "log10" not in c and c != "pdiff"]
    return df.select("set_id", *[F.round(c, 9).alias(c) for c in rounded], "beats_perm", "beats_perm95", "mannw_u")


@register(
    "mann_whitney_u",
    "select n1, n2, u, round(p,9) p from ("
    + mwu("select l_quantity x from {lineitem} where l_returnflag='A'", "select l_quantity x from {lineitem} where l_returnflag<>'A'")
    + ") m",
)
def mann_whitney_u(spark, sf):
    li = view(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), "l_returnflag")
    return stats.mannwhitney(li.where("l_returnflag = 'A'"), li.where("l_returnflag <> 'A'")).withColumn("p", F.round("p", 9))


# Upper tail of chi-square: a finite sum for even degrees of freedom, with a normal tail in front for odd ones.
_CHI = (
    "(case when dof%2=1 then " + erfc("sqrt(x/2)") + " else 0 end + coalesce(list_sum(list_transform(range(0, dof//2), "
    "lambda j: exp(-x/2+(j+(dof%2)/2.0::double)*ln(x/2)-lgamma(j+1+(dof%2)/2.0::double)))), 0))"
)


@register(
    "chi_square_gof",
    f"""select round(x,6) chisq, bins, round(least(1.0::double,{_CHI}),6) p from (select sum((o-e)*(o-e)/e) x, count(*) bins, count(*)-1 dof
          from (select count(*)::double o, avg(count(*)) over () e from {{lineitem}} group by l_suppkey) a) b""",
)
def chi_square_gof(spark, sf):
    per = view(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("observed"))
    df = per.withColumn("expected", per.select(F.avg("observed")).scalar())
    return stats.chisq(df).select(F.round("chisq", 6).alias("chisq"), "bins", F.round("p", 6).alias("p"))


# The tail of Student's t through the normal one (Wallace's transform), good to 1e-8 at these dof.
_TAIL = "((8*dof+1)/(8*dof+3)*sqrt(dof*ln(1+r*r/(1-r*r)))/sqrt(2.0::double))"


@register(
    "pearson",
    f"""select round(r,9) r, n, round({erfc(_TAIL)},6) p from (select *, (n-2)::double dof from (
          select corr(l_extendedprice,l_quantity) r, count(*) n from {{lineitem}}) a) b""",
)
def pearson(spark, sf):
    li = view(spark, sf, "lineitem")
    return stats.pearson(li, "l_extendedprice", "l_quantity").withColumns({"r": F.round("r", 9), "p": F.round("p", 6)})


# Student's t from the normal quantile by its expansion in 1/dof, good to 1e-9 at the dof of these tables.
_Z = 1.959963984540054
_TQ = (
    f"({_Z}::double+({_Z**3 + _Z}/4)/dof+({5 * _Z**5 + 16 * _Z**3 + 3 * _Z}/96)/(dof*dof)"
    f"+({3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z}/384)/(dof*dof*dof))"
)


@register(
    "ols_fit",
    f"""select i::bigint i, round(x,6) x, round(y,3) y, round(y-c,2) ci_lo, round(y+c,2) ci_hi, round(y-pw,2) pred_lo, round(y+pw,2) pred_hi, round(slope,5) slope,
          round(intercept,3) intercept, round(r2,9) r2, round(se_slope,5) se_slope, round(se_intercept,3) se_intercept from (
        select *, intercept+slope*x y, {_TQ}*sqrt(mse*(1/n+(x-xm)*(x-xm)/sxx)) c, {_TQ}*sqrt(mse*(1+1/n+(x-xm)*(x-xm)/sxx)) pw from (
          select *, x0+(x1-x0)*i/49 x, sqrt(mse/sxx) se_slope, sqrt(mse*(1/n+xm*xm/sxx)) se_intercept, n-2 dof from (
            select *, syy*(1-r2)/(n-2) mse from (
              select regr_count(l_extendedprice,l_quantity)::double n, regr_slope(l_extendedprice,l_quantity) slope, regr_intercept(l_extendedprice,l_quantity) intercept,
                regr_r2(l_extendedprice,l_quantity) r2, regr_sxx(l_extendedprice,l_quantity) sxx, regr_syy(l_extendedprice,l_quantity) syy, avg(l_quantity) xm,
                min(l_quantity) x0, max(l_quantity) x1 from {{lineitem}}) a) b, (select unnest(range(0,50)) i) g) c) d""",
)
def ols_fit(spark, sf):
    fit = stats.ols(view(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    bands = stats.ols_bands(fit, 50)
    cells = {c: fit.select(c).scalar() for c in ("slope", "intercept", "r2", "se_slope", "se_intercept")}
    return bands.withColumns(cells).select(
        F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"), F.round("y", 3).alias("y"),
        *[F.round(c, 2).alias(c) for c in ("ci_lo", "ci_hi", "pred_lo", "pred_hi")],
        F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 9).alias("r2"),
        F.round("se_slope", 5).alias("se_slope"), F.round("se_intercept", 3).alias("se_intercept"),
    )


# Pooled frequencies: three individuals' genotypes per row of lineitem.
_POOL = """select l_orderkey, l_linenumber, l_tax*12 post, l_quantity depth, 1-0.5*cast(l_partkey%3 as int) g1, 1-0.5*cast(l_suppkey%3 as int) g2,
  1-0.5*cast(floor(l_partkey/3)%3 as int) g3 from {lineitem}"""
_W = "depth/(least(0.9999::double,greatest(post,0.0001::double))*(1-least(0.9999::double,greatest(post,0.0001::double))))"
# Two unknowns, solved in closed form.
_WLS = f"""select *, (s22*t1-s12*t2)/det b1, (s11*t2-s12*t1)/det b2, (yy-((s22*t1-s12*t2)/det)*t1-((s11*t2-s12*t1)/det)*t2)/(n-2) s2 from (
  select *, s11*s22-s12*s12 det from (
    select sum(w*a*a) s11, sum(w*a*b) s12, sum(w*b*b) s22, sum(w*a*y) t1, sum(w*b*y) t2, sum(w*y*y) yy, count(*) n
    from (select (g1-g3)::double a, (g2-g3)::double b, (post-g3)::double y, {_W} w from ({_POOL}) p where post>0.1 and post<0.9 and (g1+g2+g3)/3 between 0.01 and 0.99) q) r) s"""


def pooled(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_POOL, lineitem=view(spark, sf, "lineitem"))
    return rows.withColumn("genotypes", F.array(*[F.col(f"g{i}").cast("double") for i in (1, 2, 3)]))


@register("wls_multi", f"select n, round(b1,8) b1, round(b2,8) b2, round(1-b1-b2,8) b3, round(s2*s22/det,12) v11, round(-s2*s12/det,12) v12, round(s2*s11/det,12) v22 from ({_WLS}) f")
def wls_multi(spark, sf):
    fit = stats.pool_regression(pooled(spark, sf), means=stats.MEAN_RANGE)
    b, v = fit.coefficients, fit.covariance
    row = (fit.rows, round(b[0], 8), round(b[1], 8), round(b[2], 8), round(v[0][0], 12), round(v[0][1], 12), round(v[1][1], 12))
    return spark.createDataFrame([row], "n long, b1 double, b2 double, b3 double, v11 double, v12 double, v22 double")


@register(
    "wls_predict",
    f"""select l_orderkey, l_linenumber, round(pre,8) pre, round(pre_var,10) pre_var, round(post_var,10) post_var, round(least(1,post)-pre,8) beta,
          round(sqrt(pre_var+post_var),8) vari, round((least(1,post)-pre)/sqrt(pre_var+post_var),6) z from (
        select p.*, least(1,g1*b1+g2*b2+g3*(1-b1-b2)) pre, least(1,1/({_W})) post_var,
          greatest(0,s2/det*(s22*(g1-g3)*(g1-g3)-2*s12*(g1-g3)*(g2-g3)+s11*(g2-g3)*(g2-g3))) pre_var from ({_POOL}) p, ({_WLS}) f) x""",
)
def wls_predict(spark, sf):
    rows = pooled(spark, sf)
    df = stats.pool_effects(rows, stats.pool_regression(rows, means=stats.MEAN_RANGE))
    return df.select(
        "l_orderkey", "l_linenumber", F.round("pre", 8).alias("pre"), F.round("pre_var", 10).alias("pre_var"), F.round("post_var", 10).alias("post_var"),
        F.round("beta", 8).alias("beta"), F.round("vari", 8).alias("vari"), F.round("z", 6).alias("z"),
    )


_GRID, _FINE = (24, 20), (400, 400)


def _kernel(grid: tuple[int, int], x: str = "o_totalprice", y: str = "o_custkey::double", w: str = "1.0::double", extents: tuple[float, float, float, float] | None = None) -> str:
    """CTEs px (points with their cell), c (cells), k (covariance and size of the kernel)."""
    x0, x1, y0, y1 = [f"{v}::double" for v in extents] if extents else ["min(x) over ()", "max(x) over ()", "min(y) over ()", "max(y) over ()"]
    return f"""px as (select o_orderkey, pw, floor((x-x0)/dx)::bigint ix, floor((y-y0)/dy)::bigint iy, dx, dy from (
          select *, (x1-x0)/{grid[0] - 1} dx, (y1-y0)/{grid[1] - 1} dy from (select *, {x0} x0, {x1} x1, {y0} y0, {y1} y1 from (select o_orderkey, {x} x, {y} y, {w} pw from {{orders}}) a) b
          where x between x0 and x1 and y between y0 and y1) d),
        c as (select ix, iy, sum(pw) w, count(*) n, any_value(dx) dx, any_value(dy) dy from px group by 1,2),
        m as (select sum(n)::double n, sum(w) sw, any_value(dx) dx, any_value(dy) dy, sum(w*ix) mx, sum(w*iy) my, sum(w*ix*ix) xx, sum(w*ix*iy) xy, sum(w*iy*iy) yy from c),
        v as (select n, dx, dy, pow(n,-1.0/6) s, (xx-mx/sw*mx)/sw xx, (xy-mx/sw*my)/sw xy, (yy-my/sw*my)/sw yy from m),
        k as (select *, n*dx*dy*2*pi()*s*s*sqrt(xx*yy-xy*xy) nrm, xx*yy-xy*xy det, round_even(s*2*pi()*sqrt(xx),0)::bigint kx, round_even(s*2*pi()*sqrt(yy),0)::bigint ky from v)"""


# A cell's share of the density di, dj cells away.
_SHARE = "exp(-(yy*u*u-2*xy*u*v+xx*v*v)/det/(s*s)/2)"


def _grid_sql(grid: tuple[int, int], **options) -> str:
    return f"""with {_kernel(grid, **options)},
        t as (select gx, gy, w*{_SHARE} e from (select gx, gy, k.*, w, gx-c.ix+kx//2-kx/2.0::double u, gy-c.iy+ky//2-ky/2.0::double v from c, k, (select unnest(range(0,{grid[0]})) gx) a, (select unnest(range(0,{grid[1]})) gy) b
          where gx-c.ix+kx//2 between 0 and kx-1 and gy-c.iy+ky//2 between 0 and ky-1) q)
        select gx ix, gy iy, round(coalesce(sum(e),0)/(select nrm from k)*1e9,5) density from (select unnest(range(0,{grid[0]})) gx) a cross join (select unnest(range(0,{grid[1]})) gy) b left join t using (gx, gy) group by 1,2"""


@register("kde_2d", _grid_sql(_GRID))
def kde_2d(spark, sf):
    df = stats.density(view(spark, sf, "orders"), "o_totalprice", "o_custkey", _GRID)
    return df.withColumn("density", F.round(F.col("density") * 1e9, 5))


_EXTENTS = (20_000.0, 300_000.0, 10.0, 1_400.0)


@register("kde_2d_weighted", _grid_sql(_GRID, w="(o_orderkey%5)/2.0::double", extents=_EXTENTS))
def kde_2d_weighted(spark, sf):
    """With a weight for every point, over a part of the plane."""
    points = view(spark, sf, "orders").withColumn("w", F.col("o_orderkey") % 5 / 2)
    df = stats.density(points, "o_totalprice", "o_custkey", _GRID, weights="w", extents=_EXTENTS)
    return df.withColumn("density", F.round(F.col("density") * 1e9, 5))


@register(
    "kde_2d_points",
    f"""with {_kernel(_FINE)},
        d as (select ax, ay, sum(w*{_SHARE}) e from (select a.ix ax, a.iy ay, k.*, c.w, a.ix-c.ix+kx//2-kx/2.0::double u, a.iy-c.iy+ky//2-ky/2.0::double v
          from c a cross join k join c on c.ix between a.ix+kx//2-(kx-1) and a.ix+kx//2 and c.iy between a.iy+ky//2-(ky-1) and a.iy+ky//2) q group by 1,2)
        select o_orderkey, round(e/(select nrm from k)*1e9,5) density from px join d on ax=ix and ay=iy""",
)
def kde_2d_points(spark, sf):
    """Density at each point on the default 400 x 400 grid."""
    points = view(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    df = stats.point_density(points, "o_totalprice", "o_custkey", _FINE)
    return df.select("o_orderkey", F.round(F.col("density") * 1e9, 5).alias("density"))


def adjacent(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "part").select(
        F.concat(F.lit("rs"), "p_partkey").alias("snp1"), F.concat(F.lit("rs"), F.col("p_partkey") + 1).alias("snp2")
    )


def ld(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ld_pairs(view(spark, sf, "fx_genotypes"), adjacent(spark, sf))


_LD = "snp1, snp2, cast(n00 as bigint) n00, cast(n01 as bigint) n01, cast(n10 as bigint) n10, cast(n11 as bigint) n11, round(dprime,9) dprime, round(r2,9) r2, round(chisq,9) chisq, round(pv,9) p, in_ld, same_phase"


def _rounded_ld(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("dprime", "r2", "chisq", "p")})


@register("ld_pairs", f"select {_LD} from {{sq_ld}}")
def ld_pairs(spark, sf):
    return _rounded_ld(ld(spark, sf))


@register("r2_cutoff", f"select {_LD} from {{sq_ld}} where r2>=0.3")
def r2_cutoff(spark, sf):
    return _rounded_ld(filters.r2_cutoff(ld(spark, sf), 0.3))


@register(
    "ld_linked_allele",
    """select q.name snp, lower(q.ref_allele) allele, case when q.name=l.snp1 then l.snp2 else l.snp1 end partner,
         case when not in_ld then null when same_phase then o.ref_allele else o.alt_allele end partner_allele
       from {fx_snps} q join {sq_ld} l on q.name in (l.snp1, l.snp2) join {fx_snps} o on o.name=case when q.name=l.snp1 then l.snp2 else l.snp1 end""",
)
def ld_linked_allele(spark, sf):
    snps = view(spark, sf, "fx_snps")
    sides = [snps.select(F.col("name").alias(f"snp{i}"), F.col("ref_allele").alias(f"ref{i}"), F.col("alt_allele").alias(f"alt{i}")) for i in (1, 2)]
    pairs = ld(spark, sf).join(sides[0], "snp1").join(sides[1], "snp2")
    queries = snps.select(F.col("name").alias("snp"), F.lower("ref_allele").alias("allele"))
    return stats.linked_allele(pairs, queries)
