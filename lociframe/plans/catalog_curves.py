"""Registered queries: peaks and other order-dependent groups, curves and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.stats import c_pow
from lociframe.operators import curves, ordered
from lociframe.plans.fixtures import view
from lociframe.plans.registry import Registry

# Peaks in order with the decision each one can make by itself, then the cluster fold along every chromosome.
VIEWS = {
    "sq_peak": """
select *, coalesce(pstart < prev_end - 4, false) op, coalesce(next_start < pend - 4, false) onx, next_start is null last_,
  row_number() over (partition by chrom order by pstart, pend, event_id) rn
from (select *, lag(pend) over (partition by chrom order by pstart, pend, event_id) prev_end,
        lead(pstart) over (partition by chrom order by pstart, pend, event_id) next_start from {fx_peaks}) a""",
    "sq_kind": """
select *, case when last_ then case when prev_end is not null and pstart-4<prev_end then 1 else 0 end when not op then 0 when onx then 2 else 1 end kind from {sq_peak}""",
}
register = Registry(VIEWS)

_FOLD = """with recursive fold as (
  select chrom, rn, pstart cs, pend ce, 1::bigint cl, 1::bigint cnt, fold f, l10p l, pop from {sq_kind} where rn=1
  union all
  select k.chrom, k.rn, case when j then cs else pstart end, case when j then greatest(ce, pend) else pend end, case when j then cl else cl+1 end,
    case when j then cnt+1 else 1 end, case when j then (f+k.fold)/2 else k.fold end, case when j then (l+k.l10p)/2 else k.l10p end, k.pop
  from (select k.*, fo.cs, fo.ce, fo.cl, fo.cnt, fo.f, fo.l,
          kind=1 or (kind=2 and abs((k.prev_end-k.pstart)::double/(fo.cs-fo.ce))>0.75) j
        from fold fo join {sq_kind} k on k.chrom=fo.chrom and k.rn=fo.rn+1) k)
"""


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_peaks").select(
        "chrom", F.col("pstart").alias("start"), F.col("pend").alias("end"), F.col("event_id").alias("key"), "pop", "fold", "l10p"
    )


@register(
    "peak_islands",
    """select event_id "key", chrom, op overlaps_prev, onx overlaps_next,
         cast(sum(case when op then 0 else 1 end) over (order by chrom, pstart, pend, event_id) as bigint) island from {sq_peak}""",
)
def peak_islands(spark, sf):
    return ordered.peak_flags(peaks(spark, sf)).select("key", "chrom", "overlaps_prev", "overlaps_next", "island")


@register(
    "peak_cluster",
    _FOLD
    + """select chrom, cs "start", max(ce) "end", max(cnt) "count", round(max_by(f, rn),6) fold, round(max_by(l, rn),6) l10p, concat(chrom,'_',cs) name
       from fold group by chrom, cl, cs""",
)
def peak_cluster(spark, sf):
    out = ordered.peak_merge(peaks(spark, sf)).drop("cluster")
    return out.withColumns({"fold": F.round("fold", 6), "l10p": F.round("l10p", 6)})


@register(
    "cluster_stats",
    _FOLD
    + """, per as (select chrom, cl, count(*) size, count(*)-count(distinct split_part(pop,'_',1)) extra from fold group by 1,2)
       select 'size' measure, size "value", count(*) clusters from per group by 2
       union all select 'extra', extra, count(*) from per where extra>0 group by 2""",
)
def cluster_stats(spark, sf):
    return ordered.cluster_stats(ordered.peak_merge(peaks(spark, sf), by_row=True))


@register(
    "group_consecutive",
    """select cast(g as bigint) "group", k event_type, count(*) rows_, min(event_id) first_, max(event_id) last_ from (
         select event_id, event_type k, sum(c) over (order by event_id) g from (
           select event_id, event_type, case when event_type=lag(event_type) over (order by event_id) then 0 else 1 end c from {events}) a) b group by 1,2""",
)
def group_consecutive(spark, sf):
    runs = ordered.grouped(view(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id")
    return runs.groupBy("group", "event_type").agg(
        F.count(F.lit(1)).alias("rows_"), F.min("event_id").alias("first_"), F.max("event_id").alias("last_")
    )


@register("apply_per_group")
def apply_per_group(spark, sf):
    """Per run of equal event types, the span of its values: the hook over groups, by arrays as runs are short."""
    runs = ordered.grouped(view(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "event_id")

    def span(run):
        v = run["value"]
        v = v[v == v]  # missing values take no part
        return run["group"][0], float(v.max() - v.min()) if len(v) else None

    return ordered.apply_per_group(runs, "group", span, "group long, span double", arrays=True)


@register(
    "pick_causal",
    """select snp, peak, round(prior,6) prior, round(posterior,9) posterior, case when posterior>0.9 then 'Y' else 'N' end causal,
         n>1 and c>0 kept from (select *, count(*) over (partition by peak) n, count(*) filter (posterior>0.9) over (partition by peak) c from {fx_dap}) a""",
)
def pick_causal(spark, sf):
    dap = view(spark, sf, "fx_dap")
    kept = ordered.pick_causal(dap, exclude=True).select("snp", F.lit(True).alias("kept"))
    every = ordered.pick_causal(dap).join(kept, "snp", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return every.withColumns({"prior": F.round("prior", 6), "posterior": F.round("posterior", 9)})


@register(
    "causal_stats",
    """select c causal_snps, count(*) peaks, count(*) filter (n=1) singletons from (
         select peak, count(*) n, count(*) filter (posterior>0.9) c from {fx_dap} group by 1) a group by 1""",
)
def causal_stats(spark, sf):
    return ordered.causal_stats(view(spark, sf, "fx_dap"))


_RANK = "case lower(replace(chrom,'chr','')) when 'x' then 98 when 'y' then 99 when 'mt' then 100 else try_cast(replace(chrom,'chr','') as int) end"


@register(
    "cumulative_position",
    f"""select p.chrom, p.pos, p.p, o+p.pos x, round(-log10(p.p),9) y, o+(lo+hi)/2.0::double label_x from {{fx_points}} p join (
          select chrom, lo, hi, cast(coalesce(sum(hi) over (order by {_RANK} rows between unbounded preceding and 1 preceding),0) as bigint) o
          from (select chrom, min(pos) lo, max(pos) hi from {{fx_points}} group by 1) a) c on p.chrom=c.chrom""",
)
def cumulative_position(spark, sf):
    return curves.manhattan(view(spark, sf, "fx_points")).withColumn("y", F.round("y", 9)).select("chrom", "pos", "p", "x", "y", "label_x")


def two_p(spark: SparkSession, sf: str) -> DataFrame:
    """Two p-values per point."""
    return view(spark, sf, "fx_points").select(
        F.concat_ws(".", "chrom", "pos").alias("label"), F.pow("p", F.lit(4.0)).alias("x"), F.pow(F.expr("(pos*11%997+1)/997.0D"), F.lit(4.0)).alias("y")
    )


_TWO_P = "select concat(chrom,'.',pos) label, pow(p,4) x, pow((pos*11%997+1)/997.0::double,4) y from {fx_points}"


@register(
    "significance_line",
    f"""select label, case when x<=l and y<=l then 'both' when x<=l or y<=l then 'either' else 'none' end sig, round(-log10(l),9) line
        from ({_TWO_P}) a, (select 0.05::double/count(*) l from {{fx_points}}) b""",
)
def significance_line(spark, sf):
    line = curves.significance_line(view(spark, sf, "fx_points")).scalar()
    return curves.sig_flags(two_p(spark, sf)).select("label", "sig", F.round(line, 9).alias("line"))


def _pick(name: str, order: str, n: int, rank: int, before: list[str]) -> str:
    gone = "".join(f" and label not in (select label from {b})" for b in before)
    return f"{name} as (select label, x, y, {rank} rank from tp where true{gone} order by {order}, label, x, y limit {n})"


@register(
    "label_topk",
    f"with tp as ({_TWO_P}), "
    + ", ".join(
        [
            _pick("p1", "x*y", 2, 1, []),
            _pick("p2", "1/(x*y)*pow(10.0::double,abs(log10(x)-log10(y))) desc", 22, 2, ["p1"]),
            _pick("p3", "log10(x)-log10(y)", 8, 3, ["p1", "p2"]),
            _pick("p4", "-(log10(x)-log10(y))", 8, 4, ["p1", "p2", "p3"]),
        ]
    )
    + " select label, rank from (" + " union all ".join(f"select * from p{i}" for i in range(1, 5)) + ") u",
)
def label_topk(spark, sf):
    # Powers by the C library: picks hang on the last bit.
    points = view(spark, sf, "fx_points").select(
        F.concat_ws(".", "chrom", "pos").alias("label"), c_pow(F.col("p"), F.lit(4.0)).alias("x"), c_pow(F.expr("(pos*11%997+1)/997.0D"), F.lit(4.0)).alias("y")
    )
    return curves.pick_labels(points, 40).select("label", "rank")


@register(
    "quantile_bins",
    """select distinct round(o_totalprice,6) edge from (select o_totalprice, row_number() over (order by o_totalprice)-1 r, count(*) over () n from {orders}) a
       where r=0 or r=n-1 or r in (select i*n//40 from (select unnest(range(1,40)) i) x)""",
)
def quantile_bins(spark, sf):
    return curves.uniform_bins(view(spark, sf, "orders"), "o_totalprice", 40).select(F.round("edge", 6).alias("edge"))


_A = "select l_extendedprice x from {lineitem} where l_returnflag='A'"
_B = "select l_extendedprice x from {lineitem} where l_returnflag<>'A'"


def series(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = view(spark, sf, "lineitem")
    x = F.col("l_extendedprice").alias("x")
    return li.where("l_returnflag = 'A'").select(x), li.where("l_returnflag <> 'A'").select(x)


@register(
    "linear_bins",
    f"""select cast(i as bigint) i, round(lo+(hi-lo)*i/25,6) edge from (select min(x)*0.99 lo, max(x)*1.01 hi from ({_A} union all {_B}) u) e, (select unnest(range(0,26)) i) g""",
)
def linear_bins(spark, sf):
    a, b = series(spark, sf)
    return curves.linear_bins(a, b, 25).withColumn("edge", F.round("edge", 6))


@register(
    "cumulative_frequency",
    f"""with e as (select min(x)*0.99 lo, max(x)*1.01 hi from ({_A} union all {_B}) u), ed as (select i, lo+(hi-lo)*i/25 edge from e, (select unnest(range(0,26)) i) g),
        bn as (select a.i+1 bin, a.edge lo, b.edge hi from ed a join ed b on b.i=a.i+1), xa as ({_A}), xb as ({_B})
        select bin, round((lo+hi)/2,6) mid, round((select count(*) from xa where x<=hi and x>(select min(edge) from ed))/(select count(*)::double from xa),9) cum_a,
          round((select count(*) from xb where x<=hi and x>(select min(edge) from ed))/(select count(*)::double from xb),9) cum_b from bn""",
)
def cumulative_frequency(spark, sf):
    a, b = series(spark, sf)
    curve = curves.pp_curve(a, b, curves.linear_bins(a, b, 25))
    return curve.withColumns({"mid": F.round("mid", 6), "cum_a": F.round("cum_a", 9), "cum_b": F.round("cum_b", 9)})


@register(
    "qq_curve",
    f"""select i, round((select quantile_cont(-log10(x), i/50.0::double) from ({_A}) a),6) a, round((select quantile_cont(-log10(x), i/50.0::double) from ({_B}) b),6) b
        from (select unnest(range(0,51)) i) g""".replace("select quantile_cont(-log10(x), i/50.0::double) from", "select qa[i+1] from")
    .replace(f"({_A}) a)", f"(select quantile_cont(-log10(x), [{','.join(str(i / 50) for i in range(51))}]) qa from ({_A}) s) a)")
    .replace(f"({_B}) b)", f"(select quantile_cont(-log10(x), [{','.join(str(i / 50) for i in range(51))}]) qa from ({_B}) s) b)"),
)
def qq_curve(spark, sf):
    a, b = series(spark, sf)
    return curves.qq_curve(a, b, 50, log=True).withColumns({"a": F.round("a", 6), "b": F.round("b", 6)})


@register(
    "axis_limits",
    """select round(case when xl>0 then xl-(xl-xh)*0.05 else xl-(xh-xl)*0.05 end,6) x_lo, round(case when xl>0 then xh+(xl-xh)*0.05 else xh+(xh-xl)*0.05 end,6) x_hi,
         round(yl-(yh-yl)*0.05,6) y_lo, round(yh+(yh-yl)*0.05,6) y_hi,
         round(least(case when xl>0 then xl-(xl-xh)*0.05 else xl-(xh-xl)*0.05 end, yl-(yh-yl)*0.05),6) lo,
         round(greatest(case when xl>0 then xh+(xl-xh)*0.05 else xh+(xh-xl)*0.05 end, yh+(yh-yl)*0.05),6) hi
       from (select min(pre) xl, max(pre) xh, min(post-0.5) yl, max(post-0.5) yh from {fx_effects}) a""",
)
def axis_limits(spark, sf):
    out = curves.limits(view(spark, sf, "fx_effects").select(F.col("pre").alias("x"), (F.col("post") - 0.5).alias("y")))
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@register(
    "boxplot_stats",
    """with q as (select o_orderpriority label, quantile_cont(o_totalprice,0.25) q1, quantile_cont(o_totalprice,0.5) median, quantile_cont(o_totalprice,0.75) q3, count(*) n from {orders} group by 1)
       select label, round(any_value(q1),6) q1, round(any_value(median),6) median, round(any_value(q3),6) q3,
         round(min(o_totalprice) filter (o_totalprice>=q1-1.5*(q3-q1)),6) whisker_lo, round(max(o_totalprice) filter (o_totalprice<=q3+1.5*(q3-q1)),6) whisker_hi,
         count(*) filter (o_totalprice<q1-1.5*(q3-q1) or o_totalprice>q3+1.5*(q3-q1)) outliers, count(*) n
       from {orders} join q on label=o_orderpriority group by 1""",
)
def boxplot_stats(spark, sf):
    box = curves.box_stats(view(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("value")), "label", "value")
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")})


_U = "(('0x'||substr({0}, {1}, 13))::bigint+0.5)/pow(16.0::double,13)"


@register(
    "boxplot_notch",
    f"""with v as (select o_orderpriority label, o_totalprice x, row_number() over (partition by o_orderpriority order by o_totalprice)-1 r from {{orders}}),
        b as (select label, n, b, n//2 h, md5(concat('0a:',label,':',b)) d, md5(concat('0b:',label,':',b)) e from (select label, count(*) n from v group by 1) s, (select unnest(range(1,1001)) b) g),
        m as (select *, 0.5+0.5*sqrt(1-pow({_U.format('d', 1)}, 2/(2*(case when n%2=1 then h+1 else h end)::double-1)))*cos(2*pi()*{_U.format('d', 14)}) m,
                {_U.format('e', 1)} s, pow({_U.format('e', 14)}, 1/greatest(h,1)::double) w from b),
        o as (select *, case when n%2=1 then m when s>m then m+(1-m)*(1-w) else m*w end o from m),
        r as (select o.label, b, (x.x+y.x)/2 med from o join v x on x.label=o.label and x.r=least(floor(n*m)::bigint, n-1) join v y on y.label=o.label and y.r=least(floor(n*o)::bigint, n-1))
        select label, round(quantile_cont(med,0.025),6) lo, round(quantile_cont(med,0.975),6) hi from r group by 1""",
)
def boxplot_notch(spark, sf):
    box = curves.box_notch(view(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("value")), "label", "value")
    return box.withColumns({c: F.round(c, 6) for c in ("lo", "hi")})
