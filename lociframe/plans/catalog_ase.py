"""Registered queries: allele-specific expression and the joins it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.config import pin
from lociframe.operators import ase, intervals
from lociframe.plans.fixtures import view
from lociframe.plans.registry import Registry
from lociframe.plans.sql_parts import ASE_VIEWS, fair_p

register = Registry(ASE_VIEWS)


def exons(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "fx_exons")
    return e.select("chrom", F.col("start_").alias("start"), F.col("end_").alias("end"), "gene", "strand", "ord", "exon")


def placed(spark: SparkSession, sf: str) -> DataFrame:
    snps = view(spark, sf, "fx_snps").select(
        "chrom", "pos", "name", F.col("ref_allele").alias("mat"), F.col("alt_allele").alias("pat")
    )
    return intervals.assign_interval(snps, exons(spark, sf), order=["ord", "exon"])


def snps_ra(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_snps").select(
        "chrom", "pos", "name", F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt")
    )


def called(spark: SparkSession, sf: str) -> DataFrame:
    counted = ase.snp_counts(
        ase.counts_by_allele(view(spark, sf, "fx_counts"), placed(spark, sf)), ["ind", "chrom", "pos", "name", "gene"]
    )
    return ase.snp_winner(ase.snp_pval(counted))


def genes(spark: SparkSession, sf: str) -> DataFrame:
    return ase.analyze(view(spark, sf, "fx_counts"), placed(spark, sf))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@register("snp_in_exon", "select chrom, pos, name, mat, pat, gene from {fx_placed}")
def snp_in_exon(spark, sf):
    return placed(spark, sf)


@register(
    "snp_in_peak_rename",
    """select concat(s.chrom, '.', s.pos, '-', s.peak) snp, s.name from (
         select s.chrom, s.pos, s.name, min_by(p.pop, p.event_id) peak from {fx_snps} s join {fx_peaks} p
         on s.chrom=p.chrom and s.pos>=p.pstart and s.pos<p.pend group by 1,2,3) s""",
)
def snp_in_peak_rename(spark, sf):
    snps = view(spark, sf, "fx_snps").select(F.concat_ws(".", "chrom", "pos").alias("snp"), "name")
    peaks = view(spark, sf, "fx_peaks").select(
        "chrom", F.col("pstart").alias("start"), F.col("pend").alias("end"), F.col("pop").alias("name"),
        F.col("event_id").alias("ord"),
    )
    return intervals.rename_by_peak(snps, peaks)


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_reads").select(
        F.col("file_").alias("file"), "id", "chrom", (F.col("pos1") - 1).alias("start"), "seq",
        (F.col("flag").bitwiseAND(16) == 16).alias("reverse"),
    )


@register(
    "read_covers_snp",
    """select r.id, s.name, s.chrom, s.pos, substr(r.seq, cast(s.pos-(r.pos1-1)+1 as bigint), 1) base from {fx_reads} r join {fx_snps} s
       on r.chrom=s.chrom and s.pos>=r.pos1-1 and s.pos<r.pos1-1+length(r.seq)""",
)
def read_covers_snp(spark, sf):
    hits = intervals.reads_x_snps(reads(spark, sf), snps_ra(spark, sf))
    return hits.select("id", "name", "chrom", "pos", "base")


@register(
    "snps_in_regions",
    """select chrom, pos, name from {fx_snps} s where exists
       (select 1 from {fx_peaks} p where p.chrom=s.chrom and s.pos>=p.pstart and s.pos<p.pend)""",
)
def snps_in_regions(spark, sf):
    snps = view(spark, sf, "fx_snps").select("chrom", "pos", "name")
    regions = view(spark, sf, "fx_peaks").select("chrom", F.col("pstart").alias("start"), F.col("pend").alias("end"))
    return intervals.in_intervals(snps, regions)


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_genome")


TILE = 32
_BASE_AT = """select s.*, substr(g.seq, cast(s.pos%32+1 as bigint), 1) b from {fx_snps} s join {fx_genome} g
              on s.chrom=g.chrom and g.tile=floor(s.pos/32)"""
_CALL = "case when upper(b)=ref_allele then 'ref' when upper(b)=alt_allele then 'alt' else 'no_match' end"


@register("snp_vs_genome", f"select chrom, pos, name, b base, {_CALL} call from ({_BASE_AT}) x")
def snp_vs_genome(spark, sf):
    return intervals.compare_to_genome(snps_ra(spark, sf), tiles(spark, sf), TILE).select(
        "chrom", "pos", "name", "base", "call"
    )


@register(
    "genome_match_report",
    f"""select chrom, count(*) filter (call='ref') "ref", count(*) filter (call='alt') alt, count(*) filter (call='no_match') no_match
        from (select chrom, {_CALL} call from ({_BASE_AT}) x) y group by chrom""",
)
def genome_match_report(spark, sf):
    return ase.match_report(intervals.compare_to_genome(snps_ra(spark, sf), tiles(spark, sf), TILE))


# A window reaches over at most three tiles here; bases are put together by position.
_AROUND = """select s.chrom, s.pos, string_agg(substr(g.seq, cast((s.pos+d)%32+1 as bigint), 1), '' order by d) w, count(*) n
   from {fx_snps} s cross join (select unnest(range(-KK, KK+1)) d) ds
   join {fx_genome} g on s.chrom=g.chrom and g.tile=floor((s.pos+d)/32) and s.pos+d>=0
   group by 1,2 having bool_or(d=0)"""


@register("region_sequence", f"select chrom, pos, upper(w) region, n<15 is_edge from ({_AROUND.replace('KK','7')}) x")
def region_sequence(spark, sf):
    return intervals.get_regions(snps_ra(spark, sf).select("chrom", "pos"), tiles(spark, sf), TILE)


@register(
    "dinucleotides",
    f"""select chrom, pos, substr(w,2,1) ref_base, substr(w,1,2) plus1, substr(w,2,2) plus2,
          reverse(translate(substr(w,1,2),'ACGTNacgtn','TGCANtgcan')) minus1,
          reverse(translate(substr(w,2,2),'ACGTNacgtn','TGCANtgcan')) minus2, n<3 is_edge
        from ({_AROUND.replace('KK','1')}) x where pos > 0
        union all
        select chrom, pos, substr(w,1,1), substr(w,1,1), substr(w,1,2),
          reverse(translate(substr(w,1,1),'ACGTNacgtn','TGCANtgcan')),
          reverse(translate(substr(w,1,2),'ACGTNacgtn','TGCANtgcan')), n<3
        from ({_AROUND.replace('KK','1')}) x where pos = 0""",
)
def dinucleotides(spark, sf):
    return intervals.get_dinucleotides(snps_ra(spark, sf).select("chrom", "pos"), tiles(spark, sf), TILE)


@register(
    "chroms_not_found",
    "select distinct chrom from {fx_points} where chrom not in (select distinct chrom from {fx_genome})",
)
def chroms_not_found(spark, sf):
    return intervals.missing_chroms(view(spark, sf, "fx_points"), tiles(spark, sf))


@register(
    "counts_x_snps",
    """select c.ind, c.chrom, c.pos, c.base, c.n, s.ref_allele mat, s.alt_allele pat
       from {fx_counts} c left join {fx_snps} s on c.chrom=s.chrom and c.pos=s.pos""",
)
def counts_x_snps(spark, sf):
    snps = snps_ra(spark, sf).select("chrom", "pos", F.col("ref").alias("mat"), F.col("alt").alias("pat"))
    joined = ase.counts_by_allele(view(spark, sf, "fx_counts"), snps, "left")
    return joined.select("ind", "chrom", "pos", "base", "n", "mat", "pat")


@register("snp_counts", "select ind, chrom, pos, name, gene, mat_counts, pat_counts, n_counts, other_counts from {sq_snp}")
def snp_counts(spark, sf):
    return ase.snp_counts(
        ase.counts_by_allele(view(spark, sf, "fx_counts"), placed(spark, sf)), ["ind", "chrom", "pos", "name", "gene"]
    )


@register(
    "snp_binom_pval",
    "select ind, name, mat_counts, pat_counts, case when isnan(pval) then null else round(pval, 9) end pval from {sq_p}",
)
def snp_binom_pval(spark, sf):
    return called(spark, sf).select(
        "ind", "name", "mat_counts", "pat_counts", F.round(F.nullif("pval", F.lit(float("nan"))), 9).alias("pval")
    )


@register("snp_winner", "select ind, name, win from {sq_win}")
def snp_winner(spark, sf):
    return called(spark, sf).select("ind", "name", "win")


_ACGT = """
select ind, chrom, pos, cast(coalesce(sum(n) filter (base='A'),0) as bigint) a, cast(coalesce(sum(n) filter (base='C'),0) as bigint) c,
  cast(coalesce(sum(n) filter (base='G'),0) as bigint) g, cast(coalesce(sum(n) filter (base='T'),0) as bigint) t
from {fx_counts} group by 1,2,3"""


def acgt(spark: SparkSession, sf: str) -> DataFrame:
    counts = view(spark, sf, "fx_counts")
    wide = counts.groupBy("ind", "chrom", "pos").agg(
        *[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).cast("long").alias(b.lower()) for b in "ACGT"]
    )
    snps = view(spark, sf, "fx_snps").select("chrom", "pos", "name", "ref_allele", "alt_allele")
    return wide.join(snps, ["chrom", "pos"])


_CALLED = (
    """select *, """
    + fair_p("least(n1,n2)", "(n1+n2)")
    + """ pval, coalesce((n1+n2)/nullif(a+c+g+t,0)::double,0) share,
  case when t>=greatest(a,c,g) then 't' when g>=greatest(a,c) then 'g' when c>=a then 'c' else 'a' end major
from (select x.*, s.name, s.ref_allele, s.alt_allele,
  case s.ref_allele when 'A' then a when 'C' then c when 'G' then g else t end n1,
  case s.alt_allele when 'A' then a when 'C' then c when 'G' then g else t end n2
  from ("""
    + _ACGT
    + """) x join {fx_snps} s on x.chrom=s.chrom and x.pos=s.pos) y"""
)


@register(
    "allele_call_reference",
    f"""select ind, name, round(pval,9) pval, cls, case when cls='Weird' then '?' when lower(ref_allele)=major then 'M'
          when lower(alt_allele)=major then 'P' else '?' end parent
        from (select *, case when share<0.9 then 'Weird' when pval<0.05 then 'Asym' else 'Sym' end cls from ({_CALLED}) z) w""",
)
def allele_call_reference(spark, sf):
    df = acgt(spark, sf).withColumns(
        {"a1": F.col("ref_allele"), "a2": F.col("alt_allele"), "mat_allele": F.col("ref_allele"), "pat_allele": F.col("alt_allele")}
    )
    return rounded(ase.call_counts(df), pval=9).select("ind", "name", "pval", "cls", "parent")


_GENE_COLS = (
    "ind, gene, mat_counts, pat_counts, n_counts, other_counts, snps, case when isnan(pval) then null else round(pval,9) end pval, "
    "mat_wins, pat_wins, not_sig, weird, failed, winner"
)


def _no_nan(df: DataFrame) -> DataFrame:
    return df.withColumn("pval", F.round(F.nullif("pval", F.lit(float("nan"))), 9))


@register("gene_table_all_individuals", f"select {_GENE_COLS} from {{sq_gene}}")
def gene_table_all_individuals(spark, sf):
    return _no_nan(genes(spark, sf))


@register(
    "gene_summary",
    f"""select ind, gene, cast(sum(n1) as bigint) mat_counts, cast(sum(n2) as bigint) pat_counts, cast(sum(a+c+g+t-n1-n2) as bigint) other_counts,
          count(*) snps, round(quantile_cont(pval,0.5),9) pval, count(*) filter (parent='M') mat_wins, count(*) filter (parent='P') pat_wins,
          count(*) filter (parent='?') failed, count(*) filter (cls='Sym') no_ase, count(*) filter (cls='Asym') has_ase,
          count(*) filter (cls='Weird') weird,
          case when count(*) filter (cls='Weird')/count(*)::double>0.4 then 'WEIRD'
               when count(*) filter (parent='M')>count(*) filter (parent='P') and count(*) filter (parent='M')/count(*)::double>0.6 then 'mat'
               when count(*) filter (parent='P')>count(*) filter (parent='M') and count(*) filter (parent='P')/count(*)::double>0.6 then 'pat'
               else '?' end winner
        from (select w.*, case when cls='Weird' then '?' when lower(ref_allele)=major then 'M' when lower(alt_allele)=major then 'P' else '?' end parent
              from (select z.*, p.gene, case when share<0.9 then 'Weird' when pval<0.05 then 'Asym' else 'Sym' end cls
                    from ({_CALLED}) z join {{fx_placed}} p on z.chrom=p.chrom and z.pos=p.pos) w) v
        group by ind, gene""",
)
def gene_summary(spark, sf):
    df = acgt(spark, sf).withColumns(
        {"a1": F.col("ref_allele"), "a2": F.col("alt_allele"), "mat_allele": F.col("ref_allele"), "pat_allele": F.col("alt_allele")}
    )
    mat = F.when(F.col("a1") == "A", F.col("a")).when(F.col("a1") == "C", F.col("c")).when(F.col("a1") == "G", F.col("g")).otherwise(F.col("t"))
    pat = F.when(F.col("a2") == "A", F.col("a")).when(F.col("a2") == "C", F.col("c")).when(F.col("a2") == "G", F.col("g")).otherwise(F.col("t"))
    rows = (
        ase.call_counts(df)
        .withColumns({"mat_counts": mat, "pat_counts": pat, "win": F.col("parent")})
        .withColumn("other_counts", F.expr("a+c+g+t") - F.col("mat_counts") - F.col("pat_counts"))
        .join(placed(spark, sf).select("chrom", "pos", "gene"), ["chrom", "pos"])
    )
    return rounded(ase.gene_summary(rows, ["ind", "gene"], "alleleseq"), pval=9)


# Chances of at most k on the rarer side, per depth; a draw falls between two of them.
_COINS = """select flips, k, coalesce(lag(g) over w, 0) lo, case when k=flips//2 then 2.0::double else g end hi, """ + fair_p("k", "flips") + """ p from (
  select flips, k, sum(case when 2*k=flips then 1 else 2 end * exp(lgamma(flips+1)-lgamma(k+1)-lgamma(flips-k+1)-flips*ln(2.0::double))) over (partition by flips order by k) g
  from (select flips, unnest(range(0, flips//2+1)) k from (select distinct mat_counts+pat_counts flips from {sq_p} where not isnan(pval)) a) b) c
  window w as (partition by flips order by k)"""
_HEADS = f"""select ind, round(p,12) p_, count(*) drawn from (
  select ind, mat_counts+pat_counts flips,
    ('0x'||substr(md5(concat('0:',ind,'|',name,':',(s-1)//2)), 1+13*((s-1)%2)::int, 13))::bigint/pow(16.0::double,13) u
  from {{sq_p}} cross join (select unnest(range(1,6)) s) ss where not isnan(pval)) d
  join ({_COINS}) t on t.flips=d.flips and d.u>=t.lo and d.u<t.hi group by 1,2"""

_CUTS = f"""select ind, max(p_) p_cut, max_by(fdr, p_) fdr from (
  select ind, p_, a, sum(s) over w / 5.0::double / sum(a) over w fdr from (
    select ind, p_, sum(a) a, sum(s) s from (
      select ind, round(pval,12) p_, 1 a, 0 s from {{sq_p}} where not isnan(pval)
      union all select ind, p_, 0, drawn from ({_HEADS}) h) u group by 1,2) v
  window w as (partition by ind order by p_)) x
  where a>0 and fdr<0.1 group by ind"""


def tested_snps(spark: SparkSession, sf: str) -> DataFrame:
    return called(spark, sf).withColumn("key", F.concat("ind", F.lit("|"), "name"))


@register(
    "fdr_simulated",
    f"""with hs as ({_HEADS}), act as (select round(pval,12) p_ from {{sq_p}} where not isnan(pval)),
        grid as (select unnest(list_concat([round(x*0.001,3) for x in range(0,10)], [round(x*0.01,3) for x in range(1,10)], [round(x*0.1,3) for x in range(1,10)]))::double p)
        , gg as (select distinct p from grid)
        select p, (select count(*) from act where p_<=p) n_actual, round((select coalesce(sum(drawn),0) from hs where p_<=p)/5.0::double, 6) mean_sim,
          round((select coalesce(sum(drawn),0) from hs where p_<=p)/5.0::double/((select count(*) from act where p_<=p)+1), 9) fdr from gg""",
)
def fdr_simulated(spark, sf):
    return rounded(ase.fdr_grid(pin(tested_snps(spark, sf)), "key"), mean_sim=6, fdr=9)


@register(
    "fdr_filter",
    f"select g.ind, g.gene, g.name, g.mat_counts, g.pat_counts, round(g.pval,9) pval, round(c.p_cut,9) p_cut, round(c.fdr,9) fdr "
    f"from {{sq_p}} g join ({_CUTS}) c on g.ind=c.ind where not isnan(g.pval) and g.pval<c.p_cut",
)
def fdr_filter(spark, sf):
    table = pin(tested_snps(spark, sf))
    cuts = ase.fdr_cutoff(table, "key", by=["ind"])
    kept = ase.fdr_filter(table, cuts, by=["ind"])
    return rounded(kept, pval=9, p_cut=9, fdr=9).select(
        "ind", "gene", "name", "mat_counts", "pat_counts", "pval", "p_cut", "fdr"
    )


@register(
    "wrong_base_report",
    """select tissue, chrom, count(*) snp_count, count(*) filter (not known) skipped, cast(sum(r) as bigint) "ref", cast(sum(a) as bigint) alt,
         cast(sum(ns) as bigint) ns, cast(sum(o) as bigint) other, cast(sum(r+a+ns+o) as bigint) total,
         round(sum(o)/sum(r+a+ns+o)::double, 9) other_percent
       from (select c.ind tissue, c.chrom, c.pos, bool_or(g.chrom is not null) known,
           sum(case when g.chrom is not null and base=ref_allele then n else 0 end) r,
           sum(case when g.chrom is not null and base=alt_allele then n else 0 end) a,
           sum(case when g.chrom is not null and base='N' then n else 0 end) ns,
           sum(case when g.chrom is not null and base not in (ref_allele, alt_allele, 'N') then n else 0 end) o
         from {fx_counts} c left join (select s.chrom, s.pos, s.ref_allele, s.alt_allele from {fx_snps} s join {fx_placed} p on s.chrom=p.chrom and s.pos=p.pos) g
         on c.chrom=g.chrom and c.pos=g.pos group by 1,2,3) x group by 1,2""",
)
def wrong_base_report(spark, sf):
    counts = view(spark, sf, "fx_counts").withColumnRenamed("ind", "tissue")
    snps = placed(spark, sf).select("chrom", "pos", F.col("mat").alias("ref"), F.col("pat").alias("alt"))
    return rounded(ase.wrong_base(counts, snps), other_percent=9)


@register(
    "read_allele_report",
    """with sh as (select r.*, s shift, r.pos1-1-s st, case when flag%32>=16 then translate(seq,'ACGTNacgtn','TGCANtgcan') else seq end sq
         from {fx_reads} r cross join (select 0 s union all select 1 union all select -1) ss),
       h as (select sh.file_, shift, id, count(*) snps, count(*) filter (b=ref_allele) r, count(*) filter (b=alt_allele) a,
          count(*) filter (b='N') ns, count(*) filter (b not in (ref_allele,alt_allele,'N')) o
         from (select sh.*, s.ref_allele, s.alt_allele, substr(sq, cast(s.pos-st+1 as bigint), 1) b from sh join {fx_snps} s
               on sh.chrom=s.chrom and s.pos>=st and s.pos<st+length(sq)) sh group by 1,2,3),
       t as (select file_, shift, count(*) reads from sh group by 1,2)
       select t.file_ file, t.shift, t.reads, count(h.id) with_snps, cast(coalesce(sum(snps),0) as bigint) snps, cast(coalesce(sum(r),0) as bigint) "ref",
         cast(coalesce(sum(a),0) as bigint) alt, cast(coalesce(sum(ns),0) as bigint) ns, cast(coalesce(sum(o),0) as bigint) other
       from t left join h on t.file_=h.file_ and t.shift=h.shift group by 1,2,3""",
)
def read_allele_report(spark, sf):
    return ase.read_report(reads(spark, sf), snps_ra(spark, sf))


@register("gene_list", "select distinct gene from {fx_placed}")
def gene_list(spark, sf):
    return ase.gene_list(placed(spark, sf))


@register(
    "per_gene_snp_rate",
    """select s.chrom, count(*) total, count(p.gene) in_gene, round(100.0::double*count(p.gene)/count(*), 6) percent
       from {fx_snps} s left join {fx_placed} p on s.chrom=p.chrom and s.pos=p.pos group by 1""",
)
def per_gene_snp_rate(spark, sf):
    return rounded(ase.placement_stats(view(spark, sf, "fx_snps"), placed(spark, sf)), percent=6)
