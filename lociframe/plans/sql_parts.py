"""Pieces of the SQL that the results are checked against."""

from __future__ import annotations

from lociframe.functions.stats import ERFC_COEFFICIENTS


def erfc(z: str) -> str:
    """For z >= 0."""
    t = f"(1.0::double/(1.0+0.5*({z})))"
    poly = f"{ERFC_COEFFICIENTS[-1]}::double"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({c}::double+{t}*{poly})"
    return f"({t}*exp(-({z})*({z})+{poly}))"


def erfc_any(z: str) -> str:
    return f"(case when ({z})>=0 then {erfc(f'abs({z})')} else 2-{erfc(f'abs({z})')} end)"


def fair_p(k: str, n: str) -> str:
    """Two-sided fair-coin p of k = the smaller count out of n."""
    # Binomial coefficients by an integer product, so that dyadic p-values stay exact.
    choose = f"list_reduce(list_prepend(1.0::double, range(1, i+1)::double[]), lambda acc, j: acc*(({n})-i+j)/j)"
    exact = (
        f"least(1.0::double, 2*list_sum(list_transform(range(0, ({k})::bigint+1), "
        f"lambda i: {choose}*pow(0.5::double, ({n})))))"
    )
    z = f"((({n})/2.0::double-({k})-0.5)/(sqrt(({n})::double)/2)/sqrt(2.0::double))"
    return (
        f"(case when abs(({k})-({n})/2.0::double)<1e-5 then 1.0::double when ({n})<=100 then {exact} "
        f"else least(1.0::double, {erfc(z)}) end)"
    )


# The chain from counts to gene calls, as views on top of plans.fixtures.
ASE_VIEWS = {
    "sq_snp": """
select c.ind, c.chrom, c.pos, p.name, p.gene,
  cast(sum(case when base=mat then n else 0 end) as bigint) mat_counts,
  cast(sum(case when base<>mat and base=pat then n else 0 end) as bigint) pat_counts,
  cast(sum(case when base<>mat and base<>pat and base='N' then n else 0 end) as bigint) n_counts,
  cast(sum(case when base<>mat and base<>pat and base<>'N' then n else 0 end) as bigint) other_counts
from {fx_counts} c join {fx_placed} p on c.chrom=p.chrom and c.pos=p.pos group by 1,2,3,4,5""",
    "sq_p": """
select *, case when tot>1 and (other_counts/tot::double<0.1 or n_counts/tot::double>0.25) then """
    + fair_p("least(mat_counts,pat_counts)", "(mat_counts+pat_counts)")
    + """ else 'nan'::double end pval
from (select *, mat_counts+pat_counts+n_counts+other_counts tot from {sq_snp}) x""",
    "sq_win": """
select *, case when tot<=2 then 'NA' when n_counts/tot::double>0.25 then 'Ns > 0.25'
  when (mat_counts+pat_counts)/(tot-n_counts)::double<0.9 then 'WEIRD'
  when not isnan(pval) and pval<0.05 then case when mat_counts>pat_counts then 'mat' when pat_counts>mat_counts then 'pat' else 'homo' end
  else 'NS' end win
from {sq_p}""",
    "sq_gene": """
select *, case when not isnan(pval) and pval<0.05 then
    case when weird/snps::double>0.4 then 'WEIRD' when mat_wins>pat_wins and mat_wins/snps::double>0.6 then 'mat'
         when pat_wins>mat_wins and pat_wins/snps::double>0.6 then 'pat' else '?' end
  else 'NS' end winner
from (select ind, gene, cast(sum(mat_counts) as bigint) mat_counts, cast(sum(pat_counts) as bigint) pat_counts,
        cast(sum(n_counts) as bigint) n_counts, cast(sum(other_counts) as bigint) other_counts, count(*) snps,
        case when bool_or(isnan(pval)) then 'nan'::double else quantile_cont(pval, 0.5) end pval,
        count(*) filter (win='mat') mat_wins, count(*) filter (win='pat') pat_wins, count(*) filter (win='NS') not_sig,
        count(*) filter (win='WEIRD') weird, count(*) filter (win not in ('mat','pat','NS','WEIRD')) failed
      from {sq_win} group by 1,2) g""",
}
