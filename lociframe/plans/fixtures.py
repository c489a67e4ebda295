"""Views with the shapes of genomic inputs, derived from the given tables by one SQL text each.

The same text runs in Spark (through ``view``) and, as common table expressions (``with_views``), in
the SQL that checks the results. ``{name}`` stands for a given table or another view; ``{str}`` for
the engine's text type; ``{each:1,2}`` for one row per listed number. Positions are 0-based unless the column name ends in 1.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "fx_snps": """
select concat('chr', cast(p_partkey%5+1 as int)) chrom, p_partkey*7 pos, concat('rs', p_partkey) name,
  substr('ACGT', cast(p_partkey%4 as int)+1, 1) ref_allele,
  substr('ACGT', cast((p_partkey + 1 + floor(p_partkey/4)%3)%4 as int)+1, 1) alt_allele
from {part}""",
    "fx_genes": """
select s_suppkey ord, concat('chr', cast(s_suppkey%5+1 as int)) chrom, s_suppkey*140 gstart, s_suppkey*140+1050 gend,
  concat('G', cast(floor(s_suppkey/2) as bigint)) gene, case when s_suppkey%2=0 then '+' else '-' end strand,
  '500,450' sizes, '0,600' starts
from {supplier}""",
    # The two blocks of each gene, 0-based half-open.
    "fx_exons": """
select ord, chrom, gene, strand, gstart start_, gstart+500 end_, 0 exon from {fx_genes}
union all
select ord, chrom, gene, strand, gstart+600 start_, gstart+1050 end_, 1 exon from {fx_genes}""",
    "fx_counts": """
select concat(l_returnflag,l_linestatus) ind, concat('chr', cast(l_partkey%5+1 as int)) chrom, l_partkey*7 pos,
  case when l_linenumber<=1+floor(l_partkey/100)%6 then substr('ACGT', cast(l_partkey%4 as int)+1, 1)
       when l_linenumber<=6 then substr('ACGT', cast((l_partkey + 1 + floor(l_partkey/4)%3)%4 as int)+1, 1)
       when l_orderkey%3=0 then 'N' else substr('ACGT', cast(l_orderkey%4 as int)+1, 1) end base,
  cast(sum(case when floor(l_partkey/100)%3=0 then cast(l_quantity as bigint) else cast(l_quantity as bigint)%6 end) as bigint) n
from {lineitem} group by 1,2,3,4""",
    "fx_reads": """
select concat('r',o_orderkey) id, case when o_orderkey%2=0 then 0 else 16 end flag,
  concat('chr', cast(o_orderkey%5+1 as int)) chrom, o_orderkey+1 pos1,
  translate(md5(cast(o_orderkey as {str})),'0123456789abcdef','ACGTACGTACGTACGN') seq, o_orderpriority file_
from {orders}""",
    "fx_genome": """
select concat('chr', i) chrom, p_partkey tile,
  translate(md5(concat(cast(i as {str}), ':', cast(p_partkey as {str}))),'0123456789abcdef','ACGTACGTACGTacgt') seq
from (select p_partkey, {each:1,2,3,4,5} i from {part}) x""",
    "fx_fastq": """
select doc_id, m mate, concat('read', doc_id, '/', m) id,
  case when (doc_id+m)%5=0 or doc_id%11=0
       then concat('N', substr(translate(md5(concat(cast(m as {str}), cast(doc_id as {str}))),'0123456789abcdef','ACGTACGTACGTACGT'),2,31))
       else translate(md5(concat(cast(m as {str}), cast(doc_id as {str}))),'0123456789abcdef','ACGTACGTACGTACGT') end seq,
  repeat('I',32) qual
from (select doc_id, {each:1,2} m from {documents}) x""",
    # Phased genotypes in long form: one per distinct (part, supplier) of lineitem.
    "fx_genotypes": """
select concat('rs',l_partkey) snp, l_partkey k, concat('S',l_suppkey) sample, concat('P', cast(l_suppkey%5 as int)) pop,
  case cast((l_partkey*7 + l_suppkey*13 + floor(l_partkey*l_suppkey/3))%4 as int)
       when 0 then '0|0' when 1 then '0|1' when 2 then '1|0' else '1|1' end gt
from (select distinct l_partkey, l_suppkey from {lineitem}) d""",
    # Genotype cells of six samples per SNP, sample s in 1..6.
    "fx_cells": """
select chrom, pos+1 pos1, name, ref_allele, alt_allele, s,
  concat(case cast((pos*3 + s*5 + floor(pos*s/3))%4 as int) when 0 then '0|0' when 1 then '0|1' when 2 then '1|0' else '1|1' end,
         ':', cast(s as {str})) cell
from (select *, {each:1,2,3,4,5,6} s from {fx_snps}) x""",
    "fx_peaks": """
select event_id, concat('chr', cast(user_id%5+1 as int)) chrom, event_id*20 pstart,
  event_id*20 + 40 + cast(floor(value*10)%160 as bigint) pend, concat(event_type,'_',event_id) pop, value fold, value/2 l10p
from {events}""",
    "fx_dap": """
select concat('rs',o_orderkey) snp, case when o_orderkey%7=0 then concat('pk', o_orderkey, 's') else concat('pk', cast(floor(o_orderkey/3) as bigint)) end peak, cast(0.1723 as double) prior,
  round(o_totalprice - 1000*floor(o_totalprice/1000),2)/1000 posterior
from {orders}""",
    "fx_effects": """
select concat('chr', cast(l_suppkey%5+1 as int)) chrom, l_partkey*7 pos, 'A' ref, cast(l_quantity as bigint) depth,
  l_tax*12 post, l_quantity/51 pre, cast(0.01 as double) pval, (l_quantity/51)*(1-l_quantity/51)/40 prevar,
  0.0002 + l_discount/50 postvar, l_orderkey, l_linenumber
from {lineitem}""",
    "fx_enrich": """
select concat('GS',l_suppkey) set_id, l_linenumber perm, case when l_returnflag='A' then 'sample_1' else 'sample_2' end sample,
  avg(l_tax)/10 + 0.0001 p_value
from {lineitem} group by 1,2,3""",
    "fx_points": """
select concat('chr', case when p_partkey%7=5 then 'X' when p_partkey%7=6 then 'MT' else cast(p_partkey%7+1 as {str}) end) chrom,
  p_partkey*7 pos, (p_partkey*37%1000+1)/cast(1000 as double) p
from {part}""",
    "fx_messages": """
select conv_id*1000+turn msg_id, role sender, concat('to', cast(conv_id%7 as int), '@', role) recipients, text subject, text body,
  length(text)%10 spam_score, timestamp '2024-01-01 00:00:00' ts
from {conversations}""",
    "fx_manifest": """
select page_id, url path, cast(length(html) as bigint) size, md5(html) md5 from {pages}""",
    # The other side of the manifest: some paths moved, some contents changed.
    "fx_manifest2": """
select page_id, case when page_id%10=0 then concat(path, '.old') else path end path, size,
  case when page_id%17=0 then reverse(md5) else md5 end md5
from {fx_manifest}""",
    # ASE per SNP, the chain the gene tables start from.
    "fx_placed": """
select s.chrom, s.pos, s.name, s.ref_allele mat, s.alt_allele pat, min_by(e.gene, e.ord*2+e.exon) gene
from {fx_snps} s join {fx_exons} e on s.chrom=e.chrom and s.pos>=e.start_ and s.pos<e.end_
group by 1,2,3,4,5""",
}

_TOKEN = re.compile(r"\{(\w+)\}")
_EACH = re.compile(r"\{each:([\d,]+)\}")


def _needs(text: str) -> list[str]:
    seen: list[str] = []
    for name in _TOKEN.findall(text):
        if name != "str" and name not in seen:
            seen.append(name)
    return seen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in _needs(text)}
    return spark.sql(_EACH.sub(r"explode(array(\1))", text.replace("{str}", "string")), **parts)


def with_views(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` for DuckDB with every view it names in front of it. Braces as in the views."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in known and n not in ordered:
                visit(known[n])
                ordered.append(n)

    visit(select)

    def plain(text: str) -> str:
        return _TOKEN.sub(lambda m: m.group(1), _EACH.sub(r"unnest([\1])", text.replace("{str}", "varchar")))

    ctes = ",\n".join(f"{n} as ({plain(known[n]).strip()})" for n in ordered)
    body = plain(select).strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):].strip()}"
    if body.lower().startswith("with"):
        return f"with {ctes},\n{body[len('with'):].strip()}"
    return f"with {ctes}\n{body}"
