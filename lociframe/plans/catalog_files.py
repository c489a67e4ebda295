"""Registered queries: sources, sinks and format conversions.

Each writes rows of a view as a file of the format into the shared folder and reads that file back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.config import new_path
from lociframe.functions.bases import complement, revcomp
from lociframe.functions.chroms import chrom_rank, norm_chrom, snp_id, split_snp_id
from lociframe.operators import convert, filters
from lociframe.plans.fixtures import view
from lociframe.plans.registry import Registry
from lociframe.sources import bed, database, reports, sequences, sinks, text, variants
from lociframe.streaming import streams

register = Registry()


def as_file(spark: SparkSession, df: DataFrame, line: Column, name: str, compression: str = "none") -> str:
    """Write one text line per row; returns the folder."""
    path = new_path(spark, name)
    df.select(line.alias("value")).write.text(path, compression=compression)
    return path


def tabbed(*cols: str | Column) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def joined(array: str | Column, sep: str = ",") -> Column:
    a = F.col(array) if isinstance(array, str) else array
    return F.array_join(a.cast("array<string>"), sep)


@register("read_text_any", "select text as value from (select unnest(string_split(text, chr(10))) as text from {documents}) x")
def read_text_any(spark, sf):
    docs = view(spark, sf, "documents")
    paths = [
        as_file(spark, docs.where("pmod(doc_id, 3) = 0"), F.col("text"), "plain"),
        as_file(spark, docs.where("pmod(doc_id, 3) = 1"), F.col("text"), "gz", "gzip"),
        as_file(spark, docs.where("pmod(doc_id, 3) = 2"), F.col("text"), "bz2", "bzip2"),
    ]
    return text.read_lines(spark, paths)


@register("count_lines", "select cast(sum(length(text)-length(replace(text, chr(10), ''))+1) as bigint) lines from {documents}")
def count_lines(spark, sf):
    return text.count_lines(spark, as_file(spark, view(spark, sf, "documents"), F.col("text"), "docs", "gzip"))


def gene_bed(spark: SparkSession, sf: str) -> str:
    genes = view(spark, sf, "fx_genes")
    line = tabbed("chrom", "gstart", "gend", "gene", F.lit(0), "strand", "gstart", "gend", F.lit("0"), F.lit(2), "sizes", "starts")
    return as_file(spark, genes, line, "genes.bed")


_BLOCKS = "concat(gstart,'-',gstart+500,',',gstart+600,'-',gstart+1050)"


@register(
    "read_bed",
    f"""select chrom, gstart "start", gend "end", gene "name", '0' score, strand, gstart t_start, gend t_end, '0' rgb, {_BLOCKS} exons,
        cast(null as varchar) _corrupt from {{fx_genes}}""",
)
def read_bed(spark, sf):
    blocks = F.transform("exons", lambda b: F.concat_ws("-", b["start"].cast("string"), b["end"].cast("string")))
    return bed.read_bed(spark, gene_bed(spark, sf)).withColumn("exons", joined(blocks))


@register("exon_blocks", "select gene, gstart+500 first_end, gstart+600 second_start, gstart+1050 second_end, 2 blocks from {fx_genes}")
def exon_blocks(spark, sf):
    g = view(spark, sf, "fx_genes").withColumn("b", bed.exon_blocks(F.col("gstart"), F.col("sizes"), F.col("starts")))
    return g.select(
        "gene", F.expr("b[0].end").alias("first_end"), F.expr("b[1].start").alias("second_start"),
        F.expr("b[1].end").alias("second_end"), F.size("b").alias("blocks"),
    )


@register(
    "read_gene_bed_blocks",
    """select chrom, start_ "start", end_ "end", gene, strand, exon from {fx_exons}""",
)
def read_gene_bed_blocks(spark, sf):
    return bed.read_gene_bed(spark, gene_bed(spark, sf))


@register(
    "bed12_to_gtf",
    """select chrom, 'refSeq' source, 'exon' feature, start_ "start", end_ "end", '.' score, strand, '.' frame,
         concat('gene_id "', gene, '"; transcript_id "', gene, '"; exon_number "', exon, '"') attributes from {fx_exons}""",
)
def bed12_to_gtf(spark, sf):
    return convert.bed12_to_gtf(bed.read_bed(spark, gene_bed(spark, sf)), "refSeq")


def gtf_file(spark: SparkSession, sf: str) -> str:
    gtf = convert.bed12_to_gtf(bed.read_bed(spark, gene_bed(spark, sf)), "refSeq", one_based=True)
    # Whole genes go in as rows of another feature.
    genes = view(spark, sf, "fx_genes").select(
        tabbed("chrom", F.lit("refSeq"), F.lit("gene"), F.col("gstart") + 1, "gend", F.lit("."), "strand", F.lit("."),
               F.format_string('gene_id "%s"; transcript_id "%s"', "gene", "gene")).alias("value")
    )
    rows = gtf.select(tabbed(*gtf.columns).alias("value")).unionByName(genes)
    return as_file(spark, rows, F.col("value"), "genes.gtf")


@register(
    "read_gtf_exons",
    """select chrom, 'refSeq' source, 'exon' feature, start_ "start", end_ "end", strand, gene, gene transcript from {fx_exons}""",
)
def read_gtf_exons(spark, sf):
    return bed.read_gtf(spark, gtf_file(spark, sf)).drop("_corrupt")


@register("feature_filter", """select chrom, gstart "start", gend "end", gene from {fx_genes}""")
def feature_filter(spark, sf):
    return bed.read_gtf(spark, gtf_file(spark, sf), feature="gene").select("chrom", "start", "end", "gene")


def snp_bed(spark: SparkSession, sf: str) -> str:
    snps = view(spark, sf, "fx_snps").withColumn("sep", F.when(F.expr("pmod(pos div 7, 3) = 0"), "/").otherwise("|"))
    return as_file(spark, snps, tabbed("chrom", "pos", F.col("pos") + 1, F.concat("ref_allele", "sep", "alt_allele")), "snps.bed")


@register(
    "read_bed_snps",
    """select chrom, pos "start", pos+1 "end", ref_allele "ref", alt_allele alt, (pos//7)%3<>0 phased from {fx_snps}""",
)
def read_bed_snps(spark, sf):
    return variants.read_bed_snps(spark, snp_bed(spark, sf)).select("chrom", "start", "end", "ref", "alt", "phased")


@register(
    "bed_to_vcf_hybrid",
    """select chrom, pos+1 pos1, '.' id, ref_allele "ref", alt_allele alt, '.' qual, '.' "filter", '.' info, 'GT' format, '1|0' "BxC", '0|1' "CxB" from {fx_snps}""",
)
def bed_to_vcf_hybrid(spark, sf):
    return convert.bed_to_vcf(variants.read_bed_snps(spark, snp_bed(spark, sf)))


def vcf_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Six-sample VCF rows, cells in sample order."""
    cells = view(spark, sf, "fx_cells")
    return (
        cells.groupBy("chrom", "pos1", "name", "ref_allele", "alt_allele")
        .agg(F.array_sort(F.collect_list(F.struct("s", "cell"))).alias("c"))
        .select(
            "chrom", (F.col("pos1") - 1).alias("pos"), F.col("name").alias("id"), F.col("ref_allele").alias("ref"),
            F.col("alt_allele").alias("alt"), F.lit("50").alias("qual"), F.lit("PASS").alias("filter"), F.lit(".").alias("info"),
            F.lit("GT:DP").alias("format"), F.col("c.cell").alias("gts"),
        )
    )


SAMPLES = [f"S{i}" for i in range(1, 7)]


def vcf_file(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "geno.vcf")
    sinks.write_vcf(vcf_rows(spark, sf), SAMPLES, path, compression="gzip")
    return path


_VCF = """select chrom, pos1, name, ref_allele, alt_allele, string_agg(cell, ',' order by s) cells,
  string_agg(case split_part(cell,':',1) when '0|0' then '0' when '1|1' then '2' else '1' end, ',' order by s) dos
  from {fx_cells} group by 1,2,3,4,5"""


@register(
    "read_vcf_sites",
    f"""select chrom, pos1-1 pos, name id, ref_allele "ref", alt_allele alt, '50' qual, 'PASS' "filter", '.' info, 'GT:DP' format, cells gts from ({_VCF}) x""",
)
def read_vcf_sites(spark, sf):
    return variants.read_vcf(spark, vcf_file(spark, sf)).withColumn("gts", joined("gts")).drop("_corrupt")


@register("vcf_genotype_dosage", f"select chrom, pos1-1 pos, name id, dos dosages from ({_VCF}) x")
def vcf_genotype_dosage(spark, sf):
    simple = convert.vcf_simplify(variants.read_versioned_vcf(spark, vcf_file(spark, sf)))
    return simple.select("chrom", "pos", "id", joined("dosages").alias("dosages"))


def panel_file(spark: SparkSession, sf: str) -> str:
    """Sample panel from the suppliers, every sample listed a second time with another population."""
    s = view(spark, sf, "supplier")
    lines = s.select(
        F.col("s_suppkey").alias("k"),
        F.explode(F.array(*[
            F.concat_ws("\t", F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit(p), F.expr("pmod(s_suppkey, 3)")), F.concat(F.lit("R"), "s_nationkey"),
                        F.lit("ILLUMINA,"), F.concat(F.lit("L"), "s_nationkey"))
            for p in ("POP", "LATE")
        ])).alias("value"),
    )
    ordered = lines.orderBy(~F.contains("value", F.lit("\tPOP")), "k")
    return as_file(spark, ordered, F.col("value"), "panel")


@register(
    "read_panel",
    """select concat('S',s_suppkey) sample, concat('POP',cast(s_suppkey%3 as int)) population, concat('R',s_nationkey) region,
         concat('ILLUMINA,L',s_nationkey) platforms from {supplier}""",
)
def read_panel(spark, sf):
    return variants.read_panel(spark, panel_file(spark, sf)).withColumn("platforms", joined("platforms"))


@register(
    "vcf_filter_population",
    """select chrom, pos1-1 pos, name id, string_agg(cell, ',' order by s) gts from {fx_cells} where s%3 in (0,1) group by 1,2,3""",
)
def vcf_filter_population(spark, sf):
    files = vcf_file(spark, sf)
    kept = convert.vcf_filter(
        variants.read_vcf(spark, files), variants.vcf_samples(spark, files), variants.read_panel(spark, panel_file(spark, sf)), ["POP0", "POP1"]
    )
    return kept.select("chrom", "pos", "id", joined("gts").alias("gts"))


@register(
    "vcf_to_alleleseq",
    """select chrom, pos+1 pos1, ref_allele "ref", concat(alt_allele,alt_allele) mat_gt, concat(ref_allele,ref_allele) pat_gt,
         concat(alt_allele,ref_allele) child_gt, 'PHASED' phase from {fx_snps}""",
)
def vcf_to_alleleseq(spark, sf):
    return convert.vcf_to_alleleseq(variants.read_vcf(spark, vcf_file(spark, sf)))


def alleleseq_file(spark: SparkSession, sf: str) -> str:
    rows = convert.vcf_to_alleleseq(vcf_rows(spark, sf))
    return as_file(spark, rows, tabbed(*rows.columns), "snps.alleleseq")


@register("read_alleleseq_snps", "select chrom, pos, alt_allele mat, ref_allele pat, 'PHASED' phase from {fx_snps}")
def read_alleleseq_snps(spark, sf):
    return variants.read_alleleseq(spark, alleleseq_file(spark, sf)).drop("_corrupt")


@register(
    "snp_file_dispatch",
    """select 'vcf' kind, chrom, pos+1 pos1, name, ref_allele "ref", alt_allele alt from {fx_snps}
       union all select 'alleleseq', chrom, pos+1, concat(chrom,':',pos+1), alt_allele, ref_allele from {fx_snps}
       union all select 'bed', chrom, pos+1, case when pos%2=0 then concat(chrom,':',pos+1) else name end, ref_allele, alt_allele from {fx_snps}""",
)
def snp_file_dispatch(spark, sf):
    snps = view(spark, sf, "fx_snps").withColumn("name", F.when(F.col("pos") % 2 == 0, ".").otherwise(F.col("name")))
    five = as_file(spark, snps, tabbed("chrom", "pos", F.col("pos") + 1, "name", F.concat("ref_allele", F.lit("|"), "alt_allele")), "five.bed")
    files = {"vcf": vcf_file(spark, sf), "alleleseq": alleleseq_file(spark, sf), "bed": five}
    out = None
    for kind, path in files.items():
        rows = variants.read_snps(spark, path).select(F.lit(kind).alias("kind"), "*").drop("_corrupt")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("read_locations", "select chrom, pos, 'bed' kind from {fx_snps} union all select chrom, pos, 'vcf' from {fx_snps}")
def read_locations(spark, sf):
    snps = view(spark, sf, "fx_snps")
    zero = bed.read_locations(spark, as_file(spark, snps, tabbed("chrom", "pos"), "locations.tsv"))
    one = bed.read_locations(spark, as_file(spark, snps, tabbed("chrom", F.col("pos") + 1), "locations"), base=bed.base_of("locations.vcf"))
    return zero.withColumn("kind", F.lit("bed")).unionByName(one.withColumn("kind", F.lit("vcf"))).drop("_corrupt")


@register(
    "read_fasta_tiles",
    """select chrom, cast(floor(k/100) as bigint) tile, string_agg(b, '' order by k) seq from (
         select chrom, tile*32+i-m*32 k, substr(seq, cast(i+1 as bigint), 1) b from (select *, min(tile) over () m from {fx_genome}) g
         cross join (select unnest(range(0,32)) i) ii) x group by 1,2""",
)
def read_fasta_tiles(spark, sf):
    path = new_path(spark, "genome.fa")
    tiles = view(spark, sf, "fx_genome")
    # One record per chromosome, its 32-base tiles as lines; records run on from file to file.
    rows = tiles.select("chrom", "tile", F.col("seq").alias("value")).unionByName(
        tiles.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("tile"), F.concat(F.lit(">"), "chrom").alias("value"))
    )
    rows.repartitionByRange("chrom", "tile").sortWithinPartitions("chrom", "tile").select("value").write.text(path)
    return sequences.read_fasta(spark, path, tile=100)


def fastq_file(spark: SparkSession, sf: str, where: str = "true", name: str = "reads.fq") -> str:
    path = new_path(spark, name)
    rows = view(spark, sf, "fx_fastq").where(where).orderBy("doc_id", "mate")
    sinks.write_fastq(rows, path)
    return path


@register("read_fastq", "select id, seq, qual from {fx_fastq}")
def read_fastq(spark, sf):
    return sequences.read_fastq(spark, fastq_file(spark, sf)).select("id", "seq", "qual")


@register(
    "read_sam",
    """select id, flag, chrom, pos1-1 "start", pos1-1+length(seq)-1 "end", case when flag=16 then translate(seq,'ACGTN','TGCAN') else seq end seq,
         flag=16 reverse from {fx_reads}""",
)
def read_sam(spark, sf):
    line = tabbed("id", "flag", F.concat("chrom", F.lit("_maternal")), "pos1", F.lit(60), F.lit("32M"), F.lit("*"), F.lit(0), F.lit(0), "seq", F.lit("*"))
    return sequences.read_sam(spark, as_file(spark, view(spark, sf, "fx_reads"), line, "reads.sam"), flip=True).drop("_corrupt")


@register("read_counts_nested", "select ind, chrom, pos, base, n from {fx_counts}")
def read_counts_nested(spark, sf):
    counts = view(spark, sf, "fx_counts")
    # Nested per position, so that no map grows with the table; the reader takes maps of any depth of content.
    nested = counts.groupBy("ind", "chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct("base", "n"))).alias("b")).select(
        "ind", F.create_map("chrom", F.create_map("pos", "b")).alias("counts")
    )
    return variants.explode_counts(nested, "counts", "ind")


@register(
    "read_enrichment",
    """select set_id "gene_set_ID", concat('set ',set_id) gene_set_description, round(p_value,12) p_value, 'No' "FDR_lt_0.05", sample, perm from {fx_enrich}""",
)
def read_enrichment(spark, sf):
    rows = view(spark, sf, "fx_enrich")
    out = None
    for s in ("sample_1", "sample_2"):
        path = new_path(spark, "enrichment.tsv")
        part = rows.where(F.col("sample") == s).select(
            F.concat_ws("|", "set_id", F.col("perm").cast("string")).alias("Original set"), F.concat(F.lit("set "), "set_id").alias("Text"), "p_value", F.lit("No").alias("FDR")
        )
        sinks.write_tsv(part, path)
        df = reports.read_enrichment(spark, path, "gene", sample=s)
        out = df if out is None else out.unionByName(df)
    key = F.split("gene_set_ID", r"\|")
    return out.withColumns({"perm": F.get(key, F.lit(1)).cast("int"), "gene_set_ID": F.get(key, F.lit(0)), "p_value": F.round("p_value", 12)})


@register(
    "read_enrichment_tissue",
    """select set_id "MeSH_term", concat('system ',perm) "MeSH_first_level_term", concat('part of ',set_id) "MeSH_second_level_term", round(p_value,12) p_value,
         case when perm%2=0 then 'Yes' else 'No' end "FDR_lt_0.05", 'sample_1' sample from {fx_enrich} where sample='sample_1'""",
)
def read_enrichment_tissue(spark, sf):
    path = new_path(spark, "tissues.tsv")
    rows = view(spark, sf, "fx_enrich").where("sample = 'sample_1'")
    sinks.write_tsv(rows.select(
        F.col("set_id").alias("Term"), F.concat(F.lit("system "), F.col("perm").cast("string")).alias("First"), F.concat(F.lit("part of "), "set_id").alias("Second"),
        "p_value", F.when(F.col("perm") % 2 == 0, "Yes").otherwise("No").alias("FDR")), path)
    return reports.read_enrichment(spark, path, "tissue", sample="sample_1").withColumn("p_value", F.round("p_value", 12))


@register(
    "collect_perm_runs",
    """select set_id "gene_set_ID", perm, sample, round(p_value,12) p_value from {fx_enrich}""",
)
def collect_perm_runs(spark, sf):
    folder = new_path(spark, "runs")
    rows = view(spark, sf, "fx_enrich").select(
        F.concat(F.lit("trait_perm_"), F.col("perm").cast("string"), F.lit("_"), "sample").alias("run"),
        F.col("set_id").alias("id"), F.lit("text").alias("description"), "p_value", F.lit("No").alias("fdr"),
    )
    rows.write.partitionBy("run").csv(folder, sep="\t", header=True)
    df = reports.read_perm_runs(spark, folder, "trait")
    return df.select("gene_set_ID", "perm", "sample", F.round("p_value", 12).alias("p_value"))


@register(
    "read_ld_report",
    """select name snp1, concat(name,'9') snp2, 'chr1' chrom, pos loc1, pos+10 loc2, 'YRI,ESN' populations, concat(ref_allele,',',alt_allele) alleles1,
         'G,A' alleles2, concat(pos%50,',',pos%7,',',pos%9,',',pos%40) "table", 0.5::double dprime, case when pos%3=0 then null else 0.25::double end r2,
         3.5::double chisq, 0.0::double p, '<0.0001' p_text, pos%2=0 in_ld, case when pos%2=0 then concat(ref_allele,'G') else '' end linked
       from {fx_snps}""",
)
def read_ld_report(spark, sf):
    s = view(spark, sf, "fx_snps")
    n = lambda e: F.expr(f"cast({e} as string)")
    other = F.concat("name", F.lit("9"))
    lines = [
        F.lit("Query SNPs:"),
        F.concat("name", F.lit(" (chr1:"), n("pos"), F.lit(")")),
        F.concat(other, F.lit(" (chr1:"), n("pos+10"), F.lit(")")),
        F.lit(""), F.lit("YRI+ESN Haplotypes:"), F.concat(F.lit("      "), other), F.lit("      G    A"), F.lit("     -------"),
        F.concat(F.lit("   "), "ref_allele", F.lit(" | "), n("pos%50"), F.lit(" | "), n("pos%7"), F.lit(" | 57 (0.5)")), F.lit("     -------"),
        F.concat(F.lit("   "), "alt_allele", F.lit(" | "), n("pos%9"), F.lit(" | "), n("pos%40"), F.lit(" | 49 (0.5)")), F.lit("     -------"),
        *[F.lit("x")] * 8,
        F.lit("  D': 0.5"), F.concat(F.lit("  R2: "), F.expr("if(pos%3=0, 'NA', '0.25')")), F.lit("  Chi-sq: 3.5"), F.lit("  p-value: <0.0001"), F.lit(""),
        F.when(F.expr("pos%2=0"), F.concat("name", F.lit("("), "ref_allele", F.lit(") allele is correlated with "), other, F.lit("(G) allele"))).otherwise(
            F.concat("name", F.lit(" and "), other, F.lit(" are in linkage equilibrium"))),
        F.when(F.expr("pos%2=0"), F.concat("name", F.lit("("), "alt_allele", F.lit(") allele is correlated with "), other, F.lit("(A) allele"))).otherwise(F.lit("")),
    ]
    parsed = reports.parse_ld_report(s.select(F.concat_ws("\n", *lines).alias("value"), F.col("ref_allele").alias("q")).select("value"))
    linked = F.coalesce(F.concat(F.get("alleles1", F.lit(0)), F.element_at("lookup1", F.get("alleles1", F.lit(0)))), F.lit(""))
    return parsed.select(
        "snp1", "snp2", "chrom", "loc1", "loc2", joined("populations").alias("populations"), joined("alleles1").alias("alleles1"),
        joined("alleles2").alias("alleles2"), joined("table").alias("table"), "dprime", F.nullif("r2", F.lit(float("nan"))).alias("r2"),
        "chisq", "p", "p_text", "in_ld", linked.alias("linked"),
    )


@register(
    "jdbc_snp_lookup",
    """select name, chrom, pos "chromStart", pos+1 "chromEnd" from {fx_snps} where chrom='chr2' and pos in (select pos1-1 from {fx_reads})""",
)
def jdbc_snp_lookup(spark, sf):
    snps = view(spark, sf, "fx_snps").select("name", "chrom", F.col("pos").alias("chromStart"), (F.col("pos") + 1).alias("chromEnd"))
    wanted = view(spark, sf, "fx_reads").select((F.col("pos1") - 1).alias("pos"))
    return database.snp_lookup(snps, "chr2", wanted)


@register("write_chrom_store", """select chrom, gene "name", gstart "start", gend "end" from {fx_genes}""")
def write_chrom_store(spark, sf):
    path = new_path(spark, "store")
    sinks.write_chrom_store(bed.read_bed(spark, gene_bed(spark, sf)), path)
    return spark.read.parquet(path)


@register("split_by_chrom", "select chrom, pos, name, ref_allele, alt_allele from {fx_snps}")
def split_by_chrom(spark, sf):
    path = new_path(spark, "by_chrom")
    sinks.write_by_chrom(view(spark, sf, "fx_snps"), path, "pos")
    return spark.read.parquet(path)


@register(
    "split_n_parts",
    "select o_orderkey, (row_number() over (order by o_orderkey)-1)//(count(*) over ()//7+1)+1 part from {orders}",
)
def split_n_parts(spark, sf):
    path = new_path(spark, "parts")
    sinks.write_parts(view(spark, sf, "orders").select("o_orderkey"), path, 7, "o_orderkey")
    return spark.read.csv(path, sep="\t", header=True, schema="o_orderkey long, part long")


@register("write_tsv", "select concat(chrom, ' ', pos) k, p p_value from {fx_points}")
def write_tsv(spark, sf):
    path = new_path(spark, "points.tsv")
    rows = view(spark, sf, "fx_points").select(F.concat_ws(" ", "chrom", F.col("pos").cast("string")).alias("k"), F.col("p").alias("p_value"))
    sinks.write_tsv(rows, path, "%.3e", compression="gzip")
    return spark.read.csv(path, sep="\t", header=True, schema="k string, p_value double")


@register("write_fastq", "select id, seq, qual, mate from {fx_fastq}")
def write_fastq(spark, sf):
    reads = view(spark, sf, "fx_fastq")
    out = None
    for mate in (1, 2):
        path = new_path(spark, f"mate{mate}.fq")
        sinks.write_fastq(reads.where(F.col("mate") == mate), path, compression="gzip")
        back = sequences.read_fastq(spark, path).select("id", "seq", "qual", F.lit(mate).alias("mate"))
        out = back if out is None else out.unionByName(back)
    return out


@register(
    "write_vcf",
    f"""select concat_ws(chr(9), chrom, pos1, name, ref_allele, alt_allele, '50', 'PASS', '.', 'GT:DP', replace(cells, ',', chr(9))) line from ({_VCF}) x
        union all select '##fileformat=VCFv4.1' union all select concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'S1', 'S2', 'S3', 'S4', 'S5', 'S6')
        union all select 'files without the header in front: 0'""",
)
def write_vcf(spark, sf):
    lines = text.lines_in_order(spark, vcf_file(spark, sf))
    heads = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "line")).alias("one"), F.min(F.when(F.col("value").startswith("#CHROM"), F.struct("block", "line"))).alias("two"), F.min(F.when(~F.col("value").startswith("#"), F.struct("block", "line"))).alias("body"))
    bad = heads.agg(F.count_if(~F.col("one").startswith("##fileformat=") | F.col("two").isNull() | (F.col("two") > F.col("body"))).alias("n"))
    body = lines.where(~F.col("value").startswith("#")).select(F.col("value").alias("line"))
    header = lines.where(F.col("value").startswith("#")).select(F.col("value").alias("line")).distinct()
    return body.unionByName(header).unionByName(bad.select(F.concat(F.lit("files without the header in front: "), F.col("n").cast("string")).alias("line")))


@register("bed_to_cov", "select chrom chrm, pstart snppos, cast(cast(floor(l10p*100) as bigint) as varchar) rd from {fx_peaks}")
def bed_to_cov(spark, sf):
    peaks = view(spark, sf, "fx_peaks")
    path = as_file(spark, peaks, tabbed("chrom", "pstart", "pend", "pop", F.floor(F.col("l10p") * 100).cast("long")), "cov.bed")
    return convert.bed_to_cov(bed.read_bed(spark, path))


@register("biomart_to_bed", """select chrom, pos "start", pos+1 "end", name from {fx_snps}""")
def biomart_to_bed(spark, sf):
    s = view(spark, sf, "fx_snps")
    path = new_path(spark, "biomart.tsv")
    t = convert.BIOMART_COLUMNS
    sinks.write_tsv(s.select(F.col("name").alias(t[3]), F.col("chrom").alias(t[0]), F.lit("x").alias("Extra"), F.col("pos").alias(t[1]), (F.col("pos") + 1).alias(t[2])), path)
    out = convert.biomart_to_bed(spark.read.csv(path, sep="\t", header=True))
    return out.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


_SCARF_SQL = "select concat('HWI:', doc_id, ':', mate) id, seq, qual from {fx_fastq}"


def scarf_file(spark: SparkSession, sf: str) -> str:
    line = F.concat_ws(":", F.lit("HWI"), F.col("doc_id").cast("string"), F.col("mate").cast("string"), "seq", "qual")
    return as_file(spark, view(spark, sf, "fx_fastq"), line, "reads.scarf")


@register("scarf_to_fastq", _SCARF_SQL)
def scarf_to_fastq(spark, sf):
    return sequences.parse_scarf(text.read_lines(spark, scarf_file(spark, sf))).drop("_corrupt")


@register("stream_convert", _SCARF_SQL)
def stream_convert(spark, sf):
    return streams.convert_available(spark, scarf_file(spark, sf), sequences.parse_scarf).drop("_corrupt")


@register(
    "genotype_matrix",
    "select concat('O',l_orderkey) sample, "
    + ", ".join(f"max(case when l_linenumber={i} then cast(l_partkey%3 as double) end) L{i}" for i in range(1, 8))
    + " from {lineitem} group by 1",
)
def genotype_matrix(spark, sf):
    long = view(spark, sf, "lineitem").select(
        F.concat(F.lit("O"), "l_orderkey").alias("sample"), F.concat(F.lit("L"), "l_linenumber").alias("snp"), F.expr("cast(l_partkey%3 as double)").alias("dosage")
    )
    return convert.genotype_matrix(long, [f"L{i}" for i in range(1, 8)])


@register(
    "genotype_blocks",
    """with i as (select snp, (row_number() over (order by snp)-1)//256 block, (row_number() over (order by snp)-1)%256 at_ from (select distinct snp from {fx_genotypes}) a),
       g as (select sample, block, at_, max(case gt when '0|0' then '0' when '1|1' then '2' else '1' end) d from {fx_genotypes} join i using (snp) group by 1,2,3),
       p as (select sample, i.block, i.at_ from (select distinct sample, block from g) s join i on i.block=s.block)
       select sample, p.block, string_agg(coalesce(d,'-'), ',' order by p.at_) dosages from p left join g using (sample, block, at_) group by 1,2""",
)
def genotype_blocks(spark, sf):
    long = view(spark, sf, "fx_genotypes").select("sample", "snp", convert.dosage(F.col("gt")).alias("dosage"))
    blocks, _ = convert.genotype_blocks(long, size=256)
    return blocks.select("sample", "block", F.array_join(F.col("values").cast("array<string>"), ",", "-").alias("dosages"))


@register(
    "number_records",
    "select concat(row_number() over (order by doc_id, mate)-1, ':', id) id, row_number() over (order by doc_id, mate)-1 \"number\", seq from {fx_fastq}",
)
def number_records(spark, sf):
    fq = sequences.read_fastq(spark, fastq_file(spark, sf))
    return convert.number_records(fq, "file", "record").select("id", "number", "seq")


@register("flip_parents", "select name, alt_allele mat, ref_allele pat from {fx_snps}")
def flip_parents(spark, sf):
    s = view(spark, sf, "fx_snps").select("name", F.col("ref_allele").alias("mat"), F.col("alt_allele").alias("pat"))
    return convert.flip_parents(s)


@register(
    "chrom_normalize",
    """select chrom, name, replace(chrom,'chr','') as num, chrom as added, replace(chrom,'chr','') bare from {fx_snps}""",
)
def chrom_normalize(spark, sf):
    s = view(spark, sf, "fx_snps")
    parental = F.concat("chrom", F.lit("_paternal"))
    return s.select(
        "chrom", "name", norm_chrom(parental, "num").alias("num"), norm_chrom(F.expr("substring(chrom, 4)"), "chr").alias("added"),
        norm_chrom("chrom", "num").alias("bare"),
    )


_RANK = """case lower(replace(chrom,'chr','')) when 'x' then 98 when 'y' then 99 when 'mt' then 100 else coalesce(try_cast(replace(chrom,'chr','') as int),101) end"""


@register("chrom_order", f"select chrom, pos, p, {_RANK} chrom_rank from {{fx_points}}")
def chrom_order(spark, sf):
    points = view(spark, sf, "fx_points").withColumn("chrom_rank", chrom_rank("chrom"))
    return points.orderBy("chrom_rank", "chrom", "pos")


@register("drop_n_reads_single", "select id, seq, qual from {fx_fastq} where seq not like '%N%'")
def drop_n_reads_single(spark, sf):
    return filters.drop_n(sequences.read_fastq(spark, fastq_file(spark, sf))).select("id", "seq", "qual")


_PAIRS = "from {fx_fastq} a join {fx_fastq} b on a.doc_id=b.doc_id and a.mate=1 and b.mate=2"


def mates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tuple(
        sequences.read_fastq(spark, fastq_file(spark, sf, f"mate = {m}", f"mate{m}.fq")).select("id", "seq", "qual") for m in (1, 2)
    )


@register(
    "drop_n_reads_paired",
    f"""select concat('read',a.doc_id) pair, a.seq seq1, b.seq seq2, 'both' how {_PAIRS} where not (a.seq like '%N%' and b.seq like '%N%')
        union all select concat('read',a.doc_id), a.seq, b.seq, 'any' {_PAIRS} where not (a.seq like '%N%' or b.seq like '%N%')""",
)
def drop_n_reads_paired(spark, sf):
    m1, m2 = mates(spark, sf)
    out = [
        filters.drop_n_paired(m1, m2, how).select("pair", F.col("m1.seq").alias("seq1"), F.col("m2.seq").alias("seq2"), F.lit(how).alias("how"))
        for how in ("both", "any")
    ]
    return out[0].unionByName(out[1])


@register("pair_mates", f"select concat('read',a.doc_id) pair, a.id id1, b.id id2 {_PAIRS}")
def pair_mates(spark, sf):
    return filters.pair_mates(*mates(spark, sf)).select("pair", F.col("m1.id").alias("id1"), F.col("m2.id").alias("id2"))


@register(
    "revcomp",
    "select id, translate(seq,'ACGTN','TGCAN') comp, reverse(translate(seq,'ACGTN','TGCAN')) rev, seq back from {fx_reads}",
)
def revcomp_reads(spark, sf):
    return view(spark, sf, "fx_reads").select("id", complement("seq").alias("comp"), revcomp("seq").alias("rev"), revcomp(revcomp("seq")).alias("back"))


@register("complement", "select concat(chrom,':',tile) place, translate(seq,'ACGTNacgtn','TGCANtgcan') comp from {fx_genome}")
def complement_tiles(spark, sf):
    return view(spark, sf, "fx_genome").select(F.concat_ws(":", "chrom", F.col("tile").cast("string")).alias("place"), complement("seq").alias("comp"))


@register("snp_id", "select concat(chrom,'.',pos) snp, chrom, pos from {fx_snps}")
def snp_ids(spark, sf):
    s = view(spark, sf, "fx_snps").select(snp_id("chrom", "pos").alias("snp"))
    chrom, pos = split_snp_id("snp")
    return s.select("snp", chrom.alias("chrom"), pos.alias("pos"))


@register(
    "file_kind",
    r"select url, regexp_extract(regexp_replace(concat(url,'.bed.gz'),'\.(gz|bz2)$',''),'([^.]*)$',1) packed, regexp_extract(regexp_replace(url,'\.(gz|bz2)$',''),'([^.]*)$',1) kind from {pages}",
)
def file_kind(spark, sf):
    return view(spark, sf, "pages").select("url", text.file_type(F.concat("url", F.lit(".bed.gz"))).alias("packed"), text.file_type("url").alias("kind"))
