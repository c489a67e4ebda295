import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lociframe.config import new_path
from lociframe.operators import convert, filters
from lociframe.operators.records import parse_md5sums
from lociframe.sources import bed, reports, sequences, sinks, text, variants
from lociframe.streaming import streams


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def folder(spark, name, *rows):
    path = new_path(spark, name)
    lines(spark, *rows).coalesce(1).write.text(path)
    return path


BED = ["#head", "chr1\t10\t200\tg1\t7\t-\t10\t200\t0\t2\t20,30,\t0,100,", "chr2\t5\t9", "chr3\tx\t9\tbad", "chr4\t0\t9\tg\t0\t+\t0\t9\t0\t3\t1,2\t0,5"]


def test_bed_rows_that_do_not_parse_are_kept_aside(spark):
    rows = {r.chrom: r for r in bed.parse_bed(lines(spark, *BED)).collect()}
    assert [(e.start, e.end) for e in rows["chr1"].exons] == [(10, 30), (110, 140)]
    assert rows["chr1"]._corrupt is None and rows["chr2"].name is None and rows["chr2"]._corrupt is None
    assert rows["chr3"]._corrupt.startswith("chr3") and rows["chr4"]._corrupt is not None
    assert bed.parse_gene_bed(lines(spark, *BED)).count() == 2


def test_base_shift_and_phase(spark):
    r = bed.parse_bed(lines(spark, "c\t10\t11\tA|C", "c\t20\t21\tA/C", "c\t30\t31\tAC"), snp=True, base=1).orderBy("start").collect()
    assert [(x.start, x.ref, x.alt, x.phased) for x in r[:2]] == [(9, "A", "C", True), (19, "A", "C", False)]
    assert r[2]._corrupt
    assert bed.base_of("a/x.vcf.gz") == 1 and bed.base_of("x.bed") == 0


def test_sniffing(spark):
    assert variants.sniff_snp_format(spark, folder(spark, "v", "##fileformat=VCFv4.0", "chr1\t1\t.\tA\tC")) == "vcf"
    assert variants.sniff_snp_format(spark, folder(spark, "a", "1\t5\tT\tTT\tGG\tTG\tPHASED")) == "alleleseq"
    with pytest.raises(ValueError):
        variants.sniff_snp_format(spark, folder(spark, "b", "chr1\t1\t2\tn\tAC"))
    with pytest.raises(ValueError):
        variants.sniff_snp_format(spark, folder(spark, "c", "what"))
    row = variants.read_snps(spark, folder(spark, "d", "1\t5\tT\tTT\tGG\tTG\tPHASED")).first()
    assert tuple(row) == ("chr1", 5, "chr1:5", "T", "G", None)


def test_vcf_errors(spark):
    bad = variants.parse_vcf(lines(spark, "1\t5\trs\tA\tC\t.\t.\t.\tGT\t0|0:3\t0/1"))
    with pytest.raises(Exception, match="unknown genotype"):
        convert.vcf_simplify(bad).collect()
    kept = convert.vcf_simplify(bad, on_error="quarantine").first()
    assert kept.dosages == [0, None] and kept._bad
    path = folder(spark, "h", "##fileformat=VCFv4.1", "#CHROM\tPOS\tNAME\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1")
    assert variants.vcf_version(spark, path) == "VCFv4.1"
    with pytest.raises(Exception, match="not a VCF header"):
        variants.vcf_samples(spark, path).collect()


def test_called_snp_table(spark):
    row = "1\t5\tA\tTT\tGG\tTG\tPHASED\tT\tG\t1\t2\t30\t4\tP\tAsym\t0.001\t0\t1.0"
    r = variants.parse_calls(lines(spark, "chrm\tsnppos", row)).first()
    assert (r.chrom, r.pos, r.mat_counts, r.pat_counts, r.other_counts, r.win, r.cls, r.pval) == ("chr1", 4, 4, 30, 3, "P", "Asym", 0.001)


def test_fasta_over_files(spark, tmp_path):
    seqs = {"chr1": "ACGTN" * 41, "chr2": "GATTACA" * 30, "chrM": "A"}
    for c, s in seqs.items():
        body = f">{c} some text\n" + "\n".join(s[i : i + 17] for i in range(0, len(s), 17)) + "\n"
        if c == "chr2":
            (tmp_path / f"{c}.fa.gz").write_bytes(gzip.compress(body.encode()))
        else:
            (tmp_path / f"{c}.fa").write_text(body)
    tiles = sequences.read_fasta(spark, str(tmp_path), tile=50).collect()
    for c, s in seqs.items():
        assert "".join(t.seq for t in sorted((t for t in tiles if t.chrom == c), key=lambda t: t.tile)) == s
    assert all(len(t.seq) <= 50 for t in tiles)


def test_fastq_round_trip_and_numbering(spark):
    df = spark.createDataFrame([(f"r{i}/1", "ACGN"[i % 4] * 4, "IIII") for i in range(50)], "id string, seq string, qual string")
    path = new_path(spark, "fq")
    sinks.write_fastq(df.coalesce(1), path, compression="gzip")
    back = sequences.read_fastq(spark, path)
    assert sorted(map(tuple, back.select("id", "seq", "qual").collect())) == sorted(map(tuple, df.collect()))
    numbered = convert.number_records(back, "file", "record").select("number", "id").orderBy("number").collect()
    assert [(r.number, r.id) for r in numbered] == [(i, f"{i}:r{i}/1") for i in range(50)]


def test_mates(spark):
    rows = [("a", "ANA", "AAA"), ("b", "ANA", "ANN"), ("c", "AAA", "AAA")]
    one = spark.createDataFrame([(f"{i}/1", s) for i, s, _ in rows] + [("lone/1", "A")], "id string, seq string")
    two = spark.createDataFrame([(f"{i}/2", s) for i, _, s in rows], "id string, seq string")
    assert {r.pair for r in filters.drop_n_paired(one, two, "both").collect()} == {"a", "c"}
    assert {r.pair for r in filters.drop_n_paired(one, two, "any").collect()} == {"c"}
    assert [tuple(r) for r in filters.unpaired(one, two).collect()] == [("lone", "lone/1", 1)]


def test_sam_flags(spark):
    sam = lines(spark, "@HD\tx", "q\t16\tchr1_paternal\t5\t9\t3M\t*\t0\t0\tACN\t*", "p\t0\tchr1\t5\t9\t3M\t*\t0\t0\tACN\t*")
    r = {x.id: x for x in sequences.parse_sam(sam, flip=True).collect()}
    assert (r["q"].chrom, r["q"].start, r["q"].end, r["q"].seq, r["q"].reverse) == ("chr1", 4, 6, "TGN", True)
    assert r["p"].seq == "ACN"


def test_ld_report_without_linkage(spark):
    body = ["Query SNPs:", "rs1 (chr1:10)", "rs2 (chr1:20)", "", "CEU Haplotypes:", "rs2", "G A", "---", "C | 1 | 2 | 3 (0.5)", "---", "T | 4 | 5 | 9 (0.5)",
            "---"] + ["x"] * 8 + ["D': 0.1", "R2: 0.2", "Chi-sq: 0.3", "p-value: 0.4", "", "rs1 and rs2 are in linkage equilibrium", ""]
    r = reports.parse_ld_report(lines(spark, "\n".join(body))).first()
    assert (r.snp1, r.snp2, r.loc1, r.loc2, r.populations, r.alleles1, r.alleles2, r.table) == ("rs1", "rs2", 10, 20, ["CEU"], ["C", "T"], ["G", "A"], [1, 2, 4, 5])
    assert (r.dprime, r.r2, r.chisq, r.p, r.in_ld, r.lookup1) == (0.1, 0.2, 0.3, 0.4, False, {})


def test_split_parts_and_store(spark):
    parts = sinks.split_parts(spark.range(25).withColumnRenamed("id", "v"), 4, "v").collect()
    assert {r.v: r.part for r in parts} == {v: v // 7 + 1 for v in range(25)}
    rows = bed.parse_bed(lines(spark, "c1\t5\t9\tn", "c1\t1\t2\tm", "c2\t5\t9"))
    path = new_path(spark, "store")
    assert sinks.write_chrom_store(rows, path) and not sinks.write_chrom_store(rows, path)
    assert [tuple(r) for r in spark.read.parquet(path).where("chrom = 'c1'").select("name", "start").orderBy("start").collect()] == [("m", 1), ("n", 5)]


def test_md5_manifest(spark):
    m = "d41d8cd98f00b204e9800998ecf8427e"
    assert [tuple(r) for r in parse_md5sums(lines(spark, f"{m}  a b.txt", f"{m} *c", "junk")).collect()] == [("a b.txt", m), ("c", m)]


# Every stateless reader and conversion gives on a stream what it gives on a batch.
ROWS = {
    "bed": (BED, bed.parse_bed),
    "bed_snps": (["c\t10\t11\tA|C"], lambda d: bed.parse_bed(d, snp=True)),
    "gene_bed": (BED, bed.parse_gene_bed),
    "gtf": (['1\ts\texon\t5\t9\t.\t+\t.\tgene_id "g"; transcript_id "t"'], bed.parse_gtf),
    "locations": (["c\t5"], bed.parse_locations),
    "vcf": (["#x", "1\t5\trs\tA\tC\t.\t.\t.\tGT\t0|1"], variants.parse_vcf),
    "dosage": (["1\t5\trs\tA\tC\t.\t.\t.\tGT\t0|1"], lambda d: convert.vcf_simplify(variants.parse_vcf(d))),
    "alleleseq": (["1\t5\tT\tTT\tGG\tTG\tPHASED"], variants.parse_alleleseq),
    "to_alleleseq": (["1\t5\trs\tA\tC"], lambda d: convert.vcf_to_alleleseq(variants.parse_vcf(d))),
    "hybrid": (["c\t10\t11\tA|C"], lambda d: convert.bed_to_vcf(bed.parse_bed(d, snp=True))),
    "gtf_out": (BED, lambda d: convert.bed12_to_gtf(bed.parse_bed(d))),
    "cov": (["c\t1\t2\tn\t7"], lambda d: convert.bed_to_cov(bed.parse_bed(d))),
    "sam": (["p\t0\tchr1\t5\t9\t3M\t*\t0\t0\tACN\t*"], sequences.parse_sam),
    "scarf": (["a:b:ACGT:IIII"], sequences.parse_scarf),
    "no_n": (["a:ACGT:IIII", "b:ANGT:IIII"], lambda d: filters.drop_n(sequences.parse_scarf(d))),
    "kinds": (["x/y.bed.gz", "z.gtf"], lambda d: d.select(text.file_type("value").alias("k"))),
}


@pytest.mark.parametrize("name", list(ROWS))
def test_stream_gives_the_batch_result(spark, name):
    rows, convert_fn = ROWS[name]
    path = folder(spark, name, *rows)
    batch = convert_fn(text.read_lines(spark, path))
    stream = streams.convert_available(spark, path, convert_fn, name)
    assert stream.columns == batch.columns
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect())) != []


def test_interval_lookup_on_a_stream(spark):
    path = folder(spark, "points", "c\t5", "c\t15", "c\t50")
    ivs = spark.createDataFrame([("c", 0, 10, "g1", 0), ("c", 4, 20, "g2", 1)], "chrom string, start long, end long, gene string, ord long")
    out = new_path(spark, "assigned")
    streams.assign_available(bed.parse_locations(streams.text_stream(spark, path)), ivs, out)
    assert sorted((r.pos, r.gene) for r in spark.read.parquet(out).collect()) == [(5, "g1"), (15, "g2")]


def test_unequal_blocks_are_corrupt(spark):
    from lociframe.sources import bed

    lines = spark.createDataFrame([("chr1\t0\t10\tg\t0\t+\t0\t10\t0\t2\t5,5\t0",)], "value string")
    row = bed.parse_bed(lines).first()
    assert row["_corrupt"] is not None


BAD = {
    "gtf": (lambda d: bed.parse_gtf(d), ["bad line", "1\ts\tgene\tx\t9\t.\t+\t.\tg", "1\ts\texon\t5"]),
    "locations": (bed.parse_locations, ["bad line", "c\tx"]),
    "sam": (sequences.parse_sam, ["bad line", "p\tx\tchr1\t5\t9\t3M\t*\t0\t0\tACN\t*", "p\t0\tchr1\t5"]),
    "scarf": (sequences.parse_scarf, ["bad", "a:b", ":"]),
    "calls": (variants.parse_calls, ["bad line", "1\tx\tA", "1\t5\tA\tTT\tGG\tTG\tPHASED\tT\tG\t1\t2\tx\t4\tP\tAsym\t0.001\t0\t1.0"]),
    **{f"snps_{k}": (lambda d, k=k: variants.parse_snps(d, k), ["bad line", "1\tx\t.\tA\tC\tTG", "1\t5"]) for k in ("bed", "vcf", "alleleseq")},
}


@pytest.mark.parametrize("name", list(BAD))
def test_rows_that_do_not_parse_keep_their_line(spark, name):
    parse, rows = BAD[name]
    assert sorted(r["_corrupt"] for r in parse(lines(spark, *rows)).collect()) == sorted(rows)


def test_only_the_parental_suffix_is_cut(spark):
    row = "p\t0\tchr1_KI270706v1_random\t5\t9\t3M\t*\t0\t0\tACN\t*"
    assert sequences.parse_sam(lines(spark, row)).first().chrom == "chr1_KI270706v1_random"


def test_lines_are_numbered_without_a_shuffle_on_the_file(spark):
    path = folder(spark, "n", *[str(i) for i in range(300)])
    one, two = folder(spark, "m", "x", "y"), text.numbered_lines(spark, path)
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" not in plan
    assert {int(r["value"]): r["row"] for r in two.collect()} == {i: i for i in range(300)}
    assert sorted((r["row"], r["value"]) for r in text.numbered_lines(spark, [path, one]).collect() if r["value"] in "xy") == [(0, "x"), (1, "y")]


def test_version_and_header_from_the_first_lines(spark):
    old = folder(spark, "o", "##fileformat=VCFv4.0", "1\t5\trs\tA\tC\t.\t.\t.\tGT\t0|1")
    with pytest.raises(ValueError, match="VCFv4.0"):
        variants.read_versioned_vcf(spark, old)
    assert variants.read_versioned_vcf(spark, old, "VCFv4.0").count() == 1
    assert variants.vcf_version(spark, folder(spark, "p", "1\t5", "##fileformat=VCFv4.1")) is None
    comments = folder(spark, "c", *["# x"] * (variants.LEADING + 5), "1\t5\tT\tTT\tGG\tTG\tPHASED")
    assert variants.sniff_snp_format(spark, comments) == "alleleseq"


def test_parts_are_files_with_the_header(spark, tmp_path):
    sinks.write_parts(spark.range(25).selectExpr("id AS v", "id % 3 AS w"), f"{tmp_path}/parts", 4, "v")
    found = {p.parent.name: p.read_text().split("\n")[:-1] for p in tmp_path.glob("parts/*/*.csv")}
    assert found == {f"part={k + 1}": ["v\tw", *[f"{v}\t{v % 3}" for v in range(7 * k, min(25, 7 * k + 7))]] for k in range(4)}
    assert len(list(tmp_path.glob("parts/*/*.csv"))) == 4


def _small_splits(spark, size, fn):
    """Run with files cut into splits of ``size`` bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        return fn()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [7, 23, 64, 1 << 20])
def test_fastq_over_split_edges(spark, tmp_path, size):
    reads = [(f"r{i} @x", "ACGT" * (i % 5) + "N", "@+>I" * (i % 5) + "+") for i in range(30)]
    (tmp_path / "a.fq").write_text("".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in reads))
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(b"@z\nA\n+\nI\n@cut\nAC\n"))
    (tmp_path / "empty.fq").write_text("")

    def read():
        df = sequences.read_fastq(spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" not in plan and "LogicalRDD" not in plan
        return df.select(F.regexp_extract("file", r"([^/]+)$", 1), "record", "id", "seq", "qual").collect()

    got = sorted(map(tuple, _small_splits(spark, size, read)), key=repr)
    assert got == sorted([("a.fq", k, *r) for k, r in enumerate(reads)] + [("b.fq.gz", 0, "z", "A", "I"), ("b.fq.gz", 1, "cut", "AC", None)], key=repr)


@pytest.mark.parametrize("size", [5, 16, 61, 1 << 20])
def test_fasta_over_split_edges(spark, tmp_path, size):
    r = random.Random(size)
    seqs = {f"c{k}": "".join(r.choice("ACGTacgtN") for _ in range(n)) for k, n in enumerate([1, 20, 0, 133, 40, 41, 300])}
    body = "orphan bases\n\n" + "".join(f">{c} text > more\n" + "".join(s[i : i + 9] + "\n" for i in range(0, len(s), 9)) for c, s in seqs.items())
    cut = body.index(">c4") - 30  # the sequence before runs on in the next file
    cut = body.rindex("\n", 0, cut) + 1
    (tmp_path / "1.fa").write_text(body[:cut])
    (tmp_path / "2.fa").write_text(body[cut:])
    rows = _small_splits(spark, size, lambda: sequences.read_fasta(spark, str(tmp_path), tile=20).collect())
    got = sorted((x.chrom, x.tile, x.seq) for x in rows)
    assert got == sorted((c, i // 20, s[i : i + 20]) for c, s in seqs.items() for i in range(0, len(s), 20))
    flanked = sequences.read_fasta(spark, str(tmp_path), tile=20, flank=7).where("chrom = 'c6' and tile = 3").first()
    s = seqs["c6"]
    assert (flanked.before, flanked.seq, flanked.after) == (s[53:60], s[60:80], s[80:87])


def test_every_part_is_a_whole_vcf(spark, tmp_path):
    df = spark.range(20).select(
        F.lit("chr1").alias("chrom"), F.col("id").alias("pos"), F.concat(F.lit("rs"), "id").alias("id"), F.lit("A").alias("ref"), F.lit("C").alias("alt"),
        F.lit(None).cast("string").alias("qual"), F.lit("PASS").alias("filter"), F.lit(".").alias("info"), F.lit("GT").alias("format"), F.array(F.lit("0|1"), F.lit("1|1")).alias("gts"),
    )
    path = f"{tmp_path}/out.vcf"
    sinks.write_vcf(df.repartition(3), ["S1", "S2"], path)
    files = sorted(Path(path).glob("part-*"))
    assert len(files) == 3
    back = []
    for f in files:
        assert variants.vcf_version(spark, str(f)) == "VCFv4.1"
        assert [r.sample for r in variants.vcf_samples(spark, str(f)).orderBy("idx").collect()] == ["S1", "S2"]
        back += [(r.pos, r.id, r.gts) for r in variants.read_vcf(spark, str(f)).collect()]
    assert sorted(back) == [(k, f"rs{k}", ["0|1", "1|1"]) for k in range(20)]


def test_a_matrix_of_a_million_snps(spark):
    n = 1_000_000
    long = spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 3).alias("sample"), F.format_string("rs%07d", "id").alias("snp"), (F.col("id") % 3).cast("int").alias("dosage"))
    blocks, index = convert.genotype_blocks(long)
    got = blocks.select("sample", F.size("values").alias("n"), F.aggregate(F.filter("values", lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v).alias("sum")).groupBy("sample").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.count("*").alias("blocks")).collect()
    assert {r["sample"]: (r["n"], r["sum"], r["blocks"]) for r in got} == {f"s{k}": (n, k * len(range(k, n, 3)), 245) for k in range(3)}
    assert index.count() == n
    with pytest.raises(ValueError, match="genotype_blocks"):
        convert.genotype_matrix(long, [f"rs{i}" for i in range(5000)])


def test_blocks_of_a_matrix(spark):
    rows = [("b", "s1", 1), ("b", "s3", 2), ("b", "s3", 0), ("a", "s2", None), ("a", "s5", 1), ("a", None, 1), (None, "s4", 2)]
    blocks, index = convert.genotype_blocks(spark.createDataFrame(rows, "sample string, snp string, dosage int"), size=2)
    assert {(r["sample"], r.block): r["values"] for r in blocks.collect()} == {("b", 0): [1, None], ("b", 1): [2, None], ("a", 0): [None, None], ("a", 2): [1], (None, 1): [None, 2]}
    assert sorted(map(tuple, index.collect())) == [("s1", 0, 0), ("s2", 0, 1), ("s3", 1, 0), ("s4", 1, 1), ("s5", 2, 0)]


def test_blocks_are_written_without_a_lambda_a_cell(spark):
    """The values of a block are cast and joined as they are; a lambda over each of 256 took longer than all else."""
    from lociframe.plans import catalog

    found = catalog.queries()["genotype_blocks"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join(cast(" in plan and "array_join(transform(" not in plan
    first = found.where("block = 0").first()["dosages"].split(",")
    assert len(first) == min(256, found.sparkSession.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey").distinct().count()) and set(first) <= set("012-")
