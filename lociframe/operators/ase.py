"""Allele-specific expression: counts to SNPs, SNPs to genes, genes to a false-discovery rate."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.config import pin
from lociframe.functions.bases import reverse_when
from lociframe.functions.stats import fair_binomial_p, nan
from lociframe.plans import ranged
from lociframe.plans.lookups import lookup

# Thresholds of the SNP and gene calls.
MIN_PARENTAL = 0.9
ALPHA = 0.05
MAX_N_SHARE = 0.25
MAX_OTHER_SHARE = 0.1
GENE_WEIRD = 0.4
GENE_MAJORITY = 0.6
TOO_MANY_N = "Ns > 0.25"


def counts_by_allele(counts: DataFrame, snps: DataFrame, how: str = "inner") -> DataFrame:
    """Base counts (.., chrom, pos, base, n) next to the alleles of their SNP (mat, pat, ..).

    ``how="left"`` keeps positions without a SNP, with NULL alleles.
    """
    return counts.join(snps, ["chrom", "pos"], how)


def snp_counts(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Maternal, paternal, N and other counts per SNP."""
    base = F.upper("base")
    is_mat, is_pat = base == F.col("mat"), base == F.col("pat")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    return joined.groupBy(*keys).agg(
        total(is_mat).alias("mat_counts"),
        total(~is_mat & is_pat).alias("pat_counts"),
        total(~is_mat & ~is_pat & (base == "N")).alias("n_counts"),
        total(~is_mat & ~is_pat & (base != "N")).alias("other_counts"),
    )


def snp_pval(df: DataFrame) -> DataFrame:
    """Adds ``pval``, the two-sided fair-coin p of the smaller parental count.

    NaN unless there is more than one read and either few other bases or many Ns. The second half
    of that gate reads as if it were inverted; results depend on it, so it stays.
    """
    total = F.col("mat_counts") + F.col("pat_counts") + F.col("n_counts") + F.col("other_counts")
    tested = (total > 1) & (
        (F.col("other_counts") / total < MAX_OTHER_SHARE) | (F.col("n_counts") / total > MAX_N_SHARE)
    )
    p = fair_binomial_p(F.least("mat_counts", "pat_counts"), F.col("mat_counts") + F.col("pat_counts"))
    return df.withColumn("pval", F.when(tested, p).otherwise(nan()))


def snp_winner(df: DataFrame) -> DataFrame:
    """Adds ``win``: NA, too many Ns, WEIRD, mat, pat, homo or NS."""
    total = F.col("mat_counts") + F.col("pat_counts") + F.col("n_counts") + F.col("other_counts")
    parental = F.col("mat_counts") + F.col("pat_counts")
    significant = ~F.isnan("pval") & (F.col("pval") < ALPHA)
    return df.withColumn(
        "win",
        F.when(total <= 2, "NA")
        .when(F.col("n_counts") / total > MAX_N_SHARE, TOO_MANY_N)
        .when(parental / (total - F.col("n_counts")) < MIN_PARENTAL, "WEIRD")
        .when(F.col("pval").isNull(), "NA")
        .when(significant & (F.col("mat_counts") > F.col("pat_counts")), "mat")
        .when(significant & (F.col("pat_counts") > F.col("mat_counts")), "pat")
        .when(significant, "homo")
        .otherwise("NS"),
    )


def call_counts(df: DataFrame) -> DataFrame:
    """Class and winning parent of one SNP from its four base counts.

    Input: a, c, g, t counts, a1 and a2 (child alleles), mat_allele and pat_allele (NULL when not
    phased). Adds pval, cls (Weird, Asym, Sym, Homozygous) and parent (M, P, ?). Without any of the
    four bases the parental alleles are not the bulk of the reads: Weird.
    """
    def of(allele: Column) -> Column:
        a = F.lower(allele)
        return (
            F.when(a == "a", F.col("a")).when(a == "c", F.col("c")).when(a == "g", F.col("g")).otherwise(F.col("t"))
        )

    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    n1, n2 = of(F.col("a1")), of(F.col("a2"))
    homozygous = F.lower("a1") == F.lower("a2")
    # The most frequent base; the later letter wins a tie.
    major = F.greatest(*[F.struct(F.col(b).alias("n"), F.lit(b).alias("base")) for b in "acgt"])["base"]
    phased = F.col("mat_allele").isNotNull() & F.col("pat_allele").isNotNull()
    weird = F.coalesce(F.try_divide(F.when(homozygous, n1).otherwise(n1 + n2), total), F.lit(0.0)) < MIN_PARENTAL
    return (
        df.withColumn("pval", fair_binomial_p(F.least(n1, n2), n1 + n2))
        .withColumn(
            "cls",
            F.when(weird, "Weird").when(homozygous, "Homozygous").when(F.col("pval") < ALPHA, "Asym").otherwise("Sym"),
        )
        .withColumn(
            "parent",
            F.when((F.col("cls") == "Weird") | ~phased, "?")
            .when(F.lower("mat_allele") == major, "M")
            .when(F.lower("pat_allele") == major, "P")
            .otherwise("?"),
        )
    )


def _median_p() -> Column:
    """Median p of a group, NaN as soon as one SNP has none.

    The buffer of ``percentile`` holds one entry per distinct p. A p-value is a function of two read
    counts, so read depth bounds the buffer, not the number of rows, and partial aggregation merges
    the copies before the shuffle.
    """
    return F.when(F.max(F.isnan("pval")), nan()).otherwise(F.percentile("pval", 0.5))


def gene_summary(snps: DataFrame, by: list[str], variant: str = "counts") -> DataFrame:
    """One row per gene: counts, SNPs, median p, tallies and winner.

    ``variant="counts"`` takes snp_winner output. ``variant="alleleseq"`` takes rows called
    elsewhere: win in M/P/?, cls in Sym/Asym/Weird; there the p-value does not gate the winner.
    """
    def tally(cond: Column) -> Column:
        return F.count_if(cond).cast("long")

    win = F.col("win")
    sums = [F.sum(c).alias(c) for c in ("mat_counts", "pat_counts", "n_counts", "other_counts") if c in snps.columns]
    if variant == "counts":
        tallies = [
            tally(win == "mat").alias("mat_wins"),
            tally(win == "pat").alias("pat_wins"),
            tally(win == "NS").alias("not_sig"),
            tally(win == "WEIRD").alias("weird"),
            tally(~win.isin("mat", "pat", "NS", "WEIRD")).alias("failed"),
        ]
    elif variant == "alleleseq":
        cls = F.col("cls")
        tallies = [
            tally(win == "M").alias("mat_wins"),
            tally(win == "P").alias("pat_wins"),
            tally(win == "?").alias("failed"),
            tally(cls == "Sym").alias("no_ase"),
            tally(cls == "Asym").alias("has_ase"),
            tally(cls == "Weird").alias("weird"),
        ]
    else:
        raise ValueError(f"variant must be counts or alleleseq, not {variant}")
    genes = snps.groupBy(*by).agg(
        *sums, F.count(F.lit(1)).alias("snps"), _median_p().alias("pval"), *tallies
    )
    n, mat, pat = F.col("snps"), F.col("mat_wins"), F.col("pat_wins")
    called = (
        F.when(F.col("weird") / n > GENE_WEIRD, "WEIRD")
        .when((mat > pat) & (mat / n > GENE_MAJORITY), "mat")
        .when((pat > mat) & (pat / n > GENE_MAJORITY), "pat")
        .otherwise("?")
    )
    if variant == "counts":
        significant = ~F.isnan("pval") & (F.col("pval") < ALPHA)
        called = F.when(significant, called).otherwise("NS")
    return genes.withColumn("winner", F.when(F.col("pval").isNull(), "NA").otherwise(called))


def analyze(counts: DataFrame, placed: DataFrame, ind: str = "ind", extra: DataFrame | None = None) -> DataFrame:
    """Whole job: counts of all individuals and SNPs placed in genes -> one gene table.

    A gene row covers the SNPs that have counts in that individual. ``extra`` adds columns by gene.
    """
    summed = snp_counts(counts_by_allele(counts, placed), [ind, "chrom", "pos", "gene"])
    called = snp_winner(snp_pval(summed)).drop("chrom", "pos")
    genes = gene_summary(called, [ind, "gene"])
    return genes if extra is None else genes.join(extra, "gene", "left")


def gene_list(placed: DataFrame) -> DataFrame:
    return placed.select("gene").distinct()


def placement_stats(snps: DataFrame, placed: DataFrame) -> DataFrame:
    """Per chromosome: SNPs, those in genes, percent."""
    seen = snps.groupBy("chrom").agg(F.count(F.lit(1)).alias("total"))
    hit = placed.groupBy("chrom").agg(F.count(F.lit(1)).alias("in_gene"))
    return seen.join(hit, "chrom", "left").select(
        "chrom",
        "total",
        F.coalesce("in_gene", F.lit(0)).alias("in_gene"),
        (100 * F.coalesce("in_gene", F.lit(0)) / F.col("total")).alias("percent"),
    )


# ---- simulated false-discovery rate ----

#: Hex digits of a digest that make a uniform number, and how many numbers a digest gives.
DIGITS, A_DIGEST = 13, 2


def uniform(key: Column, place: Column, seed: int = 0) -> Column:
    """The uniform number in [0, 1) at a place from 0: a pure function of (key, place, seed), the same on every retry and partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.call_function("div", place, F.lit(A_DIGEST)).cast("string")))
    return F.conv(F.substring(digest, 1 + DIGITS * (place % A_DIGEST), F.lit(DIGITS)), 16, 10).cast("double") / float(16**DIGITS)


def coin_table(depths: DataFrame) -> DataFrame:
    """For each depth ``flips``: the chance of at most k on the rarer side of that many fair flips (``upto``, k from ``first`` to half of them), where to look in it for
    a uniform number (``guide``), and the p-value of each k.

    Only k that a number of 52 bits can reach are listed, about 5 times the square root of the depth.
    """
    @F.pandas_udf("first int, upto array<double>, guide array<int>")
    def chances(flips: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for n in map(int, flips):
            half = n // 2
            k = np.arange(half - min(half, int(4.7 * math.sqrt(n)) + 20), half)
            # From the middle outwards, so that nothing underflows on the way.
            share = np.cumprod(((k + 1.0) / (n - k))[::-1])[::-1]
            chance = _central(n) * np.append(share, 1.0) * 2
            if n % 2 == 0:
                chance[-1] /= 2
            upto = np.cumsum(chance)
            upto[-1] = 2.0  # whatever is left
            size = len(upto)
            out.append((half - len(k), upto, np.searchsorted(upto, np.arange(size + 1) / size, side="right").astype(np.int32)))
        return pd.DataFrame(out, columns=["first", "upto", "guide"])

    table = depths.withColumn("_c", chances("flips")).select("flips", "_c.*")
    ks = F.sequence(F.col("first"), F.expr("cast(flips div 2 as int)"))
    return table.withColumn("p", F.transform(ks, lambda k: F.round(fair_binomial_p(k, F.col("flips")), 12)))


def _central(n: int) -> float:
    """The chance of n // 2 heads."""
    half = n // 2
    if n <= 1000:
        return math.comb(n, half) / 2**n
    # The asymptotic series of the middle of 2 * half flips, exact to the last digits from here on.
    middle = (1 - 1 / (8 * half) + 1 / (128 * half**2) + 5 / (1024 * half**3) - 21 / (32768 * half**4)) / math.sqrt(math.pi * half)
    return middle * (n / (half + 1) / 2 if n % 2 else 1.0)


def simulate(df: DataFrame, key: str, sims: int = 5, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Histogram of simulated p-values for rows with mat_counts and pat_counts: columns by.., p, drawn.

    Every draw is one uniform number looked up in the table of its depth (``coin_table``), so it costs the same at any depth. There is one table a
    distinct depth; they are broadcast if their size allows.
    """
    by = by or []
    flips = (F.col("mat_counts") + F.col("pat_counts")).cast("long")
    rows = df.select(*by, F.col(key).alias("_key"), flips.alias("flips"))
    table = pin(coin_table(rows.where("flips IS NOT NULL").select("flips").distinct()))
    found = lookup(rows, table, ["flips"])

    # A row for each draw first, so that nearly all is plain columns and no lambda over an array of draws.
    drawn = found.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).withColumn("_u", uniform(F.col("_key"), F.col("_s"), seed))
    size = F.size("upto")
    drawn = drawn.withColumn("_j", F.least(F.floor(F.col("_u") * size).cast("int"), size - 1))
    drawn = drawn.withColumns({"_low": F.get("guide", F.col("_j")), "_high": F.get("guide", F.col("_j") + 1)})
    beyond = F.filter(F.slice("upto", F.col("_low") + 1, F.col("_high") - F.col("_low")), lambda c: c <= F.col("_u"))
    drawn = drawn.select(*by, F.get("p", F.col("_low") + F.size(beyond)).alias("p"))
    return drawn.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("drawn"))


# The p-values the report lists.
FDR_GRID = [i * 0.001 for i in range(10)] + [i * 0.01 for i in range(1, 10)] + [i * 0.1 for i in range(1, 10)]


def _tested(df: DataFrame) -> DataFrame:
    return df.where(F.col("pval").isNotNull() & ~F.isnan("pval"))


def fdr_grid(df: DataFrame, key: str, sims: int = 5, seed: int = 0) -> DataFrame:
    """FDR at 28 fixed p-values: p, n_actual, mean_sim, fdr = mean_sim / (n_actual + 1)."""
    tested = _tested(df)
    points = [round(p, 3) for p in FDR_GRID]
    none = F.lit(0).cast("long")
    actual = tested.groupBy(F.round("pval", 12).alias("p")).agg(F.count(F.lit(1)).alias("a"))
    both = actual.withColumn("s", none).unionByName(
        simulate(tested, key, sims, seed).select("p", none.alias("a"), F.col("drawn").alias("s"))
    )

    def upto(p: float, weight: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("p") <= p, F.col(weight))), none)

    # One pass over the distinct p-values; no filter, which would be pushed below their aggregation.
    row = both.agg(
        F.array(*[F.struct(F.lit(p).alias("p"), upto(p, "a").alias("n_actual"), upto(p, "s").alias("n_sim")) for p in points])
        .alias("grid")
    )
    return row.select(F.inline("grid")).select(
        "p",
        "n_actual",
        (F.col("n_sim") / sims).alias("mean_sim"),
        (F.col("n_sim") / sims / (F.col("n_actual") + 1)).alias("fdr"),
    )


def fdr_cutoff(
    df: DataFrame, key: str, target: float = 0.1, sims: int = 5, seed: int = 0, by: list[str] | None = None
) -> DataFrame:
    """The largest observed p whose simulated FDR is below ``target``, and that FDR: columns by.., p, fdr.

    One row per group that has such a p. A p-value at place i of the group's sorted list (from 1)
    has FDR = mean number of simulated p-values up to it / i.
    """
    by = by or []
    tested = _tested(df)
    none = F.lit(0).cast("long")
    actual = tested.groupBy(*by, F.round("pval", 12).alias("p")).agg(F.count(F.lit(1)).alias("a"))
    both = actual.withColumn("s", none).unionByName(
        simulate(tested, key, sims, seed, by).select(*by, "p", none.alias("a"), F.col("drawn").alias("s"))
    )
    counted = both.groupBy(*by, "p").agg(F.sum("a").alias("a"), F.sum("s").alias("s"))
    s = ranged.range_sorted(counted, *by, "p")
    run = ranged.running_total(ranged.running_total(s, F.col("a"), "n_actual"), F.col("s"), "n_sim")
    if by:
        # Running totals go over all groups; take off what stood before each group.
        before = F.struct((F.col("n_actual") - F.col("a")).alias("a"), (F.col("n_sim") - F.col("s")).alias("s"))
        run = (
            ranged.carried(ranged.group_edges(run, by), F.when(F.col("_starts"), before), "_group")
            .withColumn("n_actual", F.col("n_actual") - F.col("_group.a"))
            .withColumn("n_sim", F.col("n_sim") - F.col("_group.s"))
        )
    return (
        run.where(F.col("a") > 0)
        .withColumn("fdr", F.col("n_sim") / F.lit(sims) / F.col("n_actual"))
        .where(F.col("fdr") < target)
        .groupBy(*by)
        .agg(F.max_by("fdr", "p").alias("fdr"), F.max("p").alias("p"))
        .where(F.col("p").isNotNull())
    )


def fdr_filter(df: DataFrame, cutoff: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows with p below the ``fdr_cutoff`` of their group, with that as p_cut and its fdr; groups without a cutoff keep none. One row a
    group is looked up, the table is not shuffled for it."""
    cut = cutoff.withColumnRenamed("p", "p_cut")
    found = lookup(df, cut, by) if by else df.withColumns({c: cut.select(F.max(c)).scalar() for c in ("p_cut", "fdr")})
    return found.where(~F.isnan("pval") & (F.col("pval") < F.col("p_cut")))


# ---- reports ----


def wrong_base(counts: DataFrame, snps: DataFrame) -> DataFrame:
    """Per (tissue, chrom): positions, positions without a SNP, counts by allele, share of others."""
    joined = counts.join(snps.withColumn("_known", F.lit(True)), ["chrom", "pos"], "left")
    base = F.upper("base")
    is_ref, is_alt, is_n = base == F.col("ref"), base == F.col("alt"), base == "N"
    known = F.col("_known").isNotNull()

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(known & cond, F.col("n"))), F.lit(0)).cast("long")

    # Per position first: positions are counted exactly without a distinct over the whole chromosome.
    per_pos = joined.groupBy("tissue", "chrom", "pos").agg(
        F.max(known).alias("known"),
        total(is_ref).alias("ref"),
        total(~is_ref & is_alt).alias("alt"),
        total(~is_ref & ~is_alt & is_n).alias("ns"),
        total(~is_ref & ~is_alt & ~is_n).alias("other"),
    )
    report = per_pos.groupBy("tissue", "chrom").agg(
        F.count(F.lit(1)).alias("snp_count"),
        F.count_if(~F.col("known")).alias("skipped"),
        *[F.sum(c).alias(c) for c in ("ref", "alt", "ns", "other")],
    )
    total_reads = F.col("ref") + F.col("alt") + F.col("ns") + F.col("other")
    return report.withColumn("total", total_reads).withColumn(
        "other_percent", F.coalesce(F.try_divide("other", "total"), nan())
    )


def read_report(reads: DataFrame, snps: DataFrame, name: str = "file", flip: bool = True) -> DataFrame:
    """Per file and shift (0, +1, -1): reads, reads with SNPs, SNPs under reads, ref, alt, N, other.

    ``reads``: file, id, chrom, start, seq, reverse; ``snps``: chrom, pos, ref, alt. ``flip``
    complements the bases of reverse reads.
    """
    from lociframe.operators.intervals import reads_x_snps

    shifts = (0, 1, -1)
    seq = reverse_when(F.col("seq"), F.col("reverse") & F.lit(flip))
    read = reads.select(name, "id", "chrom", "start", seq.alias("seq"))
    each = F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift")
    totals = read.groupBy(name).agg(F.count(F.lit(1)).alias("reads")).select(name, each, "reads")
    # One join serves all shifts: a read also meets the SNPs next to it, and each hit is then looked at per shift.
    hits = reads_x_snps(read, snps.select("chrom", "pos", "ref", "alt"), margin=1).select("*", each)
    at = F.col("pos") - F.col("start") + F.col("shift")
    hits = hits.where((at >= 0) & (at < F.length("seq"))).withColumn("base", F.lower(F.substring("seq", (at + 1).cast("int"), F.lit(1))))
    base = F.col("base")
    is_ref, is_alt, is_n = base == F.lower("ref"), base == F.lower("alt"), base == "n"
    per_read = hits.groupBy(name, "shift", "id").agg(
        F.count(F.lit(1)).alias("snps"),
        F.count_if(is_ref).alias("ref"),
        F.count_if(~is_ref & is_alt).alias("alt"),
        F.count_if(~is_ref & ~is_alt & is_n).alias("ns"),
        F.count_if(~is_ref & ~is_alt & ~is_n).alias("other"),
    )
    counts = ("snps", "ref", "alt", "ns", "other")
    summed = per_read.groupBy(name, "shift").agg(F.count(F.lit(1)).alias("with_snps"), *[F.sum(c).alias(c) for c in counts])
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("with_snps", *counts)]
    return totals.join(summed, [name, "shift"], "left").select(name, "shift", "reads", *filled)


def match_report(compared: DataFrame) -> DataFrame:
    """Counts of ref, alt and no_match per chromosome, in natural chromosome order."""
    from lociframe.functions.chroms import order_by_chrom

    return order_by_chrom(
        compared.groupBy("chrom").agg(
            *[F.count_if(F.col("call") == c).alias(c) for c in ("ref", "alt", "no_match")]
        )
    )
