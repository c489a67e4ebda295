import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lociframe.functions.stats import fair_binomial_p
from lociframe.operators import ase


def _exact(k, n):
    k = min(k, n - k)
    if 2 * k == n:
        return 1.0
    return float(min(Fraction(1), 2 * sum(Fraction(math.comb(n, i)) for i in range(k + 1)) / Fraction(2) ** n))


def _normal(k, n):
    k = min(k, n - k)
    return 1.0 if 2 * k == n else min(1.0, math.erfc((n / 2 - k - 0.5) / (math.sqrt(n) / 2) / math.sqrt(2)))


def test_binomial(spark):
    rows = [(k, n) for n in [0, 1, 2, 3, 10, 51, 99, 100, 101, 150, 400] for k in range(0, n + 1, max(1, n // 9))]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", fair_binomial_p(F.col("k"), F.col("n")))
    for r in df.collect():
        want = _exact(r.k, r.n) if r.n <= 100 else _normal(r.k, r.n)
        assert r.p == pytest.approx(want, rel=1e-6, abs=1e-12), (r.k, r.n)


def _snp(spark, rows):
    df = spark.createDataFrame(rows, "want string, mat_counts long, pat_counts long, n_counts long, other_counts long")
    return ase.snp_winner(ase.snp_pval(df))


def test_snp_winner_branches(spark):
    rows = [
        ("NA", 1, 1, 0, 0),
        ("NA", 0, 0, 0, 0),
        ("Ns > 0.25", 4, 4, 4, 0),
        ("WEIRD", 8, 0, 0, 2),
        ("mat", 30, 2, 0, 0),
        ("pat", 2, 30, 0, 0),
        ("NS", 10, 12, 0, 0),
        ("NS", 3, 0, 0, 0),
    ]
    for r in _snp(spark, rows).collect():
        assert r.win == r.want, r


def test_snp_pval_gate(spark):
    # Few others: tested. Many others and few Ns: not. Many others but many Ns: tested. One read: not.
    rows = [("t", 9, 1, 0, 0), ("f", 5, 1, 0, 4), ("t", 3, 1, 8, 2), ("f", 1, 0, 0, 0)]
    for r in _snp(spark, rows).collect():
        assert math.isnan(r.pval) == (r.want == "f")


def test_gene_winner(spark):
    nan = float("nan")
    rows = [("w", 0.01, "WEIRD"), ("w", 0.01, "WEIRD"), ("w", 0.01, "mat"), ("m", 0.01, "mat"), ("m", 0.02, "mat"), ("p", 0.01, "pat"),
            ("q", 0.01, "mat"), ("q", 0.01, "pat"), ("n", 0.5, "NS"), ("x", nan, "NA"), ("x", 0.001, "mat"), ("z", 0.0, "mat")]
    df = spark.createDataFrame(rows, "gene string, pval double, win string").withColumns(
        {c: F.lit(1).cast("long") for c in ("mat_counts", "pat_counts", "n_counts", "other_counts")}
    )
    got = {r.gene: r for r in ase.gene_summary(df, ["gene"]).collect()}
    assert {g: r.winner for g, r in got.items()} == {"w": "WEIRD", "m": "mat", "p": "pat", "q": "?", "n": "NS", "x": "NS", "z": "mat"}
    assert math.isnan(got["x"].pval) and got["m"].pval == pytest.approx(0.015)
    assert got["x"].failed == 1


def test_call_counts(spark):
    rows = [
        ("Asym", "M", 30, 2, 0, 0, "A", "C", "A", "C"),
        ("Asym", "P", 2, 30, 0, 0, "A", "C", "A", "C"),
        ("Sym", "P", 10, 11, 0, 0, "A", "C", "A", "C"),
        ("Weird", "?", 10, 11, 9, 0, "A", "C", "A", "C"),
        ("Homozygous", "M", 20, 0, 0, 1, "A", "A", "A", "A"),
        ("Sym", "?", 10, 11, 0, 0, "A", "C", None, "C"),
    ]
    df = spark.createDataFrame(rows, "cls0 string, parent0 string, a long, c long, g long, t long, a1 string, a2 string, mat_allele string, pat_allele string")
    for r in ase.call_counts(df).collect():
        assert (r.cls, r.parent) == (r.cls0, r.parent0), r


def test_coin_tables(spark):
    depths = [0, 1, 2, 3, 7, 60, 100, 101, 999, 1001, 5000, 100_000]
    rows = {r.flips: r for r in ase.coin_table(spark.createDataFrame([(n,) for n in depths], "flips long")).collect()}
    for n, r in rows.items():
        assert r.upto[-1] == 2.0 and len(r.upto) == len(r.p) == len(r.guide) - 1 == n // 2 - r.first + 1
        if n <= 1001:
            total = 0
            for k in range(n // 2):
                total += 2 * math.comb(n, k)
                if k >= r.first:
                    assert r.upto[k - r.first] == pytest.approx(total / 2**n, rel=1e-10, abs=1e-17)
        assert list(r.guide) == [sum(c <= j / len(r.upto) for c in r.upto) for j in range(len(r.upto) + 1)]
    assert len(rows[100_000].upto) < 2000
    # 5000 flips: the share of the middle, by the logarithm of the factorials.
    middle = math.exp(math.lgamma(5001) - 2 * math.lgamma(2501) - 5000 * math.log(2))
    assert 1 - rows[5000].upto[-2] == pytest.approx(middle, rel=1e-8)


def test_draws_are_fair_and_repeatable(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit(3).cast("long").alias("mat_counts"), F.lit(4).cast("long").alias("pat_counts"))
    one = {r.p: r.drawn for r in ase.simulate(df, "k", sims=7).collect()}
    two = {r.p: r.drawn for r in ase.simulate(df.repartition(7), "k", sims=7).collect()}
    assert one == two and sum(one.values()) == 21_000
    seen = 0
    for k in range(4):
        seen += math.comb(7, k)
        share = math.comb(7, k) * 2 / 2**7
        assert abs(one[round(2 * seen / 2**7, 12)] / 21_000 - share) < 4 * math.sqrt(share / 21_000)
    # The same numbers however the table of depths is joined.
    monkeypatch.setattr("lociframe.plans.lookups.fits", lambda *a: False)
    assert {r.p: r.drawn for r in ase.simulate(df, "k", sims=7).collect()} == one


def test_fdr_cutoff_against_brute_force(spark):
    rows = [(f"r{i}", i % 40, (i * 7) % 23, "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, mat_counts long, pat_counts long, ind string")
    df = df.withColumn("pval", fair_binomial_p(F.least("mat_counts", "pat_counts"), F.col("mat_counts") + F.col("pat_counts")))
    got = {r.ind: (r.p, r.fdr) for r in ase.fdr_cutoff(df, "key", 0.2, by=["ind"]).collect()}
    for ind in "ab":
        part = df.where(F.col("ind") == ind)
        actual = sorted(round(r.pval, 12) for r in part.collect())
        sim = [p for r in ase.simulate(part, "key").collect() for p in [r.p] * r.drawn]
        fits = [(p, sum(s <= p for s in sim) / 5 / sum(a <= p for a in actual)) for p in set(actual)]
        best = max((p, f) for p, f in fits if f < 0.2)
        assert got[ind] == pytest.approx(best)
    kept = ase.fdr_filter(df, ase.fdr_cutoff(df, "key", 0.2, by=["ind"]), by=["ind"])
    assert 0 < kept.count() < 300


def test_wrong_base_counts_skipped(spark):
    counts = spark.createDataFrame([("t", "c", 1, "a", 3), ("t", "c", 1, "g", 2), ("t", "c", 1, "n", 1), ("t", "c", 2, "a", 9)], "tissue string, chrom string, pos long, base string, n long")
    snps = spark.createDataFrame([("c", 1, "A", "C")], "chrom string, pos long, ref string, alt string")
    r = ase.wrong_base(counts, snps).first()
    assert (r.snp_count, r.skipped, r["ref"], r.alt, r.ns, r.other, r.total) == (2, 1, 3, 0, 1, 2, 6)


def test_a_position_without_reads_is_weird(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, "A", "C", "A", "C")], "a int, c int, g int, t int, a1 string, a2 string, mat_allele string, pat_allele string")
    r = ase.call_counts(df).first()
    assert (r.cls, r.parent, r.pval) == ("Weird", "?", 1.0)


def test_draws_are_plain_columns(spark):
    """A row a draw, no lambda over an array of draws, and the draws depend on key, place and seed alone."""
    df = spark.createDataFrame([(f"k{i}", i % 9, i % 4) for i in range(60)], "key string, mat_counts long, pat_counts long")
    found = ase.simulate(df, "key", sims=5, seed=3)
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()
    again = ase.simulate(df.repartition(7), "key", sims=5, seed=3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    assert sum(r.drawn for r in found.collect()) == 300
