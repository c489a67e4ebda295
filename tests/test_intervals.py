import random

import pytest
from pyspark.sql import functions as F

from lociframe.functions.bases import revcomp
from lociframe.operators import intervals


def _naive(points, ivs, strand=False):
    out = []
    for p in points:
        hits = [i for i in ivs if i[0] == p[0] and i[1] <= p[1] < i[2] and (not strand or i[4] == p[2])]
        if hits:
            out.append((*p, min(hits, key=lambda i: i[5])[3]))
    return sorted(out)


def _data(seed, n_points=400, hot=None):
    r = random.Random(seed)
    points = [(r.choice("ab"), r.randrange(0, 3000), r.choice("+-")) for _ in range(n_points)]
    if hot:
        points += [hot] * n_points
    ivs = []
    for o in range(120):
        s = r.randrange(0, 2900)
        ivs.append((r.choice("ab"), s, s + r.randrange(0, 300), f"g{o % 40}", r.choice("+-"), o))
    return points, ivs


def _frames(spark, points, ivs):
    return (
        spark.createDataFrame(points, "chrom string, pos long, strand string"),
        spark.createDataFrame(ivs, "chrom string, start long, end long, gene string, strand string, ord long"),
    )


WAYS = pytest.mark.parametrize("broadcast_rows", [0, 10**6])


@WAYS
def test_first_interval_wins_and_copies_stay(spark, broadcast_rows):
    points, ivs = _data(1, hot=("a", 1500, "+"))
    p, i = _frames(spark, points, ivs)
    got = intervals.assign_interval(p, i, width=64, broadcast_rows=broadcast_rows)
    assert sorted(map(tuple, got.collect())) == _naive(points, ivs)


@WAYS
def test_strand(spark, broadcast_rows):
    points, ivs = _data(2)
    p, i = _frames(spark, points, ivs)
    got = intervals.assign_interval(p, i, strand="strand", width=100, broadcast_rows=broadcast_rows)
    assert sorted(map(tuple, got.collect())) == _naive(points, ivs, strand=True)


@WAYS
def test_carried_columns_stay_as_they_are(spark, broadcast_rows):
    rows = [("a", 10, {"k": 1}, -0.0, None), ("a", 10, {"k": 1}, -0.0, None), ("a", 10, None, 0.0, "x"), ("a", 90, {}, float("nan"), "y"), ("b", 10, {}, 1.0, "z"), ("a", None, {}, 1.0, "n")]
    rows += [("a", 11, {"h": 1}, -0.0, "hot")] * 40
    p = spark.createDataFrame(rows, "chrom string, pos long, m map<string,int>, d double, t string").withColumn("v", F.parse_json(F.lit('{"q": [1]}')))
    i = spark.createDataFrame([("a", 0, 50, "g1", 0), ("a", 5, 95, "g2", 1)], "chrom string, start long, end long, gene string, ord long")
    got = intervals.assign_interval(p, i, broadcast_rows=broadcast_rows)
    assert got.columns == [*p.columns, "gene"]
    want = [(*r, '{"q":[1]}', "g2" if r[1] == 90 else "g1") for r in rows if r[0] == "a" and r[1] is not None]
    assert sorted(map(repr, map(tuple, got.withColumn("v", F.to_json("v")).collect()))) == sorted(map(repr, want))
    joined = intervals.bin_join(p, i.withColumnRenamed("chrom", "c").withColumn("chrom", F.col("c")), "pos", "start", "end", shares=16, broadcast_rows=broadcast_rows)
    assert sorted(repr(r.d) for r in joined.collect()) == sorted(repr(r[3]) for r in rows if r[0] == "a" and r[1] for _ in range(1 if r[1] == 90 else 2))


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BROADCAST_BYTES", 10_000)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 2000).alias("s"))
    assert not intervals._fits(wide, 100) and intervals._fits(wide.select(F.length("s")), 100) and not intervals._fits(wide, 5)


def test_full_bins_are_split_on_both_sides(spark):
    points, ivs = _data(3)
    points = [(c, 1000 + p % 40, f"{n}") for n, (c, p, _) in enumerate(points)]
    p = spark.createDataFrame(points, "chrom string, pos long, id string")
    i = spark.createDataFrame([x[:4] for x in ivs], "chrom string, s long, e long, gene string")
    want = sorted((c, q, k, g) for c, q, k in points for d, s, e, g, *_ in ivs if c == d and s <= q < e)
    assert want
    for side in ("points", "intervals"):
        for way in ({"broadcast_rows": 0}, {"broadcast_rows": 0, "shares": 0}, {}):
            joined = intervals.bin_join(p, i, "pos", "s", "e", width=50, spread=side, **{"shares": 16, **way})
            assert sorted(map(tuple, joined.select("chrom", "pos", "id", "gene").collect())) == want
    split = intervals.bin_join(p, i, "pos", "s", "e", width=50, shares=16, broadcast_rows=0)
    assert split.select("_salt").distinct().count() > 1


def _genome(spark, seqs, size):
    rows = [(c, t, s[t * size : (t + 1) * size]) for c, s in seqs.items() for t in range((len(s) + size - 1) // size)]
    return spark.createDataFrame(rows, "chrom string, tile long, seq string")


def test_windows_across_tiles_and_edges(spark):
    r = random.Random(4)
    seqs = {c: "".join(r.choice("ACGTacgt") for _ in range(n)) for c, n in (("x", 53), ("y", 20))}
    tiles = _genome(spark, seqs, 8)
    spots = [(c, p) for c, s in seqs.items() for p in range(len(s))]
    df = spark.createDataFrame(spots + [("x", 53), ("z", 1)], "chrom string, pos long")
    got = {(x.chrom, x.pos): (x.region, x.is_edge) for x in intervals.get_regions(df, tiles, 8, 7).collect()}
    want = {(c, p): (seqs[c][max(0, p - 7) : p + 8].upper(), p < 7 or p + 8 > len(seqs[c])) for c, p in spots}
    assert got == want
    one_based = intervals.get_regions(df.withColumn("pos", F.col("pos") + 1), tiles, 8, 7, base=1)
    assert {(x.chrom, x.pos - 1): x.region for x in one_based.collect()} == {k: v[0] for k, v in want.items()}


def test_dinucleotides(spark):
    tiles = _genome(spark, {"x": "ACGTTGCA"}, 3)
    df = spark.createDataFrame([("x", 0), ("x", 3), ("x", 7)], "chrom string, pos long")
    rows = intervals.get_dinucleotides(df, tiles, 3)
    got = {r.pos: (r.ref_base, r.plus1, r.plus2, r.minus1, r.minus2, r.is_edge) for r in rows.collect()}
    assert got == {
        0: ("A", "A", "AC", "T", "GT", True),
        3: ("T", "GT", "TT", "AC", "AA", False),
        7: ("A", "CA", "A", "TG", "T", True),
    }
    assert intervals.dinucleotide_shape(rows, "rows").count() == 12
    assert intervals.dinucleotide_shape(rows, "map").where("pos = 3").first().dinucleotides["+"] == ["GT", "TT"]


def test_revcomp_twice_is_identity(spark):
    df = spark.createDataFrame([("ACGTNacgtn",), ("GATTACA",)], "s string")
    assert all(r.s == r.t for r in df.select("s", revcomp(revcomp("s")).alias("t")).collect())


def test_genome_calls(spark):
    tiles = _genome(spark, {"x": "ACgT"}, 3)
    snps = spark.createDataFrame([("x", 0, "A", "C"), ("x", 2, "A", "G"), ("x", 3, "A", "C"), ("x", 9, "A", "C")], "chrom string, pos long, ref string, alt string")
    got = {r.pos: r.call for r in intervals.compare_to_genome(snps, tiles, 3).collect()}
    assert got == {0: "ref", 2: "alt", 3: "no_match"}


def test_lookup_of_computed_positions(spark):
    """Positions that are expressions of the scan: no lambda may end up in the join condition."""
    points = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("chrom"),
        F.when(F.col("id") % 3 == 0, F.lit(50)).otherwise(F.col("id")).alias("pos"),
        F.col("id").alias("name"),
    )
    ivs = spark.createDataFrame([("a", 0, 51, "g1", 1), ("a", 40, 60, "g2", 0), ("b", 100, 200, "g3", 2)], "chrom string, start long, end long, gene string, ord long")
    for rows in (0, 10**6):
        got = {r.gene: r.n for r in intervals.assign_interval(points, ivs, broadcast_rows=rows).groupBy("gene").agg(F.count("*").alias("n")).collect()}
        assert got == {"g2": len(range(0, 5000, 3)), "g3": sum(i % 3 != 0 for i in range(100, 200))}


@WAYS
def test_long_intervals_are_one_row(spark, broadcast_rows):
    r = random.Random(9)
    ivs = [("a", 0, 250_000_000, "whole", "+", 50), ("a", 131_071, 131_073, "edge", "+", 3), ("a", -5, 90, "before", "+", 1), ("a", 1 << 40, (1 << 40) + 7, "far", "+", 2), ("a", 7, 7, "empty", "+", 0)]
    ivs += [("a", s, s + r.choice([1, 50, 20_000, 3_000_000]), f"g{k}", "+", k + 60) for k, s in enumerate(r.randrange(0, 200_000_000) for _ in range(300))]
    points = [("a", p, "+") for p in (0, 5, 89, 90, 131_071, 131_072, 131_073, 249_999_999, 250_000_000, 1 << 40, (1 << 40) + 7)] + [("a", r.randrange(0, 260_000_000), "+") for _ in range(500)]
    p, i = _frames(spark, points, ivs)
    assert intervals._listed(i, "start", "end", intervals.BIN).count() == len(ivs) - 1
    got = intervals.assign_interval(p, i, broadcast_rows=broadcast_rows)
    assert sorted(map(tuple, got.collect())) == _naive(points, ivs)
    joined = intervals.bin_join(p, i.drop("strand").withColumnRenamed("gene", "g"), "pos", "start", "end", shares=4, broadcast_rows=broadcast_rows)
    assert sorted((x.pos, x.g) for x in joined.collect()) == sorted((q, g) for _, q, _ in points for _, s, e, g, _, _ in ivs if s <= q < e)


def test_equal_rows_of_a_full_bin_are_spread(spark):
    reads = spark.createDataFrame([("a", 100, "ACGT" * 5)] * 3000 + [("a", 90_000, "TTTT")], "chrom string, start long, seq string")
    snps = spark.createDataFrame([("a", 103, "x"), ("a", 90_001, "y")], "chrom string, pos long, name string")
    got = intervals.reads_x_snps(reads, snps, broadcast_rows=0)
    assert {(r.name, r.base): r.n for r in got.groupBy("name", "base").agg(F.count("*").alias("n")).collect()} == {("x", "T"): 3000, ("y", "T"): 1}
    spans = reads.select("chrom", "start", (F.col("start") + 20).alias("stop"))
    big = spans.withColumns({"_level": F.lit(0), "_bin": F.lit(0).cast("long")})
    spread = intervals._spread_out(big, spark.createDataFrame([("a", 0, 0, 8)], "chrom string, _level int, _bin long, _salts int"))
    parts = {r["_salt"]: r.n for r in spread.groupBy("_salt").agg(F.sum("_times").alias("n")).collect()}
    assert sum(parts.values()) == 3001 and len(parts) > 3 and spread.count() < 20


@pytest.mark.parametrize("flank", [0, 3, 8, 19])
def test_flanks_of_tiles(spark, flank):
    r = random.Random(flank)
    seqs = {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("x", 53), ("y", 20), ("z", 8), ("w", 3))}
    for x in intervals.flanked(_genome(spark, seqs, 8), 8, flank).collect():
        at, end = x.tile * 8, min(len(seqs[x.chrom]), x.tile * 8 + 8)
        assert (x.before, x.seq, x.after) == (seqs[x.chrom][max(0, at - flank) : at], seqs[x.chrom][at:end], seqs[x.chrom][end : end + flank])


def test_positions_of_a_hot_tile(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_fits", lambda *a: False)
    r = random.Random(4)
    seqs = {"x": "".join(r.choice("ACGT") for _ in range(64))}
    points = [("x", p, k) for k in range(40) for p in (17, 18, 63, 64)] + [("x", 40, 0), ("y", 3, 0), ("x", -1, 0)]
    df = spark.createDataFrame(points, "chrom string, pos long, k int")
    got = intervals.windows(df, _genome(spark, seqs, 8), 8, 5, 9)
    assert sorted((x.pos, x.k, x.window, x.is_edge) for x in got.collect()) == sorted(
        (p, k, seqs["x"][max(0, p - 5) : p + 10], len(seqs["x"][max(0, p - 5) : p + 10]) < 15) for c, p, k in points if c == "x" and 0 <= p < 64
    )


def test_tiles_that_do_not_fit_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_fits", lambda *a: False)
    snps = spark.createDataFrame([("x", p, "A", "C") for p in range(200)], "chrom string, pos long, ref string, alt string")
    # A range, as it has an estimate of a few bytes.
    tiles = spark.range(25).select(F.lit("x").alias("chrom"), F.col("id").alias("tile"), F.lit("ACGTACGT").alias("seq"))
    for found in (intervals.compare_to_genome(snps, tiles, 8), intervals.windows(snps, tiles, 8, 2, 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert found.count() == 200
