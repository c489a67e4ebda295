import itertools
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociframe.config import pin
from lociframe.operators import curves, ordered
from lociframe.plans import ranged


def _sequential(peaks, overlap):
    """Clusters of one sorted chromosome after another, one peak at a time."""
    out = []
    for chrom in sorted({p[0] for p in peaks}):
        run = sorted(p for p in peaks if p[0] == chrom)
        for i, (c, s, e, k, pop, fold, l10p) in enumerate(run):
            before, after = run[i - 1] if i else None, run[i + 1] if i + 1 < len(run) else None
            with_prev = before is not None and s < before[2] - 4
            if after is None:
                joins = before is not None and s - 4 < before[2]
            elif with_prev and after[1] < e - 4:
                lo, hi = out[-1][1:3]
                joins = hi != lo and abs((before[2] - s) / (lo - hi)) > overlap
            else:
                joins = with_prev
            if joins:
                o = out[-1]
                out[-1] = (c, o[1], max(o[2], e), o[3] + 1, (o[4] + fold) / 2, (o[5] + l10p) / 2)
            else:
                out.append((c, s, e, 1, fold, l10p))
    return out


@pytest.mark.parametrize("seed,step,overlap", [(1, 12, 0.75), (2, 60, 0.75), (3, 2, 0.3), (4, 5, 0.9)])
def test_peak_merge_is_sequential_merge(spark, seed, step, overlap):
    r = random.Random(seed)
    peaks, at = [], 0
    for k in range(900):
        at += r.randrange(0, step)
        peaks.append(("ab"[k % 3 == 0], at, at + r.randrange(5, 60), k, f"p{r.randrange(4)}_{k}", r.random(), r.random()))
    df = spark.createDataFrame(peaks, "chrom string, start long, end long, key long, pop string, fold double, l10p double")
    got = sorted((x.chrom, x.start, x.end, x["count"], x.fold, x.l10p) for x in ordered.peak_merge(df, overlap).collect())
    want = sorted(_sequential(peaks, overlap))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4:] == pytest.approx(w[4:]) for g, w in zip(got, want))
    stats = ordered.cluster_stats(ordered.peak_merge(df, overlap, by_row=True)).where("measure = 'size'").collect()
    assert sum(x["value"] * x.clusters for x in stats) == len(peaks)


def test_grouped_yields_every_run(spark):
    keys = "aabbbacc" * 40
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k string")
    got = {r.i: r.group for r in ordered.grouped(df, "k", "i").collect()}
    want, g = {}, 0
    for i, k in enumerate(keys):
        g += i == 0 or k != keys[i - 1]
        want[i] = g
    assert got == want

    def size(pdf):
        import pandas as pd

        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "n": [len(pdf)]})

    sizes = ordered.apply_per_group(ordered.grouped(df, "k", "i"), "group", size, "group long, n long")
    assert {r.group: r.n for r in sizes.collect()} == {v: list(want.values()).count(v) for v in set(want.values())}


def test_apply_per_group_keeps_groups_whole_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") * F.col("id") % 11).alias("g"), "id")

        def size(pdf):
            import pandas as pd

            return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [len(pdf)]})

        got = sorted(map(tuple, ordered.apply_per_group(df, "g", size, "g long, n long").collect()))
        assert got == sorted(map(tuple, df.groupBy("g").count().collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_apply_per_group_over_arrays(spark):
    """Small groups in arrays give what frames give, without a frame for each; groups over batches stay whole, null is one group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        key = F.when(F.col("id") % 13 != 0, F.col("id") * F.col("id") % 11)
        df = spark.range(500).select(key.alias("g"), F.when(F.col("id") % 5 != 0, F.col("id") / 3).alias("v"), F.format_string("t%d", "id").alias("t"))

        def over(run):
            assert isinstance(run, dict)
            v = run["v"][run["v"] == run["v"]]
            g = run["g"][0]
            return None if g != g else int(g), len(run["t"]), float(v.max() - v.min())

        got = {r.g: (r.n, r.span) for r in ordered.apply_per_group(df, "g", over, "g long, n long, span double", arrays=True).collect()}
        want = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.max("v") - F.min("v")).alias("span")).collect()
        assert got == {r.g: (r.n, r.span) for r in want} and None in got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wrong_column_count_fails(spark):
    lines = spark.createDataFrame([("a\tb",), ("a\tb\tc",)], "value string")
    with pytest.raises(Exception, match="wrong number of columns"):
        ordered.check_columns(lines, 2).collect()


def test_pick_causal(spark):
    rows = [("s1", "one", 0.95), ("s2", "two", 0.95), ("s3", "two", 0.1), ("s4", "none", 0.2), ("s5", "none", 0.3)]
    df = spark.createDataFrame(rows, "snp string, peak string, posterior double")
    every = {r.snp: (r.causal, r.prior) for r in ordered.pick_causal(df).collect()}
    assert every["s1"] == ("Y", 0.1723) and every["s3"][0] == "N" and len(every) == 5
    assert {r.snp for r in ordered.pick_causal(df, exclude=True).collect()} == {"s2", "s3"}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_quantiles_are_numpys(spark, n):
    import numpy as np

    r = random.Random(n)
    data = {g: [round(r.random(), 1) for _ in range(n)] for g in "ab"}
    data["a"] += [0.5] * (n // 2)  # a value that holds a third of the rows
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {(x.g, x.i): x.value for x in ranged.quantile_grid(df, "v", 20, ["g"]).collect()}
    assert len(got) == 42
    for g, vs in data.items():
        for i in range(21):
            assert got[g, i] == pytest.approx(np.percentile(vs, i * 5))
    flat = {x.i: x.value for x in ranged.quantile_grid(df, "v", 7).collect()}
    both = data["a"] + data["b"]
    assert flat == pytest.approx({i: np.quantile(both, i / 7) for i in range(8)})


def test_uniform_bins(spark):
    r = random.Random(9)
    for n, bins in ((50, 7), (200, 100), (10, 20)):
        values = sorted(r.randrange(30) for _ in range(n))
        df = spark.createDataFrame([(v,) for v in values], "v long")
        got = sorted(x.edge for x in curves.uniform_bins(df, "v", bins).collect())
        assert got == sorted({values[0], values[-1], *[values[i * n // bins] for i in range(1, bins)]})


def test_row_index_and_neighbours(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "v long").repartition(5)
    s = ranged.range_sorted(df, "v")
    rows = ranged.neighbours(ranged.row_index(s), ["v"]).collect()
    for r in rows:
        assert r.row == r.v
        assert (r.prev.v if r.prev else -1) == r.v - 1
        assert (r.next.v if r.next else 200) == r.v + 1


def test_labels_never_twice(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(f"l{i}", r.random() ** 3 + 1e-6, r.random() ** 3 + 1e-6) for i in range(200)], "label string, x double, y double")
    rows = curves.pick_labels(df, 20).collect()
    assert len(rows) == len({r.label for r in rows}) == 1 + 11 + 4 + 4


def test_labels_by_the_last_bit(spark):
    """Points of one line have equal scores but for rounding; the order is that of the C library's functions."""
    rows = [(f"l{i:04d}", math.pow(i / 1000, 4.0), math.pow(k / 997, 4.0)) for i in range(1, 1001) for k in (1, 2, 3)]
    best = lambda label, x, y: (-(1 / (x * y) * math.pow(10.0, abs(math.log10(x) - math.log10(y)))), label, x, y)
    small = sorted(rows, key=lambda r: (r[1] * r[2], *r))[:2]
    want = sorted((r for r in rows if r not in small), key=lambda r: best(*r))[:22]
    got = curves.pick_labels(spark.createDataFrame(rows, "label string, x double, y double"), 40).where("rank = 2").collect()
    assert sorted((r.label, r.x, r.y) for r in got) == sorted(want)


def test_theoretical_samples(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") / 3000).alias("x"))
    for kind, lo, hi in (("pvalue", 0, 1), ("uniform", 0, 1)):
        s = curves.theoretical(df, kind).agg(F.min("x"), F.max("x"), F.avg("x")).first()
        assert lo <= s[0] < 0.01 and 0.99 < s[1] <= hi and abs(s[2] - 0.5) < 0.03
    s = curves.theoretical(df, "normal").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(s[0] - 0.5) < 0.03 and abs(s[1] - 0.2887) < 0.03


def test_notch_covers_the_median(spark):
    df = spark.range(999).select(F.lit("a").alias("label"), F.col("id").cast("double").alias("v"))
    r = curves.box_notch(df, "label", "v").first()
    assert 460 < r.lo < 490 and 508 < r.hi < 540


def test_resampled_medians_are_exact(spark):
    sizes = range(1, 6)
    df = spark.createDataFrame([(n, float(k * k)) for n in sizes for k in range(n)] + [(2, None)], "n int, v double")
    boots = 20_000
    drawn = {(r.n, r["median"]): r["count"] for r in curves.resampled_medians(df, "n", "v", boots).groupBy("n", "median").count().collect()}
    for n in sizes:
        want = Counter(statistics.median(k * k for k in draw) for draw in itertools.product(range(n), repeat=n))
        for m, c in want.items():
            share = c / n**n
            assert abs(drawn.get((n, m), 0) / boots - share) < 4 * math.sqrt(share * (1 - share) / boots) + 1e-9
        assert sum(v for (k, _), v in drawn.items() if k == n) == boots


def test_edges_and_carried_values(spark):
    r = random.Random(4)
    rows = sorted((r.choice(["a", "a", "a", "b", "c", "d"]), i) for i in range(400))
    s = ranged.range_sorted(spark.createDataFrame([(None if g == "a" else g, i) for g, i in rows], "g string, i long"), "g", "i")
    s = ranged.group_edges(s, ["g"])
    first = ranged.carried(s, F.when(F.col("_starts"), F.col("i")), "first")
    both = ranged.carried(first, F.when(F.col("_ends"), F.col("i")), "last", back=True)
    ends = {}
    for g, i in rows:
        ends.setdefault(None if g == "a" else g, []).append(i)
    got = both.collect()
    assert len(got) == 400 and all((x.first, x.last) == (min(ends[x.g]), max(ends[x.g])) for x in got)
    assert "hashpartitioning(g" not in both._jdf.queryExecution().executedPlan().toString()
    nothing = ranged.carried(s, F.lit(None).cast("long"), "x").agg(F.count("x")).first()
    assert nothing[0] == 0


@pytest.mark.parametrize("parts,overlap", [(8, 0.75), (24, 0.3), (64, 0.75)])
def test_dense_peaks_over_many_parts(spark, monkeypatch, parts, overlap):
    r = random.Random(parts)
    peaks = [("a", 7 * k, 7 * k + 20 + 5 * (k % 3) + r.choice([0, 0, 0, 200]), k, f"p_{k}", 1.0 + k % 7, 2.0 + k % 5) for k in range(900)]
    df = spark.createDataFrame(peaks, "chrom string, start long, end long, key long, pop string, fold double, l10p double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    pins = []
    monkeypatch.setattr(ordered, "pin", lambda d: pins.append(1) or pin(d))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = sorted((x.chrom, x.start, x.end, x["count"]) for x in ordered.peak_merge(df, overlap).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(w[:4] for w in _sequential(peaks, overlap))
    # The parts and the marked rows are written once, however many parts there are.
    assert len(pins) == 2


def test_stretches_do_what_the_loop_does():
    def loop(peaks, lo, hi, limit):
        for kind, start, end, share in peaks:
            if ordered._opens(kind, share, lo, hi, limit):
                lo, hi = start, end
            elif end > hi:
                hi = end
        return lo, hi

    r = random.Random(1)
    for _ in range(400):
        limit, step, at, prev, peaks = r.choice([0.75, 0.3, 0.0, 2.0]), r.choice([1, 2, 5, 20]), 100, 100, []
        for _ in range(r.randrange(2, 60)):
            at += r.randrange(step)
            end = at + r.choice([0, 1, 5, r.randrange(1, 60), r.randrange(1, 400)])
            peaks.append((r.choice([1, 2, 2, 2, 2]) if r.random() > 0.02 else 0, at, end, abs(prev - at)))
            prev = end
        cuts = sorted(r.sample(range(1, len(peaks)), min(len(peaks) - 1, r.randrange(1, 8))))
        parts, place = [], 0
        for a, b in zip([0, *cuts], [*cuts, len(peaks)]):
            walk = ordered._Walk(limit)
            for p in peaks[a:b]:
                walk.peak(place, *p)
                place += 1
            parts.append(ordered.Stretch.from_json(walk.done().to_json()))
        for _ in range(20):
            lo = 100 - r.randrange(300)
            hi = lo + r.choice([0, 0, 1, r.randrange(600)])
            state = lo, hi
            for part in parts:
                state = part.after(*state)
            assert state == loop(peaks, lo, hi, limit)
