"""Operators that depend on the order of rows: peaks, consecutive groups, causal picks."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.config import parallelism, pin
from lociframe.plans import ranged

# Bases a peak must reach into the next before they overlap, and the default share.
SLACK = 4
OVERLAP = 0.75

_ORDER = ("chrom", "start", "end", "key")


def _flagged(peaks: DataFrame) -> DataFrame:
    s = ranged.neighbours(ranged.range_sorted(peaks, *_ORDER), ["chrom", "start", "end"], "_prev", "_next")
    same_prev = F.coalesce(F.col("_prev.chrom") == F.col("chrom"), F.lit(False))
    same_next = F.coalesce(F.col("_next.chrom") == F.col("chrom"), F.lit(False))
    return (
        s.withColumn("prev_end", F.when(same_prev, F.col("_prev.end")))
        .withColumn("is_last", ~same_next)
        .withColumn("overlaps_prev", F.coalesce(F.col("start") < F.col("prev_end") - SLACK, F.lit(False)))
        .withColumn("overlaps_next", F.when(same_next, F.col("_next.start") < F.col("end") - SLACK).otherwise(False))
        .drop("_prev", "_next")
    )


def peak_flags(peaks: DataFrame) -> DataFrame:
    """Peaks in coordinate order with overlaps_prev and overlaps_next, and the number of their island.

    ``peaks``: chrom, start, end, key (unique), anything else. An island is a run of peaks each of
    which overlaps the one before. Keeps the sort columns of ``plans.ranged``.
    """
    return ranged.running_total(_flagged(peaks), (~F.col("overlaps_prev")).cast("long"), "island")


def _steps(batch, limit: float):
    """(kind, start, end, share) of the peaks of an Arrow batch; kind 0 opens a cluster, 1 joins, 2 joins if ``share``, what it reaches
    into the one before, is more than ``limit`` of the open cluster's length."""
    columns = (batch.column(c).to_pylist() for c in ("_kind", "start", "end", "prev_end"))
    for kind, start, end, prev_end in zip(*columns, strict=True):
        yield kind, start, end, abs(prev_end - start)


def _opens(kind: int, share: int, lo: int, hi: int, limit: float) -> bool:
    return kind == 0 or (kind == 2 and not (hi != lo and share / (hi - lo) > limit))


def _longest(share: int, limit: float) -> int | None:
    """The least length of an open cluster that a peak of kind 2 does not join; None if it joins all."""
    if limit < 0 or (limit == 0 and share):
        return None
    length = max(1, int(share / limit)) if share else 1
    while share / length > limit:
        length += 1
    while length > 1 and share / (length - 1) <= limit:
        length -= 1
    return length


class Stretch:
    """What a stretch of sorted peaks does to the cluster (lo, hi) that is open before it, for every such cluster.

    The cluster goes through until a peak opens another; from there on all is known. Which peak that is depends on lo and hi through three
    conditions, each of which only its first hits matter to: ``by_lo`` (greatest lo, place, end state), as the cluster has grown over the stretch; ``by_length``
    (least length, place, end state), as it came; ``by_zero`` for a cluster without length. ``fixed`` (place, end state) opens in any case. Without any of them the
    cluster goes through and ends at ``top`` at least. The lists have no more entries than the longest peak has bases, as lengths fall in one and rise to it in the other.
    """

    def __init__(self, first: int, top: int | None = None, by_lo=(), by_length=(), by_zero=None, fixed=None):
        self.first, self.top, self.by_lo, self.by_length, self.by_zero, self.fixed = first, top, list(by_lo), list(by_length), by_zero, fixed

    def after(self, lo: int, hi: int) -> tuple[int, int]:
        """The open cluster at the end, given the one before."""
        hits = [self.fixed] if self.fixed else []
        if self.by_zero and lo == hi and (self.by_zero[0] is None or self.by_zero[0] <= lo):
            hits.append(self.by_zero[1:])
        k = bisect_left(self.by_lo, lo, key=lambda r: r[0])
        hits += [self.by_lo[k][1:]] if k < len(self.by_lo) else []
        k = bisect_left(self.by_length, lo - hi, key=lambda r: -r[0])
        hits += [self.by_length[k][1:]] if k < len(self.by_length) else []
        if hits:
            return tuple(min(hits)[1:])
        return lo, hi if self.top is None else max(hi, self.top)

    def hit(self, lo=None, length=None) -> None:
        """Keep a condition if an earlier one does not hold wherever it does."""
        if lo and (not self.by_lo or lo[0] > self.by_lo[-1][0]) and not (self.fixed and self.fixed[0] < lo[1]):
            if lo[0] >= self.first:  # no open cluster starts behind the first peak
                if not self.fixed or lo[1] < self.fixed[0]:
                    self.fixed = lo[1:]
            else:
                self.by_lo.append(lo)
        if length and (not self.by_length or length[0] < self.by_length[-1][0]) and not (self.fixed and self.fixed[0] < length[1]):
            self.by_length.append(length)

    def to_json(self) -> str:
        return json.dumps([self.first, self.top, self.by_lo, self.by_length, self.by_zero, self.fixed])

    @classmethod
    def from_json(cls, text: str) -> Stretch:
        return cls(*json.loads(text))


class _Walk:
    """Builds the ``Stretch`` of a part peak by peak. All clusters that conditions may have opened are followed together; those that a
    peak closes are one from there on."""

    def __init__(self, limit: float):
        self.limit, self.stretch, self.live = limit, None, []

    def peak(self, place: int, kind: int, start: int, end: int, share: int) -> None:
        s = self.stretch = self.stretch or Stretch(start)
        opened, kept = [], []
        for lo, hi, told in self.live:
            if _opens(kind, share, lo, hi, self.limit):
                opened += told
            else:
                kept.append((lo, max(hi, end), told))
        if not s.fixed:
            if kind == 0:
                s.fixed = [place, start, end]
                opened.append(s.fixed)
            elif kind == 2:
                length = _longest(share, self.limit)
                if s.by_zero is None:
                    s.by_zero = [s.top, place, start, end]
                    opened.append(s.by_zero)
                if length is not None:
                    if s.top is not None:
                        r = [s.top - length, place, start, end]
                        s.hit(lo=r)
                        opened += [s.fixed] if s.fixed else [r] if s.by_lo and s.by_lo[-1] is r else []
                    r = [length, place, start, end]
                    s.hit(length=r)
                    opened += [r] if s.by_length and s.by_length[-1] is r else []
            s.top = end if s.top is None else max(s.top, end)
        self.live = [*kept, (start, end, opened)] if opened else kept

    def done(self) -> Stretch:
        for lo, hi, told in self.live:
            for r in told:
                r[-2:] = [int(lo), int(hi)]
        return self.stretch


def _open_clusters(steps: DataFrame, limit: float) -> DataFrame:
    """The cluster open before each part of ``steps``: _part, _lo, _hi.

    Every part is walked once, all at the same time, to its ``Stretch``; these then are followed from part to part. So there is one round, whatever the peaks are like.
    """
    def walk(batches):
        part, w = None, None
        for batch in batches:
            for p, at, step in zip(batch.column("_part").to_pylist(), batch.column("_at").to_pylist(), _steps(batch, limit), strict=True):
                if p != part:
                    if w:
                        yield _row(part, w)
                    part, w = p, _Walk(limit)
                w.peak((p << 33) + at, *step)
        if w:
            yield _row(part, w)

    def _row(part, w):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([w.done().to_json()])], names=["_part", "does"])

    def follow(batches):
        lo, hi, out = 0, 0, []  # the first peak of all opens a cluster, so what is before it does not matter
        for batch in batches:
            for part, does in zip(batch.column("_part").to_pylist(), batch.column("does").to_pylist(), strict=True):
                out.append((part, lo, hi))
                lo, hi = Stretch.from_json(does).after(lo, hi)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["_part", "_lo", "_hi"])

    # A row a part, in order, as for the other stitches of sorted parts.
    does = steps.mapInArrow(walk, "_part int, does string")
    return does.coalesce(1).sortWithinPartitions("_part").mapInArrow(follow, "_part int, _lo long, _hi long")


def _marked(steps: DataFrame, limit: float) -> DataFrame:
    """``steps`` with ``opens``: whether a peak opens a cluster. ``_lo`` and ``_hi`` tell the cluster open before the part."""
    def walk(batches):
        part, lo, hi = None, 0, 0
        for batch in batches:
            marks = []
            for p, a, b, (kind, start, end, share) in zip(*(batch.column(c).to_pylist() for c in ("_part", "_lo", "_hi")), _steps(batch, limit), strict=True):
                if p != part:
                    part, lo, hi = p, a, b
                new = _opens(kind, share, lo, hi, limit)
                if new:
                    lo, hi = start, end
                elif end > hi:
                    hi = end
                marks.append(new)
            keep = [batch.column(c) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(marks, pa.bool_())], names=[*batch.schema.names, "opens"])

    return steps.mapInArrow(walk, T.StructType([*steps.schema.fields, T.StructField("opens", T.BooleanType())]))


_SEGMENT = "_part int, _at long, opened boolean, chrom string, start long, end long, count long, fold double, l10p double"


def _segments(steps: DataFrame, limit: float) -> DataFrame:
    """A row for what each part holds of each cluster. Where the cluster opens in the part, fold and l10p are halved into one value from its first peak on; where
    it goes on, they are what its ``count`` peaks there add to the value halved as many times."""
    def walk(batches):
        def row(part, at, seg):
            opened, chrom, start, end, count, fold, l10p = seg
            return (part, at, opened, chrom, start, end, count, fold, l10p)

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

        names = [c.split()[0] for c in _SEGMENT.split(", ")]
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        part, at, lo, hi, seg, out = None, 0, 0, 0, None, []
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("_part", "_lo", "_hi", "chrom", "fold", "l10p")), _steps(batch, limit), strict=True)
            for p, a, b, chrom, fold, l10p, (kind, start, end, share) in columns:
                if p != part:
                    if seg:
                        out.append(row(part, at, seg))
                    part, at, lo, hi, seg = p, 0, a, b, None
                fold, l10p = fold or 0.0, l10p or 0.0
                if _opens(kind, share, lo, hi, limit):
                    if seg:
                        out.append(row(part, at, seg))
                        at += 1
                    lo, hi = start, end
                    seg = [True, chrom, start, end, 1, fold, l10p]
                else:
                    hi = max(hi, end)
                    seg = seg or [False, chrom, start, end, 0, 0.0, 0.0]
                    seg[3:] = [max(seg[3], end), seg[4] + 1, (seg[5] + fold) / 2, (seg[6] + l10p) / 2]
            if len(out) >= 4096:
                yield made(out)
                out = []
        if seg:
            out.append(row(part, at, seg))
        if out:
            yield made(out)

    return steps.mapInArrow(walk, _SEGMENT)


def peak_merge(peaks: DataFrame, overlap: float = OVERLAP, by_row: bool = False) -> DataFrame:
    """Merge peaks (chrom, start, end, key, pop, fold, l10p) into clusters.

    A peak without overlap to the one before opens a cluster; one that overlaps only the one before
    joins it; one that overlaps both neighbours joins if the overlap is more than ``overlap`` of the
    open cluster's length. The last peak of a chromosome joins if it starts within the slack of the
    one before. Fold and log10 p are halved into the cluster's value one after the other, a null one as 0.

    What a peak does depends on the cluster open before it, so a cluster may reach over the parts
    of the sorted table. Every part is walked twice: once for what it does to any cluster that may be open before it (``Stretch``), and,
    after these have been followed from part to part, once for its peaks. The result is that of one walk over all. A cluster comes out of the second walk as one row a
    part it lies in.
    """
    f = _flagged(peaks)
    joins_last = F.col("is_last") & F.coalesce(F.col("start") - SLACK < F.col("prev_end"), F.lit(False))
    kind = (
        F.when(F.col("is_last"), F.when(joins_last, 1).otherwise(0))
        .when(~F.col("overlaps_prev"), 0)
        .when(F.col("overlaps_next"), 2)
        .otherwise(1)
    )
    cols = ["_part", "_at", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "key", "pop", F.col("fold").cast("double").alias("fold"), F.col("l10p").cast("double").alias("l10p")]
    limit = float(overlap)
    # The windows of the flags leave each part whole in one partition, in order, and the checkpoint keeps it there.
    flagged = f.withColumns({"_kind": kind, "prev_end": F.coalesce("prev_end", F.lit(0)).cast("long")})
    steps = pin(flagged.select(*cols, "_kind", "prev_end").sortWithinPartitions("_part", "_at"))
    placed = steps.join(F.broadcast(_open_clusters(steps, limit)), "_part")  # a row a part
    if by_row:
        marked = pin(_marked(placed, limit).drop("_kind", "prev_end", "_lo", "_hi"))
        return ranged.unsorted(ranged.running_total(marked, F.col("opens").cast("long"), "cluster"))
    numbered = ranged.running_total(pin(_segments(placed, limit)), F.col("opened").cast("long"), "cluster")
    # As many pieces as the cluster has parts, the one that opens it first.
    whole = numbered.groupBy("cluster").agg(
        F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("count").alias("count"),
        F.sort_array(F.collect_list(F.struct("_part", "opened", F.col("count").alias("n"), "fold", "l10p"))).alias("_pieces"),
    )

    def halved(name: str) -> Column:
        return F.aggregate("_pieces", F.lit(0.0), lambda v, p: F.when(p["opened"], p[name]).otherwise(v * F.pow(F.lit(0.5), p["n"]) + p[name]))

    return whole.select(
        "cluster", "chrom", "start", "end", "count", halved("fold").alias("fold"), halved("l10p").alias("l10p"), F.concat_ws("_", "chrom", F.col("start").cast("string")).alias("name")
    )


def cluster_stats(members: DataFrame) -> DataFrame:
    """From ``peak_merge(by_row=True)``: how many clusters have each size (measure ``size``), and how
    many have each number of extra peaks of one population (measure ``extra``, above 0 only).

    Clusters are reduced to one row per (cluster, population) first, so none is collected whole.
    """
    pop = F.split_part("pop", F.lit("_"), F.lit(1))
    per_pop = members.groupBy("cluster", pop.alias("pop")).agg(F.count(F.lit(1)).alias("n"))
    per_cluster = per_pop.groupBy("cluster").agg(F.sum("n").alias("size"), (F.sum("n") - F.count(F.lit(1))).alias("extra"))
    both = per_cluster.select(F.inline(F.array(
        F.struct(F.lit("size").alias("measure"), F.col("size").alias("value")),
        F.struct(F.lit("extra").alias("measure"), F.col("extra").alias("value")),
    ))).where("measure = 'size' or value > 0")
    return both.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("clusters"))


def grouped(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``group``: the number (from 1) of the run of rows with equal ``key`` in ``order``."""
    s = ranged.neighbours(ranged.range_sorted(df, *order), [key], "_prev", "_next")
    starts = (F.col("_prev").isNull() | ~F.col(f"_prev.{key}").eqNullSafe(F.col(key))).cast("long")
    return ranged.unsorted(ranged.running_total(s, starts, "group").drop("_prev", "_next"))


def check_columns(lines: DataFrame, count: int, sep: str = "\t") -> DataFrame:
    """Split lines into ``fields``; a line with another number of columns fails the job."""
    f = F.split("value", sep)
    return lines.withColumn(
        "fields", F.when(F.size(f) == count, f).otherwise(F.raise_error(F.concat(F.lit("wrong number of columns: "), "value")))
    )


def apply_per_group(df: DataFrame, group: str, fn: Callable, schema: str, arrays: bool = False) -> DataFrame:
    """Run a Python function on every group. A group has to fit in one task; use the aggregates
    where they can say the same.

    ``fn`` gets a pandas frame and returns one. With ``arrays`` it gets a dict of column names and numpy arrays and returns one row as a tuple
    in the order of ``schema``: making a frame for every group costs hundreds of times what a small group does.

    Rows are partitioned and sorted by the group and cut up batch by batch, so that a table of many
    small groups does not pay for an Arrow stream per group.
    """
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def each(whole):
        import numpy as np
        import pandas as pd

        if not arrays:
            return pd.concat([fn(g) for _, g in whole.groupby(group, sort=False, dropna=False)])
        key = whole[group]
        same = (key == key.shift()) | (key.isna() & key.shift().isna())
        starts = np.flatnonzero(~same.to_numpy() | (np.arange(len(whole)) == 0))
        columns = {c: whole[c].to_numpy() for c in whole.columns}
        ends = np.append(starts[1:], len(whole))
        return pd.DataFrame([fn({c: v[a:b] for c, v in columns.items()}) for a, b in zip(starts.tolist(), ends.tolist())], columns=names)

    def run(batches):
        import pandas as pd

        held: list = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[group].iloc[-1]
            tail = pdf[group].isna() if pd.isna(last) else pdf[group] == last
            if tail.all() and held and (held[0][group].iloc[0] == last or (pd.isna(held[0][group].iloc[0]) and pd.isna(last))):
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf[~tail]])
            held = [pdf[tail]]
            if len(whole):
                yield each(whole)
        if held:
            yield each(pd.concat(held))

    return df.repartition(parallelism(df.sparkSession), group).sortWithinPartitions(group).mapInPandas(run, schema)


def pick_causal(df: DataFrame, exclude: bool = False, threshold: float = 0.9, default_prior: float = 0.1723) -> DataFrame:
    """Adds causal Y/N by the posterior; ``exclude`` leaves out singletons and peaks without a causal SNP.

    Rows: snp, peak, posterior and optionally prior. Peaks are summed up first and joined back, so a
    peak with many rows is never gathered in one task.
    """
    causal = F.col("posterior") > threshold
    out = df.withColumn("causal", F.when(causal, "Y").otherwise("N"))
    if "prior" not in df.columns:
        out = out.withColumn("prior", F.lit(default_prior))
    if exclude:
        peaks = df.groupBy("peak").agg(F.count(F.lit(1)).alias("n"), F.count_if(causal).alias("c"))
        out = out.join(peaks.where("n > 1 and c > 0").select("peak"), "peak", "left_semi")
    return out


def causal_stats(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Peaks by their number of causal SNPs, with how many of them are singletons."""
    peaks = df.groupBy("peak").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("posterior") > threshold).alias("causal_snps")
    )
    return peaks.groupBy("causal_snps").agg(F.count(F.lit(1)).alias("peaks"), F.count_if(F.col("n") == 1).alias("singletons"))
