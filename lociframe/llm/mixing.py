"""Mixing sources to target weights by proportionate-fair scheduling of blocks.

Documents of a source form blocks of equal size. Time is in slots of one block. Target weights are fractions q/Q of a period of Q slots, so in a
full period a source has q blocks, and its i-th block may start in slot floor(i*Q/q) and has to be done by slot ceil((i+1)*Q/q).
Earliest deadline first meets all deadlines, so at any slot a source is less than one block from its target, and exactly on it at the end of a
period. When a source runs out in a period it has what is left of it there, and the others share the later periods in proportion. So there
are at most two kinds of periods a source and one besides; each kind is scheduled once and repeats.

Defined results: every row stays; a null source is a source of its own; rows with equal ids are rows of their own; an empty table
gives an empty one. More than ``MOST_SOURCES`` sources raise an error, as weights are given by source.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.llm.util import prefixed, same

PERIOD = 1000
BLOCK_DOCS = 16
MOST_SOURCES = 1000
OUT = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_pos")


def shares(sizes: dict, weights: dict | None, alpha: float, period: int) -> dict:
    """Blocks a period for each source: its weight in ``period`` slots, by largest remainders, one at least. Without weights: size to the power alpha."""
    raw = {s: max(0.0, weights.get(s, 0.0)) if weights else n**alpha for s, n in sizes.items()}
    total = sum(raw.values()) or 1.0
    exact = {s: w / total * max(period, 4 * len(raw)) for s, w in raw.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    spare = max(period, 4 * len(raw)) - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))[: max(0, spare)]:
        out[s] += 1
    return out


def periods(blocks: list[int], quota: list[int]) -> list[tuple[int, int, list[int]]]:
    """Runs of equal periods: first period, how many, blocks of each source in it."""
    cuts = sorted({0} | {x for n, q in zip(blocks, quota, strict=True) for x in (n // q, -(-n // q))})
    return [
        (a, b - a, [max(0, min(q, n - a * q)) for n, q in zip(blocks, quota, strict=True)])
        for a, b in zip(cuts, cuts[1:], strict=False)
    ]


def schedule(quota: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Earliest deadline first over one period: (source, block, slot, release, deadline)."""
    length = sum(quota)
    coming = sorted(((i * length) // q, -(-((i + 1) * length) // q), s, i) for s, q in enumerate(quota) for i in range(q))
    ready: list[tuple[int, int, int, int]] = []
    out, k = [], 0
    for slot in range(length):
        while k < len(coming) and coming[k][0] <= slot:
            release, deadline, s, i = coming[k]
            heapq.heappush(ready, (deadline, s, i, release))
            k += 1
        deadline, s, i, release = heapq.heappop(ready)
        assert slot < deadline, "a block would miss its deadline"
        out.append((s, i, slot, release, deadline))
    return out


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, source_col: str = "source", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """``docs`` with mix_block (number in its source), mix_slot, mix_release, mix_deadline and mix_pos, the order of the mixture.

    Ranks within a source are taken in hash buckets, about the square root of its size in number, and stitched by their counts, so no task holds a
    source. Only one row a source goes to the driver.
    """
    spark = docs.sparkSession
    counted = {r[0]: r[1] for r in docs.groupBy(source_col).count().limit(MOST_SOURCES + 1).collect()}
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = sorted(counted, key=lambda s: (s is None, str(s)))
    quota_by = shares(counted, weights, alpha, period)
    quota = [quota_by[s] for s in names]
    runs = periods([-(-counted[s] // block_docs) for s in names], quota)
    kind = docs.schema[source_col].dataType.simpleString()
    parts = [max(1, math.isqrt(counted[s])) for s in names]
    known = spark.createDataFrame([(s, i, quota[i], parts[i]) for i, s in enumerate(names)], f"__name {kind}, __sid int, __q long, __parts long")
    start, run_rows = 0, []
    for k, (first, many, shape) in enumerate(runs):
        run_rows.append((k, first, first + many, start, sum(shape), shape))
        start += many * sum(shape)
    shapes = spark.createDataFrame(run_rows, "run int, first long, last long, start long, length long, shape array<long>")

    def slots(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(row.run, row.first, row.last, row.start, row.length, *job) for row in part.itertuples(index=False) for job in schedule([int(x) for x in row.shape])]
        return pd.DataFrame(rows, columns=["run", "first", "last", "start", "length", "s", "i", "slot", "release", "deadline"])

    table = shapes.groupBy("run").applyInPandas(slots, "run int, first long, last long, start long, length long, s int, i long, slot long, release long, deadline long")
    table = prefixed(table, "__t_")
    docs = docs.drop(*OUT)
    # One row a source, MOST_SOURCES at most.
    rows = docs.join(F.broadcast(known), same(F.col(source_col), F.col("__name")), "left").withColumn("__h", F.xxhash64(F.col(id_col)))
    rows = rows.withColumn("__part", F.pmod("__h", "__parts"))
    sums = Window.partitionBy("__sid").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__sid", "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(sums))
    before = before.select(F.col("__sid").alias("__s2"), F.col("__part").alias("__p2"), F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__sid", "__part").orderBy("__h", id_col)) - 1)
    ranked = ranked.join(before, (F.col("__sid") == F.col("__s2")) & (F.col("__part") == F.col("__p2")), "left")
    ranked = ranked.withColumn("__at", F.col("__rank") + F.col("__before"))
    ranked = ranked.withColumn("mix_block", F.expr(f"__at div {block_docs}")).withColumn("__off", F.col("__at") % block_docs)
    ranked = ranked.withColumn("__period", F.expr("mix_block div __q")).withColumn("__i", F.col("mix_block") % F.col("__q"))
    within = (F.col("__period") >= F.col("__t_first")) & (F.col("__period") < F.col("__t_last"))
    # Bounded by the sources and the slots of a period, whatever the number of documents; Spark picks the join by its size.
    placed = ranked.join(table, (F.col("__sid") == F.col("__t_s")) & (F.col("__i") == F.col("__t_i")) & within, "left")
    begin = F.col("__t_start") + (F.col("__period") - F.col("__t_first")) * F.col("__t_length")
    return placed.select(
        *[F.col(c) for c in docs.columns], "mix_block", (begin + F.col("__t_slot")).alias("mix_slot"), (begin + F.col("__t_release")).alias("mix_release"),
        (begin + F.col("__t_deadline")).alias("mix_deadline"), ((begin + F.col("__t_slot")) * block_docs + F.col("__off")).alias("mix_pos"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents with mix_pos, written in that order."""
    keep = [c for c in docs.columns if c not in OUT]
    return mix(docs, **options).select(*keep, "mix_pos").repartitionByRange("mix_pos").sortWithinPartitions("mix_pos")
