"""Hard negatives by angular triangle filtering.

Vectors become integers floor(256 x). Every row stores its angle to each reference direction. For an anchor a, a row x and a reference r, the angle
between a and x lies between |angle(a, r) - angle(x, r)| and the lesser of angle(a, r) + angle(x, r) and what is left of a full turn. The cosines of these
bounds times the norms bound the score; angles and products are widened by more than rounding can change, so a bound never lies.

Rows are range-sorted by label, nearest reference and angle to it, and packed into blocks of a few thousand rows; a block is cut into windows of
``WINDOW`` rows that know the range of their angles, norms and labels. Anchors are packed in the same way. A block of rows meets a block of anchors only if
their ranges allow a score that counts, and in such a pair only the windows whose score interval overlaps what the anchor still looks for are scored,
exactly, as integers. One pass finds the positives of every anchor, a second one the negatives between the bounds these give. What a pair of blocks
returns is at most ``positives`` or ``positives x negatives`` rows an anchor, merged by anchor afterwards.

Defined results: rows with a null label, a null vector, null or non-finite components, or another length than most rows (of lengths equally
frequent the greatest) take no part. A row without an id may be chosen; its id sorts last. Rows with equal ids are rows of their own; what ties even in
the id goes by label and vector. Products beyond 64 bits are cut to the greatest 64-bit number. An empty table, or no anchors, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.config import pin
from lociframe.plans.ranged import range_sorted, row_index, running_total

SCALE = 256
REFERENCES = 24  # directions: rows of a bounded sample, each the farthest from those before it
SAMPLE = 2048  # rows the references are chosen from: those with the least hash
BLOCK, ANCHOR_BLOCK, WINDOW = 2048, 512, 64
STRIPE = 16  # blocks of rows a call scans at most
SLACK = 1e-6  # radians; arccos of a rounded cosine is off by 3e-8 at most
MOST = float(1 << 63)  # scores are cut to 64 bits, and so are their bounds
EXACT = 1 << 52  # doubles hold integers up to here; products of norms below it are summed without rounding


def usable(rows: DataFrame, vector: str, *others: Column) -> DataFrame:
    """``others`` and v, the vector, of the rows whose vector takes part; a float vector stays one."""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    whole = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = rows.select(F.col(vector).cast(kind).alias("v"), *others).where(F.col("v").isNotNull()).where(whole)
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).select("n").first()
    return good.where(F.size("v") == (size[0] if size else 0))


def integers(vectors: pd.Series) -> np.ndarray:
    """floor(SCALE x), cut to 64 bits."""
    m = np.floor(np.array([np.asarray(v, float) for v in vectors], float).reshape(len(vectors), -1 if len(vectors) else 0) * SCALE)
    top = 2.0**63
    return np.where(m >= top, np.int64((1 << 63) - 1), np.clip(m, -top, np.nextafter(top, 0)).astype(np.int64))


def references(rows: DataFrame) -> np.ndarray:
    """Unit directions: each the farthest in angle from those before, among at most SAMPLE rows of ``rows`` (id, v)."""
    sample = rows.orderBy(F.xxhash64("v", "id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    m = integers(sample).astype(float)
    norm = np.linalg.norm(m, axis=1)
    m = m[norm > 0] / norm[norm > 0, None]
    chosen: list[int] = []
    nearest = np.full(len(m), -np.inf)
    while len(chosen) < min(REFERENCES, len(m)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, m @ m[chosen[-1]])
    return m[chosen]


def with_angles(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """Adds norm, angles (to every reference), near (the closest reference) and theta (the angle to it). A zero vector has angle 0 to all."""

    @F.pandas_udf("norm double, angles array<double>, near int, theta double")
    def angle(v: pd.Series) -> pd.DataFrame:
        m = integers(v).astype(float)
        norm = np.linalg.norm(m, axis=1)
        unit = np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)
        angles = np.arccos(np.clip(unit @ refs.T, -1, 1)) if len(refs) else np.zeros((len(m), 1))
        angles[norm == 0] = 0
        near = angles.argmin(axis=1)
        return pd.DataFrame({"norm": norm, "angles": list(angles), "near": near.astype(np.int32), "theta": angles[np.arange(len(m)), near]})

    return rows.withColumn("a", angle("v")).select(*rows.columns, "a.*")


PACKED = "block long, row binary, id binary, no_id binary, label binary, norm binary, angles binary, x binary, width int, lo array<double>, hi array<double>, norms array<double>, labels array<long>"


def packed(rows: DataFrame) -> DataFrame:
    """A row a ``block`` of at most BLOCK rows: its rows as arrays in order, and the ranges of their angles, norms and labels."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        x = integers(part["v"])
        width = next(w for w in (2, 4, 8) if w == 8 or (x.size == 0 or np.abs(x.astype(float)).max() < 1 << (8 * w - 1)))
        angles = np.array([np.asarray(a, float) for a in part["angles"]])
        row = {
            "block": part["block"].iloc[0], "row": part["row"].to_numpy(np.int64).tobytes(), "id": part["id"].fillna(0).to_numpy(np.int64).tobytes(), "no_id": part["id"].isna().to_numpy(bool).tobytes(),
            "label": part["label"].to_numpy(np.int64).tobytes(), "norm": part["norm"].to_numpy(float).tobytes(), "angles": angles.tobytes(), "x": x.astype(f"<i{width}").tobytes(), "width": width,
            "lo": angles.min(axis=0), "hi": angles.max(axis=0), "norms": [part["norm"].min(), part["norm"].max()], "labels": [part["label"].min(), part["label"].max()],
        }
        return pd.DataFrame([row])

    return rows.select("block", "row", "id", "label", "norm", "angles", "v").groupBy("block").applyInPandas(pack, PACKED)


class Cells:
    """The rows of a block, and the ranges of their windows."""

    def __init__(self, block: pd.Series):
        self.row, self.id, self.label = (np.frombuffer(block[c], np.int64) for c in ("row", "id", "label"))
        n = len(self.row)
        self.no_id, self.norm = np.frombuffer(block["no_id"], bool), np.frombuffer(block["norm"], float)
        self.angles, self.x = np.frombuffer(block["angles"], float).reshape(n, -1), np.frombuffer(block["x"], f"<i{block['width']}").reshape(n, -1).astype(np.int64)
        self.at = np.arange(0, n, WINDOW)
        self.ends = np.minimum(self.at + WINDOW, n)
        each = lambda fn, v: fn.reduceat(v, self.at, axis=0)
        self.lo, self.hi = each(np.minimum, self.angles), each(np.maximum, self.angles)
        self.norms = np.array([each(np.minimum, self.norm), each(np.maximum, self.norm)])
        self.labels = np.array([each(np.minimum, self.label), each(np.maximum, self.label)])


def bounds(norm: np.ndarray, angle: np.ndarray, norms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of anchors (rows) with windows (columns), from the windows' ranges of norms (2, w) and angles ``lo``, ``hi`` (w, references)."""
    near, far = np.zeros((len(norm), len(lo))), np.full((len(norm), len(lo)), np.pi)
    for r in range(lo.shape[1]):
        t = angle[:, r, None]
        near = np.maximum(near, np.maximum(lo[None, :, r] - t, t - hi[None, :, r]))
        far = np.minimum(far, np.minimum(t + hi[None, :, r], 2 * np.pi - t - lo[None, :, r]))
    top, low = np.cos(np.clip(near - SLACK, 0, np.pi)), np.cos(np.clip(far + SLACK, 0, np.pi))
    room = 1 + 1e-9 * norm[:, None] * norms[1]
    down, up = norm[:, None] * np.where(low > 0, norms[0], norms[1]) * low - room, norm[:, None] * np.where(top > 0, norms[1], norms[0]) * top + room
    return np.clip(down, -MOST, MOST), np.clip(up, -MOST, MOST)


def exact(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Integer products: summed as doubles where these hold every sum (``most``), as Python's integers beyond."""
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    top = (1 << 63) - 1
    return np.array([[max(-top, min(top, v)) for v in row] for row in a.astype(object) @ b.astype(object).T], np.int64).reshape(len(a), len(b))


def scan(anchors: Cells, blocks: list[Cells], slots: list[tuple[int, int | None]], k: int, share: tuple[int, int]) -> tuple[list[tuple], int]:
    """The first ``k`` rows for each slot (number of the anchor, positive score) by falling score, and the number of products taken. A slot without a score takes
    rows of the anchor's label, one with a score rows of others that score at most this and at least ``share`` of it."""
    of = np.array([i for i, _ in slots], int)
    wanted = slots[0][1] is not None
    top = [s for _, s in slots] if wanted else [(1 << 63) - 1] * len(slots)
    floor = [max(-(1 << 63), -(-share[0] * s // share[1])) if wanted else -(1 << 63) for s in top]
    held: list[list[tuple]] = [[] for _ in slots]
    least, most = np.array(floor, float), np.array(top, float)  # of interest is least <= score <= most, as far as doubles tell
    taken = 0
    for cells in blocks:
        low, high = bounds(anchors.norm, anchors.angles, cells.norms, cells.lo, cells.hi)
        slack = 1e-9 * np.abs(least)[:, None]
        overlap = (high[of] >= least[:, None] - slack) & (low[of] <= most[:, None] * (1 + 1e-9) + 1)
        within = (anchors.label[of, None] >= cells.labels[0]) & (anchors.label[of, None] <= cells.labels[1])
        overlap &= ~(within & (cells.labels[0] == cells.labels[1])) if wanted else within
        score, known = np.zeros((len(anchors.row), len(cells.row)), np.int64), np.zeros((len(anchors.row), len(cells.row)), bool)
        for w in np.flatnonzero(overlap.any(axis=0)):
            pick, at = np.unique(of[overlap[:, w]]), slice(cells.at[w], cells.ends[w])
            score[pick, at] = exact(anchors.x[pick], cells.x[at], float(anchors.norm[pick].max() * cells.norms[1, w]))
            known[pick, at] = True
            taken += len(pick) * (at.stop - at.start)
        for slot in np.flatnonzero(overlap.any(axis=1)):
            i = of[slot]
            alike = cells.label == anchors.label[i]
            ok = known[i] & (~alike if wanted else alike & (cells.row != anchors.row[i])) & (score[i] >= floor[slot]) & (score[i] <= top[slot])
            at = np.flatnonzero(ok)
            if len(at) > k:
                at = at[np.lexsort((cells.row[at], cells.id[at], cells.no_id[at], -score[i, at].astype(float)))]
                at = at[score[i, at] >= score[i, at[k - 1]]]  # doubles may tie where integers do not
            if len(at):
                held[slot] = sorted(held[slot] + [(-int(score[i, a]), bool(cells.no_id[a]), int(cells.id[a]), int(cells.row[a])) for a in at])[:k]
                if len(held[slot]) == k:
                    least[slot] = max(least[slot], float(-held[slot][-1][0]))
    out = [(int(anchors.row[i]), s, -neg, no_id, None if no_id else key, row) for (i, s), found in zip(slots, held, strict=True) for neg, no_id, key, row in found]
    return out, taken


_FOUND = "anchor long, want long, score long, no_id boolean, id long, row long"


def _search(anchors: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int, share: tuple[int, int], wanted: bool) -> DataFrame:
    """Scan the ``pairs`` (ab, rb) of blocks in calls of one block of anchors and a stripe of blocks of rows; the first ``k`` of each slot over all calls."""
    stripe = F.expr(f"rb div {STRIPE}").alias("stripe")
    asked = pairs.select(F.col("ab").alias("call"), stripe).distinct().join(anchors, F.col("call") == F.col("block")).drop("block")
    sent = pairs.join(blocks, F.col("rb") == F.col("block")).select("ab", stripe, *blocks.columns)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            block = Cells(left.iloc[0])
            slots: list[tuple[int, int | None]] = [(i, None) for i in range(len(block.row))]
            if wanted:
                number = {int(r): i for i, r in enumerate(block.row)}
                slots = sorted({(number[w["anchor"]], int(s)) for w in left["wants"].iloc[0] for s in w["scores"]})
            others = [Cells(row) for _, row in right.sort_values("block").iterrows()]
            found = scan(block, others, slots, k, share)[0] if slots else []
        out = pd.DataFrame(found, columns=["anchor", "want", "score", "no_id", "id", "row"])
        return out.astype({"want": "Int64", "id": "Int64"})

    found = asked.groupBy("call", "stripe").cogroup(sent.groupBy("ab", "stripe")).applyInPandas(run, _FOUND)
    order = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "no_id", "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _interval(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest score of a pair of blocks from their ranges."""
    c = lambda side, name: F.col(f"{side}.{name}")
    gap = lambda p, q: F.array_max(F.zip_with(c(p, "lo"), c(q, "hi"), lambda x, y: x - y))
    near = F.greatest(F.lit(SLACK), gap(a, b), gap(b, a)) - SLACK
    far = F.least(
        F.lit(np.pi), F.array_min(F.zip_with(c(a, "hi"), c(b, "hi"), lambda x, y: x + y)) + SLACK, F.array_min(F.zip_with(c(a, "lo"), c(b, "lo"), lambda x, y: 2 * np.pi - x - y)) + SLACK
    )
    small, great = c(a, "norms")[0] * c(b, "norms")[0], c(a, "norms")[1] * c(b, "norms")[1]
    room = 1 + 1e-9 * great
    cut = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c))
    return cut(F.when(F.cos(far) > 0, small).otherwise(great) * F.cos(far) - room), cut(F.when(F.cos(near) > 0, great).otherwise(small) * F.cos(near) + room)


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", is_anchor: Column | None = None, positives: int = 5, negatives: int = 5,
    share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (``is_anchor``, over the columns of ``rows``) and
    each of its ``positives`` best other rows of its label, the best ``negatives`` rows of other labels that score at most the positive and at least ``share`` of it."""
    label = F.col(label) if isinstance(label, str) else label
    is_anchor = F.pmod(F.col(id_col), F.lit(100)) == 0 if is_anchor is None else is_anchor
    base = usable(rows, vector_col, F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks")).where("label IS NOT NULL")
    angled = with_angles(base, references(base)).withColumn("copy", F.monotonically_increasing_id())
    s = row_index(range_sorted(angled, "label", "near", "theta", "id", F.xxhash64("v"), "copy"))
    s = running_total(s, F.col("asks").cast("long"), "asked")
    blocks = pin(packed(s.withColumn("block", F.expr(f"row div {BLOCK}"))))
    asking = s.where("asks").withColumn("block", F.expr(f"(asked - 1) div {ANCHOR_BLOCK}"))
    anchors = pin(packed(asking))
    count = anchors.count()
    slim = ["block", "lo", "hi", "norms", "labels"]
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")) if count else F.array().cast("array<long>")
    every = blocks.select(F.struct(*slim).alias("b"), F.explode(numbers).alias("ab"))
    met = every.join(anchors.select(F.struct(*slim).alias("a"), F.col("block").alias("k")), F.col("ab") == F.col("k")).select("ab", F.col("b.block").alias("rb"), "a", "b")
    low, high = _interval("a", "b")
    one = lambda c: F.col(f"{c}.labels")
    alike = met.where((one("a")[0] <= one("b")[1]) & (one("b")[0] <= one("a")[1])).select("ab", "rb")
    found = pin(_search(anchors, blocks, alike, positives, share, wanted=False))

    wants = found.groupBy("anchor").agg(F.collect_set("score").alias("scores"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    of = asking.select(F.col("row").alias("k"), F.col("id").alias("anchor_id"), F.col("block").alias("ab"))
    wants = wants.join(of, F.col("anchor") == F.col("k")).groupBy("ab").agg(F.collect_list(F.struct("anchor", "scores")).alias("wants"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    wants = pin(wants)
    told = anchors.join(wants.select(F.col("ab").alias("k"), "wants"), F.col("block") == F.col("k")).drop("k")
    reach = met.join(wants.select(F.col("ab").alias("k2"), "least", "most"), F.col("ab") == F.col("k2"))
    one_label = (one("a")[0] == one("a")[1]) & (one("b")[0] == one("b")[1]) & (one("a")[0] == one("b")[0])
    reach = reach.where(~one_label & (high >= F.col("least") * (share[0] / share[1]) * (1 - 1e-9)) & (low <= F.col("most") * (1 + 1e-9) + 1)).select("ab", "rb")
    hard = _search(told, blocks, reach, negatives, share, wanted=True)
    hard = hard.select(F.col("anchor").alias("k"), "want", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pos = found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = pos.join(of.select(F.col("k").alias("of"), "anchor_id"), F.col("anchor") == F.col("of"))
    return named.join(hard, (F.col("anchor") == F.col("k")) & (F.col("positive_score") == F.col("want"))).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
