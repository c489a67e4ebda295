"""Whitening of embeddings from a bit-sliced scatter matrix.

Entries become integers x = floor(scale c) + shift. Per dimension the least x is taken off, and the bits of what is left are packed, one plane a bit,
over the rows of a batch into 64-bit words. The cross-product of two dimensions is then a sum over pairs of planes of 2^(p+q) times the bits that both have
set. Tasks add these up as integers, Spark adds the tasks', and n times the scatter less the product of the sums is the covariance times n^2 as an integer.
Only then does it become floating point, for the eigenvectors of a matrix whose size is the dimension, not the number of rows.

Defined results: rows with a null vector, null or non-finite entries, an entry of 2^62 / scale or more, or another length than most rows (of lengths
equally frequent the greatest) take no part. Null ids and repeated rows are rows like others. Components without variance (as far as doubles tell) have a null
``whitened`` and take no part in ``identity_error``. A ``deviation`` beyond 64 bits is null. An empty table gives an empty result, as do empty vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LIMIT = float(1 << 62)
ROWS = 1 << 13  # rows whose planes are packed together


def usable(rows: DataFrame, vector: str, *others: Column, scale: int = SCALE) -> DataFrame:
    """``others`` and v, the vector, of the rows that take part."""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    whole = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < LIMIT / scale))
    good = rows.select(F.col(vector).cast(kind).alias("v"), *others).where(F.col("v").isNotNull()).where(whole)
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).select("n").first()
    return good.where((F.size("v") == (size[0] if size else 0)) & (F.size("v") > 0))


def integers(vectors: pd.Series, scale: int, shift: int) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors], float).reshape(len(vectors), -1)
    return np.floor(m * scale).astype(np.int64) + shift


def whole_sum(x: np.ndarray) -> list[int]:
    """Sums of the columns, as Python's integers; two halves, so that none leaves 64 bits."""
    low, high = x & 0xFFFFFFFF, x >> 32
    return [int(a) + (int(b) << 32) for a, b in zip(low.sum(axis=0), high.sum(axis=0), strict=True)]


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of non-negative integers (rows, d): words of shape (bits, d, words)."""
    n, d = x.shape
    words = -(-n // 64)
    full = np.zeros((words * 64, d), np.uint64)
    full[:n] = x.astype(np.uint64)
    out = np.zeros((bits, d, words), np.uint64)
    for p in range(bits):
        out[p] = np.ascontiguousarray(np.packbits((full >> np.uint64(p)).astype(np.uint8) & 1, axis=0).T).view(np.uint64)
    return out


def scatter(x: np.ndarray, bits: int) -> np.ndarray:
    """Exact sums over the rows of x_i x_j, as Python's integers (d, d), by weighted AND-popcounts of the planes."""
    d = x.shape[1]
    every = planes(x, bits)
    words = every.shape[2]
    flat = np.ascontiguousarray(every.reshape(bits * d, words))
    weight = [1 << p for p in range(bits)]
    total = np.zeros((d, d), object)
    for p in range(bits):
        for i in range(d):
            line = flat[p * d + i]
            if not line.any():
                continue
            both = np.bitwise_count(flat & line).sum(axis=1, dtype=np.int64).reshape(bits, d)
            small = 2 * bits + words.bit_length() + 6 < 62
            add = (both * np.array(weight, np.int64)[:, None]).sum(axis=0) if small else sum(both[q].astype(object) * weight[q] for q in range(bits))
            total[i] += np.array([int(v) << p for v in add], object)
    return total


@dataclass
class Fit:
    """A fitted whitening: number of rows, exact sums, n^2 times the covariance as integers, and per component its vector, variance and share."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float


def fit(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> Fit | None:
    """``rows``: v, as ``usable`` gives them. What comes to the driver is bounded by the dimension: 3 d numbers and d (d + 1) / 2."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, low, high, sums = 0, None, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = integers(batch["v"], scale, shift)
            n += len(x)
            add = whole_sum(x)
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
            sums = add if sums is None else [a + b for a, b in zip(sums, add, strict=True)]
        if n:
            yield pd.DataFrame({"i": range(len(low)), "n": n, "low": low, "high": high, "sum": [str(s) for s in sums]})

    seen = rows.select("v").mapInPandas(measure, "i int, n long, low long, high long, sum string")
    got = seen.groupBy("i").agg(F.sum("n"), F.min("low"), F.max("high"), F.sum(F.col("sum").cast("decimal(38,0)"))).orderBy("i").collect()
    if not got:
        return None
    n, d = int(got[0][1]), len(got)
    low = np.array([g[2] for g in got], np.int64)
    bits = max((int(g[3]) - int(g[2])).bit_length() for g in got)
    sums = [int(g[4]) for g in got]

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d), object)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                total = total + scatter(integers(batch["v"].iloc[at : at + ROWS], scale, shift) - low, bits)
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "value": [str(v) for v in total[i, j]]})

    parts = rows.select("v").mapInPandas(cross, "i int, j int, value string")
    taken = [s - n * int(m) for s, m in zip(sums, low, strict=True)]  # sums of what was packed
    centred = [[0] * d for _ in range(d)]
    for i, j, value in parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        centred[i][j] = centred[j][i] = n * int(value) - taken[i] * taken[j]
    # Division of integers rounds once.
    matrix = np.array([[v / (n * n) for v in row] for row in centred])
    variances, vectors = np.linalg.eigh(matrix)
    trace = sum(centred[i][i] for i in range(d)) / (n * n)
    return Fit(n, sums, centred, vectors[:, ::-1], variances[::-1], trace)


def whiten(rows: DataFrame, model: Fit, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``rows`` (v and other columns) with deviation (string of an exact integer) and whitened (array of ``components`` doubles at most, null without variance)."""
    k = min(components, len(model.sums))
    n, sums, vectors, e = model.n, model.sums, model.vectors[:, :k], model.variances[:k]
    # Rounding of the eigenvalues is a small multiple of this.
    floor = len(sums) * np.finfo(float).eps * max(model.trace, 0.0) * 4
    some = e > floor

    @F.pandas_udf("deviation string, whitened array<double>")
    def project(v: pd.Series) -> pd.DataFrame:
        x = integers(v, scale, shift)
        fits = n * (int(np.abs(x).max()) + 1) < 1 << 62 and max(abs(s) for s in sums) < 1 << 62
        off = n * x - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object)
        if fits and len(sums) * int(np.abs(off).max()) ** 2 < 1 << 63:
            deviation = (off * off).sum(axis=1)
        else:
            deviation = (off.astype(object) ** 2).sum(axis=1)
        centred = (off / n).astype(float)
        out = np.full((len(x), k), np.nan)
        out[:, some] = centred @ vectors[:, some] / np.sqrt(e[some])
        return pd.DataFrame({"deviation": [str(s) for s in deviation], "whitened": [[None if np.isnan(w) else w for w in row] for row in out.tolist()]})

    return rows.withColumn("p", project("v")).select(*rows.columns, "p.*")


def identity_error(white: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of ``whitened``, centred first, less the identity, over the components that have a variance."""

    def total(values) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, n = None, 0
            for batch in batches:
                if len(batch):
                    m = np.array([[np.nan if w is None else w for w in row] for row in batch["whitened"]], float)
                    add = values(m)
                    held, n = add if held is None else held + add, n + len(m)
            if n:
                yield pd.DataFrame({"at": np.arange(held.size, dtype=np.int32), "n": n, "value": held.ravel()})

        return white.select("whitened").mapInPandas(run, "at int, n long, value double").groupBy("at").agg(F.sum("value"), F.sum("n")).orderBy("at")

    sums = total(lambda m: m.sum(axis=0)).collect()
    if not sums:
        return None
    n, mean = sums[0][2], np.array([np.nan if s[1] is None else s[1] / s[2] for s in sums])
    k = len(mean)
    cov = np.array([np.nan if s[1] is None else s[1] for s in total(lambda m: (m - mean).T @ (m - mean)).collect()]).reshape(k, k) / n
    some = ~np.isnan(mean)
    return float(np.abs(cov[np.ix_(some, some)] - np.eye(int(some.sum()))).max()) if some.any() else None


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each component, from 1 by falling variance."""
    kind = rows.schema[id_col].dataType.simpleString()
    good = usable(rows, vector_col, F.col(id_col).alias("id"))
    model = fit(good)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = whiten(good, model, components).drop("v")
    error = identity_error(white)
    share = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.variances[:components]]
    return white.select("id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(s) for s in share])[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
