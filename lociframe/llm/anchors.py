"""Where windows of a fixed length may repeat in a corpus: the frame of suffix-array and substring dedup.

Every window is keyed by the least hash of its runs of ``gram`` units, so equal windows have equal keys wherever they start. Neighbouring windows of one
key form a context, some 80 bytes or 20 words longer than a window. Keys that occur once in the corpus are dropped; equal contexts
of a key are one context with a count. Where all contexts of a key are equal, its windows repeat there and nowhere else, so that is decided without their text. Contexts go to shards by their key, so all windows that can be equal meet in one shard, which a solver
decides. What it decides for a context holds for all its occurrences. A key with more than ``most`` different contexts is not sent to a shard: its windows
are grouped by their own hash in as many tasks as Spark deals them to.

Texts move twice, and only contexts of repeated keys move besides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.config import pin
from lociframe.llm import tokens
from lociframe.llm.tokens import map_batches
from lociframe.llm.util import mix64

SHARD_BYTES = 1 << 20
LEAST_SHARDS = 64
MOST_CONTEXTS = 20_000
#: Bytes of text looked at together: arrays of 8 bytes a byte of it, which should stay in a core's cache.
PORTION = 1 << 18


@dataclass(frozen=True)
class Kind:
    """Units that windows are made of, the units of a window and of a gram."""

    unit: str  # "byte" or "word"
    window: int
    gram: int


@dataclass
class Units:
    hash: np.ndarray
    first: np.ndarray  # first unit of each text, and the end


def units(texts: list[bytes], unit: str) -> Units:
    if unit == "word":
        w = tokens.words(texts)
        return Units(w.hash, w.first)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return Units(raw.astype(np.uint64) + np.uint64(1), first)


def slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``size`` values in a row."""
    done = 1
    while done * 2 <= size:
        x = pick(x[: len(x) - done], x[done:])
        done *= 2
    return pick(x[: len(x) - (size - done)], x[size - done :]) if size > done else x


@dataclass
class Contexts:
    text: np.ndarray
    start: np.ndarray  # first unit within the text
    windows: np.ndarray
    key: np.ndarray
    times: np.ndarray | None  # how often the gram behind the key is in the context, if that was asked for
    content: np.ndarray | None  # if that was not


def contexts(u: Units, kind: Kind, counting: bool) -> Contexts:
    n, span = len(u.hash), kind.window - kind.gram + 1
    if n < kind.window:
        return Contexts(*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    power, inverse = tokens.powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(u.hash * power[:n], dtype=np.uint64)))
    gram = mix64((sums[kind.gram :] - sums[: n + 1 - kind.gram]) * inverse[: n + 1 - kind.gram])
    least = slide(gram, span, np.minimum)  # of each window
    # Contexts end where the least changes, a text begins or its last window is over.
    change = np.ones(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=change[1:-1])
    edges = np.concatenate((u.first[:-1], np.maximum(u.first[:-1], u.first[1:] - kind.window + 1)))
    change[edges[edges < len(least)]] = True
    a = np.flatnonzero(change)
    a, b = a[:-1], a[1:]
    text = np.searchsorted(u.first, a, side="right") - 1
    good = a + kind.window <= u.first[text + 1]
    a, b, text = a[good], b[good], text[good]
    key = least[a]
    if not counting:
        stop = b - 1 + kind.window
        content = mix64((sums[stop] - sums[a]) * inverse[a], 3) ^ mix64((stop - a).astype(np.uint64), 5)
        return Contexts(text, a - u.first[text], b - a, key, None, content)
    # Positions of grams that are the least of some window of any text; for counting those behind a key.
    padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    place = np.flatnonzero(gram == slide(padded, span, np.maximum))
    low, high = np.searchsorted(place, a), np.searchsorted(place, b + span - 1)
    total = high - low
    flat = np.repeat(low - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(total.sum())
    times = np.bincount(np.repeat(np.arange(len(a)), total), gram[place[flat]] == np.repeat(key, total), minlength=len(a)).astype(np.int64)
    return Contexts(text, a - u.first[text], b - a, key, times, None)


def _portions(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    begin, held, size = 0, [], 0
    for k, text in enumerate(column.to_pylist()):
        data = (text or "").encode("utf-8", "replace")
        if held and size + len(data) > PORTION:
            yield begin, held
            begin, held, size = k, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield begin, held


Solver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[list[tuple[int, int, int]]]]


def repeats(docs: DataFrame, kind: Kind, solver: Solver, relation: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_CONTEXTS) -> DataFrame:
    """Rows (id, digest, spans): the windows of each text to act on, as (first unit, end unit).

    ``relation`` is "anywhere" (a window that starts anywhere else, too) or "earlier" (one that starts in a document with a smaller id).
    The solver gets contexts, their windows, counts and least ids, and gives for each the runs of windows as (first, number, least id of any occurrence).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    texts = texts.withColumn("id", F.coalesce("id", F.lit((1 << 63) - 1)))  # no id: after all others

    def keys(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, part in _portions(batch.column("text")):
            c = contexts(units(part, kind.unit), kind, True)
            yield {"key": pa.array(c.key.view(np.int64)), "times": pa.array(c.times)}

    often = map_batches(texts.select("text"), keys, "key long, times long").groupBy("key").agg(F.sum("times").alias("times")).where("times > 1").select("key")

    def places(batch: pa.RecordBatch) -> Iterator[dict]:
        for begin, part in _portions(batch.column("text")):
            c = contexts(units(part, kind.unit), kind, False)
            at = pa.array(c.text + begin)
            yield {
                "id": batch.column("id").take(at), "digest": batch.column("digest").take(at), "start": pa.array(c.start), "windows": pa.array(c.windows),
                "key": pa.array(c.key.view(np.int64)), "content": pa.array(c.content.view(np.int64)),
            }

    where = map_batches(texts.select("id", "digest", "text"), places, "id long, digest long, start int, windows int, key long, content long")
    found = pin(where.join(often, "key"))
    name = ["key", "content", "windows"]
    context = found.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct("id", "digest", "start")).alias("at"))
    many = context.groupBy("key").agg(F.count("*").alias("different")).where(F.col("different") > most).select(F.col("key").alias("k"))
    sole = context.groupBy("key").agg(F.count("*").alias("different"), F.max("n").alias("times"), F.min(F.struct("content", "windows")).alias("c"))
    sole = sole.where("different = 1 AND times > 1").select(F.col("key").alias("sk"), F.col("c.content").alias("sc"), F.col("c.windows").alias("sw"))
    # By content as well, as contexts are dealt out by it already.
    context = context.join(sole, (F.col("key") == F.col("sk")) & (F.col("content") == F.col("sc")) & (F.col("windows") == F.col("sw")), "left").withColumn("sole", F.col("sk").isNotNull())
    context = pin(context.drop("sk", "sc", "sw").join(many, F.col("key") == F.col("k"), "left").withColumn("hot", F.col("k").isNotNull()).drop("k"))
    decided_now = context.where("sole").select(*name, F.lit(0).alias("first"), F.col("windows").alias("number"), F.col("at.id").alias("low"))
    context = context.where("NOT sole").drop("sole")
    length = context.agg(F.sum(F.col("windows") + kind.window)).first()[0] or 0
    shards = max(LEAST_SHARDS, length * (1 if kind.unit == "byte" else 6) // SHARD_BYTES)
    wanted = context.groupBy(F.col("at.id").alias("i"), F.col("at.digest").alias("d")).agg(F.collect_list(F.struct("at.start", "windows", "key", "content", "n", "hot")).alias("parts"))
    loaded = texts.join(wanted, (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d"))).select("id", "text", "parts")

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        parts = batch.column("parts").flatten()
        column = {c: parts.field(c) for c in ("windows", "key", "content", "n", "hot")}
        end = np.cumsum(batch.column("parts").value_lengths().to_numpy())
        row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(end, prepend=0)))
        starts, windows = parts.field("start").to_numpy(), column["windows"].to_numpy()
        begin, held, size = 0, [], 0
        for k in range(batch.num_rows):
            data = (batch.column("text")[k].as_py() or "").encode("utf-8", "replace")
            own = slice(begin + len(held), end[k])
            first, last = starts[own], starts[own] + windows[own] + (kind.window - 2)
            if kind.unit == "word":
                w = tokens.words([data])
                first, last = w.start[first], w.end[last] - 1
            held.extend(data[a : b + 1] for a, b in zip(first.tolist(), last.tolist(), strict=True))
            size += int((last - first + 1).sum())
            if size > PORTION or k == batch.num_rows - 1:
                yield {c: x.slice(begin, len(held)) for c, x in column.items()} | {"id": batch.column("id").take(row.slice(begin, len(held))), "data": held}
                begin, held, size = begin + len(held), [], 0

    pieces = map_batches(loaded, cut, "id long, windows int, key long, content long, n long, hot boolean, data binary")
    any_hot = not many.isEmpty()

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(name).reset_index(drop=True)
        answers = solver(part["data"].tolist(), part["windows"].to_numpy(), part["n"].to_numpy(), part["id"].to_numpy())
        rows = [(int(k), int(c), int(w), a, m, low) for k, c, w, runs_of in zip(part["key"], part["content"], part["windows"], answers, strict=True) for a, m, low in runs_of]
        return pd.DataFrame(rows, columns=[*name, "first", "number", "low"])

    decided = "key long, content long, windows int, first int, number int, low long"
    sent = pieces.where(~F.col("hot")) if any_hot else pieces
    sent = sent.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    answers = sent.select("shard", "id", *name, "n", "data").groupBy("shard").applyInPandas(solve, decided)
    if any_hot:
        answers = answers.unionByName(by_window(pieces.where("hot"), kind))
    answers = answers.unionByName(decided_now)
    # For "earlier", what was decided for a context holds where the least id is below the document's own.
    hits = found.join(pin(answers), name)
    if relation == "earlier":
        hits = hits.where(F.col("low") < F.col("id"))
    span = F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("first") + F.col("number") + (kind.window - 1)).alias("b"))
    return hits.groupBy("id", "digest").agg(F.collect_list(span).alias("spans"))


def by_window(pieces: DataFrame, kind: Kind) -> DataFrame:
    """The same decisions for contexts of a very frequent key, by grouping their windows by content."""

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        for k in range(batch.num_rows):
            u = units([batch.column("data")[k].as_py()], kind.unit)
            m = batch.column("windows")[k].as_py()
            power, inverse = tokens.powers(len(u.hash) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(u.hash * power[:-1], dtype=np.uint64)))
            flat = (sums[kind.window : kind.window + m] - sums[:m]) * inverse[:m]
            other = tokens.windows(mix64(u.hash, 7), kind.window, seed=7)[:m]
            yield {c: [batch.column(c)[k].as_py()] * m for c in ("key", "content", "windows", "n", "id")} | {"at": list(range(m)), "h": pa.array(flat.view(np.int64)), "g": pa.array(other.view(np.int64))}

    rows = map_batches(pieces, each, "key long, content long, windows int, n long, id long, at int, h long, g long").dropDuplicates(["key", "content", "windows", "at"])
    same_window = rows.groupBy("h", "g").agg(F.sum("n").alias("total"), F.min("id").alias("low")).where("total > 1")
    return rows.join(same_window, ["h", "g"]).select("key", "content", "windows", F.col("at").alias("first"), F.lit(1).alias("number"), "low")


def merged(spans: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans in order, touching ones joined."""
    if spans is None or not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.array(sorted((x["a"], x["b"]) for x in spans), np.int64)
    reach = np.maximum.accumulate(s[:, 1])
    new = np.ones(len(s), bool)
    new[1:] = s[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return s[at, 0], np.append(reach[at[1:] - 1], reach[-1])


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) for every row of ``docs``."""
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    left = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("__i"), F.xxhash64(text).alias("__d"))
    right = spans.select(F.col("id").alias("__j"), F.col("digest").alias("__e"), "spans")
    return left.join(right, (F.col("__i") == F.col("__j")) & (F.col("__d") == F.col("__e")), "left").select("id", "text", "spans")

