"""Benchmark decontamination: seeds find passages, alignment scores them.

Test items are cut to segments of twice ``SEGMENT`` words that overlap by half, so any ``SEGMENT`` words of an item lie in one. Every run of ``SEED`` words of a segment is a seed, so a passage is looked at if it shares
three words in a row with an item anywhere, however often the run occurs. Where a document has a seed, the words around it
are aligned to the segment by Smith-Waterman over words, which finds copies with words changed, put in or left out. The score is the part of
the best possible score of the item, or of ``SEGMENT`` words if it is longer. A document is contaminated if a segment scores ``LEAST`` or more, or if
it shares ``RUN`` words in a row with an item; shorter quotations do not count. A copy without three unedited words in a row anywhere, such as one
with every third word changed, is not found. Items of under three words are looked for as a whole and score 1.

The benchmark is a query set. It is taken in blocks of ``BLOCK_WORDS`` words, each broadcast and held against all documents; the results do not
depend on the blocks. Documents are not shuffled.

Words are compared in lower case without ASCII punctuation. Defined results: a null text has no words; an item without words is
not searched for; rows of ``docs`` keep their number whatever their ids are; without items nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.tokens import together, windows, words

SEED = 3  # words a seed
SEGMENT = 200
LEAST = 0.5
RUN = 13  # verbatim words that count whatever the length of the item
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1 << 20
PAIRS = 256  # alignments done together
_PLAIN = bytes(ord(" ") if c < 128 and not chr(c).isalnum() else c for c in range(256))


def plain(texts: list[bytes]):
    return words([t.translate(_PLAIN) for t in texts])


def lowered(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


@dataclass
class Items:
    """A block of the benchmark: the words of its segments, and the places of the seeds looked for."""

    ids: list[int | None] = field(default_factory=list)
    segments: list[np.ndarray] = field(default_factory=list)
    seeds: np.ndarray | None = None  # sorted, repeated if at several places
    where: np.ndarray | None = None  # segment and position of each
    sieve: np.ndarray | None = None
    short: dict[int, dict[int, list[int]]] = field(default_factory=dict)  # segments of under SEED words by size and hash

    def index(self) -> None:
        """Take every run of SEED words as a seed, and shorter segments as a whole."""
        for k, s in enumerate(self.segments):
            if len(s) < SEED:
                self.short.setdefault(len(s), {}).setdefault(int(windows(s, len(s))[0]), []).append(k)
        found = [windows(s, SEED) for s in self.segments]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        place = np.array([(k, p) for k, f in enumerate(found) for p in range(len(f))], np.int64).reshape(-1, 2)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.where = flat[order], place[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``runs`` that hold a seed, and the first such place among the seeds."""
        maybe = np.flatnonzero(self.sieve[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.seeds, runs[maybe])
        good = at < len(self.seeds)
        good[good] = self.seeds[at[good]] == runs[maybe[good]]
        return maybe[good], at[good]


def align(segments: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, as a part of the segment, or of SEGMENT words of it, aligned to itself."""
    out = np.zeros(len(segments))
    order = sorted(range(len(segments)), key=lambda k: (len(segments[k]), len(passages[k])))
    for begin in range(0, len(order), PAIRS):
        part = order[begin : begin + PAIRS]
        rows, cols = max(len(segments[k]) for k in part), max(len(passages[k]) for k in part)
        # Padding never matches: 0 in segments, 1 in passages; real hashes have the lowest bits set to 2.
        a, b = np.zeros((len(part), rows), np.uint64), np.ones((len(part), cols), np.uint64)
        for r, k in enumerate(part):
            a[r, : len(segments[k])] = segments[k] | np.uint64(2)
            b[r, : len(passages[k])] = passages[k] | np.uint64(2)
        slope = -GAP * np.arange(cols + 1)
        above, best = np.zeros((len(part), cols + 1), np.int32), np.zeros(len(part), np.int32)
        for i in range(rows):
            score = np.where(b == a[:, i : i + 1], MATCH, MISMATCH)
            now = np.maximum(0, above + GAP)
            now[:, 1:] = np.maximum(now[:, 1:], above[:, :-1] + score)
            now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the row
            above = now.astype(np.int32)
            best = np.maximum(best, above.max(axis=1))
        for r, k in enumerate(part):
            out[k] = best[r] / (MATCH * max(1, min(len(segments[k]), SEGMENT)))
    return np.minimum(out, 1.0)


def matches(items: Items, texts: list[bytes]) -> Iterator[tuple[int, int, float, int]]:
    """(text, segment of the block, score, longest verbatim run) for every passage found, the best of a text and segment."""
    found = plain(texts)
    for n, short in items.short.items():
        runs = windows(found.hash, n)
        at = np.flatnonzero(np.isin(runs, np.array(list(short), np.uint64)))
        text = np.searchsorted(found.first, at, side="right") - 1
        whole = at + n <= found.first[text + 1]
        for t, value in set(zip(text[whole].tolist(), runs[at[whole]].tolist(), strict=True)):
            for segment in short[value]:
                yield t, segment, 1.0, n
    at, seed = items.hits(windows(found.hash, SEED))
    text = np.searchsorted(found.first, at, side="right") - 1
    whole = at + SEED <= found.first[text + 1]
    at, seed, text = at[whole], seed[whole], text[whole]
    near: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, s, t in zip(at.tolist(), seed.tolist(), text.tolist(), strict=True):
        value, k = items.seeds[s], s
        while k < len(items.seeds) and items.seeds[k] == value:
            segment, position = items.where[k]
            near.setdefault((t, int(segment)), []).append((a - int(position), a))
            k += 1
    keys, segments, passages, verbatim = [], [], [], {}
    for (t, segment), places in near.items():
        places.sort()
        length = longest = 1
        for (begin, a), (next_begin, next_a) in zip(places, places[1:], strict=False):
            length = length + 1 if begin == next_begin and next_a == a + 1 else 1
            longest = max(longest, length)
        verbatim[t, segment] = longest + SEED - 1
        length = len(items.segments[segment])
        slack, low, high = length // 2 + 4, None, None
        for begin in [*(begin for begin, _ in places), None]:
            if low is not None and (begin is None or begin - high > slack):
                keys.append((t, segment))
                segments.append(items.segments[segment])
                passages.append(found.hash[max(found.first[t], low - slack) : min(found.first[t + 1], high + length + slack)])
                low = None
            if begin is not None:
                low, high = (begin if low is None else low), begin
    best: dict[tuple[int, int], float] = {}
    for (t, segment), score in zip(keys, align(segments, passages), strict=True):
        best[t, segment] = max(best.get((t, segment), 0.0), float(score))
    for (t, segment), score in best.items():
        yield t, segment, score, verbatim[t, segment]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    block, size = Items(), 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        flat = plain([row[1].lower().encode("utf-8", "replace")]).hash
        for k in range(0, max(1, len(flat) - SEGMENT) if len(flat) else 0, SEGMENT):
            block.ids.append(row[0])
            block.segments.append(flat[k : k + 2 * SEGMENT])
            size += SEGMENT
        if size >= BLOCK_WORDS:
            yield block
            block, size = Items(), 0
    if block.segments:
        yield block


FOUND = "array<struct<item: bigint, score: double, run: int>>"


def found_in(text: Column, items) -> Column:
    """Items of a broadcast block that a text holds passages of, each with its best score and longest verbatim run."""

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            for begin, texts in together(lowered(batch.tolist())):
                best: dict[tuple[int, int | None], tuple[float, int]] = {}
                for t, segment, score, run in matches(items.value, texts):
                    key = t, items.value.ids[segment]
                    top, longest = best.get(key, (0.0, 0))
                    best[key] = max(top, score), max(longest, run)
                for (t, item), (score, run) in best.items():
                    out[begin + t].append({"item": item, "score": score, "run": run})
            yield pd.Series(out)

    return search(text)


def scored(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with contaminated, item (the best match, those that count first, the least id of ties), item_score and items, how many items count."""
    context, columns = docs.sparkSession.sparkContext, []
    for block in blocks(benchmark, item_col, item_text):
        block.index()
        columns.append(found_in(F.col(text_col).cast("string"), context.broadcast(block)))
    every = F.concat(*columns) if columns else F.array().cast(FOUND)
    found = docs.withColumn("__found", every)
    counts = lambda x: (x["score"] >= least) | (x["run"] >= RUN)
    hit = F.filter("__found", counts)
    best = F.array_max(F.transform("__found", lambda x: F.struct(counts(x).alias("counts"), x["score"].alias("score"), (-x["item"]).alias("item"))))
    return (
        found.withColumn("contaminated", F.size(hit) > 0).withColumn("item", -best["item"]).withColumn("item_score", F.coalesce(best["score"], F.lit(0.0)))
        .withColumn("items", F.size(F.array_distinct(F.transform(hit, lambda x: x["item"])))).drop("__found")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a passage of the benchmark, with the columns of ``docs``."""
    marked = scored(docs.select(*docs.columns, F.col(text_col).alias("__text")), benchmark, "__text")
    return marked.where(~F.col("contaminated")).select(*docs.columns)
