"""Substring dedup of word sequences through compressed FM-indexes.

Each shard (see ``anchors``) keeps the different contexts of its keys as an FM-index: the Burrows-Wheeler transform of their words in a
wavelet matrix of packed bits with ranks at every 64. The words of the streamed contexts are searched backward, all contexts of a shard in step. The matching
statistic grows by a word a step up to the threshold; beyond, the interval is widened to the one of the window less its last word before the next step. An
interval at the threshold has all occurrences of a window, and so the least document it starts in.

A word goes if a window of ``LENGTH`` words that covers it also starts in a document with a smaller id.

Defined results: a null text has no words; a document of under LENGTH words keeps all; a null id comes after all others; rows that agree in
id are no smaller than one another, so they keep or lose words alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociframe.llm import anchors, tokens
from lociframe.llm.suffix import common_prefixes, joined, sorted_suffixes
from lociframe.llm.tokens import map_batches

LENGTH, GRAM = 50, 10


class Wavelet:
    """Ranks of symbols in a sequence, a bit of the symbols a level, most significant first."""

    def __init__(self, x: np.ndarray):
        self.levels = max(1, int(x.max()).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, bit.dtype))).astype(np.uint8), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])))
            self.zeros.append(int((bit == 0).sum()))
            x = np.concatenate((x[bit == 0], x[bit == 1]))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place goes on the way of a symbol to the last level."""
        for k, (words, ranks, zeros) in enumerate(zip(self.words, self.ranks, self.zeros, strict=True)):
            w = at >> 6
            ones = ranks[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    def __init__(self, s: np.ndarray, sa: np.ndarray):
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s))))[:-1]
        self.wavelet = Wavelet(s[sa - 1])
        self.base = self.wavelet.down(np.arange(len(self.first)), np.zeros(len(self.first), np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the strings with a symbol put before them."""
        shift = self.first[symbol] - self.base[symbol]
        both = self.wavelet.down(np.concatenate((symbol, symbol)), np.concatenate((low, high)))  # half the calls
        return shift + both[: len(low)], shift + both[len(low) :]


def stretches(value: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs, ``length`` words at least, of words that each occur elsewhere in the shard; ``first`` are the starts of its contexts and the end.

    A window over a word that occurs once has no other occurrence, so it need not be searched for.
    """
    good = (np.bincount(value)[value] > 1).astype(np.int8)
    begins = np.zeros(len(value) + 1, bool)
    begins[first] = True
    edge = np.diff(good, prepend=0, append=0)
    starts = np.flatnonzero((edge[:-1] > 0) | ((good > 0) & begins[:-1]))
    ends = np.flatnonzero((edge[1:] < 0) | ((good > 0) & begins[1:])) + 1
    long = ends - starts >= length
    return starts[long], ends[long]


def least_documents(data: list[bytes], windows: np.ndarray, n: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """For each context, runs of windows with the same least document of any occurrence."""
    found = tokens.words(data)
    value = np.unique(found.hash, return_inverse=True)[1]
    flat = np.repeat(ids.astype(np.int64), windows)  # a window that occurs once has its own
    offset = np.concatenate(([0], np.cumsum(windows)))[:-1]
    starts, ends = stretches(value, found.first, length)
    if len(starts):
        context = np.searchsorted(found.first, starts, side="right") - 1
        # Words are numbered anew, without those left out.
        inside = np.zeros(len(value) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        kept = np.cumsum(inside[:-1]) > 0
        value[kept] = np.unique(value[kept], return_inverse=True)[1]
        lowest = _search([value[a:b] for a, b in zip(starts, ends, strict=True)], ids[context], length)
        count = ends - starts - length + 1
        at = np.repeat(offset[context] + starts - found.first[context], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        flat[at] = lowest
    out = []
    for values in np.split(flat, offset[1:]):
        new = np.flatnonzero(np.diff(values, prepend=values[0] - 1 if values[0] > -(1 << 62) else values[0] + 1))
        out.append([(int(x), int(y - x), int(values[x])) for x, y in zip(new, np.append(new[1:], len(values)), strict=True)])
    return out


def _search(texts: list[np.ndarray], ids: np.ndarray, length: int) -> np.ndarray:
    """For every window of the texts, one text after the other, the least document any occurrence is in."""
    s, begin = joined(texts)
    sa = sorted_suffixes(s)
    index = FMIndex(s, sa)
    prefix = common_prefixes(s, sa)[sa]
    at = np.arange(len(s))
    # Intervals of suffixes that share length - 1 words, and those that share length.
    low_of = np.maximum.accumulate(np.where(prefix < length - 1, at, 0))
    high_of = np.append(np.minimum.accumulate(np.where(prefix < length - 1, at, len(s))[::-1])[::-1][1:], len(s))
    owner = np.searchsorted(begin, sa, side="right") - 1
    cut = np.flatnonzero(prefix < length)
    lowest = np.repeat(np.minimum.reduceat(ids[owner], cut), np.diff(np.append(cut, len(s))))
    size = np.array([len(t) for t in texts])
    low, high = np.zeros(len(texts), np.int64), np.full(len(texts), len(s), np.int64)
    offset = np.cumsum(size - length + 1) - (size - length + 1)
    flat = np.zeros(int((size - length + 1).sum()), np.int64)
    live = np.argsort(-size, kind="stable")
    for step in range(int(size.max(initial=0))):
        live = live[: np.searchsorted(-size[live], -step, side="left")]  # those longer than the steps done
        a, b = low[live], high[live]
        if step >= length:
            a, b = low_of[a], high_of[a]
        a, b = index.extend(s[begin[live] + size[live] - 1 - step], a, b)
        low[live], high[live] = a, b
        if step >= length - 1:
            flat[offset[live] + size[live] - 1 - step] = lowest[a]
    return flat


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = anchors.MOST_CONTEXTS) -> DataFrame:
    """A row per row of ``docs``: id, n_words, n_removed, spans (removed words), kept_sha256, kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = anchors.repeats(docs, anchors.Kind("word", LENGTH, GRAM), least_documents, "earlier", id_col, text_col, most)

    def remove(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            items = data.split()
            a, b = anchors.merged(found)
            cuts = np.concatenate(([0], np.stack([a, b], axis=1).ravel(), [len(items)])).astype(int)
            left = [w for x, y in zip(cuts[::2], cuts[1::2], strict=True) for w in items[x:y]]
            kept = b" ".join(left)
            rows.append((len(items), len(items) - len(left), [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)], hashlib.sha256(kept).hexdigest(), kept))
        size, gone, where, digest, kept = zip(*rows, strict=True)
        yield {"id": batch.column("id"), "n_words": size, "n_removed": gone, "spans": where, "kept_sha256": digest, "kept": kept}

    schema = f"id {kind}, n_words long, n_removed long, spans array<struct<a: bigint, b: bigint>>, kept_sha256 string, kept binary"
    return map_batches(anchors.with_spans(docs, spans, id_col, text_col), remove, schema)
