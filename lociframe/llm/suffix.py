"""Suffix arrays by induced sorting, permuted common prefixes, and dedup of long byte strings by them.

A suffix is smaller (S) or larger (L) than the next one. Leftmost smaller suffixes cut a string to substrings; these are sorted by inducing, named by
rank, and the string of names is sorted the same way, recursively. From the sorted leftmost smaller suffixes, two linear passes over the buckets of first
symbols induce the whole array. The passes move whole stretches of a bucket at once, which pays while symbols
are few; the recursion ends at a string with a new name every few places, whose suffixes are sorted by doubling.

Dedup: a byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Shards hold the different contexts of their keys
(see ``anchors``), of which only stretches whose grams all occur more than once are sorted; a window repeats if its suffix has a neighbour in the shard's array with a common prefix of ``LENGTH``, or if its context has more
than one occurrence.

Defined results: a null text is empty; a text of under LENGTH bytes keeps all; rows with equal text count as occurrences of their own, so
all their bytes go if they are long enough; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociframe.llm import anchors, tokens
from lociframe.llm.tokens import map_batches
from lociframe.llm.util import runs

LENGTH, GRAM = 200, 32
FEW = 64  # symbols are few if there are so many suffixes for each; else the recursion ends


def smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last one is."""
    step = np.sign(np.diff(s.astype(np.int64)))
    decided = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return np.append(np.append(step, 1)[following] > 0, True)


def _append(sa: np.ndarray, s: np.ndarray, edge: np.ndarray, items: np.ndarray, down: bool) -> None:
    """Put items, in order, at the edges of the buckets of their symbols."""
    symbol = s[items]
    narrow = np.uint8 if len(edge) <= 1 << 8 else np.uint16 if len(edge) < 1 << 16 else np.int64
    order = np.argsort(symbol.astype(narrow, copy=False), kind="stable")  # by radix, as symbols are few
    items, symbol = items[order], symbol[order]
    new = np.append(0, np.flatnonzero(symbol[1:] != symbol[:-1]) + 1)
    count = np.diff(np.append(new, len(symbol)))
    within = np.arange(len(symbol)) - np.repeat(new, count)
    sa[edge[symbol] - 1 - within if down else edge[symbol] + within] = items
    edge[symbol[new]] += -count if down else count


def _induce(s: np.ndarray, is_s: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The array from the leftmost smaller suffixes in the order ``seeds``, bucket by bucket."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    tail = ends.copy()
    _append(sa, s, tail, seeds[::-1], True)
    head = starts.copy()
    used = np.flatnonzero(ends > starts)
    for c in used:
        done = starts[c]
        while done < head[c]:
            part, done = sa[done : head[c]] - 1, head[c]
            part = part[part >= 0]
            part = part[~is_s[part]]
            if len(part):
                _append(sa, s, head, part, False)
        part = sa[tail[c] : ends[c]] - 1
        part = part[part >= 0]
        part = part[~is_s[part]]
        if len(part):
            _append(sa, s, head, part, False)
    tail = ends.copy()
    for c in used[::-1]:
        done = ends[c]
        while done > tail[c]:
            part, done = sa[tail[c] : done][::-1] - 1, tail[c]
            part = part[part >= 0]
            part = part[is_s[part]]
            if len(part):
                _append(sa, s, tail, part, True)
        part = sa[starts[c] : head[c]][::-1] - 1
        part = part[part >= 0]
        part = part[is_s[part]]
        if len(part):
            _append(sa, s, tail, part, True)
    return sa


def sorted_suffixes(s: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the sorted length; for strings of many symbols."""
    rank, size = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(len(s), np.int64)
        after[: len(s) - size] = rank[size:] + 1
        both = rank * (len(s) + 1) + after
        sa = np.argsort(both)
        step = np.diff(both[sa], prepend=both[sa[0]]) != 0
        rank = np.empty(len(s), np.int64)
        rank[sa] = np.cumsum(step)
        if rank[sa[-1]] == len(s) - 1:
            return sa
        size *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers whose last is 0 and the only 0."""
    n, symbols = len(s), int(s.max()) + 1
    if symbols * FEW > n:
        return sorted_suffixes(s)
    is_s = smaller(s)
    ends = np.cumsum(np.bincount(s, minlength=symbols))
    left = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    ranked = _induce(s, is_s, ends, left)
    chosen = np.zeros(n, bool)
    chosen[left] = True
    ranked = ranked[chosen[ranked]]
    # Names: a substring reaches to the next leftmost smaller suffix, inclusive.
    length = np.zeros(n, np.int64)
    length[left] = np.append(np.diff(left), 0) + 1
    a, b = ranked[:-1], ranked[1:]
    equal = length[a] == length[b]
    live, k = np.flatnonzero(equal), 0
    while len(live):
        live = live[length[a[live]] > k]
        differ = s[a[live] + k] != s[b[live] + k]
        equal[live[differ]] = False
        live, k = live[~differ], k + 1
    name = np.zeros(n, np.int64)
    name[ranked] = np.concatenate(([0], np.cumsum(~equal)))
    names = name[left]
    if len(left) == (~equal).sum() + 1:
        order = ranked
    else:
        order = left[suffix_array(names)]
    return _induce(s, is_s, ends, order)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, by position, the common prefix with the suffix before it in the array.

    Where the symbols before two neighbours are equal, the value is one less than that of the position before; only the others are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    known = (at > 0) & (before > 0)
    known[known] = s[at[known] - 1] == s[before[known] - 1]
    known &= np.concatenate(([False], before[:-1] >= 0))
    top = s.max()
    width = 8 if top < 1 << 8 else 4 if top < 1 << 16 else 2
    bits = 64 // width
    word, size = np.concatenate((s, np.zeros(width, s.dtype))).astype(np.uint64), 1
    while size < width:
        word, size = word[:-size] | (word[size:] << np.uint64(bits * size)), size * 2
    i = np.flatnonzero(~known & (before >= 0))
    j, value = before[i], np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x, y = i[live] + value[live], j[live] + value[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        differ = word[x] ^ word[y]
        go = differ == 0
        value[live[go]] += width
        # The symbols before the first one that differs.
        low = differ[~go]
        value[live[~go]] += np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // bits
        live = live[go]
    # A known value is that of the last compared position, less the steps since.
    full = np.zeros(n, np.int64)
    full[i] = np.minimum(value, n - np.maximum(i, j))
    last = np.maximum.accumulate(np.where(known, 0, at))
    return np.maximum(0, full[last] - (at - last))


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Parts with a 1 after each and a 0 at the end, symbols from 2 on; where each begins."""
    begin = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))[:-1].astype(np.int64)
    symbol = np.uint16 if all(p.dtype == np.uint8 for p in parts) else np.int64
    s = np.ones(int(sum(len(p) + 1 for p in parts)) + 1, symbol)
    for b, p in zip(begin, parts, strict=True):
        s[b : b + len(p)] = p.astype(symbol) + 2
    s[-1] = 0
    return s, begin


def may_repeat(s: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """True where a window starts all of whose grams occur more than once in the shard, by the top bits of their hashes.

    Any other window has no equal, so it need not be sorted.
    """
    gram = min(GRAM, length)
    if len(s) < length:
        return np.zeros(len(s), bool)
    power, inverse = tokens.powers(len(s) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s * power[: len(s)], dtype=np.uint64)))
    value = (sums[gram:] - sums[:-gram]) * inverse[: len(s) + 1 - gram]
    slot = (value >> np.uint64(63 - len(s).bit_length())).view(np.int64)
    often = np.bincount(slot)[slot] > 1
    # No gram reaches over the end of a context.
    ends = np.append(begin[1:], len(s) - 1) - 1
    over = ends[:, None] - np.arange(gram)
    often[over[(over >= 0) & (over < len(often))]] = False
    often[len(s) - gram :] = False
    first, last = runs(often)
    last = last - (length - gram)
    long = last > first
    return spread(first[long], last[long], len(s))


def spread(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """True from each first place up to its last, which is not included."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_windows(data: list[bytes], windows: np.ndarray, n: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs of repeated windows in each context of a shard."""
    s, begin = joined([np.frombuffer(d, np.uint8) for d in data])
    may = may_repeat(s, begin, length)
    flag = np.zeros(len(s), bool)
    if may.any():
        # What is left are the stretches under these windows, each with the place after it as its end.
        first, last = runs(may)
        kept = spread(first, last + length - 1, len(s))
        ends = np.flatnonzero(kept[:-1] & ~kept[1:]) + 1
        s[ends] = 1
        kept[ends] = kept[-1] = True
        place = np.flatnonzero(kept)
        s = s[place]
        used = np.bincount(s) > 0
        if used.sum() <= 1 << 8:  # numbered anew, in order
            s = (np.cumsum(used) - 1).astype(np.uint8)[s]
        sa = suffix_array(s)
        prefix = common_prefixes(s, sa)[sa]
        deep = prefix >= length
        flag[place[sa]] = deep | np.append(deep[1:], False)
        flag &= may  # places whose next bytes reach into another stretch are no windows
    often = np.asarray(n) > 1
    flag |= spread(begin[often], (begin + windows)[often], len(flag))
    first, last = runs(flag)
    owner = np.searchsorted(begin, first, side="right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in data]
    for k, x, y in zip(owner.tolist(), (first - begin[owner]).tolist(), (last - first).tolist(), strict=True):
        out[k].append((x, y, 0))
    return out


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = anchors.MOST_CONTEXTS) -> DataFrame:
    """A row per row of ``docs``: id, n_bytes, n_removed, n_spans, spans (removed bytes), kept_sha256, kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = anchors.repeats(docs, anchors.Kind("byte", LENGTH, GRAM), repeated_windows, "anywhere", id_col, text_col, most)

    def remove(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            a, b = anchors.merged(found)
            cuts = np.concatenate(([0], np.stack([a, b], axis=1).ravel(), [len(data)])).astype(int)
            kept = b"".join(data[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
            rows.append((len(data), len(data) - len(kept), [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)], hashlib.sha256(kept).hexdigest(), kept))
        size, gone, where, digest, kept = zip(*rows, strict=True)
        yield {"id": batch.column("id"), "n_bytes": size, "n_removed": gone, "n_spans": [len(w) for w in where], "spans": where, "kept_sha256": digest, "kept": kept}

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<a: bigint, b: bigint>>, kept_sha256 string, kept binary"
    return map_batches(anchors.with_spans(docs, spans, id_col, text_col), remove, schema)
