"""Stupid-backoff language-model scores of documents from the counts of their own corpus.

Documents are put in blocks. A block counts its n-grams before anything moves, and sends each different one once: (bucket, block, keys, counts), where a key is
a 64-bit hash, a bucket its leading bits, and the arrays only carry the rows of one block and bucket together. The receiving side explodes them to a row an n-gram
and block, partitioned by bucket; the count table is the sum of these rows by key, put next to them by a window over the key, so that counting and
joining back are one sort without another shuffle. A frequent n-gram has a row a block, never a row an occurrence. Totals of n-grams that are in more than one block go
back; a block knows the others itself. Scores are summed per document where its words are.

A larger corpus is counted in slices of the keys, one after the other: each slice goes through all blocks, its totals are pinned as one row a block, and its shuffle files
are gone before the next begins. So the n-grams of all orders never lie on disk together, while every one of them is counted.

For each word, S = c(n-gram)/c(context) of the longest n-gram that other documents have, times 0.4 for every order backed off, down to
(c(word)+1)/(words+1). Counts leave out the document that is scored; otherwise its own rare n-grams would look certain. The score is the mean log10 S.

Defined results: a text without words has a null score; a null id is kept; rows with equal ids are rows of their own. Counts are 64-bit throughout.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.config import parallelism, pin, shuffles_freed
from lociframe.llm.tokens import map_batches, windows, words

#: Highest order: two words of context. Keys of a higher order hardly repeat, so each adds as many rows as there are words.
ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 4 << 20
PORTION = 1 << 20
PART_BYTES = 4 << 20  # of text that a partition of the exploded n-grams stands for
SLICE_BITS = 2  # leading bits of the keys that tell slices apart, once the corpus has twice SLICE_BYTES
SLICE_BYTES = 32 << 20


def found(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The hashes of all words, and how many words each text has."""
    parts, counts, begin, size = [np.zeros(0, np.uint64)], [], 0, 0
    for k, data in enumerate(texts):  # words are found in portions, as that takes many times the bytes looked at
        size += len(data)
        if size > PORTION or k + 1 == len(texts):
            part = words(texts[begin : k + 1])
            parts.append(part.hash)
            counts += np.diff(part.first).tolist()
            begin, size = k + 1, 0
    return np.concatenate(parts), counts


def numbered(flat: np.ndarray) -> tuple[bytes, bytes]:
    """The different words, the most frequent first, and the number of each word among them, so that a block's words are found only once."""
    keys, number, n = np.unique(flat, return_inverse=True, return_counts=True)
    by = np.argsort(-n, kind="stable")
    rank = np.empty(len(by), "<u4")
    rank[by] = np.arange(len(by))
    return keys[by].tobytes(), zstandard.compress(rank[number].tobytes(), 3)


def grams(sizes: list[int], keys: bytes, numbers: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the n-gram hash that ends at each word (0 where a text begins too late), the text of each word, first words."""
    flat = np.frombuffer(keys, np.uint64)[np.frombuffer(zstandard.decompress(numbers), "<u4")]
    first = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = []
    for n in range(1, order + 1):
        full = np.zeros(len(flat), np.uint64)
        if len(flat) >= n:
            full[n - 1 :] = windows(flat, n, seed=n)
        full[(np.arange(len(full)) - first[text]) < n - 1] = 0
        out.append(full)
    return out, text, first


def counted(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and how often each occurs."""
    flat = np.concatenate(hashes)
    return np.unique(flat[flat > 0], return_counts=True)


def sliced(hashes: list[np.ndarray], number: int, bits: int) -> list[np.ndarray]:
    """Those of the hashes whose leading ``bits`` are ``number``."""
    return [h[h >> np.uint64(64 - bits) == number] for h in hashes] if bits else hashes


def bucketed(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys are in, by their leading ``bits``, and where each begins, with the end behind them."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[begin], np.append(begin, len(keys))


def ordered(flat: np.ndarray) -> np.ndarray:
    """The order that sorts the hashes, equal ones by where they are: numbers that hold a place in their last bits are sorted, much faster than places, and the few that
    only these bits tell apart are put right."""
    bits = np.uint64(len(flat).bit_length())
    near = (np.sort((flat >> bits << bits) | np.arange(len(flat), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return near[np.argsort(flat[near], kind="stable")]


def scores(hashes: list[np.ndarray], text: np.ndarray, first: np.ndarray, keys: np.ndarray, totals: np.ndarray, corpus: int, order: int) -> list[float | None]:
    """Scores from the counts of the whole corpus: ``totals`` of the sorted ``keys``, ``corpus`` words in all."""
    size = np.diff(first)
    others: list[np.ndarray] = []
    for full in hashes:
        at = ordered(full)[np.count_nonzero(full == 0) :]
        key, of = full[at], text[at]
        new = np.diff(key, prepend=np.uint64(0)) != 0
        run = np.flatnonzero(new | (np.diff(of, prepend=-1) != 0))
        own = np.diff(np.append(run, len(at)))
        every = np.zeros(len(full), np.int64)
        every[at] = totals[np.searchsorted(keys, key[new])][np.cumsum(new) - 1] - np.repeat(own, own)
        others.append(every)
    log = np.log10((others[0] + 1) / np.maximum(1, corpus - size[text] + 1)) + (order - 1) * math.log10(BACKOFF)
    for n in range(2, order + 1):
        context = np.concatenate(([0], others[n - 2][:-1]))
        good = (others[n - 1] > 0) & (context > 0)
        log[good] = np.log10(np.minimum(1.0, others[n - 1][good] / context[good])) + (order - n) * math.log10(BACKOFF)
    sums = np.bincount(text, log, minlength=len(size))
    return [float(s / n) if n else None for s, n in zip(sums, size, strict=True)]


def blocked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents, pinned: (block, ids, sizes in words, bytes, keys of the different words, numbers of the words among them)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def gather(batch: pa.RecordBatch) -> Iterator[dict]:
        held, begin, size = [], 0, 0
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        for k, text in enumerate([*texts, None]):
            if held and (text is None or size + len(text) > BLOCK_BYTES):
                flat, sizes = found(held)
                keys, numbers = numbered(flat)
                yield {
                    "block": [uuid.uuid4().int >> 65], "ids": pa.array([batch.column(0).slice(begin, len(held)).to_pylist()], pa.list_(batch.column(0).type)),
                    "sizes": [sizes], "bytes": [size], "keys": [keys], "numbers": [numbers],
                }
                held, begin, size = [], k, 0
            if text is not None:
                held.append(text)
                size += len(text)

    schema = f"block long, ids array<{kind}>, sizes array<int>, bytes long, keys binary, numbers binary"
    return pin(map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), gather, schema))


def totals(asked: DataFrame, parts: int) -> DataFrame:
    """(block, bucket, answer) from (bucket, block, keys, counts): for the keys of a block that another block has too, first their places in ``keys`` and then the sums of all
    their counts, in the same order, in the array ``answer``."""
    dealt = asked.repartition(parts, "bucket")
    rows = dealt.select("bucket", "block", "counts", F.posexplode("keys").alias("at", "key"))
    rows = rows.select("bucket", "block", "at", "key", F.get("counts", "at").cast("long").alias("n"))
    every = Window.partitionBy("key", "bucket")  # a key is in one bucket, so its rows are in one partition already
    summed = rows.withColumn("total", F.sum("n").over(every)).where("total > n")
    return summed.groupBy("block", "bucket").agg(F.concat(F.collect_list(F.col("at").cast("long")), F.collect_list("total")).alias("answer"))


def gathered(answers: DataFrame) -> DataFrame:
    """(block, buckets, sizes, totals): what ``totals`` found for a block in one row. For each of its buckets there are the totals by place up to the last one found, 0 where
    no other block has the key; those of all buckets follow each other, as compressed 64-bit numbers."""

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket").combine_chunks()
        answer = group.column("answer").combine_chunks()
        offsets = answer.offsets.to_numpy().astype(np.int64)
        n, flat = np.diff(offsets) // 2, answer.flatten().to_numpy()
        first = np.repeat(offsets[:-1] - offsets[0] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, total = flat[first], flat[first + np.repeat(n, n)]
        sizes = np.maximum.reduceat(at, np.cumsum(n) - n) + 1
        dense = np.zeros(sizes.sum(), np.int64)
        dense[np.repeat(np.cumsum(sizes) - sizes, n) + at] = total
        block, buckets = group.column("block").slice(0, 1), group.column("bucket").to_numpy()
        return pa.table({"block": block, "buckets": pa.array([buckets], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())), "totals": [zstandard.compress(dense.tobytes(), 3)]})

    return answers.groupBy("block").applyInArrow(gather, "block long, buckets array<long>, sizes array<long>, totals binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, score) for every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = blocked(docs, id_col, text_col)
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"), F.sum("bytes").alias("bytes")).first()
    bytes_in, corpus = size["bytes"] or 0, size["words"] or 0
    parts = max(parallelism(docs.sparkSession), bytes_in // PART_BYTES)
    bits = max(6, (4 * parts).bit_length())  # a few buckets a partition
    slice_bits = min(SLICE_BITS, (bytes_in // SLICE_BYTES).bit_length())

    def answered(number: int) -> DataFrame:
        def ask(batch: pa.RecordBatch) -> Iterator[dict]:
            for block, *held in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "keys", "numbers")), strict=True):
                keys, n = counted(sliced(grams(*held, order)[0], number, slice_bits))
                bucket, begin = bucketed(keys, bits)
                offsets = pa.array(begin, pa.int32())
                yield {
                    "bucket": pa.array(bucket), "block": [block] * len(bucket), "keys": pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64))),
                    "counts": pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
                }

        asked = map_batches(blocks.select("block", "sizes", "keys", "numbers"), ask, "bucket long, block long, keys array<long>, counts array<int>")
        return gathered(totals(asked, max(parallelism(docs.sparkSession), parts >> slice_bits)))

    with shuffles_freed(docs.sparkSession):
        slices = [pin(answered(k)) for k in range(1 << slice_bits)]
    answers = reduce(DataFrame.union, slices)

    def judge(group: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"id": [], "n_words": [], "score": []})
        row = group.iloc[0]
        hashes, text, first = grams(row["sizes"], row["keys"], row["numbers"], order)
        keys, n = counted(hashes)
        bucket, begin = bucketed(keys, bits)
        known = n.astype(np.int64)  # of n-grams no other block has
        for buckets, length, data in zip(answer["buckets"], answer["sizes"], answer["totals"], strict=True):
            told = np.frombuffer(zstandard.decompress(data), np.int64)
            at = np.arange(len(told)) + np.repeat(begin[np.searchsorted(bucket, buckets)] - (np.cumsum(length) - length), length)
            known[at[told > 0]] = told[told > 0]
        ids = pd.Series(list(row["ids"]), dtype="Int64" if kind in ("bigint", "int") else object)
        return pd.DataFrame({"id": ids, "n_words": np.diff(first), "score": pd.Series(scores(hashes, text, first, keys, known, corpus, order), dtype="Float64")})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(judge, f"id {kind}, n_words long, score double")
