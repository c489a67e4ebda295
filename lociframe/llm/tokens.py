"""Words of many texts at once, as arrays: where they are and a 64-bit hash of each.

Texts are joined to one byte array. The hash of a word is a difference of polynomial prefix sums modulo 2^64, shifted back by the inverse of the
base and mixed, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociframe.llm.util import mix64

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text looked at together; a longer text is looked at alone. Arrays of 8 bytes a byte of text are made, some of which a worker keeps.
TOGETHER = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers below n."""
    for k, base in enumerate((BASE, INVERSE)):
        have = _powers[k]
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[k] = have
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    raw: np.ndarray  # the bytes
    text_at: np.ndarray  # first byte of each text, and one more at the end (one byte lies between texts)
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words

    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[bytes]) -> Words:
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    text_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    space = np.concatenate(([True], _IS_SPACE[raw], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    value = (sums[end] - sums[start]) * inverse[start]
    return Words(raw, text_at, start, end, mix64(value), np.searchsorted(start, text_at))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``size`` hashes in a row."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n, total = len(hashes) - size + 1, np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * np.uint64(pow(BASE, k + 1 + seed, 1 << 64))
    return mix64(total, seed)


def together(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in portions of about TOGETHER bytes: the number of the first and their UTF-8."""
    begin, held, size = 0, [], 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if held and size + len(data) > TOGETHER:
            yield begin, held
            begin, held, size = k, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield begin, held


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, list | pa.Array]]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches, giving columns of ``schema`` as lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    arrays = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in want]
                    yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, want, strict=True)], names=want.names)

    return df.mapInArrow(run, schema)
