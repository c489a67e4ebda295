"""Exact dedup against an index of digests seen before.

The index holds every distinct digest of the history in buckets of a few thousand. Each bucket has a minimal perfect hash:
a key's slot is its rank among the bits that were hit once, level by level. Slots hold the full 32-byte digest, the winner (its id
and length) and the number of rows, so a lookup reads one slot and compares all bytes. Rows that are no members are grouped
among themselves.

Defined results: a null text counts as empty; a null id loses every tie; rows that agree in id and text are all kept by
``groups`` (they carry the winner's id) and once by ``keep_first``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.config import pin
from lociframe.llm.util import SPACE, mix64, same, text_of

PER_BUCKET = 4096  # digests a bucket holds on average at most
LEAST_BUCKETS = 64
LEVELS = 48

INDEX = "bucket int, n int, sizes array<int>, bits binary, rest binary, digests binary, ids binary, no_id binary, lengths binary, rows binary"


def digest_of(text: str) -> Column:
    """SHA-256 of the text without white space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), SPACE + "+", "").cast("binary"), 256))


class PerfectHash:
    """Slots 0..n-1 for n distinct 32-byte keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: bytes):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.rank = np.concatenate(([0], np.cumsum(bits))) if len(bits) else np.zeros(1, np.int64)

    @staticmethod
    def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix64(words[:, 0], level) ^ mix64(words[:, 1], level + 101) ^ mix64(words[:, 2] ^ words[:, 3], level + 211)
        return (mix64(h) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: (n, 32) bytes. Half of the keys left fall alone into one of two places each, so a few levels do;
        whatever is left after all levels is listed."""
        words, sizes, parts = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 4), [], []
        left = np.arange(len(words))
        while len(left) and len(sizes) < LEVELS:
            size = max(8, 2 * len(left))
            at = cls.place(words[left], len(sizes), size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(once)
            left = left[~once[at]]
        bits = np.concatenate(parts) if parts else np.zeros(0, bool)
        return cls(sizes, bits, keys[left].tobytes())

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; -1 where no level has a bit and the key is not listed. Keys outside the set get any slot."""
        words = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 4)
        out, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.place(words[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        listed = {self.rest[i : i + 32]: int(self.rank[-1]) + i // 32 for i in range(0, len(self.rest), 32)}
        for i in left if listed else ():
            out[i] = listed.get(keys[i].tobytes(), -1)
        return out


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: its winner and its number of rows. ``rows``: id, length, digest."""
    best = F.min(F.struct((-F.col("length")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("rows")).select(
        "digest", F.col("best.id").alias("id"), (-F.col("best.neg")).alias("length"), "rows"
    )


def with_bucket(groups: DataFrame, buckets: int) -> DataFrame:
    first = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    return groups.withColumn("bucket", F.pmod(first, F.lit(buckets)).cast("int"))


def build_index(groups: DataFrame) -> DataFrame:
    """The index: one row per bucket. ``groups``: bucket, digest, id, length, rows, with distinct digests."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(part["digest"])
        mph = PerfectHash.build(keys)
        order = np.argsort(mph.slots(keys))
        ids = part["id"].iloc[order]
        row = {
            "bucket": part["bucket"].iloc[0], "n": len(part), "sizes": mph.sizes, "bits": np.packbits(mph.bits).tobytes(), "rest": mph.rest,
            "digests": keys[order].tobytes(), "ids": ids.fillna(0).astype("int64").to_numpy().tobytes(), "no_id": ids.isna().to_numpy().tobytes(),
            "lengths": part["length"].iloc[order].astype("int64").to_numpy().tobytes(), "rows": part["rows"].iloc[order].astype("int64").to_numpy().tobytes(),
        }
        return pd.DataFrame([row])

    return groups.groupBy("bucket").applyInPandas(build, INDEX)


FOUND = "digest binary, id long, length long, rows long, was_id long, was_length long, was_rows long, member boolean"


def lookup(groups: DataFrame, index: DataFrame) -> DataFrame:
    """Every group of new rows with the slot it hits, and every slot that no group hit.

    Byte-checked: a group is a member only if all 32 bytes of the slot's digest agree.
    """

    def look(index_part: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = part[["digest", "id", "length", "rows"]].reset_index(drop=True)
        n = int(index_part["n"].iloc[0]) if len(index_part) else 0
        row = index_part.iloc[0] if n else None
        member, slot = np.zeros(len(out), bool), np.zeros(len(out), np.int64)
        if n:
            held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            ids = pd.Series(np.frombuffer(row["ids"], np.int64)).astype("Int64").mask(np.frombuffer(row["no_id"], bool))
            lengths, counts = (pd.Series(np.frombuffer(row[c], np.int64)) for c in ("lengths", "rows"))
            if len(out):
                size = int(sum(row["sizes"]))
                bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:size].astype(bool)
                keys = _keys(out["digest"])
                slot = PerfectHash(list(row["sizes"]), bits, row["rest"]).slots(keys)
                member = (slot >= 0) & (held[slot] == keys).all(axis=1)
        out["id"] = out["id"].astype("Int64")
        for name, values in (("was_id", ids), ("was_length", lengths), ("was_rows", counts)) if n else ():
            out[name] = values.astype("Int64").iloc[np.where(member, slot, 0)].mask(~member, pd.NA).to_numpy()
        if not n:
            out[["was_id", "was_length", "was_rows"]] = pd.NA
        out["member"] = member
        if n:
            rest = np.setdiff1d(np.arange(n), slot[member])
            alone = pd.DataFrame({
                "digest": [held[i].tobytes() for i in rest], "id": pd.NA, "length": pd.NA, "rows": 0, "was_id": ids.iloc[rest].to_numpy(),
                "was_length": lengths.iloc[rest].to_numpy(), "was_rows": counts.iloc[rest].to_numpy(), "member": True,
            })
            out = pd.concat([out.astype(object), alone.astype(object)]) if len(out) else alone
        for name in ("id", "length", "rows", "was_id", "was_length", "was_rows"):
            out[name] = out[name].astype("Int64")
        return out

    return index.groupBy("bucket").cogroup(groups.groupBy("bucket")).applyInPandas(look, FOUND)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: Column | None = None) -> DataFrame:
    """A row per row of ``docs``: id, keep_id, group_size, kept, digest, length.

    ``history`` tells which rows were there before (default: half of the rows, by a hash of the id); the others are looked up.
    Of equal texts the longest original stays, then the smallest id.
    """
    was = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0 if history is None else F.coalesce(history, F.lit(False))
    rows = pin(docs.select(F.col(id_col).alias("id"), F.length(text_of(text_col)).cast("long").alias("length"), digest_of(text_col).alias("digest"), was.alias("was")))
    sides = grouped(rows.where("was")), grouped(rows.where(~F.col("was")))
    buckets = max(LEAST_BUCKETS, math.ceil(rows.count() / PER_BUCKET))
    found = lookup(with_bucket(sides[1], buckets), build_index(with_bucket(sides[0], buckets)))
    rank = lambda p: F.when(F.col(f"{p}length").isNotNull(), F.struct(F.col(f"{p}length").alias("n"), F.col(f"{p}id").isNotNull().alias("has"), (-F.col(f"{p}id")).alias("id")))
    best = F.greatest(rank(""), rank("was_"))
    merged = found.select(
        F.col("digest").alias("group_digest"), (-best["id"]).alias("keep_id"), (F.col("rows") + F.coalesce("was_rows", F.lit(0))).alias("group_size")
    )
    return rows.join(merged, F.col("digest") == F.col("group_digest"), "left").select(
        "id", "keep_id", "group_size", same(F.col("id"), F.col("keep_id")).alias("kept"), "digest", "length"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; rows that agree in id and text stay once."""
    kept = groups(docs, id_col, text_col).where("kept").select(F.col("id").alias("__id"), F.col("digest").alias("__d")).distinct()
    marked = docs.withColumn("__digest", digest_of(text_col))
    out = marked.join(kept, same(F.col(id_col), F.col("__id")) & (F.col("__digest") == F.col("__d")), "left_semi")
    return out.dropDuplicates([id_col, "__digest"]).drop("__digest")


def decoded(index: DataFrame) -> Iterator[dict]:
    """The slots of an index, for a look at small ones."""
    for row in index.toLocalIterator():
        for i in range(row["n"]):
            yield {"digest": row["digests"][32 * i : 32 * i + 32].hex(), "id": int(np.frombuffer(row["ids"], np.int64)[i]), "rows": int(np.frombuffer(row["rows"], np.int64)[i])}
