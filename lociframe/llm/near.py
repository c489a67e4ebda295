"""N-gram Jaccard join through banded MinHash signatures.

A document is the set of its runs of five words (a shorter one is a single run). Documents with equal sets are one node. A node has a label
of ``LEVELS`` MinHash values in each of ``TREES`` bands. Two nodes meet in a band if their labels agree on a prefix of ``depth()`` values, the
same for all nodes: the longest at which a pair at the threshold meets somewhere with the target probability. Nodes that meet
form clusters, within which all pairs are verified on the exact sets. A cluster beyond ``BLOCK`` nodes is verified block against
block in many tasks, so no task holds it and pairs are never rows; only links a node and the components come out.

Defined results: a text without words is alone; copies share node, class and number of links; the class is the least id
of its documents, null if they all have none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.config import pin
from lociframe.llm.graph import components
from lociframe.llm.tokens import map_batches, together, windows, words
from lociframe.llm.util import mix64, same

WORDS, LEAST = 5, (4, 5)  # words a run; least similarity as a fraction
TREES, LEVELS, RECALL = 24, 7, 0.999
BLOCK = 512
BUNDLE = 256  # nodes of small clusters verified by one call


def depth(recall: float = RECALL, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix at which a pair of the least similarity meets in some trie with probability ``recall``."""
    s = LEAST[0] / LEAST[1]
    for d in range(levels, 1, -1):
        if 1 - (1 - s**d) ** trees >= recall:
            return d
    return 1


def sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct runs of each text, hashed and sorted."""
    found = words(texts)
    every = windows(found.hash, WORDS)
    for a, b in zip(found.first, found.first[1:], strict=False):
        if b - a >= WORDS:
            yield np.unique(every[a : b - WORDS + 1])
        elif b > a:
            yield windows(found.hash[a:b], int(b - a), seed=int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def name_of(items: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return mix64(items, 1).sum(dtype=np.uint64).tobytes() + mix64(items, 2).sum(dtype=np.uint64).tobytes()


def labels(parts: list[np.ndarray]) -> list[bytes]:
    """MinHash labels of non-empty sets: TREES x LEVELS values of 16 bits, tree by tree, sortable as bytes."""
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1]
    flat = np.concatenate(parts)
    out, room = np.empty((len(parts), TREES * LEVELS), ">u2"), np.empty_like(flat)
    for k in range(TREES * LEVELS):
        np.multiply(flat, np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)), out=room)
        np.bitwise_xor(room, room >> np.uint64(29), out=room)
        np.multiply(room, np.uint64(0x9FB21C651E98DF25), out=room)
        out[:, k] = (mix64(np.minimum.reduceat(room, at), k) & np.uint64(0xFFFF)).astype(np.uint16)
    return [row.tobytes() for row in out]


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, label) a row; node and label are null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batch: pa.RecordBatch) -> Iterator[dict]:
        for begin, texts in together(batch.column(1).to_pylist()):
            parts = list(sets(texts))
            full = [p for p in parts if len(p)]
            made = iter(labels(full)) if full else iter(())
            yield {
                "id": batch.column(0).slice(begin, len(texts)), "node": [name_of(p) if len(p) else None for p in parts],
                "label": [next(made) if len(p) else None for p in parts],
            }

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sign, f"id {kind}, node binary, label binary")


def verify(nodes: list[bytes], parts: list[np.ndarray], block: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links and component of each node, over the pairs within a block (``inside``) or between block 0 and block 1."""
    n = len(nodes)
    size = np.array([len(p) for p in parts])
    flat, owner = np.concatenate(parts), np.repeat(np.arange(n), size)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    bits = np.zeros((n, max(1, -(-int(column[-1] + 1) // 64)) * 8), np.uint8)
    row, col = owner[shared], column[at[shared]]
    np.bitwise_or.at(bits, (row, col >> 3), np.left_shift(1, col & 7).astype(np.uint8))
    bits = bits.view(np.uint64)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for i in range(n):
        if inside:
            other = np.arange(i + 1, n)
        elif block[i] == 0:
            other = np.flatnonzero(block == 1)
        else:
            continue
        if not len(other):
            continue
        both = np.bitwise_count(bits[other] & bits[i]).sum(axis=1, dtype=np.int64)
        hit = other[LEAST[1] * both >= LEAST[0] * (size[other] + size[i] - both)]
        links[i] += len(hit)
        links[hit] += 1
        for r in np.unique(root[hit]):
            if r != root[i]:
                low, high = sorted((int(r), int(root[i])))
                root[root == high] = low
    return links, root


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, class_id, n_links (other sets at the least similarity), n_copies (rows with the same set)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = pin(signed(docs, id_col, text_col))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.min("label").alias("label"))
    width = 2 * LEVELS
    prefix = F.array(*[F.substring("label", t * width + 1, 2 * depth()) for t in range(TREES)])
    met = nodes.select("node", F.posexplode(prefix).alias("tree", "prefix"))
    least = met.groupBy("tree", "prefix").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = met.withColumnRenamed("node", "a").join(least, ["tree", "prefix"]).where("a <> b").select("a", "b").distinct()
    clusters = pin(components(edges))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size")).select(F.col("root").alias("r"), "size")
    total = clusters.count()
    bundles = max(1, total // BUNDLE)
    # A key a verifying call: a bundle of clusters that fit a block each, or two blocks of a larger one.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    placed = clusters.join(sizes, F.col("root") == F.col("r")).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(nodes.select(F.col("node").alias("k"), "rep"), F.col("node") == F.col("k")).select("node", "root", "blocks", "mine", "rep")

    def load(batch: pa.RecordBatch) -> Iterator[dict]:
        names = batch.column("node").to_pylist()
        for begin, texts in together(batch.column("text").to_pylist()):
            parts = list(sets(texts))
            keep = [k for k, p in enumerate(parts) if len(p) and name_of(p) == names[begin + k]]
            pick = pa.array([begin + k for k in keep], pa.int64())
            yield {c: batch.column(c).take(pick) for c in ("node", "root", "blocks", "mine")} | {"items": [parts[k].tobytes() for k in keep]}

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    loaded = map_batches(
        texts.join(placed, same(F.col("id"), F.col("rep"))).select("node", "root", "blocks", "mine", "text"), load,
        "node binary, root binary, blocks int, mine int, items binary",
    )
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("lo"), F.greatest(o, F.col("mine")).alias("hi")))
    dealt = loaded.withColumn("pair", F.explode(pairs)).withColumn(
        "call", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.xxhash64("root", "pair.lo", "pair.hi"))
    )

    def check(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = part.assign(lo=[p["lo"] for p in part["pair"]], hi=[p["hi"] for p in part["pair"]]).drop(columns="pair").drop_duplicates(["root", "lo", "hi", "node"])
        for (_, lo, hi), group in part.groupby(["root", "lo", "hi"], sort=False):
            names = group["node"].tolist()
            links, root = verify(names, [np.frombuffer(x, np.uint64) for x in group["items"]], (group["mine"] == hi).to_numpy().astype(int), lo == hi)
            out += [(a, int(k), names[r]) for a, k, r in zip(names, links, root, strict=True)]
        return pd.DataFrame(out, columns=["node", "links", "root"])

    checked = pin(dealt.select("call", "node", "root", "mine", "pair", "items").groupBy("call").applyInPandas(check, "node binary, links long, root binary"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "l")
    classes = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    class_of = nodes.select("node", "rep", "n_copies").join(classes.select(F.col("node").alias("k"), "root"), F.col("node") == F.col("k"), "left").drop("k")
    class_of = class_of.withColumn("root", F.coalesce("root", "node")).join(links, F.col("node") == F.col("l"), "left").drop("l")
    least_id = class_of.groupBy("root").agg(F.min("rep").alias("class_id")).withColumnRenamed("root", "r")
    described = class_of.join(least_id, F.col("root") == F.col("r")).select(F.col("node").alias("k"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), "n_copies")
    return rows.join(described, F.col("node") == F.col("k"), "left").select(
        "id", F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("class_id")).cast(kind).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "node",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least id; rows without an id stay, and rows that agree in an id that stays too."""
    kept = linked(docs, id_col, text_col).where(same(F.col("id"), F.col("class_id"))).select(F.col("id").alias("__id")).distinct()
    return docs.join(kept, same(F.col(id_col), F.col("__id")), "left_semi")
