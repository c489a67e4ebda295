"""Records that run over several lines, put together in the splits of the files they lie in.

A first pass says a few things about every split: how many lines or bases it has, and what stands at its edges. From these, one row a split, follows where
each split starts in its file or sequence. A second pass puts the records together where they lie; records cut by an edge of a split come
from the first pass. No line is shuffled, sorted or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with the file and the first byte of the split they were read in; in file order within a split."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, begin, end) of the runs of lines of one split in a batch."""
    file, block = batch.column("file"), batch.column("block")
    n = batch.num_rows
    if not n:
        return
    new = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
    cuts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield file[a].as_py(), block[a].as_py(), a, b


def _with_state(lines: DataFrame, splits: DataFrame, *state: str) -> DataFrame:
    """``lines`` with columns of their split. Both passes read the same files; should they be cut up differently, as
    when executors joined in between, the job fails instead of losing lines."""
    known = splits.select("file", "block", F.struct(*state).alias("_state"))
    joined = lines.join(F.broadcast(known), ["file", "block"], "left")  # a row a split
    lost = F.raise_error(F.lit("the files were split differently while they were read; run the query again"))
    checked = F.when(F.col("_state").isNull(), lost.cast(known.schema["_state"].dataType)).otherwise(F.col("_state"))
    return joined.withColumn("_state", checked).select("value", "file", "block", *[F.col(f"_state.{s}").alias(s) for s in state])


# ---- records of a fixed number of lines ----


def fixed_records(spark: SparkSession, paths: str | list[str], names: list[str | None]) -> DataFrame:
    """Records of ``len(names)`` lines: file, record (number in the file, from 0), and a column for every named line. Lines missing at the end of a file are null."""
    size = len(names)
    kept = [(k, n) for k, n in enumerate(names) if n]
    lines = split_lines(spark, paths)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            at, count, head, tail = held
            return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "lines": count, "head": head, "tail": tail}], schema=schema)

        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))])
        held = None
        for batch in batches:
            for file, block, a, b in _runs(batch):
                if held is None or held[0] != (file, block):
                    if held:
                        yield row()
                    held = [(file, block), 0, [], []]
                value, edge = batch.column("value"), size - 1
                held[1] += b - a
                held[2] += value.slice(a, min(edge - len(held[2]), b - a)).to_pylist()
                held[3] = (held[3] + value.slice(max(a, b - edge), b - max(a, b - edge)).to_pylist())[-edge:]
        if held:
            yield row()

    splits = lines.mapInArrow(describe, "file string, block long, lines long, head array<string>, tail array<string>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, held = None, 0, pa.array([], pa.string())
        for batch in batches:
            for file, block, a, b in _runs(batch):
                if at != (file, block):
                    at, seen, held = (file, block), 0, pa.array([], pa.string())
                first = batch.column("first")[a].as_py()
                value = pa.concat_arrays([held, batch.column("value").slice(a, b - a).cast(pa.string())])
                number = first + seen - len(held)
                seen += b - a
                skip = min(-number % size, len(value))  # lines of a record that began in the split before
                n = (len(value) - skip) // size
                held = value.slice(skip + n * size)
                if n:
                    record = (number + skip) // size
                    picked = [value.take(pa.array(range(skip + k, skip + n * size, size), pa.int64())) for k, _ in kept]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(record, record + n), pa.int64()), *picked], names=["file", "record", *[name for _, name in kept]])

    columns = ", ".join(f"{n} string" for _, n in kept)
    whole = _with_state(lines, splits, "first").mapInArrow(assemble, f"file string, record long, {columns}")

    # The lines at the edges of a split that no whole record in it holds.
    lead = F.least(F.pmod(-F.col("first"), F.lit(size)), F.col("lines"))
    rest = (F.col("lines") - lead) % size
    none = F.array().cast("array<long>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(none)
    line = lambda number, value: F.struct(number.alias("number"), value.alias("value"))
    leading = F.transform(upto(lead), lambda i: line(F.col("first") + i, F.get("head", i.cast("int"))))
    trailing = F.transform(upto(rest), lambda i: line(F.col("first") + F.col("lines") - rest + i, F.get("tail", (F.size("tail") - rest + i).cast("int"))))
    cut = splits.select("file", F.explode(F.concat(leading, trailing)).alias("l")).select("file", "l.*")
    mended = cut.groupBy("file", F.floor(F.col("number") / size).cast("long").alias("record")).agg(
        *[F.max(F.when(F.col("number") % size == k, F.col("value"))).alias(n) for k, n in kept]
    )
    return whole.unionByName(mended)


# ---- sequences under headers ----


def tiled_sequences(spark: SparkSession, paths: str | list[str], tile: int) -> DataFrame:
    """Sequences under ``>`` lines, in tiles: chrom, tile, seq. A sequence runs on from one file to the next, in the order of their names, until there is a header."""
    lines = split_lines(spark, paths)

    def parts(batches: Iterator[pa.RecordBatch], columns: list[str]):
        """(key and state of the split, header or None, text) for each run of lines under one header."""
        for batch in batches:
            value = batch.column("value")
            for file, block, a, b in _runs(batch):
                state = (file, block, *(batch.column(c)[a].as_py() for c in columns))
                here = value.slice(a, b - a)
                heads = pc.indices_nonzero(pc.fill_null(pc.starts_with(here, ">"), False)).to_pylist()
                text = here.to_pylist()
                for i, (x, y) in enumerate(zip([-1, *heads], [*heads, len(text)], strict=True)):
                    if i or y:
                        yield state, text[x] if i else None, "".join(t.strip(" ") for t in text[x + 1 : y])

    def name_of(header: str) -> str:
        return (header[1:].split(maxsplit=1) or [""])[0]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lead", pa.int64()), ("head", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("tail", pa.string())])
        at, d = None, None
        for key, header, text in parts(batches, []):
            if key != at:
                if d:
                    yield pa.RecordBatch.from_pylist([d], schema=schema)
                at, d = key, {"file": key[0], "block": key[1], "lead": 0, "head": "", "name": None, "size": 0, "tail": ""}
            if header is not None:
                d |= {"name": name_of(header), "size": 0, "tail": ""}
            if d["name"] is None:
                d["lead"] += len(text)
                d["head"] += text[: tile - len(d["head"])]
            d["size"] += len(text)
            d["tail"] = (d["tail"] + text)[-tile:]
        if d:
            yield pa.RecordBatch.from_pylist([d], schema=schema)

    splits = lines.mapInArrow(describe, "file string, block long, lead long, head string, name string, size long, tail string")
    # One row a split, in one task.
    order = Window.orderBy("file", "block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    splits = splits.withColumn("_from", F.when(F.col("name").isNotNull(), F.col("_upto") - F.col("size")))
    splits = splits.withColumns(
        {"chrom": F.last("name", ignorenulls=True).over(earlier), "begin": F.max("_upto").over(earlier) - F.last("_from", ignorenulls=True).over(earlier)}
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())], names=["chrom", "tile", "seq"])

        at, chrom, number, skip, held, found = None, None, 0, 0, "", []
        for key, header, text in parts(batches, ["chrom", "begin"]):
            if key != at:
                at, held = key, ""
                chrom = key[2]
                if chrom is not None:
                    number, skip = -(-key[3] // tile), -key[3] % tile  # the rest of a tile that began in the split before
            if header is not None:
                if held:
                    found.append((chrom, number, held))  # the last tile of a sequence
                chrom, number, skip, held = name_of(header), 0, 0, ""
            if chrom is None:
                continue
            gone = min(skip, len(text))
            skip -= gone
            held = held + text[gone:]
            whole = len(held) // tile
            found += [(chrom, number + i, held[i * tile : (i + 1) * tile]) for i in range(whole)]
            number, held = number + whole, held[whole * tile :]
            if len(found) >= 256:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    whole = _with_state(lines, splits, "chrom", "begin").mapInArrow(assemble, "chrom string, tile long, seq string")

    # Tiles cut by the edges of a split: the rest of one that began before it, and the beginning of its last one.
    t = F.lit(tile).cast("long")
    piece = lambda chrom, at, seq: F.struct(chrom.alias("chrom"), at.alias("at"), seq.alias("seq"))
    missing = F.pmod(-F.col("begin"), t)
    first = F.when(F.col("chrom").isNotNull() & (missing > 0) & (F.col("lead") > 0), piece(F.col("chrom"), F.col("begin"), F.substring("head", F.lit(1), F.least(missing, F.col("lead")).cast("int"))))
    start = F.when(F.col("name").isNotNull(), F.lit(0).cast("long")).otherwise(F.col("begin"))
    owner = F.coalesce("name", "chrom")
    end = start + F.col("size")
    open_at = end - end % t
    last = F.when(owner.isNotNull() & (end % t > 0) & (open_at >= start), piece(owner, open_at, F.right("tail", (end - open_at).cast("int"))))
    cut = splits.select(F.inline(F.filter(F.array(first, last), lambda p: p.isNotNull())))
    mended = cut.groupBy("chrom", F.call_function("div", F.col("at"), t).alias("tile")).agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("p"))
    return whole.unionByName(mended.select("chrom", "tile", F.array_join("p.seq", "").alias("seq")))


def with_header(lines: DataFrame, header: list[str]) -> DataFrame:
    """Text lines with ``header`` in front of every part, so that each file written from them is complete."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(header, pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])

    return lines.select(F.col("value").cast("string").alias("value")).mapInArrow(run, "value string")
