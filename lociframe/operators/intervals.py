"""Position and interval joins.

Points that ask for intervals use bins of several levels, each eight times as wide as those of the level below: an interval is
listed once, under the smallest bin that holds it, however long it is, and a point asks one bin on each level that has intervals. The exact bounds are checked on
the joined pairs. Reads, whose rows are as long as the interval they cover, are listed under every bin of one width that they touch instead, so that the
positions looked for in them, the smaller side, ask one bin only.

The smaller side is counted and measured first. Up to BROADCAST_ROWS rows and BROADCAST_BYTES bytes it
is broadcast, and the bigger side is not shuffled at all. Beyond that both sides are shuffled by (chrom, level, bin). The few bins that then hold
more than an even share of the bigger side are split: their rows are spread over several salts and
the other side is repeated for just those bins. At most one bin a share and level can be that full, which
bounds the list of full bins by the number of shuffle partitions.

Both ways give the same rows. Columns that are only carried along may have any type and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.config import BROADCAST_BYTES, BROADCAST_ROWS, by_shuffle, fits, parallelism, pin, row_bytes
from lociframe.functions.bases import revcomp

BIN = 16384
# Bins of a level are 2 to this power times as wide as those of the level below.
STEP = 3
# Bins are counted from here, a number whose bits are a one in every STEP, so that 0, where many intervals start, is at the edge of no wide bin.
FIRST = sum(1 << (STEP * k) for k in range(14))
# Most intervals listed under one bin for a broadcast of lists.
BROADCAST_PER_BIN = 256
# Rows that agree in all columns and lie in a full bin travel as one row for so many.
PILE = 256
_KEY = ["chrom", "_level", "_bin"]


def _bin(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("long")


def _bin_on(pos: Column, width: int, level: Column | int) -> Column:
    """The bin of a position on a level."""
    lowest = F.call_function("div", pos.cast("long") + FIRST * width, F.lit(width).cast("long"))
    return F.call_function("shiftright", lowest, F.lit(STEP) * level)


def _listed(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Non-empty intervals with the level and number of the smallest bin that holds them."""
    first, last = _bin_on(F.col(start), width, 0), _bin_on(F.col(end) - 1, width, 0)
    # They share a bin on the first level at which all bits that differ are shifted out.
    at = intervals.where(F.col(end) > F.col(start)).withColumns({"_bin": first, "_differ": first.bitwiseXOR(last)})
    level = F.when(F.col("_differ") == 0, 0).otherwise(F.ceil(F.length(F.bin("_differ")) / STEP).cast("int"))
    return at.withColumn("_level", level).withColumn("_bin", F.call_function("shiftright", F.col("_bin"), F.lit(STEP) * F.col("_level"))).drop("_differ")


def _asking(points: DataFrame, pos: str, width: int, levels: list[int]) -> DataFrame:
    """A row for each point and level."""
    place = [F.struct(F.lit(k).alias("_level"), _bin_on(F.col(pos), width, k).alias("_bin")) for k in levels]
    if len(place) == 1:
        return points.withColumns({"_level": F.lit(levels[0]), "_bin": _bin_on(F.col(pos), width, levels[0])})
    return points.withColumn("_p", F.explode(F.array(*place)) if place else F.explode(F.array().cast("array<struct<_level:int,_bin:bigint>>"))).withColumns(
        {"_level": F.col("_p._level"), "_bin": F.col("_p._bin")}
    ).drop("_p")


def _levels_of(listed: DataFrame) -> list[int]:
    return sorted(r[0] for r in listed.select("_level").distinct().collect())


def _fits(df: DataFrame, rows: int, share: float = 1.0) -> bool:
    """Whether ``df`` may be broadcast, ``share`` of the room being for it."""
    return fits(df, rows, int(BROADCAST_BYTES * share))


def _hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed: those without a map or a variant in them."""
    return [f.name for f in df.schema.fields if '"map"' not in f.dataType.json() and '"variant"' not in f.dataType.json()]


def _full_bins(big: DataFrame, rows: DataFrame, shares: int) -> DataFrame:
    """Bins of ``big`` with more than 1/shares of all ``rows``, and in how many salts to split each."""
    sizes = big.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_size"))
    total = rows.select(F.count(F.lit(1))).scalar()
    return sizes.where(F.col("_size") * shares > total).select(*_KEY, F.ceil(F.col("_size") * shares / total).cast("int").alias("_salts"))


#: Types whose equal values are the same to the bit, so that rows of them may be counted in place of each other.
_PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def _spread_out(big: DataFrame, full: DataFrame) -> DataFrame:
    """``big`` with a salt in full bins, and ``_times``, for how many equal rows a row stands.

    A row's salt is a hash of it, which a retried task repeats. Equal rows of a full bin are counted, so that a pile of them is a few rows
    with salts of their own; where a column cannot be counted by (floating point, nested), they stay together.
    """
    marked = big.join(F.broadcast(full), _KEY, "left")
    hashed = F.xxhash64(*_hashable(big))
    if not all(isinstance(f.dataType, _PLAIN) for f in big.schema.fields):
        return marked.withColumn("_salt", F.pmod(hashed, F.coalesce("_salts", F.lit(1))).cast("int")).withColumn("_times", F.lit(1)).drop("_salts")
    alone = marked.where("_salts IS NULL").withColumns({"_salt": F.lit(0), "_times": F.lit(1)})
    piles = marked.where("_salts IS NOT NULL").groupBy(*big.columns, "_salts").agg(F.count(F.lit(1)).alias("_equal"))
    piles = piles.withColumn("_pile", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_equal - 1) div {PILE}"))))
    times = F.least(F.lit(PILE), F.col("_equal") - F.col("_pile") * PILE).cast("int")
    piles = piles.withColumns({"_salt": F.pmod(hashed + F.col("_pile"), F.col("_salts")).cast("int"), "_times": times})
    return alone.drop("_salts").unionByName(piles.drop("_salts", "_equal", "_pile"))


def bin_join(
    points: DataFrame,
    intervals: DataFrame,
    pos: str,
    start: str,
    end: str,
    width: int = BIN,
    shares: int | None = None,
    spread: str = "points",
    broadcast_rows: int = BROADCAST_ROWS,
    levels: list[int] | None = None,
) -> DataFrame:
    """Inner join of every point with every half-open interval over it.

    Both sides need a ``chrom`` column and otherwise distinct names. ``spread`` names the bigger side,
    whose full bins are split; the other side is repeated there, or broadcast if it is small. With
    ``points`` the bins have levels (see above; ``levels`` saves finding those of the intervals), with ``intervals`` one width.
    ``shares=0`` saves the count of the bins and leaves full ones to the skew handling of adaptive
    execution. Keeps ``_level``, ``_bin`` and ``_salt``.
    """
    if spread not in ("points", "intervals"):
        raise ValueError("spread must be points or intervals")
    shares = parallelism(points.sparkSession) if shares is None else shares
    within = (F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))
    if spread == "points":
        ivs = _listed(intervals, start, end, width)
        pts = _asking(points, pos, width, _levels_of(ivs) if levels is None else levels)
        big, small, rows = pts, ivs, points
    else:
        pts = points.withColumns({"_level": F.lit(0), "_bin": _bin(F.col(pos), width)})
        touched = F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end) - 1, width)))
        ivs = intervals.where(F.col(end) > F.col(start)).withColumns({"_level": F.lit(0), "_bin": touched})
        big, small, rows = ivs, pts, intervals
    zero = F.lit(0)
    if broadcast_rows and _fits(small, broadcast_rows):
        return big.withColumn("_salt", zero).join(F.broadcast(small), _KEY).where(within)
    if not shares:
        return pts.withColumn("_salt", zero).join(ivs.withColumn("_salt", zero), [*_KEY, "_salt"]).where(within)
    # Fewer than ``shares`` bins of a level can hold more than 1/shares of the rows each: a bounded broadcast.
    full = pin(_full_bins(big, rows, shares))
    if full.isEmpty():
        return big.withColumn("_salt", zero).join(by_shuffle(small), _KEY).where(within)
    many = small.join(F.broadcast(full), _KEY, "left").withColumn("_salt", F.explode(F.sequence(zero, F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    joined = _spread_out(big, full).join(by_shuffle(many), [*_KEY, "_salt"]).where(within)
    return joined.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def assign_interval(
    points: DataFrame,
    intervals: DataFrame,
    take: str = "gene",
    order: list[str] | None = None,
    pos: str = "pos",
    start: str = "start",
    end: str = "end",
    strand: str | None = None,
    width: int = BIN,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Give each point the ``take`` value of the first interval over it; points without one go.

    "First" is by the ``order`` columns of the intervals, i.e. their place in the source file. With
    ``strand`` the column of that name must agree on both sides. Where the points have to be shuffled,
    each place is looked up once and its interval joined to the rows there. Places with more than an even
    share of the rows, fewer than there are shares, are joined by broadcast, so their rows are not moved.
    """
    order = order or ["ord"]
    names = {start: "_start", end: "_end", take: "_take", **({strand: "_strand"} if strand else {})}
    same = ["chrom", "_start", "_end", *(["_strand"] if strand else [])]
    # One row per distinct interval: copies further down the file can never win.
    ivs = (
        intervals.where(F.col(end) > F.col(start))
        .select("chrom", *[F.col(c).alias(n) for c, n in names.items()], F.struct(*order).alias("_order"))
        .groupBy(*same)
        .agg(F.min(F.struct("_order", "_take")).alias("_best"))
    )
    listed = _listed(ivs, "_start", "_end", width)
    sizes = listed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(listed)).alias("b"))
    sizes = sizes.agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("b").alias("bytes"), F.collect_set("_level").alias("levels")).first()
    levels = sorted(sizes["levels"])
    if (sizes["all"] or 0) <= broadcast_rows and (sizes["most"] or 0) <= BROADCAST_PER_BIN and (sizes["bytes"] or 0) <= BROADCAST_BYTES:
        return _assign_by_list(points, listed, take, pos, strand, width, levels)
    place = ["chrom", pos, *([strand] if strand else [])]
    once = points.groupBy(*place).agg(F.count(F.lit(1)).alias("_copies"))
    hits = bin_join(once, ivs, pos, "_start", "_end", width, broadcast_rows=0, levels=levels)
    if strand:
        hits = hits.where(F.col(strand) == F.col("_strand"))
    won = hits.groupBy(*place, "_copies").agg(F.min("_best").alias("_best"))
    won = pin(won.select(*place, "_copies", F.col("_best._take").alias("_take")))
    shares = parallelism(points.sparkSession)
    crowded = F.col("_copies") * shares > won.select(F.sum("_copies")).scalar()
    hot = F.broadcast(won.where(crowded).drop("_copies"))
    apart = points.join(hot.select(*place), place, "left_anti").join(won.where(~crowded).drop("_copies"), place)
    out = [*points.columns, F.col("_take").alias(take)]
    return points.join(hot, place).select(*out).unionAll(apart.select(*out))


def _assign_by_list(points: DataFrame, listed: DataFrame, take: str, pos: str, strand: str | None, width: int, levels: list[int]) -> DataFrame:
    """The lookup for an interval table that fits a broadcast: each bin's intervals as a list in file
    order, so a point finds its interval where it stands, without shuffle or aggregation."""
    entry = F.struct("_best", "_start", "_end", *(["_strand"] if strand else []))
    # Level and bin in one number: all levels are looked up in one broadcast.
    place = lambda number, level: number * 64 + level
    lists = listed.groupBy("chrom", place(F.col("_bin"), F.col("_level")).alias("_place")).agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    none = F.array().cast(lists.schema["_list"].dataType)

    def over(i: Column) -> Column:
        inside = (i["_start"] <= F.col(pos)) & (i["_end"] > F.col(pos))
        return inside & (i["_strand"] == F.col(strand)) if strand else inside

    at, firsts = points, [none]
    for k in levels:
        named = lists.select(F.col("chrom").alias(f"_c{k}"), F.col("_place").alias(f"_b{k}"), F.col("_list").alias(f"_l{k}"))
        at = at.join(F.broadcast(named), (F.col("chrom") == F.col(f"_c{k}")) & (place(_bin_on(F.col(pos), width, k), F.lit(k)) == F.col(f"_b{k}")), "left")
        firsts.append(F.coalesce(F.slice(F.filter(f"_l{k}", over), 1, 1), none))
    # Through a generator, so that the test for a hit is not pushed into a join condition, where Spark
    # cannot evaluate a lambda over columns of both sides.
    first = F.explode_outer(F.slice(F.array_sort(F.flatten(F.array(*firsts))), 1, 1))
    found = at.withColumn("_hit", first).where(F.col("_hit").isNotNull())
    return found.select(*points.columns, F.col("_hit._best._take").alias(take))


def in_intervals(points: DataFrame, intervals: DataFrame, pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Points that fall in at least one interval."""
    marked = intervals.select("chrom", F.col(start).alias("s_"), F.col(end).alias("e_")).distinct()
    marked = marked.withColumn("hit", F.lit(1)).withColumn("ord", F.lit(0))
    return assign_interval(points, marked, take="hit", pos=pos, start="s_", end="e_").drop("hit")


def rename_by_peak(snps: DataFrame, peaks: DataFrame, snp: str = "snp") -> DataFrame:
    """Append the name of the peak over it to each ``chrom.pos`` id; ids outside every peak go.

    ``peaks`` has chrom, start, end, name, ord.
    """
    split = snps.withColumn("chrom", F.split_part(snp, F.lit("."), F.lit(1))).withColumn(
        "_pos", F.split_part(snp, F.lit("."), F.lit(2)).cast("long")
    )
    named = assign_interval(split, peaks.withColumnRenamed("name", "_peak"), take="_peak", pos="_pos")
    return named.withColumn(snp, F.concat_ws("-", snp, "_peak")).select(*snps.columns)


def reads_x_snps(
    reads: DataFrame, snps: DataFrame, width: int = BIN, margin: int = 0, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Every SNP under every read, with the read's base there.

    ``reads``: chrom, start, seq and anything else; ``snps``: chrom, pos and anything else. Reads play
    the part of the intervals and, being the bigger side, are the ones split where they pile up.
    ``margin`` also takes SNPs that many bases beside the read; their base is empty.
    """
    spans = reads.withColumns({"_start": F.col("start") - margin, "_end": F.col("start") + F.length("seq") + margin})
    hits = bin_join(snps, spans, "pos", "_start", "_end", width, spread="intervals", broadcast_rows=broadcast_rows)
    at = (F.col("pos") - F.col("start") + 1).cast("int")
    base = F.when(at > 0, F.substring("seq", at, F.lit(1))).otherwise("")
    return hits.withColumn("base", base).drop("_level", "_bin", "_salt", "_start", "_end")


# ---- lookups in a tiled genome: columns chrom, tile, seq; tile t holds bases t*size .. (t+1)*size-1 ----

_TILE = ["chrom", "tile"]


def flanked(tiles: DataFrame, size: int, flank: int) -> DataFrame:
    """Tiles that overlap: adds ``before`` and ``after``, up to ``flank`` bases of the sequence on both sides of each tile.

    Every tile hands its ends to its neighbours, so what moves is twice the flank a tile, not the sequence once for every position. A flank longer than
    a tile reaches over as many tiles as it takes.
    """
    reach = -(-flank // size)
    # Bases that tile t + k needs of tile t: behind it its last ones, before it its first ones.
    give = [
        F.struct((F.col("tile") + k).alias("tile"), F.lit(-k).alias("at"), (F.substring("seq", 1, flank - (-k - 1) * size) if k < 0 else F.right("seq", F.lit(flank - (k - 1) * size))).alias("ends"))
        for k in (*range(-reach, 0), *range(1, reach + 1))
    ]
    handed = tiles.select("chrom", F.inline(F.array(*give))) if give else None
    if handed is None:
        return tiles.select(*_TILE, "seq", F.lit("").alias("before"), F.lit("").alias("after"))
    own = tiles.select(*_TILE, F.lit(0).alias("at"), F.col("seq").alias("ends"))
    # At most 2 * reach + 1 rows a tile.
    pieces = own.unionByName(handed).groupBy(*_TILE).agg(F.array_sort(F.collect_list(F.struct("at", "ends"))).alias("p"))
    side = lambda test: F.array_join(F.transform(F.filter("p", lambda x: test(x["at"])), lambda x: x["ends"]), "")
    whole = pieces.select(*_TILE, side(lambda a: a == 0).alias("seq"), side(lambda a: a < 0).alias("before"), side(lambda a: a > 0).alias("after"), F.exists("p", lambda x: x["at"] == 0).alias("there"))
    return whole.where("there").drop("there")


def _at_tiles(positions: DataFrame, tiles: DataFrame, size: int, pos: str, few: bool) -> DataFrame:
    """Every position with its tile, by one equi-join, a broadcast of ``few`` tiles; positions off the genome go. Where a tile has more than an even share of the
    positions, these are spread over salts and the tile is repeated; there are fewer such tiles than shares."""
    asked = positions.where(F.col(pos) >= 0).withColumn("tile", _bin(F.col(pos), size))
    clash = {c: f"_t_{c}" for c in tiles.columns if c not in _TILE}
    named = tiles.select(*_TILE, *[F.col(c).alias(n) for c, n in clash.items()])
    inside = F.col(pos) - F.col("tile") * size < F.length("_t_seq")
    if few:
        return asked.join(F.broadcast(named), _TILE).where(inside)
    shares = parallelism(positions.sparkSession)
    total = positions.select(F.count(F.lit(1))).scalar()
    full = asked.groupBy(*_TILE).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") * shares > total)
    full = pin(full.select(*_TILE, F.ceil(F.col("_size") * shares / total).cast("int").alias("_salts")))
    if full.isEmpty():
        return asked.join(by_shuffle(named), _TILE).where(inside)
    # Positions of a tile differ; copies of one are told apart by their other columns where they have any.
    salts = F.coalesce("_salts", F.lit(1))
    spread = asked.join(F.broadcast(full), _TILE, "left").withColumn("_salt", F.pmod(F.xxhash64(*_hashable(positions)), salts).cast("int")).drop("_salts")
    repeated = named.join(F.broadcast(full), _TILE, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return spread.join(by_shuffle(repeated), [*_TILE, "_salt"]).where(inside).drop("_salt")


def windows(positions: DataFrame, tiles: DataFrame, size: int, before: int, after: int, pos: str = "pos") -> DataFrame:
    """Bases pos-before .. pos+after around each position as ``window``.

    Windows cut by an end of the sequence are shorter and have ``is_edge`` set; positions outside the
    sequence go. The tiles are given flanks as long as the window reaches, so that a position finds its whole window in one tile; tiles that
    have ``before`` and ``after`` (at least as long) are taken as they are.
    """
    flank = max(before, after)
    whole = tiles if {"before", "after"} <= set(tiles.columns) else flanked(tiles, size, flank)
    # Measured without the flanks, which saves putting them on twice.
    few = _fits(tiles.select(*_TILE, "seq"), BROADCAST_ROWS, size / (size + 2 * flank))
    at = _at_tiles(positions, whole, size, pos, few)
    line = F.concat("_t_before", "_t_seq", "_t_after")
    here = F.length("_t_before") + F.col(pos) - F.col("tile") * size  # place in it, from 0
    first = F.greatest(here - before, F.lit(0))
    window = F.substring(line, (first + 1).cast("int"), (here + after + 1 - first).cast("int"))
    found = at.withColumn("window", window).withColumn("is_edge", F.length("window") < before + after + 1)
    return found.select(*positions.columns, "window", "is_edge")


def base_at(positions: DataFrame, tiles: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """The genome base at each position, column ``base``; positions off the genome go."""
    own = tiles.select(*_TILE, "seq")
    at = _at_tiles(positions, own, size, pos, _fits(own, BROADCAST_ROWS))
    base = F.substring("_t_seq", (F.col(pos) - F.col("tile") * size + 1).cast("int"), F.lit(1))
    return at.withColumn("base", base).where(F.length("base") > 0).select(*positions.columns, "base")


def compare_to_genome(snps: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Adds ``call``: ref, alt or no_match, by the genome base at each SNP (columns ref, alt)."""
    found = F.upper("base")
    return base_at(snps, tiles, size).withColumn(
        "call", F.when(found == F.upper("ref"), "ref").when(found == F.upper("alt"), "alt").otherwise("no_match")
    )


def get_regions(positions: DataFrame, tiles: DataFrame, size: int, count: int = 7, base: int = 0) -> DataFrame:
    """``count`` bases to both sides of each position, upper case; ``pos`` stays as given."""
    shifted = positions.withColumn("_at", F.col("pos") - base)
    return (
        windows(shifted, tiles, size, count, count, "_at")
        .withColumn("region", F.upper("window"))
        .select(*positions.columns, "region", "is_edge")
    )


def get_dinucleotides(positions: DataFrame, tiles: DataFrame, size: int, base: int = 0) -> DataFrame:
    """Reference base, the two plus-strand dinucleotides at each position and their reverse
    complements. Those cut by the sequence edge are one base long, with ``is_edge`` set."""
    shifted = positions.withColumn("_at", F.col("pos") - base)
    w = windows(shifted, tiles, size, 1, 1, "_at")
    at = F.when(F.col("_at") == 0, 1).otherwise(2)
    plus1 = F.substring("window", F.lit(1), at)
    plus2 = F.substring("window", at, F.lit(2))
    return w.select(
        *positions.columns,
        F.substring("window", at, F.lit(1)).alias("ref_base"),
        plus1.alias("plus1"),
        plus2.alias("plus2"),
        revcomp(plus1).alias("minus1"),
        revcomp(plus2).alias("minus2"),
        "is_edge",
    )


def dinucleotide_shape(df: DataFrame, shape: str) -> DataFrame:
    """``get_dinucleotides`` output in another shape: ``rows`` is one row per strand and dinucleotide,
    ``map`` one row per position with both strands in a map."""
    plus, minus = F.array("plus1", "plus2"), F.array("minus1", "minus2")
    strands = F.create_map(F.lit("+"), plus, F.lit("-"), minus)
    if shape == "map":
        return df.select("chrom", "pos", "ref_base", strands.alias("dinucleotides"))
    if shape == "rows":
        both = df.select("chrom", "pos", F.explode(strands).alias("strand", "_d"))
        return both.select("chrom", "pos", "strand", F.explode("_d").alias("dinucleotide"))
    raise ValueError("shape must be rows or map")


def missing_chroms(positions: DataFrame, tiles: DataFrame) -> DataFrame:
    """Requested chromosomes that have no sequence."""
    return positions.select("chrom").distinct().join(tiles.select("chrom").distinct(), "chrom", "left_anti")
