"""Interval joins and interval sets per record. Coordinates are 0-based and half-open (start, stop).

Joins put both sides into bins of one width and meet on (record, bin); a pair is kept only in the larger of the two first
bins, so none comes twice. Intervals over many bins meet on the record alone, in a branch of their own, so that one very
long interval does not multiply. Bin width follows the intervals' lengths.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG_BINS = 64
#: Bases in a block of the operators that run along a record.
BLOCK = 1 << 16


def bin_width(*sides: DataFrame) -> int:
    """About the 90th percentile of the interval lengths of both sides, at least 1: one scalar."""
    lengths = None
    for s in sides:
        one = s.select((F.col("stop") - F.col("start")).alias("n"))
        lengths = one if lengths is None else lengths.unionByName(one)
    return max(1, int(lengths.agg(F.percentile_approx("n", 0.9)).first()[0] or 1))


def overlap_join(a: DataFrame, b: DataFrame, key: str = "record_id", width: int | None = None, same_strand: bool = False, gap: int = 0, prefix: str = "b_") -> DataFrame:
    """Pairs of rows of a and b of one record that overlap, or are less than ``gap`` bases apart; b's columns get a prefix.

    Half-open: touching intervals do not overlap. Empty intervals match nothing.
    """
    w = width or bin_width(a, b) + gap
    left = a.withColumn("_lo", F.col("start") - gap).withColumn("_hi", F.col("stop") + gap)
    right = b.select(*(F.col(c).alias(prefix + c) for c in b.columns))
    bs, be = F.col(f"{prefix}start"), F.col(f"{prefix}stop")
    meets = (F.col("_lo") < be) & (bs < F.col("_hi")) & (F.col("start") < F.col("stop")) & (bs < be)
    if same_strand:
        meets &= F.col("strand") == F.col(f"{prefix}strand")
    first = lambda x: F.floor(x / w)
    last = lambda x: F.floor((x - 1) / w)
    left = left.withColumn("_b0", first(F.col("_lo"))).withColumn("_b1", F.greatest(F.col("_b0"), last(F.col("_hi"))))
    right = right.withColumn("_c0", first(bs)).withColumn("_c1", F.greatest(F.col("_c0"), last(be)))
    long_a, long_b = F.col("_b1") - F.col("_b0") > LONG_BINS, F.col("_c1") - F.col("_c0") > LONG_BINS
    on = F.col(key) == F.col(prefix + key)
    short = left.where(~long_a).withColumn("_bin", F.explode(F.sequence("_b0", "_b1"))).join(right.where(~long_b).withColumn("_cbin", F.explode(F.sequence("_c0", "_c1"))), on & (F.col("_bin") == F.col("_cbin")))
    pairs = short.where(meets & (F.col("_bin") == F.greatest("_b0", "_c0"))).drop("_bin", "_cbin")
    wide = left.where(long_a).join(right, on & meets).unionByName(left.where(~long_a).join(right.where(long_b), on & meets))
    return pairs.unionByName(wide).drop("_lo", "_hi", "_b0", "_b1", "_c0", "_c1")


def interval_intersect(a: DataFrame, b: DataFrame, key: str = "record_id", id_col: str = "feature_id", gap: int = 0, same_strand: bool = False) -> DataFrame:
    """Rows of a that overlap any row of b (within ``gap`` bases)."""
    met = overlap_join(a.select(key, "start", "stop", "strand", id_col), b.select(key, "start", "stop", "strand"), key, same_strand=same_strand, gap=gap)
    return a.join(met.select(id_col).distinct(), id_col, "left_semi")


def interval_adjacent(a: DataFrame, b: DataFrame, window: int, same_strand: bool = False, key: str = "record_id", id_col: str = "feature_id") -> DataFrame:
    """Rows of a within ``window`` bases of a row of b."""
    return interval_intersect(a, b, key, id_col, window, same_strand)


def neighbours(a: DataFrame, b: DataFrame, within: int, ordered: bool = True, key: str = "record_id", id_col: str = "feature_id") -> DataFrame:
    """Rows of b whose flank of ``within`` bases (upstream only if ordered, by strand; else both) meets a row of a on the same strand. Strand 0 counts as reverse."""
    plus = F.col("strand") > 0
    lo = F.when(plus | F.lit(not ordered), F.col("start") - within).otherwise(F.col("start"))
    hi = F.when(~plus | F.lit(not ordered), F.col("stop") + within).otherwise(F.col("stop"))
    flank = b.select(key, lo.alias("start"), hi.alias("stop"), plus.cast("int").alias("strand"), id_col)
    other = a.select(key, "start", "stop", plus.cast("int").alias("strand"))
    return b.join(overlap_join(flank, other, key, same_strand=True).select(id_col).distinct(), id_col, "left_semi")


def filter_regions(features: DataFrame, regions: DataFrame, key: str = "record_id", id_col: str = "feature_id") -> DataFrame:
    """Features that overlap a listed region (record, start, stop), both ends closed."""
    closed = lambda d: d.withColumn("stop", F.col("stop") + 1)
    met = overlap_join(closed(features.select(key, "start", "stop", id_col)), closed(regions.select(key, "start", "stop")), key)
    return features.join(met.select(id_col).distinct(), id_col, "left_semi")


def filter_contains_points(features: DataFrame, points: DataFrame, key: str = "record_id", id_col: str = "feature_id", keep_matches: bool = False) -> DataFrame:
    """Features that hold at least one listed base (record, pos); one row a feature, or one a match."""
    spans = points.select(key, F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"))
    met = overlap_join(features.select(key, "start", "stop", id_col), spans, key).select(id_col, F.col("b_start").alias("pos"))
    return features.join(met, id_col) if keep_matches else features.join(met.select(id_col).distinct(), id_col, "left_semi")


def features_in_range(features: DataFrame, centres: DataFrame, distance: int, key: str = "record_id", id_col: str = "feature_id") -> DataFrame:
    """(centre, feature, distance): features whose nearer end is within ``distance`` bases of a centre's interval; a centre is not its own match."""
    met = overlap_join(centres.select(key, "start", "stop", id_col), features.select(key, "start", "stop", id_col), key, gap=distance + 1)
    gap = F.greatest(F.lit(0), F.col("start") - F.col("b_stop"), F.col("b_start") - F.col("stop"))
    return met.where(F.col(id_col) != F.col("b_" + id_col)).select(F.col(id_col).alias("centre"), F.col("b_" + id_col).alias("feature"), gap.alias("distance")).where(F.col("distance") <= distance)


def upstream_window(features: DataFrame, targets: DataFrame, distance: int, key: str = "record_id", id_col: str = "feature_id") -> DataFrame:
    """(target, feature): features that start within ``distance`` bases upstream of a target, by the target's strand."""
    plus = F.col("strand") > 0
    zone = targets.select(key, id_col, F.when(plus, F.col("start") - distance).otherwise(F.col("stop")).alias("start"), F.when(plus, F.col("start")).otherwise(F.col("stop") + distance).alias("stop"), plus.cast("int").alias("strand"))
    begin = F.when(plus, F.col("start")).otherwise(F.col("stop") - 1)
    spots = features.select(key, id_col, begin.alias("start"), (begin + 1).alias("stop"), plus.cast("int").alias("strand"))
    return overlap_join(zone, spots, key, same_strand=True).where(F.col(id_col) != F.col("b_" + id_col)).select(F.col(id_col).alias("target"), F.col("b_" + id_col).alias("feature"))


def excessive_overlaps(features: DataFrame, same_strand: int = 15, divergent: int = 30, key: str = "record_id", id_col: str = "feature_id") -> DataFrame:
    """(a, b, bases): pairs that overlap by ``same_strand`` bases or more on one strand, or by ``divergent`` on two."""
    met = overlap_join(features.select(key, "start", "stop", "strand", id_col), features.select(key, "start", "stop", "strand", id_col), key)
    bases = F.least("stop", "b_stop") - F.greatest("start", "b_start")
    limit = F.when(F.col("strand") == F.col("b_strand"), same_strand).otherwise(divergent)
    return met.where((F.col(id_col) < F.col("b_" + id_col)) & (bases >= limit)).select(F.col(id_col).alias("a"), F.col("b_" + id_col).alias("b"), bases.alias("bases"))


def pair_classify(a: DataFrame, b: DataFrame, distance: int, least_overlap: int = 6, key: str = "record_id", id_col: str = "feature_id") -> DataFrame:
    """(a, b, kind): same-strand pairs at most ``distance`` bases apart: embedded (b inside a), overlapping, or separate (also for overlaps under ``least_overlap``)."""
    met = overlap_join(a.select(key, "start", "stop", "strand", id_col), b.select(key, "start", "stop", "strand", id_col), key, same_strand=True, gap=distance + 1)
    bases = F.least("stop", "b_stop") - F.greatest("start", "b_start")
    inside = (F.col("start") <= F.col("b_start")) & (F.col("b_stop") <= F.col("stop"))
    kind = F.when(inside, "embedded").when(bases >= least_overlap, "overlapping").otherwise("separate")
    return met.where((-bases <= distance) & (F.col(id_col) != F.col("b_" + id_col))).select(F.col(id_col).alias("a"), F.col("b_" + id_col).alias("b"), kind.alias("kind"))


def pair_totals(pairs: DataFrame) -> DataFrame:
    """Pairs and different ends for each kind."""
    return pairs.groupBy("kind").agg(F.count("*").alias("pairs"), F.count_distinct("a").alias("a_ends"), F.count_distinct("b").alias("b_ends"))


def _marked(rows: DataFrame, keys: tuple[str, ...], joined: bool, block: int | None) -> DataFrame:
    """(keys, start, stop, _bin, _reached, _new): the largest stop before each interval of its key, and 1 where a new island begins.

    With a block the intervals of a key are cut into bins of that many bases: intervals of one start are one row before
    the shuffle, and the largest stop of the bins before is carried into each, so a bin has at most as many rows as bases.
    """
    rows = rows.select(*keys, "start", "stop")
    if block is None:
        rows, carry = rows.withColumn("_bin", F.lit(0)), F.lit(None).cast("long")
    else:
        # Empty intervals stay rows of their own: with joined=False they are islands.
        empty = F.when(F.col("stop") <= F.col("start"), F.col("stop"))
        rows = rows.groupBy(*keys, "start", empty.alias("_empty")).agg(F.max("stop").alias("stop")).withColumn("_bin", F.floor(F.col("start") / block))
        tops = rows.groupBy(*keys, "_bin").agg(F.max("stop").alias("_top"))
        before = F.max("_top").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        tops = tops.select(*(F.col(k).alias(f"_t_{k}") for k in (*keys, "_bin")), before.alias("_carry"))
        rows = rows.join(tops, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in (*keys, "_bin"))))
        carry = F.col("_carry")
    w = Window.partitionBy(*keys, "_bin").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reached", F.greatest(F.max("stop").over(w), carry))
    new = F.col("_reached").isNull() | ((F.col("start") > F.col("_reached")) if joined else (F.col("start") >= F.col("_reached")))
    return rows.select(*keys, "start", "stop", "_bin", "_reached", new.cast("int").alias("_new"))


def merge_intervals(rows: DataFrame, keys: tuple[str, ...] = ("record_id",), joined: bool = True, block: int | None = BLOCK) -> DataFrame:
    """Union of the overlapping (joined: or touching) intervals of each key, by the running largest stop.

    A key is cut into blocks of bases; without a block, for small keys, each is one task's.
    """
    w = Window.partitionBy(*keys, "_bin").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    pieces = _marked(rows, keys, joined, block).withColumn("_n", F.sum("_new").over(w)).groupBy(*keys, "_bin", "_n").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    if block is None:
        return pieces.drop("_bin", "_n")
    # Piece 0 of a bin goes on with the last island that began in a bin before.
    bins = pieces.groupBy(*keys, "_bin").agg(F.max(F.when(F.col("_n") > 0, F.col("_n"))).alias("_n"), F.max(F.when(F.col("_n") == 0, F.col("stop"))).alias("stop"))
    last = F.last(F.when(F.col("_n").isNotNull(), F.struct("_bin", "_n")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    heads = bins.withColumn("_at", last).where("stop is not null").select(*keys, "_at._bin", "_at._n", F.lit(None).cast(pieces.schema["start"].dataType).alias("start"), "stop")
    return pieces.where("_n > 0").unionByName(heads).groupBy(*keys, "_bin", "_n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_bin", "_n")


def gaps(rows: DataFrame, keys: tuple[str, ...] = ("record_id",), block: int | None = BLOCK) -> DataFrame:
    """The space between merged neighbours: from the largest stop so far to where a new island begins."""
    found = _marked(rows, keys, True, block).where("_new = 1 and _reached is not null")
    return found.select(*keys, F.col("_reached").alias("start"), F.col("start").alias("stop"))


def excessive_gaps(rows: DataFrame, lengths: DataFrame, least: int, keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Gaps of at least ``least`` bases, those before the first and after the last interval included; lengths: (keys, length)."""
    zero, end = F.lit(0).cast("long"), F.col("length").cast("long")
    edges = lengths.select(*keys, zero.alias("start"), zero.alias("stop")).unionByName(lengths.select(*keys, end.alias("start"), end.alias("stop")))
    return gaps(rows.select(*keys, "start", "stop").unionByName(edges), keys).where(F.col("stop") - F.col("start") >= least)


def codable_mask(rows: DataFrame, lengths: DataFrame, keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """A record cut into masked (inside rows) and open runs."""
    inside = merge_intervals(rows, keys)
    return inside.withColumn("masked", F.lit(True)).unionByName(excessive_gaps(rows, lengths, 1, keys).withColumn("masked", F.lit(False)))


def introns(cds: DataFrame, keys: tuple[str, ...] = ("record_id", "parent")) -> DataFrame:
    """Spaces between neighbouring coding parts of a gene, numbered along the record."""
    found = gaps(cds, keys, block=None)
    return found.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("start")))


def intron_sequences(cds: DataFrame, seqs: DataFrame, keys: tuple[str, ...] = ("record_id", "parent")) -> DataFrame:
    """(keys, seq): the spaces between neighbouring coding parts of a gene, one after the other on the forward strand; keys[0] names the sequence."""
    joined = introns(cds, keys).join(seqs.select(F.col("seq_id").alias(keys[0]), F.col("seq").cast("binary").alias("_b")), keys[0])
    piece = F.substring("_b", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int")).cast("string")
    parts = F.array_sort(F.collect_list(F.struct("n", piece.alias("s"))))  # a gene's own introns
    return joined.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("seq"))


def reading_frame(start: Column, stop: Column, strand: Column, length: Column) -> Column:
    """Frame 1 to 3 of a forward gene, 4 to 6 of a reverse one."""
    return F.when(strand > 0, F.pmod(start, F.lit(3)) + 1).otherwise(F.pmod(length - stop, F.lit(3)) + 4).cast("int")


def coding_density(features: DataFrame, lengths: DataFrame, key: str = "record_id", target: float = 0.9, spread: float = 0.1, exact: bool = False) -> DataFrame:
    """Per record: coding bases over length (exact: each base once) and a score exp(-pi z^2) of its distance from ``target``."""
    rows = merge_intervals(features, (key,)) if exact else features
    bases = rows.groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))
    density = F.try_divide(F.coalesce(F.col("bases"), F.lit(0)), F.col("length"))
    z = (F.col("density") - target) / spread
    return lengths.join(bases, key, "left").select(key, density.alias("density")).withColumn("score", F.exp(-F.pi() * z * z))
