"""Aligned pairs and alignment blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.blocked import running


def percent_identity(a: Column, b: Column) -> Column:
    """Matches over compared places x 100, gaps of the first sequence left out; 0 if none is compared."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    kept = F.filter(pairs, lambda p: (p["x"] != "-") & (p["x"] != ""))
    same = F.size(F.filter(kept, lambda p: p["x"] == p["y"]))
    return F.coalesce(F.try_divide(100.0 * same, F.size(kept)), F.lit(0.0))


def block_similarity(members: DataFrame, lengths: DataFrame, use_dice: bool = False) -> DataFrame:
    """(genome_a, genome_b, value): summed block length x identity over the first genome's length, or over the mean of both.

    members: (lcb, genome, seq); lengths: (genome, length). A genome with itself is 100.
    """
    a, b = members.alias("a"), members.alias("b")
    j = a.join(b, F.col("a.lcb") == F.col("b.lcb")).where(F.col("a.genome") != F.col("b.genome"))
    part = F.length("a.seq") * percent_identity(F.col("a.seq"), F.col("b.seq")) / 100.0
    total = j.groupBy(F.col("a.genome").alias("genome_a"), F.col("b.genome").alias("genome_b")).agg(F.sum(part).alias("s"))
    la, lb = lengths.toDF("genome_a", "_la"), lengths.toDF("genome_b", "_lb")
    over = (F.col("_la") + F.col("_lb")) / 2 if use_dice else F.col("_la")
    cross = total.join(la, "genome_a").join(lb, "genome_b").select("genome_a", "genome_b", (F.try_divide(F.col("s"), over) * 100).alias("value"))
    return cross.unionByName(lengths.select(F.col("genome").alias("genome_a"), F.col("genome").alias("genome_b"), F.lit(100.0).alias("value")))


def _places(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, match) of each ungapped base of the first sequence."""
    both = F.zip_with(F.split("seq_a", ""), F.split("seq_b", ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    kept = F.filter(both, lambda p: (p["x"] != "-") & (p["x"] != ""))
    return pairs.select(*keys, F.posexplode(F.transform(kept, lambda p: (p["x"] == p["y"]).cast("int"))).alias("pos", "match"))


def identity_track(pairs: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(keys, pos, identity): mean match over 2 x window places around each ungapped base of the first sequence."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-window, window - 1)
    return _places(pairs, keys).select(*keys, "pos", F.avg("match").over(w).alias("identity"))


def identity_features(pairs: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(keys, start, stop, identity): fixed-width windows, equal neighbours merged, zero left out."""
    n = _places(pairs, keys).groupBy(*keys, F.floor(F.col("pos") / window).alias("k")).agg(F.sum("match").alias("m"), F.count("*").alias("n"))
    n = n.withColumn("identity", F.round(F.col("m") / F.col("n"), 6))
    w = Window.partitionBy(*keys).orderBy("k")
    new = F.when(F.lag("identity").over(w) == F.col("identity"), 0).otherwise(1)
    runs = n.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg((F.min("k") * window).alias("start"), (F.max(F.col("k") * window + F.col("n"))).alias("stop"), F.first("identity").alias("identity"))
    return out.where("identity > 0").drop("_run")


def block_signature(blocks: DataFrame) -> DataFrame:
    """(lcb, signature, start): member genomes with strands in order of name, the same for a block and its flipped form; start on the first genome."""
    ms = F.array_sort(F.collect_list(F.struct("genome", "strand", "start")))
    b = blocks.groupBy("lcb").agg(ms.alias("ms"))
    text = lambda f: F.array_join(F.transform("ms", lambda m: F.concat(m["genome"], F.when(m["strand"] * f > 0, "+").otherwise("-"))), " ")
    return b.select("lcb", F.least(text(1), text(-1)).alias("signature"), F.get("ms", F.lit(0))["start"].alias("start"))


def block_clusters(blocks: DataFrame, distance: int) -> DataFrame:
    """(lcb, cluster): blocks of one signature chained in order of their start on the first genome; the least lcb names the chain.

    A block goes on with the chain of the one before if, for every member, its start is at most ``distance`` behind that
    block's stop on the same genome (a member that begins earlier is near). Chains are islands in that order: a block
    that is not near its predecessor begins a new one.
    """
    ms = F.array_sort(F.collect_list(F.struct("genome", "strand", "start", "stop")))  # a block's members: one a genome
    sig = block_signature(blocks).join(blocks.groupBy("lcb").agg(ms.alias("_ms")), "lcb")
    before = running(sig, ["signature"], ["start", "lcb"], {"_ends": ("last", F.transform("_ms", lambda m: m["stop"]), "before")})
    far = F.exists(F.zip_with(F.transform("_ms", lambda m: m["start"]), F.col("_ends"), lambda a, b: a - b > distance), lambda x: x)
    new = F.when(F.col("_ends").isNull() | far, 1).otherwise(0)
    runs = running(before.select("lcb", "signature", "start", new.alias("_new")), ["signature"], ["start", "lcb"], {"_run": ("sum", F.col("_new"), "upto")})
    names = runs.groupBy("signature", "_run").agg(F.min("lcb").alias("cluster"))
    return runs.join(names, ["signature", "_run"]).select("lcb", "cluster")


def merged_blocks(blocks: DataFrame, distance: int) -> DataFrame:
    """(cluster, genome, blocks, start, stop): the members of each chain of ``block_clusters`` from their least start to their largest stop."""
    return blocks.join(block_clusters(blocks, distance), "lcb").groupBy("cluster", "genome").agg(F.count("*").alias("blocks"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def block_regions(blocks: DataFrame) -> DataFrame:
    """(lcb, members, spans): blocks with more than one member, their spans as text in order of genome."""
    spans = F.array_sort(F.collect_list(F.struct("genome", "start", "stop")))
    out = blocks.groupBy("lcb").agg(F.count("*").alias("members"), spans.alias("x")).where("members > 1")
    return out.select("lcb", "members", F.array_join(F.transform("x", lambda m: F.concat_ws(":", m["genome"], m["start"].cast("string"), m["stop"].cast("string"))), ",").alias("spans"))


def block_regions_json(blocks: DataFrame) -> DataFrame:
    """(lcb, members, spans): as ``block_regions``, the spans as a JSON list."""
    spans = F.array_sort(F.collect_list(F.struct("genome", "start", "stop")))  # a block's members: one a genome
    return blocks.groupBy("lcb").agg(F.count("*").alias("members"), F.to_json(spans).alias("spans")).where("members > 1")


def backbone_edges(blocks: DataFrame) -> DataFrame:
    """(genome, source, target): successor edges of blocks along each genome, with null for the ends."""
    own = F.col("lcb")
    rows = running(blocks.select("genome", "start", "lcb"), ["genome"], ["start", "lcb"], {"before": ("last", own, "before"), "after": ("last", own, "after")})
    edges = rows.select("genome", F.col("before").alias("source"), F.col("lcb").alias("target"))
    return edges.unionByName(rows.where("after is null").select("genome", F.col("lcb").alias("source"), F.lit(None).cast(blocks.schema["lcb"].dataType).alias("target")))


def gapped_hit_features(pairs: DataFrame, keys: list[str], ignore_under: int) -> DataFrame:
    """(keys, start, stop): an aligned pair cut into parts at runs of ``ignore_under`` mismatches or more, in ungapped places of the first sequence."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = F.when(F.lag("match").over(w) == F.col("match"), 0).otherwise(1)
    runs = _places(pairs, keys).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "_run", "match").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    solid = runs.where((F.col("match") == 1) | (F.col("stop") - F.col("start") < ignore_under))
    v = Window.partitionBy(*keys).orderBy("start")
    cut = F.when(F.lag("stop").over(v) == F.col("start"), 0).otherwise(1)
    parts = solid.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "_part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("match").alias("m")).where("m = 1").drop("_part", "m")


def gapped_hit_gaps(pairs: DataFrame, keys: list[str], ignore_under: int) -> DataFrame:
    """(keys, start, stop, gap): the parts of ``gapped_hit_features`` with their columns run-length coded: M for a base on both sides, I for a base that the second sequence lacks.

    Columns that the first sequence lacks are taken away before, so there is no other letter.
    """
    both = F.zip_with(F.split("seq_a", ""), F.split("seq_b", ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    kept = F.filter(both, lambda p: (p["x"] != "-") & (p["x"] != ""))
    letters = F.array_join(F.transform(kept, lambda p: F.when(p["y"] == "-", "I").otherwise("M")), "")
    lined = gapped_hit_features(pairs, keys, ignore_under).join(pairs.select(*keys, letters.alias("_letters")), keys)
    part = F.substring("_letters", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    runs = F.transform(F.regexp_extract_all(part, F.lit("M+|I+"), F.lit(0)), lambda r: F.concat(F.left(r, F.lit(1)), F.length(r).cast("string")))
    return lined.select(*keys, "start", "stop", F.array_join(runs, " ").alias("gap"))


def start_track(reads: DataFrame) -> DataFrame:
    """(record_id, strand, pos, n): read starts counted: a forward read starts at pos, a reverse one at its aligned end."""
    return reads.groupBy("record_id", "strand", F.when(F.col("strand") > 0, F.col("start")).otherwise(F.col("stop")).alias("pos")).agg(F.count("*").alias("n"))


#: Places in a block of a filled track.
_TRACK_BLOCK = 1 << 12


def fill_track(track: DataFrame, lengths: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, pos, n) with zeros filled in from 0 to length - 1.

    Records are cut into blocks of places that meet the track's counts of the same block; the places become rows after
    that, so they are not shuffled.
    """
    top = F.col("length").cast("long")
    blocks = lengths.where(top > 0).select(key, top.alias("_top"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((top - 1) / _TRACK_BLOCK))).alias("_block"))
    counts = track.where("pos >= 0").groupBy(key, F.col("pos").cast("long").alias("pos")).agg(F.sum("n").cast("long").alias("n"))
    counts = counts.groupBy(key, F.floor(F.col("pos") / _TRACK_BLOCK).alias("_block")).agg(F.collect_list(F.struct("pos", "n")).alias("_x"))  # at most a block's places
    rows = blocks.join(counts, [key, "_block"], "left").select(key, "_block", "_top", F.col("_x.pos").alias("_at"), F.col("_x.n").alias("_n"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                lo = part.column("_block").to_numpy() * _TRACK_BLOCK
                size = np.minimum(lo + _TRACK_BLOCK, part.column("_top").to_numpy()) - lo
                begin = np.cumsum(size) - size
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(row)) + (lo - begin)[row]
                n = np.zeros(len(row), np.int64)
                own = part.column("_at").value_lengths().fill_null(0).to_numpy()
                of = np.repeat(np.arange(len(size)), own)
                at, told = part.column("_at").flatten().to_numpy() - lo[of], part.column("_n").flatten().to_numpy()
                inside = at < size[of]
                n[(begin[of] + at)[inside]] = told[inside]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array(pos), pa.array(n)], names=[key, "pos", "n"])

    return rows.mapInArrow(fill, f"`{key}` {dict(rows.dtypes)[key]}, pos long, n long")


def contig_coverage(depth: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, mean, deviation) of depth from sums and sums of squares."""
    s, q, n = F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count("*")
    return depth.groupBy(key).agg((s / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), q / n - F.pow(s / n, 2))).alias("deviation"))
