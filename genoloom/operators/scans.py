"""Scans that turn sequences into rows: open reading frames, motifs, hydrophobic domains, frame statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import codon as C
from genoloom.functions import sequence as S
from genoloom.operators.qc import bounds_in_frame
from genoloom.session import spread

#: Shine-Dalgarno motifs, longest first.
SD_MOTIFS = ("AGGAGGT", "GGAGGT", "AGGAGG", "GGGGGG", "AGGAG", "GAGGT", "GGAGG", "GGGGG", "AGGT", "GGGT", "GAGG", "GGGG", "AGGA", "GGAG", "GGA", "GAG", "AGG", "GGT", "GGG")
#: Residue classes of the scans.
HYDROPHOBIC = "FIWLVMYCATGSP"
NEUTRAL = "FIWLVMYCATGS"
LS_NEUTRAL = "AGVLIPFHSTYCMWQN"
LIPOBOXES = ("[ILMFTV][^REKD][GAS]C", "AW[AGS]C")


_BLOCK = 256


def _gaps_and_hits(seq: Column, pattern: str) -> tuple[Column, Column]:
    """What stands around the matches of a pattern, and the matches: one text more than matches."""
    return F.split(seq, pattern, -1), F.regexp_extract_all(seq, F.lit(pattern), F.lit(0))


def match_texts(seq: Column, pattern: str) -> Column:
    """Non-overlapping matches as array<struct<start, stop, hit>> (0-based, half-open). The pattern must not match nothing.

    Running lengths of the texts around the matches and of the matches are the places; they are summed in blocks, so that
    a long sequence with very many matches copies no long array for each.
    """
    gaps, hits = _gaps_and_hits(seq, pattern)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), h.alias("hit")))
    places = "array<struct<start:int,stop:int,hit:string>>"

    def place(at: Column, x: Column) -> Column:
        return F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["h"]).alias("stop"), x["hit"].alias("hit"))

    def block(at: Column, part: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast(places).alias("out"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["at"] + x["g"] + x["h"]).alias("at"), F.concat(a["out"], F.array(place(a["at"], x))).alias("out")))

    def blocks(xs: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_BLOCK)), lambda i: i <= F.size(xs))
        return F.transform(firsts, lambda i: F.slice(xs, i, F.lit(_BLOCK)))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{places}>").alias("out"))
    step = lambda a, part: F.get(F.transform(F.array(block(a["at"], part)), lambda w: F.struct(w["at"].alias("at"), F.concat(a["out"], F.array(w["out"])).alias("out"))), F.lit(0))
    # The pairs are bound to one name, so that the pattern runs once.
    return F.flatten(F.get(F.transform(F.array(pairs), lambda xs: F.aggregate(blocks(xs), zero, step, lambda a: a["out"])), F.lit(0)))


def matches(seq: Column, pattern: str) -> Column:
    """The places of ``match_texts`` as array<struct<start, stop>>."""
    return F.transform(match_texts(seq, pattern), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop")))


def regex_search(seqs: DataFrame, pattern: str) -> DataFrame:
    """(seq_id, start, stop, hit): one row a non-overlapping match."""
    return seqs.select("seq_id", F.explode(match_texts(F.col("seq"), pattern)).alias("m")).select("seq_id", "m.start", "m.stop", "m.hit")


def regex_marked(seqs: DataFrame, pattern: str) -> DataFrame:
    """(seq_id, seq): sequences with a match, upper case in the matches of the upper-cased sequence and lower case elsewhere."""
    gaps, hits = _gaps_and_hits(F.upper("seq"), pattern)
    text = F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(F.lower(g), F.coalesce(h, F.lit("")))), "")
    return seqs.where(F.upper("seq").rlike(pattern)).select("seq_id", text.alias("seq"))


def restriction_sites(seqs: DataFrame, enzymes: dict[str, str]) -> DataFrame:
    """(seq_id, enzyme, strand, n): how often each IUPAC recognition sequence is found on either strand; palindromes count once."""
    out = None
    for name, site in sorted(enzymes.items()):
        pattern = "".join(S.IUPAC_CLASS.get(c, c) for c in site)
        flipped = site[::-1].translate(str.maketrans(S.IUPAC, S.COMPLEMENT))
        strands = [(1, pattern)] + ([(-1, "".join(S.IUPAC_CLASS.get(c, c) for c in flipped))] if flipped != site else [])
        for strand, p in strands:
            one = seqs.select("seq_id", F.lit(name).alias("enzyme"), F.lit(strand).alias("strand"), F.regexp_count("seq", F.lit(p)).cast("long").alias("n"))
            out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


#: Text of reading frames that is gathered before it leaves a task's kernel, in characters.
_ORF_TEXT = 1 << 23


def _codes(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stop, start and residue of a codon, by 25 a + 5 b + c of its bases' codes; 4 stands for what is no base."""
    table = C.table(number)
    codons = ["".join("ACGT?"[k] for k in (i // 25, i // 5 % 5, i % 5)) for i in range(125)]
    return np.array([c in C.stops(number) for c in codons]), np.array([c in C.STARTS[number] for c in codons]), np.array([ord(table.get(c, "X")) for c in codons], np.uint8)


def orf_rows(seqs: DataFrame, number: int, min_len: int, strand: str, texts: tuple[str, ...]) -> DataFrame:
    """(seq_id, start, stop, strand, length) and the named texts (dna, protein) of the reading frames of ``orf_scan``.

    A frame's codons are numbers, its stops and starts are sought in one pass each, and a start's stop is the next one
    behind it. A frame is translated once, and what begins in it is cut out of its text; nothing is shuffled.
    """
    ways = {"both": (1, -1), "forward": (1,), "reverse": (-1,)}[strand]
    is_stop, is_start, residue = _codes(number)
    base = np.full(256, 4, np.int16)
    base[list(b"ACGT")] = range(4)
    flip = str.maketrans(S.IUPAC, S.COMPLEMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, found, size = [], [], {t: [] for t in texts}, 0

            def out() -> pa.RecordBatch:
                told = np.concatenate(numbers, axis=1).astype(np.int32)
                return pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(np.concatenate(rows))), *map(pa.array, told), *(pa.array(found[t], pa.string()) for t in texts)], names=["seq_id", "start", "stop", "strand", "length", *texts])

            for row, (seq, length) in enumerate(zip(batch.column("s"), batch.column("len"))):
                if seq.as_py() is None:
                    continue
                n = length.as_py()
                for way in ways:
                    s = seq.as_py() if way > 0 else seq.as_py().translate(flip)[::-1]
                    codes = base[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
                    for f in range(3):
                        k = max(len(s) - f, 0) // 3
                        v = codes[f : f + 3 * k].reshape(k, 3) @ np.array([25, 5, 1], np.int16)
                        stops, starts = np.flatnonzero(is_stop[v]), np.flatnonzero(is_start[v])
                        at = np.searchsorted(stops, starts)
                        first, last = starts[at < len(stops)], stops[at[at < len(stops)]]
                        keep = last - first + 1 >= min_len
                        first, last = first[keep], last[keep]
                        lo, hi = f + 3 * first, f + 3 * last + 3
                        protein = residue[v].tobytes().decode("ascii") if len(first) and "protein" in texts else ""
                        for i in range(0, len(first), 1024):
                            part = slice(i, i + 1024)
                            a, b = lo[part], hi[part]
                            rows.append(np.full(len(a), row))
                            numbers.append(np.array([a if way > 0 else n - b, b if way > 0 else n - a, np.full(len(a), way), (b - a) // 3]))
                            if "dna" in texts:
                                found["dna"] += [s[x:y] for x, y in zip(a.tolist(), b.tolist())]
                            if "protein" in texts:
                                found["protein"] += [protein[x : y + 1] for x, y in zip(first[part].tolist(), last[part].tolist())]
                            size += int((b - a).sum())
                            if size >= _ORF_TEXT:
                                yield out()
                                rows, numbers, found, size = [], [], {t: [] for t in texts}, 0
            if rows:
                yield out()

    kind = seqs.schema["seq_id"].dataType.simpleString()
    rows = spread(seqs).select("seq_id", F.upper("seq").alias("s"), F.length("seq").alias("len"))
    return rows.mapInArrow(run, ", ".join([f"seq_id {kind}, start int, stop int, strand int, length int", *(f"{t} string" for t in texts)]))


def orf_scan(seqs: DataFrame, number: int = 11, min_len: int = 30, strand: str = "both", with_sequence: bool = True) -> DataFrame:
    """(seq_id, start, stop, strand, length, dna, protein): every in-frame start before each stop is a reading frame of its own; min_len counts residues with the stop."""
    return orf_rows(seqs, number, min_len, strand, ("dna", "protein") if with_sequence else ())


def sd_scan(genes: DataFrame, seqs: DataFrame, least: int = 3, most: int = 17, top_only: bool = True, key: str = "record_id") -> DataFrame:
    """(feature_id, motif, gap, start, stop): ranked motifs upstream of each coding feature, longest then nearest; the best or all.

    The window reaches from ``least`` to ``most`` + 7 bases before the start, by strand; a motif counts if the gap between it
    and the start is within [least, most]. What of the window lies before the record holds no base.
    """
    plus = F.col("strand") > 0
    lo = F.when(plus, F.col("start") - most - 7).otherwise(F.col("stop") + least)
    hi = F.when(plus, F.col("start") - least).otherwise(F.col("stop") + most + 7)
    rows = genes.join(seqs.select(F.col("seq_id").alias(key), "seq"), key).withColumn("w", bounds_in_frame(lo, hi, F.length("seq").cast("long")))
    first, end = F.greatest(F.least("w.start", "w.stop"), F.lit(0)), F.greatest("w.start", "w.stop")
    piece = F.substring("seq", first.cast("int") + 1, (end - first).cast("int"))
    rows = rows.select("feature_id", "start", "stop", "strand", F.when(plus, piece).otherwise(S.reverse_complement(piece)).alias("up"))

    def of(m: str) -> Column:
        places = F.when(F.col("up").contains(m), matches(F.col("up"), m))  # most windows lack most motifs
        hit = lambda x: F.struct(F.lit(-len(m)).alias("rank"), (F.length("up") - x["stop"]).alias("spacing"), F.lit(m).alias("motif"))
        return F.coalesce(F.transform(places, hit), F.array().cast("array<struct<rank:int,spacing:int,motif:string>>"))

    found = F.flatten(F.array(*map(of, SD_MOTIFS)))
    rows = rows.withColumn("hits", F.array_sort(F.filter(found, lambda h: h["spacing"] + least <= most)))
    # Not explode: Spark then filters by the size of hits, with the whole window written out in place of each ``up``.
    hit = F.explode_outer(F.slice("hits", 1, 1) if top_only else F.col("hits")).alias("h")
    rows = rows.select("feature_id", "start", "stop", "strand", hit).where("h is not null")
    gap, size = F.col("h.spacing") + least, -F.col("h.rank")
    begin = F.when(plus, F.col("start") - gap - size).otherwise(F.col("stop") + gap)
    return rows.select("feature_id", F.col("h.motif").alias("motif"), gap.alias("gap"), begin.alias("start"), (begin + size).alias("stop"))


def add_sd(genes: DataFrame, children: DataFrame, seqs: DataFrame, least: int = 3, most: int = 17, key: str = "record_id") -> DataFrame:
    """(record, type, start, stop, strand, feature_id, parent): genes without a binding site among their children gain the best upstream motif as one and are widened over it; other genes stay.

    children: (type, parent).
    """
    has = children.where(F.col("type").isin("RBS", "Shine_Dalgarno_sequence")).select(F.col("parent").alias("feature_id")).distinct()
    found = sd_scan(genes.join(has, "feature_id", "left_anti"), seqs, least, most, key=key).select("feature_id", F.col("start").alias("_s"), F.col("stop").alias("_e"))
    out = genes.join(found, "feature_id", "left").select(key, "type", F.coalesce(F.least("start", "_s"), "start").alias("start"), F.coalesce(F.greatest("stop", "_e"), "stop").alias("stop"), "strand", "feature_id", F.lit(None).cast("string").alias("parent"), "_s", "_e")
    site = F.struct(F.lit("Shine_Dalgarno_sequence").alias("type"), F.col("_s").alias("start"), F.col("_e").alias("stop"), F.concat("feature_id", F.lit(".rbs")).alias("feature_id"), F.col("feature_id").alias("parent"))
    own = F.struct("type", "start", "stop", "feature_id", "parent")
    rows = F.explode(F.when(F.col("_s").isNull(), F.array(own)).otherwise(F.array(own, site))).alias("x")
    return out.select(key, "strand", rows).select(key, "x.type", "x.start", "x.stop", "strand", "x.feature_id", "x.parent")


def lipobox_scan(proteins: DataFrame, least: int = 10, most: int = 40) -> DataFrame:
    """(seq_id, box, at): proteins that match a box which begins ``least`` to ``most`` residues from the start; at is the 0-based place of its last residue's end, the first box that fits wins."""
    out = F.lit(None).cast("struct<box:int,hit:string>")
    for i, p in reversed(list(enumerate(LIPOBOXES))):
        pattern = f"^.{{{least},{most}}}{p}"
        out = F.when(F.col("seq").rlike(pattern), F.struct(F.lit(i).alias("box"), F.regexp_extract("seq", pattern, 0).alias("hit"))).otherwise(out)
    return proteins.withColumn("_x", out).where("_x is not null").select("seq_id", F.col("_x.box").alias("box"), F.length("_x.hit").alias("at"))


def lipobox_features(features: DataFrame, found: DataFrame) -> DataFrame:
    """(feature_id, start, stop, strand): the four codons of each box of ``lipobox_scan`` on the record; found: (seq_id = feature_id, at)."""
    rows = features.join(found.select(F.col("seq_id").alias("feature_id"), "at"), "feature_id")
    start = F.when(F.col("strand") > 0, F.col("start") + 3 * (F.col("at") - 4)).otherwise(F.col("stop") - 3 * F.col("at"))
    return rows.select("feature_id", start.alias("start"), (start + 12).alias("stop"), "strand")


def lipobox_window(proteins: DataFrame, least: int = 10, most: int = 50, least_after: int = 30, most_after: int = 185, boxes: tuple[str, ...] = LIPOBOXES) -> DataFrame:
    """(seq_id, after): proteins with a box in the window and a fitting number of residues from it on; boxes are tried in order."""
    region = F.substring("seq", least, most + 6 - least)
    out = F.lit(None).cast("int")
    for p in reversed(boxes):
        stop = F.regexp_instr(F.col("seq"), F.concat(F.lit("\\Q"), F.regexp_extract(region, p, 0), F.lit("\\E")), F.lit(0)) + F.length(F.regexp_extract(region, p, 0)) - 1
        after = F.length("seq") - stop + 1
        out = F.when(region.rlike(p) & after.between(least_after, most_after), after).otherwise(out)
    return proteins.withColumn("after", out).where("after is not null").select("seq_id", "after")


def tmd_scan(proteins: DataFrame, least: int = 10, most: int = 30, size_least: int = 10, size_most: int = 20, first_size_only: bool = False, periplasm: tuple[int, int] | None = None) -> DataFrame:
    """(seq_id, size): proteins with a run of hydrophobic residues of a size near the start; the longest size that fits, or the first.

    With ``periplasm`` the residues after the run, counted from its first place in the protein, must lie within it.
    """
    region = F.substring("seq", least, F.least(F.lit(most), F.length("seq")) + 2 - least)
    sizes = [size_least] if first_size_only else range(size_most, size_least - 1, -1)
    out = F.lit(None).cast("int")
    for n in reversed(list(sizes)):
        pattern = f"[{HYDROPHOBIC}]{{{n}}}"
        fits = region.rlike(pattern)
        if periplasm:
            fits &= (F.length("seq") - (F.position(F.regexp_extract(region, pattern, 0), "seq") + n)).between(*periplasm)
        out = F.when(fits, n).otherwise(out)
    return proteins.withColumn("size", out).where("size is not null").select("seq_id", "size")


def sar_scan(proteins: DataFrame, least: int = 15, most: int = 20, residues: str = "SGAT", head: int = 50) -> DataFrame:
    """(seq_id, start, size, charge, shares): windows in the first residues that are hydrophobic but for a lysine at one end; of three or more sizes at one start the shortest and the longest stay."""
    first = F.substring("seq", 1, head)

    def of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(first) - n - 1, F.lit(0))), lambda i: F.length(first) - n > 0)
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("size")))

    at = F.explode(F.flatten(F.array(*map(of, range(least, most))))).alias("w")
    rows = proteins.select("seq_id", first.alias("head"), at).select("seq_id", "head", "w.start", "w.size", F.substring("head", F.col("w.start") + 1, F.col("w.size")).alias("win"))
    ok = F.col("win").rlike(f"^(?:[{HYDROPHOBIC}]+|K[{HYDROPHOBIC}]+|[{HYDROPHOBIC}]+K)$")
    before = F.substring("head", F.lit(1), F.col("start"))
    hit = rows.where(ok).withColumn("charge", S.count_of(before, "RK") - S.count_of(before, "DE"))
    w = Window.partitionBy("seq_id", "start")
    hit = hit.withColumn("_n", F.count("*").over(w)).withColumn("_lo", F.min("size").over(w)).withColumn("_hi", F.max("size").over(w))
    share = F.round(100.0 * S.count_of(F.col("win"), residues) / F.col("size"), 2)
    return hit.where("_n < 3 or size = _lo or size = _hi").select("seq_id", "start", "size", "charge", share.alias("share"))


def transmembrane_scan(proteins: DataFrame) -> DataFrame:
    """(seq_id, start, stop): merged windows of 16 residues whose middle ten are neutral and whose ends are neutral or lysine."""
    window = f"[{NEUTRAL}K]{{3}}[{NEUTRAL}]{{10}}[{NEUTRAL}K]{{3}}"
    # Only runs of allowed residues can hold a window; windows are sought inside those runs.
    run = F.explode(match_texts(F.col("seq"), f"[{NEUTRAL}K]{{16,}}")).alias("r")
    rows = proteins.where(F.col("seq").rlike(window)).select("seq_id", run).select("seq_id", F.col("r.start").alias("at"), F.col("r.hit").alias("run"))
    starts = F.filter(F.sequence(F.lit(0), F.length("run") - 16), lambda i: F.substring(F.col("run"), i + 1, F.lit(16)).rlike(f"^{window}$"))
    rows = rows.select("seq_id", "at", F.explode(starts).alias("i")).select("seq_id", (F.col("at") + F.col("i")).alias("start"))
    w = Window.partitionBy("seq_id").orderBy("start")
    new = F.when(F.col("start") - F.lag("start").over(w) <= 16, 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("seq_id", "_run").agg(F.min("start").alias("start"), (F.max("start") + 16).alias("stop")).drop("_run")


def hydrophobic_ls_scan(proteins: DataFrame, below: int = 150, least_charge: int = 2) -> DataFrame:
    """(seq_id, start, stop): short proteins with a run of ten or more neutral residues that ends in LS (or is cut there with at least eight before it), after a charge of two or more."""
    run = F.explode(match_texts(F.col("seq"), f"[{LS_NEUTRAL}]{{10,}}")).alias("r")
    rows = proteins.where(F.length("seq") < below).select("seq_id", "seq", run).select("seq_id", "seq", F.col("r.start").alias("start"), F.col("r.hit").alias("d"))
    cut = F.regexp_extract("d", "^(.*LS)", 1)
    rows = rows.withColumn("n", F.length(cut)).where((F.col("n") > 0) & ((F.col("n") == F.length("d")) | (F.col("n") >= 10)))
    before = F.substring("seq", F.lit(1), F.col("start"))
    return rows.where(S.count_of(before, "RK") - S.count_of(before, "DE") >= least_charge).select("seq_id", "start", (F.col("start") + F.col("n")).alias("stop"))


def gc_frame(seqs: DataFrame, window: int = 120) -> DataFrame:
    """(seq_id, pos, frame, gc): for each base, the G and C among the bases of its codon position within window / 3 steps around it.

    Sequences are cut into overlapping slices, and a slice into the texts of its three codon positions, before bases become
    rows: nothing is shuffled and a chromosome is no single task.
    """
    half, steps = window // 6, 512
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(3 * steps))).alias("at")
    cut = seqs.where(F.length("seq") > 0).select("seq_id", F.col("seq").cast("binary").alias("b"), F.length("seq").alias("len"), at)
    skip = F.least(F.lit(half), F.floor(F.col("at") / 3).cast("int"))
    part = F.substring("b", F.col("at") - 3 * skip + 1, 3 * (skip + F.lit(steps + half))).cast("string")
    cut = cut.select("seq_id", "len", "at", skip.alias("skip"), part.alias("part"))
    third = lambda f: F.regexp_replace(F.substring("part", f + 1, 1 << 30), "(?s)(.).{0,2}", "$1")
    frames = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), third(f).alias("s")) for f in range(3)))).alias("x")
    cut = cut.select("seq_id", "len", "at", "skip", frames).select("seq_id", "len", "at", "skip", "x.f", "x.s")
    steps_here = F.least(F.lit(steps), F.ceil((F.col("len") - F.col("at") - F.col("f")) / 3).cast("int"))
    rows = cut.where(steps_here > 0).select("seq_id", "at", "skip", "f", "s", F.explode(F.sequence(F.lit(0), steps_here - 1)).alias("i"))
    mid = F.col("skip") + F.col("i")
    around = F.substring("s", F.greatest(mid - half, F.lit(0)) + 1, F.least(mid, F.lit(half)) + half)
    pos = (F.col("at") + F.col("f") + 3 * F.col("i")).cast("long")
    return rows.select("seq_id", pos.alias("pos"), (F.col("f") + 1).alias("frame"), S.count_of(around, "GC").cast("long").alias("gc"))


def orf_background_score(orfs: DataFrame, seqs: DataFrame, start_weights: dict[str, float]) -> DataFrame:
    """(seq_id, start, stop, p_stop, score): the chance of a stop codon by a sequence's base shares, and a reading frame's score, 1 / (1 - p_stop) ** residues times its start's weight, as a logarithm."""
    n = F.greatest(F.length("seq"), F.lit(1))
    share = lambda x: S.count_of(F.col("seq"), x) / n
    p = share("T") * share("A") * share("A") + share("T") * share("A") * share("G") + share("T") * share("G") * share("A")
    back = seqs.select("seq_id", p.alias("p_stop"))
    weight = F.coalesce(F.try_element_at(C.mapping({k: float(v) for k, v in start_weights.items()}), F.substring("dna", 1, 3)), F.lit(1e-3))
    return orfs.join(back, "seq_id").select("seq_id", "start", "stop", "strand", "p_stop", (-F.col("length") * F.log(1 - F.col("p_stop")) + F.log(weight)).alias("score"))


def slippery_score(site: Column) -> Column:
    """4 less the different bases beyond one in each half of six bases."""
    kinds = lambda s: F.size(F.array_distinct(F.split(s, "")))
    return F.lit(4) + (1 - kinds(F.substring(site, 1, 3))) + (1 - kinds(F.substring(site, 4, 3)))


def frameshift_scan(cds: DataFrame, reach: int = 60, shifts: tuple[int, ...] = (-2, -1, 1, 2), number: int = 11) -> DataFrame:
    """(feature_id, at, shift, score): six-base windows in the last ``reach`` bases whose peptide a slip leaves within one residue and whose bases it leaves within five.

    cds: (feature_id, seq, rest), rest: the bases after the coding sequence on its strand. The slipped frame must stay open
    for at least half the coding sequence's residues.
    """
    n = F.length("seq")
    over = F.least(n, F.lit(reach)) - F.least(n, F.lit(reach)) % 3
    at = F.explode(F.when(n >= 12, F.sequence(F.greatest(n - over, F.lit(9)), n - 3, F.lit(3)))).alias("at")
    rows = cds.select("feature_id", "seq", F.concat("seq", "rest").alias("all"), at).select("*", F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    here, there = F.substring("all", F.col("at") - 5, F.lit(6)), F.substring("all", F.col("at") - 5 + F.col("shift"), F.lit(6))
    rows = rows.withColumn("here", here).withColumn("there", there).where(F.levenshtein("here", "there") <= 5)
    pep = lambda s: S.translate(s, number, to_stop=False, start_as_m=False)
    rows = rows.where(F.levenshtein(pep(F.col("here")), pep(F.col("there"))) <= 1)
    tail = F.substring("all", F.col("at") - 5 + F.col("shift"), F.length("all"))
    open_codons = F.array_position(F.transform(S.codon_list(tail), lambda c: c.isin(*C.stops(number))), True)
    length = F.when(open_codons > 0, open_codons - 1).otherwise(F.floor(F.length(tail) / 3))
    return rows.where(length >= F.length("seq") / 6).select("feature_id", "at", "shift", (4 + slippery_score(F.col("there"))).alias("score"))
