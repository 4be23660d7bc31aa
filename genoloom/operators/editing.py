"""Cutting, joining and rewriting whole records, and tables composed of several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import codon as C
from genoloom.functions import sequence as S
from genoloom.operators import features as T
from genoloom.operators import intervals as I  # noqa: E741
from genoloom.operators import scans as X
from genoloom.operators.blocked import running
from genoloom.operators.qc import bounds_in_frame, qc_missing_rbs
from genoloom.session import materialize


def safe_rotate(seqs: DataFrame, features: DataFrame, position: int, key: str = "record_id") -> DataFrame:
    """(record, at, seq): each sequence rotated to the middle of the gap between features that is nearest to a position; records without a gap stay."""
    middle = I.gaps(features, (key,)).select(key, F.floor((F.col("start") + F.col("stop")) / 2).alias("at"))
    near = middle.groupBy(key).agg(F.min_by("at", F.struct(F.abs(F.col("at") - position), F.col("at"))).alias("at"))
    out = seqs.select(F.col("seq_id").alias(key), "seq").join(near, key, "left")
    return out.select(key, "at", S.rotate(F.col("seq"), F.coalesce("at", F.lit(0)).cast("int")).alias("seq"))


def safe_reopen(seqs: DataFrame, features: DataFrame, position: int, strand: int = 0, key: str = "record_id", ignored: tuple[str, ...] = ("remark", "DNA", "annotation")) -> DataFrame:
    """(record, at, from_end, seq): each sequence opened in the middle of a gap between features, or between the last one and the record's end.

    The gap that holds ``position`` is taken; else the nearest one before it for a plus ``strand``, behind it otherwise.
    position -1 asks for the first gap of the record, -2 for the last one. With strand -1 the opened sequence is turned. Records
    without such a gap stay as they are, at null; so do those without features. Features that only touch leave no gap.
    """
    lengths = seqs.select(F.col("seq_id").alias(key), F.length("seq").cast("long").alias("_n"))
    used = features.where(~F.col("type").isin(*ignored)) if "type" in features.columns else features
    spans = used.select(key, "start", "stop")
    end = lengths.join(spans.select(key).distinct(), key, "left_semi").select(key, F.col("_n").alias("start"), (F.col("_n") + 1).alias("stop"))
    free = I.gaps(spans.unionByName(end), (key,))
    middle = F.floor((F.col("start") + F.col("stop")) / 2)
    if position in (-1, -2):
        order = F.col("start") if position == -1 else -F.col("start")
    else:
        holds = (F.col("start") < position) & (position < F.col("stop"))
        near = F.col("stop") < position if strand > 0 else F.col("start") > position
        away = position - F.col("stop") if strand > 0 else F.col("start") - position
        free, order = free.where(holds | near), F.when(holds, -1).otherwise(away)
    best = free.groupBy(key).agg(F.min_by(middle, F.struct(order, F.col("start"))).alias("at"))
    out = seqs.select(F.col("seq_id").alias(key), "seq").join(best, key, "left")
    opened = S.rotate(F.col("seq"), F.coalesce("at", F.lit(0)).cast("int"))
    if strand == -1:
        opened = F.when(F.col("at").isNotNull(), S.reverse_complement(opened)).otherwise(opened)
    return out.select(key, "at", (F.length("seq") - F.col("at")).alias("from_end"), opened.alias("seq"))


def subsection(features: DataFrame, cuts: DataFrame, key: str = "record_id") -> DataFrame:
    """(cut, feature_id, start, stop): features wholly inside a cut (cut, record, start, stop), shifted to its start. Bins are as wide as cuts, so a cut is in few."""
    met = I.overlap_join(features.select(key, "start", "stop", "feature_id"), cuts.select(key, "start", "stop", "cut"), key, width=I.bin_width(cuts))
    inside = met.where((F.col("b_start") <= F.col("start")) & (F.col("stop") <= F.col("b_stop")))
    return inside.select(F.col("b_cut").alias("cut"), "feature_id", (F.col("start") - F.col("b_start")).alias("start"), (F.col("stop") - F.col("b_start")).alias("stop"))


def cut_sequences(seqs: DataFrame, cuts: DataFrame, key: str = "record_id") -> DataFrame:
    """(cut, seq): the bases of each cut."""
    out = seqs.select(F.col("seq_id").alias(key), "seq").join(cuts, key)
    return out.select("cut", F.substring("seq", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int")).alias("seq"))


def section_by_locus(features: DataFrame, first: str, last: str, key: str = "record_id") -> DataFrame:
    """(record, start, stop): the stretch from one feature to another of the same record."""
    ends = features.where(F.col("feature_id").isin(first, last)).groupBy(key).agg(F.count_distinct("feature_id").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return ends.where(F.col("n") == (1 if first == last else 2)).drop("n")


def section_by_qualifier(features: DataFrame, predicate: Column, ahead: int, behind: int, lengths: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, start, stop): merged features that pass, padded by strand and kept inside their record."""
    plus = F.col("strand") > 0
    lo = F.when(plus, F.col("start") - ahead).otherwise(F.col("start") - behind)
    hi = F.when(plus, F.col("stop") + behind).otherwise(F.col("stop") + ahead)
    hit = features.where(predicate).join(lengths, key)
    padded = hit.select(key, F.greatest(lo, F.lit(0)).alias("start"), F.least(hi, F.col("length")).alias("stop"))
    return I.merge_intervals(padded, (key,))


def one_step_codons(seqs: DataFrame, targets: list[str], number: int = 11) -> DataFrame:
    """(seq_id, pos, codon, count): in-frame codons one base away from a codon of a target residue, with a running count.

    The 64 codons' neighbours are a literal map, so no join is needed.
    """
    table = C.table(number)
    near = {c: any(table[o] in targets and sum(x != y for x, y in zip(c, o)) == 1 for o in table) for c in table}
    rows = seqs.select("seq_id", F.posexplode(S.codon_list(F.col("seq"))).alias("pos", "codon")).where(F.coalesce(F.try_element_at(C.mapping(near), "codon"), F.lit(False)))
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("seq_id", F.col("pos").cast("long").alias("pos"), "codon", F.count("*").over(w).alias("count"))


def edit_genome(seqs: DataFrame, changes: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, seq, chain): a new sequence from an ordered list of pieces (record, n, start, stop, strand, insert); inserts stand for themselves.

    chain lists where each piece lies in the new sequence.
    """
    pieces = changes.join(seqs.select(F.col("seq_id").alias(key), "seq"), key)
    part = F.substring("seq", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    own = F.coalesce(F.col("insert"), F.when(F.col("strand") < 0, S.reverse_complement(part)).otherwise(part))
    w = Window.partitionBy(key).orderBy("n")
    at = F.coalesce(F.sum(F.length(own)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.select(key, "n", own.alias("s"), at.alias("at"))
    parts = F.sort_array(F.collect_list(F.struct("n", "s", "at")))
    chain = F.array_join(F.transform("x", lambda p: F.concat_ws(":", p["n"].cast("string"), p["at"].cast("string"), F.length(p["s"]).cast("string"))), ",")
    return rows.groupBy(key).agg(parts.alias("x")).select(key, F.array_join(F.transform("x", lambda p: p["s"]), "").alias("seq"), chain.alias("chain"))


def edit_map(changes: DataFrame, lengths: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, n, start, stop, strand, at, size): where each piece of an ordered change list lies in the new sequence.

    changes: (record, n, start, stop, strand, insert); lengths: (record, length). Pieces are clipped to their record; an
    insert has no place of its own (start and stop null) but its size moves what follows.
    """
    lo, hi = F.greatest("start", F.lit(0)), F.least("stop", "length")
    insert = F.col("insert").isNotNull()
    size = F.when(insert, F.length("insert")).otherwise(F.greatest(hi - lo, F.lit(0))).cast("long")
    rows = changes.join(lengths.select(key, "length"), key).select(key, "n", F.when(~insert, lo).cast("long").alias("start"), F.when(~insert, hi).cast("long").alias("stop"), "strand", size.alias("size"))
    return running(rows, [key], ["n"], {"at": ("sum", F.col("size"), "before")}).select(key, "n", "start", "stop", "strand", "at", "size")


def edit_chain(changes: DataFrame, lengths: DataFrame, new_id: str, key: str = "record_id") -> DataFrame:
    """(record, n, start, stop, strand, new_record, new_start, new_stop, new_strand): the pieces of an edited genome, both sides counted from 1."""
    m = edit_map(changes, lengths, key).where("start is not null")
    sign = F.when(F.col("strand") < 0, "-").otherwise("+")
    return m.select(key, "n", (F.col("start") + 1).alias("start"), "stop", sign.alias("strand"), F.lit(new_id).alias("new_record"), (F.col("at") + 1).alias("new_start"), (F.col("at") + F.col("size")).alias("new_stop"), F.lit("+").alias("new_strand"))


def edit_features(features: DataFrame, changes: DataFrame, lengths: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, n, feature_id, type, start, stop, strand): features in an edited genome.

    A top feature that lies wholly in a piece comes along with all that is below it, moved to the piece's new place, turned
    and its strand changed where the piece is; one that a piece cuts is left out there, and one in several pieces comes once
    for each. features: (record, feature_id, parent, type, start, stop, strand); a child need not lie in its parent.
    """
    m = edit_map(changes, lengths, key).where("stop > start")
    tops = features.where("parent is null")
    pieces = m.select(key, "start", "stop", "n", F.coalesce(F.col("strand"), F.lit(1)).alias("turn"), "at")
    met = I.overlap_join(tops.select(key, "start", "stop", F.col("feature_id").alias("root")), pieces, key).where("b_start <= start and stop <= b_stop")
    met = met.select("root", F.col("b_n").alias("n"), F.col("b_start").alias("_lo"), F.col("b_stop").alias("_hi"), F.col("b_turn").alias("_turn"), F.col("b_at").alias("_at"))
    family = T.descendants(features, tops).select("root", "feature_id").unionByName(tops.select(F.col("feature_id").alias("root"), "feature_id"))
    rows = features.join(family, "feature_id").join(met, "root")
    turned = F.col("_turn") < 0
    start = F.when(turned, F.col("_at") + F.col("_hi") - F.col("stop")).otherwise(F.col("_at") + F.col("start") - F.col("_lo"))
    stop = F.when(turned, F.col("_at") + F.col("_hi") - F.col("start")).otherwise(F.col("_at") + F.col("stop") - F.col("_lo"))
    return rows.select(key, "n", "feature_id", "type", start.alias("start"), stop.alias("stop"), F.when(turned, -F.col("strand")).otherwise(F.col("strand")).alias("strand"))


def add_terminal_repeat(features: DataFrame, repeat_end: int, lengths: DataFrame, key: str = "record_id") -> DataFrame:
    """Features, and copies of those inside [0, repeat_end) shifted behind the record's end, their ids marked."""
    copy = features.where(F.col("stop") <= repeat_end).join(lengths, key)
    copy = copy.withColumns({"start": F.col("start") + F.col("length"), "stop": F.col("stop") + F.col("length"), "feature_id": F.concat("feature_id", F.lit(".tr"))}).drop("length")
    return features.unionByName(copy)


def suppress_stops(cds: DataFrame, suppressed: str, reach: int = 40, number: int = 11) -> DataFrame:
    """(feature_id, added): coding sequences that end in a suppressed stop, and the codons up to and with the next other stop within reach.

    cds: (feature_id, seq, rest), rest: the bases after it on its strand.
    """
    others = [c for c in C.stops(number) if c != suppressed]
    following = S.codon_list(F.substring("rest", 1, 3 * reach))
    at = F.array_position(F.transform(following, lambda c: c.isin(*others)), True)
    return cds.where(F.right("seq", F.lit(3)) == suppressed).select("feature_id", at.alias("added")).where("added > 0")


def gram_stain(hosts: DataFrame, stains: DataFrame) -> DataFrame:
    """(host, stain): looked up by the whole name, then by its first word. stains: (name, stain), unique by name."""
    exact = stains.select(F.col("name").alias("host"), F.col("stain").alias("_a"))
    word = stains.select(F.col("name").alias("_w"), F.col("stain").alias("_b"))
    out = hosts.withColumn("_w", F.substring_index("host", " ", 1)).join(exact, "host", "left").join(word, "_w", "left")
    return out.select("host", F.coalesce("_a", "_b").alias("stain"))


def record_metadata(records: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """(record, field, value) rows of a record table's columns; nulls are left out."""
    return records.unpivot(key, [F.col(f).cast("string").alias(f) for f in fields], "field", "value").where("value is not null")


def record_references(records: DataFrame, first: bool = False, key: str = "record_id") -> DataFrame:
    """(record, n, authors, title, journal, medline, pubmed, comment): the references of records, numbered from 1, or only the first of each; a missing field is empty.

    The version at the end of a record's id goes. Records without references have no row.
    """
    cited = records.select(F.substring_index(F.col(key).cast("string"), ".", 1).alias(key), F.posexplode("references").alias("n", "x"))
    cited = cited.where("n = 0") if first else cited
    return cited.select(key, (F.col("n") + 1).alias("n"), *(F.coalesce(f"x.{c}", F.lit("")).alias(c) for c in ("authors", "title", "journal", "medline", "pubmed", "comment")))


def cleavage_sites(sites: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_id, start, stop, strand): a residue position of each feature's protein (feature_id, pos, 1-based) as the three bases around the cut."""
    plus = F.col("strand") > 0
    cut = F.when(plus, F.col("start") + 3 * F.col("pos")).otherwise(F.col("stop") - 3 * F.col("pos"))
    return sites.join(features, "feature_id").select("feature_id", (cut - 1).alias("start"), (cut + 2).alias("stop"), "strand")


def sar_table(proteins: DataFrame, least: int = 15, most: int = 20) -> DataFrame:
    """(seq_id, part, start, stop): three topology features for each protein with a window: before, the longest window, after."""
    best = X.sar_scan(proteins, least, most).groupBy("seq_id").agg(F.min_by(F.struct("start", "size"), F.struct((-F.col("size")).alias("s"), F.col("start"))).alias("w"))
    rows = best.join(proteins.select("seq_id", F.length("seq").alias("n")), "seq_id")
    a, b = F.col("w.start"), F.col("w.start") + F.col("w.size")
    part = lambda name, lo, hi: F.struct(F.lit(name).alias("part"), lo.alias("start"), hi.alias("stop"))
    return rows.select("seq_id", F.explode(F.array(part("inside", F.lit(0), a), part("membrane", a, b), part("outside", b, F.col("n")))).alias("x")).select("seq_id", "x.part", "x.start", "x.stop")


def _orf_proteins(seqs: DataFrame, number: int, least: int, most: int | None = None) -> DataFrame:
    orfs = X.orf_rows(seqs, number, least, "both", ("protein",))
    ids = F.concat_ws(":", F.col("seq_id").cast("string"), F.col("start").cast("string"), F.col("stop").cast("string"), F.col("strand").cast("string"))
    out = orfs.select(ids.alias("seq_id"), F.substring_index("protein", "*", 1).alias("seq"))
    return out if most is None else out.where(F.length("seq") <= most)


def inner_candidates(seqs: DataFrame, number: int = 11) -> DataFrame:
    """Reading frames of 60 residues or more that do not start with I and have a hydrophobic run near the start."""
    return X.tmd_scan(_orf_proteins(seqs, number, 60).where(~F.col("seq").startswith("I")))


def outer_candidates(seqs: DataFrame, number: int = 11) -> DataFrame:
    """Reading frames of 30 residues or more with a lipobox."""
    return X.lipobox_window(_orf_proteins(seqs, number, 30))


def single_candidates(seqs: DataFrame, number: int = 11) -> DataFrame:
    """Reading frames of 100 to 200 residues with a lipobox near the start and a hydrophobic run later on."""
    p = _orf_proteins(seqs, number, 100, 200)
    boxed = p.join(X.lipobox_window(p, 10, 30, 60, 160), "seq_id", "left_semi")
    return X.tmd_scan(boxed, 75, 200, 15, 25)


def length_summary(proteins: DataFrame, length: str = "size") -> DataFrame:
    """Count, mean, median, least and largest of a length: one row."""
    return proteins.agg(F.count("*").alias("n"), F.avg(length).alias("mean"), F.median(length).alias("median"), F.min(length).alias("least"), F.max(length).alias("most"))


def cassette_string(features: DataFrame, classes: DataFrame, codes: dict[str, str], least: int = 5, key: str = "record_id") -> DataFrame:
    """(record, cassette): the class letters of a record's CDS in start order, upper case forward and lower case reverse; a record and its flipped form give the same text."""
    code = F.try_element_at(C.mapping(codes), "class")
    rows = features.where("type = 'CDS'").join(classes, "feature_id").withColumn("c", F.when(F.col("strand") > 0, F.upper(code)).otherwise(F.lower(code))).where("c is not null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "stop", "feature_id", "c"))), lambda x: x["c"]), "")
    out = rows.groupBy(key).agg(text.alias("t")).where(F.length("t") >= least)
    flipped = F.reverse(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return out.select(key, F.least("t", flipped).alias("cassette"))


def feature_export(features: DataFrame, seqs: DataFrame, upstream: int = 0, downstream: int = 0, key: str = "record_id") -> DataFrame:
    """(feature_id, seq): each feature's bases with some more before and after, by strand, cut at the record's ends."""
    plus = F.col("strand") > 0
    lo = F.greatest(F.lit(0), F.col("start") - F.when(plus, upstream).otherwise(downstream))
    hi = F.col("stop") + F.when(plus, downstream).otherwise(upstream)
    return T.seq_feature_extract(features.withColumns({"start": lo, "stop": hi}), seqs, key)


def require_start_codon(features: DataFrame, seqs: DataFrame, starts: tuple[str, ...] = ("ATG", "GTG", "TTG")) -> DataFrame:
    """Genes with a CDS below that begins with a start codon."""
    good = T.seq_feature_extract(features.where("type = 'CDS'"), seqs).where(F.substring("seq", 1, 3).isin(*starts))
    parents = features.join(good, "feature_id", "left_semi").select(F.col("parent").alias("feature_id"))
    return features.where("type = 'gene'").join(parents, "feature_id", "left_semi")


def require_sd(genes: DataFrame, seqs: DataFrame) -> DataFrame:
    """(feature_id, start, stop, sd_start, sd_stop): features with an upstream motif, widened over it."""
    found = X.sd_scan(genes, seqs).select("feature_id", F.col("start").alias("sd_start"), F.col("stop").alias("sd_stop"))
    out = genes.join(found, "feature_id")
    return out.select("feature_id", F.least("start", "sd_start").alias("start"), F.greatest("stop", "sd_stop").alias("stop"), "sd_start", "sd_stop")


def cluster_sizes(members: DataFrame, least: int = 1) -> DataFrame:
    """(cluster, n, share): clusters of ``least`` members or more, with their share of all members."""
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.where(F.col("n") >= least).join(F.broadcast(total)).select("cluster", "n", (F.col("n") / F.col("_t")).alias("share"))  # the total is one row


def read_subset(reads: DataFrame, genome_length: int, coverage: float, order: str) -> DataFrame:
    """The first reads in order whose summed length reaches a coverage."""
    placed = running(reads.withColumn("_all", F.lit(0)), ["_all"], [order], {"_before": ("sum", F.col("length"), "before")})
    return placed.where(F.col("_before") < genome_length * coverage).select(reads.columns)


def block_split(members: DataFrame, window: int, threshold: float = 0.7) -> DataFrame:
    """(lcb, start, stop, members): a block cut where the set of members that cover enough of a window changes; members: (lcb, genome, seq gapped)."""
    size = F.greatest(F.length("seq"), F.lit(1))
    rows = members.select("lcb", "genome", "seq", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / window).cast("int"))).alias("k"))
    part = F.substring("seq", F.col("k") * window + 1, F.lit(window))
    cover = F.try_divide(F.length(part) - S.count_of(part, "-"), F.length(part))
    sig = rows.select("lcb", "genome", "k", cover.alias("c"), F.length(part).alias("n")).groupBy("lcb", "k").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("c") >= threshold, F.col("genome")))), ",").alias("members"), F.max("n").alias("n"))
    w = Window.partitionBy("lcb").orderBy("k")
    new = F.when(F.lag("members").over(w) == F.col("members"), 0).otherwise(1)
    runs = sig.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("lcb", "_run").agg((F.min("k") * window).alias("start"), F.max(F.col("k") * window + F.col("n")).alias("stop"), F.first("members").alias("members"))
    return out.drop("_run")


def hits_to_alignment_rows(hits: DataFrame) -> DataFrame:
    """(query, flag, subject, pos, cigar): hits as alignment records; clipped ends, and flag 16 where the subject runs backwards."""
    rev = F.col("sstop") < F.col("sstart")
    span = F.col("qstop") - F.col("qstart") + 1
    before, after = F.col("qstart") - 1, F.col("qlen") - F.col("qstop")
    a, b = F.when(rev, after).otherwise(before), F.when(rev, before).otherwise(after)
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("H"))).otherwise("")
    return hits.select("query", F.when(rev, 16).otherwise(0).alias("flag"), "subject", F.least("sstart", "sstop").alias("pos"), F.concat(clip(a), span.cast("string"), F.lit("M"), clip(b)).alias("cigar"))


def flatten_for_submission(features: DataFrame, prefix: str, key: str = "record_id") -> DataFrame:
    """(record, type, start, stop, strand, locus_tag, note): a tree as a flat list: one tag a gene, short exons as binding sites, helper types gone, description as note."""
    tree = T.retype_short_exons(features)
    tags = T.renumber(tree.where("type = 'gene'"), tree.where("type <> 'gene'"), prefix, 4, key).dropDuplicates(["feature_id"])
    kind = F.when(F.col("type").isin("Shine_Dalgarno_sequence", "RBS"), "regulatory").otherwise(F.col("type"))
    out = tree.where(~tree["type"].isin("mRNA", "exon", "region", "remark")).join(tags, "feature_id", "left")
    return out.select(key, kind.alias("type"), "start", "stop", "strand", F.col("tag").alias("locus_tag"), F.col("product").alias("note"))


def gbk_to_tree(flat: DataFrame, key: str = "record_id") -> DataFrame:
    """Flat features grouped by locus tag under one gene over all of them; features without a tag hang on the smallest gene that holds them."""
    tagged = flat.where("locus_tag is not null")
    genes = tagged.groupBy(key, "locus_tag").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("strand").alias("strand"))
    genes = genes.select(key, F.lit("gene").alias("type"), "start", "stop", "strand", F.concat(F.lit("gene-"), F.col(key).cast("string"), F.lit("-"), "locus_tag").alias("feature_id"), F.lit(None).cast("string").alias("parent"))
    own = tagged.select(key, "type", "start", "stop", "strand", "feature_id", F.concat(F.lit("gene-"), F.col(key).cast("string"), F.lit("-"), "locus_tag").alias("parent"))
    lost = flat.where("locus_tag is null").select(key, "type", "start", "stop", "strand", "feature_id")
    held = I.overlap_join(lost, genes.select(key, "start", "stop", F.col("feature_id").alias("gene")), key).where((F.col("b_start") <= F.col("start")) & (F.col("stop") <= F.col("b_stop")))
    best = held.groupBy("feature_id").agg(F.min_by("b_gene", F.struct((F.col("b_stop") - F.col("b_start")).alias("n"), F.col("b_gene"))).alias("parent"))
    return genes.unionByName(own).unionByName(lost.join(best, "feature_id", "left").select(*own.columns))


def export_names(records: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, name): the phage name in a record's title, else the title, else the id."""
    from genoloom.operators.sequences import phage_host_name

    return records.select(key, F.coalesce(F.nullif(phage_host_name(F.col("title"))["phage"], F.lit("")), F.col("title"), F.col(key).cast("string")).alias("name"))


def proximity_classes(candidates: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(feature_id, near): candidates with the classes of anchor features (class column) within a window, in order."""
    met = I.overlap_join(candidates.select("record_id", "start", "stop", "feature_id"), anchors.select("record_id", "start", "stop", "class"), gap=window)
    return met.groupBy("feature_id").agg(F.array_join(F.array_sort(F.collect_set("b_class")), ",").alias("near"))


def annotation_table(features: DataFrame, seqs: DataFrame, ontology: DataFrame, key: str = "record_id") -> DataFrame:
    """One row a CDS: bounds, first and last codon, best upstream motif and gap, upstream neighbour and distance, ontology ids in order. ontology: (feature_id, go_id)."""
    cds = features.where("type = 'CDS'")
    codons = T.seq_feature_extract(cds, seqs, key).select("feature_id", F.substring("seq", 1, 3).alias("first_codon"), F.right("seq", F.lit(3)).alias("last_codon"))
    sd = X.sd_scan(cds, seqs, key=key).select("feature_id", F.col("motif").alias("sd"), F.col("gap").alias("sd_gap"))
    terms = ontology.groupBy("feature_id").agg(F.array_join(F.array_sort(F.collect_set("go_id")), ",").alias("terms"))
    out = cds.join(codons, "feature_id", "left").join(sd, "feature_id", "left").join(T.upstream_feature(cds, key), "feature_id", "left").join(terms, "feature_id", "left")
    return out.select(key, "feature_id", "start", "stop", "strand", "first_codon", "last_codon", "sd", "sd_gap", "upstream", "distance", "terms")


def first_value_below(features: DataFrame, keys: list[str], key: str = "record_id") -> DataFrame:
    """(feature_id, value): the first values of qualifiers (column attrs) named in ``keys``, of the nearest level below a feature that has any.

    Levels are searched one after the other, all features at once; values of one level are joined by ``; `` in order of start,
    and of one feature in the order of ``keys``. Features with no such value below are left out.
    """
    first = lambda k: F.try_element_at(F.try_element_at("attrs", F.lit(k)), F.lit(1))
    own = F.array_compact(F.array(*map(first, keys)))
    rows = features.where("parent is not null").select("parent", F.col("feature_id").alias("_c"), F.struct("start", F.col("feature_id").alias("id")).alias("_at"), own.alias("_v"))
    level, found = features.select(F.col("feature_id").alias("root"), "feature_id").distinct(), []
    while True:
        below = materialize(level.join(rows, F.col("feature_id") == F.col("parent")).select("root", F.col("_c").alias("feature_id"), "_at", "_v"), "values-level")
        values = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("_v") > 0, F.struct("_at", "_v")))), lambda x: x["_v"]))  # one parent's own level
        told = materialize(below.groupBy("root").agg(values.alias("_v")).where(F.size("_v") > 0).select(F.col("root").alias("feature_id"), F.array_join("_v", "; ").alias("value")), "values-found")
        found.append(told)
        # a feature that is below itself is not searched again
        level = materialize(below.where("root <> feature_id").join(told.select(F.col("feature_id").alias("root")), "root", "left_anti").select("root", "feature_id").distinct(), "values-open")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


#: The qualifiers that a column of the report is taken from, in order.
REPORT_QUALIFIERS = {
    "name": ("Name", "name"), "note": ("Note", "note", "Notes", "notes"), "product": ("product", "Product"), "locus_tag": ("locus_tag",), "owner": ("owner",),
    "date_created": ("date_creation",), "date_last_modified": ("date_last_modified",), "description": ("description", "Description"), "dbxrefs": ("Dbxref", "db_xref", "Dbxrefs"),
}
REPORT_COLUMNS = ("record", "id", "type", "start", "stop", "location", "strand", "length", "start_codon", "stop_codon", "sd_sequence", "sd_spacing", "upstream", "upstream_distance", *REPORT_QUALIFIERS)


def annotation_report(features: DataFrame, columns: list[str], types: list[str] = ("gene", "CDS"), seqs: DataFrame | None = None, ontology: DataFrame | None = None, below: bool = False, key: str = "record_id") -> DataFrame:
    """One row for each feature of the given types, with the chosen columns, in that order; only what they need is computed.

    Columns are those of REPORT_COLUMNS, or ``ontology:<column>`` for a column of the ontology table (feature_id, ...), its
    values distinct, sorted and joined by commas. start counts from 1; length is in residues of the coding sequence without
    its stop (of a feature that is no CDS: of the CDSs right below it); codons and the binding site are those of the feature's own bounds and
    need ``seqs``; upstream is the nearest feature of the same types before it on its strand. Qualifier columns (from attrs)
    are null without a value, or with ``below`` take the nearest one below the feature.
    """
    unknown = [c for c in columns if c not in REPORT_COLUMNS and not (c.startswith("ontology:") and ontology is not None)]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    if seqs is None and {"start_codon", "stop_codon", "sd_sequence", "sd_spacing"} & set(columns):
        raise ValueError("codons and binding sites need the sequences")
    rows = features.where(F.col("type").isin(*types))
    want = lambda *names: any(c in columns for c in names)
    have = lambda df: [c for c in df.columns if c != "feature_id"]
    more = []
    if want("length"):
        size = F.col("stop") - F.col("start")
        coding = features.where("type = 'CDS'")
        bases = coding.select("feature_id", size.alias("_bases")).unionByName(coding.join(rows.where("type <> 'CDS'").select(F.col("feature_id").alias("parent")), "parent", "left_semi").select(F.col("parent").alias("feature_id"), size.alias("_bases")))
        more.append(bases.groupBy("feature_id").agg((F.sum("_bases") / 3 - 1).alias("length")))
    if want("start_codon", "stop_codon"):
        more.append(T.seq_feature_extract(rows, seqs, key).select("feature_id", F.upper(F.left("seq", F.lit(3))).alias("start_codon"), F.upper(F.right("seq", F.lit(3))).alias("stop_codon")))
    if want("sd_sequence", "sd_spacing"):
        more.append(X.sd_scan(rows, seqs, key=key).select("feature_id", F.col("motif").alias("sd_sequence"), F.col("gap").alias("sd_spacing")))
    if want("upstream", "upstream_distance"):
        more.append(T.upstream_feature(rows, key).withColumnRenamed("distance", "upstream_distance"))
    values = {}
    for c in columns:
        if c in REPORT_QUALIFIERS:
            first = F.coalesce(*(F.try_element_at(F.try_element_at("attrs", F.lit(k)), F.lit(1)) for k in REPORT_QUALIFIERS[c]))
            values[c] = first
            if below:
                more.append(first_value_below(features, list(REPORT_QUALIFIERS[c]), key).withColumnRenamed("value", f"_below_{c}"))
                values[c] = F.coalesce(first, F.col(f"_below_{c}"))
        elif c.startswith("ontology:"):
            own = c.removeprefix("ontology:")
            more.append(ontology.groupBy("feature_id").agg(F.array_join(F.array_sort(F.collect_set(F.col(own).cast("string"))), ",").alias(c)))  # one feature's own terms
            values[c] = F.col(f"`{c}`")
    for df in more:
        rows = rows.join(df.select("feature_id", *(F.col(f"`{c}`").alias(c) for c in have(df))), "feature_id", "left")
    values |= {"record": F.col(key), "id": F.col("feature_id"), "start": F.col("start") + 1, "location": F.concat((F.col("start") + 1).cast("string"), F.lit(".."), F.col("stop").cast("string")), "strand": F.when(F.col("strand") > 0, "+").otherwise("-")}
    return rows.select(*((values[c] if c in values else F.col(c)).alias(c) for c in columns))


def overlap_compare(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    """(status, n): coding features of two annotations of one record set: exact, inexact (same strand, overlap by half of the longer), only first, only second.

    Each feature of the first takes its largest overlap in the second; a pair counts if each is the other's best.
    """
    x, y = (d.select(key, "start", "stop", "strand", "feature_id") for d in (a, b))
    met = I.overlap_join(x, y, key, same_strand=True)
    bases = F.least("stop", "b_stop") - F.greatest("start", "b_start")
    longer = F.greatest(F.col("stop") - F.col("start"), F.col("b_stop") - F.col("b_start"))
    met = met.withColumn("share", bases / longer).where("share >= 0.5")
    best = lambda k, other: F.row_number().over(Window.partitionBy(k).orderBy(F.desc("share"), other))
    pairs = met.withColumn("r1", best("feature_id", "b_feature_id")).withColumn("r2", best("b_feature_id", "feature_id")).where("r1 = 1 and r2 = 1").select("feature_id", "b_feature_id", F.when(F.col("share") == 1, "exact").otherwise("inexact").alias("status"))
    only = lambda d, c, name: d.join(pairs.select(F.col(c).alias("feature_id")), "feature_id", "left_anti").select(F.lit(name).alias("status"))
    every = pairs.select("status").unionByName(only(x, "feature_id", "only first")).unionByName(only(y, "b_feature_id", "only second"))
    return every.groupBy("status").agg(F.count("*").alias("n"))


def missing_rbs_messages(features: DataFrame, seqs: DataFrame, least: int = 5, most: int = 15, key: str = "record_id") -> DataFrame:
    """(record_id, feature_id, rule, message, upstream): the genes of ``qc_missing_rbs`` with the bases ``most`` to ``least`` before their start, in lower case, and whether a binding motif lies there.

    Bounds outside the record are moved by threes until inside. Genes of records without a sequence are left out.
    """
    lost = features.join(qc_missing_rbs(features).select("feature_id"), "feature_id", "left_semi").join(seqs.select(F.col("seq_id").alias(key), F.length("seq").cast("long").alias("_n")), key)
    plus = F.col("strand") > 0
    lo, hi = F.when(plus, F.col("start") - most).otherwise(F.col("stop") + least), F.when(plus, F.col("start") - least).otherwise(F.col("stop") + most)
    w = bounds_in_frame(lo, hi, F.col("_n"))
    spot = lost.withColumn("_w", w).select(F.col(key), "feature_id", F.least("_w.start", "_w.stop").alias("start"), F.greatest("_w.start", "_w.stop").alias("stop"), "strand")
    found = T.part_sequences(spot, seqs, key)
    message = F.when(F.col("seq").rlike("|".join(X.SD_MOTIFS)), "Unannotated but valid RBS").otherwise("No RBS annotated, None found")
    return found.select(F.col(key).alias("record_id"), "feature_id", F.lit("missing_rbs").alias("rule"), message.alias("message"), F.lower("seq").alias("upstream"))


def qc_corrected_genes(genes: DataFrame, cds: DataFrame) -> DataFrame:
    """(record_id, feature_id, rule, message): coding features without a gene of their 3' end, and genes without a coding feature."""
    tagged = T.locus_tags(genes, cds)
    lost = cds.join(tagged.where("gene is null").select("feature_id"), "feature_id", "left_semi").select("record_id", "feature_id", F.lit("corrected_gene").alias("rule"), F.lit("gene made").alias("message"))
    used = tagged.where("gene is not null").select(F.col("gene").alias("feature_id"))
    return lost.unionByName(genes.join(used, "feature_id", "left_anti").select("record_id", "feature_id", F.lit("corrected_gene").alias("rule"), F.lit("gene without CDS").alias("message")))
