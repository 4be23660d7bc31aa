"""Operators on sequence tables (seq_id, description, seq): projections, counts and grouping."""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.functions import codon as C
from genoloom.functions import sequence as S


def seq_length(seqs: DataFrame) -> DataFrame:
    """(seq_id, length)."""
    return seqs.select("seq_id", F.length("seq").cast("long").alias("length"))


def size_filter(seqs: DataFrame, least: int, most: int) -> DataFrame:
    """Sequences whose length is within [least, most]."""
    return seqs.where(F.length("seq").between(least, most))


def revcom_features(features: DataFrame, lengths: DataFrame, key: str = "record_id") -> DataFrame:
    """Features mirrored: start' = L - stop, strand negated. lengths: (key, length)."""
    out = features.join(lengths, key)
    return out.withColumns({"start": F.col("length") - F.col("stop"), "stop": F.col("length") - F.col("start"), "strand": -F.col("strand")}).drop("length")


def rotate_features(features: DataFrame, lengths: DataFrame, k: int, key: str = "record_id") -> DataFrame:
    """Features shifted with the origin moved to k; those that span it are dropped."""
    out = features.join(lengths, key).where(~((F.col("start") < k) & (F.col("stop") > k)))
    start = F.pmod(F.col("start") - k, F.col("length"))
    return out.withColumns({"stop": start + F.col("stop") - F.col("start"), "start": start}).drop("length")


def split_slices(seqs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(seq_id, n, seq): slices of a fixed length with a running number; the last may be shorter, none is empty."""
    starts = F.sequence(F.lit(0), F.length("seq") - 1, F.lit(size))
    cut = seqs.where(F.length("seq") > 0).select("seq_id", "seq", F.posexplode(starts).alias("n", "at"))
    return cut.select("seq_id", F.col("n").cast("long").alias("n"), F.substring("seq", F.col("at") + 1, F.lit(size + overlap)).alias("seq"))


def drop_description(seqs: DataFrame) -> DataFrame:
    """Id and sequence only, the sequence cut at ##."""
    return seqs.select("seq_id", F.substring_index("seq", "##", 1).alias("seq"))


def rename_sequences(seqs: DataFrame, name: str, keep_old: bool = True) -> DataFrame:
    """All sequences under one new id; the old id goes to the description as [Orig=old] if asked for."""
    note = F.concat(F.lit("[Orig="), F.col("seq_id").cast("string"), F.lit("]")) if keep_old else F.lit("")
    return seqs.select(F.lit(name).alias("seq_id"), note.alias("description"), "seq")


def id_swap(seqs: DataFrame, word: int) -> DataFrame:
    """Word ``word`` (1-based; -1 the last) of the description comes first, without brackets."""
    parts = F.split("description", " ")
    front = F.translate(F.coalesce(F.try_element_at(parts, F.lit(word)), F.lit("")), "[]()", "")
    return seqs.withColumn("description", F.concat_ws(" ", front, F.col("description")))


def split_headers(seqs: DataFrame) -> DataFrame:
    """One row for each of the headers joined by >."""
    return seqs.withColumn("description", F.explode(F.split("description", ">")))


def disambiguate(seqs: DataFrame, seed: int = 42) -> DataFrame:
    """IUPAC codes replaced by one base that each allows, drawn by a hash of id, place and seed; with the number of changes."""
    letters = F.split("seq", "")
    out = F.col("seq")
    bases = C.mapping({k: v.strip("[]") for k, v in S.IUPAC_CLASS.items()})

    def pick(c: Column, i: Column) -> Column:
        allowed = F.try_element_at(bases, F.upper(c))
        at = F.pmod(F.xxhash64(F.col("seq_id"), i, F.lit(seed)), F.length(allowed).cast("long")).cast("int") + 1
        return F.when(allowed.isNull(), c).otherwise(F.substring(allowed, at, F.lit(1)))

    codes = "".join(S.IUPAC_CLASS) + "".join(S.IUPAC_CLASS).lower()
    return seqs.withColumn("changes", S.count_of(out, codes).cast("long")).withColumn("seq", F.array_join(F.transform(letters, pick), ""))


def disambiguation_table(seqs: DataFrame, seed: int = 42) -> DataFrame:
    """(seq_id, pos, code, base): each IUPAC code that ``disambiguate`` replaces, with its 0-based place and the base taken. Texts are cut once; only codes become rows."""
    old, new = F.split("seq", ""), F.split("_new", "")
    both = disambiguate(seqs.withColumn("_old", F.col("seq")), seed).select("seq_id", F.col("_old").alias("seq"), F.col("seq").alias("_new"))
    spots = F.filter(F.zip_with(F.transform(old, lambda c, i: F.struct(i.alias("pos"), c.alias("code"))), new, lambda a, b: F.struct(a["pos"].cast("long").alias("pos"), a["code"].alias("code"), b.alias("base"))), lambda x: x["code"] != x["base"])
    return both.select("seq_id", F.explode(spots).alias("x")).select("seq_id", "x.pos", "x.code", "x.base")


def aa_fraction(seqs: DataFrame, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*") -> DataFrame:
    """Length and the share of each letter among the letters counted."""
    counted = S.count_of(F.col("seq"), letters)
    cols = [F.coalesce(F.try_divide(S.count_of(F.col("seq"), x), counted), F.lit(0.0)).alias("stop" if x == "*" else x.lower()) for x in letters]
    return seqs.select("seq_id", F.length("seq").cast("long").alias("length"), *cols)


def _codons(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", F.explode(S.codon_list(F.col("seq"))).alias("codon"))


def codon_counts(seqs: DataFrame) -> DataFrame:
    """(codon, n) over all sequences in frame; counted before the shuffle."""
    return _codons(seqs).groupBy("codon").agg(F.count("*").alias("n"))


def codon_fraction(seqs: DataFrame) -> DataFrame:
    """(seq_id, codon, fraction) in long form: the share of each codon of a sequence."""
    n = _codons(seqs).groupBy("seq_id", "codon").agg(F.count("*").alias("n"))
    total = seqs.select("seq_id", F.floor(F.length("seq") / 3).alias("total"))
    return n.join(total, "seq_id").select("seq_id", "codon", (F.col("n") / F.col("total")).alias("fraction"))


def codon_fraction_table(seqs: DataFrame) -> DataFrame:
    """One row a sequence with a column for each of the 64 codons."""
    wide = codon_fraction(seqs).groupBy("seq_id").pivot("codon", C.codons()).agg(F.first("fraction"))
    return wide.na.fill(0.0, C.codons())


def start_codon_counts(seqs: DataFrame, number: int = 11) -> DataFrame:
    """(codon, residue, n) of first codons."""
    n = seqs.groupBy(F.substring("seq", 1, 3).alias("codon")).agg(F.count("*").alias("n"))
    return n.select("codon", F.try_element_at(C.mapping(C.table(number)), F.upper("codon")).alias("residue"), "n")


def stop_codon_counts(seqs: DataFrame) -> DataFrame:
    """(codon, name, n) of last codons; names are null for other codons."""
    n = seqs.groupBy(F.right("seq", F.lit(3)).alias("codon")).agg(F.count("*").alias("n"))
    return n.select("codon", F.try_element_at(C.mapping(C.STOP_NAMES), F.upper("codon")).alias("name"), "n")


def net_charge(seqs: DataFrame, least_net: int | None = None, least_ratio: float | None = None, most_length: int | None = None) -> DataFrame:
    """(seq_id, net, charged, ratio): (R, K) - (D, E), their number, and its share of the length, with optional limits."""
    plus, minus = S.count_of(F.col("seq"), "RK"), S.count_of(F.col("seq"), "DE")
    out = seqs.select("seq_id", F.length("seq").alias("n"), (plus - minus).alias("net"), (plus + minus).alias("charged")).withColumn("ratio", F.try_divide("charged", "n"))
    if most_length is not None:
        out = out.where(F.col("n") <= most_length)
    if least_net is not None:
        out = out.where(F.col("net") >= least_net)
    if least_ratio is not None:
        out = out.where(F.col("ratio") >= least_ratio)
    return out.drop("n")


def residue_table(seqs: DataFrame, window: int = 9) -> DataFrame:
    """(seq_id, pos, residue, kind, hydropathy): class of each residue (+, -, N neutral, P polar) and the mean hydropathy around it; null near the ends.

    Sequences are cut into overlapping slices before residues become rows, so a long one is spread over rows without a window.
    """
    half, size = window // 2, 512
    kd = C.mapping({k: float(v) for k, v in C.HYDROPATHY.items()})
    starts = F.sequence(F.lit(0), F.length("seq") - 1, F.lit(size))
    cut = seqs.where(F.length("seq") > 0).select("seq_id", F.length("seq").alias("len"), F.explode(starts).alias("at"), "seq")
    cut = cut.select("seq_id", "len", "at", F.substring("seq", F.greatest(F.lit(0), F.col("at") - half) + 1, F.least(F.lit(size), F.col("len") - F.col("at")) + F.least(F.lit(half), F.col("at")) + half).alias("part"), F.least(F.lit(half), F.col("at")).alias("skip"))
    values = F.transform(F.split("part", ""), lambda c: F.coalesce(F.try_element_at(kd, c), F.lit(0.0)))
    cut = cut.select("seq_id", "len", "at", "part", "skip", values.alias("v"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("len") - F.col("at")) - 1))
    rows = cut.select("seq_id", "len", "at", "part", "skip", "v", i.alias("i"))
    pos = F.col("at") + F.col("i")
    inside = (pos >= half) & (pos < F.col("len") - half)
    mean = F.aggregate(F.slice("v", F.col("i") + F.col("skip") - half + 1, window), F.lit(0.0), lambda a, x: a + x) / window
    residue = F.substring("part", F.col("i") + F.col("skip") + 1, F.lit(1))
    kind = F.when(residue.isin("R", "K", "H"), "+").when(residue.isin("D", "E"), "-").when(residue.isin("S", "T", "N", "Q", "C", "Y"), "P").otherwise("N")
    return rows.select("seq_id", (pos + 1).cast("long").alias("pos"), residue.alias("residue"), kind.alias("kind"), F.when(inside, mean).alias("hydropathy"))


#: What is cut from a title, and the name patterns in the order in which they are tried, with the groups of
#: the host and the phage.
TITLE_ENDS = (", complete genome.", ", complete genome")
NAME_PATTERNS = (
    (r"^(.*)\s*bacteriophage (.*)$", 1, 2),
    (r"^(.*)\s*phage (.*)$", 1, 2),
    (r"^(?:bacterio|vibrio|Bacterio|Vibrio|)?[Pp]hage (.*)$", None, 1),
    (r"^(v[A-Z]_[A-Z][a-z]{2}_.*)", None, 1),
)


def phage_host_name(title: Column) -> Column:
    """Struct (host, phage) of a record title, by the first pattern that it meets: host bacteriophage name, host phage name, phage name, new-style name."""
    t = reduce(lambda x, end: F.replace(x, F.lit(end), F.lit("")), TITLE_ENDS, title)
    none = F.lit(None).cast("string")
    out = F.struct(none.alias("host"), none.alias("phage"))
    for pattern, h, p in reversed(NAME_PATTERNS):
        own = F.struct((F.regexp_extract(t, pattern, h) if h else none).alias("host"), F.regexp_extract(t, pattern, p).alias("phage"))
        out = F.when(t.rlike(pattern), own).otherwise(out)
    return out


def host_fields(host: Column) -> Column:
    """Struct (genus, species, strain, other) of a host string."""
    parts = F.split(F.trim(host), r"\s+")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.struct(F.nullif(at(1), F.lit("")).alias("genus"), at(2).alias("species"), at(3).alias("strain"), F.nullif(F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), " "), F.lit("")).alias("other"))


def point_mutants(seqs: DataFrame, bases: str = "ACGT", number: int | None = None, kind: str = "substitution") -> DataFrame:
    """(seq_id, pos, base, seq): all single substitutions, insertions (before pos) or deletions; with a table number, one for each (pos, protein)."""
    n, pos = F.length("seq"), F.col("pos")
    last = n if kind == "insertion" else n - 1
    at = seqs.where(last >= 0).select("seq_id", "seq", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    if kind == "deletion":
        out = at.withColumn("base", F.lit(""))
    else:
        out = at.select("seq_id", "pos", "seq", F.explode(F.array(*map(F.lit, bases))).alias("base"))
    if kind == "substitution":
        out = out.where(F.substring("seq", pos + 1, F.lit(1)) != F.col("base"))
    rest = pos + (1 if kind == "insertion" else 2)
    out = out.withColumn("seq", F.concat(F.substring("seq", F.lit(1), pos), F.col("base"), F.substring("seq", rest, n)))
    if number is not None:
        out = out.withColumn("protein", S.translate(F.col("seq"), number)).dropDuplicates(["seq_id", "pos", "protein"])
    return out


def first_difference(seqs: DataFrame, reference: Column) -> DataFrame:
    """(seq_id, pos, residue): the first place where a sequence of the reference's length differs; pos null for other lengths, 0 if equal."""
    place = F.array_position(F.zip_with(F.split("seq", ""), F.split(reference, ""), lambda a, b: a == b), False)
    pos = F.when(F.length("seq") == F.length(reference), place)
    return seqs.select("seq_id", pos.alias("pos"), F.when(pos > 0, F.substring("seq", pos.cast("int"), F.lit(1))).alias("residue"))


def difference_residues(seqs: DataFrame, reference: str) -> DataFrame:
    """(pos, residue, n): how many sequences of the reference's length have each other residue at each of its places (1-based); pos null and * for other lengths."""
    own = F.transform(F.split("seq", ""), lambda c, i: F.struct((i + 1).alias("pos"), c.alias("residue")))
    other = F.filter(own, lambda x: F.substring(F.lit(reference), x["pos"], F.lit(1)) != x["residue"])
    unequal = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit("*").alias("residue")))
    rows = seqs.select(F.explode(F.when(F.length("seq") == len(reference), other).otherwise(unequal)).alias("x"))
    return rows.groupBy("x.pos", "x.residue").agg(F.count("*").alias("n"))


def least_rotation(s: str) -> str:
    """The least rotation of a text, in time that grows with its length."""
    n = len(s)
    if not n:
        return s
    least = min(s)
    runs = [(m.end() - m.start(), m.start()) for m in re.finditer(re.escape(least) + "+", s + s) if m.start() < n]
    longest = max(r for r, _ in runs)
    if longest >= n:
        return s
    starts, both = [p for r, p in runs if r == longest], s + s
    if len(starts) <= 64:
        return min(both[p : p + n] for p in starts)
    i, j, k = 0, 1, 0
    while i < n and j < n and k < n:
        a, b = both[i + k], both[j + k]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        j += i == j
        k = 0
    at = min(i, j)
    return both[at : at + n]


@F.pandas_udf(T.StringType())
def _least_rotations(seqs: pd.Series) -> pd.Series:
    return seqs.map(least_rotation, na_action="ignore")


def contig_uid(seqs: DataFrame) -> DataFrame:
    """(seq_id, uid): an id that rotation and strand do not change, of the least rotation of either strand."""
    uid = F.md5(F.least(_least_rotations(F.col("seq")), _least_rotations(S.reverse_complement(F.col("seq")))))
    return seqs.select("seq_id", uid.alias("uid"))


def dedup(seqs: DataFrame) -> DataFrame:
    """(seq_id, copies, others): the first record of each upper-cased sequence; ids of the rest in order. Grouped by digest, so sequences are not shuffled."""
    slim = seqs.select("seq_id", F.sha2(F.upper("seq"), 256).alias("d"))
    ids = slim.groupBy("d").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("copies"), F.sort_array(F.collect_list("seq_id")).alias("all"))
    return ids.select("seq_id", "copies", F.array_join(F.slice(F.transform("all", lambda x: x.cast("string")), 2, 1 << 30), " ").alias("others"))


def concat_sequences(seqs: DataFrame, group: str, order: str, link: str = "", pre: str = "", post: str = "") -> DataFrame:
    """(group, seq): the sequences of each group as one, in order, with text before, between and after."""
    parts = F.sort_array(F.collect_list(F.struct(order, "seq")))
    return seqs.groupBy(group).agg(F.concat(F.lit(pre), F.array_join(F.transform(parts, lambda p: p["seq"]), link), F.lit(post)).alias("seq"))


def ligate_bed(seqs: DataFrame, group: str, order: str, link: str = "", pre: str = "") -> DataFrame:
    """(group, order, start, stop) of each piece within ``concat_sequences``."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.coalesce(F.sum(F.length("seq") + len(link)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(pre)
    return seqs.select(group, order, before.alias("start"), (before + F.length("seq")).alias("stop"))


def protein_props(seqs: DataFrame) -> DataFrame:
    """(seq_id, length, aromaticity, gc, gc_skew, weight); see ``isoelectric_point`` and ``instability_index`` for the other two. Aromatic share of a protein column, and of its DNA the GC per cent and the mean skew of 100-base windows.

    seqs: (seq_id, seq DNA, protein). Weight is the sum of residue masses and one water.
    """
    aromatic = F.try_divide(S.count_of(F.col("protein"), "FWY"), F.length("protein"))
    gc = F.try_divide(100.0 * S.count_of(F.upper("seq"), "GCS"), F.length("seq"))
    windows = F.when(F.length("seq") > 0, F.regexp_extract_all("seq", F.lit("(?s).{1,100}"), F.lit(0)))
    skew = F.transform(windows, lambda s: F.coalesce(F.try_divide(S.count_of(s, "Gg") - S.count_of(s, "Cc"), S.count_of(s, "GgCc")), F.lit(0.0)))
    mean = F.coalesce(F.try_divide(F.aggregate(skew, F.lit(0.0), lambda a, x: a + x), F.size(skew)), F.lit(0.0))
    weight = S.weighted(F.col("protein"), RESIDUE_MASS) + WATER
    return seqs.select("seq_id", F.length("protein").cast("long").alias("length"), aromatic.alias("aromaticity"), gc.alias("gc"), mean.alias("gc_skew"), weight.alias("weight"))


#: Average masses of residues within a chain, and of water.
RESIDUE_MASS = {
    "A": 71.0779, "R": 156.1857, "N": 114.1026, "D": 115.0874, "C": 103.1429, "Q": 128.1292, "E": 129.114, "G": 57.0513, "H": 137.1393, "I": 113.1576,
    "L": 113.1576, "K": 128.1723, "M": 131.1961, "F": 147.1739, "P": 97.1152, "S": 87.0773, "T": 101.1039, "W": 186.2099, "Y": 163.1733, "V": 99.1311,
}
WATER = 18.0153


#: pK of side chains and ends (positive, negative), and of first and last residues that change an end's.
POSITIVE_PK = {"end": 7.5, "K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE_PK = {"end": 3.55, "D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
FIRST_PK = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
LAST_PK = {"D": 4.55, "E": 4.75}
#: Where the search for a charge of zero begins, its bounds, and how near they come.
PH_START, PH_LEAST, PH_MOST, PH_STEP = 7.775, 4.05, 12.0, 0.0001


def isoelectric_point(protein: Column) -> Column:
    """The pH at which a protein's net charge is zero, by bisection; null for an empty one.

    The residues are counted once, and the halvings run over the counts as one expression, so no row leaves the JVM.
    """
    seq = F.upper(protein)
    by = lambda values, letter, plain: F.coalesce(*(F.when(letter == k, v) for k, v in values.items()), F.lit(plain))
    counts = {k: S.count_of(seq, k) for k in "KRHDECY"}
    basic = F.array(*(F.struct(counts[k].cast("double").alias("n"), F.lit(POSITIVE_PK[k]).alias("pk")) for k in "KRH"), F.struct(F.lit(1.0).alias("n"), by(FIRST_PK, F.left(seq, F.lit(1)), POSITIVE_PK["end"]).alias("pk")))
    acid = F.array(*(F.struct(counts[k].cast("double").alias("n"), F.lit(NEGATIVE_PK[k]).alias("pk")) for k in "DECY"), F.struct(F.lit(1.0).alias("n"), by(LAST_PK, F.right(seq, F.lit(1)), NEGATIVE_PK["end"]).alias("pk")))
    both = F.array(F.struct(basic.alias("basic"), acid.alias("acid")))
    total = lambda xs, share: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["n"] * share(x["pk"]))

    def halve(x: Column, ions: Column) -> Column:
        ph = x["ph"]
        charge = total(ions["basic"], lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))) - total(ions["acid"], lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph)))
        open_ = x["hi"] - x["lo"] > PH_STEP
        lo, hi = F.when(open_ & (charge > 0), ph).otherwise(x["lo"]), F.when(open_ & (charge <= 0), ph).otherwise(x["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(open_, (lo + hi) / 2).otherwise(ph).alias("ph"))

    begin = F.struct(F.lit(PH_LEAST).alias("lo"), F.lit(PH_MOST).alias("hi"), F.lit(PH_START).alias("ph"))
    steps = math.ceil(math.log2((PH_MOST - PH_LEAST) / PH_STEP)) + 1
    found = F.get(F.transform(both, lambda ions: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, lambda x, _: halve(x, ions))["ph"]), F.lit(0))
    return F.when(F.length(seq) > 0, found)


def instability_index(proteins: DataFrame, weights: DataFrame) -> DataFrame:
    """(seq_id, instability): ten times the summed weights of neighbouring residues over a protein's length; a stop at the end is left out.

    weights: (pair, weight), the table of 400 dipeptide weights to use; it is given, not built in. Pairs that it lacks count 0; an
    empty protein has null.
    """
    own = proteins.select("seq_id", F.regexp_replace("seq", r"\*$", "").alias("_p"))
    pairs = own.select("seq_id", F.explode(F.regexp_extract_all("_p", F.lit("(?s)(?=(..))"), F.lit(1))).alias("pair")).groupBy("seq_id", "pair").agg(F.count("*").alias("n"))
    total = pairs.join(weights.select("pair", "weight"), "pair").groupBy("seq_id").agg(F.sum(F.col("n") * F.col("weight")).alias("_s"))
    return own.join(total, "seq_id", "left").select("seq_id", F.when(F.length("_p") > 0, 10.0 * F.coalesce("_s", F.lit(0.0)) / F.length("_p")).alias("instability"))


def codon_reference(usage: DataFrame, organism: str, order: list[str] | None = None) -> DataFrame:
    """(codon, n) of one organism of a usage table (organism, counts: 64 numbers as text separated by blanks, in the order of codons)."""
    names = F.array(*map(F.lit, order or C.codons()))
    row = usage.where(F.col("organism") == organism).select(F.explode(F.arrays_zip(names.alias("codon"), F.split(F.trim("counts"), r"\s+").alias("n"))).alias("x"))
    return row.select("x.codon", F.col("x.n").cast("long").alias("n"))
