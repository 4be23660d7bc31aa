"""Similarity hits: scores, filters, rankings and per-genome summaries.

Hits are rows (query, subject, taxon, nident, length, qlen, slen, evalue, pident, ord, titles); column names are parameters
where an operator needs few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.blocked import choose_disjoint, running


def dice(nident: Column, qlen: Column, slen: Column) -> Column:
    """2 * identities / (query length + subject length); null where both are 0."""
    return F.try_divide(2.0 * nident, qlen + slen)


def dice_column(hits: DataFrame, name: str = "dice") -> DataFrame:
    """hits with the dice coefficient."""
    return hits.withColumn(name, dice(F.col("nident"), F.col("qlen"), F.col("slen")))


def dice_filter(hits: DataFrame, least: float = 0.5, strict: bool = False) -> DataFrame:
    """Hits whose dice coefficient is at least (strict: above) a limit."""
    d = dice(F.col("nident"), F.col("qlen"), F.col("slen"))
    return hits.where(d > least if strict else d >= least)


def all_pairs_dice(hits: DataFrame) -> DataFrame:
    """dice of each (query, subject), self-hits dropped."""
    return dice_column(hits.where(F.col("query") != F.col("subject")))


def top_n_per_query(hits: DataFrame, n: int, query: str = "query", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The first n hits of each query in the given order. Spark stops each group at n rows before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def split_titles(hits: DataFrame, titles: str = "titles", name: str = "title", separator: str = "<>") -> DataFrame:
    """One row for each subject title."""
    return hits.withColumn(name, F.explode(F.split(titles, separator))).drop(titles)


def organism_from_title(title: Column) -> Column:
    """The text between the first [ and the last ]; empty if there is none."""
    return F.regexp_extract(title, r"\[(.*)\]", 1)


def expand_taxa(hits: DataFrame, taxa: str = "taxids", accessions: str = "accessions", separator: str = ";", without: DataFrame | None = None) -> DataFrame:
    """One row for each taxon and accession; ``without`` (taxon) lists taxa to leave out."""
    out = hits.withColumn("taxon", F.explode(F.split(taxa, separator))).withColumn("accession", F.explode(F.split(accessions, separator))).drop(taxa, accessions)
    return out.join(without, "taxon", "left_anti") if without is not None else out


def bundle_hits(hits: DataFrame, keys: tuple[str, ...] = ("subject", "taxon")) -> DataFrame:
    """Per key: summed aligned length, identities and dice, and the number of hits. Partial sums before the shuffle."""
    return dice_column(hits).groupBy(*keys).agg(F.sum("length").alias("length"), F.sum("nident").alias("nident"), F.sum("dice").alias("dice"), F.count("*").alias("hsps"))


def subject_counts(hits: DataFrame, keys: tuple[str, ...] = ("taxon",), query: str = "query") -> DataFrame:
    """Different queries for each key."""
    return hits.groupBy(*keys).agg(F.count_distinct(query).alias("n"))


def related_genomes(hits: DataFrame, taxa: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The k genomes with the highest summed dice, of the listed taxa if given; ties by key."""
    out = bundle_hits(hits)
    if taxa is not None:
        out = out.join(taxa, "taxon", "left_semi")
    return out.orderBy(F.round("dice", 9).desc(), "subject", "taxon").limit(k)


def related_proteomes(hits: DataFrame, taxa: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The k taxa with the most different similar queries."""
    out = subject_counts(hits)
    if taxa is not None:
        out = out.join(taxa, "taxon", "left_semi")
    return out.orderBy(F.desc("n"), "taxon").limit(k)


def evalue_score(hits: DataFrame, key: str = "taxon", k: int = 10) -> DataFrame:
    """Per key: sum of |ln(evalue + 1e-250)|, count, mean, median and population deviation; the k highest sums."""
    score = F.abs(F.log(F.col("evalue") + F.lit(1e-250)))
    out = hits.select(key, score.alias("s")).groupBy(key)
    out = out.agg(F.sum("s").alias("score"), F.count("*").alias("n"), F.avg("s").alias("mean"), F.median("s").alias("median"), F.stddev_pop("s").alias("deviation"))
    return out.orderBy(F.round("score", 6).desc(), key).limit(k)


def top_hit_columns(features: DataFrame, hits: DataFrame, files: list[str], feature_id: str = "feature_id") -> DataFrame:
    """features with the subject of each file's best hit (least evalue, then highest dice, then subject) side by side.

    hits: (file, query, subject, evalue, nident, qlen, slen); ``files`` fixes the columns.
    """
    best = F.min_by("subject", F.struct(F.col("evalue"), (-F.col("dice")).alias("d"), F.col("subject")))
    wide = dice_column(hits).groupBy("query").pivot("file", files).agg(best)
    return features.join(wide.withColumnRenamed("query", feature_id), feature_id, "left")


def reopen_by_hits(hits: DataFrame, key: str = "subject") -> DataFrame:
    """Per key: share of hits whose query and reference run in opposite directions, and the query start of the hit lowest in the reference."""
    against = ((F.col("qstop") - F.col("qstart")) * (F.col("sstop") - F.col("sstart")) < 0).cast("int")
    first = F.min_by("qstart", F.struct(F.least("sstart", "sstop"), F.col("qstart")))
    return hits.groupBy(key).agg(F.avg(against).alias("reversed_share"), first.alias("query_start"))


def _windows(hits: DataFrame, width: int, key: str) -> DataFrame:
    """Each hit in order (key, lo, hi) with what a window of ``width`` bases from its start holds, by differences of running sums.

    A hit no longer than the window ends, at the latest, where a window from its own start ends; so of such hits those behind
    this one that end inside are all that end before the window's end, less those that come earlier. Longer hits are in no
    window but as its first hit. in_*: hits, identities and aligned length inside; prior: hits that end before the end of the
    window of the hit before; least: the first end of this and all later hits; last: the last end inside.
    """
    lo, hi = F.least("sstart", "sstop"), F.greatest("sstart", "sstop")
    rows = hits.select(key, lo.alias("lo"), hi.alias("hi"), F.col("nident").cast("long").alias("nident"), F.col("length").cast("long").alias("length"))
    rows = rows.withColumn("short", F.col("hi") - F.col("lo") <= width)
    sums = ("nident", "length")
    none = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c != key}
    ends = rows.where("short").select(key, F.col("hi").alias("at"), F.lit(0).alias("asks"), F.lit(1).alias("e_n"), *(F.col(c).alias(f"e_{c}") for c in sums), *(v.alias(c) for c, v in none.items()))
    asks = rows.select(key, (F.col("lo") + width).alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("int").alias("e_n"), *(F.lit(None).cast("long").alias(f"e_{c}") for c in sums), *none)
    values = {f"f_{c}": ("sum", F.col(f"e_{c}"), "before") for c in ("n", *sums)} | {"last": ("max", F.when(F.col("asks") == 0, F.col("at")), "before")}
    ended = running(ends.unionByName(asks), [key], ["at", "asks", "lo", "hi", *sums], values).where("asks = 1").drop("at", "asks", "e_n", *(f"e_{c}" for c in sums))
    own = {"n": F.lit(1), **{c: F.col(c) for c in sums}}
    values = {f"p_{c}": ("sum", F.when(F.col("short"), v), "before") for c, v in own.items()}
    values |= {"prior": ("last", F.col("f_n"), "before"), "lo_before": ("last", F.col("lo"), "before"), "least": ("min", F.when(F.col("short"), F.col("hi")), "from")}
    out = running(ended, [key], ["lo", "hi", *sums], values)
    inside = [(F.col(f"f_{c}") - F.col(f"p_{c}")).alias(f"in_{c}") for c in own]
    return out.select(key, "lo", "hi", *sums, "short", *inside, "last", F.col("f_n").alias("ended"), "prior", "lo_before", "least")


def hsp_windows(hits: DataFrame, query_length: int, padding: float = 1.2, cutoff: float = 0.0, k: int | None = 10) -> DataFrame:
    """Per subject, windows of floor(padding * query length) that start at a hit: summed identities of the hits wholly inside over the query length.

    A window whose hits all lie in an earlier window of the same subject is left out; of the rest, the one with the
    highest share stands for the subject (then the earliest). The k subjects of the highest shares are returned, or all
    without k. Windows come from running sums over range blocks, so a subject with most of the hits is spread.
    """
    rows = _windows(hits, int(padding * query_length), "subject")
    first = F.col("lo_before").isNull() | (F.col("lo_before") < F.col("lo"))
    open_windows = rows.where(first & (F.col("in_n") > 0) & (F.col("prior").isNull() | (F.col("ended") > F.col("prior"))))
    share = (F.col("in_nident") / F.lit(float(query_length))).alias("share")
    best = open_windows.select("subject", "lo", share).groupBy("subject").agg(F.min_by(F.struct("lo", "share"), F.struct((-F.col("share")).alias("s"), F.col("lo"))).alias("w"))
    out = best.select("subject", F.col("w.lo").alias("window_start"), F.col("w.share").alias("share")).where(F.col("share") >= cutoff)
    return out if k is None else out.orderBy(F.round("share", 9).desc(), "subject").limit(k)


def hsp_groups(hits: DataFrame, query_length: int, padding: float = 1.2, cutoff: float = 0.0, k: int | None = None, key: str = "subject") -> DataFrame:
    """Disjoint groups of hits of a subject: (subject, start, stop, hits, aligned, query_aligned, identity, subject_aligned).

    Every hit, in order of start and end, begins a group: itself and the later hits that end within floor(padding * query
    length) of its start. Groups that lie in another one are left out; of the others, along the subject, each one that has
    no hit in common with a kept one is kept. aligned sums alignment lengths; query_aligned and identity are aligned length
    and identities over the query's length, subject_aligned is aligned length over the group's. Groups with an identity below
    ``cutoff`` are left out, and of the rest the k highest are returned, if k is given.
    """
    width = int(padding * query_length)
    rows = _windows(hits, width, key)
    long = ~F.col("short")
    maximal = rows.where(long | F.col("prior").isNull() | (F.col("ended") > F.col("prior")))
    kept = choose_disjoint(maximal, key, ["lo", "hi", "nident", "length"], width)
    with_own = lambda c, own: F.col(f"in_{c}") + F.when(long, own).otherwise(0)
    stop, aligned, q = F.when(long, F.col("hi")).otherwise(F.col("last")), with_own("length", F.col("length")), F.lit(float(query_length))
    out = kept.select(key, F.col("lo").alias("start"), stop.alias("stop"), with_own("n", F.lit(1)).cast("long").alias("hits"), aligned.alias("aligned"), (aligned / q).alias("query_aligned"), (with_own("nident", F.col("nident")) / q).alias("identity"), F.try_divide(aligned, stop - F.col("lo")).alias("subject_aligned"))
    out = out.where(F.col("identity") >= cutoff)
    return out if k is None else out.orderBy(F.round("identity", 9).desc(), key, "start", "stop").limit(k)


def hit_features(hits: DataFrame) -> DataFrame:
    """Hits as ``match`` features with ``match_part`` children: one match for each (query, subject), with the widest bounds and the least evalue."""
    pair = concat_id(F.col("query"), F.col("subject"))
    match = hits.groupBy("query", "subject").agg(F.min("qstart").alias("start"), F.max("qstop").alias("stop"), F.min("evalue").alias("evalue"))
    match = match.select(F.col("query").alias("record_id"), F.lit("match").alias("type"), "start", "stop", "evalue", pair.alias("feature_id"), F.lit(None).cast("string").alias("parent"))
    n = F.row_number().over(Window.partitionBy("query", "subject").orderBy("qstart", "qstop", "evalue", "ord", "taxon"))
    part = hits.select(F.col("query").alias("record_id"), F.lit("match_part").alias("type"), F.col("qstart").alias("start"), F.col("qstop").alias("stop"), "evalue", F.concat_ws(".", pair, n.cast("string")).alias("feature_id"), pair.alias("parent"))
    return match.unionByName(part)


def concat_id(*parts: Column) -> Column:
    """Ids joined by an underscore."""
    return F.concat_ws("_", *(p.cast("string") for p in parts))
