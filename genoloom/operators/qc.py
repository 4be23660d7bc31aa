"""Quality rules on feature tables. Each rule gives rows (record_id, feature_id, rule, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.session import materialize


def _found(df: DataFrame, rule: str, message: Column) -> DataFrame:
    return df.select("record_id", "feature_id", F.lit(rule).alias("rule"), message.alias("message"))


def qc_missing_rbs(features: DataFrame) -> DataFrame:
    """Genes with a CDS but no ribosome binding site below."""
    rbs = F.col("type").isin("RBS", "Shine_Dalgarno_sequence")
    kids = features.where("parent is not null").groupBy(F.col("parent").alias("feature_id")).agg(F.count_if(F.col("type") == "CDS").alias("cds"), F.count_if(rbs).alias("rbs"))
    return _found(features.where("type = 'gene'").join(kids.where("cds > 0 and rbs = 0"), "feature_id"), "missing_rbs", F.lit("no RBS"))


def qc_weird_starts(cds: DataFrame, starts: tuple[str, ...] = ("ATG", "GTG", "TTG")) -> DataFrame:
    """Genes whose first coding sequence (record_id, feature_id, seq, parent, start) starts with another codon; without a parent column each sequence counts."""
    if "parent" in cds.columns:
        own = F.min(F.struct("start", "feature_id", "record_id", "seq")).alias("x")
        cds = cds.where("parent is not null").groupBy("parent").agg(own).select("x.*").unionByName(cds.where("parent is null").select("start", "feature_id", "record_id", "seq"))
    first = F.substring("seq", 1, 3)
    return _found(cds.where(~first.isin(*starts)), "weird_start", first)


def qc_gene_model(features: DataFrame) -> DataFrame:
    """Genes whose numbers of exons (longer than 10) and of CDS differ."""
    exon = (F.col("type") == "exon") & (F.col("stop") - F.col("start") > 10)
    kids = features.where("parent is not null").groupBy(F.col("parent").alias("feature_id")).agg(F.count_if(exon).alias("exons"), F.count_if(F.col("type") == "CDS").alias("cds"))
    bad = features.where("type = 'gene'").join(kids.where("exons <> cds"), "feature_id")
    return _found(bad, "gene_model", F.concat(F.col("exons").cast("string"), F.lit(" exons, "), F.col("cds").cast("string"), F.lit(" CDS")))


def qc_paired_lengths(features: DataFrame) -> DataFrame:
    """Genes with as many exons (longer than 10) as CDS of which a pair, in order of start, differs in length; one row a pair."""
    size = F.col("stop") - F.col("start")
    parts = features.where(F.col("parent").isNotNull() & ((F.col("type") == "CDS") | ((F.col("type") == "exon") & (size > 10)))).select("parent", "type", "start", "stop", "feature_id")
    ranked = parts.withColumn("n", F.row_number().over(Window.partitionBy("parent", "type").orderBy("start", "stop", "feature_id")))
    of = lambda t: F.max(F.when(F.col("type") == t, size))
    pairs = ranked.groupBy("parent", "n").agg(of("exon").alias("e"), of("CDS").alias("c"))
    uneven = pairs.where("e is null or c is null").select("parent").distinct()
    bad = pairs.where("e <> c").join(uneven, "parent", "left_anti").withColumnRenamed("parent", "feature_id")
    genes = features.where("type = 'gene'").select("record_id", "feature_id")
    return _found(genes.join(bad, "feature_id"), "gene_model", F.concat(F.lit("CDS "), F.col("n").cast("string"), F.lit(" is not as long as its exon")))


def qc_far_rbs(features: DataFrame, most: int = 15) -> DataFrame:
    """Genes whose first binding site lies more than ``most`` bases before their first CDS, by strand."""
    kids = features.where("parent is not null").select("parent", "type", "start", "stop", "feature_id")
    first = lambda cond: F.min(F.when(cond, F.struct("start", "stop", "feature_id")))
    both = kids.groupBy(F.col("parent").alias("feature_id")).agg(first(F.col("type") == "CDS").alias("cds"), first(F.col("type").isin("RBS", "Shine_Dalgarno_sequence")).alias("rbs"))
    genes = features.where("type = 'gene'").select("record_id", "feature_id", "strand").join(both.where("cds is not null and rbs is not null"), "feature_id")
    distance = F.when(F.col("strand") > 0, F.col("cds.start") - F.col("rbs.stop")).otherwise(F.col("rbs.start") - F.col("cds.stop"))
    return _found(genes.withColumn("d", distance).where(F.col("d") > most), "far_rbs", F.concat(F.lit("RBS too far away ("), F.col("d").cast("string"), F.lit(" nt)")))


def qc_start_counts(cds: DataFrame) -> DataFrame:
    """(codon, n): start codons of the first CDS of each gene; cds: (parent, start, feature_id, seq)."""
    first = cds.groupBy("parent").agg(F.min(F.struct("start", "feature_id", F.substring("seq", 1, 3).alias("codon"))).alias("x"))
    return first.groupBy(F.col("x.codon").alias("codon")).agg(F.count("*").alias("n"))


def qc_missing_tags(features: DataFrame, tag: str = "product") -> DataFrame:
    """CDS without a qualifier."""
    return _found(features.where((F.col("type") == "CDS") & ~F.coalesce(F.map_contains_key("attrs", tag), F.lit(False))), "missing_tag", F.lit(tag))


def qc_tree_bounds(features: DataFrame) -> DataFrame:
    """Children that are not inside their parent."""
    up = features.select(F.col("feature_id").alias("_p"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    out = features.join(up, F.col("parent") == F.col("_p")).where((F.col("start") < F.col("_s")) | (F.col("stop") > F.col("_e")))
    return _found(out, "tree_bounds", F.lit("outside parent"))


def qc_tree_rules(features: DataFrame) -> DataFrame:
    """Gene models against the rules of a tree; letter case of types aside.

    An mRNA has its gene's bounds, and a gene holds only mRNAs, regulatory and sequence_secondary_structure features. A CDS
    or exon lies in its mRNA; an mRNA holds only CDS, exon, intron and Shine_Dalgarno_sequence features, has a CDS at one
    end, or without CDSs exons at both ends, and its first two exons don't overlap. A gene without an mRNA and an mRNA without
    CDS and exon are named too. CDS, exon, intron and Shine_Dalgarno_sequence features have nothing below.
    """
    kind = F.upper("type")
    up = features.select(F.col("feature_id").alias("_p"), F.col("start").alias("_s"), F.col("stop").alias("_e"), kind.alias("_pt"), F.col("record_id").alias("_r"))
    rows = features.withColumn("_t", kind).join(up, F.col("parent") == F.col("_p"))
    gene, mrna = F.col("_pt") == "GENE", F.col("_pt") == "MRNA"
    is_, outside = lambda *t: F.col("_t").isin(*t), (F.col("start") < F.col("_s")) | (F.col("stop") > F.col("_e"))
    own = (
        F.when(gene & is_("MRNA") & ((F.col("start") != F.col("_s")) | (F.col("stop") != F.col("_e"))), "mRNA bounds differ from the gene").when(gene & ~is_("MRNA", "REGULATORY", "SEQUENCE_SECONDARY_STRUCTURE"), "unexpected child type of gene")
        .when(mrna & is_("CDS", "EXON") & outside, F.concat("type", F.lit(" outside mRNA"))).when(mrna & ~is_("CDS", "EXON", "INTRON", "SHINE_DALGARNO_SEQUENCE"), "unexpected child type of mRNA")
    )
    found = _found(rows.where(own.isNotNull()), "tree_rules", own)
    at = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    first_two = F.slice(F.array_sort(F.collect_list(F.when(is_("EXON"), F.struct("start", "stop", "feature_id")))), 1, 2)  # one parent's own exons
    per = rows.groupBy("_p", "_pt", "_r").agg(
        at(is_("MRNA")).alias("mrna"), at(is_("CDS")).alias("cds"), at(is_("CDS") & ((F.col("start") == F.col("_s")) | (F.col("stop") == F.col("_e")))).alias("bound"), at(is_("EXON")).alias("exon"),
        (at(is_("EXON") & (F.col("start") == F.col("_s"))) & at(is_("EXON") & (F.col("stop") == F.col("_e")))).alias("both"), first_two.alias("two"),
    )
    a, b = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    ends = F.when(F.col("cds") & ~F.col("bound"), F.when(F.col("exon") & ~F.col("both"), "no CDS or exon covers both ends").otherwise("no CDS at either end")).when(~F.col("cds") & F.col("exon") & ~F.col("both"), "no exon covers both ends").when(~F.col("cds") & ~F.col("exon"), "no CDS or exon")
    told = lambda df, message: df.select(F.col("_r").alias("record_id"), F.col("_p").alias("feature_id"), F.lit("tree_rules").alias("rule"), message.alias("message"))
    of_mrna = per.where(mrna)
    found = found.unionByName(told(of_mrna.where(ends.isNotNull()), ends)).unionByName(told(of_mrna.where((F.size("two") > 1) & ~((a["start"] > b["stop"]) | (b["start"] > a["stop"]))), F.lit("overlapping exons")))
    found = found.unionByName(told(per.where(gene & ~F.col("mrna")), F.lit("no mRNA"))).unionByName(told(per.where(F.col("_pt").isin("CDS", "EXON", "INTRON", "SHINE_DALGARNO_SEQUENCE")), F.lit("has features below")))
    bare = features.where(kind.isin("GENE", "MRNA")).join(per.select("_p"), F.col("feature_id") == F.col("_p"), "left_anti")
    return found.unionByName(_found(bare, "tree_rules", F.when(kind == "GENE", "no mRNA").otherwise("no CDS or exon")))


def qc_tree_counts(features: DataFrame) -> DataFrame:
    """Parents with more than one mRNA or two exons, and ids that come twice."""
    kids = features.where("parent is not null").groupBy("record_id", F.col("parent").alias("feature_id")).agg(F.count_if(F.col("type") == "mRNA").alias("mrna"), F.count_if(F.col("type") == "exon").alias("exons"))
    many = _found(kids.where("mrna > 1 or exons > 2"), "tree_counts", F.lit("too many children"))
    twice = features.groupBy("feature_id").agg(F.count("*").alias("n"), F.min("record_id").alias("record_id")).where("n > 1")
    return many.unionByName(_found(twice, "tree_counts", F.lit("id is not unique")))


def qc_parents(features: DataFrame) -> DataFrame:
    """Parents that no row has, rows that are their own parent, and rows on a cycle of any length.

    Rows without a parent or a child among the rest are taken away until none is left: what stays is on a cycle.
    """
    ids = features.select(F.col("feature_id").alias("_p")).distinct()
    lost = _found(features.where("parent is not null").join(ids, F.col("parent") == F.col("_p"), "left_anti"), "parents", F.lit("parent not found"))
    own = _found(features.where("parent = feature_id"), "parents", F.lit("own parent"))
    rest = materialize(features.where("parent is not null and parent <> feature_id").select("record_id", "feature_id", "parent"), "qc-edges")
    n = rest.count()
    while n:
        up = rest.select(F.col("feature_id").alias("_p")).distinct()
        down = rest.select(F.col("parent").alias("_c")).distinct()
        rest = materialize(rest.join(up, F.col("parent") == F.col("_p"), "left_semi").join(down, F.col("feature_id") == F.col("_c"), "left_semi"), "qc-edges")
        n, before = rest.count(), n
        if n == before:
            break
    return lost.unionByName(own).unionByName(_found(rest, "parents", F.lit("cycle")).distinct())


def qc_bounds(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """Features outside their record (record_id, length)."""
    return _found(features.join(lengths, "record_id").where((F.col("start") < 0) | (F.col("stop") > F.col("length"))), "bounds", F.lit("outside record"))


def qc_quotes(features: DataFrame, key: str = "product") -> DataFrame:
    """Features with an unpaired double quote in a qualifier's text."""
    text = F.array_join(F.try_element_at("attrs", F.lit(key)), "\n")
    return _found(features.where(F.regexp_count(text, F.lit('"')) % 2 == 1), "quotes", F.lit(key))


def qc_metadata(features: DataFrame, metadata: tuple[str, ...] = ("remark", "region", "source")) -> DataFrame:
    """Features other than metadata that span their whole record, from the least start to the largest stop of all."""
    ends = features.groupBy("record_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return _found(features.where(~F.col("type").isin(*metadata)).join(ends, ["record_id", "start", "stop"]), "metadata", F.lit("spans the record"))


def bounds_in_frame(start: Column, stop: Column, length: Column) -> Column:
    """Struct (start, stop): ends beyond the record moved by threes until inside."""
    s = F.when(start < 0, F.pmod(start, F.lit(3))).otherwise(start)
    e = F.when(stop > length, stop - 3 * F.ceil((stop - length) / 3)).otherwise(stop)
    return F.struct(s.cast("long").alias("start"), e.cast("long").alias("stop"))


def qc_report(findings: list[DataFrame], features: DataFrame) -> DataFrame:
    """(record_id, rule, findings, features): counts per record and rule beside the record's number of features."""
    every = findings[0]
    for f in findings[1:]:
        every = every.unionByName(f)
    counts = every.groupBy("record_id", "rule").agg(F.count("*").alias("findings"))
    return counts.join(features.groupBy("record_id").agg(F.count("*").alias("features")), "record_id")
