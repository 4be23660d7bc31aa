"""Bulk ingest: each reader is one Spark job over a directory of files. Coordinates become 0-based and half-open.

Lines that break a format's rules are kept with a message in ``_error`` where the table has one; nothing is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.operators.locations import parse_location, reading_order


def _text(spark: SparkSession, path: str, sep: str | None = None, whole: bool = False) -> DataFrame:
    rows = spark.read.text(path, wholetext=whole, lineSep=sep)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _unescape(text: Column) -> Column:
    """Percent-decoding of the characters that the format escapes."""
    out = text
    for code, char in (("%09", "\t"), ("%0A", "\n"), ("%3B", ";"), ("%3D", "="), ("%26", "&"), ("%2C", ","), ("%25", "%")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def fasta_records(text: DataFrame, value: str = "value") -> DataFrame:
    """(seq_id, description, seq) from pieces of text that each begin with a header (its > may be there or not)."""
    body = F.regexp_replace(value, r"^\s*>", "")
    header = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s", "")
    keep = [c for c in text.columns if c != value]
    return text.where(F.length(F.trim(body)) > 0).select(F.regexp_extract(header, r"^(\S*)", 1).alias("seq_id"), header.alias("description"), seq.alias("seq"), *keep)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, description, seq, file): one row a record; files may be split between records."""
    return fasta_records(_text(spark, path, "\n>")).select("seq_id", "description", "seq", "file")


def parse_gff3(lines: DataFrame, value: str = "value") -> DataFrame:
    """Feature rows from lines: nine columns, bounds with < or >, strand and phase checks, escaped attributes; problems in _error.

    An attribute piece without = belongs to the one before it. A repeated key appends its values.
    """
    rows = lines.where(~F.col(value).startswith("#") & (F.trim(value) != ""))
    c = F.split(value, "\t")
    at = lambda i: F.get(c, F.lit(i))
    joined = F.regexp_replace(at(8), r";(?=[^=;]*(;|$))", "%3B")
    pairs = F.filter(F.split(F.regexp_replace(joined, r"(%3B)+$", ""), ";"), lambda x: F.contains(x, F.lit("=")))
    split = F.transform(pairs, lambda x: F.struct(_unescape(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.transform(F.split(F.regexp_replace(x, r"^[^=]*=", ""), ","), _unescape).alias("v")))
    keys = F.array_distinct(F.transform(split, lambda p: p["k"]))
    attrs = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.flatten(F.transform(F.filter(split, lambda p: p["k"] == k), lambda p: p["v"])))))
    number = lambda x: F.regexp_replace(x, "[<>]", "").try_cast("bigint")
    start, stop = number(at(3)), number(at(4))
    error = F.array_compact(F.array(
        F.when(F.size(c) != 9, "not nine columns"), F.when(start.isNull() | stop.isNull(), "bounds are not numbers"), F.when(start > stop, "start after end"),
        F.when(~at(6).isin("+", "-", ".", "?"), "strand"), F.when(~at(7).isin("0", "1", "2", "."), "phase"),
    ))
    out = rows.select(
        _unescape(at(0)).alias("record_id"), at(1).alias("source"), at(2).alias("type"), (start - 1).alias("start"), stop.alias("stop"), at(5).try_cast("double").alias("score"),
        F.when(at(6) == "+", 1).when(at(6) == "-", -1).otherwise(0).alias("strand"), at(7).try_cast("int").alias("phase"), F.when(F.size(c) >= 9, attrs).alias("attrs"), F.array_join(error, "; ").alias("_error"),
        *(x for x in lines.columns if x != value),
    )
    first = lambda k: F.try_element_at(F.try_element_at("attrs", F.lit(k)), F.lit(1))
    return out.withColumn("feature_id", first("ID")).withColumn("parents", F.coalesce(F.try_element_at("attrs", F.lit("Parent")), F.array().cast("array<string>"))).withColumn("parent", first("Parent"))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features of GFF3 files; lines of an embedded FASTA part (no tab) are left out."""
    lines = _text(spark, path).select("value", "file")
    return parse_gff3(lines.where(F.contains("value", F.lit("\t"))))


def read_gff3_regions(spark: SparkSession, path: str, seqs: DataFrame | None = None) -> DataFrame:
    """(record_id, length): a sequence's length, else the ##sequence-region line, else the largest feature end."""
    lines = _text(spark, path)
    pragma = lines.where(F.col("value").startswith("##sequence-region")).select(F.regexp_extract("value", r"^##sequence-region\s+(\S+)", 1).alias("record_id"), F.regexp_extract("value", r"(\d+)\s*$", 1).cast("long").alias("_pragma"))
    ends = read_gff3(spark, path).groupBy("record_id").agg(F.max("stop").alias("_end"))
    out = ends.join(pragma.groupBy("record_id").agg(F.max("_pragma").alias("_pragma")), "record_id", "full")
    if seqs is None:
        return out.select("record_id", F.coalesce("_pragma", "_end").alias("length"))
    known = seqs.select(F.col("seq_id").cast("string").alias("record_id"), F.length("seq").cast("long").alias("_seq"))
    return out.join(known, "record_id", "left").select("record_id", F.coalesce("_seq", "_pragma", "_end").alias("length"))


def merge_split_locations(features: DataFrame) -> DataFrame:
    """Lines of one record and id become one feature with parts in reading order (on the minus strand from the end); differing types are an error."""
    parts = reading_order(F.collect_list(F.struct("start", "stop", "strand")))  # one feature's own lines
    g = features.groupBy("record_id", "feature_id").agg(F.min("type").alias("type"), F.count_distinct("type").alias("_k"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("strand").alias("strand"), parts.alias("parts"))
    return g.withColumn("_error", F.when(F.col("_k") > 1, "types differ")).drop("_k")


def split_gff_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, sequences) of files that hold annotations and then FASTA."""
    whole = _text(spark, path, whole=True)
    cut = F.regexp_replace("value", r"(?s)^.*?(##FASTA|\n(?=>)|^(?=>))", "")
    head = F.regexp_extract("value", r"(?s)^(.*?)(?:##FASTA|\n>|$)", 1)
    lines = whole.select(F.explode(F.split(head, "\n")).alias("value"), "file")
    has = F.col("value").rlike(r"(?s)(^|\n)(##FASTA|>)")
    records = whole.where(has).select(F.explode(F.split(cut, r"(^|\n)>")).alias("value"), "file").where(F.trim("value") != "")
    return parse_gff3(lines.where(F.contains("value", F.lit("\t")))), fasta_records(records)


BLAST_COLUMNS = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, sallseqid string, score int, nident int, positive int, gaps int, ppos double, qframe int, sframe int, qseq string, sseq string, qlen int, slen int, salltitles string"


def read_blast_tab(spark: SparkSession, path: str, dice: bool = False) -> DataFrame:
    """Hits in 25 columns (26 with dice); lines that begin with # are dropped."""
    return spark.read.csv(path, sep="\t", schema=BLAST_COLUMNS + (", dice double" if dice else ""), comment="#", quote="")


def read_genome_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits in 8 columns."""
    return spark.read.csv(path, sep="\t", schema="query string, align_len int, identities int, qlen int, slen int, title string, accessions string, taxids string", comment="#", quote="")


_HSP = "STRUCT<`Hsp_bit-score`: DOUBLE, `Hsp_evalue`: DOUBLE, `Hsp_query-from`: INT, `Hsp_query-to`: INT, `Hsp_hit-from`: INT, `Hsp_hit-to`: INT, `Hsp_identity`: INT, `Hsp_align-len`: INT>"
_ITERATION = f"`Iteration_query-ID` STRING, `Iteration_query-def` STRING, `Iteration_query-len` INT, Iteration_hits STRUCT<Hit: ARRAY<STRUCT<Hit_id: STRING, Hit_def: STRING, Hit_accession: STRING, Hit_len: INT, Hit_hsps: STRUCT<Hsp: ARRAY<{_HSP}>>>>>"


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each alignment: query, hit and alignment fields."""
    it = spark.read.format("xml").option("rowTag", "Iteration").schema(_ITERATION).load(path)
    hit = it.select(F.col("`Iteration_query-ID`").alias("query"), F.col("`Iteration_query-len`").alias("qlen"), F.posexplode("Iteration_hits.Hit").alias("hit_no", "h"))
    hsp = hit.select("query", "qlen", "hit_no", F.col("h.Hit_accession").alias("accession"), F.col("h.Hit_def").alias("title"), F.col("h.Hit_len").alias("slen"), F.posexplode("h.Hit_hsps.Hsp").alias("hsp_no", "p"))
    return hsp.select(
        "query", "hit_no", "hsp_no", "accession", "title", "qlen", "slen", F.col("p.`Hsp_evalue`").alias("evalue"), F.col("p.`Hsp_bit-score`").alias("bitscore"), F.col("p.`Hsp_query-from`").alias("qstart"), F.col("p.`Hsp_query-to`").alias("qend"),
        F.col("p.`Hsp_hit-from`").alias("sstart"), F.col("p.`Hsp_hit-to`").alias("send"), F.col("p.`Hsp_identity`").alias("nident"), F.col("p.`Hsp_align-len`").alias("length"),
    )


def read_xmfa(spark: SparkSession, path: str) -> DataFrame:
    """(file, lcb, member, start, stop, strand, comment, seq) of alignment blocks; lcb numbers the blocks of a file from 1."""
    whole = _text(spark, path, whole=True)
    blocks = whole.select("file", F.posexplode(F.split("value", r"\n=[^\n]*")).alias("lcb", "block"))
    member = blocks.select("file", (F.col("lcb") + 1).alias("lcb"), F.explode(F.split("block", r"(^|\n)>")).alias("m"))
    p = r"^\s*(\d+):(\d+)-(\d+)\s+([+-])\s*([^\n]*)"
    x = lambda i: F.regexp_extract("m", p, i)
    return member.where(F.col("m").rlike(p)).select("file", "lcb", x(1).cast("int").alias("member"), (x(2).cast("long") - 1).alias("start"), x(3).cast("long").alias("stop"), F.when(x(4) == "+", 1).otherwise(-1).alias("strand"), x(5).alias("comment"), F.regexp_replace(F.regexp_replace("m", p, ""), r"\s", "").alias("seq"))


def read_backbone(spark: SparkSession, path: str) -> DataFrame:
    """(block, genome, start, stop) in long form; zero bounds are absent. One file, its line order numbers the blocks."""
    whole = _text(spark, path, whole=True)
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("block", "line")).where((F.col("block") > 0) & (F.trim("line") != ""))
    cells = lines.select("file", "block", F.posexplode(F.split("line", r"\s+")).alias("i", "v")).where("v <> ''")
    pair = cells.groupBy("file", "block", F.floor(F.col("i") / 2).alias("genome")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).cast("long").alias("start"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).cast("long").alias("stop"))
    return pair.where("start <> 0")


def read_cdhit(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, member, representative) of cluster reports."""
    rows = _text(spark, path, ">Cluster ").where(F.trim("value") != "")
    line = rows.select(F.regexp_extract("value", r"^(\d+)", 1).alias("cluster_id"), F.explode(F.split("value", "\n")).alias("line"))
    return line.where(F.contains("line", F.lit(">"))).select("cluster_id", F.regexp_extract("line", r">(.+?)\.\.\.", 1).alias("member"), F.trim("line").endswith("*").alias("representative"))


def read_cluster_lines(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, member): one cluster a line, members separated by blanks; the cluster's id is its first member."""
    parts = F.split(F.trim("value"), r"\s+")
    return _text(spark, path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("cluster"), F.explode(parts).alias("member"))


def _gene_and_cds(calls: DataFrame) -> DataFrame:
    """Each call as a gene and its CDS."""
    two = F.explode(F.array(F.struct(F.lit("gene").alias("type"), F.col("call").alias("feature_id"), F.lit(None).cast("string").alias("parent")), F.struct(F.lit("CDS").alias("type"), F.concat("call", F.lit(".cds")).alias("feature_id"), F.col("call").alias("parent")))).alias("x")
    return calls.select("record_id", "start", "stop", "strand", two).select("record_id", "x.type", "start", "stop", "strand", "x.feature_id", "x.parent")


def read_glimmer(spark: SparkSession, path: str, lengths: DataFrame | None = None) -> DataFrame:
    """Gene calls as genes and CDS; calls over the origin are cut there and marked _truncated. lengths: (record_id, length)."""
    rec = _text(spark, path, "\n>").select(F.regexp_extract("value", r"^\s*>?(\S+)", 1).alias("record_id"), F.explode(F.split("value", "\n")).alias("line"))
    p = r"^(\S+)\s+(\d+)\s+(\d+)\s+([+-])\d\s+(\S+)"
    x = lambda i: F.regexp_extract("line", p, i)
    rows = rec.where(F.col("line").rlike(p)).select("record_id", x(1).alias("call"), x(2).cast("long").alias("a"), x(3).cast("long").alias("b"), F.when(x(4) == "+", 1).otherwise(-1).alias("strand"))
    lo, hi = F.when(F.col("strand") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("strand") > 0, F.col("b")).otherwise(F.col("a"))
    wraps = lo > hi
    rows = rows.join(lengths, "record_id", "left") if lengths is not None else rows.withColumn("length", F.lit(None).cast("long"))
    stop = F.when(wraps, F.coalesce("length", lo)).otherwise(hi)
    return _gene_and_cds(rows.select("record_id", F.when(wraps, F.concat("call", F.lit("_truncated"))).otherwise(F.col("call")).alias("call"), (lo - 1).alias("start"), stop.alias("stop"), "strand"))


def read_mga(spark: SparkSession, path: str) -> DataFrame:
    """Eleven-column calls as genes, CDS and binding sites; genes widen to their site."""
    # A record is what follows a comment line that is not one of the two about GC content and the model.
    rec = _text(spark, path, whole=True).select(F.explode(F.split("value", r"(?:^|\n)#[ \t]*+(?!gc\b|self\b)")).alias("r")).where(F.trim("r") != "")
    lines = rec.select(F.regexp_extract("r", r"^(\S+)", 1).alias("record_id"), F.explode(F.split("r", "\n")).alias("value")).where(~F.col("value").startswith("#") & F.contains("value", F.lit("\t")))
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))
    rows = lines.where(at(1).try_cast("long").isNotNull()).select("record_id", at(0).alias("call"), (at(1).try_cast("long") - 1).alias("start"), at(2).try_cast("long").alias("stop"), F.when(at(3) == "+", 1).otherwise(-1).alias("strand"), at(8).try_cast("long").alias("rs"), at(9).try_cast("long").alias("re"))
    genes = rows.withColumn("start", F.least("start", F.coalesce(F.col("rs") - 1, F.col("start")))).withColumn("stop", F.greatest("stop", F.coalesce("re", "stop")))
    cds = _gene_and_cds(rows).where("type = 'CDS'")
    sites = rows.where("rs is not null").select("record_id", F.lit("Shine_Dalgarno_sequence").alias("type"), (F.col("rs") - 1).alias("start"), F.col("re").alias("stop"), "strand", F.concat("call", F.lit(".rbs")).alias("feature_id"), F.col("call").alias("parent"))
    return _gene_and_cds(genes).where("type = 'gene'").unionByName(cds).unionByName(sites)


def read_trnascan(spark: SparkSession, path: str) -> DataFrame:
    """tRNA calls as features."""
    c = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(c, F.lit(i))
    a, b = at(2).try_cast("long"), at(3).try_cast("long")
    rows = _text(spark, path).where(a.isNotNull() & b.isNotNull())
    return rows.select(at(0).alias("record_id"), F.lit("tRNA").alias("type"), (F.least(a, b) - 1).alias("start"), F.greatest(a, b).alias("stop"), F.when(a <= b, 1).otherwise(-1).alias("strand"), F.concat_ws(".", at(0), F.lit("trna"), at(1)).alias("feature_id"), at(4).alias("product"), at(5).alias("anticodon"))


def read_sam_starts(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, strand, start, stop): aligned reads; bases consumed on the reference come from the CIGAR."""
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))
    used = F.transform(F.regexp_extract_all(at(5), F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda x: x.cast("long"))
    pos, flag = at(3).try_cast("long"), at(1).try_cast("int")
    rows = _text(spark, path).where(~F.col("value").startswith("@") & (pos > 0) & (flag.bitwiseAND(F.lit(4)) == 0))
    return rows.select(at(2).alias("record_id"), F.when(flag.bitwiseAND(F.lit(16)) != 0, -1).otherwise(1).alias("strand"), (pos - 1).alias("start"), (pos - 1 + F.aggregate(used, F.lit(0).cast("long"), lambda a, x: a + x)).alias("stop"))


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """A header-driven annotation table; the header's leading # is cut from its first column."""
    df = spark.read.csv(path, sep="\t", header=True, quote="")
    return df.withColumnsRenamed({c: c.lstrip("# ").strip() for c in df.columns})


def read_five_column(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, n, type, start, stop, strand, attrs, qualifiers, parts) of five-column feature tables; reversed ends are the minus strand.

    qualifiers has all values of each key, attrs the first; parts (start, stop, strand) are the feature's lines in their order.
    """
    rec = _text(spark, path, ">Feature ").where(F.trim("value") != "").select(F.regexp_extract("value", r"^(\S+)", 1).alias("record_id"), F.posexplode(F.split("value", "\n")).alias("i", "line")).where("i > 0")
    c = F.split("line", "\t")
    at = lambda i: F.get(c, F.lit(i))
    is_new = (F.coalesce(at(2), F.lit("")) != "").cast("int")
    n = F.sum(is_new).over(Window.partitionBy("record_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rec.withColumn("new", is_new).withColumn("n", n).select("record_id", "n", "i", F.regexp_replace(at(0), "[<>]", "").try_cast("long").alias("a"), F.regexp_replace(at(1), "[<>]", "").try_cast("long").alias("b"), at(2).alias("type"), at(3).alias("k"), at(4).alias("v")).where("n > 0")
    entries = F.sort_array(F.collect_list(F.when(F.coalesce("k", F.lit("")) != "", F.struct("i", "k", F.coalesce("v", F.lit("")).alias("v")))))
    qualifiers = F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["k"])), lambda k: F.struct(k, F.transform(F.filter(entries, lambda e: e["k"] == k), lambda e: e["v"]))))
    place = F.struct("i", (F.least("a", "b") - 1).alias("start"), F.greatest("a", "b").alias("stop"), F.when(F.col("a") > F.col("b"), -1).otherwise(1).alias("strand"))
    places = F.transform(F.sort_array(F.collect_list(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), place))), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), p["strand"].alias("strand")))
    out = rows.groupBy("record_id", "n").agg(places.alias("parts"), F.max("type").alias("type"), F.min(F.least("a", "b")).alias("lo"), F.max(F.greatest("a", "b")).alias("stop"), F.max(F.when(F.col("a") > F.col("b"), 1).otherwise(0)).alias("rev"), qualifiers.alias("qualifiers"))
    attrs = F.transform_values("qualifiers", lambda k, v: F.get(v, F.lit(0))).alias("attrs")
    return out.select("record_id", "n", "type", (F.col("lo") - 1).alias("start"), "stop", F.when(F.col("rev") == 1, -1).otherwise(1).alias("strand"), attrs, "qualifiers", "parts")


def read_term_dictionary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(category, term) of JSON that maps categories to their terms: one object a file, or one a line, so that large files can be split."""
    j = _text(spark, path, whole=not lines).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "terms"))
    return j.select("category", F.explode("terms").alias("term"))


def read_gene_table(spark: SparkSession, path: str, record: str, start: str, stop: str, name: str) -> DataFrame:
    """Rows of a headed table as gene features; names are escaped."""
    df = spark.read.csv(path, sep="\t", header=True, quote="")
    text = F.col(name)
    for char, code in (("%", "%25"), ("&", "%26"), (",", "%2C"), (";", "%3B"), ("=", "%3D")):
        text = F.replace(text, F.lit(char), F.lit(code))
    a, b = F.col(start).cast("long"), F.col(stop).cast("long")
    return df.select(F.col(record).alias("record_id"), F.lit("gene").alias("type"), (F.least(a, b) - 1).alias("start"), F.greatest(a, b).alias("stop"), F.when(a <= b, 1).otherwise(-1).alias("strand"), text.alias("name"))


#: The lines of a reference and what they are called here.
_REFERENCE = {"authors": "AUTHORS", "title": "TITLE", "journal": "JOURNAL", "medline": "MEDLINE", "pubmed": "PUBMED", "comment": "REMARK"}
_GENBANK = T.StructType([T.StructField(c, T.StringType()) for c in ("record_id", "organism", "source", "taxonomy", "date", "comment", "seq")] + [T.StructField("references", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in _REFERENCE]))), T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("location", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])))])


def _genbank_value(key: str, lines: list[str]) -> str:
    """A qualifier's lines as one value: joined by blanks (protein sequences by nothing), the quotes around it gone, doubled ones undone."""
    value = ("" if key == "translation" else " ").join(lines).strip()
    if value.startswith('"'):
        value = value[1:-1] if len(value) > 1 and value.endswith('"') else value[1:]
    return value.replace('""', '"')


def _genbank_record(block: str) -> dict:
    """Splits one record block into its parts; no interpretation beyond the line layout."""
    import re

    head, _, rest = block.partition("\nFEATURES")
    table, _, origin = rest.partition("\nORIGIN")
    def field(name: str) -> str | None:
        m = re.search(rf"^\s*{name}\s+(.*(?:\n {{10,}}.*)*)", head, re.M)
        return re.sub(r"\s+", " ", m[1]).strip() if m else None
    organism = re.search(r"^  ORGANISM\s+(.*)((?:\n {10,}.*)*)", head, re.M)
    features: list[dict] = []
    last: list[list[str]] | None = None  # the values of the qualifier that lines are added to, each a list of its lines
    for line in table.split("\n")[1:]:
        text = line.strip()
        quoted = last is not None and sum(x.count('"') for x in last[-1]) % 2 == 1  # inside a quote a line may begin with anything
        if re.match(r" {5}\S", line) and not quoted:
            kind, _, loc = text.partition(" ")
            features.append({"type": kind, "location": loc.strip(), "attrs": {}})
            last = None
        elif features and not quoted and (m := re.match(r"\s+/([^=\s]+)(?:=(.*))?$", line)):
            last = features[-1]["attrs"].setdefault(m[1], [])
            last.append([(m[2] or "").rstrip()])
        elif features and text:
            if last is not None:
                last[-1].append(text)
            else:
                features[-1]["location"] += text
    for f in features:
        f["attrs"] = {k: [_genbank_value(k, lines) for lines in v] for k, v in f["attrs"].items()}
    def cited(text: str) -> dict:
        found = {k: re.search(rf"^ {{2,3}}{name}\s+(.*(?:\n {{10,}}.*)*)", text, re.M) for k, name in _REFERENCE.items()}
        return {k: re.sub(r"\s+", " ", m[1]).strip() if m else None for k, m in found.items()}

    locus = re.search(r"^LOCUS\s+(\S+).*?(\d{2}-[A-Z]{3}-\d{4})?\s*$", head, re.M)
    return {
        "record_id": locus[1] if locus else None, "organism": organism[1].strip() if organism else None, "source": field("SOURCE"), "taxonomy": re.sub(r"\s+", " ", organism[2]).strip() if organism else None,
        "date": locus[2] if locus else None, "comment": field("COMMENT"), "seq": re.sub(r"[\s\d/]", "", origin.partition("\n")[2]).upper(),
        "references": [cited(re.split(r"\n(?=\S)", x)[0]) for x in re.split(r"^REFERENCE", head, flags=re.M)[1:]], "features": features,
    }


def read_genbank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, features) of flat files: record fields with the sequence, and features with bounds, strand and parts (start, stop, strand; in reading order) from their location text.

    A feature whose parts lie on both strands has strand 0. Lines of a qualifier are joined by blanks, those of a translation
    by nothing; quotes around a value go and doubled ones inside become single.
    """

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            yield pd.DataFrame([_genbank_record(b) for b in page["value"] if "LOCUS" in b], columns=[f.name for f in _GENBANK.fields])

    blocks = _text(spark, path, "\n//").select("value").where(F.contains("value", F.lit("LOCUS")))
    records = blocks.mapInPandas(run, _GENBANK)
    f = records.select("record_id", F.posexplode("features").alias("n", "f"))
    # Parts on other records (accession:bounds) are left out; a single base or a site between two is a part of its own.
    placed = f.select("record_id", "n", "f.type", parse_location(F.col("f.location")).alias("parts"), "f.attrs")
    strands = F.array_distinct(F.transform("parts", lambda p: p["strand"]))
    placed = placed.withColumn("strand", F.when(F.size(strands) > 1, 0).otherwise(F.coalesce(F.get(strands, F.lit(0)), F.lit(1))))
    features = placed.select("record_id", "n", "type", F.array_min("parts.start").alias("start"), F.array_max("parts.stop").alias("stop"), "strand", "attrs", "parts")
    return records.drop("features"), features
