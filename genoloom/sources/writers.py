"""Text sinks: each makes lines with built-in expressions; ``write_lines`` and its kin write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.operators.features import tree_depths
from genoloom.operators.locations import with_parts


def _escape(text: Column) -> Column:
    out = text
    for char, code in (("%", "%25"), (",", "%2C"), ("=", "%3D"), (";", "%3B"), ("&", "%26"), ("\t", "%09"), ("\n", "%0A")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def gff3_lines(features: DataFrame, source: str = "genoloom") -> DataFrame:
    """(record_id, line): GFF3 text of features (record_id, type, start, stop, strand, feature_id, parent, attrs); keys in order.

    A feature with a column ``parts`` has a line for each part, along the record, all with its id.
    """
    if "parts" in features.columns:
        features = with_parts(features)
        features = features.select(*(c for c in features.columns if c not in ("start", "stop", "strand", "parts")), F.inline(F.array_sort("parts")))
    own = F.map_filter("attrs", lambda k, v: ~k.isin("ID", "Parent"))
    rest = F.transform(F.array_sort(F.map_entries(own)), lambda e: F.concat(_escape(e["key"]), F.lit("="), F.array_join(F.transform(e["value"], _escape), ",")))
    ids = F.array_compact(F.array(F.concat(F.lit("ID="), _escape(F.col("feature_id"))), F.when(F.col("parent").isNotNull(), F.concat(F.lit("Parent="), _escape(F.col("parent"))))))
    strand = F.when(F.col("strand") > 0, "+").when(F.col("strand") < 0, "-").otherwise(".")
    last = F.array_join(F.concat(ids, F.coalesce(rest, F.array().cast("array<string>"))), ";")
    line = F.concat_ws("\t", _escape(F.col("record_id").cast("string")), F.lit(source), "type", (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.lit("."), strand, F.lit("."), last)
    return features.select("record_id", line.alias("line"))


def write_gff3(features: DataFrame, path: str) -> None:
    """GFF3 files, each record whole and in start order; of features with one start, those higher in the tree come first."""
    deep = features.join(tree_depths(features), "feature_id", "left").withColumn("_depth", F.coalesce("_depth", F.lit(0)))
    placed = deep.repartitionByRange("record_id").sortWithinPartitions("record_id", "start", "_depth", F.desc("stop"), "feature_id")
    gff3_lines(placed).select("line").write.text(path)


def fasta_lines(seqs: DataFrame, width: int = 60) -> DataFrame:
    """(seq_id, line): one record as text, its sequence wrapped."""
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return seqs.select("seq_id", F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), wrapped).alias("line"))


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    """FASTA files."""
    fasta_lines(seqs, width).select("line").write.text(path)


def bed_lines(features: DataFrame) -> DataFrame:
    """(record_id, line): BED6 text."""
    line = F.concat_ws("\t", F.col("record_id").cast("string"), F.col("start").cast("string"), F.col("stop").cast("string"), "feature_id", F.lit("0"), F.when(F.col("strand") < 0, "-").otherwise("+"))
    return features.select("record_id", line.alias("line"))


def wig_lines(track: DataFrame) -> DataFrame:
    """(record_id, pos, line): variable-step text, 1-based; a record's header goes before its first place."""
    body = F.concat_ws(" ", (F.col("pos") + 1).cast("string"), F.col("n").cast("string"))
    head = F.concat(F.lit("variableStep chrom="), F.col("record_id").cast("string"))
    return track.select("record_id", "pos", F.when(F.col("pos") == 0, F.concat_ws("\n", head, body)).otherwise(body).alias("line"))


def five_column_lines(features: DataFrame) -> DataFrame:
    """(record_id, feature_id, line): five-column text, ends reversed on the minus strand, one line more for each qualifier value.

    A feature with a column ``parts`` has a line for each part in reading order, the type on the first.
    """
    ends = lambda p: (F.when(p["strand"] < 0, p["stop"]).otherwise(p["start"] + 1).cast("string"), F.when(p["strand"] < 0, p["start"] + 1).otherwise(p["stop"]).cast("string"))
    head = F.array_join(F.transform("parts", lambda p, i: F.concat_ws("\t", *ends(p), F.when(i == 0, F.col("type")))), "\n")
    rest = F.flatten(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.transform(e["value"], lambda v: F.concat(F.lit("\t\t\t"), e["key"], F.lit("\t"), v))))
    return with_parts(features).select("record_id", "feature_id", F.concat_ws("\n", head, F.when(F.size(rest) > 0, F.array_join(rest, "\n"))).alias("line"))


def xmfa_lines(blocks: DataFrame, width: int = 80) -> DataFrame:
    """(lcb, line): alignment blocks (lcb, member, start, stop, strand, comment, seq) as text."""
    seq = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    head = F.concat(F.lit("> "), F.col("member").cast("string"), F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(" "), F.when(F.col("strand") < 0, "-").otherwise("+"), F.lit(" "), F.col("comment"))
    parts = blocks.select("lcb", F.struct("member", F.concat_ws("\n", head, seq).alias("t")).alias("x")).groupBy("lcb").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select("lcb", F.concat(F.array_join(F.transform("xs", lambda x: x["t"]), "\n"), F.lit("\n=")).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The ``line`` column as text files."""
    lines.select("line").write.text(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """A headed table."""
    rows.write.csv(path, sep="\t", header=True, quote="")


def write_partitioned(lines: DataFrame, path: str, by: str) -> None:
    """One folder of text files for each value of a column (record, source, cluster or bin)."""
    lines.select(by, "line").repartition(by).write.partitionBy(by).text(path)
