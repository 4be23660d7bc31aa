"""Queries over text sinks, and round trips that write the driver's tables in a format and read them back."""

import uuid

from pyspark.sql import functions as F

from genoloom.functions.codon import codons
from genoloom.operators.blocks import fill_track, start_track
from genoloom.operators.sequences import codon_reference
from genoloom.plans.feature_queries import _tree
from genoloom.plans.relation_queries import _TRACK, _lengths, _reads
from genoloom.plans.views import duckdb_sql, view
from genoloom.session import shared_dir
from genoloom.sources import readers as R
from genoloom.sources import writers as W


def _path(s, kind):
    return f"{shared_dir(s)}/genoloom/{kind}-{uuid.uuid4().hex}"


def _gff3(s, d):
    t = _tree(s, d)
    path = _path(s, "gff3")
    W.write_gff3(t.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("note"), F.array(F.lit("a;b=c,d"), F.col("type"))))), path)
    return R.read_gff3(s, path)


def _fasta(s, d):
    path = _path(s, "fasta")
    W.write_fasta(view(s, d, "dna"), path)
    return R.read_fasta(s, path)


def _blast(s, d):
    path = _path(s, "tab")
    h = view(s, d, "hits").withColumn("evalue", F.round("evalue", 4))
    cols = {"qseqid": "query", "sseqid": "subject", "pident": "pident", "length": "length", "evalue": "evalue", "nident": "nident", "qlen": "qlen", "slen": "slen", "salltitles": "titles"}
    W.write_lines(h.select(F.concat_ws("\t", *(F.col(cols[c]).cast("string") if c in cols else F.lit("0") for c in (x.split()[0] for x in R.BLAST_COLUMNS.split(", ")))).alias("line")), path)
    return R.read_blast_tab(s, path)


def _xmfa(s, d):
    path = _path(s, "xmfa")
    a = view(s, d, "aligned").where("length(seq_a) > 0")
    both = a.select(F.col("conv_id").alias("lcb"), (F.col("turn") * 2).alias("member"), F.col("seq_a").alias("seq")).unionByName(a.select(F.col("conv_id").alias("lcb"), (F.col("turn") * 2 + 1).alias("member"), F.col("seq_b").alias("seq")))
    W.write_lines(W.xmfa_lines(both.select("lcb", "member", F.lit(0).alias("start"), F.length("seq").alias("stop"), F.lit(-1).alias("strand"), F.concat(F.lit("c"), F.col("lcb").cast("string")).alias("comment"), "seq")), path)
    return R.read_xmfa(s, path)


def _trip(s, lines, kind, read):
    """Writes text lines and reads them back."""
    path = _path(s, kind)
    W.write_lines(lines, path)
    return read(s, path)


def _reformat(s, d):
    return W.gff3_lines(_gff3(s, d).withColumn("attrs", F.map_filter("attrs", lambda k, v: k != "note")), "again").select("line")


def _blocks(s, d):
    return view(s, d, "aligned").where("length(seq_a) > 0").select(F.col("conv_id").alias("lcb"), "turn", F.col("seq_a").alias("seq"))


def _sam(s, d):
    f = view(s, d, "features")
    cigar = F.concat((F.col("stop") - F.col("start")).cast("string"), F.lit("M2S"))
    line = F.concat_ws("\t", "feature_id", F.when(F.col("strand") < 0, "16").otherwise("0"), F.col("record_id").cast("string"), (F.col("start") + 1).cast("string"), F.lit("9"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    return _trip(s, f.select(line.alias("line")), "sam", R.read_sam_starts)


def _five(s, d):
    t = _tree(s, d)
    per = W.five_column_lines(t).groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("t"))
    return _trip(s, per.select(F.concat(F.lit(">Feature r"), F.col("record_id").cast("string"), F.lit("\n"), "t").alias("line")), "tbl", R.read_five_column)


def _clusters(s, d):
    o = view(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("m"))
    return o.select("o_custkey", F.transform("m", lambda x: x.cast("string")).alias("m"))


def _cdhit(s, d):
    body = F.array_join(F.transform("m", lambda x, i: F.concat(i.cast("string"), F.lit("\t9aa, >"), x, F.when(i == 0, "... *").otherwise("... at 90%"))), "\n")
    return _trip(s, _clusters(s, d).select(F.concat(F.lit(">Cluster "), F.col("o_custkey").cast("string"), F.lit("\n"), body).alias("line")), "clstr", R.read_cdhit)


def _glimmer(s, d):
    f = view(s, d, "features")
    a, b = F.when(F.col("strand") > 0, F.col("start") + 1).otherwise(F.col("stop")), F.when(F.col("strand") > 0, F.col("stop")).otherwise(F.col("start") + 1)
    line = F.concat_ws(" ", "feature_id", a.cast("string"), b.cast("string"), F.when(F.col("strand") > 0, "+1").otherwise("-1"), F.lit("7.5"))
    per = f.select("record_id", line.alias("l")).groupBy("record_id").agg(F.array_join(F.collect_list("l"), "\n").alias("t"))
    return _trip(s, per.select(F.concat(F.lit(">r"), F.col("record_id").cast("string"), F.lit(" x\n"), "t").alias("line")), "predict", R.read_glimmer)


def _terms(s, d):
    p = view(s, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("t"))
    return _trip(s, p.select(F.to_json(F.create_map("p_brand", "t")).alias("line")), "json", lambda s, path: R.read_term_dictionary(s, path, lines=True))


def _gaf(s, d):
    path = _path(s, "gaf")
    W.write_tsv(view(s, d, "supplier").select(F.col("s_suppkey").alias("# gene"), F.col("s_name").alias("go_id")), path)
    return R.read_gaf(s, path)


def _gene_table(s, d):
    path = _path(s, "tsv")
    f = view(s, d, "features")
    W.write_tsv(f.select(F.col("record_id").alias("rec"), F.when(F.col("strand") > 0, F.col("start") + 1).otherwise(F.col("stop")).alias("from"), F.when(F.col("strand") > 0, F.col("stop")).otherwise(F.col("start") + 1).alias("to"), F.concat("feature_id", F.lit(";a=b")).alias("label")), path)
    return R.read_gene_table(s, path, "rec", "from", "to", "label")


def _trna(s, d):
    f = view(s, d, "features")
    line = F.concat_ws("\t", F.concat(F.lit("r"), F.col("record_id").cast("string")), "feature_id", F.when(F.col("strand") > 0, F.col("start") + 1).otherwise(F.col("stop")).cast("string"), F.when(F.col("strand") > 0, F.col("stop")).otherwise(F.col("start") + 1).cast("string"), F.lit("Ala"), F.lit("TGC"), F.lit("0"), F.lit("0"), F.lit("60"))
    return _trip(s, f.select(line.alias("line")), "trna", R.read_trnascan)


def _partitioned(s, d):
    path = _path(s, "parts")
    f = view(s, d, "features")
    W.write_partitioned(W.bed_lines(f.withColumn("record_id", F.concat_ws("/", F.col("record_id").cast("string"), "type"))).select(F.substring_index("record_id", "/", -1).alias("type"), F.regexp_replace("line", "/[A-Za-z]+\t", "\t").alias("line")), path, "type")
    return s.read.text(path)


def _mga(s, d):
    f = view(s, d, "features")
    line = F.concat_ws("\t", "feature_id", (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.when(F.col("strand") > 0, "+").otherwise("-"), *map(F.lit, ("0", "11", "1.5", "p", "-", "-", "-")))
    per = f.select("record_id", line.alias("l")).groupBy("record_id").agg(F.array_join(F.collect_list("l"), "\n").alias("t"))
    return _trip(s, per.select(F.concat(F.lit("# r"), F.col("record_id").cast("string"), F.lit("\n# gc = 0.5, rbs = 0.4\n# self: -\n"), "t").alias("line")), "mga", R.read_mga)


def _regions(s, d):
    f = view(s, d, "tree").withColumn("attrs", F.create_map().cast("map<string,array<string>>"))
    even = f.where("record_id % 2 = 0").select("record_id").distinct()
    pragma = even.select(F.concat(F.lit("##sequence-region "), F.col("record_id").cast("string"), F.lit(" 1 "), (F.col("record_id") + 90000).cast("string")).alias("line"))
    return _trip(s, W.gff3_lines(f).select("line").unionByName(pragma), "gff3", R.read_gff3_regions)


def _gff_fasta(s, d):
    seqs = view(s, d, "dna").where("length(seq) > 0")
    gff = F.concat_ws("\t", F.concat(F.lit("s"), F.col("seq_id").cast("string")), F.lit("x"), F.lit("region"), F.lit("1"), F.length("seq").cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=f"), F.col("seq_id").cast("string")))
    rows = seqs.select(F.floor(F.col("seq_id") / 20).alias("file"), gff.alias("g"), F.concat(F.lit(">s"), F.col("seq_id").cast("string"), F.lit("\n"), "seq").alias("q"))
    whole = rows.groupBy("file").agg(F.concat_ws("\n", F.array_join(F.collect_list("g"), "\n"), F.lit("##FASTA"), F.array_join(F.collect_list("q"), "\n")).alias("line"))
    path = _path(s, "gff-fasta")
    W.write_partitioned(whole, path, "file")
    features, found = R.split_gff_fasta(s, path)
    return features.join(found, features.record_id == found.seq_id, "full").select("record_id", "seq_id", "feature_id", "start", "stop", F.md5("seq").alias("seq"))


def _backbone(s, d):
    at = lambda x: x.cast("string")
    c = view(s, d, "customer").select("c_nationkey", "c_custkey", F.concat_ws("\t", at(F.col("c_custkey") * 10 + 1), at(F.col("c_custkey") * 10 + 9), *(at(F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(F.col("c_custkey") * 7 + k)) for k in (1, 5))).alias("l"))
    per = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "l"))).alias("ls"))
    text = F.concat(F.lit("seq0_leftend\tseq0_rightend\tseq1_leftend\tseq1_rightend\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    path = _path(s, "backbone")
    W.write_partitioned(per.select("c_nationkey", text.alias("line")), path, "c_nationkey")
    return R.read_backbone(s, path)


def _blast_xml(s, d):
    h = view(s, d, "hits")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    hsp = F.concat(F.lit("<Hit_hsps><Hsp>"), tag("Hsp_bit-score", F.col("bitscore")), tag("Hsp_evalue", F.col("evalue")), tag("Hsp_query-from", F.col("qstart") + 1), tag("Hsp_query-to", F.col("qstop")), tag("Hsp_hit-from", F.col("sstart") + 1), tag("Hsp_hit-to", F.col("sstop")), tag("Hsp_identity", F.col("nident")), tag("Hsp_align-len", F.col("length")), F.lit("</Hsp></Hit_hsps>"))
    hit = F.concat(F.lit("<Hit>"), tag("Hit_id", F.col("subject")), tag("Hit_def", F.concat(F.lit("protein "), F.col("taxon").cast("string"))), tag("Hit_accession", F.col("subject")), tag("Hit_len", F.col("slen")), hsp, F.lit("</Hit>"))
    per = h.groupBy("query").agg(F.array_join(F.collect_list(hit), "").alias("hits"))
    line = F.concat(F.lit("<Iteration>"), tag("Iteration_query-ID", F.concat(F.lit("q"), F.col("query").cast("string"))), tag("Iteration_query-len", F.lit(99)), F.lit("<Iteration_hits>"), "hits", F.lit("</Iteration_hits></Iteration>"))
    ends = ("<BlastOutput><BlastOutput_iterations>", "</BlastOutput_iterations></BlastOutput>")
    whole = per.groupBy(F.floor(F.col("query") / 1000).alias("file")).agg(F.concat(F.lit(ends[0]), F.array_join(F.collect_list(line), "\n"), F.lit(ends[1])).alias("line"))
    path = _path(s, "xml")
    W.write_partitioned(whole, path, "file")
    return R.read_blast_xml(s, path)


def _genbank(s, d):
    q = view(s, d, "dna").where("length(seq) > 0")
    n = F.length("seq").cast("string")
    text = F.concat(F.lit("LOCUS       r"), F.col("seq_id").cast("string"), F.lit(" "), n, F.lit(" bp DNA\nFEATURES             Location/Qualifiers\n     CDS             complement(join(J00194.1:100..202,3..9,12.."), (F.length("seq") + 20).cast("string"), F.lit('))\n                     /gene="a b"\n                     /db_xref="x:1"\n                     /db_xref="x:2"\nORIGIN\n        1 '), F.lower("seq"), F.lit("\n//"))
    path = _path(s, "gbk")
    W.write_lines(q.select(text.alias("line")), path)
    records, features = R.read_genbank(s, path)
    f = features.select("record_id", "type", "start", "stop", "strand", F.size("parts").alias("parts"), F.array_join(F.col("attrs")["db_xref"], ",").alias("xrefs"))
    return records.select("record_id", F.md5("seq").alias("seq")).join(f, "record_id")


def _tsv(s, d):
    path = _path(s, "tsv")
    W.write_tsv(view(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return s.read.csv(path, sep="\t", header=True, quote="")


def _fasta_parts(s, d):
    path = _path(s, "fasta-parts")
    q = view(s, d, "dna").withColumn("source", F.coalesce(F.regexp_extract("description", r"\[(.*)\]", 1), F.lit("none")))
    W.write_partitioned(W.fasta_lines(q).join(q.select("seq_id", "source"), "seq_id"), path, "source")
    return R.fasta_records(s.read.text(path, lineSep="\n>")).select("source", "seq_id", F.md5("seq").alias("seq"))


QUERIES = {
    "read_mga": lambda s, d: _mga(s, d).select("record_id", "type", "start", "stop", "strand", "feature_id", "parent"),
    "read_gff3_regions": _regions,
    "split_gff_fasta": _gff_fasta,
    "read_backbone": lambda s, d: _backbone(s, d).select("block", "genome", "start", "stop"),
    "read_blast_xml": lambda s, d: _blast_xml(s, d).select("query", "accession", "title", "slen", "evalue", "bitscore", "qstart", "send", "nident", "length"),
    "read_genbank": _genbank,
    "write_tsv": _tsv,
    "write_partitioned_sequences": _fasta_parts,
    "reformat": _reformat,
    "write_xmfa": lambda s, d: W.xmfa_lines(_blocks(s, d).select("lcb", F.col("turn").alias("member"), F.lit(0).alias("start"), F.length("seq").alias("stop"), F.lit(1).alias("strand"), F.lit("x").alias("comment"), "seq")).select("lcb", F.md5("line").alias("line")),
    "read_sam_starts": _sam,
    "read_five_column": lambda s, d: _five(s, d).select("record_id", "type", "start", "stop", "strand", F.try_element_at("attrs", F.lit("product")).alias("product")),
    "read_cluster_lines": lambda s, d: _trip(s, _clusters(s, d).select(F.array_join("m", " ").alias("line")), "clusters", R.read_cluster_lines),
    "read_cdhit": _cdhit,
    "read_glimmer": lambda s, d: _glimmer(s, d).select("record_id", "type", "start", "stop", "strand", "feature_id", "parent"),
    "read_term_dictionary": _terms,
    "read_gaf": _gaf,
    "read_gene_table": _gene_table,
    "read_trnascan": lambda s, d: _trna(s, d).select("record_id", "start", "stop", "strand", "feature_id"),
    "write_partitioned_features": lambda s, d: _partitioned(s, d).select("type", "value"),
    "merge_split_locations": lambda s, d: R.merge_split_locations(view(s, d, "parts").withColumn("feature_id", F.col("parent"))).select("record_id", "feature_id", "type", "start", "stop", F.size("parts").alias("n"), "_error"),
    "codon_reference": lambda s, d: codon_reference(view(s, d, "part").select(F.col("p_brand").alias("organism"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * F.col("p_size") + 1).cast("string")), " ").alias("counts")), "Brand#11").groupBy("codon").agg(F.sum("n").alias("n")),
    "read_gff3": lambda s, d: _gff3(s, d).select("record_id", "type", "start", "stop", "strand", "feature_id", "parent", F.array_join(F.try_element_at("attrs", F.lit("note")), "|").alias("note"), "_error"),
    "read_fasta": lambda s, d: _fasta(s, d).select("seq_id", F.md5("seq").alias("seq")),
    "read_blast_tab": lambda s, d: _blast(s, d).select("qseqid", "sseqid", "length", "nident", "evalue", "salltitles"),
    "read_xmfa": lambda s, d: _xmfa(s, d).select("comment", "member", "stop", "strand", F.md5("seq").alias("seq")),
    "write_gff3": lambda s, d: W.gff3_lines(_tree(s, d)).select("line"),
    "write_fasta": lambda s, d: W.fasta_lines(view(s, d, "dna")).select("seq_id", F.md5("line").alias("line")),
    "write_bed": lambda s, d: W.bed_lines(view(s, d, "features")).select("line"),
    "write_wig": lambda s, d: W.wig_lines(fill_track(start_track(_reads(s, d)), _lengths(s, d))).groupBy("line").agg(F.count("*").alias("n")),
    "write_five_column": lambda s, d: W.five_column_lines(_tree(s, d)).select("line"),
}

_A1, _B1 = "CASE WHEN strand > 0 THEN start + 1 ELSE stop END", "CASE WHEN strand > 0 THEN stop ELSE start + 1 END"
_SIGN = "CASE WHEN strand > 0 THEN '+' ELSE '-' END"
ORACLE_SQL = {
    "read_mga": duckdb_sql("SELECT 'r' || record_id AS record_id, 'gene' AS type, start, stop, strand, feature_id, NULL AS parent FROM {features} UNION ALL SELECT 'r' || record_id, 'CDS', start, stop, strand, feature_id || '.cds', feature_id FROM {features}"),
    "read_gff3_regions": duckdb_sql("SELECT CAST(record_id AS VARCHAR) AS record_id, CASE WHEN record_id % 2 = 0 THEN record_id + 90000 ELSE max(stop) END AS length FROM {tree} GROUP BY record_id"),
    "split_gff_fasta": duckdb_sql("SELECT 's' || seq_id AS record_id, 's' || seq_id AS seq_id, 'f' || seq_id AS feature_id, 0 AS start, length(seq) AS stop, md5(seq) AS seq FROM {dna} WHERE length(seq) > 0"),
    "read_backbone": """WITH b AS (SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS block FROM customer)
        SELECT block, 0 AS genome, k * 10 + 1 AS start, k * 10 + 9 AS stop FROM b UNION ALL SELECT block, 1, k * 7 + 1, k * 7 + 5 FROM b WHERE k % 3 <> 0""",
    "read_blast_xml": duckdb_sql("SELECT 'q' || query AS query, CAST(subject AS VARCHAR) AS accession, 'protein ' || taxon AS title, slen, evalue, bitscore, qstart + 1 AS qstart, sstop AS send, nident, length FROM {hits}"),
    "read_genbank": duckdb_sql("SELECT 'r' || seq_id AS record_id, md5(seq) AS seq, 'CDS' AS type, 2 AS start, length(seq) + 20 AS stop, -1 AS strand, 2 AS parts, 'x:1,x:2' AS xrefs FROM {dna} WHERE length(seq) > 0"),
    "write_tsv": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
    "write_partitioned_sequences": duckdb_sql("SELECT coalesce(regexp_extract(description, '\\[(.*)\\]', 1), 'none') AS source, CAST(seq_id AS VARCHAR) AS seq_id, md5(seq) AS seq FROM {dna}"),
    "reformat": duckdb_sql(f"""SELECT record_id || chr(9) || 'again' || chr(9) || type || chr(9) || (start + 1) || chr(9) || stop || chr(9) || '.' || chr(9) || {_SIGN} || chr(9) || '.' || chr(9) || 'ID=' || feature_id || coalesce(';Parent=' || parent, '') || coalesce(';product=' || product, '') AS line FROM {{tree}}"""),
    "write_xmfa": duckdb_sql("""SELECT lcb, md5(string_agg(t, chr(10) ORDER BY turn) || chr(10) || '=') AS line FROM (SELECT conv_id AS lcb, turn, '> ' || turn || ':1-' || length(seq_a) || ' + x' || chr(10) || rtrim(regexp_replace(seq_a, '(.{80})', '\\1' || chr(10), 'g'), chr(10)) AS t FROM {aligned} WHERE length(seq_a) > 0) GROUP BY lcb"""),
    "read_sam_starts": duckdb_sql("SELECT CAST(record_id AS VARCHAR) AS record_id, strand, start, stop FROM {features}"),
    "read_five_column": duckdb_sql("SELECT 'r' || record_id AS record_id, type, start, stop, strand, product FROM {tree}"),
    "read_cluster_lines": "SELECT CAST(min(o_orderkey) OVER (PARTITION BY o_custkey) AS VARCHAR) AS cluster, CAST(o_orderkey AS VARCHAR) AS member FROM orders",
    "read_cdhit": "SELECT CAST(o_custkey AS VARCHAR) AS cluster_id, CAST(o_orderkey AS VARCHAR) AS member, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS representative FROM orders",
    "read_glimmer": duckdb_sql("SELECT 'r' || record_id AS record_id, 'gene' AS type, start, stop, strand, feature_id, NULL AS parent FROM {features} UNION ALL SELECT 'r' || record_id, 'CDS', start, stop, strand, feature_id || '.cds', feature_id FROM {features}"),
    "read_term_dictionary": "SELECT DISTINCT p_brand AS category, p_type AS term FROM part",
    "read_gaf": "SELECT CAST(s_suppkey AS VARCHAR) AS gene, s_name AS go_id FROM supplier",
    "read_gene_table": duckdb_sql("SELECT CAST(record_id AS VARCHAR) AS record_id, 'gene' AS type, start, stop, strand, feature_id || '%3Ba%3Db' AS name FROM {features}"),
    "read_trnascan": duckdb_sql("SELECT 'r' || record_id AS record_id, start, stop, strand, 'r' || record_id || '.trna.' || feature_id AS feature_id FROM {features}"),
    "write_partitioned_features": duckdb_sql(f"SELECT type, record_id || chr(9) || start || chr(9) || stop || chr(9) || feature_id || chr(9) || '0' || chr(9) || {_SIGN} AS value FROM {{features}}"),
    "merge_split_locations": duckdb_sql("SELECT record_id, parent AS feature_id, min(type) AS type, min(start) AS start, max(stop) AS stop, count(*) AS n, CASE WHEN count(DISTINCT type) > 1 THEN 'types differ' END AS _error FROM {parts} GROUP BY record_id, parent"),
    "codon_reference": "SELECT codon, CAST(sum(i * p_size + 1) AS BIGINT) AS n FROM part, (SELECT unnest([" + ", ".join(f"'{c}'" for c in codons()) + "]) AS codon, unnest(range(0, 64)) AS i) WHERE p_brand = 'Brand#11' GROUP BY codon",
    "read_gff3": duckdb_sql("SELECT CAST(record_id AS VARCHAR) AS record_id, type, start, stop, strand, feature_id, parent, 'a;b=c,d|' || type AS note, '' AS _error FROM {tree}"),
    "read_fasta": duckdb_sql("SELECT CAST(seq_id AS VARCHAR) AS seq_id, md5(seq) AS seq FROM {dna}"),
    "read_blast_tab": duckdb_sql("SELECT CAST(query AS VARCHAR) AS qseqid, CAST(subject AS VARCHAR) AS sseqid, CAST(length AS INT) AS length, CAST(nident AS INT) AS nident, round(evalue, 4) AS evalue, titles AS salltitles FROM {hits}"),
    "read_xmfa": duckdb_sql("SELECT 'c' || conv_id AS comment, CAST(turn * 2 + k AS INT) AS member, length(seq_a) AS stop, -1 AS strand, md5(CASE WHEN k = 0 THEN seq_a ELSE seq_b END) AS seq FROM {aligned}, (VALUES (0), (1)) v(k) WHERE length(seq_a) > 0"),
    "write_gff3": duckdb_sql(f"""SELECT record_id || chr(9) || 'genoloom' || chr(9) || type || chr(9) || (start + 1) || chr(9) || stop || chr(9) || '.' || chr(9) || {_SIGN} || chr(9) || '.' || chr(9) || 'ID=' || feature_id || coalesce(';Parent=' || parent, '') || coalesce(';product=' || product, '') AS line FROM {{tree}}"""),
    "write_fasta": duckdb_sql("SELECT seq_id, md5('>' || seq_id || chr(10) || rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10))) AS line FROM {dna}"),
    "write_bed": duckdb_sql(f"SELECT record_id || chr(9) || start || chr(9) || stop || chr(9) || feature_id || chr(9) || '0' || chr(9) || {_SIGN} AS line FROM {{features}}"),
    "write_wig": duckdb_sql(f"SELECT CASE WHEN pos = 0 THEN 'variableStep chrom=' || record_id || chr(10) ELSE '' END || (pos + 1) || ' ' || n AS line, count(*) AS n FROM {_TRACK} GROUP BY 1"),
    "write_five_column": duckdb_sql("SELECT CASE WHEN strand < 0 THEN stop ELSE start + 1 END || chr(9) || CASE WHEN strand < 0 THEN start + 1 ELSE stop END || chr(9) || type || coalesce(chr(10) || chr(9) || chr(9) || chr(9) || 'product' || chr(9) || product, '') AS line FROM {tree}"),
}
