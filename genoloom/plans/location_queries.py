"""Queries over features of several parts."""

from pyspark.sql import functions as F

from genoloom.operators import locations as L
from genoloom.plans.feature_queries import _f, _seqs
from genoloom.plans.sequence_queries import _PROTEIN, _WHOLE
from genoloom.plans.source_queries import _path
from genoloom.plans.views import duckdb_sql, view
from genoloom.sources import readers as R
from genoloom.sources import writers as W


def _spliced(s, d):
    """The coding parts of a gene as one feature."""
    cds = view(s, d, "parts").where("type = 'CDS'").withColumn("feature_id", F.col("parent"))
    return R.merge_split_locations(cds)


def _circles(s, d):
    """Coding features that begin inside a record of at least their length, and the records' lengths."""
    lengths = _seqs(s, d).select(F.col("seq_id").alias("record_id"), F.length("seq").alias("length"))
    cds = _f(s, d, "CDS").join(lengths, "record_id").where("start < length and stop - start <= length")
    return L.over_origin(cds.drop("length"), lengths).select(*(c for c in cds.columns if c != "length"), "parts")


def _named(s, d):
    return _f(s, d, "CDS").withColumn("locus_tag", F.when(F.col("start") % 3 > 0, F.concat(F.lit("t "), (F.col("start") % 40).cast("string")))).withColumn("phase", (F.col("start") % 3).cast("int"))


def _seq(df):
    return df.withColumn("seq", F.md5("seq"))


def _genbank(s, d):
    n = F.length("seq").cast("string")
    at = "                     "
    text = F.concat(
        F.lit("LOCUS       r"), F.col("seq_id").cast("string"), F.lit(" "), n, F.lit(" bp DNA\nFEATURES             Location/Qualifiers\n     CDS             join(complement(3..9),\n" + at + "12.."), n,
        F.lit(f')\n{at}/translation="MK\n{at}VL"\n{at}/note="a ""b"" and\n{at}/c"\n     gene            complement(join(J00194.1:100..202,3..9,12..'), n, F.lit(f'))\n{at}/gene="g"\nORIGIN\n        1 '), F.col("seq"),
    )
    path = _path(s, "gbk")
    W.write_lines(view(s, d, "dna").where("length(seq) >= 40").select(F.concat(text, F.lit("\n//")).alias("line")), path)
    first = lambda k: F.try_element_at(F.try_element_at("attrs", F.lit(k)), F.lit(1)).alias(k)
    return R.read_genbank(s, path)[1].select("record_id", "n", "type", "start", "stop", "strand", L.location_text(F.col("parts")).alias("location"), first("translation"), first("note"))


QUERIES = {
    "seq_feature_extract_parts": lambda s, d: _seq(L.part_sequences(_spliced(s, d).select("record_id", "feature_id", "start", "stop", "strand", "parts"), _seqs(s, d)).select("record_id", "feature_id", "seq")),
    "seq_feature_extract_origin": lambda s, d: _seq(L.part_sequences(_circles(s, d), _seqs(s, d)).select("feature_id", "seq")),
    "seq_feature_extract_phase": lambda s, d: _seq(L.extract_features(_named(s, d), _seqs(s, d), "all")),
    "seq_feature_extract_nice": lambda s, d: _seq(L.extract_features(_named(s, d), _seqs(s, d), "nice")),
    "seq_feature_extract_unique": lambda s, d: _seq(L.extract_features(_named(s, d).withColumn("feature_id", F.concat(F.lit("f "), (F.col("start") % 40).cast("string"))), _seqs(s, d), "unique", describe=False)),
    "feature_export_parts": lambda s, d: _seq(L.export_features(_spliced(s, d).withColumn("type", F.lit("CDS")), _seqs(s, d), ["CDS"], 6, 3)).drop("record_id"),
    "feature_export_proteins": lambda s, d: _seq(L.export_features(_named(s, d).withColumn("codon_start", F.col("phase") + 1), _seqs(s, d), ["CDS"], translate=True, strip_stops=True)).drop("record_id"),
    "read_genbank_parts": _genbank,
}

_TURN = "CASE WHEN strand < 0 THEN reverse(translate({q}, 'ACGT', 'TGCA')) ELSE {q} END"
_RECORDS = "(SELECT seq_id + 1 AS record_id, seq AS whole FROM {dna})"
_NAMED = f"(SELECT f.*, whole, CASE WHEN start % 3 > 0 THEN 't ' || start % 40 END AS locus_tag, start % 3 AS phase, CASE WHEN strand > 0 THEN '+' ELSE '-' END AS sign FROM {{features}} f JOIN {_RECORDS} USING (record_id) WHERE type = 'CDS')"
_CUT = "substring(whole, lo + 1, hi - lo)"
_TRIMMED = f"(SELECT *, CASE WHEN strand < 0 THEN start ELSE start + phase END AS lo, CASE WHEN strand < 0 THEN stop - phase ELSE stop END AS hi FROM {_NAMED})"
ORACLE_SQL = {
    "seq_feature_extract_parts": duckdb_sql(f"""SELECT record_id, parent AS feature_id, md5(string_agg({_TURN.format(q='substring(whole, start + 1, stop - start)')}, '' ORDER BY strand * start, strand * stop)) AS seq
        FROM {{parts}} JOIN {_RECORDS} USING (record_id) WHERE type = 'CDS' GROUP BY record_id, parent"""),
    "seq_feature_extract_origin": duckdb_sql(f"SELECT feature_id, md5({_TURN.format(q='substring(whole || whole, start + 1, stop - start)')}) AS seq FROM {{features}} JOIN {_RECORDS} USING (record_id) WHERE type = 'CDS' AND start < length(whole) AND stop - start <= length(whole)"),
    "seq_feature_extract_phase": duckdb_sql(f"SELECT record_id, feature_id, feature_id AS id, '[Location=[' || (lo + 1) || ':' || hi || '](' || sign || ')]' AS description, md5({_TURN.format(q=_CUT)}) AS seq FROM {_TRIMMED}"),
    "seq_feature_extract_nice": duckdb_sql(f"""SELECT record_id, feature_id, tag || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS id, ' [Location=[' || start || ':' || stop || '](' || sign || ');ID=' || feature_id || ']' AS description, md5({_TURN.format(q='substring(whole, start + 1, stop - start)')}) AS seq
        FROM (SELECT *, row_number() OVER (PARTITION BY record_id, tag ORDER BY start, stop, feature_id) AS k FROM (SELECT *, replace(coalesce(locus_tag, feature_id), ' ', '-') AS tag FROM {_NAMED}))"""),
    "seq_feature_extract_unique": duckdb_sql(f"""SELECT record_id, 'f ' || start % 40 AS feature_id, tag || CASE WHEN k > 1 THEN '__' || md5(tag || ':' || k) ELSE '' END AS id, '' AS description, md5({_TURN.format(q=_CUT)}) AS seq
        FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY start, stop, lo, hi, strand) AS k FROM (SELECT *, record_id || '____f-' || start % 40 AS tag FROM {_TRIMMED}))"""),
    "feature_export_parts": duckdb_sql(f"""SELECT parent AS feature_id, string_agg('[start=' || (lo + 1) || ',end=' || hi || ']', ', joined with ' ORDER BY k) AS definition, md5(string_agg({_TURN.format(q=_CUT)}, '' ORDER BY k)) AS seq FROM
        (SELECT *, greatest(0, start - CASE WHEN strand > 0 AND k = 1 THEN 6 WHEN strand < 0 AND k = n THEN 3 ELSE 0 END) AS lo, stop + CASE WHEN strand < 0 AND k = 1 THEN 6 WHEN strand > 0 AND k = n THEN 3 ELSE 0 END AS hi FROM
        (SELECT *, row_number() OVER (PARTITION BY record_id, parent ORDER BY strand * start, strand * stop) AS k, count(*) OVER (PARTITION BY record_id, parent) AS n FROM {{parts}} JOIN {_RECORDS} USING (record_id) WHERE type = 'CDS')) GROUP BY record_id, parent"""),
    "feature_export_proteins": duckdb_sql(f"""SELECT feature_id, '[start=' || (start + 1) || ',end=' || stop || ']' AS definition, md5(regexp_replace(CASE WHEN {_WHOLE} THEN 'M' || substring(p, 2) ELSE p END, '\\*$', '')) AS seq
        FROM (SELECT *, split_part(p, '*', 1) AS body FROM (SELECT *, coalesce({_PROTEIN}, '') AS p FROM (SELECT *, {_TURN.format(q=_CUT)} AS seq FROM {_TRIMMED})))"""),
    "read_genbank_parts": duckdb_sql("""SELECT 'r' || seq_id AS record_id, 0 AS n, 'CDS' AS type, 2 AS start, length(seq) AS stop, 0 AS strand, 'join(complement(3..9),12..' || length(seq) || ')' AS location, 'MKVL' AS translation, 'a "b" and /c' AS note FROM {dna} WHERE length(seq) >= 40
        UNION ALL SELECT 'r' || seq_id, 1, 'gene', 2, length(seq), -1, 'complement(join(3..9,12..' || length(seq) || '))', NULL, NULL FROM {dna} WHERE length(seq) >= 40"""),
}
