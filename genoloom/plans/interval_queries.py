"""Queries over interval joins and interval sets."""

from pyspark.sql import functions as F

from genoloom.operators import intervals as I  # noqa: E741
from genoloom.plans.views import duckdb_sql, view


def _f(s, d, kind=None):
    f = view(s, d, "features")
    return f.where(F.col("type") == kind) if kind else f


def _regions(s, d):
    return view(s, d, "points").where("cast(feature_id as int) % 5 = 0").select("record_id", "start", "stop")


def _points(s, d):
    return view(s, d, "points").select("record_id", F.col("start").alias("pos")).distinct()


def _lengths(s, d):
    return view(s, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit(20200).alias("length"))


def _score(df):
    return df.select("record_id", F.round("density", 6).alias("density"), F.round("score", 6).alias("score"))


QUERIES = {
    "interval_intersect": lambda s, d: I.interval_intersect(_f(s, d), view(s, d, "points")).select("feature_id"),
    "interval_intersect_reverse": lambda s, d: I.interval_intersect(view(s, d, "points"), _f(s, d)).select("feature_id"),
    "interval_adjacent": lambda s, d: I.interval_adjacent(_f(s, d), view(s, d, "points"), 300, same_strand=True).select("feature_id"),
    "neighbours": lambda s, d: I.neighbours(_f(s, d, "gene"), _f(s, d, "CDS"), 400).select("feature_id"),
    "neighbours_unordered": lambda s, d: I.neighbours(_f(s, d, "gene"), _f(s, d, "CDS"), 400, ordered=False).select("feature_id"),
    "filter_regions": lambda s, d: I.filter_regions(_f(s, d), _regions(s, d)).select("feature_id"),
    "filter_contains_points": lambda s, d: I.filter_contains_points(_f(s, d), _points(s, d)).select("feature_id"),
    "features_in_range": lambda s, d: I.features_in_range(_f(s, d, "CDS"), _f(s, d, "RBS"), 500),
    "upstream_window": lambda s, d: I.upstream_window(_f(s, d, "CDS"), _f(s, d, "gene"), 600),
    "excessive_overlaps": lambda s, d: I.excessive_overlaps(_f(s, d, "CDS")),
    "pair_classify": lambda s, d: I.pair_totals(I.pair_classify(_f(s, d, "gene"), _f(s, d, "CDS"), 150)),
    "merge_intervals": lambda s, d: I.merge_intervals(_f(s, d)),
    "gaps": lambda s, d: I.gaps(_f(s, d)),
    "excessive_gaps": lambda s, d: I.excessive_gaps(_f(s, d), _lengths(s, d), 2000),
    "codable_mask": lambda s, d: I.codable_mask(_f(s, d), _lengths(s, d)),
    "intron_sequences": lambda s, d: I.intron_sequences(view(s, d, "parts").where("type = 'CDS'"), view(s, d, "dna").select((F.col("seq_id") + 1).alias("seq_id"), "seq")),
    "introns": lambda s, d: I.introns(view(s, d, "parts").where("type = 'CDS'")),
    "reading_frame": lambda s, d: _f(s, d, "gene").groupBy(I.reading_frame(F.col("start"), F.col("stop"), F.col("strand"), F.lit(20200)).alias("frame")).agg(F.count("*").alias("n")),
    "coding_density": lambda s, d: _score(I.coding_density(_f(s, d, "CDS"), _lengths(s, d))),
    "exact_coding_density": lambda s, d: _score(I.coding_density(_f(s, d, "CDS"), _lengths(s, d), exact=True)),
}

_MERGED = """m0 AS (SELECT record_id, start, stop, max(stop) OVER (PARTITION BY record_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {src}),
    m1 AS (SELECT *, sum(CASE WHEN reached IS NULL OR start > reached THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m0),
    m AS (SELECT record_id, min(start) AS start, max(stop) AS stop FROM m1 GROUP BY record_id, island)"""
_EDGES = "(SELECT record_id, start, stop FROM {features} UNION ALL SELECT p_partkey, 0, 0 FROM part UNION ALL SELECT p_partkey, 20200, 20200 FROM part)"
_GAPS = "SELECT record_id, stop AS start, nx AS stop FROM (SELECT *, lead(start) OVER (PARTITION BY record_id ORDER BY start) AS nx FROM m) WHERE nx IS NOT NULL"
_DENSITY = "SELECT record_id, round(dn, 6) AS density, round(exp(-pi() * pow((dn - 0.9) / 0.1, 2)), 6) AS score FROM (SELECT p_partkey AS record_id, coalesce(bases, 0) / 20200 AS dn FROM part LEFT JOIN (SELECT record_id, sum(stop - start) AS bases FROM {src} GROUP BY record_id) ON record_id = p_partkey)"


def _merged(src, rest):
    return duckdb_sql(f"WITH {_MERGED.replace('{src}', src)} {rest}")


ORACLE_SQL = {
    "interval_intersect": duckdb_sql("SELECT feature_id FROM {features} a WHERE EXISTS (SELECT 1 FROM {points} b WHERE a.record_id = b.record_id AND a.start < b.stop AND b.start < a.stop)"),
    "interval_intersect_reverse": duckdb_sql("SELECT feature_id FROM {points} a WHERE EXISTS (SELECT 1 FROM {features} b WHERE a.record_id = b.record_id AND a.start < b.stop AND b.start < a.stop)"),
    "interval_adjacent": duckdb_sql("SELECT feature_id FROM {features} a WHERE EXISTS (SELECT 1 FROM {points} b WHERE a.record_id = b.record_id AND a.strand = b.strand AND a.start - 300 < b.stop AND b.start < a.stop + 300)"),
    "neighbours": duckdb_sql("""SELECT feature_id FROM {features} b WHERE type = 'CDS' AND EXISTS (SELECT 1 FROM {features} a WHERE a.type = 'gene' AND a.record_id = b.record_id AND a.strand = b.strand
        AND a.start < b.stop + CASE WHEN b.strand > 0 THEN 0 ELSE 400 END AND b.start - CASE WHEN b.strand > 0 THEN 400 ELSE 0 END < a.stop)"""),
    "neighbours_unordered": duckdb_sql("SELECT feature_id FROM {features} b WHERE type = 'CDS' AND EXISTS (SELECT 1 FROM {features} a WHERE a.type = 'gene' AND a.record_id = b.record_id AND a.strand = b.strand AND a.start < b.stop + 400 AND b.start - 400 < a.stop)"),
    "filter_regions": duckdb_sql("SELECT feature_id FROM {features} a WHERE EXISTS (SELECT 1 FROM {points} b WHERE CAST(b.feature_id AS INT) % 5 = 0 AND a.record_id = b.record_id AND a.start <= b.stop AND b.start <= a.stop)"),
    "filter_contains_points": duckdb_sql("SELECT feature_id FROM {features} a WHERE EXISTS (SELECT 1 FROM {points} b WHERE a.record_id = b.record_id AND a.start <= b.start AND b.start < a.stop)"),
    "features_in_range": duckdb_sql("""SELECT centre, feature, distance FROM (SELECT a.feature_id AS centre, b.feature_id AS feature, greatest(0, a.start - b.stop, b.start - a.stop) AS distance
        FROM {features} a JOIN {features} b ON a.record_id = b.record_id WHERE a.type = 'RBS' AND b.type = 'CDS') WHERE distance <= 500"""),
    "upstream_window": duckdb_sql("""SELECT t.feature_id AS target, f.feature_id AS feature FROM {features} t JOIN {features} f ON t.record_id = f.record_id AND t.strand = f.strand WHERE t.type = 'gene' AND f.type = 'CDS'
        AND CASE WHEN t.strand > 0 THEN f.start >= t.start - 600 AND f.start < t.start ELSE f.stop - 1 >= t.stop AND f.stop - 1 < t.stop + 600 END"""),
    "excessive_overlaps": duckdb_sql("""SELECT a, b, bases FROM (SELECT x.feature_id AS a, y.feature_id AS b, least(x.stop, y.stop) - greatest(x.start, y.start) AS bases, x.strand = y.strand AS same
        FROM {features} x JOIN {features} y ON x.record_id = y.record_id AND x.feature_id < y.feature_id WHERE x.type = 'CDS' AND y.type = 'CDS') WHERE bases >= CASE WHEN same THEN 15 ELSE 30 END"""),
    "pair_classify": duckdb_sql("""SELECT kind, count(*) AS pairs, count(DISTINCT a) AS a_ends, count(DISTINCT b) AS b_ends FROM (SELECT x.feature_id AS a, y.feature_id AS b, CASE WHEN x.start <= y.start AND y.stop <= x.stop THEN 'embedded'
        WHEN least(x.stop, y.stop) - greatest(x.start, y.start) >= 6 THEN 'overlapping' ELSE 'separate' END AS kind FROM {features} x JOIN {features} y ON x.record_id = y.record_id AND x.strand = y.strand
        WHERE x.type = 'gene' AND y.type = 'CDS' AND greatest(x.start, y.start) - least(x.stop, y.stop) <= 150) GROUP BY kind"""),
    "merge_intervals": _merged("{features}", "SELECT * FROM m"),
    "gaps": _merged("{features}", _GAPS),
    "excessive_gaps": _merged(_EDGES, f"SELECT * FROM ({_GAPS}) WHERE stop - start >= 2000"),
    "codable_mask": duckdb_sql(f"""WITH {_MERGED.replace('{src}', _EDGES)}, g AS ({_GAPS}), {_MERGED.replace('{src}', '{features}').replace('m0', 'n0').replace('m1', 'n1').replace('m AS', 'n AS')}
        SELECT record_id, start, stop, true AS masked FROM n UNION ALL SELECT record_id, start, stop, false FROM g WHERE stop > start"""),
    "intron_sequences": duckdb_sql("""WITH m0 AS (SELECT record_id, parent, start, max(stop) OVER (PARTITION BY record_id, parent ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {parts} WHERE type = 'CDS')
        SELECT record_id, parent, string_agg(substring(seq, reached + 1, start - reached), '' ORDER BY start) AS seq FROM m0 JOIN {dna} ON seq_id + 1 = record_id WHERE start > reached GROUP BY record_id, parent"""),
    "introns": duckdb_sql("""WITH m0 AS (SELECT record_id, parent, start, stop, max(stop) OVER (PARTITION BY record_id, parent ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {parts} WHERE type = 'CDS')
        SELECT record_id, parent, reached AS start, start AS stop, row_number() OVER (PARTITION BY record_id, parent ORDER BY start) AS n FROM m0 WHERE start > reached"""),
    "reading_frame": duckdb_sql("SELECT CAST(CASE WHEN strand > 0 THEN start % 3 + 1 ELSE (20200 - stop) % 3 + 4 END AS INT) AS frame, count(*) AS n FROM {features} WHERE type = 'gene' GROUP BY 1"),
    "coding_density": duckdb_sql(_DENSITY.replace("{src}", "(SELECT * FROM {features} WHERE type = 'CDS')")),
    "exact_coding_density": _merged("(SELECT * FROM {features} WHERE type = 'CDS')", _DENSITY.replace("{src}", "m")),
}
