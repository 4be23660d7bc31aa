"""Queries over similarity hits."""

from pyspark.sql import functions as F

from genoloom.operators import hits as H
from genoloom.plans.views import duckdb_sql, view

DICE = "2.0 * nident / (qlen + slen)"


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _taxa(s, d):
    return view(s, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("taxon"))


def _files(s, d):
    return view(s, d, "hits").withColumn("file", F.concat(F.lit("db"), (F.col("taxon") % 3).cast("string")))


QUERIES = {
    "related_genomes": lambda s, d: _r(H.related_genomes(view(s, d, "hits"), _taxa(s, d), 25), "dice"),
    "dice_column": lambda s, d: _r(H.dice_column(view(s, d, "hits")).select("query", "subject", "ord", "dice"), "dice"),
    "dice_filter": lambda s, d: H.dice_filter(view(s, d, "hits"), 0.6).select("query", "subject", "ord", "nident"),
    "all_pairs_dice": lambda s, d: _r(H.all_pairs_dice(view(s, d, "hits")).select("query", "subject", "ord", "dice"), "dice"),
    "bundle_hits": lambda s, d: _r(H.bundle_hits(view(s, d, "hits")), "dice"),
    "subject_counts": lambda s, d: H.subject_counts(view(s, d, "hits")),
    "related_proteomes": lambda s, d: H.related_proteomes(view(s, d, "hits"), _taxa(s, d), 15),
    "evalue_score": lambda s, d: _r(H.evalue_score(view(s, d, "hits")), "score", "mean", "median", "deviation"),
    "top_n_per_query": lambda s, d: H.top_n_per_query(view(s, d, "hits"), 2, order=("ord", "subject", "taxon")).select("query", "subject", "ord"),
    "split_titles": lambda s, d: H.split_titles(view(s, d, "hits").select("query", "subject", "ord", "titles")),
    "organism_from_title": lambda s, d: H.split_titles(view(s, d, "hits").select("query", "subject", "ord", "titles")).select("query", "subject", "ord", H.organism_from_title(F.col("title")).alias("organism")),
    "expand_taxa": lambda s, d: H.expand_taxa(
        view(s, d, "hits").select("query", "ord", F.concat_ws(";", F.col("taxon").cast("string"), (F.col("taxon") + 1).cast("string")).alias("taxids"), F.concat_ws(";", F.concat(F.lit("A"), F.col("subject").cast("string")), F.concat(F.lit("B"), F.col("subject").cast("string"))).alias("accessions")),
        without=_taxa(s, d).select(F.col("taxon").cast("string").alias("taxon")),
    ),
    "top_hit_columns": lambda s, d: H.top_hit_columns(view(s, d, "orders").select(F.col("o_orderkey").alias("feature_id")), _files(s, d), ["db0", "db1", "db2"]),
    "reopen_by_hits": lambda s, d: _r(H.reopen_by_hits(view(s, d, "hits").withColumn("qstop", F.when(F.col("ord") % 3 == 0, F.col("qstart") - 5).otherwise(F.col("qstop")))), "reversed_share"),
    "hsp_windows": lambda s, d: _r(H.hsp_windows(view(s, d, "hits"), 300, k=None), "share"),
    "hsp_groups": lambda s, d: _r(H.hsp_groups(view(s, d, "hits"), 300), "query_aligned", "identity", "subject_aligned"),
    "hit_features": lambda s, d: H.hit_features(view(s, d, "hits")),
}

_TAXA = "SELECT s_suppkey FROM supplier WHERE s_nationkey < 20"
ORACLE_SQL = {
    "related_genomes": duckdb_sql(f"""SELECT subject, taxon, CAST(sum(length) AS BIGINT) AS length, CAST(sum(nident) AS BIGINT) AS nident, round(sum({DICE}), 6) AS dice, count(*) AS hsps FROM {{hits}}
        WHERE taxon IN ({_TAXA}) GROUP BY subject, taxon ORDER BY round(sum({DICE}), 9) DESC, subject, taxon LIMIT 25"""),
    "dice_column": duckdb_sql(f"SELECT query, subject, ord, round({DICE}, 6) AS dice FROM {{hits}}"),
    "dice_filter": duckdb_sql(f"SELECT query, subject, ord, nident FROM {{hits}} WHERE {DICE} >= 0.6"),
    "all_pairs_dice": duckdb_sql(f"SELECT query, subject, ord, round({DICE}, 6) AS dice FROM {{hits}} WHERE query <> subject"),
    "bundle_hits": duckdb_sql(f"SELECT subject, taxon, CAST(sum(length) AS BIGINT) AS length, CAST(sum(nident) AS BIGINT) AS nident, round(sum({DICE}), 6) AS dice, count(*) AS hsps FROM {{hits}} GROUP BY subject, taxon"),
    "subject_counts": duckdb_sql("SELECT taxon, count(DISTINCT query) AS n FROM {hits} GROUP BY taxon"),
    "related_proteomes": duckdb_sql(f"SELECT taxon, count(DISTINCT query) AS n FROM {{hits}} WHERE taxon IN ({_TAXA}) GROUP BY taxon ORDER BY n DESC, taxon LIMIT 15"),
    "evalue_score": duckdb_sql("""SELECT taxon, round(sum(s), 6) AS score, count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS deviation
        FROM (SELECT taxon, abs(ln(evalue + 1e-250)) AS s FROM {hits}) GROUP BY taxon ORDER BY round(sum(s), 6) DESC, taxon LIMIT 10"""),
    "top_n_per_query": duckdb_sql("SELECT query, subject, ord FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord, subject, taxon) AS k FROM {hits}) WHERE k <= 2"),
    "split_titles": duckdb_sql("SELECT query, subject, ord, unnest(string_split(titles, '<>')) AS title FROM {hits}"),
    "organism_from_title": duckdb_sql("SELECT query, subject, ord, regexp_extract(title, '\\[(.*)\\]', 1) AS organism FROM (SELECT query, subject, ord, unnest(string_split(titles, '<>')) AS title FROM {hits})"),
    "expand_taxa": duckdb_sql(f"""SELECT query, ord, taxon, accession FROM (SELECT query, ord, CAST(h.taxon + t.i AS VARCHAR) AS taxon, a.p || CAST(subject AS VARCHAR) AS accession
        FROM {{hits}} h, (VALUES (0), (1)) t(i), (VALUES ('A'), ('B')) a(p)) WHERE taxon NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM ({_TAXA}))"""),
    "top_hit_columns": duckdb_sql(f"""WITH b AS (SELECT query, taxon % 3 AS f, subject, row_number() OVER (PARTITION BY query, taxon % 3 ORDER BY evalue, {DICE} DESC, subject) AS k FROM {{hits}})
        SELECT o_orderkey AS feature_id, max(CASE WHEN f = 0 THEN subject END) AS db0, max(CASE WHEN f = 1 THEN subject END) AS db1, max(CASE WHEN f = 2 THEN subject END) AS db2
        FROM orders LEFT JOIN b ON query = o_orderkey AND k = 1 GROUP BY o_orderkey"""),
    "reopen_by_hits": duckdb_sql("""WITH h AS (SELECT subject, qstart, CASE WHEN ord % 3 = 0 THEN qstart - 5 ELSE qstop END AS qstop, sstart, sstop FROM {hits})
        SELECT subject, round(avg(CASE WHEN (qstop - qstart) * (sstop - sstart) < 0 THEN 1 ELSE 0 END), 6) AS reversed_share, arg_min(qstart, (least(sstart, sstop), qstart)) AS query_start FROM h GROUP BY subject"""),
    "hsp_windows": duckdb_sql("""WITH r AS (SELECT subject, sstart AS lo, sstop AS hi, nident FROM {hits}), w AS (SELECT DISTINCT subject, lo FROM r),
        g AS (SELECT w.subject, w.lo, sum(r.nident) AS ident, max(r.hi) AS last FROM w JOIN r ON r.subject = w.subject AND r.lo >= w.lo AND r.hi <= w.lo + 360 GROUP BY w.subject, w.lo),
        o AS (SELECT *, max(last) OVER (PARTITION BY subject ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM g)
        SELECT subject, lo AS window_start, round(ident / 300.0, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ident DESC, lo) AS k FROM o WHERE reached IS NULL OR last > reached) WHERE k = 1"""),
    "hsp_groups": duckdb_sql("""WITH r AS (SELECT subject, sstart AS lo, sstop AS hi, nident, length, row_number() OVER (PARTITION BY subject ORDER BY sstart, sstop, nident, length) AS i FROM {hits}),
        g AS (SELECT x.subject, x.i, x.lo, count(*) AS hits, sum(y.length) AS aligned, sum(y.nident) AS nident, max(y.hi) AS last, min(y.hi) AS least FROM r x JOIN r y ON y.subject = x.subject AND (y.i = x.i OR y.i > x.i AND y.hi <= x.lo + 360) GROUP BY ALL),
        m AS (SELECT * FROM g x WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.subject = x.subject AND z.i < x.i AND x.last <= z.lo + 360)),
        n AS (SELECT x.subject, x.i, min(y.i) AS following FROM m x JOIN m y ON y.subject = x.subject AND y.i > x.i AND y.least > x.lo + 360 GROUP BY x.subject, x.i),
        k AS (SELECT subject, min(i) AS i FROM m GROUP BY subject UNION ALL SELECT n.subject, n.following FROM k JOIN n ON n.subject = k.subject AND n.i = k.i)
        SELECT m.subject, lo AS start, last AS stop, hits, CAST(aligned AS BIGINT) AS aligned, round(aligned / 300.0, 6) AS query_aligned, round(nident / 300.0, 6) AS identity, round(aligned / (last - lo), 6) AS subject_aligned FROM k JOIN m ON m.subject = k.subject AND m.i = k.i""").replace("WITH ", "WITH RECURSIVE ", 1),
    "hit_features": duckdb_sql("""SELECT query AS record_id, 'match' AS type, min(qstart) AS start, max(qstop) AS stop, min(evalue) AS evalue, query || '_' || subject AS feature_id, NULL AS parent FROM {hits} GROUP BY query, subject
        UNION ALL SELECT query, 'match_part', qstart, qstop, evalue, query || '_' || subject || '.' || row_number() OVER (PARTITION BY query, subject ORDER BY qstart, qstop, evalue, ord, taxon), query || '_' || subject FROM {hits}"""),
}
