"""Queries over record editing and composed tables."""

from pyspark.sql import functions as F

from genoloom.operators import alignment as A
from genoloom.operators import editing as E
from genoloom.operators import sequences as Q
from genoloom.plans.feature_queries import _f, _seqs, _tree
from genoloom.plans.relation_queries import _members
from genoloom.plans.scan_queries import _UP, _cds, _proteins
from genoloom.plans.views import duckdb_sql, view


def _lengths(s, d):
    return view(s, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit(20200).alias("length"))


def _cuts(s, d):
    return view(s, d, "part").select(F.col("p_partkey").alias("record_id"), (F.col("p_size") * 100).cast("long").alias("start"), (F.col("p_size") * 100 + 9000).cast("long").alias("stop"), F.col("p_partkey").alias("cut"))


def _changes(s, d):
    n = view(s, d, "lineitem").groupBy(F.col("l_partkey").alias("record_id"), F.col("l_linenumber").alias("n")).agg((F.max("l_suppkey") * 7 % 300).alias("start"))
    return n.select("record_id", "n", "start", (F.col("start") + 40).alias("stop"), F.when(F.col("n") % 2 == 0, -1).otherwise(1).alias("strand"), F.when(F.col("n") % 5 == 0, "NNN").alias("insert"))


def _classes(s, d):
    return view(s, d, "features").select("feature_id", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("start") % 3 + 1).cast("int")).alias("class"))


def _flat(s, d):
    return _tree(s, d).where("type <> 'gene'").withColumn("locus_tag", F.when(F.col("start") % 4 > 0, F.col("parent")))


def _shifted(s, d):
    f = _f(s, d, "CDS")
    return f.where("start % 5 <> 0").withColumn("stop", F.when(F.col("start") % 2 == 0, F.col("stop") + 6).otherwise(F.col("stop"))).withColumn("feature_id", F.concat("feature_id", F.lit("b")))


def _compared(s, d, least=0.7):
    named = lambda f, k: f.withColumn("product", F.when(F.col("start") % k == 0, "hypothetical protein").otherwise("tail fiber"))
    return A.annotation_compare(named(_f(s, d, "CDS"), 3), named(_shifted(s, d), 2), _seqs(s, d), least=least)


def _round(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


CODES = {"x": "A", "y": "B"}
QUERIES = {
    "safe_rotate": lambda s, d: E.safe_rotate(_seqs(s, d), _f(s, d), 5000).select("record_id", "at", F.md5("seq").alias("seq")),
    "subsection": lambda s, d: E.subsection(_f(s, d), _cuts(s, d)),
    "cut_sequences": lambda s, d: E.cut_sequences(_seqs(s, d), _cuts(s, d)).select("cut", F.md5("seq").alias("seq")),
    "section_by_locus": lambda s, d: E.section_by_locus(_tree(s, d), "g1", "g2"),
    "section_by_qualifier": lambda s, d: E.section_by_qualifier(_f(s, d), F.col("type") == "RBS", 200, 50, _lengths(s, d)),
    "one_step_codons": lambda s, d: E.one_step_codons(view(s, d, "dna"), ["*", "W"]),
    "edit_genome": lambda s, d: E.edit_genome(_seqs(s, d), _changes(s, d)),
    "add_terminal_repeat": lambda s, d: E.add_terminal_repeat(_f(s, d), 3000, _lengths(s, d)).select("feature_id", "start", "stop"),
    "suppress_stops": lambda s, d: E.suppress_stops(_cds(s, d), "TAG"),
    "gram_stain": lambda s, d: E.gram_stain(view(s, d, "part").select(F.col("p_type").alias("host")).distinct(), view(s, d, "region").select(F.upper(F.regexp_extract("r_name", "^(.)", 1)).alias("name"), F.lit("none").alias("stain")).distinct().unionByName(view(s, d, "part").select(F.substring_index("p_type", " ", 1).alias("name"), F.lit("positive").alias("stain")).distinct())),
    "record_metadata": lambda s, d: E.record_metadata(view(s, d, "supplier").select(F.col("s_suppkey").alias("record_id"), "s_name", "s_nationkey"), ["s_name", "s_nationkey"]),
    "cleavage_sites": lambda s, d: E.cleavage_sites(_f(s, d, "CDS").select("feature_id", (F.col("start") % 20 + 1).alias("pos")), _f(s, d)),
    "sar_table": lambda s, d: E.sar_table(_proteins(s, d), 6, 9),
    "inner_candidates": lambda s, d: E.inner_candidates(view(s, d, "dna")),
    "outer_candidates": lambda s, d: E.outer_candidates(view(s, d, "dna")),
    "single_candidates": lambda s, d: E.single_candidates(view(s, d, "dna")),
    "candidate_summary": lambda s, d: _round(E.length_summary(E.inner_candidates(view(s, d, "dna")))),
    "cassette_string": lambda s, d: E.cassette_string(_f(s, d), _classes(s, d), CODES),
    "feature_export": lambda s, d: E.feature_export(_f(s, d), _seqs(s, d), 30, 10).select("feature_id", F.md5("seq").alias("seq")),
    "require_start_codon": lambda s, d: E.require_start_codon(view(s, d, "tree"), _seqs(s, d)).select("feature_id"),
    "require_sd": lambda s, d: E.require_sd(_f(s, d, "gene"), _seqs(s, d)),
    "cluster_sizes": lambda s, d: _round(E.cluster_sizes(view(s, d, "orders").select(F.col("o_custkey").alias("cluster")), 10)),
    "read_subset": lambda s, d: E.read_subset(view(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("length")), 20000, 3.0, "o_orderkey"),
    "block_split": lambda s, d: E.block_split(_members(s, d), 25, 0.85),
    "hits_to_alignment_rows": lambda s, d: E.hits_to_alignment_rows(view(s, d, "hits").withColumn("sstop", F.when(F.col("ord") % 2 == 0, F.col("sstart") - 9).otherwise(F.col("sstop"))).withColumn("qlen", F.lit(5100))),
    "flatten_for_submission": lambda s, d: E.flatten_for_submission(view(s, d, "tree"), "gp"),
    "gbk_to_tree": lambda s, d: E.gbk_to_tree(_flat(s, d)).select("feature_id", "parent", "start", "stop"),
    "export_names": lambda s, d: E.export_names(view(s, d, "part").select(F.col("p_partkey").alias("record_id"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Phage "), F.col("p_brand"))).when(F.col("p_size") % 3 == 1, F.col("p_name")).alias("title"))),
    "proximity_classes": lambda s, d: E.proximity_classes(_f(s, d, "CDS"), _f(s, d, "gene").join(_classes(s, d), "feature_id"), 900),
    "annotation_table": lambda s, d: E.annotation_table(_f(s, d), _seqs(s, d), _f(s, d).where("start % 3 = 0").select("feature_id", F.concat(F.lit("GO:"), F.col("strand").cast("string")).alias("go_id"))),
    "annotation_overlaps": lambda s, d: E.overlap_compare(_f(s, d, "CDS"), _shifted(s, d)),
    "annotation_compare": lambda s, d: _compared(s, d).select("record_id", "first", "second", "similarity", "identity", "length_difference", "length_class", "hypothetical", "first_place", "second_place"),
    "annotation_compare_exact": lambda s, d: _compared(s, d, 1.0).select("record_id", "first", "second", "similarity", "identity", "length_class"),
    "annotation_summary": lambda s, d: A.annotation_summary(_compared(s, d)),
    "qc_corrected_genes": lambda s, d: E.qc_corrected_genes(_f(s, d, "gene"), _f(s, d, "CDS")),
    "aa_fraction_codons": lambda s, d: Q.codon_fraction_table(view(s, d, "dna")).select("seq_id", F.round("ATG", 6).alias("atg"), F.round("TTT", 6).alias("ttt")),
}

_MERGED = """m0 AS (SELECT record_id, start, stop, max(stop) OVER (PARTITION BY record_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {src}),
    m1 AS (SELECT *, sum(CASE WHEN reached IS NULL OR start > reached THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m0),
    m AS (SELECT record_id, min(start) AS start, max(stop) AS stop FROM m1 GROUP BY record_id, island)"""
_RECORDS = "(SELECT seq_id + 1 AS record_id, seq FROM {dna})"
_FLIP = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_CODON_AT = "SELECT seq_id, unnest(range(0, length(seq) // 3)) AS pos, unnest(list_transform(range(0, length(seq) // 3), lambda i: substring(seq, CAST(i * 3 + 1 AS BIGINT), 3))) AS codon FROM {dna}"


def _near(targets, number=11):
    from genoloom.functions import codon as C

    t = C.table(number)
    return ", ".join(f"'{c}'" for c in t if any(t[o] in targets and sum(x != y for x, y in zip(c, o)) == 1 for o in t))


ORACLE_SQL = {
    "safe_rotate": duckdb_sql(f"""WITH {_MERGED.replace('{src}', '{features}')}, g AS (SELECT record_id, CAST(floor((stop + nx) / 2) AS BIGINT) AS at_ FROM (SELECT *, lead(start) OVER (PARTITION BY record_id ORDER BY start) AS nx FROM m) WHERE nx IS NOT NULL),
        n AS (SELECT record_id, arg_min(at_, (abs(at_ - 5000), at_)) AS at_ FROM g GROUP BY record_id), r AS (SELECT s.record_id, at_, seq, coalesce(at_, 0) % greatest(length(seq), 1) AS k FROM {_RECORDS} s LEFT JOIN n ON n.record_id = s.record_id)
        SELECT record_id, at_ AS "at", md5(substring(seq, k + 1) || substring(seq, 1, k)) AS seq FROM r"""),
    "subsection": duckdb_sql("SELECT p_partkey AS cut, feature_id, start - p_size * 100 AS start, stop - p_size * 100 AS stop FROM {features} JOIN part ON p_partkey = record_id WHERE start >= p_size * 100 AND stop <= p_size * 100 + 9000"),
    "cut_sequences": duckdb_sql(f"SELECT p_partkey AS cut, md5(substring(seq, p_size * 100 + 1, 9000)) AS seq FROM part JOIN {_RECORDS} ON record_id = p_partkey"),
    "section_by_locus": duckdb_sql("SELECT record_id, min(start) AS start, max(stop) AS stop FROM {tree} WHERE feature_id IN ('g1', 'g2') GROUP BY record_id HAVING count(DISTINCT feature_id) = 2"),
    "section_by_qualifier": duckdb_sql(f"""WITH {_MERGED.replace('{src}', "(SELECT record_id, greatest(start - CASE WHEN strand > 0 THEN 200 ELSE 50 END, 0) AS start, least(stop + CASE WHEN strand > 0 THEN 50 ELSE 200 END, 20200) AS stop FROM {features} WHERE type = 'RBS')")} SELECT * FROM m"""),
    "one_step_codons": duckdb_sql(f"SELECT seq_id, pos, codon, count(*) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS count FROM ({_CODON_AT}) WHERE codon IN ({_near(['*', 'W'])})"),
    "edit_genome": duckdb_sql(f"""WITH c AS (SELECT l_partkey AS record_id, l_linenumber AS n, max(l_suppkey) * 7 % 300 AS start FROM lineitem GROUP BY 1, 2),
        p AS (SELECT c.record_id, n, CASE WHEN n % 5 = 0 THEN 'NNN' WHEN n % 2 = 0 THEN reverse(translate(substring(seq, start + 1, 40), 'ACGT', 'TGCA')) ELSE substring(seq, start + 1, 40) END AS s FROM c JOIN {_RECORDS} r ON r.record_id = c.record_id),
        a AS (SELECT *, CAST(coalesce(sum(length(s)) OVER (PARTITION BY record_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM p)
        SELECT record_id, string_agg(s, '' ORDER BY n) AS seq, string_agg(n || ':' || o || ':' || length(s), ',' ORDER BY n) AS chain FROM a GROUP BY record_id"""),
    "add_terminal_repeat": duckdb_sql("SELECT feature_id, start, stop FROM {features} UNION ALL SELECT feature_id || '.tr', start + 20200, stop + 20200 FROM {features} WHERE stop <= 3000"),
    "gram_stain": duckdb_sql("SELECT DISTINCT p_type AS host, 'positive' AS stain FROM part"),
    "record_metadata": duckdb_sql("SELECT s_suppkey AS record_id, 's_name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier"),
    "cleavage_sites": duckdb_sql("SELECT feature_id, c - 1 AS start, c + 2 AS stop, strand FROM (SELECT feature_id, strand, CASE WHEN strand > 0 THEN start + 3 * (start % 20 + 1) ELSE stop - 3 * (start % 20 + 1) END AS c FROM {features} WHERE type = 'CDS')"),
    "cassette_string": duckdb_sql(f"""WITH c AS (SELECT record_id, string_agg(CASE WHEN strand > 0 THEN k ELSE lower(k) END, '' ORDER BY start, stop, feature_id) AS t FROM (SELECT *, CASE start % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS k FROM {{features}} WHERE type = 'CDS' AND start % 3 < 2) GROUP BY record_id)
        SELECT record_id, least(t, reverse({_FLIP.format('t')})) AS cassette FROM c WHERE length(t) >= 5"""),
    "feature_export": duckdb_sql(f"""SELECT feature_id, md5(CASE WHEN strand < 0 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END) AS seq FROM (SELECT feature_id, strand, substring(seq, lo + 1, hi - lo) AS q FROM (SELECT *, greatest(0, start - CASE WHEN strand > 0 THEN 30 ELSE 10 END) AS lo, stop + CASE WHEN strand > 0 THEN 10 ELSE 30 END AS hi FROM {{features}}) f JOIN {_RECORDS} r ON r.record_id = f.record_id)"""),
    "require_start_codon": duckdb_sql(f"""SELECT feature_id FROM {{tree}} WHERE type = 'gene' AND feature_id IN (SELECT parent FROM (SELECT parent, CASE WHEN strand < 0 THEN reverse(translate(substring(seq, start + 1, stop - start), 'ACGT', 'TGCA')) ELSE substring(seq, start + 1, stop - start) END AS q
        FROM {{tree}} t JOIN {_RECORDS} r ON r.record_id = t.record_id WHERE type = 'CDS') WHERE left(q, 3) IN ('ATG', 'GTG', 'TTG'))""", once=True),
    "cluster_sizes": duckdb_sql("SELECT o_custkey AS cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY o_custkey HAVING count(*) >= 10"),
    "read_subset": duckdb_sql("SELECT o_orderkey, length FROM (SELECT o_orderkey, o_custkey % 200 AS length, coalesce(sum(o_custkey % 200) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 60000"),
    "hits_to_alignment_rows": duckdb_sql("""SELECT query, CASE WHEN rev THEN 16 ELSE 0 END AS flag, subject, least(sstart, sstop) AS pos, CASE WHEN a > 0 THEN a || 'H' ELSE '' END || (qstop - qstart + 1) || 'M' || CASE WHEN b > 0 THEN b || 'H' ELSE '' END AS cigar
        FROM (SELECT *, CASE WHEN rev THEN 5100 - qstop ELSE qstart - 1 END AS a, CASE WHEN rev THEN qstart - 1 ELSE 5100 - qstop END AS b FROM (SELECT query, subject, qstart, qstop, sstart, s AS sstop, s < sstart AS rev FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN sstart - 9 ELSE sstop END AS s FROM {hits})))"""),
    "flatten_for_submission": duckdb_sql("""WITH g AS (SELECT feature_id, 'gp_' || lpad(CAST(row_number() OVER (PARTITION BY record_id ORDER BY start, stop, feature_id) AS VARCHAR), 4, '0') AS tag FROM {tree} WHERE type = 'gene'),
        t AS (SELECT *, CASE WHEN type = 'exon' AND stop - start < 20 THEN 'Shine_Dalgarno_sequence' ELSE type END AS k FROM {tree})
        SELECT record_id, CASE WHEN k = 'Shine_Dalgarno_sequence' THEN 'regulatory' ELSE k END AS type, start, stop, strand, g.tag AS locus_tag, product AS note FROM t LEFT JOIN g ON g.feature_id = coalesce(t.parent, t.feature_id) WHERE k NOT IN ('mRNA', 'exon', 'region', 'remark')""", once=True),
    "gbk_to_tree": duckdb_sql("""WITH f AS (SELECT *, CASE WHEN start % 4 > 0 THEN parent END AS tag FROM {tree} WHERE type <> 'gene'), g AS (SELECT record_id, 'gene-' || record_id || '-' || tag AS gene, min(start) AS start, max(stop) AS stop FROM f WHERE tag IS NOT NULL GROUP BY record_id, tag),
        o AS (SELECT f.feature_id, arg_min(gene, (g.stop - g.start, gene)) AS parent FROM f JOIN g ON g.record_id = f.record_id AND g.start <= f.start AND f.stop <= g.stop WHERE tag IS NULL GROUP BY f.feature_id)
        SELECT gene AS feature_id, NULL AS parent, start, stop FROM g UNION ALL SELECT f.feature_id, CASE WHEN tag IS NOT NULL THEN 'gene-' || record_id || '-' || tag ELSE o.parent END, start, stop FROM f LEFT JOIN o ON o.feature_id = f.feature_id"""),
    "export_names": duckdb_sql("SELECT p_partkey AS record_id, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS name FROM part"),
    "proximity_classes": duckdb_sql("""SELECT c.feature_id, string_agg(DISTINCT k, ',' ORDER BY k) AS near FROM {features} c JOIN (SELECT *, CASE start % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS k FROM {features} WHERE type = 'gene') g ON g.record_id = c.record_id AND c.start - 900 < g.stop AND g.start < c.stop + 900 WHERE c.type = 'CDS' GROUP BY c.feature_id"""),
    "annotation_table": duckdb_sql(f"""WITH {_UP.replace("type = 'gene'", "type = 'CDS'")}, sd AS (SELECT feature_id, motif AS sd, gap AS sd_gap FROM h WHERE k = 1),
        un AS (SELECT feature_id, lag(feature_id) OVER w AS upstream, start - lag(stop) OVER w AS distance FROM {{features}} WHERE strand > 0 AND type = 'CDS' WINDOW w AS (PARTITION BY record_id ORDER BY stop, start, feature_id)
        UNION ALL SELECT feature_id, lead(feature_id) OVER z, lead(start) OVER z - stop FROM {{features}} WHERE strand <= 0 AND type = 'CDS' WINDOW z AS (PARTITION BY record_id ORDER BY start, stop, feature_id)),
        c AS (SELECT f.*, CASE WHEN strand < 0 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS t FROM (SELECT f.*, substring(seq, start + 1, stop - start) AS q FROM {{features}} f LEFT JOIN {_RECORDS} r ON r.record_id = f.record_id WHERE type = 'CDS') f)
        SELECT record_id, c.feature_id, c.start, c.stop, c.strand, left(t, 3) AS first_codon, right(t, 3) AS last_codon, sd, sd_gap, upstream, distance, CASE WHEN c.start % 3 = 0 THEN 'GO:' || c.strand END AS terms
        FROM c LEFT JOIN sd ON sd.feature_id = c.feature_id LEFT JOIN un ON un.feature_id = c.feature_id"""),
    "annotation_compare_exact": duckdb_sql(f"""WITH x AS (SELECT f.record_id, feature_id, start, stop, row_number() OVER (PARTITION BY f.record_id ORDER BY start, stop, feature_id) AS k, CASE WHEN strand < 0 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS q FROM (SELECT *, substring(seq, start + 1, stop - start) AS q FROM {{features}} f JOIN {_RECORDS} r USING (record_id) WHERE type = 'CDS') f),
        y AS (SELECT f.record_id, feature_id, row_number() OVER (PARTITION BY f.record_id ORDER BY start, stop, feature_id) AS k, CASE WHEN strand < 0 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS q FROM (SELECT record_id, feature_id || 'b' AS feature_id, start, strand, stop, substring(seq, start + 1, stop - start) AS q FROM (SELECT record_id, feature_id, start, strand, seq, CASE WHEN start % 2 = 0 THEN stop + 6 ELSE stop END AS stop FROM {{features}} JOIN {_RECORDS} r USING (record_id) WHERE type = 'CDS' AND start % 5 <> 0)) f),
        m AS (SELECT x.record_id, x.feature_id AS a, y.feature_id AS b, row_number() OVER (PARTITION BY x.record_id, x.feature_id ORDER BY abs(x.k - y.k), y.feature_id) AS r1, row_number() OVER (PARTITION BY x.record_id, y.feature_id ORDER BY abs(x.k - y.k), x.feature_id) AS r2 FROM x JOIN y ON x.record_id = y.record_id AND x.q = y.q AND x.q <> '' AND abs(x.k - y.k) <= 10),
        p AS (SELECT * FROM m WHERE r1 = 1 AND r2 = 1)
        SELECT record_id, a AS first, b AS second, 'Exact match' AS similarity, 100.0::DOUBLE AS identity, 'Same Length' AS length_class FROM p
        UNION ALL SELECT record_id, feature_id, NULL, 'In First but not Second', 0.0, NULL FROM x WHERE (record_id, feature_id) NOT IN (SELECT record_id, a FROM p) UNION ALL SELECT record_id, NULL, feature_id, 'In Second but not First', 0.0, NULL FROM y WHERE (record_id, feature_id) NOT IN (SELECT record_id, b FROM p)"""),
    "annotation_overlaps": duckdb_sql("""WITH x AS (SELECT * FROM {features} WHERE type = 'CDS'), y AS (SELECT record_id, strand, feature_id || 'b' AS feature_id, start, CASE WHEN start % 2 = 0 THEN stop + 6 ELSE stop END AS stop FROM x WHERE start % 5 <> 0),
        m AS (SELECT x.feature_id AS a, y.feature_id AS b, (least(x.stop, y.stop) - greatest(x.start, y.start)) / greatest(x.stop - x.start, y.stop - y.start) AS share FROM x JOIN y ON x.record_id = y.record_id AND x.strand = y.strand AND x.start < y.stop AND y.start < x.stop),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY share DESC, b) AS r1, row_number() OVER (PARTITION BY b ORDER BY share DESC, a) AS r2 FROM m WHERE share >= 0.5), p AS (SELECT * FROM r WHERE r1 = 1 AND r2 = 1),
        e AS (SELECT CASE WHEN share = 1 THEN 'exact' ELSE 'inexact' END AS status FROM p UNION ALL SELECT 'only first' FROM x WHERE feature_id NOT IN (SELECT a FROM p) UNION ALL SELECT 'only second' FROM y WHERE feature_id NOT IN (SELECT b FROM p)) SELECT status, count(*) AS n FROM e GROUP BY status"""),
    "qc_corrected_genes": duckdb_sql("""WITH c AS (SELECT *, CASE WHEN strand > 0 THEN stop ELSE start END AS e FROM {features}), g AS (SELECT record_id, strand, e, min(feature_id) AS gene FROM c WHERE type = 'gene' GROUP BY 1, 2, 3)
        SELECT record_id, feature_id, 'corrected_gene' AS rule, 'gene made' AS message FROM c WHERE type = 'CDS' AND NOT EXISTS (SELECT 1 FROM g WHERE g.record_id = c.record_id AND g.strand = c.strand AND g.e = c.e)
        UNION ALL SELECT record_id, feature_id, 'corrected_gene', 'gene without CDS' FROM c WHERE type = 'gene' AND feature_id NOT IN (SELECT gene FROM g JOIN c d ON d.type = 'CDS' AND g.record_id = d.record_id AND g.strand = d.strand AND g.e = d.e)"""),
    "aa_fraction_codons": duckdb_sql(f"SELECT seq_id, round(coalesce(count(*) FILTER (codon = 'ATG') / count(*), 0), 6) AS atg, round(coalesce(count(*) FILTER (codon = 'TTT') / count(*), 0), 6) AS ttt FROM ({_CODON_AT}) GROUP BY seq_id"),
}
