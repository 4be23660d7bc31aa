"""Queries over edited genomes, protein stability, intron runs and annotation reports."""

from pyspark.sql import functions as F

from genoloom.operators import editing as E
from genoloom.operators import features as T
from genoloom.operators import relations as R
from genoloom.operators import scans as X
from genoloom.operators import sequences as Q
from genoloom.plans.editing_queries import _RECORDS, _changes
from genoloom.plans.feature_queries import _f, _seqs, _shifted, _tree
from genoloom.plans.sequence_queries import _PROTEIN, _WHOLE
from genoloom.operators.submission import flatten_features
from genoloom.plans.source_queries import _path
from genoloom.plans.views import duckdb_sql, view
from genoloom.sources import readers as R_
from genoloom.sources import writers as W


def _record_lengths(s, d):
    return _seqs(s, d).select(F.col("seq_id").alias("record_id"), F.length("seq").alias("length"))


def _pieces(s, d):
    """Longer pieces than those of the edited sequence, so that features fit in."""
    return _changes(s, d).withColumn("stop", F.col("start") + 4000)


def _weights(s, d):
    """A weight for the pairs of residues that the parts' numbers name."""
    letter = lambda c: F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (c % 20 + 1).cast("int"), F.lit(1))
    pairs = view(s, d, "part").select(F.concat(letter(F.col("p_partkey")), letter(F.floor(F.col("p_partkey") / 20))).alias("pair"), "p_size")
    return pairs.groupBy("pair").agg(F.max("p_size").cast("double").alias("weight"))


def _intron_hits(s, d):
    h = view(s, d, "hits")
    start = F.col("query") * 7 % 20000
    return h.select("subject", F.col("query").alias("gene"), F.when(F.col("ord") % 2 == 0, 1).otherwise(-1).alias("strand"), start.alias("start"), (start + F.col("length") * 3).alias("stop"), "sstart", "sstop", (F.col("nident") / F.col("length")).alias("identity"), F.lit(0).cast("long").alias("qstart"), F.col("length").alias("qstop"), "nident", "ord", "taxon")


def _notes(s, d):
    """Trees whose genes have no product and whose parts have one or none."""
    return _tree(s, d)


def _cited(s, d):
    """A record for each supplier, with two references, written as a flat file and read back."""
    t = view(s, d, "supplier").select(F.concat(F.lit("LOCUS       s"), F.col("s_suppkey").cast("string"), F.lit(".1 4 bp DNA\nREFERENCE   1  (bases 1 to 4)\n  AUTHORS   "), "s_name", F.lit(" and\n            others\n  TITLE     t\n   PUBMED   "), F.col("s_nationkey").cast("string"), F.lit("\nREFERENCE   2\n  JOURNAL   j\nFEATURES             Location/Qualifiers\nORIGIN\n        1 acgt\n//")).alias("line"))
    path = _path(s, "references")
    W.write_lines(t, path)
    return R_.read_genbank(s, path)[0]


def _table(s, d):
    """Edits of every seventh coding feature, and of ids that no feature has."""
    a = _f(s, d, "CDS").where("start % 7 = 0")
    found = a.select("feature_id", F.when(F.col("start") % 2 == 0, "new").alias("name"), F.lit(None).cast("string").alias("note"), (F.col("start") + F.col("start") % 3).alias("new_start"), F.when(F.col("stop") % 2 == 0, "k").alias("Kind of"))
    return found.unionByName(view(s, d, "nation").select(F.concat(F.lit("none"), F.col("n_nationkey").cast("string")).alias("feature_id"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("note"), F.lit(1).cast("bigint").alias("new_start"), F.lit(None).cast("string").alias("Kind of")))


def _with_attrs(df):
    return df.withColumns({"parent": F.lit(None).cast("string"), "attrs": F.create_map(F.lit("Name"), F.array(F.concat(F.lit("n"), (F.col("start") % 4).cast("string"))))})


def _edited(s, d, log):
    out = T.edit_from_table(_with_attrs(_f(s, d, "CDS")), _table(s, d))[1 if log else 0]
    first = lambda k: F.try_element_at(F.try_element_at("attrs", F.lit(k)), F.lit(1))
    return out if log else out.select("feature_id", "start", first("Name").alias("name"), first("kind_of").alias("kind_of"))


def _short_proteins(s, d):
    """The first four residues that the coding features of every tenth record are translated to."""
    from genoloom.functions import sequence as S
    from genoloom.operators.locations import part_sequences

    coded = part_sequences(_f(s, d, "CDS").where("record_id % 10 = 0 and stop - start < 30"), _seqs(s, d)).select(S.translate(F.col("seq"), 11, to_stop=False).alias("protein")).where("protein <> ''").distinct()
    return coded.select(F.concat(F.lit("q"), "protein").alias("query"), "protein")


QUERIES = {
    "flatten_features": lambda s, d: flatten_features(_tree(s, d), "gp_").select("record_id", "feature_id", "type", "start", "stop", "strand", F.size("parts").alias("parts"), "locus_tag", F.try_element_at(F.try_element_at("attrs", F.lit("product")), F.lit(1)).alias("product"), F.size("attrs").alias("keys")),
    "record_references": lambda s, d: E.record_references(_cited(s, d)),
    "missing_rbs_messages": lambda s, d: E.missing_rbs_messages(_tree(s, d), _seqs(s, d)),
    "safe_reopen": lambda s, d: E.safe_reopen(_seqs(s, d), _f(s, d), 5000, 1).select("record_id", "at", "from_end", F.md5("seq").alias("seq")),
    "safe_reopen_minus": lambda s, d: E.safe_reopen(_seqs(s, d), _f(s, d), 5000, -1).select("record_id", "at", "from_end", F.md5("seq").alias("seq")),
    "safe_reopen_last": lambda s, d: E.safe_reopen(_seqs(s, d), _f(s, d), -2).select("record_id", "at", "from_end", F.md5("seq").alias("seq")),
    "edit_from_table": lambda s, d: _edited(s, d, False),
    "edit_from_table_log": lambda s, d: _edited(s, d, True),
    "gene_differences": lambda s, d: T.gene_differences(_with_attrs(_f(s, d, "gene")), _with_attrs(_shifted(s, d).where("type = 'gene'"))),
    "adjacent_to_protein": lambda s, d: T.adjacent_to_protein(_f(s, d), _seqs(s, d), s.createDataFrame([("start", "M"), ("two", "FF"), ("three", "FLL")], "query string, protein string").unionByName(_short_proteins(s, d)), 2, 1),
    "disambiguation_table": lambda s, d: Q.disambiguation_table(view(s, d, "dna").withColumn("seq", F.translate("seq", "A", "R"))).groupBy("seq_id", "code").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.sum(F.when(F.col("base").isin("A", "G"), 1).otherwise(0)).alias("allowed")),
    "disambiguate_records": lambda s, d: Q.disambiguate(view(s, d, "dna").withColumn("seq", F.translate("seq", "AC", "RN"))).select("seq_id", "changes", F.length("seq").alias("n"), (~F.col("seq").rlike("[^ACGT]")).alias("plain")),
    "first_difference_records": lambda s, d: Q.first_difference(view(s, d, "dna").select("seq_id", "seq"), F.reverse("seq")),
    "edit_features": lambda s, d: E.edit_features(view(s, d, "tree").join(_record_lengths(s, d).select("record_id"), "record_id", "left_semi"), _pieces(s, d), _record_lengths(s, d)).select("record_id", "n", "feature_id", "start", "stop", "strand"),
    "edit_chain": lambda s, d: E.edit_chain(_pieces(s, d), _record_lengths(s, d), "new"),
    "isoelectric_point": lambda s, d: view(s, d, "proteins").select("seq_id", F.round(Q.isoelectric_point(F.col("seq")), 4).alias("pi")),
    "instability_index": lambda s, d: Q.instability_index(view(s, d, "proteins"), _weights(s, d)).select("seq_id", F.round("instability", 6).alias("instability")),
    "intron_runs": lambda s, d: R.intron_runs(_intron_hits(s, d), 3000, 20000, 0.5, -20).groupBy("cluster.subject", "cluster.strand").agg(F.count_distinct("cluster.n").alias("runs"), F.count("*").alias("hits"), F.min("start").alias("start"), F.max("stop").alias("stop")),
    "intron_features": lambda s, d: R.intron_features(_intron_hits(s, d), 3000, 20000, 0.5, -20).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"), F.sum("score").alias("score"), F.count("note").alias("notes")),
    "first_value_below": lambda s, d: E.first_value_below(_notes(s, d), ["product"]),
    "annotation_report": lambda s, d: E.annotation_report(_f(s, d).withColumns({"parent": F.lit(None).cast("string"), "attrs": F.create_map(F.lit("Name"), F.array(F.concat(F.lit("n"), (F.col("start") % 9).cast("string"))))}), ["record", "id", "type", "location", "strand", "length", "start_codon", "name", "upstream", "upstream_distance", "ontology:term"], types=["CDS"], seqs=_seqs(s, d),
        ontology=_f(s, d, "CDS").where("start % 3 = 0").select("feature_id", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("term"))),
}

_MAP = f"""c AS (SELECT l_partkey AS record_id, l_linenumber AS n, max(l_suppkey) * 7 % 300 AS start FROM lineitem GROUP BY 1, 2),
    p AS (SELECT c.record_id, n, start, least(start + 4000, length(seq)) AS stop, n % 5 = 0 AS ins, CASE WHEN n % 2 = 0 THEN -1 ELSE 1 END AS turn FROM c JOIN {_RECORDS} r ON r.record_id = c.record_id),
    m AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY record_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ FROM (SELECT *, CASE WHEN ins THEN 3 ELSE greatest(stop - start, 0) END AS size FROM p))"""


def _pi_sql():
    """The bisection as one subquery a step."""
    n = lambda k: f"(length(p) - length(replace(p, '{k}', '')))"
    case = lambda values, at, plain: "CASE " + " ".join(f"WHEN {at} = '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {plain} END"
    text = f"SELECT seq_id, {', '.join(f'CAST({n(k)} AS DOUBLE) AS n{k}' for k in 'KRHDECY')}, CAST({case(Q.FIRST_PK, 'left(p, 1)', Q.POSITIVE_PK['end'])} AS DOUBLE) AS nt, CAST({case(Q.LAST_PK, 'right(p, 1)', Q.NEGATIVE_PK['end'])} AS DOUBLE) AS ct, {Q.PH_LEAST}::DOUBLE AS lo, {Q.PH_MOST}::DOUBLE AS hi, {Q.PH_START}::DOUBLE AS ph FROM (SELECT seq_id, upper(seq) AS p FROM {{proteins}}) WHERE p <> ''"
    plus = " + ".join([*(f"n{k} / (1 + pow(10.0, ph - {Q.POSITIVE_PK[k]}))" for k in "KRH"), "1.0 / (1 + pow(10.0, ph - nt))"])
    minus = " + ".join([*(f"n{k} / (1 + pow(10.0, {Q.NEGATIVE_PK[k]} - ph))" for k in "DECY"), "1.0 / (1 + pow(10.0, ct - ph))"])
    keep = "seq_id, nK, nR, nH, nD, nE, nC, nY, nt, ct"
    for _ in range(18):
        text = f"SELECT {keep}, lo, hi, CASE WHEN o THEN (lo + hi) / 2 ELSE ph END AS ph FROM (SELECT {keep}, o, ph, CASE WHEN o AND q > 0 THEN ph ELSE lo END AS lo, CASE WHEN o AND q <= 0 THEN ph ELSE hi END AS hi FROM (SELECT *, hi - lo > {Q.PH_STEP} AS o, {plus} - ({minus}) AS q FROM ({text})))"
    return duckdb_sql(f"SELECT d.seq_id, round(ph, 4) AS pi FROM {{proteins}} d LEFT JOIN ({text}) x ON x.seq_id = d.seq_id")


_RUNS = """WITH h AS (SELECT subject, query AS gene, CASE WHEN ord % 2 = 0 THEN 1 ELSE -1 END AS strand, query * 7 % 20000 AS start, query * 7 % 20000 + length * 3 AS stop, sstart, sstop, nident, length FROM {hits} WHERE nident / length >= 0.5),
    w AS (SELECT *, max(stop) OVER (PARTITION BY subject, strand ORDER BY start, stop, gene, sstart, sstop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM h),
    x AS (SELECT *, sum(CASE WHEN start - ps <= 3000 THEN 0 ELSE 1 END) OVER (PARTITION BY subject, strand ORDER BY start, stop, gene, sstart, sstop ROWS UNBOUNDED PRECEDING) AS run FROM w),
    o AS (SELECT subject, strand, max(run) AS last FROM x GROUP BY subject, strand HAVING 20000 - max(stop) + min(start) <= 3000),
    y AS (SELECT x.* EXCLUDE (run), CASE WHEN run = last THEN 1 ELSE run END AS run FROM x LEFT JOIN o ON o.subject = x.subject AND o.strand = x.strand),
    z AS (SELECT *, max(sstop) OVER (PARTITION BY subject, strand, run ORDER BY sstart, sstop, start, stop, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM y),
    k AS (SELECT subject, strand, run FROM z GROUP BY ALL HAVING count(DISTINCT gene) > 1 AND count(*) FILTER (top IS NOT NULL AND least(top, sstop) - sstart > 20) = 0),
    r AS (SELECT z.* FROM z JOIN k USING (subject, strand, run))"""
_OPEN = f"""WITH w AS (SELECT record_id, start, stop FROM {{features}} UNION ALL SELECT DISTINCT r.record_id, length(seq), length(seq) + 1 FROM {_RECORDS} r JOIN {{features}} f ON f.record_id = r.record_id),
    m AS (SELECT *, max(stop) OVER (PARTITION BY record_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), g AS (SELECT record_id, reach AS a, start AS b, (reach + start) // 2 AS mid FROM m WHERE start > reach),
    n AS (SELECT record_id, arg_min(mid, ({{order}}, a)) AS at_ FROM g WHERE {{fits}} GROUP BY record_id), r AS (SELECT s.record_id, seq, at_, coalesce(at_, 0) % greatest(length(seq), 1) AS k FROM {_RECORDS} s LEFT JOIN n ON n.record_id = s.record_id),
    o AS (SELECT record_id, at_, length(seq) - at_ AS from_end, substring(seq, k + 1) || substring(seq, 1, k) AS q FROM r)"""
_BEFORE = {"order": "CASE WHEN a < 5000 AND 5000 < b THEN -1 ELSE 5000 - b END", "fits": "b < 5000 OR a < 5000 AND 5000 < b"}
_BEHIND = {"order": "CASE WHEN a < 5000 AND 5000 < b THEN -1 ELSE a - 5000 END", "fits": "a > 5000 OR a < 5000 AND 5000 < b"}


def _open(order, fits, q):
    return duckdb_sql(_OPEN.replace("{order}", order).replace("{fits}", fits) + f' SELECT record_id, at_ AS "at", from_end, md5({q}) AS seq FROM o')


_EDITS = """WITH f AS (SELECT feature_id, start, stop, 'n' || start % 4 AS name FROM {features} WHERE type = 'CDS'), e AS (SELECT feature_id, start % 2 = 0 AS named, start + start % 3 AS new_start, stop % 2 = 0 AS kind FROM f WHERE start % 7 = 0)"""
ORACLE_SQL = {
    "flatten_features": duckdb_sql("""WITH g AS (SELECT record_id, feature_id, 'gp_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS tag FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY start, stop, feature_id) AS n FROM {tree} WHERE type = 'gene')),
        t AS (SELECT x.*, tag FROM {tree} x JOIN g ON g.feature_id = coalesce(x.parent, x.feature_id)),
        c AS (SELECT record_id, parent, arg_min(feature_id, (start, stop, feature_id)) AS feature_id, arg_min(coalesce(product, ''), (start, stop, feature_id)) AS product, min(start) AS start, max(stop) AS stop, min(strand) AS strand, count(*) AS parts, any_value(tag) AS tag FROM t WHERE type = 'CDS' AND stop - start >= 10 GROUP BY record_id, parent)
        SELECT record_id, feature_id, CASE type WHEN 'gene' THEN 'gene' ELSE 'RBS' END AS type, start, stop, strand, 1 AS parts, tag AS locus_tag, CASE WHEN type <> 'gene' THEN product END AS product, CASE WHEN type <> 'gene' AND product IS NOT NULL THEN 1 ELSE 0 END AS keys FROM t WHERE type IN ('gene', 'Shine_Dalgarno_sequence') OR type = 'exon' AND stop - start < 10
        UNION ALL SELECT record_id, feature_id, 'CDS', start, stop, strand, parts, tag, nullif(product, ''), CASE WHEN product = '' THEN 1 ELSE 2 END FROM c"""),
    "record_references": """SELECT 's' || s_suppkey AS record_id, 1 AS n, s_name || ' and others' AS authors, 't' AS title, '' AS journal, '' AS medline, CAST(s_nationkey AS VARCHAR) AS pubmed, '' AS comment FROM supplier
        UNION ALL SELECT 's' || s_suppkey, 2, '', '', 'j', '', '', '' FROM supplier""",
    "missing_rbs_messages": duckdb_sql(f"""WITH k AS (SELECT parent FROM {{tree}} WHERE parent IS NOT NULL GROUP BY parent HAVING count_if(type = 'CDS') > 0 AND count_if(type = 'Shine_Dalgarno_sequence') = 0),
        g AS (SELECT t.record_id, feature_id, strand, seq, length(seq) AS len, CASE WHEN strand > 0 THEN start - 15 ELSE stop + 5 END AS lo, CASE WHEN strand > 0 THEN start - 5 ELSE stop + 15 END AS hi FROM {{tree}} t JOIN k ON k.parent = t.feature_id JOIN {_RECORDS} r ON r.record_id = t.record_id),
        v AS (SELECT *, CASE WHEN lo < 0 THEN ((lo % 3) + 3) % 3 ELSE lo END AS l2, CASE WHEN hi > len THEN hi - 3 * CAST(ceil((hi - len) / 3) AS BIGINT) ELSE hi END AS h2 FROM g),
        u AS (SELECT *, CASE WHEN strand > 0 THEN p ELSE reverse(translate(p, 'ACGT', 'TGCA')) END AS up FROM (SELECT *, substring(seq, greatest(least(l2, h2), 0) + 1, greatest(greatest(l2, h2) - greatest(least(l2, h2), 0), 0)) AS p FROM v))
        SELECT record_id, feature_id, 'missing_rbs' AS rule, CASE WHEN regexp_matches(up, '{"|".join(X.SD_MOTIFS)}') THEN 'Unannotated but valid RBS' ELSE 'No RBS annotated, None found' END AS message, lower(up) AS upstream FROM u"""),
    "safe_reopen": _open(**_BEFORE, q="q"),
    "safe_reopen_minus": _open(**_BEHIND, q="CASE WHEN at_ IS NULL THEN q ELSE reverse(translate(q, 'ACGT', 'TGCA')) END"),
    "safe_reopen_last": _open("-a", "true", "q"),
    "edit_from_table": duckdb_sql(f"{_EDITS} SELECT f.feature_id, coalesce(new_start, start) AS start, CASE WHEN named THEN 'new' ELSE name END AS name, CASE WHEN kind THEN 'k' END AS kind_of FROM f LEFT JOIN e ON e.feature_id = f.feature_id"),
    "edit_from_table_log": duckdb_sql(f"""{_EDITS} SELECT feature_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN named THEN 'Name' END, CASE WHEN moved THEN 'Start' END, CASE WHEN kind THEN 'Other Qualifiers' END], lambda x: x IS NOT NULL), ', '), ''), 'None') AS changed, CASE WHEN named OR moved OR kind THEN 'Success' ELSE 'No Change' END AS status
        FROM (SELECT e.feature_id, named, new_start <> start AS moved, kind FROM e JOIN f ON f.feature_id = e.feature_id) UNION ALL SELECT 'none' || n_nationkey, 'None', 'ID not Found' FROM nation"""),
    "gene_differences": duckdb_sql("""WITH a AS (SELECT * FROM {features} WHERE type = 'gene'), b AS (SELECT record_id, feature_id, stop, strand, CASE WHEN start % 4 = 0 AND strand > 0 THEN start + 3 ELSE start END AS start FROM a WHERE start % 3 <> 0),
        x AS (SELECT record_id, CASE WHEN strand > 0 THEN start ELSE stop END AS end5, max((start, feature_id, stop, strand)) AS x FROM a GROUP BY 1, 2), y AS (SELECT record_id, CASE WHEN strand > 0 THEN start ELSE stop END AS end5, max((start, feature_id, stop, strand)) AS y FROM b GROUP BY 1, 2)
        SELECT record_id, end5, x[2] AS first, y[2] AS second, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN array_to_string(list_filter([CASE WHEN x[2] <> y[2] THEN 'id' END, CASE WHEN x[1] % 4 <> y[1] % 4 THEN 'qualifiers' END, CASE WHEN x[4] <> y[4] THEN 'strand' END], lambda z: z IS NOT NULL), ',') END AS differs FROM x FULL JOIN y USING (record_id, end5)"""),
    "adjacent_to_protein": duckdb_sql(f"""WITH f AS (SELECT f.*, row_number() OVER (PARTITION BY f.record_id ORDER BY start, stop, feature_id) AS n FROM {{features}} f WHERE type = 'CDS'),
        t AS (SELECT f.record_id, feature_id, start, stop, strand, n, CASE WHEN strand < 0 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS seq FROM (SELECT f.*, substring(seq, start + 1, stop - start) AS q FROM f JOIN {_RECORDS} r ON r.record_id = f.record_id) f),
        p AS (SELECT *, CASE WHEN {_WHOLE} THEN 'M' || substring(p, 2) ELSE p END AS full_ FROM (SELECT *, split_part(p, '*', 1) AS body FROM (SELECT *, coalesce({_PROTEIN}, '') AS p FROM t))),
        c AS (SELECT *, regexp_replace(full_, '\\*+$', '') AS prot FROM p), q AS (SELECT * FROM (VALUES ('start', 'M'), ('two', 'FF'), ('three', 'FLL')) v(query, prot) UNION ALL SELECT 'q' || full_, regexp_replace(full_, '\\*+$', '') FROM (SELECT DISTINCT full_ FROM c WHERE record_id % 10 = 0 AND stop - start < 30 AND full_ <> '')),
        m AS (SELECT query, feature_id AS centre, record_id, strand, n FROM c JOIN q ON q.prot = c.prot WHERE c.prot <> '')
        SELECT query, centre, f.feature_id AS feature, CASE WHEN (f.n < m.n) = (m.strand > 0) THEN 'up' ELSE 'down' END AS side, abs(f.n - m.n) AS apart FROM m JOIN f ON f.record_id = m.record_id AND f.n BETWEEN m.n - 2 AND m.n + 1 AND f.n <> m.n"""),
    "disambiguation_table": duckdb_sql("SELECT seq_id, 'R' AS code, count(*) AS n, CAST(sum(i - 1) AS BIGINT) AS places, count(*) AS allowed FROM (SELECT seq_id, unnest(string_split(seq, '')) AS c, unnest(range(1, length(seq) + 1)) AS i FROM {dna} WHERE seq <> '') WHERE c = 'A' GROUP BY seq_id"),
    "disambiguate_records": duckdb_sql("SELECT seq_id, length(seq) - length(translate(seq, 'AC', '')) AS changes, length(seq) AS n, true AS plain FROM {dna}"),
    "first_difference_records": duckdb_sql("SELECT seq_id, pos, CASE WHEN pos > 0 THEN substring(seq, pos, 1) END AS residue FROM (SELECT seq_id, seq, coalesce(list_position(list_transform(list_zip(string_split(seq, ''), string_split(reverse(seq), '')), lambda z: z[1] = z[2]), false), 0) AS pos FROM {dna})"),
    "edit_features": duckdb_sql(f"""WITH {_MAP}, q AS (SELECT * FROM m WHERE NOT ins AND stop > start), t AS (SELECT x.*, coalesce(x.parent, x.feature_id) AS root FROM {{tree}} x), g AS (SELECT * FROM t WHERE parent IS NULL)
        SELECT t.record_id, q.n, t.feature_id, CASE WHEN turn < 0 THEN at_ + q.stop - t.stop ELSE at_ + t.start - q.start END AS start, CASE WHEN turn < 0 THEN at_ + q.stop - t.start ELSE at_ + t.stop - q.start END AS stop, CASE WHEN turn < 0 THEN -t.strand ELSE t.strand END AS strand
        FROM t JOIN g ON g.feature_id = t.root JOIN q ON q.record_id = g.record_id AND q.start <= g.start AND g.stop <= q.stop"""),
    "edit_chain": duckdb_sql(f"WITH {_MAP} SELECT record_id, n, start + 1 AS start, stop, CASE WHEN turn < 0 THEN '-' ELSE '+' END AS strand, 'new' AS new_record, at_ + 1 AS new_start, at_ + size AS new_stop, '+' AS new_strand FROM m WHERE NOT ins"),
    "isoelectric_point": _pi_sql(),
    "instability_index": duckdb_sql("""WITH l AS (SELECT 'ACDEFGHIKLMNPQRSTVWY' AS a), w AS (SELECT substring(a, CAST(p_partkey % 20 + 1 AS INT), 1) || substring(a, CAST(p_partkey // 20 % 20 + 1 AS INT), 1) AS pair, CAST(max(p_size) AS DOUBLE) AS weight FROM part, l GROUP BY 1),
        t AS (SELECT seq_id, sum(weight) AS s FROM (SELECT seq_id, a || lead(a) OVER (PARTITION BY seq_id ORDER BY i) AS pair FROM (SELECT seq_id, unnest(string_split(seq, '')) AS a, unnest(range(1, length(seq) + 1)) AS i FROM {proteins} WHERE seq <> '')) x JOIN w ON w.pair = x.pair GROUP BY seq_id)
        SELECT p.seq_id, CASE WHEN length(seq) > 0 THEN round(10.0 * coalesce(s, 0) / length(seq), 6) END AS instability FROM {proteins} p LEFT JOIN t ON t.seq_id = p.seq_id"""),
    "intron_runs": duckdb_sql(f"{_RUNS} SELECT subject, strand, count(DISTINCT run) AS runs, count(*) AS hits, min(start) AS start, max(stop) AS stop FROM r GROUP BY subject, strand"),
    "intron_features": duckdb_sql(f"""{_RUNS}, g AS (SELECT subject, strand, run, min(start) AS start, max(stop) AS stop FROM r GROUP BY ALL), c AS (SELECT subject, strand, run, gene, min((start, stop, sstart, sstop, 0, length, nident)) AS f FROM r GROUP BY ALL)
        SELECT 'gene' AS type, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases, CAST(NULL AS BIGINT) AS score, count_if(stop - start > 16000) AS notes FROM g UNION ALL SELECT 'mRNA', count(*), CAST(sum(stop - start) AS BIGINT), NULL, 0 FROM g
        UNION ALL SELECT 'CDS', count(*), CAST(sum(3 * f[6]) AS BIGINT), CAST(sum(1000 * f[7] // f[6]) AS BIGINT), count(*) FROM c"""),
    "first_value_below": duckdb_sql("SELECT parent AS feature_id, string_agg(product, '; ' ORDER BY start, feature_id) AS value FROM {tree} WHERE parent IS NOT NULL AND product IS NOT NULL GROUP BY parent"),
    "annotation_report": duckdb_sql(f"""WITH u AS (SELECT feature_id, lag(feature_id) OVER w AS upstream, start - lag(stop) OVER w AS distance FROM {{features}} WHERE strand > 0 AND type = 'CDS' WINDOW w AS (PARTITION BY record_id ORDER BY stop, start, feature_id)
        UNION ALL SELECT feature_id, lead(feature_id) OVER v, lead(start) OVER v - stop FROM {{features}} WHERE strand <= 0 AND type = 'CDS' WINDOW v AS (PARTITION BY record_id ORDER BY start, stop, feature_id)),
        f AS (SELECT f.*, substring(seq, start + 1, stop - start) AS q FROM {{features}} f LEFT JOIN {_RECORDS} r ON r.record_id = f.record_id WHERE type = 'CDS')
        SELECT record_id AS record, f.feature_id AS id, type, (start + 1) || '..' || stop AS location, CASE WHEN strand > 0 THEN '+' ELSE '-' END AS strand, (stop - start) / 3 - 1 AS length, left(CASE WHEN strand < 0 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END, 3) AS start_codon,
        'n' || start % 9 AS name, upstream, distance AS upstream_distance, CASE WHEN start % 3 = 0 THEN 'a,b' END AS "ontology:term" FROM f JOIN u ON u.feature_id = f.feature_id"""),
}
