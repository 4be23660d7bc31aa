"""Queries over sequence scans."""

from pyspark.sql import functions as F

from genoloom.functions import codon as C
from genoloom.functions import sequence as S
from genoloom.operators import scans as X
from genoloom.operators.features import seq_feature_extract
from genoloom.plans.views import duckdb_sql, view

ENZYMES = {"EcoRI": "GAATTC", "HincII": "GTYRAC", "BsaI": "GGTCTC"}
WEIGHTS = {"ATG": 1.0, "GTG": 0.3, "TTG": 0.1}


def _dna(s, d):
    return view(s, d, "dna")


def _records(s, d):
    return _dna(s, d).select((F.col("seq_id") + 1).alias("seq_id"), "seq")


def _proteins(s, d):
    """Proteins cut from all documents' residues into slices of 140 (a data shape: every residue is in one)."""
    from genoloom.operators.sequences import split_slices

    return split_slices(view(s, d, "proteins"), 140).select((F.col("seq_id") * 10000 + F.col("n")).alias("seq_id"), "seq")


def _cds(s, d):
    f = view(s, d, "features").where("type = 'CDS'").select("record_id", "feature_id", "start", "stop", F.lit(1).alias("strand"))
    own = seq_feature_extract(f, _records(s, d))
    rest = seq_feature_extract(f.withColumns({"start": F.col("stop"), "stop": F.col("stop") + 90}), _records(s, d)).withColumnRenamed("seq", "rest")
    return own.join(rest, "feature_id")


def _lipoboxes(s, d):
    f = view(s, d, "features").where("type = 'CDS'")
    proteins = seq_feature_extract(f, _records(s, d)).select(F.col("feature_id").alias("seq_id"), S.translate(F.col("seq"), 11, to_stop=False, start_as_m=False).alias("seq"))
    return X.lipobox_features(f, X.lipobox_scan(proteins))


def _orfs(s, d):
    o = X.orf_scan(_dna(s, d), 11, 30)
    return o.select("seq_id", "start", "stop", "strand", F.length("protein").alias("length"), F.md5("dna").alias("dna"), F.md5("protein").alias("protein"))


def _add_sd(s, d):
    tree = view(s, d, "tree")
    return X.add_sd(tree.where("type = 'gene'").drop("product", "parent"), tree.where("parent is not null").select("type", "parent"), _records(s, d))


QUERIES = {
    "orf_scan": _orfs,
    "mga_orf_scan": lambda s, d: X.orf_scan(_dna(s, d), 11, 60, with_sequence=False),
    "sd_scan": lambda s, d: X.sd_scan(view(s, d, "features").where("type = 'gene'"), _records(s, d)),
    "sd_scan_all": lambda s, d: X.sd_scan(view(s, d, "features").where("type = 'gene'"), _records(s, d), top_only=False),
    "regex_search": lambda s, d: X.regex_search(_dna(s, d), "AC[GT]{2,4}A"),
    "regex_marked": lambda s, d: X.regex_marked(_dna(s, d), "AC[GT]{2,4}A").select("seq_id", F.md5("seq").alias("seq")),
    "add_sd": _add_sd,
    "tmd_scan_periplasm": lambda s, d: X.tmd_scan(_proteins(s, d), size_least=5, size_most=12, periplasm=(110, 120)),
    "restriction_sites": lambda s, d: X.restriction_sites(_dna(s, d), ENZYMES),
    "lipobox_scan": lambda s, d: X.lipobox_scan(_proteins(s, d)),
    "lipobox_features": _lipoboxes,
    "lipobox_window": lambda s, d: X.lipobox_window(_proteins(s, d)),
    "tmd_scan": lambda s, d: X.tmd_scan(_proteins(s, d), size_least=5, size_most=12),
    "sar_scan": lambda s, d: X.sar_scan(_proteins(s, d), 6, 9),
    "transmembrane_scan": lambda s, d: X.transmembrane_scan(_proteins(s, d)),
    "hydrophobic_ls_scan": lambda s, d: X.hydrophobic_ls_scan(_proteins(s, d)),
    "gc_frame": lambda s, d: X.gc_frame(_dna(s, d)),
    "orf_background_score": lambda s, d: X.orf_background_score(X.orf_scan(_dna(s, d), 11, 60), _dna(s, d), WEIGHTS).select("seq_id", "start", "stop", "strand", F.round("p_stop", 6).alias("p_stop"), F.round("score", 5).alias("score")),
    "frameshift_scan": lambda s, d: X.frameshift_scan(_cds(s, d)),
}

_STRANDS = "b AS (SELECT seq_id, length(seq) AS len, 1 AS strand, seq AS q FROM {dna} UNION ALL SELECT seq_id, length(seq), -1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM {dna})"
_TABLE = "map([{}], [{}])".format(", ".join(f"'{c}'" for c in C.codons()), ", ".join(f"'{r}'" for r in C.TABLES[11]))
_STOPS = "('" + "', '".join(C.stops(11)) + "')"
_STARTS = "('" + "', '".join(C.STARTS[11]) + "')"


def _orf_sql(least):
    return f"""{_STRANDS}, c AS (SELECT seq_id, len, strand, q, f, unnest(range(0, (len - f) // 3)) AS i FROM b, (VALUES (0), (1), (2)) v(f)), k AS (SELECT *, substring(q, f + i * 3 + 1, 3) AS codon FROM c),
        w AS (SELECT *, min(CASE WHEN codon IN {_STOPS} THEN i END) OVER (PARTITION BY seq_id, strand, f ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last FROM k),
        o AS (SELECT seq_id, len, strand, f + i * 3 AS lo, f + last * 3 + 3 AS hi, last - i + 1 AS length, q FROM w WHERE codon IN {_STARTS} AND last IS NOT NULL AND last - i + 1 >= {least}),
        p AS (SELECT seq_id, CASE WHEN strand > 0 THEN lo ELSE len - hi END AS start, CASE WHEN strand > 0 THEN hi ELSE len - lo END AS stop, strand, length, substring(q, lo + 1, hi - lo) AS dna FROM o)"""


_PROT = "pr AS (SELECT seq_id * 10000 + n AS seq_id, substring(seq, n * 140 + 1, 140) AS seq FROM (SELECT seq_id, seq, unnest(range(0, (length(seq) + 139) // 140)) AS n FROM {proteins}))"
_UP = """g AS (SELECT feature_id, start, stop, strand, length(seq) AS len, seq, CASE WHEN strand > 0 THEN start - 24 ELSE stop + 3 END AS lo, CASE WHEN strand > 0 THEN start - 3 ELSE stop + 24 END AS hi FROM {features} JOIN {dna} ON seq_id + 1 = record_id WHERE type = 'gene'),
    v AS (SELECT *, CASE WHEN lo < 0 THEN ((lo % 3) + 3) % 3 ELSE lo END AS l2, CASE WHEN hi > len THEN hi - 3 * CAST(ceil((hi - len) / 3) AS BIGINT) ELSE hi END AS h2 FROM g),
    u AS (SELECT feature_id, start, stop, strand, CASE WHEN strand > 0 THEN p ELSE reverse(translate(p, 'ACGT', 'TGCA')) END AS up FROM (SELECT *, substring(seq, least(l2, h2) + 1, abs(h2 - l2)) AS p FROM v)),
    m AS (SELECT motif, k FROM (SELECT unnest([{motifs}]) AS motif, generate_subscripts([{motifs}], 1) AS k)),
    x AS (SELECT u.*, motif, length(up) - (r.e) AS spacing FROM u, m, LATERAL (SELECT unnest(list_transform(range(1, len(string_split(up, motif))), lambda i: CAST(list_sum(list_transform(string_split(up, motif)[1:i], lambda z: length(z))) + i * length(motif) AS BIGINT))) AS e) r),
    h AS (SELECT feature_id, motif, spacing + 3 AS gap, CASE WHEN strand > 0 THEN start - spacing - 3 - length(motif) ELSE stop + spacing + 3 END AS start, length(motif) AS n, row_number() OVER (PARTITION BY feature_id ORDER BY length(motif) DESC, spacing, motif) AS k FROM x WHERE spacing + 3 <= 17)""".replace("{motifs}", ", ".join(f"'{m}'" for m in X.SD_MOTIFS))


def _count(pattern):
    return f"len(regexp_extract_all(seq, '{pattern}'))"


_LB = "[ILMFTV][^REKD][GAS]C"
ORACLE_SQL = {
    "orf_scan": duckdb_sql(f"WITH {_orf_sql(30)} SELECT seq_id, start, stop, strand, length, md5(dna) AS dna, md5(list_aggregate(list_transform(range(0, length(dna) // 3), lambda i: CAST({_TABLE}[substring(dna, CAST(i * 3 + 1 AS BIGINT), 3)] AS VARCHAR)), 'string_agg', '')) AS protein FROM p"),
    "mga_orf_scan": duckdb_sql(f"WITH {_orf_sql(60)} SELECT seq_id, start, stop, strand, length FROM p"),
    "sd_scan": duckdb_sql(f"WITH {_UP} SELECT feature_id, motif, gap, start, start + n AS stop FROM h WHERE k = 1"),
    "sd_scan_all": duckdb_sql(f"WITH {_UP} SELECT feature_id, motif, gap, start, start + n AS stop FROM h"),
    "regex_search": duckdb_sql("""WITH e AS (SELECT seq_id, seq, regexp_extract_all(seq, '(?s)(.*?)(AC[GT]{2,4}A)', 1) AS a, regexp_extract_all(seq, '(?s)(.*?)(AC[GT]{2,4}A)', 2) AS b FROM {dna}),
        u AS (SELECT seq_id, unnest(list_transform(a, lambda z: length(z))) AS g, unnest(b) AS hit, generate_subscripts(b, 1) AS k FROM e), s AS (SELECT *, CAST(sum(g + length(hit)) OVER (PARTITION BY seq_id ORDER BY k) AS BIGINT) AS stop FROM u)
        SELECT seq_id, stop - length(hit) AS start, stop, hit FROM s"""),
    "regex_marked": duckdb_sql("""SELECT seq_id, md5(array_to_string(list_transform(range(1, len(a) + 1), lambda i: lower(a[i]) || coalesce(b[i], '')), '')) AS seq
        FROM (SELECT seq_id, string_split_regex(seq, 'AC[GT]{2,4}A') AS a, regexp_extract_all(seq, 'AC[GT]{2,4}A') AS b FROM {dna}) WHERE len(b) > 0"""),
    "add_sd": duckdb_sql(f"""WITH {_UP.replace('{features}', '{tree}')}, f AS (SELECT h.feature_id, h.start AS s, h.start + n AS e FROM h WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM {{tree}} c WHERE c.parent = h.feature_id AND c.type = 'Shine_Dalgarno_sequence'))
        SELECT record_id, type, least(start, coalesce(s, start)) AS start, greatest(stop, coalesce(e, stop)) AS stop, strand, t.feature_id, CAST(NULL AS VARCHAR) AS parent FROM {{tree}} t LEFT JOIN f ON f.feature_id = t.feature_id WHERE type = 'gene'
        UNION ALL SELECT record_id, 'Shine_Dalgarno_sequence', s, e, strand, t.feature_id || '.rbs', t.feature_id FROM {{tree}} t JOIN f ON f.feature_id = t.feature_id WHERE type = 'gene'"""),
    "tmd_scan_periplasm": duckdb_sql(f"""WITH {_PROT}, x AS (SELECT seq_id, seq, k, regexp_extract(substring(seq, 10, least(30, length(seq)) - 8), '[FIWLVMYCATGSP]{{' || k || '}}') AS g FROM pr, (SELECT unnest(range(5, 13)) AS k))
        SELECT seq_id, max(k) AS size FROM x WHERE g <> '' AND length(seq) - (instr(seq, g) + k) BETWEEN 110 AND 120 GROUP BY seq_id"""),
    "restriction_sites": duckdb_sql(f"""SELECT * FROM (SELECT seq_id, 'EcoRI' AS enzyme, 1 AS strand, {_count('GAATTC')} AS n FROM {{dna}} UNION ALL SELECT seq_id, 'HincII', 1, {_count('GT[CT][AG]AC')} FROM {{dna}}
        UNION ALL SELECT seq_id, 'BsaI', 1, {_count('GGTCTC')} FROM {{dna}} UNION ALL SELECT seq_id, 'BsaI', -1, {_count('GAGACC')} FROM {{dna}}) WHERE n > 0"""),
    "lipobox_scan": duckdb_sql(f"""WITH {_PROT} SELECT seq_id, CASE WHEN a <> '' THEN 0 ELSE 1 END AS box, length(CASE WHEN a <> '' THEN a ELSE b END) AS at FROM (SELECT seq_id, regexp_extract(seq, '^.{{10,40}}{_LB}') AS a, regexp_extract(seq, '^.{{10,40}}AW[AGS]C') AS b FROM pr) WHERE a <> '' OR b <> ''"""),
    "lipobox_features": duckdb_sql(f"""WITH c AS (SELECT feature_id, start, stop, strand, CASE WHEN strand < 0 THEN reverse(translate(p, 'ACGT', 'TGCA')) ELSE p END AS q FROM (SELECT *, substring(seq, start + 1, stop - start) AS p FROM {{features}} JOIN {{dna}} ON seq_id + 1 = record_id WHERE type = 'CDS')),
        pr AS (SELECT *, array_to_string(list_transform(range(0, length(q) // 3), lambda i: CAST({_TABLE}[substring(q, CAST(i * 3 + 1 AS BIGINT), 3)] AS VARCHAR)), '') AS seq FROM c),
        x AS (SELECT *, regexp_extract(seq, '^.{{10,40}}{_LB}') AS a, regexp_extract(seq, '^.{{10,40}}AW[AGS]C') AS b FROM pr), y AS (SELECT *, length(CASE WHEN a <> '' THEN a ELSE b END) AS fin FROM x WHERE a <> '' OR b <> ''),
        z AS (SELECT feature_id, strand, CASE WHEN strand > 0 THEN start + 3 * (fin - 4) ELSE stop - 3 * fin END AS lo FROM y) SELECT feature_id, lo AS start, lo + 12 AS stop, strand FROM z"""),
    "lipobox_window": duckdb_sql(f"""WITH {_PROT}, t AS (SELECT seq_id, seq, regexp_extract(substring(seq, 10, 46), '{_LB}') AS a, regexp_extract(substring(seq, 10, 46), 'AW[AGS]C') AS b FROM pr),
        x AS (SELECT seq_id, CASE WHEN a <> '' THEN length(seq) - (instr(seq, a) + 3) + 1 END AS fa, CASE WHEN b <> '' THEN length(seq) - (instr(seq, b) + 3) + 1 END AS fb FROM t)
        SELECT seq_id, CASE WHEN fa BETWEEN 30 AND 185 THEN fa ELSE fb END AS after FROM x WHERE fa BETWEEN 30 AND 185 OR fb BETWEEN 30 AND 185"""),
    "tmd_scan": duckdb_sql(f"""WITH {_PROT} SELECT seq_id, max(k) AS size FROM pr, (SELECT unnest(range(5, 13)) AS k) WHERE regexp_matches(substring(seq, 10, least(30, length(seq)) - 8), '[FIWLVMYCATGSP]{{' || k || '}}') GROUP BY seq_id"""),
    "sar_scan": duckdb_sql(f"""WITH {_PROT}, w AS (SELECT seq_id, head, n AS size, unnest(range(0, length(head) - n)) AS start FROM (SELECT seq_id, substring(seq, 1, 50) AS head FROM pr), (VALUES (6), (7), (8)) v(n)), h AS (SELECT *, substring(head, start + 1, size) AS win, substring(head, 1, start) AS b FROM w),
        k AS (SELECT *, count(*) OVER p AS c, min(size) OVER p AS lo, max(size) OVER p AS hi FROM h WHERE regexp_full_match(win, '[FIWLVMYCATGSP]+|K[FIWLVMYCATGSP]+|[FIWLVMYCATGSP]+K') WINDOW p AS (PARTITION BY seq_id, start))
        SELECT seq_id, start, size, length(translate(b, 'DE', '')) - length(translate(b, 'RK', '')) AS charge, round(100.0 * (length(win) - length(translate(win, 'SGAT', ''))) / size, 2) AS share FROM k WHERE c < 3 OR size = lo OR size = hi"""),
    "transmembrane_scan": duckdb_sql(f"""WITH {_PROT}, w AS (SELECT seq_id, seq, unnest(range(0, length(seq) - 15)) AS start FROM pr), h AS (SELECT seq_id, start FROM w WHERE regexp_full_match(substring(seq, start + 1, 16), '[FIWLVMYCATGSK]{{3}}[FIWLVMYCATGS]{{10}}[FIWLVMYCATGSK]{{3}}')),
        l AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY seq_id ORDER BY start) <= 16 THEN 0 ELSE 1 END AS nw FROM h), r AS (SELECT *, sum(nw) OVER (PARTITION BY seq_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT seq_id, min(start) AS start, max(start) + 16 AS stop FROM r GROUP BY seq_id, run"""),
    "hydrophobic_ls_scan": duckdb_sql(f"""WITH {_PROT}, e AS (SELECT seq_id, seq, regexp_extract_all(seq, '(?s)(.*?)([AGVLIPFHSTYCMWQN]{{10,}})', 1) AS a, regexp_extract_all(seq, '(?s)(.*?)([AGVLIPFHSTYCMWQN]{{10,}})', 2) AS b FROM pr WHERE length(seq) < 150),
        u AS (SELECT seq_id, seq, unnest(list_transform(a, lambda z: length(z))) AS g, unnest(b) AS d, generate_subscripts(b, 1) AS k FROM e), s AS (SELECT *, CAST(sum(g + length(d)) OVER (PARTITION BY seq_id ORDER BY k) - length(d) AS BIGINT) AS start, length(regexp_extract(d, '^(.*LS)', 1)) AS n FROM u)
        SELECT seq_id, start, start + n AS stop FROM s WHERE n > 0 AND (n = length(d) OR n >= 10) AND length(translate(substring(seq, 1, start), 'DE', '')) - length(translate(substring(seq, 1, start), 'RK', '')) >= 2"""),
    "gc_frame": duckdb_sql("""WITH r AS (SELECT seq_id, unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS base FROM {dna} WHERE length(seq) > 0)
        SELECT seq_id, pos, CAST(pos % 3 + 1 AS INT) AS frame, CAST(sum(CASE WHEN base IN ('G', 'C') THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id, pos % 3 ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS BIGINT) AS gc FROM r"""),
    "orf_background_score": duckdb_sql(f"""WITH {_orf_sql(60)}, n AS (SELECT seq_id, greatest(length(seq), 1) AS n, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'T', '')) AS t, length(seq) - length(replace(seq, 'G', '')) AS g FROM {{dna}}),
        bg AS (SELECT seq_id, (t / n) * (a / n) * (a / n) + (t / n) * (a / n) * (g / n) + (t / n) * (g / n) * (a / n) AS p_stop FROM n)
        SELECT p.seq_id, start, stop, strand, round(p_stop, 6) AS p_stop, round(-length * ln(1 - p_stop) + ln(CASE left(dna, 3) WHEN 'ATG' THEN 1.0 WHEN 'GTG' THEN 0.3 WHEN 'TTG' THEN 0.1 ELSE 0.001 END), 5) AS score FROM p JOIN bg ON bg.seq_id = p.seq_id"""),
}
