"""Queries over sequences."""

from pyspark.sql import functions as F

from genoloom.functions import codon as C
from genoloom.functions import sequence as S
from genoloom.operators import sequences as Q
from genoloom.plans.views import duckdb_sql, view


def _dna(s, d):
    return view(s, d, "dna")


def _oligos(s, d):
    """Short sequences: whole names of parts as DNA."""
    return view(s, d, "oligos")


def _lengths(s, d):
    return view(s, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit(20200).alias("length"))


def _md5(df, *cols):
    return df.select("seq_id", *(F.md5(c).alias(c) for c in cols))


def _round(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _titles(s, d):
    return view(s, d, "part").select("p_partkey", F.concat_ws(" ", F.when(F.col("p_size") % 8 != 6, "Genus sp"), F.when(F.col("p_size") % 4 == 0, "bacteriophage").when(F.col("p_size") % 4 == 1, "phage").when(F.col("p_size") % 4 == 2, "vB_Eco_"), F.concat(F.col("p_brand"), F.lit(", complete genome."))).alias("title"))


QUERIES = {
    "seq_length": lambda s, d: Q.seq_length(_dna(s, d)),
    "size_filter": lambda s, d: Q.size_filter(_dna(s, d), 500, 5000).select("seq_id"),
    "reverse_complement": lambda s, d: _md5(_dna(s, d).withColumn("seq", S.reverse_complement(F.col("seq"))), "seq"),
    "revcom_features": lambda s, d: Q.revcom_features(view(s, d, "features"), _lengths(s, d)).select("feature_id", "start", "stop", "strand"),
    "translate": lambda s, d: _md5(_dna(s, d).withColumn("protein", S.translate(F.col("seq"), 11, to_stop=False, start_as_m=False)), "protein"),
    "translate_to_stop": lambda s, d: _dna(s, d).select("seq_id", S.translate(F.col("seq"), 11).alias("protein")),
    "chop": lambda s, d: _dna(s, d).select("seq_id", F.substring("seq", 1, 30).alias("seq")),
    "rotate": lambda s, d: _md5(_dna(s, d).withColumn("seq", S.rotate(F.col("seq"), 1234)), "seq"),
    "rotate_features": lambda s, d: Q.rotate_features(view(s, d, "features"), _lengths(s, d), 7000).select("feature_id", "start", "stop"),
    "split_slices": lambda s, d: Q.split_slices(_dna(s, d), 700).select("seq_id", "n", F.md5("seq").alias("seq")),
    "drop_description": lambda s, d: _md5(Q.drop_description(_dna(s, d).withColumn("seq", F.replace("seq", F.lit("ACGTA"), F.lit("##")))), "seq"),
    "rename_sequences": lambda s, d: Q.rename_sequences(_dna(s, d), "new").select("seq_id", "description", F.md5("seq").alias("seq")),
    "id_swap": lambda s, d: Q.id_swap(_dna(s, d), -1).select("seq_id", "description"),
    "split_headers": lambda s, d: Q.split_headers(_dna(s, d).withColumn("description", F.replace("description", F.lit(" "), F.lit(">")))).select("seq_id", "description"),
    "junction_window": lambda s, d: _dna(s, d).select("seq_id", S.junction_window(F.col("seq"), 20).alias("seq")),
    "highlight_motif": lambda s, d: _dna(s, d).select("seq_id", F.md5(S.highlight(F.col("seq"), F.lit(10), F.lit(16))).alias("seq")),
    "aa_fraction": lambda s, d: _round(Q.aa_fraction(view(s, d, "proteins"), "ACDKW*")),
    "codon_counts": lambda s, d: Q.codon_counts(_dna(s, d)),
    "codon_fraction": lambda s, d: _round(Q.codon_fraction(_dna(s, d))),
    "start_codon_counts": lambda s, d: Q.start_codon_counts(_dna(s, d)),
    "stop_codon_counts": lambda s, d: Q.stop_codon_counts(_dna(s, d)),
    "oligo_mass": lambda s, d: _oligos(s, d).select("seq_id", F.round(S.oligo_mass(F.col("seq")), 4).alias("mass")),
    "melting_temp": lambda s, d: _oligos(s, d).select("seq_id", F.round(S.melting_temp(F.col("seq")), 6).alias("tm"), F.round(S.melting_temp(F.col("seq"), 0.1), 6).alias("tm_salt")),
    "net_charge": lambda s, d: _round(Q.net_charge(view(s, d, "proteins"), least_ratio=0.1)),
    "residue_table": lambda s, d: _round(Q.residue_table(view(s, d, "proteins"))),
    "phage_host_name": lambda s, d: _titles(s, d).select("p_partkey", Q.phage_host_name(F.col("title")).alias("x")).select("p_partkey", "x.host", "x.phage"),
    "host_fields": lambda s, d: view(s, d, "part").select("p_partkey", Q.host_fields(F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("x")).select("p_partkey", "x.genus", "x.species", "x.strain", "x.other"),
    "point_mutants": lambda s, d: Q.point_mutants(_oligos(s, d)),
    "point_insertions": lambda s, d: Q.point_mutants(_oligos(s, d), kind="insertion"),
    "point_deletions": lambda s, d: Q.point_mutants(_oligos(s, d), kind="deletion"),
    "difference_residues": lambda s, d: Q.difference_residues(_oligos(s, d), "ACGTACGTACGTACGTACGTACGT"),
    "first_difference": lambda s, d: Q.first_difference(_oligos(s, d), F.lit("ACGTACGTACGTACGTACGTACGT")),
    "contig_uid": lambda s, d: Q.contig_uid(_oligos(s, d)),
    "dedup": lambda s, d: Q.dedup(_dna(s, d)),
    "concat_sequences": lambda s, d: Q.concat_sequences(_dna(s, d).withColumn("g", F.floor(F.col("seq_id") / 20)), "g", "seq_id", link="NN").select("g", F.md5("seq").alias("seq")),
    "ligate": lambda s, d: Q.ligate_bed(_dna(s, d).withColumn("g", F.floor(F.col("seq_id") / 20)), "g", "seq_id", link="NN", pre="A").select("g", "seq_id", "start", "stop"),
    "protein_props": lambda s, d: _round(Q.protein_props(_dna(s, d).join(view(s, d, "proteins").withColumnRenamed("seq", "protein"), "seq_id"))),
    "disambiguate": lambda s, d: Q.disambiguate(_oligos(s, d).withColumn("seq", F.translate("seq", "AC", "RN"))).select("seq_id", "changes", F.length("seq").alias("n"), (~F.col("seq").rlike("[^ACGT]")).alias("plain")),
}

_CODONS = "list_transform(range(0, length(seq) // 3), lambda i: substring(seq, CAST(i * 3 + 1 AS BIGINT), 3))"
_TABLE = "map([{}], [{}])".format(", ".join(f"'{c}'" for c in C.codons()), ", ".join(f"'{r}'" for r in C.TABLES[11]))
_PROTEIN = f"list_aggregate(list_transform({_CODONS}, lambda c: CAST({_TABLE}[c] AS VARCHAR)), 'string_agg', '')"
_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_OLIGO = "{oligos}"
_N = {x: f"(length(seq) - length(replace(seq, '{x}', '')))" for x in "ACGT"}
_GC, _AT = f"({_N['G']} + {_N['C']})", f"({_N['A']} + {_N['T']})"


def _letters(col, letters):
    return f"(length({col}) - length(translate({col}, '{letters}', '')))"


_WHOLE = "length(seq) % 3 = 0 AND length(body) = length(p) - 1 AND p LIKE '%*' AND substring(seq, 1, 3) IN ('" + "', '".join(C.STARTS[11]) + "')"
_KD = "map([{}], [{}])".format(", ".join(f"'{k}'" for k in C.HYDROPATHY), ", ".join(f"{v}::DOUBLE" for v in C.HYDROPATHY.values()))
ORACLE_SQL = {
    "seq_length": duckdb_sql("SELECT seq_id, length(seq) AS length FROM {dna}"),
    "size_filter": duckdb_sql("SELECT seq_id FROM {dna} WHERE length(seq) BETWEEN 500 AND 5000"),
    "reverse_complement": duckdb_sql(f"SELECT seq_id, md5({_RC}) AS seq FROM {{dna}}"),
    "revcom_features": duckdb_sql("SELECT feature_id, 20200 - stop AS start, 20200 - start AS stop, -strand AS strand FROM {features}"),
    "translate": duckdb_sql(f"SELECT seq_id, md5(coalesce({_PROTEIN}, '')) AS protein FROM {{dna}}"),
    "translate_to_stop": duckdb_sql(f"SELECT seq_id, CASE WHEN {_WHOLE} THEN 'M' || substring(body, 2) ELSE body END AS protein FROM (SELECT *, split_part(p, '*', 1) AS body FROM (SELECT seq_id, seq, coalesce({_PROTEIN}, '') AS p FROM {{dna}}))"),
    "chop": duckdb_sql("SELECT seq_id, substring(seq, 1, 30) AS seq FROM {dna}"),
    "rotate": duckdb_sql("SELECT seq_id, md5(substring(seq, k + 1) || substring(seq, 1, k)) AS seq FROM (SELECT seq_id, seq, 1234 % greatest(length(seq), 1) AS k FROM {dna})"),
    "rotate_features": duckdb_sql("SELECT feature_id, (start - 7000 + 20200) % 20200 AS start, (start - 7000 + 20200) % 20200 + stop - start AS stop FROM {features} WHERE NOT (start < 7000 AND stop > 7000)"),
    "split_slices": duckdb_sql("SELECT seq_id, n, md5(substring(seq, n * 700 + 1, 700)) AS seq FROM (SELECT seq_id, seq, unnest(range(0, (length(seq) + 699) // 700)) AS n FROM {dna})"),
    "drop_description": duckdb_sql("SELECT seq_id, md5(split_part(replace(seq, 'ACGTA', '##'), '##', 1)) AS seq FROM {dna}"),
    "rename_sequences": duckdb_sql("SELECT 'new' AS seq_id, '[Orig=' || seq_id || ']' AS description, md5(seq) AS seq FROM {dna}"),
    "id_swap": duckdb_sql("SELECT seq_id, translate(string_split(description, ' ')[-1], '[]()', '') || ' ' || description AS description FROM {dna}"),
    "split_headers": duckdb_sql("SELECT seq_id, unnest(string_split(description, ' ')) AS description FROM {dna}"),
    "junction_window": duckdb_sql("SELECT seq_id, substring(right(seq, 20), 1, greatest(length(right(seq, 20)) - 3, 0)) || '[' || right(right(seq, 20), 3) || ']' || left(seq, 20) AS seq FROM {dna}"),
    "highlight_motif": duckdb_sql("SELECT seq_id, md5(lower(substring(seq, 1, 10)) || upper(substring(seq, 11, 6)) || lower(substring(seq, 17))) AS seq FROM {dna}"),
    "aa_fraction": duckdb_sql("SELECT seq_id, length(seq) AS length, " + ", ".join(f"round(coalesce({_letters('seq', x)} / nullif({_letters('seq', 'ACDKW*')}, 0), 0), 6) AS {'stop' if x == '*' else x.lower()}" for x in "ACDKW*") + " FROM {proteins}"),
    "codon_counts": duckdb_sql(f"SELECT codon, count(*) AS n FROM (SELECT unnest({_CODONS}) AS codon FROM {{dna}}) GROUP BY codon"),
    "codon_fraction": duckdb_sql(f"SELECT seq_id, codon, round(count(*) / any_value(t), 6) AS fraction FROM (SELECT seq_id, length(seq) // 3 AS t, unnest({_CODONS}) AS codon FROM {{dna}}) GROUP BY seq_id, codon"),
    "start_codon_counts": duckdb_sql(f"SELECT codon, {_TABLE}[codon] AS residue, n FROM (SELECT substring(seq, 1, 3) AS codon, count(*) AS n FROM {{dna}} GROUP BY 1)"),
    "stop_codon_counts": duckdb_sql("SELECT codon, CASE codon WHEN 'TAG' THEN 'Amber' WHEN 'TAA' THEN 'Ochre' WHEN 'TGA' THEN 'Opal' END AS name, n FROM (SELECT right(seq, 3) AS codon, count(*) AS n FROM {dna} GROUP BY 1)"),
    "oligo_mass": duckdb_sql(f"SELECT seq_id, round({_N['A']} * 313.21::DOUBLE + {_N['T']} * 304.2::DOUBLE + {_N['C']} * 289.18::DOUBLE + {_N['G']} * 329.21::DOUBLE - 61.96, 4) AS mass FROM {_OLIGO}"),
    "melting_temp": duckdb_sql(f"""SELECT seq_id, round(CASE WHEN length(seq) < 14 THEN 2.0 * {_AT} + 4.0 * {_GC} ELSE 64.9 + 41.0 * ({_GC} - 16.4::DOUBLE) / nullif(length(seq), 0) END, 6) AS tm,
        round(CASE WHEN length(seq) < 14 THEN 2.0 * {_AT} + 4.0 * {_GC} - 16.6 * log10(0.05) + 16.6 * log10(0.1) ELSE 100.5 + 41.0 * {_GC} / nullif(length(seq), 0) - 820.0 / nullif(length(seq), 0) + 16.6 * log10(0.1) END, 6) AS tm_salt FROM {_OLIGO}"""),
    "net_charge": duckdb_sql(f"""SELECT seq_id, {_letters('seq', 'RK')} - {_letters('seq', 'DE')} AS net, {_letters('seq', 'RK')} + {_letters('seq', 'DE')} AS charged, round({_letters('seq', 'RKDE')} / nullif(length(seq), 0), 6) AS ratio
        FROM {{proteins}} WHERE {_letters('seq', 'RKDE')} / nullif(length(seq), 0) >= 0.1"""),
    "residue_table": duckdb_sql(f"""WITH r AS (SELECT seq_id, length(seq) AS len, unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS residue FROM {{proteins}} WHERE length(seq) > 0), k AS (SELECT *, {_KD}[residue] AS kd FROM r)
        SELECT seq_id, pos, residue, CASE WHEN residue IN ('R', 'K', 'H') THEN '+' WHEN residue IN ('D', 'E') THEN '-' WHEN residue IN ('S', 'T', 'N', 'Q', 'C', 'Y') THEN 'P' ELSE 'N' END AS kind,
        CASE WHEN pos > 4 AND pos <= len - 4 THEN round(avg(kd) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) END AS hydropathy FROM k"""),
    "phage_host_name": duckdb_sql("""SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) THEN 'Genus sp ' END AS host, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN CASE WHEN p_size % 8 = 6 THEN 'vB_Eco_ ' || p_brand END END AS phage FROM part"""),
    "host_fields": duckdb_sql("SELECT p_partkey, nullif(a[1], '') AS genus, a[2] AS species, a[3] AS strain, nullif(array_to_string(a[4:], ' '), '') AS other FROM (SELECT p_partkey, string_split_regex(trim(p_type || ' ' || p_brand || ' ' || p_name), '\\s+') AS a FROM part)"),
    "point_insertions": duckdb_sql(f"""SELECT seq_id, pos, base, left(seq, pos) || base || substring(seq, pos + 1) AS seq FROM (SELECT seq_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM {_OLIGO}) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS base)"""),
    "point_deletions": duckdb_sql(f"SELECT seq_id, pos, '' AS base, left(seq, pos) || substring(seq, pos + 2) AS seq FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS pos FROM {_OLIGO})"),
    "point_mutants": duckdb_sql(f"""SELECT seq_id, pos, base, substring(seq, 1, pos) || base || substring(seq, pos + 2) AS seq FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS pos FROM {_OLIGO}) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS base) WHERE substring(seq, pos + 1, 1) <> base"""),
    "difference_residues": duckdb_sql(f"""SELECT pos, residue, count(*) AS n FROM (SELECT i AS pos, substring(seq, i, 1) AS residue FROM (SELECT seq, unnest(range(1, 25)) AS i FROM {_OLIGO} WHERE length(seq) = 24) WHERE substring(seq, i, 1) <> substring('ACGTACGTACGTACGTACGTACGT', i, 1)
        UNION ALL SELECT NULL, '*' FROM {_OLIGO} WHERE length(seq) <> 24) GROUP BY pos, residue"""),
    "first_difference": duckdb_sql(f"""SELECT seq_id, pos, CASE WHEN pos > 0 THEN substring(seq, pos, 1) END AS residue FROM (SELECT seq_id, seq, CASE WHEN length(seq) = 24 THEN coalesce(list_position(list_transform(range(1, 25), lambda i: substring(seq, i, 1) = substring('ACGTACGTACGTACGTACGTACGT', i, 1)), false), 0) END AS pos FROM {_OLIGO})"""),
    "contig_uid": duckdb_sql(f"""WITH b AS (SELECT seq_id, seq AS q FROM {_OLIGO} UNION ALL SELECT seq_id, {_RC} FROM {_OLIGO}), t AS (SELECT seq_id, q, unnest(range(0, greatest(length(q), 1))) AS k FROM b) SELECT seq_id, md5(min(substring(q, k + 1) || substring(q, 1, k))) AS uid FROM t GROUP BY seq_id"""),
    "dedup": duckdb_sql("SELECT a[1] AS seq_id, len(a) AS copies, array_to_string(a[2:], ' ') AS others FROM (SELECT list(seq_id ORDER BY seq_id) AS a FROM {dna} GROUP BY upper(seq))"),
    "concat_sequences": duckdb_sql("SELECT seq_id // 20 AS g, md5(string_agg(seq, 'NN' ORDER BY seq_id)) AS seq FROM {dna} GROUP BY 1"),
    "ligate": duckdb_sql("SELECT seq_id // 20 AS g, seq_id, b AS start, b + length(seq) AS stop FROM (SELECT *, 1 + coalesce(sum(length(seq) + 2) OVER (PARTITION BY seq_id // 20 ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM {dna})"),
    "protein_props": duckdb_sql(f"""WITH j AS (SELECT d.seq_id, d.seq, p.seq AS protein FROM {{dna}} d JOIN {{proteins}} p USING (seq_id)),
        w AS (SELECT seq_id, avg(coalesce(({_letters('q', 'G')} - {_letters('q', 'C')}) / nullif({_letters('q', 'GC')}, 0), 0)) AS skew FROM (SELECT seq_id, substring(seq, i * 100 + 1, 100) AS q FROM (SELECT seq_id, seq, unnest(range(0, (length(seq) + 99) // 100)) AS i FROM j)) GROUP BY seq_id)
        SELECT j.seq_id, length(protein) AS length, round({_letters('protein', 'FWY')} / nullif(length(protein), 0), 6) AS aromaticity, round(100.0 * {_letters('seq', 'GC')} / nullif(length(seq), 0), 6) AS gc, round(coalesce(skew, 0), 6) AS gc_skew,
        round({' + '.join(f"{v}::DOUBLE * {_letters('protein', k)}" for k, v in Q.RESIDUE_MASS.items())} + {Q.WATER}, 6) AS weight FROM j LEFT JOIN w USING (seq_id)"""),
    "disambiguate": duckdb_sql("SELECT seq_id, length(seq) - length(translate(seq, 'AC', '')) AS changes, length(seq) AS n, true AS plain FROM {oligos}"),
}
