"""Queries over feature tables and trees."""

from pyspark.sql import functions as F

from genoloom.operators import features as T
from genoloom.operators import sequences as Q
from genoloom.plans.views import duckdb_sql, view


def _tree(s, d):
    t = view(s, d, "tree")
    return t.withColumn("attrs", F.when(F.col("product").isNotNull(), F.create_map(F.lit("product"), F.array("product"))).otherwise(F.create_map().cast("map<string,array<string>>")))


def _f(s, d, kind=None):
    f = view(s, d, "features")
    return f.where(F.col("type") == kind) if kind else f


def _product(df):
    return df.select("feature_id", F.try_element_at(F.try_element_at("attrs", F.lit("product")), F.lit(1)).alias("product"))


def _centres(s, d):
    return view(s, d, "features").where("start % 17 = 0").select("feature_id")


def _edits(s, d):
    a = _f(s, d, "CDS").where("start % 5 = 0")
    found = a.select("feature_id", F.when(F.col("start") % 2 == 0, F.col("start") + 9).otherwise(F.col("start")).alias("new_start"), F.lit(None).cast("bigint").alias("new_stop"), F.lit(None).cast("int").alias("new_strand"))
    return found.unionByName(view(s, d, "nation").select(F.concat(F.lit("none"), F.col("n_nationkey").cast("string")).alias("feature_id"), F.lit(1).cast("bigint").alias("new_start"), F.lit(None).cast("bigint").alias("new_stop"), F.lit(None).cast("int").alias("new_strand")))


def _shifted(s, d):
    return _f(s, d).where("start % 3 <> 0").withColumn("start", F.when((F.col("start") % 4 == 0) & (F.col("strand") > 0), F.col("start") + 3).otherwise(F.col("start")))


def _seqs(s, d):
    return view(s, d, "dna").select((F.col("seq_id") + 1).alias("seq_id"), "seq")


RULES = [("hypothetical", "hypothetical"), ("tail", "tail"), ("fiber", "fiber [0-2]")]

QUERIES = {
    "filter_tree": lambda s, d: T.filter_tree(_tree(s, d), F.col("start") % 3 == 0).select("feature_id"),
    "filter_tree_invert": lambda s, d: T.filter_tree(_tree(s, d), F.col("type") == "gene", invert=True, below=False).select("feature_id"),
    "filter_type": lambda s, d: T.filter_type(_tree(s, d), ["cds", "EXON"]).select("feature_id", "parent"),
    "drop_types": lambda s, d: T.drop_types(_tree(s, d), ["gene", "exon"]).select("feature_id"),
    "filter_qualifier_value": lambda s, d: T.filter_qualifier_value(_tree(s, d), ["product", "note"], ["tail fiber 1", "tail fiber 3"]).select("feature_id"),
    "filter_qualifier_contains": lambda s, d: T.filter_qualifier_contains(_tree(s, d), ["product"], ["fiber 2", "hypo"]).select("feature_id"),
    "filter_by_tag": lambda s, d: T.filter_by_tag(_tree(s, d), "CDS", "product", "tail").select("feature_id"),
    "filter_at_location": lambda s, d: T.filter_at_location(_f(s, d), 7000, 1).select("feature_id"),
    "filter_contains": lambda s, d: T.filter_contains(_f(s, d), 7000, 7030).select("feature_id"),
    "coding_genes": lambda s, d: T.coding_genes(_tree(s, d)).select("feature_id"),
    "filter_records": lambda s, d: T.filter_records(_f(s, d), view(s, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("accession"))).select("feature_id"),
    "search_terms": lambda s, d: T.search_terms(view(s, d, "documents"), ["the", "tion", "token", "ünd"], "text", "doc_id"),
    "nearby_k": lambda s, d: T.nearby_k(_f(s, d), _centres(s, d), 2),
    "adjacent_k": lambda s, d: T.adjacent_k(_f(s, d), _centres(s, d), 2),
    "upstream_feature": lambda s, d: T.upstream_feature(_f(s, d)),
    "moron_rule": lambda s, d: T.moron_rule(_f(s, d)).select("feature_id"),
    "sort_by_start": lambda s, d: T.sort_by_start(_f(s, d)).select("feature_id", "place"),
    "retype": lambda s, d: T.retype(_f(s, d), ["CDS", "RBS"], "misc").groupBy("type").agg(F.count("*").alias("n")),
    "retype_short_exons": lambda s, d: T.retype_short_exons(_tree(s, d)).select("feature_id", "type"),
    "extract_qualifier": lambda s, d: T.extract_qualifier(_tree(s, d), "product"),
    "remove_qualifiers": lambda s, d: _product(T.remove_qualifiers(_tree(s, d), "CDS", "product", "hypothetical")),
    "promote_qualifier": lambda s, d: _product(T.promote_qualifier(_tree(s, d), "product", "gene", "CDS")),
    "product_to_grandparent": lambda s, d: _product(T.product_to_grandparent(_tree(s, d))),
    "copy_cds_qualifiers": lambda s, d: _product(T.copy_cds_qualifiers(_tree(s, d))),
    "add_parent_genes": lambda s, d: T.add_parent_genes(_tree(s, d)).select("feature_id", "type", "parent"),
    "add_parent_chain": lambda s, d: T.add_parent_chain(_tree(s, d), ["exon"], ["operon", "gene", "mRNA"]).select("feature_id", "type", "parent"),
    "add_gene_over_feature": lambda s, d: T.add_parent_chain(_tree(s, d).where("parent is null"), ["gene"], ["operon"]).select("feature_id", "type", "parent"),
    "drop_middle_level": lambda s, d: T.drop_middle_level(_tree(s, d), "gene").select("feature_id", "parent"),
    "add_exons_over_cds": lambda s, d: T.add_exons(_tree(s, d), move_cds=True).select("feature_id", "type", "start", "stop", "parent"),
    "add_exons": lambda s, d: T.add_exons(_tree(s, d)).select("feature_id", "type", "start", "stop"),
    "genes_from_pairs": lambda s, d: T.genes_from_pairs(_f(s, d).withColumn("name", F.col("start") % 200), "name"),
    "fminmax": lambda s, d: T.fminmax(_tree(s, d)),
    "display_name": lambda s, d: _tree(s, d).select("feature_id", T.display_name(F.col("attrs"), F.col("feature_id")).alias("name")),
    "escape_text": lambda s, d: view(s, d, "part").select("p_partkey", T.escape_text(F.concat("p_name", F.lit("(é)"), "p_brand")).alias("name")),
    "merge_annotations": lambda s, d: T.merge_annotations(_tree(s, d), _tree(s, d).where("start % 2 = 0").select("feature_id", F.create_map(F.lit("product"), F.array(F.lit("extra"))).alias("attrs")), ["product"]).select("feature_id", F.array_join(F.try_element_at("attrs", F.lit("product")), "|").alias("product")),
    "update_from_table": lambda s, d: T.update_from_table(_f(s, d, "CDS"), _edits(s, d))[1],
    "rename_from_table": lambda s, d: T.rename_from_table(_tree(s, d), view(s, d, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name"))),
    "renumber": lambda s, d: T.renumber(_tree(s, d).where("type = 'gene'"), _tree(s, d).where("type <> 'gene'"), "gp", 3),
    "locus_tags": lambda s, d: T.locus_tags(_f(s, d, "gene"), _f(s, d, "CDS")),
    "feature_color_custom": lambda s, d: T.feature_color_class(_tree(s, d), RULES, custom=[("first", ["tail", "1"], ["protein"]), ("never", ["tail"], ["fiber"])]),
    "feature_color_class": lambda s, d: T.feature_color_class(_tree(s, d), RULES),
    "parent_child_types": lambda s, d: T.parent_child_types(_tree(s, d)),
    "merge_feature_sets": lambda s, d: T.merge_feature_sets(view(s, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("record_id")), _f(s, d), view(s, d, "points")).groupBy("record_id").agg(F.count("*").alias("n")),
    "feature_tag_counts": lambda s, d: T.feature_tag_counts(_tree(s, d)),
    "id_join": lambda s, d: T.id_join(_f(s, d).select("record_id"), view(s, d, "points").select("record_id"), "record_id"),
    "text_join": lambda s, d: T.text_join(view(s, d, "customer").select("c_name", "c_nationkey"), view(s, d, "supplier").select("s_name", "s_nationkey"), "c_nationkey", "s_nationkey").groupBy("c_name").agg(F.count("*").alias("n")),
    "text_join_invert": lambda s, d: T.text_join(view(s, d, "customer").select("c_name", "c_nationkey"), view(s, d, "supplier").where("s_nationkey > 9").select("s_nationkey"), "c_nationkey", "s_nationkey", invert=True)[0],
    "zip_append": lambda s, d: T.zip_append(_seqs(s, d).withColumn("ord", F.col("seq_id")), _seqs(s, d).withColumn("ord", F.col("seq_id") - 1)).select("seq_id", F.length("seq").alias("n")),
    "rebase": lambda s, d: T.rebase(view(s, d, "parts"), view(s, d, "parts").where("start % 4 = 0").select(F.col("feature_id").alias("record_id"), F.concat("feature_id", F.lit("c")).alias("feature_id"), (F.col("start") % 20).alias("start"), (F.col("start") % 20 + 12).alias("stop"), F.lit(1).alias("strand")), protein=True),
    "gene_diff": lambda s, d: T.gene_diff(_f(s, d, "gene"), _shifted(s, d).where("type = 'gene'")),
    "feature_match": lambda s, d: T.feature_match(_f(s, d), _shifted(s, d)),
    "answer_score": lambda s, d: T.answer_score(_shifted(s, d).withColumn("who", F.col("record_id") % 11), _f(s, d, "CDS"), "who").select("who", "score", F.round("share", 6).alias("share")),
    "codon_usage_compare": lambda s, d: T.codon_usage_compare(Q.codon_counts(view(s, d, "dna").where("seq_id % 2 = 0")), Q.codon_counts(view(s, d, "dna").where("seq_id % 2 = 1"))).select("codon", "residue", F.round("first", 6).alias("first"), F.round("second", 6).alias("second")),
    "seq_feature_extract": lambda s, d: T.seq_feature_extract(_f(s, d), _seqs(s, d)),
}

_END3 = "CASE WHEN strand > 0 THEN stop ELSE start END"
_END5 = "CASE WHEN strand > 0 THEN start ELSE stop END"
_SHIFT = "(SELECT record_id, type, feature_id, strand, stop, CASE WHEN start % 4 = 0 AND strand > 0 THEN start + 3 ELSE start END AS start FROM {features} WHERE start % 3 <> 0)"
_CODON = "SELECT unnest(list_transform(range(0, length(seq) // 3), lambda i: substring(seq, CAST(i * 3 + 1 AS BIGINT), 3))) AS codon FROM {dna} WHERE seq_id % 2 = "
_CHILD = "(SELECT parent, feature_id, product, strand, start, stop, type, record_id FROM {tree} WHERE parent IS NOT NULL)"


def _codon_rows():
    from genoloom.functions import codon as C

    return ", ".join(f"('{c}', '{r}')" for c, r in C.table(11).items())


ORACLE_SQL = {
    "filter_tree": duckdb_sql("SELECT t.feature_id FROM {tree} t LEFT JOIN {tree} p ON p.feature_id = t.parent WHERE t.start % 3 = 0 OR p.start % 3 = 0", once=True),
    "filter_tree_invert": duckdb_sql("SELECT feature_id FROM {tree} WHERE type <> 'gene'"),
    "filter_type": duckdb_sql("SELECT feature_id, CAST(NULL AS VARCHAR) AS parent FROM {tree} WHERE type IN ('CDS', 'exon')"),
    "drop_types": duckdb_sql("SELECT feature_id FROM {tree} WHERE type NOT IN ('gene', 'exon')"),
    "filter_qualifier_value": duckdb_sql("SELECT feature_id FROM {tree} WHERE product IN ('tail fiber 1', 'tail fiber 3')"),
    "filter_qualifier_contains": duckdb_sql("SELECT feature_id FROM {tree} WHERE product LIKE '%fiber 2%' OR product LIKE '%hypo%'"),
    "filter_by_tag": duckdb_sql("SELECT feature_id FROM {tree} WHERE type = 'CDS' AND product LIKE '%tail%'"),
    "filter_at_location": duckdb_sql("SELECT feature_id FROM {features} WHERE 7000 BETWEEN start AND stop AND strand = 1"),
    "filter_contains": duckdb_sql("SELECT feature_id FROM {features} WHERE start < 7000 AND stop > 7030"),
    "coding_genes": duckdb_sql("SELECT t.feature_id FROM {tree} t JOIN (SELECT parent FROM {tree} WHERE type = 'CDS' GROUP BY parent) c ON c.parent = t.feature_id WHERE t.type = 'gene'", once=True),
    "filter_records": duckdb_sql("SELECT feature_id FROM {features} WHERE record_id IN (SELECT p_partkey FROM part WHERE p_size = 7)"),
    "search_terms": duckdb_sql("SELECT doc_id, term FROM documents, (SELECT unnest(['the', 'tion', 'token', 'ünd']) AS term) WHERE contains(lower(text), term)"),
    "nearby_k": duckdb_sql("""WITH r AS (SELECT record_id, feature_id, start, row_number() OVER (PARTITION BY record_id ORDER BY start, stop, feature_id) AS n FROM {features})
        SELECT c.feature_id AS centre, f.feature_id AS feature FROM r c JOIN r f ON c.record_id = f.record_id AND abs(c.n - f.n) BETWEEN 1 AND 2 WHERE c.start % 17 = 0""", once=True),
    "adjacent_k": duckdb_sql("""WITH r AS (SELECT record_id, feature_id, start, strand, row_number() OVER (PARTITION BY record_id ORDER BY start, stop, feature_id) AS n FROM {features})
        SELECT c.feature_id AS centre, f.feature_id AS feature, CASE WHEN (f.n < c.n) = (c.strand > 0) THEN 'up' ELSE 'down' END AS side FROM r c JOIN r f ON c.record_id = f.record_id AND abs(c.n - f.n) BETWEEN 1 AND 2 WHERE c.start % 17 = 0""", once=True),
    "upstream_feature": duckdb_sql("""SELECT feature_id, lag(feature_id) OVER w AS upstream, start - lag(stop) OVER w AS distance FROM {features} WHERE strand > 0 WINDOW w AS (PARTITION BY record_id ORDER BY stop, start, feature_id)
        UNION ALL SELECT feature_id, lead(feature_id) OVER v, lead(start) OVER v - stop FROM {features} WHERE strand <= 0 WINDOW v AS (PARTITION BY record_id ORDER BY start, stop, feature_id)"""),
    "moron_rule": duckdb_sql("""SELECT feature_id FROM (SELECT feature_id, strand, lag(strand, 1) OVER w AS a, lag(strand, 2) OVER w AS b, lead(strand, 1) OVER w AS c, lead(strand, 2) OVER w AS e FROM {features}
        WINDOW w AS (PARTITION BY record_id ORDER BY start, stop, feature_id)) WHERE a <> strand AND b <> strand AND c <> strand AND e <> strand"""),
    "sort_by_start": duckdb_sql("SELECT feature_id, row_number() OVER (PARTITION BY record_id ORDER BY start, stop, feature_id) AS place FROM {features}"),
    "retype": duckdb_sql("SELECT CASE WHEN type IN ('CDS', 'RBS') THEN 'misc' ELSE type END AS type, count(*) AS n FROM {features} GROUP BY 1"),
    "retype_short_exons": duckdb_sql("SELECT feature_id, CASE WHEN type = 'exon' AND stop - start < 20 THEN 'Shine_Dalgarno_sequence' ELSE type END AS type FROM {tree}"),
    "extract_qualifier": duckdb_sql("SELECT feature_id, product AS value FROM {tree}"),
    "remove_qualifiers": duckdb_sql("SELECT feature_id, CASE WHEN type = 'CDS' AND product LIKE '%hypothetical%' THEN NULL ELSE product END AS product FROM {tree}"),
    "promote_qualifier": duckdb_sql(f"""WITH k AS (SELECT parent AS p, arg_min(product, (CASE WHEN strand > 0 THEN start ELSE -stop END, feature_id)) AS v FROM {_CHILD} WHERE type = 'CDS' AND product IS NOT NULL GROUP BY parent)
        SELECT feature_id, CASE WHEN type = 'gene' THEN v ELSE product END AS product FROM {{tree}} LEFT JOIN k ON feature_id = p"""),
    "product_to_grandparent": duckdb_sql(f"""WITH k AS (SELECT parent AS p, arg_min(product, feature_id) AS v FROM {_CHILD} WHERE type = 'CDS' AND product IS NOT NULL GROUP BY parent)
        SELECT feature_id, CASE WHEN type = 'gene' THEN v ELSE product END AS product FROM {{tree}} LEFT JOIN k ON feature_id = p"""),
    "copy_cds_qualifiers": duckdb_sql(f"""WITH k AS (SELECT parent AS p, min(product) AS v FROM {_CHILD} WHERE type = 'CDS' GROUP BY parent HAVING count(*) = 1)
        SELECT feature_id, CASE WHEN type = 'gene' THEN v ELSE product END AS product FROM {{tree}} LEFT JOIN k ON feature_id = p"""),
    "add_parent_genes": duckdb_sql("""SELECT feature_id, type, CASE WHEN type = 'CDS' THEN feature_id || '.mRNA' ELSE parent END AS parent FROM {tree} UNION ALL SELECT feature_id || '.gene', 'gene', parent FROM {tree} WHERE type = 'CDS'
        UNION ALL SELECT feature_id || '.mRNA', 'mRNA', feature_id || '.gene' FROM {tree} WHERE type = 'CDS'"""),
    "add_parent_chain": duckdb_sql("""SELECT feature_id, type, CASE WHEN type = 'exon' THEN feature_id || '.mRNA' ELSE parent END AS parent FROM {tree} UNION ALL SELECT feature_id || '.operon', 'operon', parent FROM {tree} WHERE type = 'exon'
        UNION ALL SELECT feature_id || '.gene', 'gene', feature_id || '.operon' FROM {tree} WHERE type = 'exon' UNION ALL SELECT feature_id || '.mRNA', 'mRNA', feature_id || '.gene' FROM {tree} WHERE type = 'exon'"""),
    "add_gene_over_feature": duckdb_sql("SELECT feature_id, type, feature_id || '.operon' AS parent FROM {tree} WHERE parent IS NULL UNION ALL SELECT feature_id || '.operon', 'operon', NULL FROM {tree} WHERE parent IS NULL"),
    "drop_middle_level": duckdb_sql("SELECT feature_id, CAST(NULL AS VARCHAR) AS parent FROM {tree} WHERE type <> 'gene'"),
    "add_exons_over_cds": duckdb_sql("SELECT feature_id, type, start, stop, CASE WHEN type = 'CDS' THEN parent || '.exon' ELSE parent END AS parent FROM {tree} UNION ALL SELECT parent || '.exon', 'exon', min(start), max(stop), parent FROM {tree} WHERE type = 'CDS' AND parent IS NOT NULL GROUP BY record_id, parent"),
    "add_exons": duckdb_sql(f"SELECT feature_id, type, start, stop FROM {{tree}} UNION ALL SELECT parent || '.exon', 'exon', min(start), max(stop) FROM {_CHILD} WHERE type = 'CDS' GROUP BY record_id, parent"),
    "genes_from_pairs": duckdb_sql("SELECT record_id, start % 200 AS name, min(start) AS start, max(stop) AS stop FROM {features} WHERE type IN ('CDS', 'RBS') GROUP BY record_id, start % 200 HAVING count(*) = 2 AND count(DISTINCT type) = 2"),
    "fminmax": duckdb_sql("SELECT coalesce(parent, feature_id) AS feature_id, min(start) AS start, max(stop) AS stop FROM {tree} GROUP BY 1"),
    "display_name": duckdb_sql("SELECT feature_id, coalesce(product, feature_id) AS name FROM {tree}"),
    "escape_text": duckdb_sql("SELECT p_partkey, regexp_replace(p_name || '(é)' || p_brand, '[^A-Za-z0-9._:-]', '_', 'g') AS name FROM part"),
    "merge_annotations": duckdb_sql("SELECT feature_id, CASE WHEN start % 2 = 0 THEN 'extra' || coalesce('|' || product, '') ELSE product END AS product FROM {tree}"),
    "update_from_table": duckdb_sql("""SELECT feature_id, CASE WHEN start % 2 = 0 THEN 'Success' ELSE 'No Change' END AS status, CASE WHEN start % 2 = 0 THEN 'start' ELSE '' END AS changed FROM {features} WHERE type = 'CDS' AND start % 5 = 0
        UNION ALL SELECT 'none' || n_nationkey, 'ID not Found', '' FROM nation"""),
    "rename_from_table": duckdb_sql("SELECT t.feature_id, coalesce(a.o_orderpriority, b.o_orderpriority, 'Not Found') AS name FROM {tree} t LEFT JOIN orders a ON t.parent = 'g' || a.o_orderkey AND a.o_orderkey % 3 = 0 LEFT JOIN orders b ON t.feature_id = 'g' || b.o_orderkey AND b.o_orderkey % 3 = 0"),
    "renumber": duckdb_sql("""WITH g AS (SELECT feature_id, 'gp_' || lpad(CAST(row_number() OVER (PARTITION BY record_id ORDER BY start, stop, feature_id) AS VARCHAR), 3, '0') AS tag FROM {tree} WHERE type = 'gene')
        SELECT * FROM g UNION ALL SELECT t.feature_id, g.tag FROM {tree} t JOIN g ON t.parent = g.feature_id""", once=True),
    "locus_tags": duckdb_sql(f"""WITH g AS (SELECT record_id, strand, {_END3} AS e, min(feature_id) AS gene FROM {{features}} WHERE type = 'gene' GROUP BY 1, 2, 3)
        SELECT c.feature_id, gene, CASE WHEN gene IS NULL THEN 'no gene' ELSE 'same 3'' end' END AS note FROM (SELECT *, {_END3} AS e FROM {{features}} WHERE type = 'CDS') c LEFT JOIN g USING (record_id, strand, e)"""),
    "feature_color_custom": duckdb_sql("SELECT feature_id, CASE WHEN product = 'tail fiber 1' THEN 'first' WHEN regexp_matches(product, 'fiber [0-2]') THEN 'fiber' WHEN product LIKE '%tail%' THEN 'tail' WHEN product LIKE '%hypothetical%' THEN 'hypothetical' END AS class FROM {tree}"),
    "feature_color_class": duckdb_sql("SELECT feature_id, CASE WHEN regexp_matches(product, 'fiber [0-2]') THEN 'fiber' WHEN product LIKE '%tail%' THEN 'tail' WHEN product LIKE '%hypothetical%' THEN 'hypothetical' END AS class FROM {tree}"),
    "parent_child_types": duckdb_sql("SELECT p.type AS parent_type, c.type, count(*) AS n FROM {tree} c JOIN {tree} p ON c.parent = p.feature_id GROUP BY 1, 2"),
    "merge_feature_sets": duckdb_sql("SELECT record_id, count(*) AS n FROM (SELECT record_id FROM {features} UNION ALL SELECT record_id FROM {points} WHERE record_id IN (SELECT p_partkey FROM part WHERE p_size < 10)) GROUP BY record_id"),
    "feature_tag_counts": duckdb_sql("""SELECT *, CASE WHEN cds = 0 THEN 'no CDS' WHEN cds > 1 THEN 'several CDS' WHEN rbs > 1 THEN 'several RBS' END AS message FROM (SELECT parent, count(*) FILTER (type = 'CDS') AS cds,
        count(*) FILTER (type IN ('RBS', 'Shine_Dalgarno_sequence')) AS rbs, count(*) AS "all" FROM {tree} WHERE parent IS NOT NULL GROUP BY parent)"""),
    "id_join": duckdb_sql("""SELECT record_id, CASE WHEN l IS NULL THEN 'right' WHEN r IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT record_id, 1 AS l FROM {features}) FULL JOIN (SELECT DISTINCT record_id, 1 AS r FROM {points}) USING (record_id)"""),
    "text_join": duckdb_sql("SELECT c_name, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_name"),
    "text_join_invert": duckdb_sql("SELECT c_name, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 9)"),
    "zip_append": duckdb_sql("SELECT (a.seq_id + 1) || '_' || (b.seq_id + 1) AS seq_id, length(a.seq) + length(b.seq) AS n FROM {dna} a JOIN {dna} b ON b.seq_id = a.seq_id + 1"),
    "rebase": duckdb_sql("""SELECT feature_id || 'c' AS feature_id, record_id, CASE WHEN strand > 0 THEN start + 3 * (start % 20) ELSE stop - 3 * (start % 20 + 12) END AS start, CASE WHEN strand > 0 THEN start + 3 * (start % 20 + 12) ELSE stop - 3 * (start % 20) END AS stop,
        CASE WHEN strand > 0 THEN 1 ELSE -1 END AS strand FROM {parts} WHERE start % 4 = 0"""),
    "gene_diff": duckdb_sql(f"""WITH x AS (SELECT record_id, {_END5} AS end5, min((feature_id, strand)) AS x FROM {{features}} WHERE type = 'gene' GROUP BY 1, 2), y AS (SELECT record_id, {_END5} AS end5, min((feature_id, strand)) AS y FROM {_SHIFT} WHERE type = 'gene' GROUP BY 1, 2)
        SELECT record_id, end5, CASE WHEN y IS NULL THEN 'only first' WHEN x IS NULL THEN 'only second' ELSE 'both' END AS status, x[1] <> y[1] AS id_differs, x[2] <> y[2] AS strand_differs FROM x FULL JOIN y USING (record_id, end5)"""),
    "feature_match": duckdb_sql(f"""WITH x AS (SELECT record_id, strand, {_END3} AS e, min((start, stop)) AS x FROM {{features}} GROUP BY 1, 2, 3), y AS (SELECT record_id, strand, {_END3} AS e, min((start, stop)) AS y FROM {_SHIFT} GROUP BY 1, 2, 3)
        SELECT CASE WHEN y IS NULL THEN 'only first' WHEN x IS NULL THEN 'only second' WHEN x = y THEN 'same' ELSE 'moved start' END AS status, count(*) AS n FROM x FULL JOIN y USING (record_id, strand, e) GROUP BY 1"""),
    "answer_score": duckdb_sql(f"""WITH k AS (SELECT DISTINCT record_id, start, stop AS kstop FROM {{features}} WHERE type = 'CDS'), e AS (SELECT record_id % 11 AS who, feature_id, max(CASE WHEN kstop = stop THEN 1.0 WHEN kstop IS NOT NULL THEN 0.5 ELSE 0.0 END) AS p FROM {_SHIFT} a LEFT JOIN k USING (record_id, start) GROUP BY 1, 2),
        t AS (SELECT who, CAST(sum(p) AS DOUBLE) AS score FROM e GROUP BY who) SELECT who, score, round(score / nullif((SELECT max(score) FROM t), 0), 6) AS share FROM t"""),
    "codon_usage_compare": duckdb_sql(f"""WITH c AS (SELECT * FROM (VALUES {_codon_rows()}) v(codon, residue)), a AS (SELECT codon, count(*) AS n FROM ({_CODON}0) GROUP BY codon), b AS (SELECT codon, count(*) AS n FROM ({_CODON}1) GROUP BY codon)
        SELECT c.codon, residue, round(coalesce(a.n / (SELECT sum(n) FROM a), 0), 6) AS first, round(coalesce(b.n / (SELECT sum(n) FROM b), 0), 6) AS second FROM c LEFT JOIN a ON a.codon = c.codon LEFT JOIN b ON b.codon = c.codon"""),
    "seq_feature_extract": duckdb_sql("SELECT feature_id, CASE WHEN strand < 0 THEN reverse(translate(substring(seq, start + 1, stop - start), 'ACGT', 'TGCA')) ELSE substring(seq, start + 1, stop - start) END AS seq FROM {features} JOIN {dna} ON seq_id + 1 = record_id"),
}
