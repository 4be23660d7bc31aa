"""Queries over the driver's tables that apply the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.best_fit import pack_documents_best_fit
from genoloom.llm.centroids import cluster_vectors
from genoloom.llm.embedding_dedup import embedding_components
from genoloom.llm.line_dedup import dedup_lines
from genoloom.llm.mixing import mix_plan
from genoloom.llm.packing import pack_documents
from genoloom.llm.pii import personal_data
from genoloom.llm.quality_classifier import quality_scores
from genoloom.llm.quality_rules import CLASSES, COMMON_WORDS, MARKS, Limits, quality_verdicts
from genoloom.llm.simhash import simhash_components
from genoloom.llm.suffix_dedup import remove_repeats
from genoloom.llm.token_alignment import align_tokenizers
from genoloom.llm.token_counts import token_counts
from genoloom.session import spread

MIN_SITES = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def _tokenizer(name: str) -> str:
    """The default place of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components over all documents: 3-word shingles, at most 2 differing bits."""
    return simhash_components(_table(spark, sf_dir, "documents"), shingle_words=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of all documents."""
    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after cross-site lines go: lines before and taken out, and a digest of the rest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    before = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"))
    return dedup_lines(before, min_sites=MIN_SITES, removed_col="n_removed").select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048, added_tokens=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources to target weights takes of each document."""
    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after byte strings of 200 bytes that repeat anywhere go."""
    return remove_repeats(_table(spark, sf_dir, "documents"), min_len=200)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances to the language's references and the verdict for every document."""
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return personal_data(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98 within a label."""
    return embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents, with the corpus-wide counts of linked pairs."""
    return align_tokenizers(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into few sequences of 2048 tokens, only longer ones cut."""
    return pack_documents_best_fit(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all whole-number embeddings after three rounds."""
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_personal_data": op9_personal_data,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_best_fit": op12_best_fit,
    "op13_centroids": op13_centroids,
}

_SPACE = "[\\x20\\x09-\\x0D]"


def _quality_sql(limits: Limits = Limits()) -> str:
    """The quality rules in DuckDB's SQL."""
    k, m = len(CLASSES) + 1, len(COMMON_WORDS) + 1
    chain, counts = ["SELECT doc_id, lang, t, t AS t0 FROM d"], []
    for i, c in enumerate(CLASSES):
        chain.append(f"SELECT *, regexp_replace(t{i}, '{c.replace("'", "''")}', '', 'g') AS t{i + 1} FROM ({chain[-1]})")
        counts.append(f"CAST(length(t{i}) - length(t{i + 1}) AS DOUBLE)")
    marks = range(MARKS.start, MARKS.stop)
    words = ", ".join(f"CAST(len(list_filter(lw, lambda x: x = '{w}')) AS DOUBLE)" for w in COMMON_WORDS)
    listed = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    js = lambda p, q: f"""CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z:
        CASE WHEN z[1] > 0 THEN z[1] / list_sum({p}) * log2(2 * z[1] / list_sum({p}) / (z[1] / list_sum({p}) + z[2] / list_sum({q}))) / 2 ELSE 0.0 END
        + CASE WHEN z[2] > 0 THEN z[2] / list_sum({q}) * log2(2 * z[2] / list_sum({q}) / (z[1] / list_sum({p}) + z[2] / list_sum({q}))) / 2 ELSE 0.0 END)))), 9) ELSE 0.0 END"""  # noqa: E731
    return f"""
        WITH d AS (SELECT doc_id, coalesce(lang, chr(1)) AS lang, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + {limits.window - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {limits.window - 2})) AS i FROM w)),
        h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
        r AS (SELECT doc_id, CAST(sum(least({limits.window}, coalesce(i - p, {limits.window}))) AS BIGINT) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        c AS (SELECT doc_id, lang, [{", ".join(counts)}, CAST(length(t{len(CLASSES)}) AS DOUBLE)] AS c, list_filter(string_split_regex(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '') AS lw, length(t) AS n_chars FROM ({chain[-1]})),
        v AS (SELECT doc_id, lang, c, n_chars, list_concat([{words}], [CAST(len(list_filter(lw, lambda x: x NOT IN ({listed}))) AS DOUBLE)]) AS wc FROM c),
        b AS (SELECT v.*, len(ws) AS n_words, CAST(v.n_chars - v.c[4] AS BIGINT) AS word_chars, CAST(v.c[6] AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
            len(ws) < {limits.min_words} OR 100 * coalesce(r.n, 0) > {limits.repeat_percent} * len(ws) AS base_failed, list_sum(v.c) AS nc, {" + ".join(f"v.c[{i + 1}]" for i in marks)} AS nm
            FROM v JOIN w ON w.doc_id = v.doc_id LEFT JOIN l ON l.doc_id = v.doc_id LEFT JOIN r ON r.doc_id = v.doc_id),
        f AS (SELECT lang, [{", ".join(f"coalesce(quantile_disc(c[{i + 1}] / nc, 0.5) FILTER (nc >= {limits.min_chars}), 0.0)" for i in range(k))}] AS fc,
            [{", ".join(f"coalesce(quantile_disc(c[{i + 1}] / nm, 0.5) FILTER (nm >= {limits.min_marks}), 0.0)" for i in marks)}] AS fm, [{", ".join(f"sum(wc[{i + 1}])" for i in range(m))}] AS fw FROM b WHERE NOT base_failed GROUP BY lang),
        j AS (SELECT b.*, fc, fm, fw, [{", ".join(f"c[{i + 1}]" for i in marks)}] AS own, coalesce(list_sum(fw) >= {limits.min_reference_words}, false) AS ok FROM b LEFT JOIN f ON f.lang = b.lang),
        s AS (SELECT *, CASE WHEN ok AND nc >= {limits.min_chars} THEN {js("c", "fc")} ELSE 0.0 END AS class_distance, CASE WHEN ok AND nm >= {limits.min_marks} THEN {js("own", "fm")} ELSE 0.0 END AS mark_distance,
            CASE WHEN ok AND list_sum(wc) >= {limits.min_histogram_words} THEN {js("wc", "fw")} ELSE 0.0 END AS word_distance FROM j)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, mark_distance, word_distance,
            NOT base_failed AND class_distance <= {limits.max_class_distance} AND mark_distance <= {limits.max_mark_distance} AND word_distance <= {limits.max_word_distance} AS kept FROM s"""


def _centroid_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """Plain k-means over whole numbers in DuckDB's SQL, a few tables a round."""
    out = f"""
        WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale}.0 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM e WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""
    for i in range(rounds + 1):
        out += f""",
        d{i} AS (SELECT vec_id, v, c, list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS d FROM e, c{i}),
        a{i} AS MATERIALIZED (SELECT vec_id, v, d, c FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM d{i}) WHERE r = 1)"""
        if i < rounds:
            out += f""",
        s{i} AS (SELECT c, list(x ORDER BY j) AS m FROM (SELECT c, j, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(s{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN s{i} ON s{i}.c = c{i}.c)"""
    return f"""{out}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(m, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} ON c{rounds}.c = a.c"""


ORACLE_SQL: dict[str, str] = {
    "op13_centroids": _centroid_sql(),
    "op5_mixing": f"""
        WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS DOUBLE) AS w FROM s),
        p AS (SELECT *, sum(3.0 * source_size) OVER o AS caps, sum(w) OVER o AS ws, (SELECT sum(source_size) FROM r) AS total, (SELECT sum(w) FROM r) AS allw FROM r
            WINDOW o AS (ORDER BY source_size / w, source_size, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT CAST((total - coalesce(caps, 0)) / (allw - coalesce(ws, 0)) AS DOUBLE) AS level FROM p WHERE w * ((total - coalesce(caps, 0)) / (allw - coalesce(ws, 0))) <= 3.0 * source_size ORDER BY source_size / w, source_size, w LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN w * level > 3.0 * source_size THEN CAST(3.0 * source_size AS DOUBLE) ELSE w * level END AS target, CASE WHEN w * level > 3.0 * source_size THEN 3.0::DOUBLE WHEN source_size > 0 THEN w * level / source_size ELSE 0.0 END AS rate FROM r, v),
        o AS (SELECT d.doc_id, size, source_size, target, rate, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS pos,
            CAST('0x' || substring(md5('7:' || CASE WHEN d.source IS NULL THEN 'true' ELSE 'false' END || ':' || coalesce(d.source, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST((floor(u + (pos + 1) * rate) - floor(u + pos * rate)) * size AS BIGINT) AS taken FROM o""",
    "op8_quality_rules": _quality_sql(),
    "op10_embedding_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        k AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        r AS (SELECT vec_id AS x, vec_id AS root FROM e UNION SELECT k.y, r.root FROM r JOIN k ON k.x = r.x AND r.root < k.y),
        c AS (SELECT x, min(root) AS root FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM k GROUP BY x)
        SELECT c.x AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, c.x = root AS kept FROM c LEFT JOIN n ON n.x = c.x""",
    "op3_line_dedup": f"""
        WITH l AS (
          SELECT doc_id, source, i - 1 AS pos, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(13)) AS k
          FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), range(1, len(lines) + 1) AS r(i)
        ), spread AS (
          SELECT k, min((doc_id, pos)) AS first FROM l WHERE regexp_matches(k, '[^\\x20\\x09-\\x0D]')
          GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}
        ), marked AS (
          SELECT l.*, coalesce((l.doc_id, l.pos) <> s.first, false) AS gone FROM l LEFT JOIN spread s ON l.k = s.k
        )
        SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed,
               md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
        FROM marked GROUP BY doc_id""",
}
