"""The driver's tables in the shapes that the operators take: one SQL text for each view, run by Spark and by DuckDB alike.

``{name}`` stands for a table or an earlier view, ``{g}`` for the flag with which DuckDB replaces all matches of a pattern.
Coordinates are 0-based and half-open (start, stop).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from genoloom.session import spread

#: Tables of texts, where a row is much work: they are spread over all cores.
_TEXTS = ("documents", "conversations")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DNA = ("ACGT" * 13)[:52]
_RESIDUES = ("ACDEFGHIKLMNPQRSTVWY" * 3)[:52]

VIEWS: dict[str, str] = {
    "dna": f"""SELECT doc_id AS seq_id, concat('doc ', source, ' [', lang, ']') AS description,
        regexp_replace(translate(coalesce(text, ''), '{_LETTERS}', '{_DNA}'), '[^ACGT]', ''{{g}}) AS seq FROM {{documents}}""",
    "proteins": f"""SELECT doc_id AS seq_id, regexp_replace(translate(coalesce(text, ''), '{_LETTERS}', '{_RESIDUES}'), '[^ACDEFGHIKLMNPQRSTVWY]', ''{{g}}) AS seq FROM {{documents}}""",
    "features": """SELECT l_partkey AS record_id, CASE l_returnflag WHEN 'N' THEN 'gene' WHEN 'A' THEN 'CDS' ELSE 'RBS' END AS type,
        l_orderkey * 7 % 20000 AS start, l_orderkey * 7 % 20000 + CAST(l_quantity AS BIGINT) * 3 AS stop,
        CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS strand,
        concat(CAST(l_orderkey AS VARCHAR(20)), '.', CAST(l_partkey AS VARCHAR(20)), '.', CAST(l_suppkey AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(20))) AS feature_id FROM {lineitem}""",
    "points": """SELECT user_id AS record_id, (event_id * 37) % 20000 AS start, (event_id * 37) % 20000 + CAST(floor(value) AS BIGINT) % 200 + 1 AS stop,
        CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS strand, CAST(event_id AS VARCHAR(20)) AS feature_id FROM {events}""",
    "parts": """SELECT l_orderkey AS gene, concat('g', CAST(l_orderkey AS VARCHAR(20))) AS parent, CAST(floor(l_orderkey / 64) AS BIGINT) AS record_id,
        CASE l_returnflag WHEN 'N' THEN 'CDS' WHEN 'A' THEN 'exon' ELSE 'Shine_Dalgarno_sequence' END AS type,
        (l_orderkey * 211 + l_partkey % 60) % 20000 + l_linenumber * 60 AS start, (l_orderkey * 211 + l_partkey % 60) % 20000 + l_linenumber * 60 + CAST(l_quantity AS BIGINT) * 3 AS stop,
        CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS strand,
        concat(CAST(l_orderkey AS VARCHAR(20)), '.', CAST(l_partkey AS VARCHAR(20)), '.', CAST(l_suppkey AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(20))) AS feature_id,
        CASE WHEN l_linenumber % 3 = 0 THEN 'hypothetical protein' WHEN l_linenumber % 3 = 1 THEN concat('tail fiber ', CAST(l_suppkey % 5 AS VARCHAR(20))) ELSE NULL END AS product FROM {lineitem}""",
    "tree": """SELECT record_id, 'gene' AS type, min(start) AS start, max(stop) AS stop, min(strand) AS strand, parent AS feature_id, NULL AS parent, CAST(NULL AS VARCHAR(40)) AS product FROM {parts} GROUP BY record_id, parent
        UNION ALL SELECT record_id, type, start, stop, strand, feature_id, parent, product FROM {parts}""",
    "hits": """SELECT l_orderkey AS query, l_partkey AS subject, l_suppkey AS taxon, CAST(l_quantity AS BIGINT) AS nident, CAST(l_quantity AS BIGINT) + l_linenumber AS length,
        60 + l_suppkey % 40 AS qlen, 55 + l_partkey % 50 AS slen, l_discount AS evalue, 100 - 100 * l_tax AS pident, l_linenumber AS ord, l_extendedprice AS bitscore,
        (l_partkey * 13) % 5000 AS qstart, (l_partkey * 13) % 5000 + CAST(l_quantity AS BIGINT) AS qstop, (l_suppkey * 29) % 5000 AS sstart, (l_suppkey * 29) % 5000 + CAST(l_quantity AS BIGINT) AS sstop,
        concat('protein ', CAST(l_partkey % 7 AS VARCHAR(20)), ' [', 'Phage ', CAST(l_suppkey AS VARCHAR(20)), ']<>putative ', CAST(l_linenumber AS VARCHAR(20)), ' [Host ', CAST(l_suppkey % 9 AS VARCHAR(20)), ']') AS titles FROM {lineitem}""",
    "scores": """SELECT concat('o', CAST(l_orderkey AS VARCHAR(20))) AS id_a, concat('p', CAST(l_partkey AS VARCHAR(20))) AS id_b, CAST(max(l_quantity) AS DOUBLE) * 50 - 900 AS value FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "balance_scores": """SELECT a.c_name AS id_a, b.c_name AS id_b, round(a.c_acctbal - b.c_acctbal, 2) AS value FROM {customer} a JOIN {customer} b ON a.c_nationkey = b.c_nationkey""",
    "oligos": f"""SELECT p_partkey AS seq_id, regexp_replace(translate(concat(p_name, p_type, p_brand), '{_LETTERS}', '{_DNA}'), '[^ACGT]', ''{{g}}) AS seq FROM {{part}}""",
    "reads": """SELECT l_partkey AS record_id, l_orderkey * 7 % 2000 AS start, l_orderkey * 7 % 2000 + CAST(l_quantity AS BIGINT) * 3 AS stop, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS strand FROM {lineitem}""",
    "aligned": f"""SELECT a.conv_id, a.turn, left(a.s, CAST(least(length(a.s), length(b.s)) AS INT)) AS seq_a, left(b.s, CAST(least(length(a.s), length(b.s)) AS INT)) AS seq_b
        FROM (SELECT conv_id, turn, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ''{{g}}), '{_LETTERS} ', '{_DNA}-') AS s FROM {{conversations}}) a
        JOIN (SELECT conv_id, turn, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ''{{g}}), '{_LETTERS} ', '{_DNA}-') AS s FROM {{conversations}}) b
        ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "blocks": """SELECT o_custkey AS lcb, concat('genome', CAST(o_orderkey % 4 AS VARCHAR(20))) AS genome, min(o_orderkey * 3 % 30000) AS start, min(o_orderkey * 3 % 30000) + 200 AS stop,
        min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) AS strand FROM {orders} GROUP BY o_custkey, concat('genome', CAST(o_orderkey % 4 AS VARCHAR(20)))""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver, as a Spark DataFrame."""
    if name not in VIEWS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name in _TEXTS else table
    text = VIEWS[name]
    inputs = {x: view(spark, sf_dir, x) for x in set(re.findall(r"\{([a-z]\w*)\}", text)) - {"g"}}
    return spark.sql(text.replace("{g}", ""), **inputs)


def duckdb_sql(body: str, once: bool = False) -> str:
    """A query text for DuckDB: ``{name}`` becomes the name, and the views it needs come first as common table expressions.

    ``once``: every common table expression, those of the body too, is computed once and kept.
    """
    need: list[str] = []

    def add(text: str) -> None:
        for x in re.findall(r"\{([a-z]\w*)\}", text):
            if x in VIEWS and x not in need:
                add(VIEWS[x])
                need.append(x)

    add(body)
    plain = lambda text: re.sub(r"\{([a-z]\w*)\}", lambda m: ", 'g'" if m[1] == "g" else m[1], text)
    ctes = ",\n".join(f"{x} AS ({plain(VIEWS[x])})" for x in need)
    body = plain(body).strip()
    if not ctes:
        return body
    head = re.match(r"(?i)with\s+(recursive\s+)?", body)
    text = f"WITH {head[1] or ''}{ctes},\n{body[head.end():]}" if head else f"WITH {ctes}\n{body}"
    return re.sub(r"((?:WITH(?: RECURSIVE)?|,)\s+\w+) AS \((?=\s*(?:SELECT|WITH)\b)", r"\1 AS MATERIALIZED (", text) if once and not (head and head[1]) else text
