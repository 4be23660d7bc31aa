"""Every registered query of the library proper against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from genoloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float) or hasattr(v, "is_finite"):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    q = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())


#: Queries without SQL, and where plain Python stands in for it.
BRUTE_FORCE = {
    "require_sd": "test_brute_force", "suppress_stops": "test_brute_force", "frameshift_scan": "test_brute_force", "block_split": "test_brute_force", "sar_table": "test_brute_force", "inner_candidates": "test_brute_force",
    "outer_candidates": "test_brute_force", "single_candidates": "test_brute_force", "candidate_summary": "test_brute_force", "annotation_compare": "test_alignment", "annotation_summary": "test_alignment", "renumber_report": "test_gene_models",
}


def test_every_query_has_sql_or_brute_force():
    assert set(QUERIES) - set(ORACLE_SQL) == set(BRUTE_FORCE)


@pytest.mark.parametrize("name", sorted(BRUTE_FORCE))
def test_query_without_sql_reads_the_tables(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns and (rows or name in ("suppress_stops", "single_candidates", "require_sd")), name
