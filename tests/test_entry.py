"""The driver's contract, and registered queries against their SQL on the smallest tables."""

import os

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["accessible_arrow", "accessible_mutual_recursion", "bulk_check_tristate", "check_new_overlay", "const_admin_arrow", "grants_all_matrix", "redact_field", "role_transitive", "upsert_latest", "cascade_delete", "model_level_check"]


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len([q for q in queries if not q.startswith("op")]) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    want = sorted(repr([r[names.index(c)] for c in order]) for r in cursor.fetchall())
    assert sorted(df.columns) == order
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
