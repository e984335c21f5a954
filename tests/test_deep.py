"""Registered queries against their SQL where the tree of folders is deeper than the default limit of hops."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from grantlake.config import Config

SF = "/root/testdata/sf0.001"
DEEP = ["accessible_arrow", "check_one", "read_your_writes", "tool_calls", "lookup_subjects_full", "accessible_arrow_union_types", "accessible_folder_tree", "all_of_check", "override_composed", "scoped_exists_by_user", "accessible_precedence", "bulk_check_two_valued", "codename_check"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", DEEP)
def test_deep_folders(spark, monkeypatch, name):
    """20 folders are 3 hops deep and the default is made 1, as 9,900 are 9 hops deep and the default is 8."""
    monkeypatch.setattr(Config.__init__, "__defaults__", (1, *Config.__init__.__defaults__[1:]))
    assert Config().max_hops == 1
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
