"""Queries over user sets: answers come from sets of the names in tuples, and no table that is written on the way has a row for each member of a group and object."""

import os

import __spark_entry__ as entry
import pytest
from grantlake.sources.scratch import Rounds

SF = "/root/testdata/sf0.01"
NAMED = [
    "schema_from_catalog",
    "accessible_builtin_intersection",
    "accessible_union",
    "accessible_exclusion",
    "override_composed",
    "accessible_group",
    "accessible_precedence",
    "all_of_check",
    "accessible_arrow_union_types",
    "accessible_folder_tree",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMED)
def test_told_by_names(spark, monkeypatch, name):
    saved, save = [], Rounds.save

    def noted(self, df, at):
        out = save(self, df, at)
        saved.append((at, out))
        return out

    monkeypatch.setattr(Rounds, "save", noted)
    entry.queries()[name](spark, SF)
    found = [df for at, df in saved if at == "sets"]
    assert found
    for df in found:  # user sets and everyone stand in place of their members
        assert not df.where("name like '%#member' or name like '%:*#'").isEmpty()


def test_unions_and_exclusions_by_names(spark):
    """Every operator, `*`, nested groups and a subject that two names stand for, against verdicts of single checks."""
    from grantlake.operators.engine import SUBJECT, Engine
    from grantlake.plans.parser import parse_schema
    from grantlake.sources.store import TupleStore

    schema = parse_schema("""definition a/user {}
definition a/group { relation member: a/user | a/group#member }
definition a/folder { relation viewer: a/user | a/group#member
 relation parent: a/folder
 permission read = viewer + parent->read }
definition a/doc { relation owner: a/user
 relation viewer: a/user | a/group#member | a/user:*
 relation folder: a/folder
 relation banned: a/user | a/group#member
 permission any = owner + viewer + folder->read
 permission both = viewer & folder->read
 permission less = (owner + folder->read) - banned
 permission mixed = both + less
 permission known = viewer & authenticated
 permission nested = (viewer - banned) & any }""")
    rows = [("a/group", "g", "member", "a/user", str(i), "") for i in range(4)] + [("a/group", "h", "member", "a/group", "g", "member"), ("a/group", "h", "member", "a/user", "5", "")]
    rows += [("a/folder", "1", "parent", "a/folder", "0", ""), ("a/folder", "2", "parent", "a/folder", "1", ""), ("a/folder", "0", "viewer", "a/group", "g", "member"), ("a/folder", "1", "viewer", "a/user", "5", ""), ("a/folder", "2", "viewer", "a/group", "h", "member")]
    rows += [("a/doc", str(i), "folder", "a/folder", str(i % 3), "") for i in range(6)] + [("a/doc", str(i), "owner", "a/user", str(i), "") for i in range(6)]
    rows += [("a/doc", "0", "viewer", "a/user", "*", ""), ("a/doc", "1", "viewer", "a/group", "h", "member"), ("a/doc", "2", "viewer", "a/user", "6", ""), ("a/doc", "4", "viewer", "a/group", "g", "member"), ("a/doc", "5", "viewer", "a/group", "h", "member"), ("a/doc", "5", "viewer", "a/group", "g", "member")]
    rows += [("a/doc", "1", "banned", "a/user", "2", ""), ("a/doc", "5", "banned", "a/group", "g", "member"), ("a/doc", "0", "banned", "a/user", "1", "")]
    store = TupleStore(spark.createDataFrame([(*r, "", None, None, 1) for r in rows], "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string, caveat_name string, caveat_context string, expires_at timestamp_ntz, version long"))
    names = [f"a/user:{i}" for i in range(8)] + ["a/group:g#member", "a/group:h#member"]
    frame = (engine := Engine(spark, schema, store)).subjects(names)
    everyone = frame.crossJoin(spark.createDataFrame([(str(i),) for i in range(6)], "resource_id string")).selectExpr("*", "'a/doc' as resource_type")
    for action in ("mixed", "nested"):
        assert engine.evaluate(frame).by_names("a/doc", action) is not None
        got = [tuple(r) for r in engine.accessible(frame, action, "a/doc").select(*SUBJECT, "resource_id").collect()]
        want = {tuple(r) for r in engine.accessible(names, action, "a/doc").select(*SUBJECT, "resource_id").collect()}  # one by one
        assert len(got) == len(set(got)) and set(got) == want
        asked = engine.bulk_check(everyone.selectExpr("*", f"'{action}' as action"), narrow=False).where("allowed")
        assert {tuple(r) for r in asked.select(*SUBJECT, "resource_id").collect()} == want


def test_objects_with_equal_sets_are_told_at_once(spark, monkeypatch):
    """Requested subjects meet each set of names once, not once an object that has it; what is dealt to several rows is told once each."""
    from grantlake.operators import engine as at
    from grantlake.operators.engine import SUBJECT, Engine
    from grantlake.plans.parser import parse_schema
    from grantlake.sources.store import TupleStore

    schema = parse_schema("""definition a/user {}
definition a/group { relation member: a/user }
definition a/doc { relation viewer: a/user | a/group#member
 relation banned: a/user
 relation open: a/user:*
 permission read = (viewer & open) - banned }""")
    rows = [("a/group", g, "member", "a/user", str(u), "") for g, us in (("g", range(4)), ("h", range(2, 6))) for u in us]
    rows += [("a/doc", str(i), "viewer", "a/group", g, "member") for i in range(40) for g in ("g", "h") if i % 3 or g == "g"] + [("a/doc", "1", "banned", "a/user", "2", "")] + [("a/doc", str(i), "open", "a/user", "*", "") for i in range(40)]
    store = TupleStore(spark.createDataFrame([(*r, "", None, None, 1) for r in rows], "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string, caveat_name string, caveat_context string, expires_at timestamp_ntz, version long"))
    names = [f"a/user:{i}" for i in range(7)]
    want = {("a/user", str(u), "", str(i)) for i in range(40) for u in range(6 if i % 3 else 4) if (i, u) != (1, 2)}
    frame = (engine := Engine(spark, schema, store)).subjects(names)
    by = engine.evaluate(frame).by_names("a/doc", "read")
    assert by.sets.count() == 40 and by.alike(by.sets).count() == 3
    for most, members in ((at.ALIKE, at.MEMBERS), (4, at.MEMBERS), (4, 0)):
        monkeypatch.setattr(at, "ALIKE", most)
        monkeypatch.setattr(at, "MEMBERS", members)
        got = [tuple(r) for r in engine.accessible(frame, "read", "a/doc").select(*SUBJECT, "resource_id").collect()]
        assert len(got) == len(want) and set(got) == want
    assert by.alike(by.sets).count() > 3
