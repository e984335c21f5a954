"""Answers with a row for every subject and object: no table on the way is as large, and what is written compresses."""

import os

import __spark_entry__ as entry
import pytest
from grantlake.operators.engine import SUBJECT, Engine
from grantlake.plans.parser import parse_schema
from grantlake.sources.scratch import Rounds
from grantlake.sources.store import TupleStore
from grantlake.sources.universe import Universe
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
COLUMNS = "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string, caveat_name string, caveat_context string, expires_at timestamp_ntz, version long"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_no_table_has_a_row_for_each_check(spark, monkeypatch):
    saved, save = [], Rounds.save

    def noted(self, df, at):
        saved.append(save(self, df, at))
        return saved[-1]

    monkeypatch.setattr(Rounds, "save", noted)
    n = entry.queries()["check_new_overlay"](spark, SF).count()
    assert n == 3000 and saved and all(df.count() < n for df in saved)


def test_all_subjects_asked_for_each_proposal(spark):
    """The same verdicts as for proposals of one subject each, told by names or not (an unknown action)."""
    schema = parse_schema("""definition a/user {}
definition a/group { relation member: a/user | a/group#member }
definition a/folder { relation viewer: a/user | a/group#member
 relation parent: a/folder
 permission read = viewer + parent->read }
definition a/doc { relation folder: a/folder
 relation viewer: a/user | a/group#member | a/user:*
 relation banned: a/user | a/group#member
 permission create = folder->read & authenticated
 permission less = (viewer + folder->read) - banned }""")
    rows = [("a/group", "g", "member", "a/user", str(i), "") for i in range(4)] + [("a/group", "h", "member", "a/group", "g", "member"), ("a/group", "h", "member", "a/user", "5", "")]
    rows += [("a/folder", "1", "parent", "a/folder", "0", ""), ("a/folder", "0", "viewer", "a/group", "g", "member"), ("a/folder", "1", "viewer", "a/user", "5", ""), ("a/doc", "9", "folder", "a/folder", "0", "")]
    store = TupleStore(spark.createDataFrame([(*r, "", None, None, 1) for r in rows], COLUMNS))
    engine = Engine(spark, schema, store)
    subjects = engine.subjects([f"a/user:{i}" for i in range(8)] + ["a/group:h#member", "anonymous:*"])
    given = [("p", "folder", "a/folder", "0", ""), ("q", "folder", "a/folder", "1", ""), ("q", "banned", "a/group", "g", "member"), ("r", "viewer", "a/user", "*", ""), ("r", "banned", "a/user", "6", ""), ("s", "viewer", "a/group", "h", "member")]
    edges = spark.createDataFrame(given, "id string, relation string, subject_type string, subject_id string, subject_relation string")
    for actions in (("create", "less"), ("less", "unheard")):
        asked = spark.createDataFrame([(i, a) for i in "pqrst" for a in actions], "id string, action string").withColumn("resource_type", F.lit("a/doc"))
        each = asked.crossJoin(subjects).withColumn("one", F.concat_ws("/", "id", "action", *SUBJECT))
        mine = edges.join(each.select("id", "one"), "id").drop("id").withColumnRenamed("one", "id")
        want = engine.check_new(each.withColumnsRenamed({"id": "which", "one": "id"}), mine).select(F.col("which").alias("id"), *SUBJECT, "action", "verdict", "allowed", "result", "conditional_on", "reason")
        got = engine.check_new(asked, edges, subjects=subjects).select(*want.columns)
        assert got.count() == 50 * len(actions)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def role(spark, members, objects):
    schema = parse_schema("""definition a/user {}
definition a/role { relation member: a/user }
definition a/order { relation admin: a/role // backing:const=admin
 permission read = admin->member }""")
    rows = spark.range(members).select(*[F.lit(x).alias(c) for c, x in (("resource_type", "a/role"), ("resource_id", "admin"), ("relation", "member"), ("subject_type", "a/user"))], (F.col("id") * 7919 % 100003).cast("string").alias("subject_id"), F.lit("").alias("subject_relation"), F.lit("").alias("caveat_name"), F.lit(None).cast("string").alias("caveat_context"), F.lit(None).cast("timestamp_ntz").alias("expires_at"), F.lit(1).cast("long").alias("version"))
    engine = Engine(spark, schema, TupleStore(rows), Universe().register("a/order", spark.range(objects), "id"))
    return engine, rows.select(*SUBJECT)


def test_whole_types_are_written_small(spark, tmp_path):
    """Two million rows of subject and object: less than half a byte each with Spark's own settings (1.4 where all subjects follow in turn)."""
    engine, subjects = role(spark, 2000, 1000)
    out = engine.accessible(subjects, "read", "a/order").select("subject_id", F.col("resource_id").cast("long").alias("order"))
    out.write.parquet(f"file://{tmp_path}/out")
    there = spark.read.parquet(f"file://{tmp_path}/out")
    assert there.count() == there.distinct().count() == 2_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1_000_000


def test_whole_types_in_the_tables_own_type(spark, monkeypatch):
    from grantlake.operators import engine as at

    engine, subjects = role(spark, 600, 300)
    want = {("a/user", str(i * 7919 % 100003), "", o) for i in range(600) for o in range(300)}
    for few in (at.FEW, 10):
        monkeypatch.setattr(at, "FEW", few)
        got = [tuple(r) for r in engine.accessible(subjects, "read", "a/order", native=True).collect()]
        assert len(got) == len(want) and set(got) == want
