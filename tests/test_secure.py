import pytest
from grantlake.config import Config
from grantlake.errors import MissingActor, PermissionDenied, UnscopedNotAllowed
from grantlake.operators import audit
from grantlake.operators.engine import Engine
from grantlake.operators.secure import SecuredFrame, codename_to_action, requires
from grantlake.plans.parser import parse_schema
from grantlake.refs import Grant, ObjectRef, SubjectRef
from grantlake.sources.store import TupleStore
from grantlake.sources.universe import Universe
from grantlake.streaming.checks import check_stream
from pyspark.sql import functions as F

SCHEMA = parse_schema(
    """
definition auth/user {}
definition hr/team { relation lead: auth/user
    permission read = lead }
definition hr/person {
    relation self: auth/user
    relation team: hr/team // backing:field=team_id
    permission read = self + team->read
    permission write = team->read
    permission delete = team->read
    permission create = nil
    permission read__salary = self
    permission write__salary = self
}
"""
)


@pytest.fixture
def e(spark):
    people = spark.createDataFrame([(1, "ann", 10, "t1"), (2, "bob", 20, "t1"), (3, "cat", 30, "t2")], "id long, name string, salary int, team_id string")
    teams = spark.createDataFrame([("t1", "one"), ("t2", "two")], "id string, title string")
    u = Universe().register("hr/person", people, "id", {"team_id": "hr/team"}).register("hr/team", teams, "id")
    grant = lambda r, rel, s: Grant(ObjectRef.parse(r), rel, SubjectRef.parse(s))
    store = TupleStore.of(spark, [grant("hr/team:t1", "lead", "auth/user:ann"), *[grant(f"hr/person:{i}", "self", f"auth/user:{n}") for i, n in ((1, "ann"), (2, "bob"), (3, "cat"))]])
    return Engine(spark, SCHEMA, store, u)


def people(e, who="ann"):
    return SecuredFrame.of(e, "hr/person").as_user(who)


def test_scope_and_redaction(e):
    assert {r.name for r in people(e).to_df().collect()} == {"ann", "bob"} and people(e, "bob").count() == 1 and not people(e, "zoe").exists()
    shown = {r.name: r.salary for r in people(e).redact("redact").to_df().collect()}
    assert shown == {"ann": 10, "bob": None}
    assert {r.name: r._omitted for r in people(e).redact("omit").to_df().collect()} == {"ann": [], "bob": ["salary"]}
    assert {r.name: r.salary for r in people(e).redact("redact").for_write().to_df().collect()} == {"ann": 10, "bob": 20}
    assert people(e).group_by().agg(F.sum("salary")).first()[0] == 30
    with pytest.raises(PermissionDenied):
        people(e).redact("redact").select("name", "salary")
    assert people(e).redact("redact").select("name").count() == 2
    assert [tuple(r) for r in people(e).denied_fields().collect()] == [(2, "salary")]


def test_bypass(e):
    frame = SecuredFrame.of(e, "hr/person")
    with pytest.raises(MissingActor):
        frame.count()
    with pytest.raises(UnscopedNotAllowed):
        frame.unscoped()
    assert frame.unscoped("report").count() == 3 and frame.system("job").count() == 3
    with pytest.raises(UnscopedNotAllowed):
        SecuredFrame.of(e._copy(config=Config(allow_unscoped=False)), "hr/person").unscoped("x")
    assert SecuredFrame.of(e._copy(config=Config(strict=False)), "hr/person").count() == 3
    with pytest.raises(ValueError):
        frame.with_action("")


def test_writes(e):
    mine = people(e).where("team_id = 't1'")
    assert {r.name for r in mine.update({"name": F.upper("name")}).collect()} == {"ANN", "BOB"}
    with pytest.raises(PermissionDenied, match="write__salary"):
        mine.update({"salary": F.lit(1)})
    with pytest.raises(PermissionDenied, match="3"):
        people(e).update({"name": F.lit("x")})
    table = e.universe.get("hr/person").df
    assert {r.name for r in mine.delete(table).collect()} == {"cat"}
    people(e).save(table.withColumn("name", F.when(F.col("id") == 2, "rob").otherwise(F.col("name"))))
    with pytest.raises(PermissionDenied):
        people(e).save(table.withColumn("salary", F.lit(5)))
    with pytest.raises(PermissionDenied, match="create"):
        people(e).save(table.withColumn("id", F.col("id") + 100))


def test_joins(e):
    teams = SecuredFrame.of(e, "hr/team").as_user("ann")
    assert {(r.name, r.team__title) for r in people(e).guarded_join(teams, "team_id").collect()} == {("ann", "one"), ("bob", "one")}
    with pytest.raises(PermissionDenied):
        people(e, "cat").guarded_join(SecuredFrame.of(e, "hr/team").as_user("cat"), "team_id").count()
    lists = {r.id: [p.name for p in r.people] for r in teams.prefetch(people(e), "team_id", "people").collect()}
    assert lists == {"t1": ["ann", "bob"]}


def test_gates_and_names(e):
    @requires(people(e, "bob"), "read", "person_id")
    def show(person_id):
        return person_id

    assert show(person_id=2) == 2
    with pytest.raises(PermissionDenied):
        show(person_id=1)
    assert [codename_to_action(n) for n in ("view_x", "app.change_x", "delete_x", "add_x", "audit")] == ["read", "write", "delete", "create", "audit"]
    assert e.universe.problems(SCHEMA) == ["hr/person.team_id points at hr/team: joins need a guarded join or a scoped prefetch"]


def test_audit_and_stream(spark, e, tmp_path):
    rows = audit.events(e.store.df, "grant", ("auth/user", "root"), "seed", "2024-01-01 00:00:00")
    audit.append(rows, str(tmp_path / "log"))
    audit.append(audit.events(e.store.matching(relation="lead"), "revoke"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 5 and "hr/team:t1#lead @ auth/user:ann" in {r.target for r in log.collect()}
    asked = spark.createDataFrame([("auth/user", n, "", "read", "hr/person", str(i)) for n in ("ann", "bob") for i in (1, 2, 3)], "subject_type string, subject_id string, subject_relation string, action string, resource_type string, resource_id string")
    assert audit.denials(e.bulk_check(asked)).count() == 3
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    check_stream(stream, lambda: e, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("allowed").count() == 3
