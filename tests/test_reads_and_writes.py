"""Redacted writes, ambient actors, the audit trail, tools, codenames, versions, the registry form, the catalog, narrowed and kept evaluations."""

import pytest
from grantlake.config import Config
from grantlake.errors import MissingActor, PermissionDenied, SchemaError, StoreBehind, UnscopedNotAllowed
from grantlake.operators import roles
from grantlake.operators.actors import acting, acting_agent, bypassing
from grantlake.operators.audit import Trail
from grantlake.operators.engine import Engine
from grantlake.operators.secure import SecuredFrame, has_codenames, tool
from grantlake.plans.compose import restore, sync
from grantlake.plans.introspect import check_schema
from grantlake.plans.parser import parse_schema
from grantlake.plans.printer import schema_text
from grantlake.refs import Grant, ObjectRef, SubjectRef, subject_ref
from grantlake.sources.store import RegistryStore, TupleStore, migrate, open_store
from grantlake.sources.universe import Universe
from grantlake.sources.versions import current_version, version_scope
from pyspark.sql import functions as F

TEXT = """
caveat limit(amount int, most int) { amount <= most }
definition auth/user {}
definition agents/grant { relation valid: auth/user }
definition auth/group { relation member: auth/user | auth/group#member }
definition lab/room {
    relation keeper: auth/user | auth/group#member
    relation within: lab/room
    permission read = keeper + within->read
}
definition lab/sample {
    relation owner: auth/user | agents/grant#valid
    relation room: lab/room
    relation buyer: auth/user with limit
    relation anyone: auth/user:*
    permission read = owner + room->read + anyone
    permission write = owner + room->read
    permission create = room->read
    permission buy = buyer
    permission read__mass = owner
}
"""
SCHEMA = parse_schema(TEXT)


def grant(r, rel, s, **more):
    return Grant(ObjectRef.parse(r), rel, SubjectRef.parse(s), **more)


GRANTS = [
    grant("lab/sample:1", "owner", "auth/user:ann"),
    grant("lab/sample:2", "owner", "auth/user:bob"),
    grant("lab/sample:3", "owner", "agents/grant:ann.robot#valid"),
    grant("lab/sample:2", "room", "lab/room:inner"),
    grant("lab/sample:4", "anyone", "auth/user:*"),
    grant("lab/room:inner", "within", "lab/room:outer"),
    grant("lab/room:outer", "keeper", "auth/group:staff#member"),
    grant("auth/group:staff", "member", "auth/user:ann"),
    grant("lab/sample:1", "buyer", "auth/user:cat", caveat="limit", context='{"most": 10}'),
    grant("lab/sample:2", "buyer", "auth/user:cat", caveat="limit", context='{"most": 99}'),
]


def engine(spark, trail=None, **settings):
    samples = spark.createDataFrame([(1, "salt", 5), (2, "lead", 6), (3, "iron", 7), (4, "tin", 8)], "id long, name string, mass int")
    universe = Universe().register("lab/sample", samples, "id")
    return Engine(spark, SCHEMA, TupleStore.of(spark, GRANTS).audited(trail), universe, config=Config(**settings))


def samples(e):
    return SecuredFrame.of(e, "lab/sample")


def test_redacted_values_are_kept(spark):
    frame = samples(engine(spark)).as_user("ann").redact("redact")
    shown = frame.to_df()
    assert {r.id: r.mass for r in shown.collect()} == {1: 5, 2: None, 4: None}
    mine = shown.where("id < 3")
    back = {r.id: (r.name, r.mass) for r in frame.save(mine.withColumn("name", F.upper("name"))).collect()}
    assert back == {1: ("SALT", 5), 2: ("LEAD", 6)}
    assert {r.id: r.mass for r in frame.save(mine.where("id = 1").withColumn("mass", F.lit(50))).collect()} == {1: 50}
    with pytest.raises(PermissionDenied, match="mass.*2"):
        frame.save(mine.withColumn("mass", F.lit(50)))
    with pytest.raises(ValueError, match="more than once"):
        frame.save(mine.unionByName(mine))
    assert {r.id: r.mass for r in samples(engine(spark)).as_user("ann").save(mine).collect()} == {1: 5, 2: None}  # nothing is redacted for this frame
    row = frame.instance(2)
    assert row.get().mass is None and row.has_access("write") and not row.has_access("read__mass") and row.as_user("bob").get("redact").mass == 6
    assert [tuple(r) for r in row.save(name="zinc").collect()] == [(2, "zinc", 6)]
    with pytest.raises(PermissionDenied):
        row.as_user("zoe").frame.guard("write")


def test_gated_columns_are_not_handed_out(spark):
    frame = samples(engine(spark)).as_user("ann").redact("redact")
    for take in (frame.scoped, lambda: frame.group_by("mass"), lambda: frame.select("id", "mass")):
        with pytest.raises(PermissionDenied, match="mass"):
            take()
    assert {r.name for r in frame.group_by("name").count().collect()} == {"salt", "lead", "tin"}
    with pytest.raises(Exception, match="mass"):
        frame.group_by("name").agg(F.max("mass")).collect()
    assert frame.count() == 3 and frame.redact("allow").scoped().count() == 3
    other = frame.related(frame, "id").collect()
    assert all(r.other.mass == r.row.mass for r in other) and {r.row.mass for r in other} == {5, None}
    assert {r.id: r.n for r in frame.prefetch_count(frame, "id", "n").collect()} == {1: 1, 2: 1, 4: 1}


def test_ambient_actor_agent_and_bypass(spark, tmp_path):
    e = engine(spark, Trail(spark, str(tmp_path / "log"), at="2024-01-01 00:00:00"))
    frame = samples(e)
    with pytest.raises(MissingActor):
        frame.count()
    with acting("auth/user:ann"):
        assert frame.count() == 3 and frame.as_user("bob").count() == 2
        with bypassing(e, "repair"):
            assert frame.count() == 4 and frame.as_user("bob").count() == 2
    with acting_agent("ann", "robot") as who:
        assert str(who) == "agents/grant:ann.robot#valid" and {r.id for r in frame.to_df().collect()} == {3}
    assert {r.id for r in frame.as_agent("ann", "robot").to_df().collect()} == {3}
    with pytest.raises(UnscopedNotAllowed), bypassing(e, ""):
        pass
    frame.unscoped("report")
    assert sorted((r.kind, r.actor_id, r.reason) for r in e.trail.read().collect()) == [("bypass", "", "report"), ("bypass", "ann", "repair")]
    assert subject_ref(e.config, "auth/group", "staff") == SubjectRef("auth/group", "staff", "member") and frame.as_member("staff").actor.relation == "member"


def test_trail_of_grants_revokes_and_denials(spark, tmp_path):
    e = engine(spark, Trail(spark, str(tmp_path / "log"), ("auth/user", "root")), audit_denials=True)
    store, _ = e.store.write(SCHEMA, [grant("lab/sample:1", "owner", "auth/user:eve")])
    store = store.delete(resource_type="lab/sample", relation="anyone")
    roles.revoke_role(store, ObjectRef("auth/group", "staff"), SubjectRef("auth/user", "ann"))
    assert not e.has_access("auth/user:zoe", "read", "lab/sample:1")
    with pytest.raises(PermissionDenied):
        samples(e).as_user("zoe").guard("write")
    log = [(r.kind, r.actor_id, r.target) for r in e.trail.read().collect()]
    assert [x for x in log if x[0] != "deny"] == [x for x in log if x[0] != "deny" and x[1] == "root"] and len(log) == 8
    assert {("grant", "root", "lab/sample:1#owner @ auth/user:eve"), ("revoke", "root", "lab/sample:4#anyone @ auth/user:*"), ("revoke", "root", "auth/group:staff#member @ auth/user:ann"), ("deny", "zoe", "lab/sample:1#read")} <= set(log)
    assert sum(x[0] == "deny" for x in log) == 5


def test_tools(spark):
    e = engine(spark)

    @tool(e, "lab/sample", "read", id_argument="sample", resource_id="2")
    def show(sample=None):
        return sample

    @tool(e, "lab/sample", "create", relations={"room": "room"})
    def add(room=None):
        return room

    @tool(e, "lab/sample", "buy", id_argument="sample")
    def buy(sample):
        return sample

    with pytest.raises(PermissionDenied, match="nobody"):
        show(1)
    with acting("auth/user:ann"):
        assert show(1) == 1 and show() is None and add(room="lab/room:inner") == "lab/room:inner"
        for fails in (lambda: show(3), add, lambda: add("no reference"), lambda: add("lab/room:else")):
            with pytest.raises(PermissionDenied):
                fails()
    with acting("auth/user:cat"), pytest.raises(PermissionDenied, match="missing: amount"):
        buy(1)


def test_codenames(spark):
    rows = [("ann", "lab.view_sample", "1", True, False), ("ann", "change_sample", "2", True, False), ("ann", "view_sample", "1", False, True), ("zoe", "view_sample", "1", True, True), ("ann", "audit_sample", "1", True, False), ("ann", "view", "1", True, None)]
    asked = spark.createDataFrame([("auth/user", u, "", c, "lab/sample", r, a, s) for u, c, r, a, s in rows], "subject_type string, subject_id string, subject_relation string, codename string, resource_type string, resource_id string, is_active boolean, is_superuser boolean")
    got = lambda e: {(r.subject_id, r.codename, r.is_active): (r.allowed, r.defers) for r in has_codenames(e, asked).collect()}
    plain, above = got(engine(spark)), got(engine(spark, superuser_bypass=True))
    assert plain == {("ann", "lab.view_sample", True): (True, False), ("ann", "change_sample", True): (True, False), ("ann", "view_sample", False): (False, False), ("zoe", "view_sample", True): (False, False), ("ann", "audit_sample", True): (False, True), ("ann", "view", True): (False, True)}
    assert above == plain | {("zoe", "view_sample", True): (True, False)}


def test_reads_at_a_version(spark):
    e = engine(spark)
    store, made = e.store.write(SCHEMA, [grant("lab/sample:1", "owner", "auth/user:zoe")])
    new = e._copy(store=store)
    ask = lambda x, **how: x.check("auth/user:zoe", "read", "lab/sample:1", **how)["allowed"]
    assert ask(new) and ask(new, token=made) and not ask(new, token="lake.9", consistency="at_exact_snapshot") and not ask(e)
    with pytest.raises(StoreBehind):
        ask(e, token=made)
    assert not ask(e, token=made, consistency="minimize_latency")
    for bad in ("other.3", "lake.x", "lake.²"):
        with pytest.raises(ValueError):
            ask(e, token=bad)
    with pytest.raises(ValueError):
        ask(e, consistency="at_exact_snapshot")
    assert current_version() is None
    with version_scope():
        later, made = store.write(SCHEMA, [grant("lab/sample:1", "owner", "auth/user:yan")])
        assert current_version() == made
        with pytest.raises(StoreBehind):
            ask(e)
        assert ask(e._copy(store=later)) and not ask(e, consistency="minimize_latency")
    assert current_version() is None


def test_writes_replace_only_their_keys(spark):
    store = TupleStore.of(spark, GRANTS)
    again, made = store.write(SCHEMA, [grant("lab/sample:1", "buyer", "auth/user:cat", caveat="limit", context="{}"), grant("lab/sample:9", "owner", "auth/user:ann"), grant("lab/sample:1", "buyer", "auth/user:cat", caveat="limit", context='{"most": 1}')])
    rows = {(r.resource_id, r.relation, r.subject_id): (r.version, r.caveat_context) for r in again.df.collect()}
    assert made == "lake.12" and len(rows) == again.df.count() == 11
    assert rows["1", "buyer", "cat"] == (12, '{"most": 1}') and rows["9", "owner", "ann"] == (11, None) and rows["2", "buyer", "cat"] == (9, '{"most": 99}')
    assert store.write(SCHEMA, [])[1] == "lake.9"


def test_registry_form(spark, tmp_path):
    store = TupleStore.of(spark, GRANTS)
    store.save(str(tmp_path / "plain"))
    assert migrate(spark, str(tmp_path / "plain"), str(tmp_path / "coded"), "registry", dry_run=True) == {"read": 10, "written": 0}
    assert migrate(spark, str(tmp_path / "plain"), str(tmp_path / "coded"), "registry") == {"read": 10, "written": 10}
    assert migrate(spark, str(tmp_path / "coded"), str(tmp_path / "back"), "denormalized")["written"] == 10
    coded = RegistryStore.load(spark, str(tmp_path / "coded"))
    wire = lambda df: sorted(map(tuple, df.select(*df.columns[:7]).collect()))
    assert wire(coded.for_resource("lab/sample", "2")) == wire(store.for_resource("lab/sample", "2")) and wire(coded.for_subject("auth/group", "staff", "member")) == wire(store.for_subject("auth/group", "staff", "member"))
    more = coded.upsert(TupleStore.of(spark, [GRANTS[0], grant("lab/sample:8", "owner", "auth/user:new")], 20))
    assert more.plain().df.count() == 11 and more.objects.count() == more.objects.select("key").distinct().count() == coded.objects.count() + 2
    e = Engine(spark, SCHEMA, open_store(spark, str(tmp_path / "coded"), Config(storage="registry")))
    assert e.has_access("auth/user:ann", "read", "lab/sample:2")


def test_catalog_and_lints():
    rows, _ = sync([], "lab", SCHEMA)
    assert schema_text(restore(rows)) == schema_text(SCHEMA)
    assert check_schema(TEXT) == [] and check_schema("definition x") and check_schema("definition a/x { permission p = q\n permission q = p }")
    role = "definition u {}\ndefinition b/role { relation member: u }\ndefinition a/role { relation member: u }"
    assert check_schema(role, Config(universal_admin="a/role:admin")) == ["b/role#member does not admit a/role:admin#member"]
    assert check_schema(TEXT, Config(max_hops=0)) and check_schema(TEXT, Config(storage="odd"))


def test_settings_are_checked(spark):
    table = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(SchemaError, match="begin with"):
        Engine(spark, SCHEMA, TupleStore.empty(spark), Universe("t/").register("lab/sample", table, "id"))
    e = Engine(spark, SCHEMA, TupleStore.empty(spark), Universe("t/").register("lab/sample", table, "id"), config=Config(type_prefix="t/"))
    assert e.universe.get("lab/sample").type == e.universe.get("t/lab/sample").type == "t/lab/sample"
    with pytest.raises(SchemaError, match="max_hops"):
        Engine(spark, SCHEMA, TupleStore.empty(spark), config=Config(max_hops=0))


def test_narrowed_checks_and_contexts_of_requests(spark):
    e = engine(spark)
    asked = spark.createDataFrame([("auth/user", u, "", a, "lab/sample", str(r), c) for u in ("ann", "bob", "cat") for a in ("read", "write", "buy", "none") for r in (1, 2, 3, 4, 5) for c in (None, '{"amount": 50}', '{"amount": 5, "most": 3}')], "subject_type string, subject_id string, subject_relation string, action string, resource_type string, resource_id string, ctx string")
    rows = [sorted(map(str, e.bulk_check(asked, context_column="ctx", narrow=n).collect())) for n in (False, True)]
    assert rows[0] == rows[1]
    got = {(r.subject_id, r.action, r.resource_id, r.ctx): r for r in e.bulk_check(asked, context_column="ctx", narrow=True).collect()}
    assert got["ann", "read", "2", None].allowed and got["ann", "read", "4", None].allowed and not got["bob", "read", "1", None].allowed
    buy = [got["cat", "buy", r, c].result for r in "12" for c in (None, '{"amount": 50}', '{"amount": 5, "most": 3}')]
    assert buy == ["CONDITIONAL_PERMISSION", "NO_PERMISSION", "NO_PERMISSION", "CONDITIONAL_PERMISSION", "HAS_PERMISSION", "NO_PERMISSION"]
    assert list(got["cat", "buy", "1", None].conditional_on) == ["amount"]
    assert {r.subject_id for r in e.bulk_check(asked, {"amount": 9}).where("action = 'buy' and allowed and ctx is null").collect()} == {"cat"}
    plan = e.bulk_check(asked, narrow=True)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_kept_evaluations(spark):
    e = engine(spark)
    first = e.evaluation(["auth/user:ann"])
    frame = samples(e).as_user("ann").redact("redact")
    assert frame.to_df().count() == 3 and e.evaluation([SubjectRef.parse("auth/user:ann")]) is first and len(e._memo) == 1
    assert e.evaluation(["auth/user:ann"], {"amount": 1}) is not first and e._copy(now="2030-01-01 00:00:00")._memo == {}
    assert e._rounds
    e.clear()
    assert not e._memo and not e._rounds and frame.count() == 3
