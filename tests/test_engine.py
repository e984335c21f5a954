"""The engine on small graphs, and against a plain evaluator on random ones."""

import pytest
from grantlake.config import Config
from grantlake.errors import DepthExceeded, SchemaError
from grantlake.operators import roles
from grantlake.operators.engine import Engine
from grantlake.plans.ast import Combine, Hop, Name, Nothing
from grantlake.plans.parser import parse_schema
from grantlake.refs import Grant, ObjectRef, SubjectRef
from grantlake.sources.store import TupleStore
from grantlake.sources.versions import read_token
from grantlake.sources.universe import Universe
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

BLOG = parse_schema(
    """
definition auth/user {}
definition auth/group { relation member: auth/user | auth/group#member }
caveat link(limit int, now int) { now < limit }
definition blog/folder {
    relation viewer: auth/user | auth/group#member
    relation parent: blog/folder
    permission read = viewer + parent->read
}
definition blog/post {
    relation owner: auth/user
    relation viewer: auth/user | auth/group#member | auth/user:* | auth/user with link
    relation banned: auth/user | auth/user with link
    relation folder: blog/folder
    relation home: blog/folder // backing:field=folder_id
    relation admin: org/role // backing:const=boss
    permission read = owner + viewer + folder->read
    permission calm = viewer - banned
    permission home_read = home->read
    permission manage = admin->member
    permission anyone = authenticated
    permission guest = anonymous
    permission all_but = authenticated - banned
    permission create = folder->read
}
definition org/role {
    relation member: auth/user
    relation includes: org/role#effective_member
    permission effective_member = member + includes
}
"""
)


def g(text, caveat="", context=None, expires=None):
    res, subject = text.split(" @ ")
    obj, relation = res.rsplit("#", 1)
    return Grant(ObjectRef.parse(obj), relation, SubjectRef.parse(subject), caveat, context, expires)


def engine(spark, *grants, schema=BLOG, **config):
    posts = spark.createDataFrame([("p1", "f1"), ("p2", "f2"), ("p3", None)], "id string, folder_id string")
    u = Universe().register("blog/post", posts, "id", {"folder_id": "blog/folder"})
    return Engine(spark, schema, TupleStore.of(spark, [x if isinstance(x, Grant) else g(x) for x in grants]), u, "2024-01-31 00:00:00", Config(**config))


def ids(e, subject, action, kind="blog/post", **k):
    return {r.resource_id for r in e.accessible([subject], action, kind, **k).collect()}


def test_reads(spark):
    e = engine(
        spark,
        "blog/post:p1#owner @ auth/user:ann",
        "blog/post:p2#viewer @ auth/group:g#member",
        "auth/group:g#member @ auth/group:h#member",
        "auth/group:h#member @ auth/group:g#member",
        "auth/group:h#member @ auth/user:bob",
        "blog/post:p3#folder @ blog/folder:leaf",
        "blog/folder:leaf#parent @ blog/folder:root",
        "blog/folder:root#viewer @ auth/group:g#member",
        "blog/post:p4#viewer @ auth/user:*",
        "org/role:boss#member @ auth/user:ann",
        "blog/folder:f1#viewer @ auth/user:cat",
        "blog/post:p1#folder @ auth/user:cat",
        "blog/post:p9#owner @ auth/group:g#member",
        g("blog/post:p5#owner @ auth/user:ann", expires="2024-01-31 00:00:00"),
        g("blog/post:p6#owner @ auth/user:ann", expires="2024-01-31 00:00:01"),
    )
    assert ids(e, "auth/user:ann", "read") == {"p1", "p4", "p6"}
    assert ids(e, "auth/user:bob", "read") == {"p2", "p3", "p4"}
    assert ids(e, "auth/group:g#member", "viewer") == {"p2"}
    assert ids(e, "auth/user:cat", "home_read") == {"p1"}
    assert ids(e, "auth/user:ann", "manage") == {"p1", "p2", "p3"} and ids(e, "auth/user:bob", "manage") == set()
    assert ids(e, "auth/user:ann", "anyone") == {"p1", "p2", "p3"} and ids(e, "auth/anonymous:*", "anyone") == set() and ids(e, "auth/anonymous:*", "guest") == {"p1", "p2", "p3"}
    assert e.check("auth/user:ann", "read", "blog/post:p1")["result"] == "HAS_PERMISSION"
    assert e.check("auth/user:ann", "nope", "blog/post:p1")["reason"] == "unknown action"
    assert e.check("auth/user:ann", "read", "no/such:p1")["reason"] == "unknown resource type"
    assert e.has_access("auth/user:ann", "manage", "blog/post:") and not e.has_access("auth/user:zoe", "home_read", "blog/post:")
    held = {r.subject_id: r.grants_all for r in e.grants_all(e.subjects(["auth/user:ann", "auth/user:bob"]), "manage", "blog/post").collect()}
    assert held == {"ann": True, "bob": False}
    assert not e.grants_all(e.subjects(["auth/user:ann"]), "all_but", "blog/post").first().grants_all
    assert "(owner + viewer)" in e.explain("blog/post", "read") and "Physical Plan" in e.explain("blog/post", "read", e.subjects(["auth/user:ann"]))


def test_whole_type_less_a_few(spark):
    e = engine(spark, "blog/post:p1#banned @ auth/user:ann")
    assert ids(e, "auth/user:ann", "all_but") == {"p2", "p3"} and ids(e, "auth/user:bob", "all_but") == {"p1", "p2", "p3"}


def test_conditions(spark):
    e = engine(
        spark,
        g("blog/post:p1#viewer @ auth/user:ann", "link", '{"limit": 5}'),
        "blog/post:p2#viewer @ auth/user:ann",
        g("blog/post:p2#viewer @ auth/user:ann", "link", '{"limit": 5}'),
        g("blog/post:p2#banned @ auth/user:ann", "link", "{}"),
        g("blog/post:p3#viewer @ auth/user:ann", "unknown", "{}"),
    )
    row = e.check("auth/user:ann", "read", "blog/post:p1")
    assert (row.result, row.conditional_on) == ("CONDITIONAL_PERMISSION", ["now"])
    assert e.check("auth/user:ann", "read", "blog/post:p1", {"now": 4}).allowed and not e.check("auth/user:ann", "read", "blog/post:p1", {"now": 5}).allowed
    assert e.check("auth/user:ann", "read", "blog/post:p2").allowed and not e.check("auth/user:ann", "read", "blog/post:p3").allowed
    row = e.check("auth/user:ann", "calm", "blog/post:p2")
    assert (row.result, row.conditional_on) == ("CONDITIONAL_PERMISSION", ["limit", "now"])
    assert ids(e, "auth/user:ann", "read") == {"p2"} and ids(e, "auth/user:ann", "read", conditional=True) == {"p1", "p2"}


def test_hops(spark):
    chain = [f"blog/folder:{i + 1}#parent @ blog/folder:{i}" for i in range(12)]
    grants = [*chain, "blog/folder:0#viewer @ auth/user:ann"]
    with pytest.raises(DepthExceeded):
        ids(engine(spark, *grants), "auth/user:ann", "read", "blog/folder")
    assert ids(engine(spark, *grants, on_exceed="truncate"), "auth/user:ann", "read", "blog/folder") == {str(i) for i in range(9)}
    loop = ["blog/folder:a#parent @ blog/folder:b", "blog/folder:b#parent @ blog/folder:a", "blog/folder:a#viewer @ auth/user:ann"]
    assert ids(engine(spark, *loop), "auth/user:ann", "read", "blog/folder") == {"a", "b"}


def test_not_stratified(spark):
    bad = parse_schema("definition u/u {} definition a/b { relation r: a/b relation o: u/u permission p = o - r->p }")
    with pytest.raises(SchemaError, match="itself"):
        ids(engine(spark, schema=bad), "u/u:x", "p", "a/b")


def test_preflight(spark):
    e = engine(spark, "blog/folder:f#viewer @ auth/user:ann")
    rows = [("1", "auth/user", "ann", "", "create", "blog/post"), ("2", "auth/user", "bob", "", "create", "blog/post"), ("3", "auth/user", "bob", "", "home_read", "blog/post")]
    proposals = spark.createDataFrame(rows, "id string, subject_type string, subject_id string, subject_relation string, action string, resource_type string")
    edge = "id string, relation string, subject_type string, subject_id string, subject_relation string"
    edges = spark.createDataFrame([("1", "folder", "blog/folder", "f", ""), ("2", "folder", "blog/folder", "f", ""), ("3", "home", "blog/folder", "f", "")], edge)
    assert {r.id: r.allowed for r in e.check_new(proposals, edges).collect()} == {"1": True, "2": False, "3": False}
    with pytest.raises(SchemaError, match="constant"):
        e.check_new(proposals, spark.createDataFrame([("1", "admin", "org/role", "boss", "")], edge))


def test_roles(spark):
    role, top = ObjectRef("org/role", "reader"), ObjectRef("org/role", "boss")
    store = roles.imply(roles.grant_role(TupleStore.empty(spark), BLOG, top, SubjectRef("auth/user", "ann")), BLOG, top, role)
    e = Engine(spark, BLOG, store)
    assert ids(e, "auth/user:ann", "effective_member", "org/role") == {"boss", "reader"}
    assert [r.role_id for r in roles.implies_of(store, top).collect()] == ["reader"] and [r.role_id for r in roles.implied_by_of(store, role).collect()] == ["boss"]
    assert roles.members_of(store, top).count() == 1 and roles.roles_of(store, e.subjects(["auth/user:ann"])).count() == 1
    assert roles.unimply(store, top, role).df.count() == 1 and roles.revoke_role(store, top, SubjectRef("auth/user", "ann")).df.count() == 1
    strict = Engine(spark, BLOG, store, config=Config(usersets_are_relations_only=True))
    assert ids(strict, "auth/user:ann", "effective_member", "org/role") == {"boss"}


def test_store(spark):
    store, first = TupleStore.empty(spark).write(BLOG, [g("blog/post:p#owner @ auth/user:a"), g("blog/post:p#viewer @ auth/group:g#member")])
    store, second = store.write(BLOG, [g("blog/post:p#owner @ auth/user:a", expires="2030-01-01 00:00:00"), g("blog/post:q#owner @ auth/user:a"), g("blog/post:q#owner @ auth/user:a", expires="2031-01-01 00:00:00")])
    rows = {(r.resource_id, r.relation): r for r in store.df.collect()}
    assert len(rows) == 3 and str(rows[("p", "owner")].expires_at)[:4] == "2030" and str(rows[("q", "owner")].expires_at)[:4] == "2031"
    assert read_token(second) > read_token(first) and store.as_of(read_token(first)).df.count() == 1
    with pytest.raises(ValueError):
        read_token("other.5")
    for bad in ("blog/post:p#owner @ auth/group:g#member", "blog/post:p#nope @ auth/user:a", "no/type:p#owner @ auth/user:a", "blog/post:p#admin @ org/role:boss"):
        with pytest.raises(SchemaError, match="inadmissible"):
            store.write(BLOG, [g("blog/post:ok#owner @ auth/user:a"), g(bad)])
    with pytest.raises(ValueError):
        store.delete(BLOG)
    with pytest.raises(SchemaError, match="backed"):
        store.delete(BLOG, resource_type="blog/post", relation="admin")
    assert store.delete(BLOG, resource_id="q").df.count() == 2 and store.delete(allow_all=True).df.count() == 0
    assert store.delete_exact(store.df.where("relation = 'viewer'")).df.count() == 2
    assert sorted(map(tuple, TupleStore.decode(*store.encode()).wire().collect())) == sorted(map(tuple, store.wire().collect()))
    assert store.cascade(spark.createDataFrame([("auth/group", "g"), ("blog/post", "q")], "type string, id string")).df.count() == 1
    assert store.for_resource("blog/post", "p").count() == 2 and store.for_subject("auth/group", "g", "member").count() == 1


# -- random graphs

NAMES = ["r1", "r2", "p1", "p2"]
TYPES = ["a/x", "a/y"]


def plain(schema, tuples, subject, kind, name):
    """Ids by naive iteration to the least fixpoint; exclusion only of relations, which come first."""
    sets = {(d.type, n): set() for d in schema.definitions for n in NAMES if d.type in TYPES}

    def value(t, e):
        if isinstance(e, Nothing):
            return set()
        if isinstance(e, Name):
            return sets[(t, e.name)]
        if isinstance(e, Hop):
            return {r[1] for r in tuples if r[0] == t and r[2] == e.via and r[5] == "" and r[4] in sets.get((r[3], e.target), ())}
        left, right = value(t, e.left), value(t, e.right)
        return left | right if e.op == "+" else left & right if e.op == "&" else left - right

    for part in (("r1", "r2"), ("p1", "p2")):
        for _ in range(40):
            for d in schema.definitions:
                for n in part if d.type in TYPES else ():
                    if rel := d.relation(n):
                        new = {r[1] for r in tuples if r[0] == d.type and r[2] == n and (r[3], r[4], r[5]) == subject}
                        new |= {r[1] for r in tuples if r[0] == d.type and r[2] == n and r[3] == "u/u" and r[4] == "*"}
                        new |= {r[1] for r in tuples if r[0] == d.type and r[2] == n and r[5] and r[4] in sets[(r[3], r[5])]}
                        assert rel
                    else:
                        new = value(d.type, d.permission(n).expr)
                    sets[(d.type, n)] = sets[(d.type, n)] | new
    return sets[(kind, name)]


leaf = st.sampled_from([Name("r1"), Name("r2"), Hop("r1", "p1"), Hop("r2", "p2"), Hop("r2", "r1"), Nothing()])
positive = st.recursive(leaf, lambda x: st.builds(Combine, st.sampled_from("+&"), x, x), max_leaves=4)
expression = positive | st.builds(Combine, st.just("-"), positive, st.sampled_from([Name("r1"), Name("r2")]))
row = st.tuples(st.sampled_from(TYPES), st.sampled_from("123"), st.sampled_from(["r1", "r2"]), st.one_of(st.tuples(st.just("u/u"), st.sampled_from(["ann", "bob", "*"]), st.just("")), st.tuples(st.sampled_from(TYPES), st.sampled_from("123"), st.sampled_from(["", "r1"]))))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow], derandomize=True)
@given(exprs=st.tuples(expression, expression, expression, expression), rows=st.lists(row, min_size=4, max_size=14, unique=True))
def test_random_graphs(spark, exprs, rows):
    from grantlake.plans.printer import expression_text

    admits = "u/u | u/u:* | a/x | a/y | a/x#r1 | a/y#r1"
    text = "definition u/u {}" + "".join(f"definition {t} {{ relation r1: {admits}\n relation r2: {admits}\n permission p1 = {expression_text(exprs[2 * i])}\n permission p2 = {expression_text(exprs[2 * i + 1])} }}\n" for i, t in enumerate(TYPES))
    schema = parse_schema(text)
    tuples = [(t, i, r, *s) for t, i, r, s in rows]
    grants = [Grant(ObjectRef(t, i), r, SubjectRef(*s)) for t, i, r, s in rows]
    e = Engine(spark, schema, TupleStore.of(spark, grants), config=Config(max_hops=50))
    for t, n in (("a/x", "p1"), ("a/y", "p2")):
        got = {}
        for r in e.accessible(["u/u:ann", "u/u:bob"], n, t).collect():
            got.setdefault(r.subject_id, set()).add(r.resource_id)
        for who in ("ann", "bob"):
            assert got.get(who, set()) == plain(schema, tuples, ("u/u", who, ""), t, n)


@pytest.mark.parametrize("narrow", [False, True])
def test_hops_without_a_limit(spark, narrow):
    """Chains longer than the default limit, downwards and, from the requested objects, upwards; cycles end all the same."""
    chain = [f"blog/folder:{i + 1}#parent @ blog/folder:{i}" for i in range(15)]
    e = engine(spark, *chain, "blog/folder:0#parent @ blog/folder:9", "blog/folder:0#viewer @ auth/user:ann", "blog/post:p1#folder @ blog/folder:15", max_hops=None)
    asked = spark.createDataFrame([("auth/user", who, "", "read", "blog/post", "p1") for who in ("ann", "bob")], "subject_type string, subject_id string, subject_relation string, action string, resource_type string, resource_id string")
    assert {r.subject_id: r.allowed for r in e.bulk_check(asked, narrow=narrow).collect()} == {"ann": True, "bob": False}
    if not narrow:
        assert ids(e, "auth/user:ann", "read", "blog/folder") == {str(i) for i in range(16)}


def test_only_asked_pairs_of_types_that_nothing_asked_for_leads_into(spark):
    """Stars lead into posts by `open` alone: requests to read meet the edges of posts as pairs, those to open do not; both are right."""
    schema = parse_schema("definition auth/user {} definition blog/folder { relation viewer: auth/user relation starred: blog/post permission read = viewer permission open = viewer + starred->open } definition blog/post { relation owner: auth/user | auth/user:* relation folder: blog/folder permission read = owner + folder->read permission open = owner + folder->open }")
    e = engine(spark, "blog/post:p1#folder @ blog/folder:f", "blog/folder:f#starred @ blog/post:p2", "blog/post:p2#owner @ auth/user:ann", "blog/folder:f#viewer @ auth/user:bob", "blog/post:p3#owner @ auth/user:*", schema=schema)
    want = {("ann", "read", "p2"), ("bob", "read", "p1"), ("ann", "open", "p1"), ("ann", "open", "p2"), ("bob", "open", "p1"), *(("ann", a, "p3") for a in ("read", "open")), *(("bob", a, "p3") for a in ("read", "open"))}
    every = [("auth/user", who, "", a, "blog/post", p) for who in ("ann", "bob") for a in ("read", "open") for p in ("p1", "p2", "p3")]
    for actions in (("read",), ("open",), ("read", "open")):
        rows = [x for x in every if x[3] in actions]
        asked = spark.createDataFrame(rows, "subject_type string, subject_id string, subject_relation string, action string, resource_type string, resource_id string")
        assert {(r.subject_id, r.action, r.resource_id) for r in e.bulk_check(asked).collect() if r.allowed} == {x for x in want if x[1] in actions}
        ev = e.evaluate(asked)
        ev.wanted = [("blog/post", a) for a in actions]
        assert ev.is_top("blog/post") == ("open" not in actions)


def test_intersection_works_out_pairs_of_the_lesser_side(spark):
    """Owners are few; viewers through groups and everyone are only looked up for them, from either side of `&` and through a hop."""
    schema = parse_schema("definition auth/user {} definition auth/group { relation member: auth/user | auth/group#member } definition blog/folder { relation viewer: auth/user permission read = viewer } definition blog/post { relation owner: auth/user relation folder: blog/folder relation viewer: auth/user | auth/user:* | auth/group#member permission a = owner & viewer permission b = viewer & owner permission c = owner & (viewer + folder->read) permission d = viewer & folder->read }")
    e = engine(spark, *[f"blog/post:p{i}#owner @ auth/user:ann" for i in range(1, 6)], "blog/post:p1#viewer @ auth/user:*", "blog/post:p2#viewer @ auth/group:g#member", "auth/group:g#member @ auth/group:h#member", "auth/group:h#member @ auth/user:ann", "auth/group:h#member @ auth/user:bob", "blog/post:p3#viewer @ auth/user:ann", "blog/post:p4#folder @ blog/folder:f", "blog/folder:f#viewer @ auth/user:ann", "blog/post:p1#folder @ blog/folder:f", schema=schema)
    users = e.subjects(["auth/user:ann", "auth/user:bob"])
    for action, want in (("a", "123"), ("b", "123"), ("c", "1234"), ("d", "1")):
        assert {(r.subject_id, r.resource_id) for r in e.accessible(users, action, "blog/post").collect()} == {("ann", f"p{i}") for i in want}
        ev = e.evaluate(users)
        ev.verdicts("blog/post", action)
        written = "few" in "".join(f for df in (ev.memo[("blog/post", action)].rows,) for f in df.inputFiles())
        assert written == (action != "d")
