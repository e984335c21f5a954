import pytest
from grantlake.config import Config
from grantlake.errors import SchemaError
from grantlake.plans.ast import Admitted, Backing, Combine, Hop, Name, Nothing
from grantlake.plans.compose import Override, compose, sync
from grantlake.plans.introspect import const_cycles, const_targets, field_gates, permission_sources, permissions_reaching, relation_dependencies, roles_reaching, universal_admin
from grantlake.plans.parser import parse_expression, parse_schema, validate
from grantlake.plans.printer import expression_text, schema_text
from grantlake.refs import Grant, ObjectRef, SubjectRef, agent_grant

TEXT = """
// @package: blog
use expiration
/* a block
comment */
definition auth/user {}
definition auth/group { relation member: auth/user | auth/group#member }
caveat fresh(expires_at timestamp, now timestamp, tags list<string>) { now < expires_at && "}" != '{' && 3 / 2 > 1 % 7 }
definition blog/folder {
    relation owner: auth/user
    relation parent: blog/folder
    permission read = owner + parent->read
}
definition blog/post {
    relation owner: auth/user
    relation viewer: auth/user with fresh | auth/group#member | auth/user:* | org/role:object-viewer#member | auth/user with expiration | auth/user with fresh and expiration
    relation folder: blog/folder // backing:field=folder_id
    relation admin: org/role // backing:const=admin
    permission read = owner + viewer & folder->read - nil
    permission write = (owner - viewer) - owner
    permission read__title = owner
    permission manage = read + admin->member
}
definition org/role { relation member: auth/user }
"""


@pytest.mark.parametrize(
    ("text", "printed"),
    [("a + b & c - d", "(((a + b) & c) - d)"), ("a - b + c", "(a - (b + c))"), ("a - b - c", "((a - b) - c)"), ("a & b + c", "(a & (b + c))"), ("(a & b) + c", "((a & b) + c)"), ("a->b + nil", "(a->b + nil)"), ("a - b & c", "(a - (b & c))")],
)
def test_precedence(text, printed):
    assert expression_text(parse_expression(text)) == printed
    assert parse_expression(printed) == parse_expression(text)


@pytest.mark.parametrize("text", ["a +", "+ a", "(a", "a b", "a->", "", "a $ b"])
def test_bad_expressions(text):
    with pytest.raises(SchemaError):
        parse_expression(text)


def test_schema():
    s = parse_schema(TEXT)
    assert validate(s) == [] and s.uses == ("expiration",) and ("package", "blog") in s.headers
    assert s.caveat("fresh").params == (("expires_at", "timestamp"), ("now", "timestamp"), ("tags", "list"))
    assert s.caveat("fresh").body.endswith("3 / 2 > 1 % 7")
    post = s.definition("blog/post")
    assert post.relation("viewer").admits == (Admitted("auth/user", caveat="fresh"), Admitted("auth/group", "member"), Admitted("auth/user", wildcard=True), Admitted("org/role", "member", id="object-viewer"), Admitted("auth/user", expires=True), Admitted("auth/user", caveat="fresh", expires=True))
    assert post.relation("folder").backing == Backing("field", "folder_id") and post.relation("admin").backing == Backing("const", "admin")
    assert post.permission("read").expr == Combine("-", Combine("&", Combine("+", Name("owner"), Name("viewer")), Hop("folder", "read")), Nothing())


def test_print_round_trip():
    s = parse_schema(TEXT)
    again = parse_schema(schema_text(s))
    assert schema_text(again) == schema_text(s) == schema_text(parse_schema(TEXT))
    assert again.definition("blog/post").relation("folder").backing == Backing("field", "folder_id")


@pytest.mark.parametrize(
    ("text", "word"),
    [
        ("definition a/b { permission p = q }", "undefined"),
        ("definition a/b { permission p = x->y }", "undefined relation"),
        ("definition a/b { relation r: u/v with nope }", "caveat nope"),
        ("definition a/b { relation r: u/v permission r = nil }", "twice"),
        ("definition a/b { relation anonymous: u/v }", "reserved"),
        ("definition a/b { relation r: authenticated }", "no subject type"),
        ("definition a/b { relation r: u/v | u/w // backing:field=x\n }", "backed"),
        ("definition a/b {} definition a/b {}", "twice"),
    ],
)
def test_problems(text, word):
    assert any(word in p for p in validate(parse_schema(text)))


@pytest.mark.parametrize("text", ["definition a/b {", "definition {}", "caveat c(x int) { x > 1", "stuff", "definition a/b { relation r u/v }"])
def test_bad_schemas(text):
    with pytest.raises(SchemaError):
        parse_schema(text)


def test_introspection():
    s = parse_schema(TEXT)
    kinds = [(x.kind, x.name, x.via) for x in permission_sources(s, "blog/post", "manage")]
    assert ("permission", "read", "") in kinds and ("arrow", "member", "admin") in kinds and ("relation", "viewer", "") in kinds
    assert relation_dependencies(s, "blog/post", "manage") == {"owner", "viewer", "folder", "admin"}
    assert permissions_reaching(s, "blog/post", "folder") == {"read", "manage"}
    assert roles_reaching(s, "blog/post", "manage", "org/role") == {"admin", "object-viewer"}
    assert field_gates(s.definition("blog/post"), "read") == {"title": "read__title"}
    assert universal_admin(s, "x/role:admin") == ["org/role#member does not admit x/role:admin#member"] and const_targets(s) == []
    assert const_targets(parse_schema("definition a/b { relation r: n/o // backing:const=x\n permission p = r->q }"))
    assert const_cycles(parse_schema("definition a/b { relation r: a/b // backing:const=x\n permission p = r->p }"))


def test_overrides():
    s = parse_schema(TEXT)
    rows = [Override(4, "tighten", "blog/folder", "read", "owner", "2"), Override(2, "disable", "blog/folder", "read", "nil", "1"), Override(3, "loosen", "blog/folder", "read", "parent", "1"), Override(1, "extend", "blog/folder", "read", "owner", "3"), Override(9, "extend", "no/such", "read", "owner")]
    read = lambda x: expression_text(x.definition("blog/folder").permission("read").expr)
    assert read(compose(s, rows)) == "(((((owner + parent->read) + parent) + owner) - nil) & owner)"
    assert compose(s, []) == s and compose(s, rows) == compose(s, rows[::-1])
    assert read(compose(s, [Override(1, "extend", "blog/folder", "read", "owner", "1", expires_at="5")], now="6")) == read(s)
    assert compose(s, [Override(1, "recaveat", "", "fresh", "true", "1"), Override(2, "recaveat", "", "fresh", "false", "2")]).caveat("fresh").body == "false"
    with pytest.raises(SchemaError, match="cycle"):
        compose(s, [Override(1, "extend", "blog/post", "read", "manage")])
    with pytest.raises(SchemaError):
        compose(s, [Override(1, "extend", "blog/post", "read", "a +")])


def test_sync():
    s = parse_schema(TEXT)
    rows, did = sync([], "blog", s)
    assert set(did.values()) == {"create"} and set(sync(rows, "blog", s)[1].values()) == {"keep"}
    from dataclasses import replace

    key = "permission:blog/folder#read"
    at = next(i for i, r in enumerate(rows) if r.external_id == key)
    edited = [*rows[:at], replace(rows[at], payload="{}"), *rows[at + 1 :]]
    assert sync(edited, "blog", s)[1][key] == "drift" and sync(edited, "blog", s, overwrite=True)[1][key] == "update"
    assert sync([replace(r, payload="{}", no_update=True) if r.external_id == key else r for r in rows], "blog", s)[1][key] == "held"
    small = parse_schema("definition auth/user {}")
    kept, did = sync(rows, "blog", small)
    assert [r.external_id for r in kept] == ["definition:auth/user"] and did[key] == "prune"
    with pytest.raises(SchemaError, match="belongs"):
        sync(rows, "other", s)


def test_refs_and_config():
    assert ObjectRef.parse("a/b:x:y") == ObjectRef("a/b", "x:y") and str(SubjectRef.parse("a/b:x#m")) == "a/b:x#m"
    assert SubjectRef.parse("a/b:x").relation == "" and str(agent_grant("u", "g")) == "agents/grant:u.g#valid"
    assert Grant(ObjectRef("a", "b"), "r", SubjectRef("c", "d")).caveat == ""
    with pytest.raises(ValueError):
        ObjectRef.parse("nothing")
    assert Config().problems() == [] and len(Config(on_exceed="x", storage="y", redact_mode="z", max_hops=0, consistency="q").problems()) == 5
