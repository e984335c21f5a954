"""Registered queries: (spark, folder) -> DataFrame, one or more an operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import PermissionDenied, SchemaError, StoreBehind
from ..functions import cel
from ..operators import roles
from ..operators.actors import acting, bypassing
from ..operators.audit import Trail
from ..operators.engine import SUBJECT
from ..operators.secure import SecuredFrame, has_any_tuple, has_codenames, has_perms, tool
from ..operators.verdicts import and3, minus3, or3
from ..plans.ast import Caveat, Permission
from ..plans.compose import Override, compose, restore, sync
from ..plans.introspect import check_schema, permission_sources, permissions_reaching, relation_dependencies, roles_reaching
from ..plans.parser import parse_expression, parse_schema
from ..plans.printer import expression_text
from ..refs import Grant, ObjectRef, SubjectRef
from ..sources.scratch import scratch_root
from ..sources.store import KEY, RegistryStore, TupleStore, migrate, target_column
from ..sources.versions import token, version_scope
from .world import World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(World(spark, sf_dir))
    QUERIES[f.__name__].__doc__ = f.__doc__
    return f


def documents(w: World, action: str, every: int = 50) -> DataFrame:
    out = w.engine().accessible(w.users(every), action, "docs/document")
    return out.select(F.col("subject_id").alias("user_id"), F.col("resource_id").cast("long").alias("doc_id"))


def accessible(name: str, action: str, every: int = 50) -> None:
    QUERIES[name] = lambda spark, sf_dir: documents(World(spark, sf_dir), action, every)


for _name, _action, _every in (
    ("accessible_direct", "owner", 50),
    ("accessible_group", "viewer", 50),
    ("accessible_union", "either", 50),
    ("accessible_intersection", "both", 50),
    ("accessible_exclusion", "others", 50),
    ("accessible_precedence", "order", 50),
    ("accessible_nil", "none", 50),
    ("accessible_subpermission", "sub", 50),
    ("accessible_arrow", "read", 50),
    ("accessible_mutual_recursion", "open", 50),
    ("accessible_expired", "preview", 1),
    ("accessible_pinned_id", "pinned", 50),
    ("accessible_builtin_intersection", "logged_viewer", 50),
):
    accessible(_name, _action, _every)


@query
def accessible_wildcard(w: World) -> DataFrame:
    """Documents that users may view as everyone or by name, groups aside."""
    d = w.schema.definition("docs/document")
    rel = replace(d.relation("viewer"), admits=tuple(a for a in d.relation("viewer").admits if not a.relation))
    schema = replace(w.schema, definitions=tuple(replace(x, relations=tuple(rel if r.name == "viewer" else r for r in x.relations)) if x.type == d.type else x for x in w.schema.definitions))
    out = w.engine()._copy(schema=schema).accessible(w.users(), "viewer", "docs/document")
    return out.select(F.col("subject_id").alias("user_id"), F.col("resource_id").cast("long").alias("doc_id"))


@query
def accessible_nested_group(w: World) -> DataFrame:
    """Groups that users are in, through groups in groups."""
    return w.engine().accessible(w.users(), "member", "auth/group").select(F.col("subject_id").alias("user_id"), F.col("resource_id").alias("group_id"))


def folders(w: World, every: int) -> DataFrame:
    return w.engine().accessible(w.users(every), "read", "docs/folder").select(F.col("subject_id").alias("user_id"), F.col("resource_id").cast("long").alias("folder_id"))


@query
def accessible_arrow_union_types(w: World) -> DataFrame:
    return folders(w, 50)


@query
def accessible_folder_tree(w: World) -> DataFrame:
    return folders(w, 10)


@query
def accessible_as_of(w: World) -> DataFrame:
    """What was granted by version 400."""
    out = w.engine().as_of(400).accessible(w.users(), "either", "docs/document")
    return out.select(F.col("subject_id").alias("user_id"), F.col("resource_id").cast("long").alias("doc_id"))


@query
def stale_rows_ignored(w: World) -> DataFrame:
    """Owners of all documents; every 97th also has a row which the schema does not admit."""
    return documents(w, "owner", 1)


@query
def field_backed_direct(w: World) -> DataFrame:
    """Orders that an account holds by a column."""
    accounts = w.table("customer").where("c_custkey % 50 = 0").select(F.lit("crm/account").alias("subject_type"), F.col("c_custkey").cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))
    return w.engine().accessible(accounts, "held", "sales/order").select(F.col("subject_id").alias("account_id"), F.col("resource_id").cast("long").alias("o_orderkey"))


@query
def field_backed_arrow(w: World) -> DataFrame:
    """Orders that region managers may read: order to account to nation to region."""
    managers = w.table("region").select(F.lit("auth/user").alias("subject_type"), F.col("r_regionkey").cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))
    d = w.schema.definition("sales/order")
    text = replace(d, permissions=tuple(replace(p, expr=p.expr.left) if p.name == "read" else p for p in d.permissions))
    schema = replace(w.schema, definitions=tuple(text if x.type == d.type else x for x in w.schema.definitions))
    out = w.engine()._copy(schema=schema).accessible(managers, "read", "sales/order")
    return out.select(F.col("subject_id").alias("user_id"), F.col("resource_id").cast("long").alias("o_orderkey"))


@query
def const_admin_arrow(w: World) -> DataFrame:
    """Orders of those whom the constant role gives all of them."""
    return w.engine().accessible(w.users(), "admin_only", "sales/order", native=True).select(F.col("subject_id").alias("user_id"), F.col("resource_id").alias("o_orderkey"))


@query
def const_direct(w: World) -> DataFrame:
    """The constant role itself holds every order; another does not."""
    return w.engine().accessible(["org/role:admin", "org/role:editor"], "admin", "sales/order").select(F.col("subject_id").alias("role_id"), F.col("resource_id").cast("long").alias("o_orderkey"))


@query
def grants_all_matrix(w: World) -> DataFrame:
    out = None
    for action in ("list", "read", "admin_only", "held"):
        part = w.engine().grants_all(w.users(), action, "sales/order").select(F.col("subject_id").alias("user_id"), F.lit(action).alias("action"), "grants_all")
        out = part if out is None else out.unionByName(part)
    return out


@query
def bulk_check_two_valued(w: World) -> DataFrame:
    """A check an event, undeclared actions included; review, which has a caveat, is never allowed without its parameter."""
    return w.engine().bulk_check(w.requests()).select("event_id", "action", "allowed")


def gated(w: World) -> DataFrame:
    """Requests by those who are gated viewers of a document."""
    return w.store.df.where("relation = 'gated_viewer'").select("subject_type", "subject_id", "subject_relation", "resource_type", "resource_id")


@query
def bulk_check_tristate(w: World) -> DataFrame:
    """careful = (owner + gated_viewer) - banned without the request's parameter: conditional unless owner or banned decide."""
    owners = w.store.df.where("resource_type = 'docs/document' and relation = 'owner' and subject_type = 'auth/user'").select("subject_type", "subject_id", "subject_relation", "resource_type", "resource_id")
    asked = gated(w).unionByName(owners).distinct().withColumn("action", F.lit("careful"))
    return w.engine().bulk_check(asked).select(F.col("resource_id").cast("long").alias("doc_id"), F.col("subject_id").alias("user_id"), "result")


@query
def check_missing_params(w: World) -> DataFrame:
    asked = gated(w).withColumn("action", F.lit("vetted"))
    return w.engine().bulk_check(asked).select(F.col("resource_id").cast("long").alias("doc_id"), F.col("subject_id").alias("user_id"), F.array_join("conditional_on", ",").alias("missing"))


@query
def caveat_context_override(w: World) -> DataFrame:
    """A request's parameter wins over the tuple's."""
    asked, engine = gated(w).withColumn("action", F.lit("vetted")), w.engine()
    static = engine.bulk_check(asked, {"required": 1}).select("resource_id", "subject_id", F.col("allowed").alias("static_allowed"))
    override = engine.bulk_check(asked, {"required": 1, "quality": 0}).select("resource_id", "subject_id", F.col("allowed").alias("override_allowed"))
    return static.join(override, ["resource_id", "subject_id"]).select(F.col("resource_id").cast("long").alias("doc_id"), F.col("subject_id").alias("user_id"), "static_allowed", "override_allowed")


@query
def kleene_truth_table(w: World) -> DataFrame:
    t = w.spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    return t.select("a", "b", or3(F.col("a"), F.col("b")).cast("int").alias("either"), and3(F.col("a"), F.col("b")).cast("int").alias("both"), minus3(F.col("a"), F.col("b")).cast("int").alias("but_not"))


@query
def model_level_check(w: World) -> DataFrame:
    """Whether any document at all would do."""
    actions = w.spark.createDataFrame([(a,) for a in ("write", "signed_in", "none", "vetted")], "action string")
    asked = w.users().crossJoin(actions).withColumns({"resource_type": F.lit("docs/document"), "resource_id": F.lit("")})
    return w.engine().bulk_check(asked).select(F.col("subject_id").alias("user_id"), "action", "allowed")


@query
def lookup_subjects_direct(w: World) -> DataFrame:
    some = w.table("documents").select(F.col("doc_id").cast("string").alias("resource_id"))
    return w.engine().lookup_direct(some, "read", "docs/document", "auth/user").select(F.col("resource_id").cast("long").alias("doc_id"), F.col("subject_id").alias("user_id"))


@query
def lookup_subjects_full(w: World) -> DataFrame:
    """Who may read each document, of the users whose key is divisible by 50."""
    some = w.table("documents").select(F.col("doc_id").cast("string").alias("resource_id"))
    return w.engine().lookup_full(some, "read", "docs/document", w.users()).select(F.col("resource_id").cast("long").alias("doc_id"), F.col("subject_id").alias("user_id"))


@query
def check_new_overlay(w: World) -> DataFrame:
    """Whether each user may create a document in each folder: all folders, the users whose key is divisible by 50."""
    folder = w.table("documents").select(F.col("doc_id").alias("folder_id")).where(F.col("folder_id") < w.n_folders())
    ident = F.col("folder_id").cast("string")
    proposals = folder.select(ident.alias("id"), F.lit("create").alias("action"), F.lit("docs/document").alias("resource_type"), "folder_id")
    edges = folder.select(ident.alias("id"), F.lit("folder").alias("relation"), F.lit("docs/folder").alias("subject_type"), ident.alias("subject_id"), F.lit("").alias("subject_relation"))
    return w.engine().check_new(proposals, edges, subjects=w.users()).select(F.col("subject_id").alias("user_id"), "folder_id", "allowed")


@query
def roles_of(w: World) -> DataFrame:
    return roles.roles_of(w.store, w.store.df).select("subject_type", "subject_id", "role_id")


@query
def members_of(w: World) -> DataFrame:
    return roles.members_of(w.store, ObjectRef("org/role", "admin"))


@query
def implies_of(w: World) -> DataFrame:
    return roles.implies_of(w.store, ObjectRef("org/role", "admin"))


@query
def implied_by_of(w: World) -> DataFrame:
    return roles.implied_by_of(w.store, ObjectRef("org/role", "editor"))


@query
def role_transitive(w: World) -> DataFrame:
    """Roles that users hold through roles that include roles."""
    return w.engine().accessible(w.users(1), "effective_member", "org/role").select(F.col("subject_id").alias("user_id"), F.col("resource_id").alias("role_id"))


@query
def roles_reaching_orders(w: World) -> DataFrame:
    return w.spark.createDataFrame([(r,) for r in sorted(roles_reaching(w.schema, "sales/order", "read", "org/role"))], "role_id string")


QUERIES["roles_reaching"] = QUERIES.pop("roles_reaching_orders")


def orders(w: World, user: str = "auth/user:2") -> SecuredFrame:
    return SecuredFrame.of(w.engine(), "sales/order").with_actor(user)


@query
def scoped_count(w: World) -> DataFrame:
    return orders(w).scoped().agg(F.count(F.lit(1)).alias("n"))


@query
def scoped_aggregate_by_status(w: World) -> DataFrame:
    return orders(w).group_by("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query
def scoped_exists_by_user(w: World) -> DataFrame:
    found = w.engine().reaching(w.users(), "read", "docs/document").select(F.col("subject_id").alias("user_id"), F.lit(True).alias("any_document"))
    return w.users().select(F.col("subject_id").alias("user_id")).join(found, "user_id", "left").select("user_id", F.coalesce("any_document", F.lit(False)).alias("any_document"))


def seven(w: World) -> SecuredFrame:
    return SecuredFrame.of(w.engine(), "docs/document").as_user(7)


@query
def redact_field(w: World) -> DataFrame:
    """A gated column is null where the actor may not read it."""
    return seven(w).redact("redact").to_df().select("doc_id", "text", "source")


@query
def omit_field(w: World) -> DataFrame:
    return seven(w).redact("omit").to_df().select("doc_id", F.array_join("_omitted", ",").alias("omitted"))


@query
def denied_fields(w: World) -> DataFrame:
    return seven(w).denied_fields()


@query
def bulk_guard_denied(w: World) -> DataFrame:
    """Rows that keep a bulk update from happening."""
    return seven(w).denied("write").select(F.col("id").cast("long").alias("doc_id"))


@query
def related_guard_denied(w: World) -> DataFrame:
    """Accounts that a join from orders would reach past their scope."""
    accounts = SecuredFrame.of(w.engine(), "crm/account").as_user(2)
    used = w.table("orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return accounts.denied("read", accounts.df.join(used, "c_custkey", "left_semi")).select(F.col("id").cast("long").alias("c_custkey"))


@query
def prefetch_scoped_counts(w: World) -> DataFrame:
    accounts = SecuredFrame.of(w.engine(), "crm/account").as_user(2)
    return accounts.prefetch(orders(w), "o_custkey", "orders").select("c_custkey", F.size("orders").cast("long").alias("n_orders"))


@query
def upsert_latest(w: World) -> DataFrame:
    """Writes over a third of the owner tuples."""
    batch = w.store.df.where("relation = 'owner' and version % 3 = 0 and subject_type = 'auth/user'")
    again = w.store.df.where("relation = 'owner' and version % 3 = 0 and subject_type <> 'auth/user'")
    base = w.store.high_watermark()
    batch = batch.withColumns({"version": F.col("version") + (1_000_000 - base - 1), "caveat_context": F.lit("{}")})
    new = w.store.write(w.schema, batch)[0].df
    # inadmissible rows cannot be written through the schema; their log entries are replayed as they are
    replay = again.withColumns({"version": F.col("version") + 1_000_000, "caveat_context": F.lit("{}")})
    out = new.join(replay.select(*KEY), list(KEY), "left_anti").unionByName(replay)
    return out.select(*KEY, "version", F.coalesce("caveat_context", F.lit("")).alias("caveat_context"))


@query
def delete_filter(w: World) -> DataFrame:
    return w.store.delete(w.schema, resource_type="docs/document", relation="viewer", subject_id="*").wire()


@query
def delete_exact(w: World) -> DataFrame:
    return w.store.delete_exact(w.store.df.where("relation = 'owner' and version % 4 = 0")).wire()


@query
def zookie_high_watermark(w: World) -> DataFrame:
    top = w.store.high_watermark()
    return w.spark.createDataFrame([(token(top), top)], "token string, version long")


@query
def registry_roundtrip(w: World) -> DataFrame:
    """Dictionary-encoded and back."""
    return TupleStore.decode(*w.store.encode()).wire()


@query
def cascade_delete(w: World) -> DataFrame:
    """Without the tuples of folders that are gone, at either end."""
    folders = w.store.df.where("resource_type = 'docs/folder'").select(F.col("resource_id").alias("id")).unionByName(w.store.df.where("subject_type = 'docs/folder'").select(F.col("subject_id").alias("id"))).distinct()
    gone = folders.where("cast(id as bigint) % 2 = 0").select(F.lit("docs/folder").alias("type"), "id")
    return w.store.cascade(gone).wire()


@query
def override_composed(w: World) -> DataFrame:
    """((owner + viewer) - banned) & folder->read, as three overrides of owner make it."""
    rows = [Override(3, "tighten", "docs/document", "read__text", "folder->read", "2024-01-03"), Override(1, "extend", "docs/document", "read__text", "viewer", "2024-01-01"), Override(2, "disable", "docs/document", "read__text", "banned", "2024-01-02")]
    out = w.engine()._copy(schema=compose(w.schema, rows)).accessible(w.users(), "read__text", "docs/document")
    return out.select(F.col("subject_id").alias("user_id"), F.col("resource_id").cast("long").alias("doc_id"))


@query
def permission_sources_of_read(w: World) -> DataFrame:
    return w.spark.createDataFrame([(s.kind, s.name, s.via) for s in permission_sources(w.schema, "docs/document", "read")], "kind string, name string, via string")


QUERIES["permission_sources"] = QUERIES.pop("permission_sources_of_read")


@query
def canonical_schema(w: World) -> DataFrame:
    want = {("docs/document", "read"), ("docs/document", "order"), ("sales/order", "read"), ("org/role", "effective_member")}
    rows = [(d.type, p.name, expression_text(p.expr)) for d in w.schema.definitions for p in d.permissions if (d.type, p.name) in want]
    return w.spark.createDataFrame(rows, "type string, permission string, expression string")


@query
def audit_targets(w: World) -> DataFrame:
    return w.store.df.select(target_column().alias("target"), "version")


@query
def order_by_resource_wire(w: World) -> DataFrame:
    return TupleStore(w.store.df.where("resource_type = 'docs/folder'")).by_resource().select(*KEY)


@query
def resolve_subjects(w: World) -> DataFrame:
    refs = w.store.df.where("resource_type = 'docs/folder'").select("subject_type", "subject_id")
    return w.universe.resolve(refs, ["auth/user"]).select("subject_id", "c_name")


@query
def module_probe(w: World) -> DataFrame:
    return has_any_tuple(w.engine(), w.users(), ["docs/folder"]).select(F.col("subject_id").alias("user_id"), "has_any")


def asked(w: World, actions: dict[str, str], label: str) -> DataFrame:
    """A request for each user whose key is divisible by 50, each of their documents by owner, viewer or ban, and each action."""
    near = w.store.df.where("resource_type = 'docs/document' and subject_type = 'auth/user' and subject_id <> '*' and relation in ('owner', 'viewer', 'banned')")
    pairs = near.join(w.users(), SUBJECT, "left_semi").select(*SUBJECT, "resource_type", "resource_id").distinct()
    return pairs.withColumn("_a", F.explode(F.array(*[F.struct(F.lit(k).alias(label), F.lit(v).alias("action")) for k, v in actions.items()]))).select(*pairs.columns, f"_a.{label}", "_a.action")


@query
def all_of_check(w: World) -> DataFrame:
    """Requests that need both read and write."""
    both = asked(w, {"read": "read", "write": "write"}, "name").withColumn("request_id", F.concat_ws("/", "subject_id", "resource_id"))
    return has_perms(w.engine(), both).select(F.split_part("request_id", F.lit("/"), F.lit(1)).alias("user_id"), F.split_part("request_id", F.lit("/"), F.lit(2)).cast("long").alias("doc_id"), "allowed")


@query
def codename_check(w: World) -> DataFrame:
    """Codenames of a framework: an unknown verb defers, an inactive user is refused. Odd documents are asked for by inactive users."""
    some = asked(w, {n: "" for n in ("view_document", "docs.change_document", "delete_document", "audit_document")}, "codename").drop("action")
    some = some.withColumns({"is_active": F.col("resource_id").cast("long") % 2 == 0, "is_superuser": F.lit(False)})
    return has_codenames(w.engine(), some).select(F.col("subject_id").alias("user_id"), F.col("resource_id").cast("long").alias("doc_id"), "codename", "allowed", "defers")


# -- single checks, writes and what the schema says


@query
def check_one(w: World) -> DataFrame:
    """One request after the other, as a caller with few would ask."""
    engine, rows = w.engine(), []
    for subject in ("auth/user:0", "auth/user:7", "auth/anonymous:*"):
        for action, resource in (("read", "docs/folder:0"), ("write", "docs/document:0"), ("write", "docs/document:1"), ("signed_in", "docs/document:1"), ("public", "docs/document:1")):
            rows.append((subject, action, resource, engine.check(subject, action, resource)["allowed"]))
    return w.spark.createDataFrame(rows, "subject string, action string, resource string, allowed boolean")


@query
def check_at_token(w: World) -> DataFrame:
    """Every owner's check at the version at which half of the owner tuples were there."""
    owners = w.store.df.where("resource_type = 'docs/document' and relation = 'owner' and subject_type = 'auth/user'")
    half = w.table("documents").count() // 2
    some = owners.select(*SUBJECT, F.lit("owner").alias("action"), "resource_type", "resource_id")
    return w.engine().bulk_check(some, token=token(half), consistency="at_exact_snapshot").select(F.col("resource_id").cast("long").alias("doc_id"), F.col("subject_id").alias("user_id"), "allowed")


@query
def bulk_check_row_context(w: World) -> DataFrame:
    """Gated viewers, each request with a context of its own."""
    some = gated(w).withColumn("action", F.lit("vetted")).withColumn("n", F.col("resource_id").cast("long") % 3)
    some = some.withColumn("context", F.when(F.col("n") == 0, '{"required": 0}').when(F.col("n") == 1, '{"required": 1}'))
    return w.engine().bulk_check(some, context_column="context").select(F.col("resource_id").cast("long").alias("doc_id"), F.col("subject_id").alias("user_id"), "result")


@query
def caveat_string_ops(w: World) -> DataFrame:
    """Expressions over text, whole numbers and lists: a rule over every document's columns."""
    rules = {"size": ("size(lang) == 2 && size(source) > 4", (("lang", "string"), ("source", "string"))), "joined": ('lang + ":" + source == "en:src1"', (("lang", "string"), ("source", "string"))), "halves": ("n / 2 * 2 == n && n % 4 != 0", (("n", "int"),)), "listed": ('lang in ["de", "fr"] && !source.startsWith("src1")', (("lang", "string"), ("source", "string")))}
    docs = w.table("documents")
    context = F.to_json(F.struct("lang", "source", F.col("doc_id").alias("n")))
    return docs.select("doc_id", *[(cel.verdict(Caveat(name, params, body), context, {})[0] == 2).alias(name) for name, (body, params) in rules.items()])


@query
def save_keeps_redacted(w: World) -> DataFrame:
    """What user 7 writes back after reading with redaction and marking every row: viewers may write here, but not read the text, which stays."""
    engine = w.engine()._copy(schema=compose(w.schema, [Override(1, "extend", "docs/document", "write", "viewer", "2024-01-01"), Override(2, "disable", "docs/document", "write", "banned", "2024-01-01")]))
    frame = SecuredFrame.of(engine, "docs/document", w.table("documents").withColumnRenamed("source", "origin")).as_user(7).redact("redact")
    mine = replace(frame, df=frame.df.join(frame.allowed_ids("write"), F.col("doc_id").cast("string") == F.col("_rid"), "left_semi"))
    return mine.save(mine.to_df().withColumn("origin", F.concat("origin", F.lit("!")))).select("doc_id", "text", "origin")


@query
def guarded_update(w: World) -> DataFrame:
    """User 7 marks the documents that they may write; asking for more fails."""
    frame = seven(w)
    mine = SecuredFrame.of(frame.engine, frame.type, frame.df.join(frame.allowed_ids("write"), F.col("doc_id").cast("string") == F.col("_rid"), "left_semi")).as_user(7)
    return mine.update({"source": F.lit("marked")}).select("doc_id", "source")


@query
def guarded_delete(w: World) -> DataFrame:
    """Accounts without those of region 2 that its manager may delete; the permission to read stands for that to delete."""
    d = w.schema.definition("crm/account")
    gone = Permission("delete", d.permission("read").expr)
    schema = replace(w.schema, definitions=tuple(replace(x, permissions=(*x.permissions, gone)) if x.type == d.type else x for x in w.schema.definitions))
    frame = SecuredFrame.of(w.engine()._copy(schema=schema), "crm/account").as_user(2)
    mine = SecuredFrame.of(frame.engine, frame.type, frame.scoped()).as_user(2)
    return mine.delete(frame.df).select("c_custkey")


@query
def conditional_gate(w: World) -> DataFrame:
    """A gate that depends on a parameter which nobody gave: hidden, unless the configuration shows what is conditional."""
    d = w.schema.definition("docs/document")
    gate = Permission("read__lang", parse_expression("gated_viewer"))
    schema = replace(w.schema, definitions=tuple(replace(x, permissions=(*x.permissions, gate)) if x.type == d.type else x for x in w.schema.definitions))
    out = None
    for shown in (False, True):
        engine = w.engine(conditional_visible=shown)._copy(schema=schema)
        part = SecuredFrame.of(engine, "docs/document").as_user(17).redact("redact").to_df().select("doc_id", F.lit(shown).alias("shown"), F.col("lang").isNotNull().alias("visible"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def write_rejected(w: World) -> DataFrame:
    """Tuples that the schema does not admit, or that a column or constant stands for, fail the whole batch."""
    bad = {"group as owner": "docs/document:0#owner @ auth/group:nation-0#member", "column": "sales/order:1#account @ crm/account:1", "constant": "sales/order:1#admin @ org/role:admin", "unknown": "docs/document:0#nothing @ auth/user:1", "wildcard": "docs/folder:0#owner @ auth/user:*"}
    rows = []
    for name, text in {**bad, "fine": "docs/document:0#owner @ auth/user:1"}.items():
        left, _, right = text.partition(" @ ")
        resource, _, relation = left.partition("#")
        try:
            w.store.write(w.schema, [Grant(ObjectRef.parse(resource), relation, SubjectRef.parse(right))])
            rows.append((name, True))
        except SchemaError:
            rows.append((name, False))
    return w.spark.createDataFrame(rows, "name string, written boolean")


@query
def grant_and_revoke_roles(w: World) -> DataFrame:
    """Role edges after granting, implying, revoking and unimplying."""
    role = lambda name: ObjectRef("org/role", name)
    store = roles.grant_role(w.store, w.schema, role("viewer"), SubjectRef("auth/user", "9"))
    store = roles.imply(store, w.schema, role("viewer"), role("guest"))
    store = roles.revoke_role(store, role("editor"), SubjectRef("auth/user", "3"))
    store = roles.unimply(store, role("admin"), role("editor"))
    return TupleStore(store.df.where("resource_type = 'org/role'")).wire()


@query
def audit_grant_revoke(w: World) -> DataFrame:
    """The trail of two writes over the store."""
    trail = Trail(w.spark, f"{scratch_root(w.spark)}/trail-{uuid.uuid4().hex}", ("auth/user", "root"), "tidy", "2024-01-31 00:00:00")
    store = w.store.audited(trail)
    store.delete(resource_type="docs/document", relation="viewer", subject_id="*").write(w.schema, [Grant(ObjectRef("docs/folder", "0"), "owner", SubjectRef("auth/user", "5"))])
    return trail.read().select("kind", "actor_id", "target", "reason", F.get_json_object(F.coalesce("before", "after"), "$.relation").alias("relation"))


def from_rows(w: World, rows: list[tuple], schema: str) -> DataFrame:
    return w.spark.createDataFrame(rows, schema)


@query
def relation_dependencies_of_all(w: World) -> DataFrame:
    """Which relations each permission of documents reads."""
    d = w.schema.definition("docs/document")
    return from_rows(w, [(p.name, r) for p in d.permissions for r in sorted(relation_dependencies(w.schema, d.type, p.name))], "permission string, relation string")


@query
def permissions_reaching_of_all(w: World) -> DataFrame:
    """Which permissions of documents each relation bears on."""
    d = w.schema.definition("docs/document")
    return from_rows(w, [(r.name, p) for r in d.relations for p in sorted(permissions_reaching(w.schema, d.type, r.name))], "relation string, permission string")


@query
def schema_lints(w: World) -> DataFrame:
    """What the lints find in schemas with one fault each."""
    faults = {
        "fine": "definition a/x { relation r: a/x\n permission p = r }",
        "cycle": "definition a/x { permission p = q\n permission q = p }",
        "constant cycle": "definition a/x { relation r: a/x // backing:const=one\n permission p = r->p }",
        "constant target": "definition a/x { relation r: b/y // backing:const=one\n permission p = nil }",
        "unknown name": "definition a/x { permission p = nothing }",
    }
    return from_rows(w, [(n, bool(check_schema(t))) for n, t in faults.items()], "name string, found boolean")


@query
def recaveat_override(w: World) -> DataFrame:
    """Gated viewers under a stricter rule that an override puts in the caveat's place."""
    schema = compose(w.schema, [Override(1, "recaveat", "", "min_quality", "quality > required", "2024-01-01")])
    some = gated(w).withColumn("action", F.lit("vetted"))
    out = w.engine()._copy(schema=schema).bulk_check(some, {"required": 0})
    return out.select(F.col("resource_id").cast("long").alias("doc_id"), F.col("subject_id").alias("user_id"), "allowed")


@query
def registry_scans(w: World) -> DataFrame:
    """Tuples of a few objects by either end, over the dictionary-encoded store as files."""
    path = f"{scratch_root(w.spark)}/registry-{uuid.uuid4().hex}"
    RegistryStore.of(w.store).save(path)
    store = RegistryStore.load(w.spark, path)
    found = [store.for_resource("docs/document", "0"), store.for_subject("auth/group", "nation-0", "member"), store.for_subject("org/role", "admin")]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select(*KEY).distinct()


@query
def storage_migrated(w: World) -> DataFrame:
    """From the plain form to the dictionary-encoded one and back, as files."""
    base = f"{scratch_root(w.spark)}/migrate-{uuid.uuid4().hex}"
    w.store.save(f"{base}/plain")
    there = migrate(w.spark, f"{base}/plain", f"{base}/coded", "registry")
    back = migrate(w.spark, f"{base}/coded", f"{base}/back", "denormalized")
    return from_rows(w, [("registry", there["read"], there["written"]), ("denormalized", back["read"], back["written"])], "to string, n_read long, n_written long")


@query
def schema_from_catalog(w: World) -> DataFrame:
    """Documents that users own or view by a schema that was synchronised into catalog rows and read back."""
    rows, _ = sync([], "catalog", w.schema)
    out = w.engine()._copy(schema=restore(rows)).accessible(w.users(), "either", "docs/document")
    return out.select(F.col("subject_id").alias("user_id"), F.col("resource_id").cast("long").alias("doc_id"))


@query
def schema_synchronised(w: World) -> DataFrame:
    """What synchronising does to rows that are new, unchanged, changed in the package, edited, held or gone."""
    old = [f"permission {n} = r" for n in ("same", "changed", "edited", "held", "gone")]
    rows, _ = sync([], "p", parse_schema("definition a/x { relation r: a/x\n" + "\n".join(old) + "}"))
    rows = [replace(x, payload='{"expression": "nil"}') if x.external_id.endswith("#edited") else replace(x, no_update=x.external_id.endswith("#held")) for x in rows]
    new = "permission same = r\npermission changed = nil\npermission edited = r + r\npermission held = nil\npermission added = r"
    _, did = sync(rows, "p", parse_schema(f"definition a/x {{ relation r: a/x\n{new} }}"))
    return from_rows(w, sorted(did.items()), "external_id string, done string")


@query
def explained(w: World) -> DataFrame:
    """The algebra of every permission of documents."""
    d = w.schema.definition("docs/document")
    return from_rows(w, [(p.name, w.engine().explain(d.type, p.name).split(" = ", 1)[1]) for p in d.permissions if p.name in ("either", "both", "others", "none", "sub", "preview")], "permission string, algebra string")


@query
def tool_calls(w: World) -> DataFrame:
    """Which calls of tools get through, for a user and nobody."""
    engine, rows = w.engine(), []
    calls = {
        "read folder 0": (tool(engine, "docs/folder", "read", id_argument="at")(lambda at=None: None), {"at": 0}),
        "write document 1": (tool(engine, "docs/document", "write", id_argument="at")(lambda at=None: None), {"at": 1}),
        "write a fixed one": (tool(engine, "docs/document", "write", resource_id="0")(lambda at=None: None), {}),
        "write the only one": (tool(engine, "docs/document", "write")(lambda: None), {}),
        "create in folder 0": (tool(engine, "docs/document", "create", relations={"folder": "at"})(lambda at=None: None), {"at": "docs/folder:0"}),
        "create nowhere": (tool(engine, "docs/document", "create", relations={"folder": "at"})(lambda at=None: None), {}),
    }
    for who in ("0", None):
        for name, (call, how) in calls.items():
            try:
                with acting(f"auth/user:{who}") if who else nullcontext():
                    call(**how)
                rows.append((who or "nobody", name, True))
            except PermissionDenied:
                rows.append((who or "nobody", name, False))
    return from_rows(w, rows, "who string, call string, allowed boolean")


@query
def ambient_actor(w: World) -> DataFrame:
    """How many orders a frame without an actor shows to an ambient manager of region 2, under a bypass, and to a frame's own actor."""
    frame, rows = SecuredFrame.of(w.engine(), "sales/order"), []
    with acting("auth/user:2"):
        rows.append(("ambient", frame.count()))
        with bypassing(frame.engine, "count"):
            rows.append(("bypass", frame.count()))
            rows.append(("own", frame.as_user(3).count()))
    return from_rows(w, rows, "way string, n long")


@query
def read_your_writes(w: World) -> DataFrame:
    """A folder's new owner, seen by engines over the store before and after the write."""
    rows = []
    with version_scope():
        later, _ = w.store.write(w.schema, [Grant(ObjectRef("docs/folder", "1"), "owner", SubjectRef("auth/user", "6"))])
        for name, store in (("after", later), ("before", w.store)):
            try:
                rows.append((name, w.engine()._copy(store=store).has_access("auth/user:6", "read", "docs/folder:1")))
            except StoreBehind:
                rows.append((name, None))
    return from_rows(w, rows, "store string, allowed boolean")


@query
def instance_checks(w: World) -> DataFrame:
    """Single documents as user 7 meets them."""
    frame, rows = seven(w).redact("redact"), []
    for i in (0, 1, 2, 3):
        one = frame.instance(i)
        row = one.get()
        rows.append((i, row is not None, bool(row is not None and row.text is not None), one.has_access("write")))
    return from_rows(w, rows, "doc_id long, seen boolean, text_seen boolean, writes boolean")


@query
def universal_admin_lint(w: World) -> DataFrame:
    """Role types that do not admit the universal admin's members."""
    text = "definition a/user {}\n" + "\n".join(f"definition {t}/role {{ relation member: a/user{more} }}" for t, more in (("root", ""), ("good", " | root/role:admin#member"), ("bad", " | root/role:other#member"), ("none", "")))
    found = " ".join(check_schema(text, Config(universal_admin="root/role:admin")))
    return from_rows(w, [(t, f"{t}/role#member" in found) for t in ("root", "good", "bad", "none")], "type string, found boolean")
