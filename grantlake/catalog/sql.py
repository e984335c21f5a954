"""The same answers in DuckDB's SQL: plain joins and recursive queries over the derived graph."""

from __future__ import annotations

from .world import ACTIONS, NOW, edges_sql

ND = "(SELECT count(*) FROM documents)"
INADMISSIBLE = "(resource_type = 'docs/document' AND (relation = 'owner' AND subject_type = 'auth/group' OR relation = 'folder' AND subject_type = 'auth/user' OR relation = 'pinned' AND subject_id <> 'region-0'))"


def world(every: int = 50, who: str | None = None, until: str = "") -> str:
    """Common tables: t all tuples, a admitted and live ones, me the subjects, mem(g, u) group membership,
    dr(rt, rid, rel, u) what users hold by relation (wildcards and groups resolved), fread(f, u) readable folders, dread(d, u) readable documents."""
    me = who or f"SELECT CAST(c_custkey AS VARCHAR) AS u FROM customer WHERE c_custkey % {every} = 0"
    return f"""WITH RECURSIVE t AS (SELECT * FROM ({edges_sql(True)})),
a AS (SELECT * FROM t WHERE NOT {INADMISSIBLE} AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'){until}),
me AS ({me}),
mem AS (SELECT a.resource_id AS g, me.u AS u FROM a JOIN me ON a.subject_id = me.u WHERE a.resource_type = 'auth/group' AND a.subject_type = 'auth/user'
  UNION SELECT a.resource_id, mem.u FROM a JOIN mem ON a.resource_type = 'auth/group' AND a.subject_type = 'auth/group' AND a.subject_id = mem.g),
dr AS (SELECT resource_type AS rt, resource_id AS rid, relation AS rel, me.u AS u FROM a JOIN me ON subject_type = 'auth/user' AND subject_id = me.u WHERE caveat_name = ''
  UNION SELECT resource_type, resource_id, relation, me.u FROM a, me WHERE subject_type = 'auth/user' AND subject_id = '*'
  UNION SELECT resource_type, resource_id, relation, mem.u FROM a JOIN mem ON subject_type = 'auth/group' AND subject_relation = 'member' AND subject_id = mem.g),
par AS (SELECT resource_id AS f, subject_id AS p FROM a WHERE resource_type = 'docs/folder' AND relation = 'parent'),
fread AS (SELECT rid AS f, u FROM dr WHERE rt = 'docs/folder' AND rel IN ('owner', 'viewer')
  UNION SELECT par.f, fread.u FROM par JOIN fread ON par.p = fread.f),
fol AS (SELECT resource_id AS d, subject_id AS f FROM a WHERE resource_type = 'docs/document' AND relation = 'folder'),
doc AS (SELECT rid AS d, rel, u FROM dr WHERE rt = 'docs/document'),
banned AS (SELECT d, u FROM doc WHERE rel = 'banned'),
dread AS (SELECT d, u FROM (SELECT d, u FROM doc WHERE rel IN ('owner', 'viewer') UNION SELECT fol.d, fread.u FROM fol JOIN fread ON fol.f = fread.f) WHERE (d, u) NOT IN (SELECT (d, u) FROM banned)),
gate AS (SELECT a.resource_id AS d, me.u AS u, CAST(json_extract(caveat_context, '$.quality') AS INTEGER) AS quality FROM a JOIN me ON a.subject_id = me.u WHERE relation = 'gated_viewer')
"""


def held(*relations: str) -> str:
    return f"SELECT d, u FROM doc WHERE rel IN ({', '.join(repr(r) for r in relations)})"


def docs(body: str, **how) -> str:
    """Answers of `accessible` on documents: user_id, doc_id."""
    return world(**how) + f"SELECT u AS user_id, CAST(d AS BIGINT) AS doc_id FROM ({body}) GROUP BY ALL"


ROLE = """, rmem AS (SELECT rid AS r, u FROM dr WHERE rt = 'org/role' AND rel = 'member'
  UNION SELECT a.resource_id, rmem.u FROM a JOIN rmem ON a.resource_type = 'org/role' AND a.relation = 'includes' AND a.subject_id = rmem.r)
"""
OREAD = "SELECT CAST(o_orderkey AS VARCHAR) AS o, u FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN dr ON rt = 'geo/region' AND rel = 'manager' AND rid = CAST(n_regionkey AS VARCHAR)"
ADMINS = "SELECT u FROM dr WHERE rt = 'org/role' AND rel = 'member' AND rid = 'admin'"
ASK = f"ask AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, {ACTIONS} AS action, CAST(event_id % {ND} AS VARCHAR) AS d FROM events)"
ASKERS = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events"
KEYS = "resource_type, resource_id, relation, subject_type, subject_id, subject_relation, caveat_name"
TARGET = "concat(resource_type, ':', resource_id, '#', relation, ' @ ', subject_type, ':', subject_id, CASE WHEN subject_relation <> '' THEN concat('#', subject_relation) ELSE '' END, CASE WHEN caveat_name <> '' THEN concat(' with ', caveat_name) ELSE '' END)"

NEAR = f", wr AS (({held('owner')}) EXCEPT SELECT d, u FROM banned), near AS (SELECT DISTINCT resource_id AS d, me.u AS u FROM t JOIN me ON subject_id = me.u WHERE resource_type = 'docs/document' AND subject_type = 'auth/user' AND relation IN ('owner', 'viewer', 'banned'))"
#: The relations that each permission of documents names, itself or through the permissions that it names.
DEPENDS = "SELECT permission, unnest(string_split(relations, ' ')) AS relation FROM (VALUES ('read', 'owner viewer folder banned'), ('write', 'owner banned'), ('review', 'viewer gated_viewer'), ('vetted', 'gated_viewer'), ('careful', 'owner gated_viewer banned'), ('preview', 'temp_viewer'), ('read__text', 'owner'), ('write__text', 'owner banned'), ('both', 'owner viewer'), ('either', 'owner viewer'), ('others', 'viewer owner'), ('order', 'owner viewer folder banned'), ('sub', 'owner banned temp_viewer'), ('logged_viewer', 'viewer'), ('open', 'owner folder'), ('create', 'folder')) AS v(permission, relations)"

SQL: dict[str, str] = {
    "accessible_direct": docs(held("owner")),
    "accessible_wildcard": world() + "SELECT me.u AS user_id, CAST(resource_id AS BIGINT) AS doc_id FROM a, me WHERE relation = 'viewer' AND (subject_id = '*' OR subject_type = 'auth/user' AND subject_id = me.u) AND resource_type = 'docs/document' GROUP BY ALL",
    "accessible_group": docs(held("viewer")),
    "accessible_nested_group": world() + "SELECT u AS user_id, g AS group_id FROM mem",
    "accessible_union": docs(held("owner", "viewer")),
    "accessible_intersection": docs(f"{held('owner')} INTERSECT {held('viewer')}"),
    "accessible_exclusion": docs(f"{held('viewer')} EXCEPT {held('owner')}"),
    "accessible_precedence": docs(f"(({held('owner', 'viewer')}) INTERSECT (SELECT fol.d, fread.u FROM fol JOIN fread ON fol.f = fread.f)) EXCEPT SELECT d, u FROM banned"),
    "accessible_nil": docs(f"{held('owner')} LIMIT 0"),
    "accessible_subpermission": docs(f"({held('owner')} EXCEPT SELECT d, u FROM banned) UNION {held('temp_viewer')}"),
    "accessible_arrow": docs("SELECT d, u FROM dread"),
    "accessible_arrow_union_types": world() + "SELECT u AS user_id, CAST(f AS BIGINT) AS folder_id FROM fread",
    "accessible_folder_tree": world(every=10) + "SELECT u AS user_id, CAST(f AS BIGINT) AS folder_id FROM fread",
    "accessible_mutual_recursion": world()
    + ", st AS (SELECT resource_id AS f, subject_id AS d FROM a WHERE relation = 'starred'), op AS (SELECT rt AS k, rid AS x, u FROM dr WHERE rel = 'owner' AND rt IN ('docs/folder', 'docs/document') UNION SELECT CASE WHEN e.k = 'docs/folder' THEN 'docs/document' ELSE 'docs/folder' END, e.x, op.u FROM (SELECT 'docs/folder' AS k, f AS y, d AS x FROM fol UNION ALL SELECT 'docs/document', d, f FROM st) AS e JOIN op ON op.k = e.k AND op.x = e.y) SELECT u AS user_id, CAST(x AS BIGINT) AS doc_id FROM op WHERE k = 'docs/document'",
    "accessible_expired": docs(held("temp_viewer"), every=1),
    "accessible_as_of": docs(held("owner", "viewer"), until=" AND version <= 400"),
    "accessible_pinned_id": docs(held("pinned")),
    "accessible_builtin_intersection": docs(held("viewer")),
    "stale_rows_ignored": docs(held("owner"), every=1),
    "field_backed_direct": "SELECT CAST(o_custkey AS VARCHAR) AS account_id, o_orderkey FROM orders WHERE o_custkey % 50 = 0",
    "field_backed_arrow": world(who="SELECT CAST(r_regionkey AS VARCHAR) AS u FROM region") + f", oread AS ({OREAD}) SELECT u AS user_id, CAST(o AS BIGINT) AS o_orderkey FROM oread",
    "const_admin_arrow": world() + f"SELECT u AS user_id, o_orderkey FROM orders, ({ADMINS})",
    "const_direct": "SELECT 'admin' AS role_id, o_orderkey FROM orders",
    "grants_all_matrix": world() + f"SELECT me.u AS user_id, action, CASE WHEN action = 'list' THEN true WHEN action IN ('read', 'admin_only') THEN me.u IN ({ADMINS}) ELSE false END AS grants_all FROM me, (SELECT unnest(['list', 'read', 'admin_only', 'held']) AS action)",
    "bulk_check_two_valued": world(who=ASKERS) + f", {ASK} SELECT event_id, action, CASE action WHEN 'read' THEN (d, ask.u) IN (SELECT (d, u) FROM dread) WHEN 'write' THEN (d, ask.u) IN (SELECT (d, u) FROM (({held('owner')}) EXCEPT SELECT d, u FROM banned)) ELSE false END AS allowed FROM ask",
    "bulk_check_tristate": world(every=1) + ", pairs AS (SELECT d, u FROM gate UNION SELECT d, u FROM doc WHERE rel = 'owner') SELECT CAST(d AS BIGINT) AS doc_id, u AS user_id, CASE WHEN (d, u) IN (SELECT (d, u) FROM doc WHERE rel = 'owner') THEN CASE WHEN (d, u) IN (SELECT (d, u) FROM banned) THEN 'NO_PERMISSION' ELSE 'HAS_PERMISSION' END WHEN (d, u) IN (SELECT (d, u) FROM banned) THEN 'NO_PERMISSION' ELSE 'CONDITIONAL_PERMISSION' END AS result FROM pairs",
    "check_missing_params": world(every=1) + "SELECT CAST(d AS BIGINT) AS doc_id, u AS user_id, 'required' AS missing FROM gate",
    "caveat_context_override": world(every=1) + "SELECT CAST(d AS BIGINT) AS doc_id, u AS user_id, quality >= 1 AS static_allowed, 0 >= 1 AS override_allowed FROM gate",
    "kleene_truth_table": "SELECT a, b, greatest(a, b) AS either, least(a, b) AS both, CASE WHEN a = 0 OR b = 2 THEN 0 WHEN a = 2 AND b = 0 THEN 2 ELSE 1 END AS but_not FROM (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b)",
    "model_level_check": world() + f"SELECT me.u AS user_id, action, CASE action WHEN 'write' THEN me.u IN (SELECT u FROM (({held('owner')}) EXCEPT SELECT d, u FROM banned)) WHEN 'signed_in' THEN true ELSE false END AS allowed FROM me, (SELECT unnest(['write', 'signed_in', 'none', 'vetted']) AS action)",
    "lookup_subjects_direct": world() + "SELECT CAST(resource_id AS BIGINT) AS doc_id, subject_id AS user_id FROM t WHERE resource_type = 'docs/document' AND relation IN ('owner', 'viewer', 'banned') AND subject_type = 'auth/user' GROUP BY ALL",
    "lookup_subjects_full": world() + "SELECT CAST(d AS BIGINT) AS doc_id, u AS user_id FROM dread",
    "check_new_overlay": world() + f"SELECT me.u AS user_id, f AS folder_id, (CAST(f AS VARCHAR), me.u) IN (SELECT (f, u) FROM fread) AS allowed FROM me, (SELECT doc_id AS f FROM documents WHERE doc_id < greatest(1, {ND} // 10))",
    "roles_of": world() + "SELECT subject_type, subject_id, resource_id AS role_id FROM t WHERE resource_type LIKE '%/role' AND relation = 'member'",
    "members_of": world() + "SELECT subject_type, subject_id, subject_relation FROM t WHERE resource_type = 'org/role' AND resource_id = 'admin' AND relation = 'member'",
    "implies_of": world() + "SELECT DISTINCT resource_type AS role_type, resource_id AS role_id FROM t WHERE resource_type LIKE '%/role' AND relation = 'includes' AND subject_type = 'org/role' AND subject_id = 'admin' AND subject_relation = 'effective_member'",
    "implied_by_of": world() + "SELECT DISTINCT subject_type AS role_type, subject_id AS role_id FROM t WHERE resource_type = 'org/role' AND resource_id = 'editor' AND relation = 'includes' AND subject_relation = 'effective_member'",
    "role_transitive": world(every=1) + ROLE + "SELECT u AS user_id, r AS role_id FROM rmem",
    "roles_reaching": "SELECT 'admin' AS role_id",
    "scoped_count": world(who="SELECT '2' AS u") + f", oread AS ({OREAD}) SELECT count(DISTINCT o) AS n FROM oread",
    "scoped_aggregate_by_status": world(who="SELECT '2' AS u") + f", oread AS ({OREAD}) SELECT o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT o FROM oread) GROUP BY 1",
    "scoped_exists_by_user": world() + "SELECT me.u AS user_id, me.u IN (SELECT u FROM dread) AS any_document FROM me",
    "redact_field": world(who="SELECT '7' AS u") + f"SELECT doc_id, CASE WHEN (CAST(doc_id AS VARCHAR), '7') IN ({held('owner').replace('SELECT d, u', 'SELECT (d, u)')}) THEN text END AS text, source FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT d FROM dread)",
    "omit_field": world(who="SELECT '7' AS u") + f"SELECT doc_id, CASE WHEN (CAST(doc_id AS VARCHAR), '7') IN ({held('owner').replace('SELECT d, u', 'SELECT (d, u)')}) THEN '' ELSE 'text' END AS omitted FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT d FROM dread)",
    "denied_fields": world(who="SELECT '7' AS u") + "SELECT CAST(d AS BIGINT) AS doc_id, 'text' AS field FROM (SELECT d FROM dread EXCEPT SELECT d FROM doc WHERE rel = 'owner')",
    "bulk_guard_denied": world(who="SELECT '7' AS u") + f"SELECT doc_id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT d FROM (({held('owner')}) EXCEPT SELECT d, u FROM banned))",
    "related_guard_denied": world(who="SELECT '2' AS u") + "SELECT DISTINCT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2",
    "prefetch_scoped_counts": world(who="SELECT '2' AS u") + f", oread AS ({OREAD}) SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderkey AS VARCHAR) IN (SELECT o FROM oread)) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
    "upsert_latest": world() + f", log AS (SELECT {KEYS}, version, caveat_context FROM t UNION ALL SELECT {KEYS}, 1000000 + version, '{{}}' FROM t WHERE relation = 'owner' AND version % 3 = 0) SELECT {KEYS}, max(version) AS version, arg_max(coalesce(caveat_context, ''), version) AS caveat_context FROM log GROUP BY ALL",
    "delete_filter": world() + f"SELECT {KEYS} FROM t WHERE NOT (resource_type = 'docs/document' AND relation = 'viewer' AND subject_id = '*')",
    "delete_exact": world() + f"SELECT {KEYS} FROM t WHERE NOT (relation = 'owner' AND version % 4 = 0)",
    "zookie_high_watermark": world() + "SELECT concat('lake.', CAST(max(version) AS VARCHAR)) AS token, max(version) AS version FROM t",
    "registry_roundtrip": world() + f"SELECT {KEYS} FROM t",
    "cascade_delete": world() + f"SELECT {KEYS} FROM t WHERE NOT (resource_type = 'docs/folder' AND CAST(CASE WHEN resource_type = 'docs/folder' THEN resource_id ELSE '1' END AS BIGINT) % 2 = 0) AND NOT (subject_type = 'docs/folder' AND CAST(CASE WHEN subject_type = 'docs/folder' THEN subject_id ELSE '1' END AS BIGINT) % 2 = 0)",
    "override_composed": docs(f"(({held('owner')}) UNION ({held('viewer')}) EXCEPT SELECT d, u FROM banned) INTERSECT (SELECT fol.d, fread.u FROM fol JOIN fread ON fol.f = fread.f)"),
    "permission_sources": "SELECT * FROM (VALUES ('relation', 'owner', ''), ('relation', 'viewer', ''), ('arrow', 'read', 'folder'), ('relation', 'banned', '')) AS v(kind, name, via)",
    "canonical_schema": "SELECT * FROM (VALUES ('docs/document', 'read', '(((owner + viewer) + folder->read) - banned)'), ('docs/document', 'order', '(((owner + viewer) & folder->read) - banned)'), ('sales/order', 'read', '(account->read + admin->member)'), ('org/role', 'effective_member', '(member + includes)')) AS v(type, permission, expression)",
    "audit_targets": world() + f"SELECT {TARGET} AS target, version FROM t",
    "order_by_resource_wire": world() + f"SELECT {KEYS} FROM t WHERE resource_type = 'docs/folder'",
    "resolve_subjects": world() + "SELECT DISTINCT subject_id, c_name FROM t JOIN customer ON subject_type = 'auth/user' AND subject_id = CAST(c_custkey AS VARCHAR) WHERE resource_type = 'docs/folder'",
    "module_probe": world() + "SELECT u AS user_id, u IN (SELECT subject_id FROM t WHERE resource_type = 'docs/folder' AND subject_type = 'auth/user') AS has_any FROM me",
    "all_of_check": world() + f"{NEAR} SELECT u AS user_id, CAST(d AS BIGINT) AS doc_id, (d, u) IN (SELECT (d, u) FROM dread) AND (d, u) IN (SELECT (d, u) FROM wr) AS allowed FROM near",
    "codename_check": world() + f"{NEAR} SELECT u AS user_id, CAST(d AS BIGINT) AS doc_id, codename, CAST(d AS BIGINT) % 2 = 0 AND CASE codename WHEN 'view_document' THEN (d, u) IN (SELECT (d, u) FROM dread) WHEN 'docs.change_document' THEN (d, u) IN (SELECT (d, u) FROM wr) ELSE false END AS allowed, CAST(d AS BIGINT) % 2 = 0 AND codename = 'audit_document' AS defers FROM near, (SELECT unnest(['view_document', 'docs.change_document', 'delete_document', 'audit_document']) AS codename)",
    "check_one": world(who="SELECT unnest(['0', '7']) AS u")
    + f", wr AS (({held('owner')}) EXCEPT SELECT d, u FROM banned) SELECT concat(st, ':', u) AS subject, action, concat(rt, ':', rid) AS resource, CASE action WHEN 'read' THEN (rid, u) IN (SELECT (f, u) FROM fread) WHEN 'write' THEN (rid, u) IN (SELECT (d, u) FROM wr) WHEN 'signed_in' THEN st = 'auth/user' ELSE st <> 'auth/user' END AS allowed FROM (VALUES ('auth/user', '0'), ('auth/user', '7'), ('auth/anonymous', '*')) AS s(st, u), (VALUES ('read', 'docs/folder', '0'), ('write', 'docs/document', '0'), ('write', 'docs/document', '1'), ('signed_in', 'docs/document', '1'), ('public', 'docs/document', '1')) AS x(action, rt, rid)",
    "check_at_token": world() + f"SELECT CAST(resource_id AS BIGINT) AS doc_id, subject_id AS user_id, version <= {ND} // 2 AS allowed FROM t WHERE resource_type = 'docs/document' AND relation = 'owner' AND subject_type = 'auth/user'",
    "bulk_check_row_context": world(every=1) + "SELECT CAST(d AS BIGINT) AS doc_id, u AS user_id, CASE CAST(d AS BIGINT) % 3 WHEN 2 THEN 'CONDITIONAL_PERMISSION' ELSE CASE WHEN quality >= CAST(d AS BIGINT) % 3 THEN 'HAS_PERMISSION' ELSE 'NO_PERMISSION' END END AS result FROM gate",
    "caveat_string_ops": "SELECT doc_id, coalesce(length(lang) = 2 AND length(source) > 4, false) AS size, coalesce(concat(lang, ':', source) = 'en:src1', false) AS joined, doc_id // 2 * 2 = doc_id AND doc_id % 4 <> 0 AS halves, coalesce(lang IN ('de', 'fr') AND NOT starts_with(source, 'src1'), false) AS listed FROM documents",
    "save_keeps_redacted": world(who="SELECT '7' AS u") + f"SELECT doc_id, text, source || '!' AS origin FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT d FROM (({held('owner', 'viewer')}) EXCEPT SELECT d, u FROM banned))",
    "guarded_update": world(who="SELECT '7' AS u") + f"SELECT doc_id, 'marked' AS source FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT d FROM (({held('owner')}) EXCEPT SELECT d, u FROM banned))",
    "guarded_delete": "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2",
    "conditional_gate": world(who="SELECT '17' AS u") + "SELECT doc_id, shown, shown AND lang IS NOT NULL AND CAST(doc_id AS VARCHAR) IN (SELECT d FROM gate) AS visible FROM documents, (SELECT unnest([true, false]) AS shown) WHERE CAST(doc_id AS VARCHAR) IN (SELECT d FROM dread)",
    "write_rejected": "SELECT name, name = 'fine' AS written FROM (SELECT unnest(['group as owner', 'column', 'constant', 'unknown', 'wildcard', 'fine']) AS name)",
    "grant_and_revoke_roles": world() + f"SELECT {KEYS} FROM t WHERE resource_type = 'org/role' AND NOT (resource_id = 'editor' AND relation = 'member' AND subject_id = '3') AND NOT (resource_id = 'editor' AND relation = 'includes' AND subject_id = 'admin') UNION ALL SELECT * FROM (VALUES ('org/role', 'viewer', 'member', 'auth/user', '9', '', ''), ('org/role', 'guest', 'includes', 'org/role', 'viewer', 'effective_member', '')) AS v({KEYS})",
    "audit_grant_revoke": world() + f"SELECT 'revoke' AS kind, 'root' AS actor_id, {TARGET} AS target, 'tidy' AS reason, relation FROM t WHERE resource_type = 'docs/document' AND relation = 'viewer' AND subject_id = '*' UNION ALL SELECT 'grant', 'root', 'docs/folder:0#owner @ auth/user:5', 'tidy', 'owner'",
    "relation_dependencies_of_all": f"SELECT permission, relation FROM ({DEPENDS})",
    "permissions_reaching_of_all": f"SELECT relation, permission FROM ({DEPENDS})",
    "schema_lints": "SELECT name, name <> 'fine' AS found FROM (SELECT unnest(['fine', 'cycle', 'constant cycle', 'constant target', 'unknown name']) AS name)",
    "recaveat_override": world(every=1) + "SELECT CAST(d AS BIGINT) AS doc_id, u AS user_id, quality > 0 AS allowed FROM gate",
    "registry_scans": world() + f"SELECT DISTINCT {KEYS} FROM t WHERE resource_type = 'docs/document' AND resource_id = '0' OR subject_type = 'auth/group' AND subject_id = 'nation-0' AND subject_relation = 'member' OR subject_type = 'org/role' AND subject_id = 'admin'",
    "storage_migrated": world() + 'SELECT "to", n AS n_read, n AS n_written FROM (SELECT count(*) AS n FROM t), (SELECT unnest([\'registry\', \'denormalized\']) AS "to")',
    "schema_from_catalog": docs(held("owner", "viewer")),
    "schema_synchronised": "SELECT * FROM (VALUES ('definition:a/x', 'keep'), ('relation:a/x#r', 'keep'), ('permission:a/x#same', 'keep'), ('permission:a/x#changed', 'update'), ('permission:a/x#edited', 'drift'), ('permission:a/x#held', 'held'), ('permission:a/x#added', 'create'), ('permission:a/x#gone', 'prune')) AS v(external_id, done)",
    "explained": "SELECT * FROM (VALUES ('either', '(owner + viewer)'), ('both', '(owner & viewer)'), ('others', '(viewer - owner)'), ('none', 'nil'), ('sub', '(write + preview)'), ('preview', 'temp_viewer')) AS v(permission, algebra)",
    "tool_calls": world(who="SELECT '0' AS u")
    + f", wr AS (({held('owner')}) EXCEPT SELECT d, u FROM banned) SELECT who, call, CASE call WHEN 'read folder 0' THEN ('0', who) IN (SELECT (f, u) FROM fread) WHEN 'write document 1' THEN ('1', who) IN (SELECT (d, u) FROM wr) WHEN 'write a fixed one' THEN ('0', who) IN (SELECT (d, u) FROM wr) WHEN 'create in folder 0' THEN ('0', who) IN (SELECT (f, u) FROM fread) ELSE false END AS allowed FROM (SELECT unnest(['0', 'nobody']) AS who), (SELECT unnest(['read folder 0', 'write document 1', 'write a fixed one', 'write the only one', 'create in folder 0', 'create nowhere']) AS call)",
    "ambient_actor": world(who="SELECT unnest(['2', '3']) AS u")
    + f", oread AS ({OREAD}), n AS (SELECT count(*) AS every FROM orders) SELECT way, CASE WHEN u IS NULL OR u IN ({ADMINS}) THEN every ELSE (SELECT count(DISTINCT o) FROM oread WHERE oread.u = x.u) END AS n FROM (VALUES ('ambient', '2'), ('bypass', NULL), ('own', '3')) AS x(way, u), n",
    "read_your_writes": "SELECT * FROM (VALUES ('after', true), ('before', NULL)) AS v(store, allowed)",
    "instance_checks": world(who="SELECT '7' AS u") + f", wr AS (({held('owner')}) EXCEPT SELECT d, u FROM banned) SELECT CAST(i AS BIGINT) AS doc_id, CAST(i AS VARCHAR) IN (SELECT d FROM dread) AS seen, CAST(i AS VARCHAR) IN (SELECT d FROM dread) AND CAST(i AS VARCHAR) IN ({held('owner').replace('SELECT d, u', 'SELECT d')}) AS text_seen, CAST(i AS VARCHAR) IN (SELECT d FROM wr) AS writes FROM (SELECT unnest(range(4)) AS i)",
    "universal_admin_lint": "SELECT type, type IN ('bad', 'none') AS found FROM (SELECT unnest(['root', 'good', 'bad', 'none']) AS type)",
}
