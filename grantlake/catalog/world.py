"""The derived graph: schema, tuples and tables, as DataFrames and as SQL in the common subset of Spark and DuckDB."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.engine import Engine
from ..plans.parser import parse_schema
from ..sources.scratch import scratch_root
from ..sources.store import TupleStore
from ..sources.universe import Universe

NOW = "2024-01-31 00:00:00"

SCHEMA = """
// @package: catalog
// @schema_revision: 1
caveat min_quality(quality int, required int) { quality >= required }

definition auth/user {}
definition auth/group {
    relation member: auth/user | auth/group#member
}
definition docs/folder {
    relation owner: auth/user
    relation viewer: auth/group#member
    relation parent: docs/folder
    relation starred: docs/document
    permission read = owner + viewer + parent->read
    permission open = owner + starred->open
}
definition docs/document {
    relation owner: auth/user
    relation viewer: auth/user | auth/group#member | auth/user:*
    relation folder: docs/folder
    relation banned: auth/user
    relation temp_viewer: auth/user with expiration
    relation gated_viewer: auth/user with min_quality
    relation pinned: auth/group:region-0#member | auth/user
    permission read = (owner + viewer + folder->read) - banned
    permission write = owner - banned
    permission review = viewer & gated_viewer
    permission vetted = gated_viewer
    permission careful = (owner + gated_viewer) - banned
    permission preview = temp_viewer
    permission read__text = owner
    permission write__text = owner - banned
    permission both = owner & viewer
    permission either = owner + viewer
    permission others = viewer - owner
    permission order = owner + viewer & folder->read - banned
    permission none = nil
    permission sub = write + preview
    permission signed_in = authenticated
    permission public = anonymous
    permission logged_viewer = viewer & authenticated
    permission open = owner + folder->open
    permission create = folder->read & authenticated
}
definition geo/region {
    relation manager: auth/user
    permission read = manager
}
definition geo/nation {
    relation region: geo/region // backing:field=n_regionkey
    permission read = region->read
}
definition crm/account {
    relation nation: geo/nation // backing:field=c_nationkey
    permission read = nation->read
}
definition sales/order {
    relation account: crm/account // backing:field=o_custkey
    relation admin: org/role // backing:const=admin
    permission read = account->read + admin->member
    permission list = authenticated
    permission admin_only = admin->member
    permission held = account
}
definition org/role {
    relation member: auth/user | auth/group#member
    relation includes: org/role#effective_member
    permission effective_member = member + includes
}
"""

_NULLS = "'' AS caveat_name, CAST(NULL AS STRING) AS caveat_context, CAST(NULL AS {ntz}) AS expires_at"
_USERS = "(SELECT count(*) FROM {customer})"
_FOLDERS = "(SELECT greatest(1, CAST(floor(count(*) / 10.0) AS BIGINT)) FROM {documents})"


def _edge(kind: str, rid: str, relation: str, st: str, sid: str, sr: str, source: str, version: str, extra: str = _NULLS) -> str:
    return f"SELECT '{kind}' AS resource_type, CAST({rid} AS STRING) AS resource_id, '{relation}' AS relation, '{st}' AS subject_type, CAST({sid} AS STRING) AS subject_id, '{sr}' AS subject_relation, {extra}, CAST({version} AS BIGINT) AS version FROM {source}"


_DOC, _FOLDER = "docs/document", f"{{documents}} WHERE doc_id < {_FOLDERS}"
_SEGMENTS = "(SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) - 1 AS k FROM (SELECT DISTINCT c_mktsegment FROM {customer}))"
EDGES = [
    _edge(_DOC, "doc_id", "owner", "auth/user", f"(doc_id * 7) % {_USERS}", "", "{documents}", "doc_id"),
    _edge(_DOC, "doc_id", "viewer", "auth/user", "'*'", "", "{documents} WHERE doc_id % 50 = 0", "doc_id + 1"),
    _edge(_DOC, "doc_id", "viewer", "auth/group", "concat('region-', CAST(doc_id % 5 AS STRING))", "member", "{documents} WHERE doc_id % 4 = 2", "doc_id + 2"),
    _edge(_DOC, "doc_id", "viewer", "auth/group", "concat('seg-', s)", "member", f"{{documents}} JOIN {_SEGMENTS} AS seg ON doc_id % 5 = k WHERE doc_id % 4 = 1", "doc_id + 3"),
    _edge(_DOC, "doc_id", "viewer", "auth/user", f"(doc_id * 13 + 5) % {_USERS}", "", "{documents} WHERE doc_id % 4 = 3", "doc_id + 4"),
    _edge(_DOC, "doc_id", "folder", "docs/folder", f"doc_id % {_FOLDERS}", "", "{documents}", "doc_id + 5"),
    _edge(_DOC, "doc_id", "banned", "auth/user", f"(doc_id * 7) % {_USERS}", "", "{labels} WHERE toxic = 1", "doc_id + 6"),
    _edge(_DOC, "doc_id", "temp_viewer", "auth/user", f"(doc_id * 11) % {_USERS}", "", "{documents} WHERE doc_id % 6 = 0", "doc_id + 7", "'' AS caveat_name, CAST(NULL AS STRING) AS caveat_context, {expiry} AS expires_at"),
    _edge(_DOC, "doc_id", "gated_viewer", "auth/user", f"(doc_id * 17) % {_USERS}", "", "{labels}", "doc_id + 8", "'min_quality' AS caveat_name, concat('{{\"quality\": ', CAST(quality AS STRING), '}}') AS caveat_context, CAST(NULL AS {ntz}) AS expires_at"),
    _edge(_DOC, "doc_id", "pinned", "auth/group", "concat('region-', CAST(doc_id % 5 AS STRING))", "member", "{documents} WHERE doc_id % 3 = 0", "doc_id + 9"),
    _edge("docs/folder", "doc_id", "owner", "auth/user", f"(doc_id * 7) % {_USERS}", "", _FOLDER + " AND doc_id % 5 = 0", "doc_id + 10"),
    _edge("docs/folder", "doc_id", "viewer", "auth/group", "concat('nation-', CAST(doc_id % 25 AS STRING))", "member", _FOLDER + " AND doc_id % 7 = 3", "doc_id + 11"),
    _edge("docs/folder", "doc_id", "parent", "docs/folder", "CAST(floor((doc_id - 1) / 3.0) AS BIGINT)", "", _FOLDER + " AND doc_id > 0", "doc_id + 12"),
    _edge("docs/folder", "doc_id", "starred", "docs/document", "doc_id + 1", "", _FOLDER + " AND doc_id % 4 < 3", "doc_id + 13"),
    _edge("auth/group", "concat('nation-', CAST(c_nationkey AS STRING))", "member", "auth/user", "c_custkey", "", "{customer}", "c_custkey"),
    _edge("auth/group", "concat('region-', CAST(n_regionkey AS STRING))", "member", "auth/group", "concat('nation-', CAST(n_nationkey AS STRING))", "member", "{nation}", "n_nationkey"),
    _edge("auth/group", "concat('seg-', c_mktsegment)", "member", "auth/user", "c_custkey", "", "{customer}", "c_custkey"),
    _edge("geo/region", "r_regionkey", "manager", "auth/user", "r_regionkey", "", "{region}", "r_regionkey"),
    _edge("org/role", "'admin'", "member", "auth/user", "r_regionkey", "", "{region} WHERE r_regionkey < 2", "r_regionkey"),
    _edge("org/role", "'admin'", "member", "auth/group", "'region-0'", "member", "{region} WHERE r_regionkey = 0", "r_regionkey"),
    _edge("org/role", "'editor'", "includes", "org/role", "'admin'", "effective_member", "{region} WHERE r_regionkey = 0", "r_regionkey"),
    _edge("org/role", "'editor'", "member", "auth/user", "r_regionkey", "", "{region} WHERE r_regionkey = 3", "r_regionkey"),
    _edge("org/role", "'viewer'", "includes", "org/role", "'editor'", "effective_member", "{region} WHERE r_regionkey = 0", "r_regionkey"),
    # rows that the schema does not admit and every read passes over
    _edge(_DOC, "doc_id", "owner", "auth/group", "'nation-0'", "member", "{documents} WHERE doc_id % 97 = 0", "doc_id"),
    _edge(_DOC, "doc_id", "folder", "auth/user", "1", "", "{documents} WHERE doc_id % 97 = 0", "doc_id"),
]
TABLES = ("region", "nation", "customer", "orders", "events", "documents", "labels")
ACTIONS = "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'review' ELSE 'delete' END"


def edges_sql(duckdb: bool) -> str:
    """All tuples as one query: over {table} fields for Spark, over plain names for DuckDB."""
    text = " UNION ALL ".join(EDGES)
    if not duckdb:
        return text.replace("{ntz}", "TIMESTAMP_NTZ").replace("{expiry}", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(CAST(doc_id % 60 AS INT))")
    text = text.replace("{ntz}", "TIMESTAMP").replace("{expiry}", "TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INT))")
    return text.format(**{t: t for t in TABLES})


#: Where the stores of this process are: (application, folder) -> path, relations with caveats.
STORES: dict[tuple[str, str], tuple[str, set]] = {}


class World:
    """Tables, tuples and an engine over one folder of test data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.schema = spark, sf_dir, parse_schema(SCHEMA)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tuples(self) -> DataFrame:
        return self.spark.sql(edges_sql(False), **{t: self.table(t) for t in TABLES if t != "events" and t != "orders"})

    @cached_property
    def store(self) -> TupleStore:
        """The tuples as a written store, laid out by type and relation; once an application and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in STORES:
            path = f"{scratch_root(self.spark)}/store-{uuid.uuid4().hex}"
            TupleStore(self.tuples).save(path)
            STORES[key] = (path, TupleStore.load(self.spark, path).caveated())
        path, caveated = STORES[key]
        return TupleStore(TupleStore.load(self.spark, path).df, caveated)

    @cached_property
    def universe(self) -> Universe:
        u = Universe()
        u.register("docs/document", self.table("documents"), "doc_id")
        u.register("geo/nation", self.table("nation"), "n_nationkey", {"n_regionkey": "geo/region"})
        u.register("geo/region", self.table("region"), "r_regionkey")
        u.register("crm/account", self.table("customer"), "c_custkey", {"c_nationkey": "geo/nation"})
        u.register("sales/order", self.table("orders"), "o_orderkey", {"o_custkey": "crm/account"})
        u.register("auth/user", self.table("customer"), "c_custkey")
        return u

    def engine(self, **settings) -> Engine:
        """Folders are a ternary tree, deeper than any fixed number of hops once there are enough documents, and all of it counts."""
        return Engine(self.spark, self.schema, self.store, self.universe, NOW, Config(**{"max_hops": None, **settings}))

    def users(self, every: int = 50) -> DataFrame:
        """The subjects that most queries ask for: users whose key is divisible by `every`."""
        return self.table("customer").where(F.col("c_custkey") % every == 0).select(F.lit("auth/user").alias("subject_type"), F.col("c_custkey").cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))

    def n_folders(self) -> int:
        return max(1, self.table("documents").count() // 10)

    def requests(self) -> DataFrame:
        """A request an event."""
        n = self.table("documents").count()
        e = self.table("events")
        return e.select("event_id", F.lit("auth/user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"), F.lit("").alias("subject_relation"), F.expr(ACTIONS).alias("action"), F.lit("docs/document").alias("resource_type"), (F.col("event_id") % n).cast("string").alias("resource_id"))
