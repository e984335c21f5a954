"""The table of relationship tuples: scans, keyed upserts and deletes, versions, dictionary encoding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..plans.ast import Admitted, Schema
from ..refs import Grant
from .versions import record_version, token

KEY = ("resource_type", "resource_id", "relation", "subject_type", "subject_id", "subject_relation", "caveat_name")
SCHEMA = "resource_type string, resource_id string, relation string, subject_type string, subject_id string, subject_relation string, caveat_name string, caveat_context string, expires_at timestamp_ntz, version long"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))


def admits(a: Admitted) -> Column:
    """Whether a tuple's subject is of an admitted kind; `with <caveat>` does not restrict."""
    test = (F.col("subject_type") == a.type) & (F.col("subject_relation") == a.relation)
    if a.wildcard:
        return test & (F.col("subject_id") == "*")
    test = test & (F.col("subject_id") != "*")
    return test & (F.col("subject_id") == a.id) if a.id else test


def admitted(schema: Schema) -> Column:
    """Whether a tuple fits its relation's declaration. A static predicate: it reaches the Parquet scan."""
    tests = [(F.col("resource_type") == d.type) & (F.col("relation") == r.name) & reduce(Column.__or__, map(admits, r.admits)) for d in schema.definitions for r in d.relations if not r.backing]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def matches(**fields: str) -> Column:
    """All non-empty fields equal; none at all matches everything."""
    return reduce(Column.__and__, [F.col(k) == v for k, v in fields.items() if v], F.lit(True))


class TupleStore:
    """An immutable view of the latest tuples. Writes return a new store and the batch's version token.

    trail: where grants and revokes are noted, if anywhere (an object with granted(tuples), revoked(tuples)); later stores keep it.
    """

    def __init__(self, df: DataFrame, caveated: set[tuple[str, str]] | None = None, trail=None):
        """caveated: the (type, relation) whose tuples have caveats, if known."""
        self.df, self._caveated, self.trail = df.select(*COLUMNS), caveated, trail

    def audited(self, trail) -> TupleStore:
        return TupleStore(self.df, self._caveated, trail)

    def _without(self, kept: DataFrame, gone: DataFrame) -> TupleStore:
        """The store of kept; gone is noted, and its removal counts as a write of the next version."""
        if self.trail:
            self.trail.revoked(gone)
        return TupleStore(kept, self._caveated, self.trail)

    @classmethod
    def empty(cls, spark: SparkSession) -> TupleStore:
        return cls(spark.createDataFrame([], SCHEMA))

    @classmethod
    def of(cls, spark: SparkSession, grants: Iterable[Grant], version: int = 0) -> TupleStore:
        return cls(rows(spark, grants, version))

    # -- scans

    def for_resource(self, kind: str, ident: str) -> DataFrame:
        return self.df.where(matches(resource_type=kind, resource_id=ident))

    def for_subject(self, kind: str, ident: str, relation: str | None = None) -> DataFrame:
        out = self.df.where(matches(subject_type=kind, subject_id=ident))
        return out if relation is None else out.where(F.col("subject_relation") == relation)

    def by_resource(self) -> DataFrame:
        return self.df.orderBy(*KEY)

    def by_subject(self) -> DataFrame:
        return self.df.orderBy("subject_type", "subject_id", "subject_relation", "resource_type", "resource_id", "relation", "caveat_name")

    def wire(self) -> DataFrame:
        return self.df.select(*KEY)

    def caveated(self) -> set[tuple[str, str]]:
        """The (type, relation) whose tuples have caveats: one scan, as many rows as the schema has relations."""
        if self._caveated is None:
            self._caveated = {tuple(r) for r in self.df.where("caveat_name <> ''").select("resource_type", "relation").distinct().collect()}
        return self._caveated

    def as_of(self, version: int) -> TupleStore:
        """Tuples whose last write is at most version (an upper bound; overwritten values are not brought back)."""
        return TupleStore(self.df.where(F.col("version") <= version), self._caveated, self.trail)

    def high_watermark(self) -> int:
        return self.df.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    # -- writes

    def write(self, schema: Schema, writes: DataFrame | Sequence[Grant]) -> tuple[TupleStore, str]:
        """Upserts by key; within the batch the last of a key wins. Anything inadmissible fails the whole batch."""
        spark = self.df.sparkSession
        if not isinstance(writes, DataFrame):
            writes = rows(spark, writes, 0)
            bad = writes.where(~admitted(schema)).limit(5).collect()
        else:
            bad = writes.where(~admitted(schema)).limit(5).collect()
        if bad:
            raise SchemaError(f"inadmissible: {', '.join(target_text(r.asDict()) for r in bad)}{backed_hint(schema, bad)}")
        base = self.high_watermark()
        # positions come from the versions that the batch carries (0, 1, ... for a list)
        ranked = writes.withColumn("version", F.col("version") + base + 1).select(*COLUMNS)
        last = Window.partitionBy(*KEY).orderBy(F.desc("version"))
        batch = ranked.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")
        # only the batch is ranked; of the store, rows of the relations that it touches are looked up in it and the others pass
        touched = [tuple(r) for r in batch.select("resource_type", "relation").distinct().collect()]
        here = reduce(Column.__or__, [(F.col("resource_type") == t) & (F.col("relation") == n) for t, n in touched], F.lit(False))
        kept = self.df.where(~here).unionByName(self.df.where(here).join(batch.select(*KEY), list(KEY), "left_anti"))
        top = token(ranked.agg(F.coalesce(F.max("version"), F.lit(base))).first()[0])
        if self.trail:
            self.trail.granted(batch)
        record_version(top)
        return TupleStore(kept.unionByName(batch), trail=self.trail), top

    def delete(self, schema: Schema | None = None, allow_all: bool = False, **fields: str) -> TupleStore:
        """Without the tuples that match; an empty filter needs allow_all."""
        if not any(fields.values()) and not allow_all:
            raise ValueError("an empty filter deletes everything: pass allow_all=True")
        reject_backed(schema, fields)
        return self._without(self.df.where(~matches(**fields)), self.matching(**fields))

    def matching(self, **fields: str) -> DataFrame:
        """What delete() would take, for the audit trail."""
        return self.df.where(matches(**fields))

    def delete_exact(self, keys: DataFrame) -> TupleStore:
        """Without the tuples of exactly these keys (all seven columns; empty means empty)."""
        gone = keys.select(*KEY).distinct()
        return self._without(self.df.join(gone, list(KEY), "left_anti"), self.df.join(gone, list(KEY), "left_semi"))

    def cascade(self, gone: DataFrame) -> TupleStore:
        """Without the tuples that have one of these objects (type, id) at either end."""
        g = gone.select("type", "id").distinct()
        near = lambda df: (df["resource_type"] == g["type"]) & (df["resource_id"] == g["id"])
        far = lambda df: (df["subject_type"] == g["type"]) & (df["subject_id"] == g["id"])
        rest = self.df.join(g, near(self.df), "left_anti")
        gone = self.df.join(g, near(self.df), "left_semi").unionByName(rest.join(g, far(rest), "left_semi"))
        return self._without(rest.join(g, far(rest), "left_anti"), gone)

    # -- dictionary encoding

    def encode(self) -> tuple[DataFrame, DataFrame]:
        """(objects: key, type, id; tuples with resource_key and subject_key). Keys are 128-bit hashes, so batches encode alike without a lookup and no two objects share one."""
        ends = self.df.select(F.col("resource_type").alias("type"), F.col("resource_id").alias("id")).unionByName(self.df.select(F.col("subject_type").alias("type"), F.col("subject_id").alias("id"))).distinct()
        objects = ends.select(object_key(F.col("type"), F.col("id")).alias("key"), "type", "id")
        coded = self.df.select(object_key(F.col("resource_type"), F.col("resource_id")).alias("resource_key"), "relation", object_key(F.col("subject_type"), F.col("subject_id")).alias("subject_key"), *COLUMNS[5:])
        return objects, coded

    @classmethod
    def decode(cls, objects: DataFrame, coded: DataFrame) -> TupleStore:
        r = objects.select(F.col("key").alias("resource_key"), F.col("type").alias("resource_type"), F.col("id").alias("resource_id"))
        s = objects.select(F.col("key").alias("subject_key"), F.col("type").alias("subject_type"), F.col("id").alias("subject_id"))
        return cls(coded.join(r, "resource_key").join(s, "subject_key"))

    # -- files

    def save(self, path: str) -> None:
        """Partitioned by resource type and relation, which every read names, and sorted by what reverse lookups filter on."""
        ordered = self.df.repartition("resource_type", "relation", F.pmod(F.xxhash64("resource_id"), F.lit(64))).sortWithinPartitions("resource_type", "relation", "subject_type", "subject_id")
        ordered.write.partitionBy("resource_type", "relation").mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TupleStore:
        return cls(spark.read.schema(SCHEMA).parquet(path))


def object_key(kind: Column, ident: Column) -> Column:
    """16 bytes. A length stands before the type, so no two pairs run together."""
    return F.unhex(F.md5(F.concat(F.length(kind).cast("string"), F.lit(":"), kind, F.lit(":"), ident)))


class RegistryStore:
    """The dictionary-encoded form as a store of its own: objects and coded tuples, as files. Scans filter the dictionary first and join its keys."""

    def __init__(self, objects: DataFrame, coded: DataFrame):
        self.objects, self.coded = objects, coded

    @classmethod
    def of(cls, store: TupleStore) -> RegistryStore:
        return cls(*store.encode())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RegistryStore:
        return cls(spark.read.parquet(f"{path}/objects"), spark.read.parquet(f"{path}/tuples"))

    def save(self, path: str) -> None:
        """Tuples by relation and sorted by subject key, as what is looked up from subjects is most."""
        self.objects.repartition("type").sortWithinPartitions("type", "id").write.partitionBy("type").mode("overwrite").parquet(f"{path}/objects")
        self.coded.repartition("relation", F.pmod(F.xxhash64("resource_key"), F.lit(64))).sortWithinPartitions("relation", "subject_key").write.partitionBy("relation").mode("overwrite").parquet(f"{path}/tuples")

    def plain(self) -> TupleStore:
        return TupleStore.decode(self.objects, self.coded)

    def _of(self, side: str, kind: str, ident: str) -> DataFrame:
        at = self.objects.where((F.col("type") == kind) & (F.col("id") == ident)).select(F.col("key").alias(side))
        return TupleStore.decode(self.objects, self.coded.join(F.broadcast(at), side, "left_semi")).df  # a row at most

    def for_resource(self, kind: str, ident: str) -> DataFrame:
        return self._of("resource_key", kind, ident)

    def for_subject(self, kind: str, ident: str, relation: str | None = None) -> DataFrame:
        out = self._of("subject_key", kind, ident)
        return out if relation is None else out.where(F.col("subject_relation") == relation)

    def upsert(self, store: TupleStore) -> RegistryStore:
        """With the tuples of another store, those of equal keys replaced; the dictionary gets the objects that it lacks."""
        objects, coded = store.encode()
        keys = ["resource_key", "relation", "subject_key", "subject_relation", "caveat_name"]
        new = objects.join(self.objects.select("key"), "key", "left_anti")
        return RegistryStore(self.objects.unionByName(new), self.coded.join(coded.select(*keys), keys, "left_anti").unionByName(coded))


def migrate(spark: SparkSession, source: str, target: str, to: str, dry_run: bool = False) -> dict[str, int]:
    """Copies the store in folder source to folder target in the other form ("registry" or "denormalized"): counts of rows read and of rows that the copy gives back.

    A copy that does not give back what was read is an error; a dry run writes nothing.
    """
    if to not in ("registry", "denormalized"):
        raise ValueError(f"registry or denormalized, not {to!r}")
    plain = TupleStore.load(spark, source) if to == "registry" else RegistryStore.load(spark, source).plain()
    made = RegistryStore.of(plain)
    if not dry_run:
        (made if to == "registry" else plain).save(target)
    back = made.plain() if dry_run else RegistryStore.load(spark, target).plain() if to == "registry" else TupleStore.load(spark, target)
    lost = plain.wire().exceptAll(back.wire()).count() + back.wire().exceptAll(plain.wire()).count()
    if lost:
        raise ValueError(f"{lost} tuples differ between {source} and the copy")
    return {"read": plain.df.count(), "written": 0 if dry_run else back.df.count()}


def rows(spark: SparkSession, grants: Iterable[Grant], version: int = 0) -> DataFrame:
    made = [(g.resource.type, g.resource.id, g.relation, g.subject.type, g.subject.id, g.subject.relation, g.caveat, g.context, g.expires_at, version + i) for i, g in enumerate(grants)]
    out = spark.createDataFrame(made, SCHEMA.replace("expires_at timestamp_ntz", "expires_at string"))
    return out.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz")).select(*COLUMNS)


def target_text(r: dict) -> str:
    return f"{r['resource_type']}:{r['resource_id']}#{r['relation']} @ {r['subject_type']}:{r['subject_id']}" + (f"#{r['subject_relation']}" if r["subject_relation"] else "") + (f" with {r['caveat_name']}" if r["caveat_name"] else "")


def target_column() -> Column:
    """target_text as a column."""
    extra = lambda c, mark: F.when(F.col(c) != "", F.concat(F.lit(mark), F.col(c))).otherwise("")
    return F.concat("resource_type", F.lit(":"), "resource_id", F.lit("#"), "relation", F.lit(" @ "), "subject_type", F.lit(":"), "subject_id", extra("subject_relation", "#"), extra("caveat_name", " with "))


def reject_backed(schema: Schema | None, fields: dict[str, str]) -> None:
    d = schema.definition(fields.get("resource_type", "")) if schema else None
    rel = d.relation(fields.get("relation", "")) if d else None
    if rel and rel.backing:
        raise SchemaError(f"{d.type}#{rel.name} is backed by a {rel.backing.kind}: it has no tuples")


def backed_hint(schema: Schema, bad: list) -> str:
    names = sorted({f"{r['resource_type']}#{r['relation']}" for r in bad if (d := schema.definition(r["resource_type"])) and (x := d.relation(r["relation"])) and x.backing})
    return f" ({', '.join(names)}: backed relations take no tuples)" if names else ""


def open_store(spark: SparkSession, path: str, config) -> TupleStore:
    """The store in a folder, in the form that the configuration names."""
    return RegistryStore.load(spark, path).plain() if config.storage == "registry" else TupleStore.load(spark, path)
