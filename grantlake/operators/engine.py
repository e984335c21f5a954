"""Bulk evaluation of permission schemas: what is compiled on the driver is a plan, and the cluster runs it."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONSISTENCY, Config
from ..errors import DepthExceeded, SchemaError, StoreBehind
from ..functions import cel
from ..plans.ast import BUILTINS, Combine, Expr, Hop, Name, Nothing, Relation, Schema, leaves
from ..plans.introspect import components, defined, dependencies, reachable
from ..plans.parser import validate
from ..plans.printer import expression_text
from ..refs import ObjectRef, SubjectRef
from ..sources.scratch import Rounds
from ..sources.store import TupleStore, admits
from ..sources.universe import Universe
from ..sources.versions import current_version, read_token
from .verdicts import PARTS, Algebra, Verdicts, and3, every_pair, product, tasks

SUBJECT = ["subject_type", "subject_id", "subject_relation"]
RESULTS = {2: "HAS_PERMISSION", 1: "CONDITIONAL_PERMISSION", 0: "NO_PERMISSION"}
#: Hops that are one plan, at first (the start among them) and later.
FIRST_HOPS, HOPS = 3, 4
#: Up to this many subjects given as values are also pushed into the scan as literals.
LITERALS = 200
#: Evaluations that an engine keeps.
MEMO = 64
#: A store so many times as large as the requests is narrowed first.
NARROW = 1000
#: Bytes that a request given as values counts for, as the planner has no estimate of such frames.
REQUEST = 200
#: Reached objects that are sent to all executors, at most, so that no edge is shuffled to meet them.
BROADCAST = 1 << 16
#: Names that one object's sets hold, at most; beyond, requested subjects are followed one by one.
LARGEST = 1000
#: Names of objects that are a task's share at least: each may stand for very many subjects.
PER_PART = 1 << 10
#: Names of requested subjects that are sent to all executors, at most.
FEW = 1 << 19
#: Objects with equal sets of names that are told at once, or so.
ALIKE = 1 << 9
#: Listed objects that are sent to all executors, at most (100 MB or so).
MEMBERS = 1 << 20


def subject_key(kind: Column, ident: Column, relation: Column) -> Column:
    return F.concat(kind, F.lit(":"), ident, F.lit("#"), relation)


#: Stands between a subject and the JSON context of its request in a key.
WITH = "\u0001"


def subject_columns() -> list[Column]:
    """The subject columns back from a key: types have no colon and relations no hash sign."""
    key = F.substring_index(F.col("skey"), WITH, 1)
    kind, relation = F.substring_index(key, ":", 1), F.substring_index(key, "#", -1)
    ident = F.substr(key, F.length(kind) + 2, F.length(key) - F.length(kind) - F.length(relation) - 2)
    return [c.alias(n) for c, n in zip((kind, ident, relation), SUBJECT, strict=True)]


class Engine:
    """A compiled schema over a tuple store and a universe. Engines are immutable: a changed schema or store is another engine.

    now: tuples that expire at or before it do not count (text such as "2024-01-31 00:00:00"; None: never).
    """

    def __init__(self, spark: SparkSession, schema: Schema, store: TupleStore, universe: Universe | None = None, now: str | None = None, config: Config | None = None):
        problems = validate(schema)
        if problems:
            raise SchemaError("; ".join(problems))
        self.spark, self.schema, self.store, self.universe, self.now, self.config = spark, schema, store, universe or Universe(), now, config or Config()
        problems = self.config.problems()
        if self.universe.tables and self.universe.prefix != self.config.type_prefix:
            problems.append(f"the universe's types begin with {self.universe.prefix!r}, the configuration's with {self.config.type_prefix!r}")
        if problems:
            raise SchemaError("; ".join(problems))
        self.overlay: DataFrame | None = None
        self._caveated: set[tuple[str, str]] | None = None
        self._memo: OrderedDict[tuple, Evaluation] = OrderedDict()
        self._rounds: list[Rounds] = []

    def _copy(self, **changes) -> Engine:
        other = Engine(self.spark, self.schema, self.store, self.universe, self.now, self.config)
        other.overlay, other._caveated = self.overlay, self._caveated
        for k, v in changes.items():
            setattr(other, k, v)
        return other

    def as_of(self, version: int) -> Engine:
        return self._copy(store=self.store.as_of(version))

    @property
    def trail(self):
        """Where denials and bypasses are noted: the store's trail, if it has one."""
        return self.store.trail

    def reading(self, token: str | None = None, consistency: str | None = None) -> Engine:
        """The engine for reads that must have seen a token's version.

        What is given wins; else a token that this piece of work has written (version_scope) counts as
        at_least_as_fresh; else the configuration's consistency. at_least_as_fresh and fully_consistent need a store that has
        seen the version (StoreBehind if not), at_exact_snapshot reads as of it (only then are later writes passed over).
        """
        if token is None and consistency is None and current_version():
            token, consistency = current_version(), "at_least_as_fresh"
        consistency = consistency or ("at_least_as_fresh" if token else self.config.consistency)
        version = read_token(token) if token else None
        if consistency == "at_exact_snapshot":
            if version is None:
                raise ValueError("an exact snapshot needs a token")
            return self.as_of(version)
        if consistency not in CONSISTENCY:
            raise ValueError(f"consistency must be one of {', '.join(CONSISTENCY)}, not {consistency!r}")
        if version is not None and consistency != "minimize_latency" and self.store.high_watermark() < version:
            raise StoreBehind(f"the store has not seen {token}")
        return self

    def with_overlay(self, edges: DataFrame) -> Engine:
        """Virtual tuples beside the stored ones, without caveats; they may also stand for column-backed edges."""
        return self._copy(overlay=edges)

    def subjects(self, refs: Iterable[SubjectRef | str]) -> DataFrame:
        found = [s if isinstance(s, SubjectRef) else SubjectRef.parse(s) for s in refs]
        return self.spark.createDataFrame([(s.type, s.id, s.relation) for s in dict.fromkeys(found)], ", ".join(f"{c} string" for c in SUBJECT))

    def caveated(self) -> set[tuple[str, str]]:
        """The (type, relation) whose tuples have caveats: known from one scan, as many rows as the schema has relations."""
        if self._caveated is None:
            self._caveated = self.store.caveated() if self.schema.caveats else set()
        return self._caveated

    def evaluate(self, subjects: DataFrame, context: Mapping | None = None, targets: Mapping[str, DataFrame] | None = None, literals: list[SubjectRef] | None = None) -> Evaluation:
        return Evaluation(self, subjects, context or {}, targets or {}, literals)

    def evaluation(self, refs: Iterable[SubjectRef | str], context: Mapping | None = None) -> Evaluation:
        """The evaluation for subjects given as values: kept, so that scope, gates and checks of one actor share what has been found.

        MEMO evaluations are kept, those used last. Engines are immutable, so what is kept stays true; another
        store, schema, overlay or time is another engine with nothing kept.
        """
        literals = [s if isinstance(s, SubjectRef) else SubjectRef.parse(s) for s in refs]
        key = (frozenset(literals), json.dumps(dict(context or {}), sort_keys=True, default=str))
        if key in self._memo:
            self._memo.move_to_end(key)
        else:
            self._memo[key] = self.evaluate(self.subjects(literals), context, literals=literals)
            if len(self._memo) > MEMO:
                self._memo.popitem(last=False)
        return self._memo[key]

    def rounds(self) -> Rounds:
        """A folder for the tables of a fixpoint, which clear() deletes."""
        self._rounds.append(Rounds(self.spark))
        return self._rounds[-1]

    def clear(self) -> None:
        """Forgets kept evaluations and deletes the tables of their rounds. Frames that this engine has given before can no longer be read."""
        self._memo.clear()
        for r in self._rounds:
            r.drop()
        self._rounds.clear()

    # -- the read API

    def accessible(self, subjects: DataFrame | Iterable[SubjectRef | str], action: str, kind: str, context: Mapping | None = None, conditional: bool = False, token: str | None = None, consistency: str | None = None, native: bool = False) -> DataFrame:
        """(subject_type, subject_id, subject_relation, resource_id) of unconditional access (with conditional, any but no). token, consistency: see reading().

        native: resource_id has the type that it has in the universe's table, not text.
        """
        if (at := self.reading(token, consistency)) is not self:
            return at.accessible(subjects, action, kind, context, conditional, consistency="minimize_latency", native=native)
        ev = self.evaluate(subjects, context) if isinstance(subjects, DataFrame) else self.evaluation(subjects, context)
        rid = F.col("rid").cast(self.universe.id_type(kind)) if native else F.col("rid")
        if isinstance(subjects, DataFrame) and (by := ev.by_names(kind, action)):
            return by.listed().select(*SUBJECT, rid.alias("resource_id"))
        v = ev.verdicts(kind, action)
        if v.rows is None and v.whole is not None:  # subject columns and types of ids once a subject and object, as the answer is a row for both
            held = self.rounds().save(v.whole.where(F.col("v") >= (1 if conditional else 2)).select(*subject_columns()), "whole")
            n, m = self.universe.get(kind).df.count(), held.count()
            ids = self.universe.ids(kind).select(rid.alias("rid"))
            return (every_pair(ids, n, held, m, "subject_id") if m <= FEW else product(ids, "rid", held)).select(*SUBJECT, F.col("rid").alias("resource_id"))
        rows = ev.rows(kind, action, spread=True)
        return rows.where(F.col("v") >= (1 if conditional else 2)).select(*subject_columns(), rid.alias("resource_id"))

    def reaching(self, subjects: DataFrame | Iterable[SubjectRef | str], action: str, kind: str, context: Mapping | None = None) -> DataFrame:
        """(subject_type, subject_id, subject_relation), once each, of those who have the action on some object of the type, unconditionally."""
        ev = self.evaluate(subjects, context) if isinstance(subjects, DataFrame) else self.evaluation(subjects, context)
        if isinstance(subjects, DataFrame) and (by := ev.by_names(kind, action)):
            return by.some()
        v = ev.verdicts(kind, action)
        whole = product(self.universe.ids(kind).limit(1), "rid", v.whole) if v.whole is not None else None
        found = ev.algebra.stack(*[df.where("v = 2").select("skey") for df in (v.rows, whole) if df is not None])
        return (ev.nothing() if found is None else found).select("skey").distinct().select(*subject_columns())

    def bulk_check(self, requests: DataFrame, context: Mapping | None = None, context_column: str | None = None, narrow: bool | None = None, token: str | None = None, consistency: str | None = None) -> DataFrame:
        """requests with verdict, allowed, result, conditional_on and reason appended.

        requests: subject_type, subject_id, subject_relation, action, resource_type, resource_id and whatever
        else. One plan a (resource_type, action) serves all requests of it. An empty resource_id asks
        whether any object would do (yes or no, never conditional). context holds for all requests;
        context_column names a column of JSON with each request's own, which wins over it.
        narrow: first follow the edges up from the requested objects, so that only edges of objects that may matter are read and the cost goes with the
        requests; by default if the store is NARROW times as large as the requests, by the planner's estimate.
        """
        if (at := self.reading(token, consistency)) is not self:
            return at.bulk_check(requests, context, context_column, narrow, consistency="minimize_latency")
        kinds = [tuple(r) for r in requests.select("resource_type", "action").distinct().collect()]
        skey = subject_key(*[F.col(c) for c in SUBJECT])
        if context_column:
            skey = F.concat(skey, F.lit(WITH), F.coalesce(F.col(context_column).cast("string"), F.lit("{}")))
        asked = requests.withColumn("skey", skey)
        known = [(t, a) for t, a in sorted(kinds, key=str) if defined(self.schema, t, a)]
        kinds = {t for t, _ in known}
        models = requests.where(F.col("resource_id") == "").limit(1).count() > 0 if known else False
        store_is_large = known and not models and (estimate(self.store.df) > NARROW * estimate(requests) if narrow is None else narrow)
        # what is asked, once: every plan below meets it early, so that verdicts nobody asked for are not carried along
        pairs = self.rounds().save(asked.select(F.col("resource_type").alias("kind"), "skey", F.col("resource_id").alias("rid")).distinct(), "asked") if known and not models else None
        evs: dict[bool, Evaluation] = {}
        for t, a in known:  # missing names are only carried where caveats are in reach
            caveats = bool(self.evaluate(requests).reads(t, a) & self.caveated())
            if caveats not in evs:
                evs[caveats] = self.evaluate(asked.select("skey", *SUBJECT).distinct(), context)
            evs[caveats].wanted.append((t, a))
        named = True in evs
        rows = whole = None
        for ev in evs.values():
            if pairs is not None:
                ev.pairs = {t: pairs.where(F.col("kind") == t).drop("kind") for t in {t for t, _ in known}}
                ev.targets = {t: p.select("rid").distinct() for t, p in ev.pairs.items()}
            if store_is_large:
                ev.narrow(ev.wanted)
            for t, a in ev.wanted:
                by = ev.by_names(t, a) if pairs is not None else None
                v = Verdicts(by.among(ev.pairs[t])) if by else ev.verdicts(t, a)
                more = [F.array().cast("array<string>").alias("m")] if named and not ev.algebra.conditional else []
                tag = lambda df, t=t, a=a, more=more: df.select(F.lit(t).alias("resource_type"), F.lit(a).alias("action"), *df.columns, *more)
                if v.rows is not None:
                    part = tag(v.rows.withColumnRenamed("rid", "resource_id"))
                    rows = part if rows is None else rows.unionByName(part)
                    if models:
                        some = v.rows.where("v = 2").groupBy("skey").agg(F.max("v").alias("v")).withColumn("resource_id", F.lit(""))
                        some = some.withColumn("m", F.array().cast("array<string>")) if ev.algebra.conditional else some
                        rows = rows.unionByName(tag(some))
                if v.whole is not None:
                    part = tag(v.whole)
                    whole = part if whole is None else whole.unionByName(part)
        none = F.array().cast("array<string>")
        key = ["resource_type", "action", "skey"]
        out, vs, ms = asked, [F.lit(0).cast("tinyint")], []
        for name, df, on in (("r", rows, [*key, "resource_id"]), ("w", whole, key)):
            if df is not None:
                df = df.withColumnsRenamed({"v": f"_{name}v", "m": f"_{name}m"})
                out = out.join(df, on, "left")
                vs.append(F.coalesce(f"_{name}v", F.lit(0).cast("tinyint")))
                ms += [F.when(F.col(f"_{name}v") == 1, F.col(f"_{name}m"))] if named else []
        v = F.greatest(*vs) if len(vs) > 1 else vs[0]
        v = F.when((F.col("resource_id") == "") & (v == 1), F.lit(0).cast("tinyint")).otherwise(v)
        names = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(m, none) for m in ms])))) if ms else none
        types = [d.type for d in self.schema.definitions]
        okay = F.lit(False)
        for t, a in known:
            okay = okay | ((F.col("resource_type") == t) & (F.col("action") == a))
        reason = F.when(~F.col("resource_type").isin(types), "unknown resource type").when(~okay, "unknown action").otherwise("")
        out = out.withColumn("verdict", v)
        result = F.when(F.col("verdict") == 2, RESULTS[2]).when(F.col("verdict") == 1, RESULTS[1]).otherwise(RESULTS[0])
        out = out.select(*requests.columns, "verdict", (F.col("verdict") == 2).alias("allowed"), result.alias("result"), F.when(F.col("verdict") == 1, names).otherwise(none).alias("conditional_on"), reason.alias("reason"))
        if self.config.audit_denials and self.trail:
            self.trail.denied(out)
        return out

    def check(self, subject: SubjectRef | str, action: str, resource: ObjectRef | str, context: Mapping | None = None, token: str | None = None, consistency: str | None = None):
        """One request as a row (verdict, allowed, result, conditional_on, reason). Ask in bulk for more than a few."""
        s = subject if isinstance(subject, SubjectRef) else SubjectRef.parse(subject)
        r = resource if isinstance(resource, ObjectRef) else ObjectRef.parse(resource)
        request = self.spark.createDataFrame([(s.type, s.id, s.relation, action, r.type, r.id)], ", ".join(f"{c} string" for c in (*SUBJECT, "action", "resource_type", "resource_id")))
        return self.bulk_check(request, context, narrow=self.narrows(1), token=token, consistency=consistency).first()

    def narrows(self, n: int) -> bool:
        """Whether n requests that are given as values are few enough, beside the store, to follow the edges up from what they ask for."""
        return estimate(self.store.df) > NARROW * REQUEST * n

    def has_access(self, subject, action: str, resource, context: Mapping | None = None) -> bool:
        """Conditional counts as no."""
        return self.check(subject, action, resource, context)["allowed"]

    def grants_all(self, subjects: DataFrame | Iterable[SubjectRef | str], action: str, kind: str) -> DataFrame:
        """subjects with grants_all: whether built-ins and constant hops alone, without any `-`, give them every object of the type."""
        ev = self.evaluate(subjects) if isinstance(subjects, DataFrame) else self.evaluation(subjects)
        whole = ev.static_whole(kind, action)
        out = ev.subjects
        if whole is None:
            return out.select(*SUBJECT, F.lit(False).alias("grants_all"))
        held = ev.algebra.merge(whole, "skey").where("v = 2").select("skey", F.lit(True).alias("g"))
        return out.join(held, "skey", "left").select(*SUBJECT, F.coalesce("g", F.lit(False)).alias("grants_all"))

    def lookup_direct(self, resources: DataFrame, action: str, kind: str, subject_type: str) -> DataFrame:
        """(resource_id, subject...) of tuples of the relations that the action's expression names: operators, hops, expiry and caveats aside."""
        d = self.schema.definition(kind)
        names = [action] if d.relation(action) else [x.name for x in leaves(d.permission(action).expr) if isinstance(x, Name) and d.relation(x.name)]
        edges = self.store.df.where((F.col("resource_type") == kind) & F.col("relation").isin(names) & (F.col("subject_type") == subject_type))
        return edges.join(resources.select("resource_id").distinct(), "resource_id", "left_semi").select("resource_id", *SUBJECT).distinct()

    def lookup_full(self, resources: DataFrame, action: str, kind: str, subjects: DataFrame, context: Mapping | None = None) -> DataFrame:
        """(resource_id, subject...) of every subject of `subjects` that has the action on them, by the full plan."""
        ids = resources.select(F.col("resource_id").alias("rid")).distinct()
        ev = self.evaluate(subjects, context, {kind: ids})
        ev.wanted = [(kind, action)]
        if by := ev.by_names(kind, action):
            return by.listed(ids).select(F.col("rid").alias("resource_id"), *SUBJECT)
        v = ev.verdicts(kind, action)
        rows = ev.algebra.stack(v.rows, ev.algebra.spread(v.whole, ids) if v.whole is not None else None)
        if rows is None:
            return ev.subjects.select(F.lit("").alias("resource_id"), *SUBJECT).where(F.lit(False))
        return rows.where("v = 2").join(ids, "rid", "left_semi").select(F.col("rid").alias("resource_id"), *subject_columns()).distinct()

    def check_new(self, proposals: DataFrame, edges: DataFrame, context: Mapping | None = None, narrow: bool | None = None, subjects: DataFrame | None = None) -> DataFrame:
        """proposals (id, subject..., action, resource_type) with verdict and the rest: may the subject make a row that carries these edges?

        edges: id, relation, subject..., of the same id; they hold for the proposal alone, whatever caveats
        their relations ask for. Constant edges come from the schema; giving one is an error. narrow: see bulk_check().
        subjects: all who are asked for each of the proposals, which then have no subject columns; so the edges are given once a proposal.
        """
        consts = [(d.type, r.name) for d in self.schema.definitions for r in d.relations if r.backing and r.backing.kind == "const"]
        new = F.concat(F.lit("new:"), F.col("id").cast("string"))
        virtual = edges.join(proposals.select("id", "resource_type").distinct(), "id").select("resource_type", new.alias("resource_id"), "relation", "subject_type", "subject_id", "subject_relation")
        virtual = self.rounds().save(virtual, "new")  # each relation reads them
        given = {tuple(r) for r in virtual.select("resource_type", "relation").distinct().collect()}
        if bad := sorted(given & set(consts)):
            raise SchemaError(f"constant edges come from the schema: {', '.join(f'{t}#{n}' for t, n in bad)}")
        engine, proposals = self.with_overlay(virtual), proposals.withColumn("resource_id", new)
        if subjects is not None:
            subjects = subjects.select(*SUBJECT).distinct()
            if (checked := engine.by_all(proposals, subjects, context)) is not None:
                return checked.drop("resource_id")
            proposals = product(proposals, "id", subjects)
        return engine.bulk_check(proposals, context, narrow=narrow).drop("resource_id")

    def by_all(self, asked: DataFrame, subjects: DataFrame, context: Mapping | None) -> DataFrame | None:
        """What bulk_check() gives for each row of asked (action, resource_type, resource_id) with each of subjects, if names tell it: no table has a row for both but the answer."""
        asked, out = self.rounds().save(asked, "asked"), None
        for t, a in sorted((tuple(r) for r in asked.select("resource_type", "action").distinct().collect()), key=str):
            mine = asked.where((F.col("resource_type") == t) & (F.col("action") == a))
            ev = self.evaluate(subjects, context, {t: mine.select(F.col("resource_id").alias("rid")).distinct()})
            ev.wanted = [(t, a)]
            if (by := ev.by_names(t, a, overlay=True)) is None:
                return None
            out = ev.algebra.stack(out, by.answers(mine))
        if out is None:
            return None
        yes, columns = F.col("allowed"), [*SUBJECT, *[c for c in asked.columns if c not in SUBJECT]]
        out = out.select(*columns, F.when(yes, 2).otherwise(0).cast("tinyint").alias("verdict"), "allowed", F.when(yes, RESULTS[2]).otherwise(RESULTS[0]).alias("result"), F.array().cast("array<string>").alias("conditional_on"), F.lit("").alias("reason"))
        if self.config.audit_denials and self.trail:
            self.trail.denied(out)
        return out

    def explain(self, kind: str, permission: str, subjects: DataFrame | None = None) -> str:
        """The permission's algebra and, with subjects, Spark's plan of it."""
        d = self.schema.definition(kind)
        text = f"{kind}#{permission} = {expression_text(d.permission(permission).expr)}"
        if subjects is not None:
            text += "\n" + self.accessible(subjects, permission, kind)._jdf.queryExecution().toString()
        return text


class Evaluation:
    """Verdicts for a table of subjects, with sub-plans shared by (type, name)."""

    def __init__(self, engine: Engine, subjects: DataFrame, context: Mapping, targets: Mapping[str, DataFrame], literals: list[SubjectRef] | None):
        self.engine, self.schema, self.context, self.targets, self.literals = engine, engine.schema, context, targets, literals
        self.subjects = subjects if "skey" in subjects.columns else subjects.select(subject_key(*[F.col(c) for c in SUBJECT]).alias("skey"), *SUBJECT)
        self.own_context = "skey" in subjects.columns
        self.narrowed = False
        self.names_only = False  # subjects meet the tuples that name them, and no others
        self.pairs: dict[str, DataFrame] = {}  # (skey, rid) that are asked, by type
        self.wanted: list[tuple[str, str]] = []  # (type, name) that are asked, if nothing else will be
        self._edges: dict[tuple, DataFrame | None] = {}
        self.memo: dict[tuple[str, str], Verdicts] = {}
        self.algebra = Algebra(False)
        self.rounds: Rounds | None = None
        self._tops: tuple[list, set[str]] | None = None

    def prepare(self, kind: str, name: str) -> None:
        """Missing names are carried only if some relation in reach has caveats."""
        reach = self.reads(kind, name)
        if not self.algebra.conditional and reach & self.engine.caveated():
            self.algebra, self.memo = Algebra(True), {}

    def reads(self, kind: str, name: str) -> set[tuple[str, str]]:
        """The (type, relation) whose tuples may be read."""
        out = set()
        for t, n in reachable(self.schema, kind, name):
            out.add((t, n))
            d = self.schema.definition(t)
            if d and (perm := d.permission(n)):
                out |= {(t, x.via) for x in leaves(perm.expr) if isinstance(x, Hop)}
        return out

    def verdicts(self, kind: str, name: str) -> Verdicts:
        """The verdicts of a permission or relation (a permission wins, should both exist)."""
        if not defined(self.schema, kind, name):
            return Verdicts()
        self.prepare(kind, name)
        near = lambda at: dependencies(self.schema, *at)
        for scc in components([(kind, name)], near):
            todo = [at for at in scc if at not in self.memo]
            if not todo:
                continue
            if len(scc) == 1 and scc[0] not in near(scc[0]):
                self.memo[scc[0]] = self.rule(scc[0], self.memo, None)
            else:
                self.fixpoint(scc)
        return self.memo[(kind, name)]

    def rows(self, kind: str, name: str, spread: bool = False) -> DataFrame:
        v = self.verdicts(kind, name)
        whole = self.algebra.spread(v.whole, self.engine.universe.ids(kind)) if spread and v.whole is not None else None
        parts = [x for x in (v.rows, whole) if x is not None]
        if not parts:
            return self.nothing()
        return self.algebra.merge(self.algebra.stack(*parts), "skey", "rid") if len(parts) > 1 else parts[0]

    def nothing(self) -> DataFrame:
        extra = [F.array().cast("array<string>").alias("m")] if self.algebra.conditional else []
        return self.subjects.select("skey", F.lit(None).cast("string").alias("rid"), F.lit(0).cast("tinyint").alias("v"), *extra).where(F.lit(False))

    # -- edges

    def edges(self, kind: str, rel: Relation, only: list | None = None) -> DataFrame | None:
        """(rid, st, si, sr, v[, m]) of a relation: its admitted, live tuples, or its column."""
        key = (kind, rel.name, tuple(only or ()), self.algebra.conditional, self.narrowed)
        if key not in self._edges:
            self._edges[key] = self._read(kind, rel, only)
        return self._edges[key]

    def _read(self, kind: str, rel: Relation, only: list | None) -> DataFrame | None:
        engine, parts = self.engine, []
        extra = [F.array().cast("array<string>").alias("m")] if self.algebra.conditional else []
        yes = F.lit(2).cast("tinyint").alias("v")
        if rel.backing and rel.backing.kind == "field":
            e = engine.universe.column_edges(kind, rel.backing.value)
            parts.append(e.select("rid", F.lit(rel.admits[0].type).alias("st"), F.col("subject_id").alias("si"), F.lit("").alias("sr"), yes, *extra))
        elif not rel.backing:
            test = F.lit(False)
            for a in only or rel.admits:
                test = test | admits(a)
            e = engine.store.df.where((F.col("resource_type") == kind) & (F.col("relation") == rel.name) & test)
            if engine.now is not None:
                e = e.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(engine.now).cast("timestamp_ntz")))
            if self.waits(kind, rel.name):  # until the request is known
                v, m = yes, F.array().cast("array<string>")
            else:
                v, m = self.tuple_verdict(kind, rel.name, None)
            waiting = ["caveat_name", "caveat_context"] if self.waits(kind, rel.name) else []
            parts.append(e.select(F.col("resource_id").alias("rid"), F.col("subject_type").alias("st"), F.col("subject_id").alias("si"), F.col("subject_relation").alias("sr"), v.alias("v"), *([m.alias("m")] if extra else []), *waiting).where("v > 0"))
        if engine.overlay is not None:
            test = F.lit(False)
            for a in only or rel.admits:
                test = test | admits(a)
            o = engine.overlay.where((F.col("resource_type") == kind) & (F.col("relation") == rel.name) & test)
            waiting = [F.lit("").alias("caveat_name"), F.lit(None).cast("string").alias("caveat_context")] if self.waits(kind, rel.name) else []
            parts.append(o.select(F.col("resource_id").alias("rid"), F.col("subject_type").alias("st"), F.col("subject_id").alias("si"), F.col("subject_relation").alias("sr"), yes, *extra, *waiting))
        out = self.algebra.stack(*parts)
        if out is not None and kind in self.targets and (self.narrowed or self.is_top(kind)):
            out = out.join(self.targets[kind], "rid", "left_semi")
        return out

    def is_asked(self, kind: str) -> bool:
        """Whether only known pairs of subject and object of the type matter."""
        return kind in self.pairs and self.is_top(kind)

    def waits(self, kind: str, relation: str) -> bool:
        """Whether a relation's caveats are judged once an edge has met a request, as each has a context of its own."""
        return self.own_context and (kind, relation) in self.engine.caveated()

    def settle(self, joined: DataFrame, kind: str, relation: str, v: str, m: str) -> DataFrame:
        """joined, edges with the requests' keys, with the verdicts of caveats that waited for them."""
        if not self.waits(kind, relation):
            return joined
        cv, cm = self.tuple_verdict(kind, relation, F.substring_index(F.col("skey"), WITH, -1))
        return joined.withColumns({"_cv": cv, "_cm": cm}).withColumns({v: F.least(F.col(v), F.col("_cv")), m: F.array_distinct(F.concat(F.col(m), F.col("_cm")))}).where(F.col(v) > 0).drop("_cv", "_cm", "caveat_name", "caveat_context")

    def narrow(self, asked: list[tuple[str, str]]) -> None:
        """Makes targets of all types in reach: the requested objects and, following edges up, those whose verdicts theirs may come from.

        A fixpoint of its own, a written table a hop, as far as the hops that count go. Only ids are kept, and a hop reads only the edges
        of the types that the one before has reached. Types of which nothing is reached have no targets, and nothing of them is read.
        """
        links, consts = {}, set()
        for t, n in dict.fromkeys(x for at in asked for x in reachable(self.schema, *at)):
            d = self.schema.definition(t)
            if rel := d.relation(n):
                links |= {(t, rel.name, x, x.type): None for x in rel.admits if x.relation and not rel.backing and defined(self.schema, x.type, x.relation)}
            for x in leaves(d.permission(n).expr) if d.permission(n) else ():
                if isinstance(x, Hop) and (via := d.relation(x.via)):
                    if via.backing and via.backing.kind == "const":
                        consts.add((via.admits[0].type, via.backing.value))
                    else:
                        links |= {(t, via.name, a, a.type): None for a in via.admits if defined(self.schema, a.type, x.target)}
        if not links and not consts:  # what is asked narrows enough
            return
        self.rounds = self.rounds or self.engine.rounds()
        start = [ids.select(F.lit(t).alias("kind"), "rid") for t, ids in self.targets.items()]
        if consts:
            start.append(self.engine.spark.createDataFrame(sorted(consts), "kind string, rid string"))
        self.targets = {}
        seen = self.rounds.save(self.algebra.stack(*start).distinct(), "asked")
        kinds = {t for at in asked for t, _ in reachable(self.schema, *at)}
        fresh, hops, there = seen, 0, {t for t, _ in asked} | {t for t, _ in consts}
        most = self.engine.config.max_hops
        while links and (most is None or hops <= most + 1):
            here = dict(fresh.groupBy("kind").count().collect())  # a row a type
            there |= set(here)
            at = {t: fresh.where(F.col("kind") == t).select("rid") for t in here}
            at = {t: F.broadcast(ids) if here[t] <= BROADCAST else ids for t, ids in at.items()}
            found = [self.edges(t, self.schema.definition(t).relation(n), [x]).join(at[t], "rid", "left_semi").select(F.lit(to).alias("kind"), F.col("si").alias("rid")) for t, n, x, to in links if t in at]
            if not found:
                break
            fresh, hops = self.rounds.save(self.algebra.stack(*found).distinct().join(seen, ["kind", "rid"], "left_anti"), "reached"), hops + 1
            seen = seen.unionByName(fresh)
        else:
            there = kinds
        self.targets, self.narrowed = {t: seen.where(F.col("kind") == t).select("rid") for t in kinds & there}, True

    def is_top(self, kind: str) -> bool:
        """Whether no hop or user set in reach of what is wanted leads into the type, so that only requested objects of it matter."""
        if self._tops is None or self._tops[0] != self.wanted:
            self._tops = list(self.wanted), self.entered()
        return kind not in self._tops[1]

    def entered(self) -> set[str]:
        """The types that hops or user sets lead into: any of the schema's, or those in reach of what is wanted."""
        every = [(d.type, x.name) for d in self.schema.definitions for x in (*d.relations, *d.permissions)]
        out = set()
        for t, n in {x for at in self.wanted for x in self.reads(*at)} if self.wanted else every:
            d = self.schema.definition(t)
            if rel := d.relation(n):
                out |= {a.type for a in rel.admits if a.relation}
            for x in leaves(d.permission(n).expr) if d.permission(n) else ():
                if isinstance(x, Hop) and (via := d.relation(x.via)):
                    out |= {a.type for a in via.admits if defined(self.schema, a.type, x.target)}
        return out

    def tuple_verdict(self, kind: str, relation: str, request: Column | None) -> tuple[Column, Column]:
        """A tuple's own verdict: 2 without a caveat, 0 with an unknown one. request: the JSON context of a request, where each has its own."""
        none = F.array().cast("array<string>")
        if (kind, relation) not in self.engine.caveated():
            return F.lit(2).cast("tinyint") if self.schema.caveats else F.when(F.col("caveat_name") == "", 2).otherwise(0).cast("tinyint"), none
        v, m = F.when(F.col("caveat_name") == "", F.lit(2).cast("tinyint")), F.when(F.col("caveat_name") == "", none)
        for c in self.schema.caveats:
            cv, cm = cel.verdict(c, F.col("caveat_context"), self.context, request, self.engine.config.caveat_errors)
            v, m = v.when(F.col("caveat_name") == c.name, cv), m.when(F.col("caveat_name") == c.name, cm)
        return v.otherwise(F.lit(0).cast("tinyint")), m.otherwise(none)

    # -- rules

    def rule(self, at: tuple[str, str], env: Mapping, delta: Mapping | None) -> Verdicts:
        """What a node's definition gives from env; with delta, what the new verdicts of its component add."""
        d = self.schema.definition(at[0])
        if perm := d.permission(at[1]):
            return self.expr(at[0], perm.expr, env, delta)
        return self.relation(at[0], d.relation(at[1]), env, delta)

    def relation(self, kind: str, rel: Relation, env: Mapping, delta: Mapping | None) -> Verdicts:
        a = self.algebra
        if rel.backing and rel.backing.kind == "const":
            if delta is not None:
                return Verdicts()
            held = self.subjects.where((F.col("subject_type") == rel.admits[0].type) & (F.col("subject_id") == rel.backing.value) & (F.col("subject_relation") == ""))
            return Verdicts(None, self.constant(held))
        if self.narrowed and kind not in self.targets:
            return Verdicts()
        parts: list[DataFrame] = []
        if delta is None:
            edges = self.edges(kind, rel)
            if self.literals is not None and len(self.literals) <= LITERALS:
                ids = sorted({s.id for s in self.literals} | {"*"})
                edges = edges.where(F.col("si").isin(ids))
            who = self.subjects.select("skey", F.col("subject_type").alias("st"), F.col("subject_id").alias("si"), F.col("subject_relation").alias("sr"))
            wild = [x for x in rel.admits if x.wildcard]
            public = self.edges(kind, rel, wild) if wild else None
            alone = (F.col("sr") == "") & (F.col("si") != "*")
            if self.names_only:
                found = [edges.join(who, ["st", "si", "sr"])]
            elif self.is_asked(kind):  # edges meet the requests on both ends at once
                askers = self.pairs[kind].join(who, "skey")
                found = [edges.join(askers, ["rid", "st", "si", "sr"])]
                if wild:
                    found.append(public.drop("si", "sr").join(askers.where(alone).select("skey", "rid", "st"), ["rid", "st"]))
            else:
                found = [edges.join(who, ["st", "si", "sr"])]
                # the rows of everyone meet every subject of their type: a product for each type, not one hot key
                found += [product(public.where(F.col("st") == t), "rid", who.where((F.col("st") == t) & alone).select("skey")) for t in dict.fromkeys(x.type for x in wild)]
            parts += [self.settle(x, kind, rel.name, "v", "m").select("skey", "rid", "v", *a.extra) for x in found]
        for x in rel.admits:
            if self.names_only or not self.is_userset(x):
                continue
            source = (delta if delta is not None else env).get((x.type, x.relation))
            if source is not None:
                parts += self.followed(kind, rel, self.edges(kind, rel, [x]), source)
        return Verdicts(a.merge(a.stack(*parts), "skey", "rid")) if parts else Verdicts()

    def is_userset(self, x) -> bool:
        """Whether the subjects of a user set that a relation admits count."""
        if not x.relation or not defined(self.schema, x.type, x.relation):
            return False
        return not self.engine.config.usersets_are_relations_only or self.schema.definition(x.type).relation(x.relation) is not None

    def by_names(self, kind: str, name: str, overlay: bool = False) -> Named | None:
        """The permission by the names in tuples, if it can be told so and user sets or `*` make that worth while. overlay: also if there are virtual tuples."""
        if not defined(self.schema, kind, name) or self.literals is not None or self.narrowed or self.engine.overlay is not None and not overlay:
            return None
        self.prepare(kind, name)
        if self.algebra.conditional:
            return None
        by = Named(self, kind)
        return by if by.build(name) else None

    def constant(self, held: DataFrame) -> DataFrame:
        extra = [F.array().cast("array<string>").alias("m")] if self.algebra.conditional else []
        return held.select("skey", F.lit(2).cast("tinyint").alias("v"), *extra)

    def follow(self, kind: str, rel: Relation, edges: DataFrame, target: Verdicts) -> Verdicts:
        """Verdicts of the objects at the near end of edges, from those of the far end."""
        parts = self.followed(kind, rel, edges, target)
        return Verdicts(self.algebra.merge(self.algebra.stack(*parts), "skey", "rid")) if parts else Verdicts()

    def followed(self, kind: str, rel: Relation, edges: DataFrame, target: Verdicts) -> list[DataFrame]:
        """The rows of follow(), each derivation its own, so that whoever has more of them merges all at once."""
        a, parts = self.algebra, []
        edges = edges.withColumnsRenamed({"rid": "near", "v": "ev", "m": "em"})
        for df, whole in ((target.rows, False), (target.whole, True)):
            if df is None:
                continue
            if self.is_asked(kind):
                both = edges.join(self.pairs[kind].withColumnRenamed("rid", "near"), "near")
                j = both.join(df, "skey") if whole else both.join(df.withColumnRenamed("rid", "si"), ["si", "skey"])
            else:
                j = product(edges, "near", df) if whole else edges.join(df, edges["si"] == df["rid"])
            j = self.settle(j, kind, rel.name, "ev", "em")
            v = and3(F.col("ev"), F.col("v")).alias("v")
            m = [F.array_sort(F.array_distinct(F.concat("em", "m"))).alias("m")] if a.conditional else []
            parts.append(j.select("skey", F.col("near").alias("rid"), v, *m))
        return parts

    def expr(self, kind: str, expr: Expr, env: Mapping, delta: Mapping | None) -> Verdicts:
        a = self.algebra
        if isinstance(expr, Nothing):
            return Verdicts()
        if isinstance(expr, Name):
            return self.name(kind, expr.name, env, delta)
        if isinstance(expr, Hop):
            return self.hop(kind, expr, env, delta)
        left = lambda d: self.expr(kind, expr.left, env, d)
        right = lambda d: self.expr(kind, expr.right, env, d)
        if expr.op == "+":
            return a.union(left(delta), right(delta))
        if expr.op == "&":
            if delta is None:
                for few, other in ((expr.left, expr.right), (expr.right, expr.left)):
                    if env is self.memo and (met := self.met(kind, few, other)):
                        return met
                return a.intersection(left(None), right(None))
            return a.union(a.intersection(left(delta), right(None)), a.intersection(left(None), right(delta)))
        return a.exclusion(left(delta), right(None), lambda: self.engine.universe.ids(kind))

    def met(self, kind: str, few: Expr, other: Expr) -> Verdicts | None:
        """few & other, where few comes from tuples that name their subject, so it has no more rows than they: of other only its pairs are worked out.

        None where that does not hold, or where verdicts of the type's other objects are needed on the way.
        """
        if self.algebra.conditional or self.literals is not None or self.pairs or not self.direct(kind, few) or self.direct(kind, other):
            return None
        sub = Evaluation(self.engine, self.subjects, self.context, self.targets, None)
        sub.own_context = self.own_context
        sub.memo = {at: v for at, v in self.memo.items() if at[0] != kind}
        for x in leaves(other):
            if isinstance(x, Hop):
                types = {a.type for a in self.schema.definition(kind).relation(x.via).admits}
                if kind in types:
                    return None
                sub.wanted += [(t, x.target) for t in types if defined(self.schema, t, x.target)]
            elif x.name not in BUILTINS:
                sub.wanted.append((kind, x.name))
        if not sub.wanted or not sub.is_top(kind):
            return None
        self.rounds = self.rounds or self.engine.rounds()
        rows = self.rounds.save(self.expr(kind, few, self.memo, None).rows, "few")
        sub.pairs = {kind: rows.select("skey", "rid")}
        env = sub.memo | {at: sub.verdicts(*at) for at in sub.wanted}
        return self.algebra.intersection(Verdicts(rows), sub.expr(kind, other, env, None))

    def direct(self, kind: str, expr: Expr) -> bool:
        """Whether an expression's rows come from tuples that name their subject, one by one."""
        if isinstance(expr, Combine):
            left, right = self.direct(kind, expr.left), self.direct(kind, expr.right)
            return left if expr.op == "-" else left or right if expr.op == "&" else left and right
        if not isinstance(expr, Name) or expr.name in BUILTINS:
            return False
        d = self.schema.definition(kind)
        rel = d.relation(expr.name)
        return bool(rel and not d.permission(expr.name) and not rel.backing and not any(x.relation or x.wildcard for x in rel.admits))

    def name(self, kind: str, name: str, env: Mapping, delta: Mapping | None) -> Verdicts:
        if name in BUILTINS:
            return Verdicts() if delta is not None else Verdicts(None, self.constant(self.subjects.where(self.builtin(name))))
        if delta is not None:
            return delta.get((kind, name), Verdicts())
        return env.get((kind, name), Verdicts())

    def builtin(self, name: str) -> Column:
        anonymous = (F.col("subject_type") == self.engine.config.anonymous_type) & (F.col("subject_id") == "*") & (F.col("subject_relation") == "")
        return anonymous if name == "anonymous" else ~anonymous & (F.col("subject_id") != "")

    def hop(self, kind: str, hop: Hop, env: Mapping, delta: Mapping | None) -> Verdicts:
        """Each admitted type that defines the target; the relation part of a subject is passed over, as is a `*` row's meaning."""
        rel = self.schema.definition(kind).relation(hop.via)
        source = delta if delta is not None else env
        if rel.backing and rel.backing.kind == "const":
            target = source.get((rel.admits[0].type, hop.target), Verdicts())
            here = [target.rows.where(F.col("rid") == rel.backing.value).drop("rid") if target.rows is not None else None, target.whole]
            return Verdicts(None, self.algebra.merge(self.algebra.stack(*here), "skey"))
        if self.narrowed and kind not in self.targets:
            return Verdicts()
        parts = []
        for t in dict.fromkeys(x.type for x in rel.admits):
            target = source.get((t, hop.target))
            if target is not None and (target.rows is not None or target.whole is not None):
                parts.append(self.follow(kind, rel, self.edges(kind, rel, [x for x in rel.admits if x.type == t]), target))
        return self.algebra.union(*parts) if parts else Verdicts()

    # -- recursion

    def fixpoint(self, scc: list[tuple[str, str]]) -> None:
        """The least fixpoint of a component: only verdicts that are new or better go on.

        Several hops are one plan, and their new verdicts one written table for the whole component, so a chain of n hops costs n / HOPS
        jobs or so. Keys and verdicts are finite, so it ends even on cyclic data and without max_hops. Each row knows how many hops away it
        was first found; beyond max_hops the setting decides.
        """
        self.stratified(scc)
        self.rounds = self.rounds or self.engine.rounds()
        found: dict[tuple[str, str], list[Verdicts]] = {at: [] for at in scc}
        delta, first, most = None, 0, self.engine.config.max_hops
        while True:
            last = first + (FIRST_HOPS if delta is None else HOPS) - 1
            env = {**self.memo, **{at: self.total(found[at]) for at in scc}}
            fresh = {at: self.rule(at, env, delta) for at in scc}
            new: dict[tuple[str, str], list[Verdicts]] = {at: [] for at in scc}
            for hop in range(first, last + 1):
                for at, v in fresh.items():
                    new[at].append(Verdicts(*(df and df.withColumn("hop", F.lit(hop)) for df in (v.rows, v.whole))))
                step = {at: v for at, v in fresh.items() if v.rows is not None or v.whole is not None}
                if hop == last or not step:
                    break
                env = {**env, **{at: self.algebra.union(*(x for x in (env[at], v) if x.rows is not None or x.whole is not None)) for at, v in step.items()}}
                fresh = {at: self.rule(at, env, step) for at in scc}
            parts = [(at, whole, df) for at in scc for whole, df in ((False, self.better([v.rows for v in new[at]], [v.rows for v in found[at]], "skey", "rid")), (True, self.better([v.whole for v in new[at]], [v.whole for v in found[at]], "skey"))) if df is not None]
            if not parts:
                break
            saved, counts = self.materialise(parts, "-".join(at[1] for at in scc), last, most)
            if any(c["over"] for c in counts.values()):
                if self.engine.config.on_exceed == "raise":
                    raise DepthExceeded(f"{', '.join(f'{t}#{x}' for t, x in scc)}: more than {most} hops")
                saved = saved.where(F.col("hop") <= most)
            delta = {}
            for at in scc:
                mine = {whole: saved.where(F.col("part") == i).drop("part", *(["rid"] if whole else [])) for i, (a, whole, _) in enumerate(parts) if a == at and i in counts}
                if mine:
                    found[at].append(Verdicts(*(df and df.drop("hop") for df in (mine.get(False), mine.get(True)))))
                    # what was found before the last hop has gone on already, unless another verdict may come of it
                    delta[at] = Verdicts(*(df and (df if self.algebra.conditional else df.where(F.col("hop") == last)).drop("hop") for df in (mine.get(False), mine.get(True))))
            if most is not None and last >= most and self.engine.config.on_exceed != "raise" or not any(c["last"] for c in counts.values()):
                break
            first = last + 1
        for at in scc:
            self.memo[at] = self.total(found[at])

    def total(self, parts: list[Verdicts]) -> Verdicts:
        """What the steps found. Without conditional verdicts no step finds what another has, so nothing need be merged."""
        if self.algebra.conditional:
            return self.algebra.union(*parts) if parts else Verdicts()
        return Verdicts(self.algebra.stack(*[p.rows for p in parts]), self.algebra.stack(*[p.whole for p in parts]))

    def better(self, new: list[DataFrame | None], old: list[DataFrame | None], *keys: str) -> DataFrame | None:
        """The part of new (with hop) that is not in old or exceeds it, one row a key."""
        new = self.algebra.merge(self.algebra.stack(*new), *keys, also=(F.min("hop").alias("hop"),))
        before = self.algebra.stack(*old)
        if new is None or before is None:
            return new
        if not self.algebra.conditional:
            return new.join(before.select(*keys), list(keys), "left_anti")
        was = self.algebra.merge(before, *keys).select(*keys, F.col("v").alias("_v"), F.col("m").alias("_m"))
        return new.join(was, list(keys), "left").where(F.col("_v").isNull() | (F.col("v") > F.col("_v")) | ((F.col("v") == 1) & (F.col("_v") == 1) & (F.size(F.array_except("m", "_m")) > 0))).drop("_v", "_m")

    def materialise(self, parts: list[tuple], name: str, last: int, most: int | None) -> tuple[DataFrame, dict[int, dict]]:
        """The written table of the parts (part, skey, rid, v[, m], hop) and, for each part that has rows, how many are of the last hop and over the most."""
        rid = lambda whole: F.lit(None).cast("string").alias("rid") if whole else F.col("rid")
        stacked = self.algebra.stack(*[df.select(F.lit(i).alias("part"), "skey", rid(whole), "v", *self.algebra.extra, "hop") for i, (_, whole, df) in enumerate(parts)])
        saved = self.rounds.save(stacked, name)
        counts = saved.groupBy("part").agg(F.count_if(F.col("hop") == last).alias("last"), (F.lit(0) if most is None else F.count_if(F.col("hop") > most)).alias("over")).collect()  # a row a part
        return saved, {r["part"]: r.asDict() for r in counts}

    def stratified(self, scc: list[tuple[str, str]]) -> None:
        members = set(scc)

        def names(kind: str, expr: Expr) -> set:
            out = set()
            for x in leaves(expr):
                if isinstance(x, Name):
                    out.add((kind, x.name))
                elif via := self.schema.definition(kind).relation(x.via):
                    out |= {(a.type, x.target) for a in via.admits}
            return out

        def walk(kind: str, expr: Expr) -> None:
            if isinstance(expr, Combine):
                if expr.op == "-" and names(kind, expr.right) & members:
                    raise SchemaError(f"{kind}: `- {expression_text(expr.right)}` depends on itself")
                walk(kind, expr.left)
                walk(kind, expr.right)

        for t, n in scc:
            if perm := self.schema.definition(t).permission(n):
                walk(t, perm.expr)

    def static_whole(self, kind: str, name: str, seen: tuple = ()) -> DataFrame | None:
        """(skey, v) of subjects that built-ins and constant hops alone give the whole type."""
        d = self.schema.definition(kind)
        perm = d.permission(name) if d else None
        return self._static(kind, perm.expr, (*seen, (kind, name))) if perm and (kind, name) not in seen else None

    def _static(self, kind: str, expr: Expr, seen: tuple) -> DataFrame | None:
        a = self.algebra
        if isinstance(expr, Combine):
            if expr.op == "-":
                return None
            left, right = self._static(kind, expr.left, seen), self._static(kind, expr.right, seen)
            if expr.op == "&":
                return a._meet(left, right, ["skey"], ["skey"])
            return a.merge(a.stack(left, right), "skey")
        if isinstance(expr, Name) and expr.name in BUILTINS:
            return self.constant(self.subjects.where(self.builtin(expr.name)))
        if isinstance(expr, Name):
            return self.static_whole(kind, expr.name, seen)
        if isinstance(expr, Hop) and (rel := self.schema.definition(kind).relation(expr.via)).backing and rel.backing.kind == "const":
            for at in [(rel.admits[0].type, expr.target)]:
                self.verdicts(*at)
            return self.hop(kind, expr, self.memo, None).whole
        return None


class Named:
    """A permission without caveats, by the subjects that tuples name: sets of names of each object, and the names of each requested subject.

    A requested subject's names are itself, `*` of its type and the user sets that it is in. The members of a group are not followed through hops one by one:
    a tree of n folders under a group costs n rows, not n a member. Requested subjects meet the sets at the end: where
    pairs are asked for, once a pair, else once a row of the answer (and name that leads to it), and no row of the answer is shuffled.
    A permission is a tree of `&` and `-` (and `+` over them) over unions of names and hops, which are unions all the way down; each union is a set.
    """

    def __init__(self, ev: Evaluation, kind: str):
        self.ev, self.schema, self.kind = ev, ev.schema, kind
        self.unions: list[Expr] = []
        self.usersets: set[tuple[str, str]] = set()
        self.wild: set[str] = set()

    def build(self, name: str) -> bool:
        """Works out the sets; False if the permission cannot be told so, or an object has more than LARGEST names."""
        ev, engine = self.ev, self.ev.engine
        self.tree = self.shape(Name(name), ())
        if self.tree is None or not self.lists(self.tree) or not (self.usersets or self.wild):
            return False
        if any((self.kind, name) in reachable(self.schema, *u) for u in self.usersets):
            return False
        held = [(t, r, ev.verdicts(t, r)) for t, r in sorted(self.usersets)]
        if any(v.whole is not None for _, _, v in held):
            return False
        alone = (F.col("subject_relation") == "") & (F.col("subject_id") != "*")
        parts = [ev.subjects.select("skey", *SUBJECT)]
        parts += [ev.subjects.where((F.col("subject_type") == t) & alone).select("skey", "subject_type", F.lit("*").alias("subject_id"), "subject_relation") for t in sorted(self.wild)]
        parts += [v.rows.select("skey", F.lit(t).alias("subject_type"), F.col("rid").alias("subject_id"), F.lit(r).alias("subject_relation")) for t, r, v in held if v.rows is not None]
        ev.rounds = ev.rounds or engine.rounds()
        held = ev.rounds.save(ev.algebra.stack(*parts).distinct(), "names")
        sub = Evaluation(engine, held.select(*SUBJECT).distinct(), ev.context, ev.targets, None)
        sub.names_only, sub.wanted = True, list(ev.wanted)
        rows = None
        for i, union in enumerate(self.unions):
            for x in leaves(union):
                at = [(a.type, x.target) for a in self.schema.definition(self.kind).relation(x.via).admits] if isinstance(x, Hop) else [(self.kind, x.name)]
                for t, n in dict.fromkeys(at):
                    sub.verdicts(t, n)
            found = sub.expr(self.kind, union, sub.memo, None).rows
            if found is not None:
                rows = ev.algebra.stack(rows, found.select(F.lit(i).alias("union"), "rid", F.col("skey").alias("name")))
        if rows is None:
            return False
        rows = ev.rounds.save(rows, "sets")
        total, most = rows.groupBy("union", "rid").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if most > LARGEST:
            return False
        self.tested = "&" in str(self.tree)  # each row that meets the sets costs tests, beside which putting equal sets together is cheap
        held = held.select("skey", subject_key(*[F.col(c) for c in SUBJECT]).alias("name")).join(rows.select("name").distinct(), "name", "left_semi")
        self.held = held = ev.rounds.save(held, "held")
        self.mine = held.groupBy("skey").agg(F.collect_list("name").alias("mine"))
        for builtin in BUILTINS:
            self.mine = self.mine.join(ev.subjects.select("skey", ev.builtin(builtin).alias(f"_{builtin}")).distinct(), "skey")
        if "&" in str(self.tree):  # the side of & whose names stand for fewer subjects leads
            rows = rows.join(held.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name")
        else:
            rows = rows.withColumn("n", F.lit(0).cast("long"))
        mine = lambda i, x: F.when(F.col("union") == i, F.col(x))
        n = range(len(self.unions))
        self.parts = min(4 * PARTS, 1 + total // PER_PART)
        self.sets = rows.repartition(self.parts, "rid").groupBy("rid").agg(*[F.sort_array(F.collect_set(mine(i, "name"))).alias(f"s{i}") for i in n], *[F.coalesce(F.sum(mine(i, "n")), F.lit(0)).alias(f"n{i}") for i in n])
        return True

    def shape(self, expr: Expr, seen: tuple) -> int | str | tuple | None:
        """The place of a union, a built-in, or (operator, left, right); None if it is none of these."""
        if self.plain(expr):
            self.unions.append(expr)
            return len(self.unions) - 1
        if isinstance(expr, Combine):
            left, right = self.shape(expr.left, seen), self.shape(expr.right, seen)
            return None if left is None or right is None else (expr.op, left, right)
        if not isinstance(expr, Name) or expr.name in seen:
            return None
        if expr.name in BUILTINS:
            return expr.name
        perm = self.schema.definition(self.kind).permission(expr.name)
        return self.shape(perm.expr, (*seen, expr.name)) if perm else None

    def plain(self, expr: Expr) -> bool:
        """Whether an expression is a union all the way down to tuples and columns. Notes the user sets and types of `*` that they name."""
        todo, seen, usersets, wild = [(self.kind, expr)], set(), set(), set()
        while todo:
            t, e = todo.pop()
            d = self.schema.definition(t)
            if isinstance(e, Combine):
                if e.op != "+":
                    return False
                todo += [(t, e.left), (t, e.right)]
            elif isinstance(e, Hop):
                via = d.relation(e.via)
                if via is None or via.backing and via.backing.kind == "const":
                    return False
                todo += [(a.type, Name(e.target)) for a in via.admits if defined(self.schema, a.type, e.target)]
            elif isinstance(e, Name) and (t, e.name) not in seen:
                seen.add((t, e.name))
                rel = d.relation(e.name)
                if e.name in BUILTINS:
                    return False
                if perm := d.permission(e.name):
                    todo.append((t, perm.expr))
                elif rel and rel.backing and rel.backing.kind == "const":
                    return False
                elif rel:
                    usersets |= {(x.type, x.relation) for x in rel.admits if self.ev.is_userset(x)}
                    wild |= {x.type for x in rel.admits if x.wildcard}
        self.usersets |= usersets
        self.wild |= wild
        return True

    def lists(self, tree) -> bool:
        """Whether all who have it are named in its sets."""
        if not isinstance(tree, tuple):
            return isinstance(tree, int)
        op, left, right = tree
        return self.lists(left) if op == "-" else self.lists(left) or self.lists(right) if op == "&" else self.lists(left) and self.lists(right)

    def holds(self, tree) -> Column:
        """Whether a subject with the names `mine` has it on the object of the sets."""
        if isinstance(tree, int):
            return F.arrays_overlap("mine", f"s{tree}")
        if isinstance(tree, str):
            return F.col(f"_{tree}")
        op, left, right = tree
        left, right = self.holds(left), self.holds(right)
        return left & ~right if op == "-" else left & right if op == "&" else left | right

    def leading(self, tree) -> tuple[Column, Column, Column | None]:
        """The names that lead to all who may have it, how many subjects they stand for, and what is to be tested of a subject whom one of them stands for."""
        if isinstance(tree, int):
            return F.col(f"s{tree}"), F.col(f"n{tree}"), None
        op, left, right = tree
        both = lambda a, b: b if a is None else a & b
        if op == "+":
            (x, n, test), (y, m, other) = self.leading(left), self.leading(right)
            return F.array_union(x, y), n + m, None if test is None and other is None else self.holds(tree)
        if op == "-" or not self.lists(right):
            x, n, test = self.leading(left)
            return x, n, both(test, ~self.holds(right) if op == "-" else self.holds(right))
        y, m, other = self.leading(right)
        if not self.lists(left):
            return y, m, both(other, self.holds(left))
        x, n, test = self.leading(left)
        return F.when(n <= m, x).otherwise(y), F.least(n, m), F.when(n <= m, both(test, self.holds(right))).otherwise(both(other, self.holds(left)))

    def never(self, tree) -> Column:
        """Whether the sets of an object let nobody have it, whatever their names."""
        if isinstance(tree, int):
            return F.size(f"s{tree}") == 0
        if isinstance(tree, str):
            return F.lit(False)
        op, left, right = tree
        left = self.never(left)
        return left if op == "-" else left | self.never(right) if op == "&" else left & self.never(right)

    def certain(self, tree) -> Column:
        """Whether all for whom a leading name stands have it, whatever other names are theirs."""
        if isinstance(tree, int):
            return F.lit(True)
        op, left, right = tree
        return self.certain(left) & self.never(right) if op == "-" else self.certain(left) & self.certain(right) if op == "+" else F.lit(False)

    def some(self) -> DataFrame:
        """(subject columns), one row each, of all who have it on some object.

        A name on an object that gives it to all whom the name stands for decides for them; only subjects without such a name
        meet the objects' sets, of which equal ones are met once.
        """
        names, _, test = self.leading(self.tree)
        sets = self.sets.select(self.certain(self.tree).alias("_sure"), *[f"{c}{i}" for c in "sn" for i in range(len(self.unions))], F.explode(names).alias("name"))
        found = self.held.join(sets.where("_sure").select("name").distinct(), "name").select("skey")
        if test is not None:
            sure = self.ev.rounds.save(found.distinct(), "sure")
            met = sets.where("not _sure").drop("_sure").distinct().join(self.held.join(sure, "skey", "left_anti"), "name").join(self.mine, "skey")
            found = sure.unionByName(met.where(test).select("skey"))
        return self.ev.subjects.select("skey", *SUBJECT).join(found.distinct(), "skey", "left_semi").select(*SUBJECT).distinct()

    def among(self, pairs: DataFrame) -> DataFrame:
        """(skey, rid, v) of the pairs that have it."""
        return pairs.join(self.sets, "rid").join(self.mine, "skey").where(self.holds(self.tree)).select("skey", "rid", F.lit(2).cast("tinyint").alias("v"))

    def answers(self, asked: DataFrame) -> DataFrame:
        """asked (resource_id and whatever else), each row with each requested subject's columns and `allowed`.

        Subjects with equal names are told at once, so a row costs a step of a join with them and no test; none is shuffled.
        """
        ev, flags = self.ev, {f"_{b}": F.coalesce(self.ev.builtin(b), F.lit(False)) for b in BUILTINS}
        mine = F.sort_array(F.coalesce("mine", F.array().cast("array<string>")))
        who = ev.subjects.select("skey", *SUBJECT).distinct().join(self.mine.select("skey", "mine"), "skey", "left").withColumns(flags | {"mine": mine})
        same = ["mine", *flags]
        groups = ev.rounds.save(who.select(*same).distinct().withColumn("_group", F.monotonically_increasing_id()), "groups")
        who = ev.rounds.save(who.join(groups, same).select("_group", *SUBJECT), "who")
        m = who.count()
        rows = asked.join(self.sets.withColumnRenamed("rid", "resource_id"), "resource_id", "left").repartition(tasks(asked.count() * m), "resource_id")
        met = product(rows, "resource_id", groups, m <= FEW).select("_group", *asked.columns, F.coalesce(self.holds(self.tree), F.lit(False)).alias("allowed"))
        if m <= FEW:
            return met.join(F.broadcast(who), "_group").drop("_group")
        who = who.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        return met.withColumn("_part", F.pmod(F.xxhash64("resource_id"), F.lit(PARTS))).join(who, ["_group", "_part"]).drop("_group", "_part")

    def alike(self, sets: DataFrame) -> DataFrame:
        """A written table of the sets, once for all objects that have equal ones, with these (rids) and the least of them: some ALIKE a row, so that no row holds very many."""
        same = [f"{c}{i}" for c in "sn" for i in range(len(self.unions))]
        many = sets.groupBy(*same).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > ALIKE)
        part = F.coalesce(F.pmod(F.xxhash64("rid"), F.ceil(F.col("_many") / ALIKE)), F.lit(0).cast("long"))
        dealt = sets.join(many, same, "left").withColumn("_share", part)
        return self.ev.rounds.save(dealt.groupBy(*same, "_share").agg(F.collect_list("rid").alias("rids")).withColumn("least", F.array_min("rids")), "alike")

    def listed(self, ids: DataFrame | None = None) -> DataFrame:
        """(subject columns, rid), one row each, of all who have it (on objects of ids). A name's row counts if no earlier name of the object is the subject's, too.

        With `&`, who has it is worked out once for all objects with equal sets. Up to MEMBERS objects are sent to all executors, as a join there is faster than explode.
        """
        sets, few = self.sets if ids is None else self.sets.join(ids, "rid", "left_semi"), False
        if self.tested:
            sets = self.alike(sets)
            members = sets.select("least", F.explode("rids").alias("rid"))
            few = members.count() <= MEMBERS
            sets = (sets.drop("rids") if few else sets).repartition(self.parts)
        names, _, test = self.leading(self.tree)
        sets = sets.withColumn("names", names).select("*", F.posexplode("names").alias("at", "name"))
        who = self.held.join(self.mine, "skey").join(self.ev.subjects.select("skey", *SUBJECT).distinct(), "skey").drop("skey")
        if self.held.count() <= FEW:
            found = sets.join(F.broadcast(who), "name")
        else:  # a name may stand for very many and be on very many objects
            who = who.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
            found = sets.withColumn("_part", F.pmod(F.xxhash64("least" if self.tested else "rid"), F.lit(PARTS))).join(who, ["name", "_part"])
        found = found.where((F.col("at") == 0) | ~F.arrays_overlap("mine", F.slice("names", F.lit(1), F.col("at"))))
        found = found if test is None else found.where(test)
        if few:
            return found.join(F.broadcast(members), "least").select(*SUBJECT, "rid")
        return found.select(*SUBJECT, F.explode("rids").alias("rid") if self.tested else F.col("rid"))


def estimate(df: DataFrame) -> int:
    """Bytes of a frame by the planner's estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def with_subject(df: DataFrame, kind: str, ident: Column, relation: str = "") -> DataFrame:
    """df with the three subject columns."""
    return df.withColumns({"subject_type": F.lit(kind), "subject_id": ident.cast("string"), "subject_relation": F.lit(relation)})


def configure(engine: Engine, **settings) -> Engine:
    return engine._copy(config=replace(engine.config, **settings))
