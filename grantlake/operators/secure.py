"""DataFrames that only show what an actor may see: row scope, column redaction, guarded writes and joins."""

from __future__ import annotations

import inspect
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DepthExceeded, MissingActor, PermissionDenied, SchemaError
from ..plans.introspect import field_gates
from ..refs import SubjectRef, agent_grant, subject_ref
from .actors import allow_bypass, current_actor, current_bypass
from .engine import SUBJECT, Engine

#: Action of a framework's permission code names and of a row's life.
CODENAMES = {"view": "read", "change": "write", "delete": "delete", "add": "create"}


def codename_to_action(codename: str) -> str:
    """`app.change_thing` or `change_thing` to write; an unknown verb stands for itself."""
    verb = codename.rpartition(".")[2].partition("_")[0]
    return CODENAMES.get(verb, verb)


@dataclass(frozen=True)
class SecuredFrame:
    """Rows of a registered type as seen by one actor. Immutable; every method that narrows returns another frame.

    The scope is a semi-join with a plan, never a list of ids on the driver; it vanishes where the schema
    alone gives the actor the whole type.
    """

    engine: Engine
    type: str
    df: DataFrame
    actor: SubjectRef | None = None
    action: str = "read"
    unscoped_for: str | None = None
    mode: str = ""
    context: tuple[tuple[str, object], ...] = ()

    @classmethod
    def of(cls, engine: Engine, kind: str, df: DataFrame | None = None) -> SecuredFrame:
        return cls(engine, kind, engine.universe.get(kind).df if df is None else df)

    # -- who and how

    def with_actor(self, actor: SubjectRef | str) -> SecuredFrame:
        return replace(self, actor=actor if isinstance(actor, SubjectRef) else SubjectRef.parse(actor), unscoped_for=None)

    def as_user(self, user_id) -> SecuredFrame:
        return self.with_actor(SubjectRef(self.engine.config.user_type, str(user_id)))

    def as_member(self, group_id) -> SecuredFrame:
        """As any member of a group."""
        return self.with_actor(subject_ref(self.engine.config, self.engine.config.group_type, group_id))

    def as_agent(self, user_id, agent_id) -> SecuredFrame:
        """As an agent that a user let act."""
        return self.with_actor(agent_grant(str(user_id), str(agent_id)))

    def with_action(self, action: str) -> SecuredFrame:
        if not action:
            raise ValueError("an action is needed")
        return replace(self, action=action)

    def with_context(self, context: Mapping) -> SecuredFrame:
        return replace(self, context=tuple(sorted(context.items())))

    def unscoped(self, reason: str = "") -> SecuredFrame:
        """Without row scope or redaction: the configuration may forbid it, or ask for a reason."""
        allow_bypass(self.engine, reason)
        return self._unscoped(reason or "-")

    def system(self, reason: str) -> SecuredFrame:
        """As unscoped, for the engine's own work: not forbidden by allow_unscoped."""
        return self._unscoped(reason)

    def _unscoped(self, reason: str) -> SecuredFrame:
        if self.engine.trail:
            self.engine.trail.bypass(self.actor or current_actor(), reason)
        return replace(self, unscoped_for=reason, actor=None)

    def redact(self, mode: str) -> SecuredFrame:
        return replace(self, mode=mode)

    def for_write(self) -> SecuredFrame:
        """Row scope for writing, no redaction, so that no redacted null is ever written back."""
        return replace(self, action="write", mode="allow")

    def where(self, test: Column | str) -> SecuredFrame:
        return replace(self, df=self.df.where(test))

    # -- reading

    @property
    def id(self) -> str:
        return self.engine.universe.get(self.type).id_column

    def _key(self) -> Column:
        return F.col(self.id).cast("string")

    def who(self) -> SubjectRef | None:
        """The actor in effect: the frame's own, or the ambient one."""
        return self.actor or current_actor()

    def _open(self) -> bool:
        """Whether rows go unscoped. The frame's own bypass comes first, then its actor, an ambient bypass, an ambient actor."""
        if self.unscoped_for is not None:
            return True
        if self.actor is not None:
            return False
        if current_bypass() is not None:
            return True
        if current_actor() is not None:
            return False
        if self.engine.config.strict:
            raise MissingActor(f"{self.type}: with_actor() or unscoped() first")
        return True

    def _mode(self) -> str:
        return self.mode or self.engine.config.redact_mode

    def _hidden_columns(self) -> set[str]:
        """Gated columns, where redaction is on."""
        return set() if self._mode() == "allow" or self._open() else set(self.gates())

    def allowed_ids(self, action: str | None = None, conditional: bool = False) -> DataFrame:
        """(_rid) that the actor has the action on."""
        found = self.engine.accessible([self.who()], action or self.action, self.type, dict(self.context), conditional)
        return found.select(F.col("resource_id").alias("_rid")).distinct()

    def _rows(self) -> DataFrame:
        """The rows in scope, all columns as they are."""
        if self._open():
            return self.df
        if self.engine.grants_all([self.who()], self.action, self.type).first()["grants_all"]:
            return self.df
        ids = self.allowed_ids()
        return self.df.join(ids, self._key() == ids["_rid"], "left_semi")

    def scoped(self) -> DataFrame:
        """The rows in scope, all columns as they are. Where redaction is on, gated columns are not handed out: to_df() has them redacted."""
        self._refuse(self.df.columns)
        return self._rows()

    def _refuse(self, columns) -> None:
        if bad := sorted(set(columns) & self._hidden_columns()):
            raise PermissionDenied(f"{self.type}: {', '.join(bad)} are gated (read__ permissions); read them with to_df()")

    def gates(self, verb: str = "read") -> dict[str, str]:
        d = self.engine.schema.definition(self.type)
        return {c: p for c, p in field_gates(d, verb).items() if c in self.df.columns} if d else {}

    def to_df(self) -> DataFrame:
        """Rows in scope; gated columns are shown, nulled ("redact", "raise") or nulled and named in _omitted ("omit")."""
        mode, rows = self._mode(), self._rows()
        gates = {} if mode == "allow" or self._open() else self.gates()
        hidden = {}
        for column, permission in sorted(gates.items()):
            ids = self.allowed_ids(permission, self.engine.config.conditional_visible).withColumn(f"_see_{column}", F.lit(True))
            rows = rows.join(ids, F.col(self.id).cast("string") == ids["_rid"], "left").drop("_rid")
            hidden[column] = F.col(f"_see_{column}").isNull()
        out = [F.when(~hidden[c], F.col(c)).alias(c) if c in hidden else F.col(c) for c in self.df.columns]
        if mode == "omit":
            names = F.filter(F.array(*[F.when(h, F.lit(c)) for c, h in sorted(hidden.items())]), lambda x: x.isNotNull()) if hidden else F.array()
            out.append(names.cast("array<string>").alias("_omitted"))
        return rows.select(*out)

    def select(self, *columns: str) -> DataFrame:
        """Columns of rows in scope. Where redaction is on, a gated column may not be projected past it."""
        self._refuse(columns)
        return self._rows().select(*columns)

    def count(self) -> int:
        return self._rows().count()

    def exists(self) -> bool:
        return self._rows().limit(1).count() > 0

    def group_by(self, *columns):
        """An ordinary aggregation above the scope. Where redaction is on, gated columns can neither be grouped by nor aggregated."""
        hidden = self._hidden_columns()
        self._refuse(c for c in columns if isinstance(c, str))
        return self._rows().drop(*hidden).groupBy(*columns)

    def denied_fields(self) -> DataFrame:
        """(id, field) of the gated columns that the actor may not read, of rows in scope."""
        out = None
        for column, permission in sorted(self.gates().items()):
            ids = self.allowed_ids(permission, self.engine.config.conditional_visible)
            part = self._rows().join(ids, self._key() == ids["_rid"], "left_anti").select(self.id, F.lit(column).alias("field"))
            out = part if out is None else out.unionByName(part)
        return self.df.select(self.id, F.lit("").alias("field")).where(F.lit(False)) if out is None else out

    # -- writing

    def denied(self, action: str, rows: DataFrame | None = None) -> DataFrame:
        """(id) of rows that the actor may not do the action on."""
        ids = self.allowed_ids(action)
        rows = self.df if rows is None else rows
        return rows.join(ids, F.col(self.id).cast("string") == ids["_rid"], "left_anti").select(F.col(self.id).cast("string").alias("id")).distinct()

    def guard(self, action: str, rows: DataFrame | None = None) -> None:
        """All or nothing: an error that names five of the rows that are not allowed, if any is."""
        if self._open():
            return
        denied = self.denied(action, rows)
        bad = [r[0] for r in denied.orderBy("id").limit(5).collect()]
        if bad:
            if self.engine.config.audit_denials and self.engine.trail:
                who = self.who()
                self.engine.trail.denied(denied.select(F.lit(who.type).alias("subject_type"), F.lit(who.id).alias("subject_id"), F.lit(self.type).alias("resource_type"), F.col("id").alias("resource_id"), F.lit(action).alias("action"), F.lit(False).alias("allowed"), F.lit("").alias("reason")))
            raise PermissionDenied(f"{self.who()} may not {action} {self.type}: {', '.join(bad)}")

    def update(self, values: Mapping[str, Column]) -> DataFrame:
        """The table's rows with new values; needs write, and write__<column> for gated ones, on every row."""
        gates = self.gates("write")
        for action in ["write", *[gates[c] for c in values if c in gates]]:
            self.guard(action)
        return self.df.withColumns(dict(values))

    def delete(self, table: DataFrame) -> DataFrame:
        """table without these rows; needs delete on every one."""
        self.guard("delete")
        gone = self.df.select(self._key().alias("_gone")).distinct()
        return table.join(gone, table[self.id].cast("string") == gone["_gone"], "left_anti")

    def save(self, changed: DataFrame) -> DataFrame:
        """The rows to write for changed rows of the same columns: new ones need create, changed ones write, and write__<column> for what changed.

        Where redaction is on, a column that the actor may not read on a row keeps its old value if it comes back null, and may
        not be given another. An id may come once; a null id is a new row's.
        """
        if self._open():
            return changed
        names = list(self.df.columns)
        twice = changed.where(F.col(self.id).isNotNull()).groupBy(self.id).count().where("count > 1").orderBy(self.id).limit(5).collect()
        if twice:
            raise ValueError(f"{self.type}: {', '.join(str(r[0]) for r in twice)} come more than once")
        old = self.df.select(*[F.col(c).alias(f"_old_{c}") for c in names])
        both = changed.select(*names).join(old, F.col(self.id).cast("string") == F.col(f"_old_{self.id}").cast("string"), "left")
        known, new = both.where(F.col(f"_old_{self.id}").isNotNull()), both.where(F.col(f"_old_{self.id}").isNull()).select(*names)
        if new.limit(1).count() and not self.engine.has_access(self.who(), "create", f"{self.type}:", dict(self.context)):
            raise PermissionDenied(f"{self.who()} may not create {self.type}")
        for column in sorted(self._hidden_columns()):
            ids = self.allowed_ids(self.gates()[column], self.engine.config.conditional_visible).withColumn("_seen", F.lit(True))
            known = known.join(ids, F.col(self.id).cast("string") == ids["_rid"], "left").drop("_rid")
            hidden, kept = F.col("_seen").isNull(), F.col(f"_old_{column}")
            bad = [r[0] for r in known.where(hidden & F.col(column).isNotNull() & ~F.col(column).eqNullSafe(kept)).select(self.id).orderBy(self.id).limit(5).collect()]
            if bad:
                raise PermissionDenied(f"{self.who()} may not write {column}, which is redacted, on {self.type}: {', '.join(map(str, bad))}")
            known = known.withColumn(column, F.when(hidden, kept).otherwise(F.col(column))).drop("_seen")
        dirty = {c: ~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in names if c != self.id}
        any_dirty = F.lit(False)
        for test in dirty.values():
            any_dirty = any_dirty | test
        self.guard("write", known.where(any_dirty))
        for column, permission in self.gates("write").items():
            if column in dirty:
                self.guard(permission, known.where(dirty[column]))
        return known.select(*names).unionByName(new)

    def instance(self, ident) -> SecuredRow:
        """One row as the actor sees it."""
        return SecuredRow(self.where(F.col(self.id).cast("string") == str(ident)), str(ident))

    # -- joins

    def guarded_join(self, other: SecuredFrame, column: str) -> DataFrame:
        """Rows in scope with the row of other that column points at, as <type>__<column>; an error if any is out of other's scope. Both sides are redacted where redaction is on."""
        rows = self.to_df()
        used = other.df.join(rows.select(F.col(column).cast("string").alias("_fk")).distinct(), other._key() == F.col("_fk"), "left_semi")
        other.guard(other.action, used)
        prefix, right = other.type.rpartition("/")[2], other.to_df()
        right = right.select(*[F.col(c).alias(f"{prefix}__{c}") for c in right.columns])
        return rows.join(right, rows[column].cast("string") == right[f"{prefix}__{other.id}"].cast("string"))

    def prefetch(self, other: SecuredFrame, column: str, into: str) -> DataFrame:
        """Rows in scope with an array of the rows of other, in its scope, whose column points at them: for keys with few rows. Both sides are redacted where redaction is on.

        related() has the same rows side by side, whatever their number; prefetch_count() only counts them.
        """
        right = other.to_df()
        lists = right.groupBy(F.col(column).cast("string").alias("_fk")).agg(F.sort_array(F.collect_list(F.struct(*right.columns))).alias(into))
        return self.to_df().join(lists, self._key() == lists["_fk"], "left").drop("_fk").withColumn(into, F.coalesce(into, F.array().cast(lists.schema[into].dataType)))

    def related(self, other: SecuredFrame, column: str) -> DataFrame:
        """(row, other) structs: rows in scope beside each row of other, in its scope, whose column points at them (null if none). No key's rows are gathered in one place."""
        left, right = self.to_df(), other.to_df()
        left = left.select(self._key().alias("_id"), F.struct(*left.columns).alias("row"))
        right = right.select(F.col(column).cast("string").alias("_id"), F.struct(*right.columns).alias("other"))
        return left.join(right, "_id", "left").select("row", "other")

    def prefetch_count(self, other: SecuredFrame, column: str, into: str) -> DataFrame:
        """Rows in scope with how many rows of other, in its scope, point at them."""
        counts = other._rows().groupBy(F.col(column).cast("string").alias("_fk")).agg(F.count(F.lit(1)).alias(into))
        return self.to_df().join(counts, self._key() == counts["_fk"], "left").drop("_fk").withColumn(into, F.coalesce(into, F.lit(0)).cast("long"))


@dataclass(frozen=True)
class SecuredRow:
    """One row of a secured frame: the same verbs."""

    frame: SecuredFrame
    ident: str

    def with_actor(self, actor: SubjectRef | str) -> SecuredRow:
        return replace(self, frame=self.frame.with_actor(actor))

    def as_user(self, user_id) -> SecuredRow:
        return replace(self, frame=self.frame.as_user(user_id))

    def as_agent(self, user_id, agent_id) -> SecuredRow:
        return replace(self, frame=self.frame.as_agent(user_id, agent_id))

    def unscoped(self, reason: str = "") -> SecuredRow:
        return replace(self, frame=self.frame.unscoped(reason))

    def check(self, action: str, context: Mapping | None = None):
        """The engine's row of the check (allowed, result, conditional_on, reason)."""
        return self.frame.engine.check(self.frame.who(), action, f"{self.frame.type}:{self.ident}", dict(self.frame.context) | dict(context or {}))

    def has_access(self, action: str, context: Mapping | None = None) -> bool:
        return self.frame._open() or self.check(action, context)["allowed"]

    def get(self, mode: str | None = None):
        """The row, redacted as the mode says; None if it is out of scope or not there."""
        return (self.frame.redact(mode) if mode else self.frame).to_df().first()

    def save(self, **values) -> DataFrame:
        """The row to write with these values changed: what save() of a frame checks is checked. A redacted column cannot be named."""
        self.frame._open()
        seen = self.frame.to_df()
        return self.frame.save(seen.select(*self.frame.df.columns).withColumns({c: F.lit(v).cast(seen.schema[c].dataType) for c, v in values.items()}))

    def delete(self, table: DataFrame) -> DataFrame:
        return self.frame.delete(table)


def requires(frame: SecuredFrame, action: str, id_argument: str):
    """Decorates a function: its call needs the action on the row that an argument names."""

    def wrap(f):
        @wraps(f)
        def inner(**kwargs):
            if not frame._open() and not frame.engine.has_access(frame.who(), action, f"{frame.type}:{kwargs[id_argument]}", dict(frame.context)):
                raise PermissionDenied(f"{frame.who()} may not {action} {frame.type}:{kwargs[id_argument]}")
            return f(**kwargs)

        return inner

    return wrap


#: Actions that ask for a row that does not exist yet.
CREATE = ("create", "add")


def tool(engine: Engine, kind: str, action: str, id_argument: str | None = None, resource_id: str | None = None, relations: Mapping[str, str] | None = None):
    """Decorates a function that acts for the ambient actor: its call needs the action.

    To create, the row that does not exist yet is asked for with the edges that relations (relation: argument with a reference
    "type:id") give it; arguments that are missing, None or no reference give none. Else the row that id_argument names is asked
    for, or resource_id, or the one called *. Without an actor, or where a caveat lacks parameters, the call is denied.
    """

    def wrap(f):
        signature = inspect.signature(f)

        @wraps(f)
        def inner(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            actor = current_actor()
            if actor is None:
                raise PermissionDenied(f"{f.__name__}: nobody acts")
            if action in CREATE:
                edges = []
                for relation, argument in (relations or {}).items():
                    try:
                        ref = SubjectRef.parse(str(bound.arguments[argument])) if bound.arguments.get(argument) is not None else None
                    except ValueError:
                        ref = None
                    edges += [("0", relation, ref.type, ref.id, ref.relation)] if ref else []
                asked = engine.spark.createDataFrame([("0", actor.type, actor.id, actor.relation, action, kind)], f"id string, {', '.join(f'{c} string' for c in SUBJECT)}, action string, resource_type string")
                result, target = engine.check_new(asked, engine.spark.createDataFrame(edges, f"id string, relation string, {', '.join(f'{c} string' for c in SUBJECT)}"), narrow=engine.narrows(1 + len(edges))).first(), kind
            else:
                value = bound.arguments.get(id_argument) if id_argument else None
                target = f"{kind}:{value if value is not None else resource_id if resource_id is not None else '*'}"
                result = engine.check(actor, action, target)
            if not result["allowed"]:
                more = f" (missing: {', '.join(result['conditional_on'])})" if result["conditional_on"] else ""
                raise PermissionDenied(f"{actor} may not {action} {target}{more}")
            return f(*args, **kwargs)

        return inner

    return wrap


def has_codenames(engine: Engine, asked: DataFrame, context: Mapping | None = None) -> DataFrame:
    """asked (subject..., codename, resource_type, resource_id, is_active, is_superuser) with allowed.

    A codename such as app.view_thing stands for an action; one whose verb is unknown allows nothing here and leaves the decision to others (defers).
    Nobody inactive is allowed anything; superusers are allowed all if the configuration says so; a recursion that is too deep allows nothing.
    """
    verb = F.split_part(F.substring_index("codename", ".", -1), F.lit("_"), F.lit(1))
    known = F.create_map(*[F.lit(x) for pair in CODENAMES.items() for x in pair])
    action = F.when(F.substring_index("codename", ".", -1).contains("_"), F.try_element_at(known, verb))
    asked = asked.withColumn("_n", F.monotonically_increasing_id()).withColumn("action", F.coalesce(action, F.lit("")))
    active = F.coalesce(F.col("is_active"), F.lit(False))
    above = F.lit(engine.config.superuser_bypass) & F.coalesce(F.col("is_superuser"), F.lit(False))
    try:
        out = engine.bulk_check(asked, context)
    except DepthExceeded:
        out = asked.withColumn("allowed", F.lit(False))
    return out.withColumns({"allowed": active & (above | F.col("allowed")), "defers": active & ~above & (F.col("action") == "")}).drop("_n", "verdict", "result", "conditional_on", "reason")


def has_perms(engine: Engine, requests: DataFrame, context: Mapping | None = None) -> DataFrame:
    """(request_id, allowed) of requests of several actions: allowed if all are."""
    if "request_id" not in requests.columns:
        raise SchemaError("requests need a request_id")
    return engine.bulk_check(requests, context).groupBy("request_id").agg(F.min("allowed").alias("allowed"))


def has_any_tuple(engine: Engine, subjects: DataFrame, kinds: list[str]) -> DataFrame:
    """subjects with has_any: whether some tuple of these resource types names them. No schema walk."""
    keys = ["subject_type", "subject_id", "subject_relation"]
    named = engine.store.df.where(F.col("resource_type").isin(kinds)).select(*keys).distinct().withColumn("has_any", F.lit(True))
    return subjects.join(named, keys, "left").select(*keys, F.coalesce("has_any", F.lit(False)).alias("has_any"))
