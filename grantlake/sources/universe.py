"""Business tables behind resource types: ids, foreign-key edges, references back to rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..plans.ast import Schema


@dataclass(frozen=True)
class Table:
    type: str
    df: DataFrame
    id_column: str
    references: dict[str, str] = field(default_factory=dict)  # column -> type it points at


class Universe:
    """type -> table. Ids are compared as text."""

    def __init__(self, prefix: str = ""):
        self.prefix, self.tables = prefix, {}

    def register(self, kind: str, df: DataFrame, id_column: str, references: dict[str, str] | None = None) -> Universe:
        kind = self.prefix + kind
        if id_column not in df.columns:
            raise SchemaError(f"{kind}: no column {id_column}")
        self.tables[kind] = Table(kind, df, id_column, references or {})
        return self

    def get(self, kind: str) -> Table:
        """The table of a type, named with the prefix or without."""
        kind = kind if kind in self.tables else self.prefix + kind
        if kind not in self.tables:
            raise SchemaError(f"no table is registered for {kind}")
        return self.tables[kind]

    def ids(self, kind: str) -> DataFrame:
        """(rid) of every row."""
        t = self.get(kind)
        return t.df.select(F.col(t.id_column).cast("string").alias("rid")).where("rid is not null").distinct()

    def id_type(self, kind: str) -> str:
        t = self.get(kind)
        return dict(t.df.dtypes)[t.id_column]

    def column_edges(self, kind: str, column: str) -> DataFrame:
        """(rid, subject_id) of the rows whose column is not null."""
        t = self.get(kind)
        return t.df.where(F.col(column).isNotNull()).select(F.col(t.id_column).cast("string").alias("rid"), F.col(column).cast("string").alias("subject_id"))

    def resolve(self, refs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        """The rows that refs (subject_type, subject_id) name, with both columns in front; refs without a row are left out."""
        out = None
        for kind in kinds or sorted(self.tables):
            t = self.get(kind)
            mine = refs.where(F.col("subject_type") == kind).select("subject_type", "subject_id").distinct()
            part = mine.join(t.df, mine["subject_id"] == t.df[t.id_column].cast("string"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def problems(self, schema: Schema) -> list[str]:
        """Backed relations without their column or table, and references between protected tables (which unscoped joins would cross)."""
        out = []
        for d in schema.definitions:
            for r in d.relations:
                if r.backing and d.type not in self.tables:
                    out.append(f"{d.type}#{r.name}: backed, but no table is registered")
                elif r.backing and r.backing.kind == "field":
                    t = self.tables[d.type]
                    if r.backing.value not in t.df.columns:
                        out.append(f"{d.type}#{r.name}: no column {r.backing.value}")
                    elif t.references.get(r.backing.value, r.admits[0].type) != r.admits[0].type:
                        out.append(f"{d.type}#{r.name}: column {r.backing.value} points at {t.references[r.backing.value]}")
        for t in self.tables.values():
            out += [f"{t.type}.{c} points at {to}: joins need a guarded join or a scoped prefetch" for c, to in sorted(t.references.items()) if to in self.tables and schema.definition(to) and schema.definition(t.type)]
        return out


def object_ref(kind: str, ident: Column, prefix: str = "") -> Column:
    """An object as a struct (type, id); the prefix is that of the universe."""
    return F.struct(F.lit(prefix + kind).alias("type"), ident.cast("string").alias("id"))


def agent_subject_id(user: Column, agent: Column) -> Column:
    return F.concat_ws(".", user.cast("string"), agent.cast("string"))
