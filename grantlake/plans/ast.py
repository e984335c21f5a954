"""The permission schema as data. Expressions are Nothing, Name, Hop and Combine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

BUILTINS = ("anonymous", "authenticated")


@dataclass(frozen=True)
class Nothing:
    """`nil`: no one."""


@dataclass(frozen=True)
class Name:
    """A relation, a permission of the same definition, or a built-in term."""

    name: str


@dataclass(frozen=True)
class Hop:
    """`via->target`: target on whatever via points at."""

    via: str
    target: str


@dataclass(frozen=True)
class Combine:
    """op is + (or), & (and) or - (but not)."""

    op: str
    left: Expr
    right: Expr


Expr = Nothing | Name | Hop | Combine


@dataclass(frozen=True)
class Admitted:
    """A kind of subject that a relation takes: `type`, `type:*`, `type#relation`, `type:id` or `type:id#relation`."""

    type: str
    relation: str = ""
    wildcard: bool = False
    id: str = ""
    caveat: str = ""
    expires: bool = False


@dataclass(frozen=True)
class Backing:
    """kind "field": the edge is a column of the resource's table; kind "const": every row has an edge to one object."""

    kind: str
    value: str


@dataclass(frozen=True)
class Relation:
    name: str
    admits: tuple[Admitted, ...]
    backing: Backing | None = None
    expires: bool = False


@dataclass(frozen=True)
class Permission:
    name: str
    expr: Expr


@dataclass(frozen=True)
class Definition:
    type: str
    relations: tuple[Relation, ...] = ()
    permissions: tuple[Permission, ...] = ()

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name == name), None)

    def permission(self, name: str) -> Permission | None:
        return next((p for p in self.permissions if p.name == name), None)


@dataclass(frozen=True)
class Caveat:
    name: str
    params: tuple[tuple[str, str], ...]
    body: str


@dataclass(frozen=True)
class Schema:
    definitions: tuple[Definition, ...] = ()
    caveats: tuple[Caveat, ...] = ()
    uses: tuple[str, ...] = ()
    headers: tuple[tuple[str, str], ...] = field(default=())

    def definition(self, kind: str) -> Definition | None:
        return next((d for d in self.definitions if d.type == kind), None)

    def caveat(self, name: str) -> Caveat | None:
        return next((c for c in self.caveats if c.name == name), None)


def leaves(expr: Expr) -> Iterator[Name | Hop]:
    """The names and hops of an expression, left to right."""
    if isinstance(expr, Combine):
        yield from leaves(expr.left)
        yield from leaves(expr.right)
    elif not isinstance(expr, Nothing):
        yield expr
