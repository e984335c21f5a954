"""Overrides over a baseline schema, and synchronising stored definitions with packages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, replace

from ..errors import SchemaError
from .ast import Combine, Expr, Schema
from .introspect import permission_cycles
from .parser import parse_expression, parse_schema
from .printer import admitted_text, expression_text

#: How an override of each kind joins the permission, in the order in which kinds apply.
JOINS = ((("extend", "loosen"), "+"), (("disable",), "-"), (("tighten",), "&"))


@dataclass(frozen=True)
class Override:
    """kind is extend, loosen, disable, tighten or recaveat. target is a type (with name a permission) or "" (with name a caveat)."""

    id: int
    kind: str
    target: str
    name: str
    expression: str
    created_at: str = ""
    expires_at: str | None = None


def compose(baseline: Schema, overrides: Iterable[Override], now: str | None = None) -> Schema:
    """((base + extends + loosens) - disables) & tightens for each permission, each kind by (created_at, id); the last recaveat replaces a body.

    With now, overrides that have expired by then are left out. Targets that are not in the baseline are
    passed over. A composition that adds a cycle of permissions is an error.
    """
    live = sorted((o for o in overrides if now is None or o.expires_at is None or o.expires_at > now), key=lambda o: (o.created_at, o.id))
    by: dict[tuple[str, str], list[Override]] = {}
    for o in live:
        by.setdefault((o.target, o.name), []).append(o)

    def permission(kind: str, name: str, expr: Expr) -> Expr:
        mine = by.get((kind, name), ())
        for kinds, op in JOINS:
            for o in (o for o in mine if o.kind in kinds):
                expr = Combine(op, expr, parse_expression(o.expression))
        return expr

    definitions = tuple(replace(d, permissions=tuple(replace(p, expr=permission(d.type, p.name, p.expr)) for p in d.permissions)) for d in baseline.definitions)
    caveats = tuple(replace(c, body=next((o.expression for o in reversed(by.get(("", c.name), ())) if o.kind == "recaveat"), c.body)) for c in baseline.caveats)
    out = replace(baseline, definitions=definitions, caveats=caveats)
    if new := permission_cycles(out) - permission_cycles(baseline):
        raise SchemaError(f"overrides add a cycle: {', '.join(f'{t}#{n}' for t, n in sorted(new))}")
    return out


@dataclass(frozen=True)
class Stored:
    """A row of the schema catalog: which package owns it and what was last synchronised."""

    external_id: str
    package: str
    payload: str
    content_hash: str
    no_update: bool = False


def payloads(schema: Schema) -> dict[str, str]:
    """{external id: canonical JSON} of definitions, relations, permissions and caveats."""
    out = {}
    for d in schema.definitions:
        out[f"definition:{d.type}"] = {"type": d.type}
        for r in d.relations:
            out[f"relation:{d.type}#{r.name}"] = {"admits": sorted(map(admitted_text, r.admits)), "backing": [r.backing.kind, r.backing.value] if r.backing else None}
        for p in d.permissions:
            out[f"permission:{d.type}#{p.name}"] = {"expression": expression_text(p.expr)}
    for c in schema.caveats:
        out[f"caveat:{c.name}"] = {"params": c.params, "body": c.body}
    return {k: json.dumps(v, sort_keys=True) for k, v in out.items()}


def sync(stored: Iterable[Stored], package: str, schema: Schema, overwrite: bool = False, prune: bool = True) -> tuple[list[Stored], dict[str, str]]:
    """(rows after, {external id: what was done}).

    create: new; keep: unchanged; update: the package changed it and nobody else did; drift: the row was
    edited since (its payload no longer has its hash), left alone unless overwrite; held: no_update rows;
    prune: gone from the package. A definition or caveat that another package owns is an error.
    """
    rows, wanted, did = {s.external_id: s for s in stored}, payloads(schema), {}
    for key in wanted:
        if key.split(":")[0] in ("definition", "caveat") and key in rows and rows[key].package != package:
            raise SchemaError(f"{key} belongs to package {rows[key].package}")
    for key, payload in wanted.items():
        new = Stored(key, package, payload, hashlib.sha256(payload.encode()).hexdigest())
        old = rows.get(key)
        if not old:
            did[key] = "create"
        elif old.payload == payload:
            did[key] = "keep"
        elif old.no_update:
            did[key] = "held"
        elif hashlib.sha256(old.payload.encode()).hexdigest() != old.content_hash and not overwrite:
            did[key] = "drift"
        else:
            did[key] = "update"
        if did[key] in ("create", "update"):
            rows[key] = new
    for key, old in list(rows.items()):
        if prune and old.package == package and key not in wanted:
            did[key] = "held" if old.no_update else "prune"
            if not old.no_update:
                del rows[key]
    return sorted(rows.values(), key=lambda s: s.external_id), did


def restore(stored: Iterable[Stored], overrides: Iterable[Override] = ()) -> Schema:
    """The schema that catalog rows say, whatever package owns them, with overrides applied."""
    parts: dict[str, list[str]] = {}
    caveats = []
    for row in sorted(stored, key=lambda s: s.external_id):
        what, _, name = row.external_id.partition(":")
        payload = json.loads(row.payload)
        if what == "caveat":
            caveats.append(f"caveat {name}({', '.join(f'{n} {t}' for n, t in payload['params'])}) {{ {payload['body']} }}")
            continue
        kind, _, member = name.partition("#")
        lines = parts.setdefault(kind, [])
        if what == "relation":
            backing = f" // backing:{payload['backing'][0]}={payload['backing'][1]}" if payload["backing"] else ""
            lines.append(f"relation {member}: {' | '.join(payload['admits'])}{backing}")
        elif what == "permission":
            lines.append(f"permission {member} = {payload['expression']}")
    text = "\n".join([*caveats, *(f"definition {k} {{\n" + "\n".join(lines) + "\n}" for k, lines in parts.items())])
    return compose(parse_schema(text), list(overrides))
