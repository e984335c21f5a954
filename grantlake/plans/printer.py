"""The canonical text of a schema: sorted, every combination in parentheses, backing kept, equal for equal schemas."""

from __future__ import annotations

import hashlib

from .ast import Admitted, Combine, Expr, Hop, Nothing, Schema


def expression_text(expr: Expr) -> str:
    if isinstance(expr, Nothing):
        return "nil"
    if isinstance(expr, Hop):
        return f"{expr.via}->{expr.target}"
    if isinstance(expr, Combine):
        return f"({expression_text(expr.left)} {expr.op} {expression_text(expr.right)})"
    return expr.name


def admitted_text(a: Admitted) -> str:
    text = a.type + (":*" if a.wildcard else f":{a.id}" if a.id else "") + (f"#{a.relation}" if a.relation else "")
    extra = [x for x in (a.caveat, "expiration" if a.expires else "") if x]
    return text + (f" with {' and '.join(extra)}" if extra else "")


def schema_text(schema: Schema) -> str:
    out = []
    for c in sorted(schema.caveats, key=lambda c: c.name):
        out.append(f"caveat {c.name}({', '.join(f'{p} {k}' for p, k in c.params)}) {{\n    {c.body}\n}}\n")
    for d in sorted(schema.definitions, key=lambda d: d.type):
        lines = []
        for r in sorted(d.relations, key=lambda r: r.name):
            mark = f" // backing:{r.backing.kind}={r.backing.value}" if r.backing else ""
            lines.append(f"    relation {r.name}: {' | '.join(sorted(map(admitted_text, r.admits)))}{mark}")
        lines += [f"    permission {p.name} = {expression_text(p.expr)}" for p in sorted(d.permissions, key=lambda p: p.name)]
        out.append(f"definition {d.type} {{\n" + "\n".join(lines) + "\n}\n")
    body = "\n".join(out)
    return f"// content: sha256:{hashlib.sha256(body.encode()).hexdigest()}\n\n{body}"
