"""Caveat expressions (a subset of CEL) compiled to Catalyst columns: no UDF runs."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CaveatUnsupported
from ..plans.ast import Caveat

TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[uU]?)|(?P<str>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<id>[A-Za-z_]\w*)|(?P<op>\|\||&&|[<>=!]=|[-+*/%<>!?:.,()\[\]]))")
BINDING = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
#: How a parameter of each type is read from JSON text.
TYPES = {"int": "bigint", "uint": "decimal(20,0)", "double": "double", "float": "double", "bool": "boolean", "string": "string", "bytes": "binary", "timestamp": "timestamp"}
UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


@lru_cache(maxsize=256)
def parse(body: str) -> tuple:
    """A tree of tuples: ("lit", v), ("var", name), ("list", items), ("call", name, args), ("field", x, name), ("index", x, i), ("if", c, a, b), (op, ...)."""
    tokens, at = [], 0
    body = body.strip()
    while at < len(body):
        m = TOKEN.match(body, at)
        if not m:
            raise CaveatUnsupported(f"cannot read {body[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    place = 0

    def peek():
        return tokens[place] if place < len(tokens) else ("", "")

    def take(text=None):
        nonlocal place
        kind, value = peek()
        if not kind or text is not None and value != text:
            raise CaveatUnsupported(f"expected {text or 'more'}, found {value!r} in {body!r}")
        place += 1
        return kind, value

    def items(close):
        out = []
        while peek()[1] != close:
            out.append(expression())
            if peek()[1] == ",":
                take()
        take(close)
        return tuple(out)

    def primary():
        kind, value = take()
        if value == "(":
            x = expression()
            take(")")
        elif value == "[":
            x = ("list", items("]"))
        elif value in ("!", "-"):
            x = ("not" if value == "!" else "neg", postfix(primary()))
        elif kind == "num":
            x = ("lit", float(value) if "." in value else int(value.rstrip("uU")))
        elif kind == "str":
            x = ("lit", json.loads(f'"{value[1:-1]}"') if value[0] == '"' else value[1:-1].replace("\\'", "'"))
        elif kind == "id" and value in ("true", "false", "null"):
            x = ("lit", {"true": True, "false": False, "null": None}[value])
        elif kind == "id" and peek()[1] == "(":
            take()
            x = ("call", value, items(")"))
        elif kind == "id":
            x = ("var", value)
        else:
            raise CaveatUnsupported(f"unexpected {value!r} in {body!r}")
        return postfix(x)

    def postfix(x):
        while peek()[1] in (".", "["):
            if take()[1] == "[":
                x = ("index", x, expression())
                take("]")
            else:
                name = take()[1]
                if peek()[1] == "(":
                    take()
                    x = ("call", name, (x, *items(")")))
                else:
                    x = ("field", x, name)
        return x

    def binary(least):
        left = primary()
        while BINDING.get(peek()[1], 0) >= least:
            op = take()[1]
            left = (op, left, binary(BINDING[op] + 1))
        return left

    def expression():
        test = binary(1)
        if peek()[1] != "?":
            return test
        take()
        yes = expression()
        take(":")
        return ("if", test, yes, expression())

    tree = expression()
    if place < len(tokens):
        raise CaveatUnsupported(f"unexpected {peek()[1]!r} in {body!r}")
    return tree


def seconds(text: str) -> float:
    """A duration such as 1h30m in seconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|ns|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("-"):
        raise CaveatUnsupported(f"not a duration: {text!r}")
    return (-1 if text.startswith("-") else 1) * sum(float(n) * UNITS[u] for n, u in parts)


def literal(value) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), literal(v))])
    if isinstance(value, dt.datetime):
        return F.lit(value)
    return F.lit(value)


#: Types that arithmetic orders: the result of mixed operands is the later one.
NUMBERS = ("int", "uint", "double")


def compile_tree(tree: tuple, names: Mapping[str, tuple[Column, str]]) -> tuple[Column, str]:
    """(column, type) of an expression; names: column and type of each variable. The type "dyn" stands for what only the data tell, as text."""
    kind, *rest = tree
    go = lambda x: compile_tree(x, names)
    if kind == "lit":
        value = rest[0]
        return literal(value), "null" if value is None else {bool: "bool", int: "int", float: "double", str: "string"}[type(value)]
    if kind == "var":
        return names[rest[0]]
    if kind == "list":
        items = [go(x) for x in rest[0]]
        return F.array(*[c for c, _ in items]), f"list<{items[0][1]}>" if items else "list"
    if kind == "if":
        test, yes, no = (go(x) for x in rest)
        return F.when(test[0], yes[0]).otherwise(no[0]), yes[1] if yes[1] != "null" else no[1]
    if kind == "not":
        return ~go(rest[0])[0], "bool"
    if kind == "neg":
        c, t = go(rest[0])
        return -c, t
    if kind == "field":
        return F.try_element_at(go(rest[0])[0], F.lit(rest[1])), "dyn"
    if kind == "index":
        (c, t), (i, _) = go(rest[0]), go(rest[1])
        return (F.get(c, i.cast("int")) if t.startswith("list") else F.try_element_at(c, i)), inner(t)
    if kind == "call":
        return call(rest[0], rest[1], names)
    (a, s), (b, t) = go(rest[0]), go(rest[1])
    a, s, b, t = alike(a, s, b, t)
    if kind in ("||", "&&"):
        return (a | b if kind == "||" else a & b), "bool"
    if kind == "in":
        return (F.map_contains_key(b, a) if t.startswith("map") else F.array_contains(b, a)), "bool"
    if kind in ("==", "!=", "<", "<=", ">", ">="):
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[kind], "bool"
    if kind == "+" and (s in ("string", "bytes", "dyn") or s.startswith("list")):
        return F.concat(a, b), s
    if kind == "-" and s == t == "timestamp":
        return a - b, "duration"
    if kind in "+-":
        made = ("timestamp" if "timestamp" in (s, t) else s) if "duration" in (s, t) else s
        return (F.try_add(a, b) if kind == "+" else F.try_subtract(a, b)), made
    if kind == "*":
        return F.try_multiply(a, b), s
    # division of integers is towards zero; by zero is an error, which is null here
    nonzero = F.nullif(b, F.lit(0).cast("bigint" if s != "double" else "double"))
    if kind == "%":
        return a % nonzero, s
    return (a / nonzero, s) if s == "double" else (F.call_function("div", a, nonzero), s)


def inner(kind: str) -> str:
    """The element type of a list or the value type of a map; "dyn" if it is not declared."""
    return kind[kind.index("<") + 1 : -1].split(",")[-1].strip() if "<" in kind else "dyn"


def alike(a: Column, s: str, b: Column, t: str) -> tuple[Column, str, Column, str]:
    """Operands with a common type: text from data takes the type of what it stands beside, and numbers the wider one."""
    for left in (True, False):
        mine, other = (s, t) if left else (t, s)
        if mine == "dyn" and other in TYPES:
            c = a if left else b
            c = F.try_to_timestamp(c) if other == "timestamp" else c.try_cast(TYPES[other])
            a, s, b, t = (c, other, b, t) if left else (a, s, c, other)
    if s in NUMBERS and t in NUMBERS and s != t:
        wide = NUMBERS[max(NUMBERS.index(s), NUMBERS.index(t))]
        a, b, s, t = a.try_cast(TYPES[wide]), b.try_cast(TYPES[wide]), wide, wide
    return a, s, b, t


def call(name: str, args: tuple, names: Mapping[str, tuple[Column, str]]) -> tuple[Column, str]:
    if name == "duration" and len(args) == 1 and args[0][0] == "lit":
        return F.make_dt_interval(secs=F.lit(seconds(args[0][1]))), "duration"
    made = [compile_tree(a, names) for a in args]
    kinds = [t for _, t in made]
    found = {
        ("size", 1): (lambda x: F.size(x) if kinds[0].startswith(("list", "map")) else F.octet_length(x) if kinds[0] == "bytes" else F.length(x), "int"),
        ("startsWith", 2): (lambda x, y: x.startswith(y), "bool"),
        ("endsWith", 2): (lambda x, y: x.endswith(y), "bool"),
        ("contains", 2): (lambda x, y: x.contains(y), "bool"),
        ("matches", 2): (lambda x, y: F.regexp_like(x, y), "bool"),
        ("timestamp", 1): (lambda x: x if kinds[0] == "timestamp" else F.try_to_timestamp(x), "timestamp"),
        ("int", 1): (lambda x: F.unix_timestamp(x) if kinds[0] == "timestamp" else x.try_cast("bigint"), "int"),
        ("uint", 1): (lambda x: x.try_cast(TYPES["uint"]), "uint"),
        ("double", 1): (lambda x: x.try_cast("double"), "double"),
        ("string", 1): (lambda x: x.cast("string"), "string"),
    }.get((name, len(made)))
    if not found:
        raise CaveatUnsupported(f"{name}() with {len(made)} arguments is not supported")
    column = found[0](*[c for c, _ in made])
    return (column.cast("bigint") if name == "size" else column), found[1]


def variables(tree) -> set[str]:
    if not isinstance(tree, tuple) or not tree:
        return set()
    if tree[0] == "var":
        return {tree[1]}
    return set().union(*(variables(x) for x in tree if isinstance(x, tuple)), *(variables(y) for x in tree if isinstance(x, tuple) for y in x if isinstance(y, tuple)))


def given(text: Column, kind: str) -> Column:
    """A parameter of a declared type from its JSON text; null if it cannot be read."""
    base = kind.split("<")[0].strip()
    if base == "timestamp":
        return F.try_to_timestamp(text)
    if base in ("list", "map"):
        inside = TYPES.get(inner(kind), "string")
        return F.from_json(text, f"array<{inside}>" if base == "list" else f"map<string,{inside}>")
    if base == "duration":
        part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
        total = sum((part(u) * scale for u, scale in UNITS.items()), F.lit(0.0)) * F.when(text.startswith("-"), -1.0).otherwise(1.0)
        return F.when(F.regexp_like(text, F.lit(r"^-?(\d+(\.\d+)?(ms|us|ns|h|m|s))+$")), F.make_dt_interval(secs=total.cast("decimal(18,6)")))
    return text.try_cast(TYPES[base]) if base in TYPES else text


def held(value, kind: str) -> Column:
    """A parameter of a declared type that a request gives as a Python value."""
    base = kind.split("<")[0].strip()
    if base == "timestamp" and isinstance(value, str):
        return F.try_to_timestamp(F.lit(value))
    if base == "duration" and isinstance(value, str):
        return F.make_dt_interval(secs=F.lit(seconds(value)))
    return literal(value).try_cast(TYPES[base]) if base in TYPES else literal(value)


def type_of(value) -> str:
    return {bool: "bool", int: "int", float: "double", str: "string", list: "list", tuple: "list", dict: "map", dt.datetime: "timestamp"}.get(type(value), "dyn")


def verdict(caveat: Caveat, static: Column, dynamic: Mapping[str, object], request: Column | None = None, on_error: str = "deny") -> tuple[Column, Column]:
    """(verdict 0-2, sorted names that are missing) of a caveat for a row's JSON context and a request's.

    dynamic holds for all requests; request is a column of JSON, each row's own, and wins over it, as both do over the
    tuple's, even with a null. Every declared parameter must be in one of them, or the verdict is 1 (conditional).
    A value that cannot be read, a null and an error such as a division by zero make it 0; with on_error="raise" they end the query.
    """
    asked = None if request is None else F.from_json(F.coalesce(request, F.lit("{}")), "map<string,string>")
    row = F.from_json(F.coalesce(static, F.lit("{}")), "map<string,string>")
    has = lambda m, name: F.coalesce(F.map_contains_key(m, F.lit(name)), F.lit(False))
    tree = parse(caveat.body)
    names, missing = {}, []
    kinds = dict(caveat.params)
    undeclared = sorted(variables(tree) - set(kinds))
    for name in sorted(kinds) + undeclared:
        declared = name in kinds
        kind = kinds.get(name, type_of(dynamic[name]) if name in dynamic else "dyn")
        if name in dynamic:
            value, known = held(dynamic[name], kind) if declared else literal(dynamic[name]), F.lit(True)
        else:
            value, known = given(F.try_element_at(row, F.lit(name)), kind), has(row, name) if declared else F.lit(False)
        if asked is not None:
            value = F.when(has(asked, name), given(F.try_element_at(asked, F.lit(name)), kind)).otherwise(value)
            known = known | has(asked, name)
        names[name] = (value, kind)
        missing.append(F.when(~known, F.lit(name)))
    gone = F.array_sort(F.filter(F.array(*missing), lambda x: x.isNotNull())) if missing else F.array().cast("array<string>")
    try:
        result = compile_tree(tree, names)[0].cast("boolean")
    except KeyError as e:
        raise CaveatUnsupported(f"{caveat.name}: unknown type {e}") from e
    known = result if on_error == "deny" else F.coalesce(result, F.raise_error(F.lit(f"caveat {caveat.name} failed to evaluate")).cast("boolean"))
    return F.when(F.size(gone) > 0, 1).when(F.coalesce(known, F.lit(False)), 2).otherwise(0).cast("tinyint"), gone.cast("array<string>")
