"""The expression semantics in plain Python: an expression gives a list of values, and an empty list is *missing*."""

import math
import re

from fernline.lang import ast


def kind(v):
    if v is None or isinstance(v, bool):
        return "null" if v is None else "bool"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def truthy(values):
    return any(v is not None and v is not False for v in values)


def equal(a, b):
    return kind(a) == kind(b) not in ("array", "object") and a == b


def ordered(op, a, b):
    if op in (">", ">="):
        return ordered("<" + op[1:], b, a)
    if kind(a) != kind(b) or kind(a) in ("array", "object"):
        return False
    if a is None:
        return op == "<="
    return a < b if op == "<" else a <= b


def compare(op, a, b):
    if op in ("==", "!="):
        return equal(a, b) == (op == "==")
    if op in ("<", "<=", ">", ">="):
        return ordered(op, a, b)
    if not (isinstance(a, str) and isinstance(b, str)):
        return False
    if op == "matches":
        return re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in b), a, re.S) is not None
    return {"contains": b in a, "starts_with": a.startswith(b), "ends_with": a.endswith(b)}[op]


def step(v, s):
    if isinstance(s, ast.Field):
        return [v[s.name]] if isinstance(v, dict) and s.name in v else []
    if isinstance(s, ast.Index):
        return [v[s.at]] if isinstance(v, list) and -len(v) <= s.at < len(v) else []
    if isinstance(s, ast.Iterate):
        return list(v) if isinstance(v, list) else [v[k] for k in sorted(v)] if isinstance(v, dict) else []
    return [v] + [y for x in step(v, ast.Iterate()) for y in step(x, s)]


def first(values):
    return values[0] if values else None


def number(v):
    return float(v) if kind(v) == "number" else None


def arithmetic(op, a, b):
    a, b = number(a), number(b)
    if a is None or b is None or op == "/" and b == 0:
        return None
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[op]()
    return out if math.isfinite(out) else None


def evaluate(e, env):
    match e:
        case ast.Path(root, segments):
            out = [env[root]]
            for s in segments:
                out = [y for x in out for y in step(x, s)]
            return out
        case ast.Literal(value):
            return [value]
        case ast.Binary("and", a, b):
            return [truthy(evaluate(a, env)) and truthy(evaluate(b, env))]
        case ast.Binary("or", a, b):
            return [truthy(evaluate(a, env)) or truthy(evaluate(b, env))]
        case ast.Binary("+" | "-" | "*" | "/", a, b):
            return [arithmetic(e.op, first(evaluate(a, env)), first(evaluate(b, env)))]
        case ast.Binary(op, a, b):
            return [compare(op, x, y) for x in evaluate(a, env) for y in evaluate(b, env)]
        case ast.Unary("not", item):
            return [not truthy([v]) for v in evaluate(item, env)]
        case ast.Unary("-", item):
            n = number(first(evaluate(item, env)))
            return [None if n is None else -n]
        case ast.Exists(item):
            return [bool(evaluate(item, env))]
        case ast.TypeTest(item, k, negated):
            return [(kind(v) == k) != negated for v in evaluate(item, env)]
        case ast.In(item, ast.ArrayLit(items), negated):
            op, values = "!=" if negated else "==", evaluate(item, env)
            if len(items) == 1:
                return [compare(op, x, y) for x in values for y in evaluate(items[0], env)]
            each = [truthy([compare(op, x, y) for x in values for y in evaluate(i, env)]) for i in items]
            return [all(each) if negated else any(each)]
        case ast.Call("if", (c, a, b)):
            return evaluate(a if truthy(evaluate(c, env)) else b, env)
        case ast.Call("length", (a,)):
            v = first(evaluate(a, env))
            return [0 if v is None else len(v) if isinstance(v, str | list | dict) else None]
    raise NotImplementedError(e)
