"""The scalar functions and arithmetic: arguments are single values, and whatever doesn't fit gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.kinds import Ex, first, of_kind, text

_LARGEST = 1.7976931348623157e308


def _num(e: Ex) -> Column:
    return of_kind(first(e), "num").cast("double")


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) <= _LARGEST, c)


def _number(c: Column) -> Ex:
    return Ex("num", c, T.DoubleType())


def _text(c: Column) -> Ex:
    return Ex("str", c, T.StringType())


def arithmetic(op: str, a: Ex, b: Ex) -> Ex:
    x, y = _num(a), _num(b)
    if op == "/":
        return _number(_finite(x / F.when(y != 0, y)))
    return _number(_finite({"+": x + y, "-": x - y, "*": x * y}[op]))


def minus(a: Ex) -> Ex:
    return _number(-_num(a))


def _round(x: Column, places: Column) -> Column:
    p = F.greatest(F.lit(-308.0), F.least(F.lit(308.0), F.rint(places)))
    scale = F.pow(F.lit(10.0), p)
    scaled = x * scale
    # half away from zero on the binary value; numbers without a fraction stay as they are
    up = F.signum(scaled) * F.floor(F.abs(scaled) + 0.5).cast("double")
    up = F.when(F.abs(scaled) < 4503599627370496.0, up).otherwise(scaled)
    return _finite(up / scale)


def _whole(x: Column, f) -> Column:
    return F.when(F.abs(x) < 9007199254740992.0, f(x).cast("double")).otherwise(x)


def length(e: Ex) -> Ex:
    e = first(e)
    if e.kind == "any":
        items, fields = F.try_variant_get(e.col, "$", "array<variant>"), F.try_variant_get(e.col, "$", "map<string,variant>")
        own = F.when(e.col.isNull() | F.is_variant_null(e.col), F.lit(0)).otherwise(F.coalesce(F.char_length(text(e)), F.size(F.when(items.isNotNull(), items)), F.when(fields.isNotNull(), F.size(F.map_keys(fields)))))
        return Ex("num", own.cast("bigint"), T.LongType())
    if e.kind == "str":
        own = F.coalesce(F.char_length(text(e)), F.lit(0))
    elif e.kind == "arr":
        own = F.when(e.output().isNull(), 0).otherwise(F.size(e.output()))
    elif e.kind == "obj":
        count = F.size(F.map_keys(e.value())) if isinstance(e.dtype, T.MapType) else F.lit(len(e.members if e.members is not None else e.dtype.names))
        own = F.when(e.output().isNull(), 0).otherwise(count)
    elif e.kind == "null":
        own = F.lit(0)
    else:
        own = F.when(e.output().isNull(), 0)
    return Ex("num", own.cast("bigint"), T.LongType())


def call(name: str, args: list[Ex]) -> Ex:
    """A function by name; ``if`` is not among them."""
    if name == "length":
        return length(args[0])
    if name in ("lower", "upper", "trim"):
        s = text(first(args[0]))
        return _text({"lower": F.lower, "upper": F.upper, "trim": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")}[name](s))
    if name == "substr":
        s, start, count = text(first(args[0])), _num(args[1]), _num(args[2])
        at = F.greatest(F.lit(0.0), F.least(start, F.lit(2147483646.0))).cast("int")
        n = F.greatest(F.lit(0.0), F.least(count, F.lit(2147483646.0))).cast("int")
        return _text(F.when(start.isNotNull() & count.isNotNull(), F.substring(s, at + 1, n)))
    if name == "replace":
        s, old, new = (text(first(a)) for a in args)
        return _text(F.replace(s, old, new))
    x = _num(args[0])
    if name == "round":
        return _number(_round(x, _num(args[1]) if len(args) > 1 else F.lit(0.0)))
    if name == "abs":
        return _number(F.abs(x))
    if name == "floor":
        return _number(_whole(x, F.floor))
    if name == "ceil":
        return _number(_whole(x, F.ceil))
    if name == "sqrt":
        return _number(F.when(x >= 0, F.sqrt(x)))
    if name == "pow":
        return _number(_finite(F.pow(x, _num(args[1]))))
    y = _num(args[1])  # mod: the sign of the dividend
    return _number(x % F.when(y != 0, y))
