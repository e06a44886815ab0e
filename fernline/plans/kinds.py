"""Values of the query language as Columns: kind, presence and value.

A field may be missing (nothing is there), null (a null is there) or have a value; predicates are
two-valued. In typed columns a SQL NULL is a null, and ``present`` says where something is there at
all; in VARIANT columns (kind ``any``) SQL NULL is missing and a variant null is null. Wherever the
kinds are known while the query is compiled, expressions collapse to plain Columns, so that filters
still reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = ("bool", "num", "str")
#: `.**` follows values to this depth and fails, rather than lose some, if there are deeper ones.
MAX_DEPTH = 32
_NOTHING = object()


@dataclass(frozen=True)
class Ex:
    kind: str  # null, bool, num, str, arr, obj, any
    col: Column | None = None
    dtype: T.DataType | None = None  # of a value (not of the stream)
    present: Column | None = None  # None: always (for ``any``: where col isn't NULL)
    many: bool = False  # a stream: col is an array of values
    unsure: bool = False  # a bool whose NULL means false
    literal: object = field(default=_NOTHING, compare=False)
    members: dict[str, Ex] | None = None  # of an obj made of columns
    name: str | None = None  # of the column that a VARIANT alias is
    held: Column | None = None  # of an obj made of columns: where it isn't null (None: everywhere)
    sure: bool = False  # known never to be null

    @property
    def is_literal(self) -> bool:
        return self.literal is not _NOTHING

    def value(self) -> Column:
        """The value as a Column; a bool is never NULL for false."""
        if self.members is not None and self.col is None:
            inner = F.struct(*[m.output().alias(n) for n, m in self.members.items()]) if self.members else F.struct()
            there = both(self.present, self.held)
            return F.when(there, inner) if there is not None else inner
        return F.coalesce(self.col, F.lit(False)) if self.unsure and not self.many else self.col

    def output(self) -> Column:
        """The value in a place that holds exactly one: the first of a stream, null for missing."""
        e = first(self)
        if e.kind == "any":
            return F.coalesce(e.col, VARIANT_NULL())
        if e.kind == "null":
            return F.lit(None) if e.col is None else e.col
        return F.when(e.present, e.value()) if e.present is not None else e.value()


def VARIANT_NULL() -> Column:
    return F.parse_json(F.lit("null"))


def absent() -> Ex:
    return Ex("null", F.lit(None), T.NullType(), present=F.lit(False))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ArrayType):
        return "arr"
    if isinstance(t, T.StructType | T.MapType):
        return "obj"
    if isinstance(t, T.VariantType):
        return "any"
    return "null" if isinstance(t, T.NullType) else "str"


def typed(col: Column, t: T.DataType, present: Column | None = None) -> Ex:
    return Ex(kind_of(t), col, t, present)


def literal(value: object) -> Ex:
    if value is None:
        return Ex("null", F.lit(None), T.NullType(), literal=None)
    kind = "bool" if isinstance(value, bool) else "num" if isinstance(value, int | float) else "str"
    t = {"bool": T.BooleanType(), "num": T.LongType() if isinstance(value, int) else T.DoubleType(), "str": T.StringType()}[kind]
    return Ex(kind, F.lit(value).cast(t) if isinstance(t, T.LongType) else F.lit(value), t, literal=value)


# --- presence and truth


def is_there(e: Ex) -> Column | None:
    """Where something is emitted; None: everywhere."""
    if e.many:
        return F.size(e.col) > 0
    if e.kind == "any":
        return e.col.isNotNull()
    return e.present


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def element(e: Ex, x: Column) -> Ex:
    """One value of a stream."""
    return Ex(e.kind, x, e.dtype)


def first(e: Ex) -> Ex:
    if not e.many:
        return e
    if e.kind == "any":
        return Ex("any", F.get(e.col, 0), e.dtype)
    return Ex(e.kind, F.get(e.col, 0), e.dtype, present=F.size(e.col) > 0)


def stream(e: Ex) -> Ex:
    """A value as a stream of none or one."""
    if e.many:
        return e
    there, one = is_there(e), F.array(e.value())
    return replace(e, col=one if there is None else F.when(there, one).otherwise(F.filter(one, lambda x: F.lit(False))), present=None, many=True, members=None, held=None, unsure=False, literal=_NOTHING)


def tag(v: Column) -> Column:
    return F.schema_of_variant(v)


_NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def of_kind(e: Ex, kind: str) -> Column:
    """The value of a single scalar as that kind, NULL if it has another (or is null or missing)."""
    if e.kind == "any":
        if kind == "num":
            return F.when(tag(e.col).rlike(_NUMBER), F.try_variant_get(e.col, "$", "double"))
        if kind == "str":
            return F.when(tag(e.col) == "STRING", F.try_variant_get(e.col, "$", "string"))
        return F.when(tag(e.col) == "BOOLEAN", F.try_variant_get(e.col, "$", "boolean"))
    if e.kind != kind:
        return F.lit(None).cast({"num": "double", "str": "string", "bool": "boolean"}[kind])
    value = e.value() if kind == "bool" else e.col
    return F.when(e.present, value) if e.present is not None else value


def text(e: Ex) -> Column:
    return of_kind(e, "str").cast("string")


def is_null(e: Ex) -> Column:
    """Where a present single value is null."""
    if e.kind == "any":
        return F.coalesce(F.is_variant_null(e.col), F.lit(False))
    if e.held is not None:
        return ~e.held
    return F.lit(e.literal is None) if e.is_literal else F.lit(False) if e.unsure or e.members is not None and e.present is None else e.value().isNull()


def truthy(e: Ex) -> Column:
    """Whether anything true is emitted; may be NULL for false, which a filter takes the same way."""
    if e.many:
        return F.exists(e.col, lambda x: F.coalesce(truthy(element(e, x)), F.lit(False)))
    if e.kind == "any":
        return F.when(e.col.isNull() | F.is_variant_null(e.col), F.lit(False)).otherwise(F.coalesce(of_kind(e, "bool"), F.lit(True)))
    if e.kind == "null":
        return F.lit(False)
    own = e.col if e.kind == "bool" else (F.lit(True) if e.held is None else e.held) if e.members is not None else e.col.isNotNull()
    return e.present & own if e.present is not None else own


def holds(e: Ex) -> Column:
    """``truthy`` without NULL, for where the result is looked at."""
    return F.coalesce(truthy(e), F.lit(False))


def boolean(col: Column, present: Column | None = None, unsure: bool = True) -> Ex:
    return Ex("bool", col, T.BooleanType(), present, unsure=unsure)


def each(e: Ex, f: Callable[[Ex], Ex]) -> Ex:
    """``f`` of every value of a stream, or of the single value."""
    if not e.many:
        return f(e)
    sample = f(element(e, F.col("x")))  # for its kind
    out = F.transform(e.col, lambda x: stream(f(element(e, x))).col)
    return Ex(sample.kind, F.flatten(out), sample.dtype, many=True)


# --- conversion to VARIANT


def variant(e: Ex) -> Column:
    """A single value as VARIANT: missing stays NULL."""
    if e.kind == "any":
        return e.col
    if e.kind == "null":
        return F.when(e.present, VARIANT_NULL()) if e.present is not None else VARIANT_NULL()
    value = e.value()
    if e.kind in ("arr", "obj"):
        out = F.call_function("to_variant_object", value)
    else:
        out = value.cast("string").cast("variant") if e.kind == "str" else value.cast("variant")
    out = F.coalesce(out, VARIANT_NULL())
    return F.when(e.present, out) if e.present is not None else out


def as_any(e: Ex) -> Ex:
    if e.kind == "any":
        return e
    return Ex("any", F.transform(e.col, lambda x: variant(element(e, x))), T.VariantType(), many=True) if e.many else Ex("any", variant(e), T.VariantType())


# --- paths


def get_field(e: Ex, name: str) -> Ex:
    if e.members is not None:
        if name not in e.members:
            return absent()
        m = e.members[name]
        return replace(m, present=both(e.present, m.present)) if e.present is not None and m.kind != "any" else m
    if e.many:
        return each(e, lambda x: get_field(x, name))
    if e.kind == "any":
        quoted = name.replace("\\", "\\\\").replace('"', '\\"')
        return Ex("any", F.try_variant_get(e.col, f'$["{quoted}"]', "variant"), T.VariantType())
    if isinstance(e.dtype, T.StructType) and name in e.dtype.names:
        return typed(e.col.getField(name), e.dtype[name].dataType, both(e.present, e.col.isNotNull()))
    if isinstance(e.dtype, T.MapType):
        return typed(F.try_element_at(e.col, F.lit(name)), e.dtype.valueType, both(e.present, F.coalesce(F.map_contains_key(e.col, name), F.lit(False))))
    return absent()


def _children(v: Column) -> Column:
    """Elements of an array, values of an object, else none (of a VARIANT)."""
    values = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), values, F.expr("cast(array() as array<variant>)"))


def iterate(e: Ex) -> Ex:
    if e.many:
        return each(e, iterate)
    if e.kind == "any":
        return Ex("any", F.when(e.col.isNotNull(), _children(e.col)).otherwise(F.expr("cast(array() as array<variant>)")), e.dtype, many=True)
    if e.kind == "arr":
        there = both(e.present, e.col.isNotNull())
        return Ex(kind_of(e.dtype.elementType), F.when(there, e.col).otherwise(F.filter(F.array(F.get(e.col, 0)), lambda x: F.lit(False))), e.dtype.elementType, many=True)
    if isinstance(e.dtype, T.MapType):
        return iterate(Ex("arr", F.map_values(e.col), T.ArrayType(e.dtype.valueType), e.present))
    if e.kind == "obj":
        return iterate(Ex("any", variant(e), T.VariantType()))
    return Ex("any", F.expr("cast(array() as array<variant>)"), T.VariantType(), many=True)


def get_index(e: Ex, at: int) -> Ex:
    if e.many:
        return each(e, lambda x: get_index(x, at))
    if e.kind == "any":
        items = F.try_variant_get(e.col, "$", "array<variant>")
        return Ex("any", F.get(items, F.lit(at) if at >= 0 else F.size(items) + at), e.dtype)
    if e.kind == "arr":
        n = F.coalesce(F.size(e.col), F.lit(0))
        return typed(F.get(e.col, F.lit(at) if at >= 0 else F.size(e.col) + at), e.dtype.elementType, both(e.present, n > at if at >= 0 else n >= -at))
    return absent()


def descend(e: Ex, depth: int = MAX_DEPTH) -> Ex:
    """The value and all below it, in document order."""

    def below(v: Column, left: int) -> Column:
        own = F.array(v)
        if not left:
            deeper = F.size(_children(v)) > 0
            return F.when(deeper, F.raise_error(F.lit(f"values nested deeper than {depth} levels under .**")).cast("array<variant>")).otherwise(own)
        return F.concat(own, F.flatten(F.transform(_children(v), lambda x: below(x, left - 1))))

    a = as_any(e)
    if a.many:
        return Ex("any", F.flatten(F.transform(a.col, lambda x: below(x, depth))), T.VariantType(), many=True)
    return Ex("any", F.when(a.col.isNotNull(), below(a.col, depth)).otherwise(F.expr("cast(array() as array<variant>)")), T.VariantType(), many=True)


# --- keys


def canonical(e: Ex) -> Column:
    """A single value as struct<t, n, s>, whose equality and order are those of group and join keys: null, bool, whole number, other number, string (t 0 to 4); containers have t 5."""
    num, word, flag = of_kind(e, "num").cast("double"), text(e), of_kind(e, "bool")
    whole = (F.floor(num) == num) & (F.abs(num) < 2.0**63)
    t = F.when(is_null(e), 0).when(flag.isNotNull(), 1).when(num.isNotNull(), F.when(whole, 2).otherwise(3)).when(word.isNotNull(), 4).otherwise(5)
    return F.struct(t.alias("t"), F.coalesce(num, flag.cast("int").cast("double")).alias("n"), word.alias("s"))


def from_canonical(c: Column) -> Column:
    """The VARIANT of a canonical key."""
    number = F.when(F.abs(c["n"]) < 2.0**53, c["n"].cast("bigint").cast("variant")).otherwise(c["n"].cast("variant"))
    return F.when(c["t"] == 0, VARIANT_NULL()).when(c["t"] == 1, (c["n"] == 1).cast("variant")).when(c["t"] == 2, number).when(c["t"] == 3, c["n"].cast("variant")).otherwise(c["s"].cast("variant"))


def sort_columns(e: Ex, down: bool) -> list[Column]:
    """Sort expressions: null and missing, bool, number, string, containers; all reversed for ``down``."""
    e = first(e)
    if e.kind == "any":
        c = canonical(Ex("any", F.coalesce(e.col, VARIANT_NULL()), e.dtype))
        parts = [F.when(c["t"] == 3, 2).otherwise(c["t"]), c["n"], c["s"]]
    elif e.kind in SCALARS:
        parts = [e.output()]
    else:
        parts = [F.when(e.output().isNull(), 0).otherwise(1)]
    return [p.desc() if down else p.asc() for p in parts]


# --- comparison


def _equal(a: Ex, b: Ex) -> Column:
    """Equality of two present single values; may be NULL for false."""
    if a.is_literal and a.literal is None:
        return is_null(b)
    if b.is_literal and b.literal is None:
        return is_null(a)
    if a.kind == "any" and b.kind == "any":
        x, y = canonical(a), canonical(b)
        return (x == y) & (x["t"] != 5)
    if b.kind == "any":
        a, b = b, a
    if a.kind == "any":
        if b.kind not in SCALARS:
            return is_null(a) & is_null(b)
        own, other = of_kind(a, b.kind), b.value()
        return own == other if b.is_literal else F.when(is_null(b), is_null(a)).otherwise(own == other)
    if a.kind != b.kind or a.kind not in SCALARS:
        return F.lit(False) if a.is_literal or b.is_literal else is_null(a) & is_null(b)
    x, y = a.value(), b.value()
    return x == y if a.is_literal or b.is_literal else x.eqNullSafe(y)


def _ordered(op: str, a: Ex, b: Ex) -> Column:
    if op in (">", ">="):
        return _ordered("<" + op[1:], b, a)
    null_too = F.lit(False) if op == "<" or a.is_literal and a.literal is not None or b.is_literal and b.literal is not None else is_null(a) & is_null(b)

    def less(x: Column, y: Column) -> Column:
        return x < y if op == "<" else x <= y

    kinds = [k for k in SCALARS if a.kind in (k, "any") and b.kind in (k, "any")]
    if not kinds:
        return null_too
    if len(kinds) == 1:
        k = kinds[0]
        x, y = (e.value() if e.kind == k else of_kind(e, k) for e in (a, b))
        own = less(x, y)
        return own if op == "<" or a.is_literal or b.is_literal else F.coalesce(own, null_too)
    return F.coalesce(*[less(of_kind(a, k), of_kind(b, k)) for k in kinds], null_too)


def _glob(pattern: str) -> str:
    return "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(c, c) for c in pattern)


def _pattern(op: str, a: Ex, b: Ex) -> Column:
    if "str" not in (a.kind, b.kind) and not (a.kind == b.kind == "any") or a.kind not in ("str", "any") or b.kind not in ("str", "any"):
        return F.lit(False)
    x, y = text(a), text(b)
    if op == "matches":
        if b.is_literal:
            return x.like(_glob(str(b.literal)))
        regex = F.concat(F.lit(r"(?s)^\Q"), F.replace(F.replace(y, F.lit("*"), F.lit(r"\E.*\Q")), F.lit("?"), F.lit(r"\E.\Q")), F.lit(r"\E$"))
        return F.rlike(x, regex)
    return {"contains": x.contains, "starts_with": x.startswith, "ends_with": x.endswith}[op](y)


def compare(op: str, a: Ex, b: Ex) -> Ex:
    """A comparison: one bool for each pair of values, nothing where a side is missing."""
    if a.many:
        return each(a, lambda x: compare(op, x, b))
    if b.many:
        return each(b, lambda y: compare(op, a, y))
    there = both(is_there(a), is_there(b))
    if op == "==":
        return boolean(_equal(a, b), there)
    if op == "!=":
        return boolean(~F.coalesce(_equal(a, b), F.lit(False)), there, unsure=False)
    if op in ("<", "<=", ">", ">="):
        return boolean(_ordered(op, a, b), there)
    return boolean(_pattern(op, a, b), there)


def negate(e: Ex) -> Ex:
    return each(e, lambda x: boolean(~holds(x) if x.present is None or x.kind == "any" else ~holds(replace(x, present=None)), is_there(x), unsure=False))


def type_test(e: Ex, kind: str, negated: bool) -> Ex:
    def one(x: Ex) -> Ex:
        own = {"string": "str", "number": "num", "bool": "bool", "array": "arr", "object": "obj"}.get(kind)
        if x.kind == "any":
            t = tag(x.col)
            test = {"string": t == "STRING", "number": t.rlike(_NUMBER), "bool": t == "BOOLEAN", "null": t == "VOID", "array": t.startswith("ARRAY"), "object": t.startswith("OBJECT")}[kind]
        elif kind == "null":
            test = is_null(x)
        else:
            test = ~is_null(x) if x.kind == own else F.lit(False)
        return boolean(~test if negated else test, is_there(x), unsure=False)

    return each(e, one)


def merge(a: Ex, b: Ex, choose: Callable[[Column, Column], Column]) -> Ex:
    """One of two single values (``choose`` gets their Columns); of two kinds the result is a VARIANT."""
    a, b = first(a), first(b)
    if "null" in (a.kind, b.kind) and a.kind != b.kind and "any" not in (a.kind, b.kind):
        other = b if a.kind == "null" else a
        there = None if a.present is None and b.present is None else choose(*(F.lit(True) if x.present is None else x.present for x in (a, b)))
        return Ex(other.kind, choose(*(F.lit(None).cast(other.dtype) if x.kind == "null" else x.value() for x in (a, b))), other.dtype, there)
    if a.kind == b.kind and a.kind in SCALARS:
        there = None if a.present is None and b.present is None else choose(*(F.lit(True) if x.present is None else x.present for x in (a, b)))
        same = a.dtype == b.dtype
        x, y = (e.value() if same or a.kind == "bool" else e.value().cast("double" if a.kind == "num" else "string") for e in (a, b))
        return Ex(a.kind, choose(x, y), a.dtype if same else T.DoubleType() if a.kind == "num" else T.StringType(), there)
    return Ex("any", choose(variant(a), variant(b)), T.VariantType())


def canonical_sort(e: Ex) -> list[Column]:
    """Order in which groups are emitted: null, bool, whole numbers, other numbers, strings."""
    if e.kind == "any" or e.kind == "num":
        c = canonical(e if e.kind == "num" else Ex("any", F.coalesce(e.col, VARIANT_NULL()), e.dtype))
        return [c["t"].asc(), c["n"].asc(), c["s"].asc()]
    return [e.output().asc()]
