"""Exploring documents: text search, children, paths, sampled schemas, table projection."""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .plans import kinds as K
from .sinks.emit import kind

SAMPLE = 5000
#: A projection is a table if it has two rows, two fifths of them objects, and its commonest field is in three fifths of those.
MAX_COLUMNS, OBJECT_SHARE, FIELD_SHARE = 20, 0.4, 0.6


def member_path(parent: str, key: str | int) -> str:
    """The path of a child: ``.a``, ``["odd key"]`` or ``[0]``."""
    if isinstance(key, int):
        return f"{parent or '.'}[{key}]" if parent else f".[{key}]"
    return f"{parent}.{key}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) else f"{parent or '.'}[{json.dumps(key, ensure_ascii=False)}]"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(df: DataFrame, needle: str) -> DataFrame:
    """Rows in which a key or a string value contains ``needle``, ASCII letters in either case."""
    low = needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    def hit(c: Column, t: T.DataType) -> Column | None:
        if isinstance(t, T.StringType):
            return _ascii_lower(c).contains(low)
        if isinstance(t, T.ArrayType):
            probe = hit(F.get(c, 0), t.elementType)
            return None if probe is None else F.exists(c, lambda x: F.coalesce(hit(x, t.elementType), F.lit(False)))
        if isinstance(t, T.StructType):
            parts = [F.lit(True) if low in _plain_lower(f.name) else hit(c.getField(f.name), f.dataType) for f in t.fields]
            return _any([p for p in parts if p is not None])
        if isinstance(t, T.VariantType):
            e = K.descend(K.Ex("any", c, t))
            return F.exists(e.col, lambda x: F.coalesce(_ascii_lower(K.of_kind(K.Ex("any", x, t), "str")).contains(low), F.lit(False)) | F.exists(F.coalesce(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")), F.expr("cast(array() as array<string>)")), lambda k: _ascii_lower(k).contains(low)))
        return None

    if any(low in _plain_lower(f.name) for f in df.schema.fields):
        return df
    found = _any([h for f in df.schema.fields if (h := hit(F.col(f"`{f.name}`"), f.dataType)) is not None])
    return df.where(F.lit(False) if found is None else found)


def _plain_lower(text: str) -> str:
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _any(parts: list[Column]) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return out


def _kind_label(v: Column) -> Column:
    t = K.tag(v)
    return F.when(t == "VOID", "null").when(t == "STRING", "string").when(t == "BOOLEAN", "bool").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number")


def _value_at(engine: Engine, path: str) -> DataFrame | None:
    """One row with the VARIANT ``v`` at a path; None for the root of a catalog of tables."""
    if path == "." and engine.catalog.document_for(None) is None:
        return None
    lowered = engine.lower(f"from {path} as node limit 1")
    if lowered.shape == "value":
        f = lowered.df.schema[0]
        return lowered.df.select(K.variant(K.typed(F.col(f"`{f.name}`"), f.dataType)).alias("v"))
    return lowered.df.select(F.call_function("to_variant_object", F.struct(*[F.col(f"`{c}`") for c in lowered.df.columns])).alias("v"))


def _entries(v: Column) -> Column:
    """Members of a container as array<struct<key, value>>, keys null in arrays."""
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return F.coalesce(items, fields, F.expr("cast(array() as array<struct<key:string,value:variant>>)"))


def _count(v: Column) -> Column:
    return F.size(_entries(v))


def children(engine: Engine, path: str = ".", offset: int = 0, limit: int = 100) -> list[dict]:
    """A page of the children of the value at a path: path, key or index, kind, number of children, and the value if it is no container.

    The page is cut on the executors; only its rows come to the driver.
    """
    at = _value_at(engine, path)
    if at is None:
        tables = sorted(engine.catalog.tables)[offset : offset + limit]
        return [{"path": member_path("", n), "key": n, "kind": "array", "children": engine.catalog.tables[n].frame.count(), "value": None} for n in tables]
    page = at.select(F.posexplode(F.slice(_entries(F.col("v")), offset + 1, max(limit, 0))).alias("pos", "e")).select("pos", "e.key", F.col("e.value").alias("value"))
    kind_of = _kind_label(F.col("value"))
    rows = page.select("pos", "key", kind_of.alias("kind"), _count(F.col("value")).alias("children"), F.when(~kind_of.isin("array", "object"), F.to_json("value")).alias("text")).collect()
    base, out = "" if path == "." else path, []
    for r in sorted(rows, key=lambda r: r["pos"]):
        key = r["key"] if r["key"] is not None else offset + r["pos"]
        out.append({"path": member_path(base, key), "key": key, "kind": r["kind"], "children": r["children"], "value": None if r["text"] is None else json.loads(r["text"])})
    return out


def node(engine: Engine, path: str) -> dict | None:
    """Kind, number of children, bytes of JSON text and parent path of the value at a path; None if there is none."""
    at = _value_at(engine, path)
    if at is None:
        return {"path": path, "kind": "object", "children": len(engine.catalog.tables), "bytes": None, "parent": None}
    r = at.select(_kind_label(F.col("v")).alias("kind"), _count(F.col("v")).alias("children"), F.octet_length(F.to_json("v")).alias("bytes")).first()
    if r is None:
        return None
    parent = re.sub(r'(\.[A-Za-z_][A-Za-z0-9_]*|\[-?\d+\]|\.?\["(?:[^"\\]|\\.)*"\])$', "", path)
    return {"path": path, **r.asDict(), "parent": None if path == "." else parent or "."}


def kind_counts(engine: Engine, path: str) -> dict[str, int]:
    """How many values of each kind a path gives, counted on the executors."""
    lowered = engine.lower(f"from {path} as node")
    if lowered.shape != "value":
        return {"object": lowered.df.count()}
    f = lowered.df.schema[0]
    e = K.typed(F.col(f"`{f.name}`"), f.dataType)
    names = {"str": "string", "num": "number", "arr": "array", "obj": "object", "bool": "bool", "null": "null"}
    if e.kind == "any":
        label = _kind_label(e.col)
    else:
        label = F.when(e.col.isNull(), "null").otherwise(names[e.kind])
    return {r["kind"]: r["count"] for r in lowered.df.groupBy(label.alias("kind")).count().collect()}


def sample_kinds(engine: Engine, text: str, most: int = SAMPLE) -> list[str]:
    """The kinds among the first rows of a query."""
    return sorted({kind(v) for v in engine.run(text, limit=most).rows})


def sample_keys(engine: Engine, text: str, most: int = SAMPLE) -> list[str]:
    """The union of the keys of the first rows of a query, sorted."""
    return sorted({k for v in engine.run(text, limit=most).rows if isinstance(v, dict) for k in v})


def project_table(rows: list[object]) -> dict | None:
    """Columns and cells if the rows look like a table, else None."""
    objects = [r for r in rows if isinstance(r, dict) and r]
    if len(rows) < 2 or len(objects) < OBJECT_SHARE * len(rows):
        return None
    seen: Counter = Counter(k for r in objects for k in r)
    if max(seen.values()) < FIELD_SHARE * len(objects):
        return None
    order = {k: i for i, k in enumerate(dict.fromkeys(k for r in objects for k in r))}
    columns = sorted(sorted(seen, key=lambda k: (-seen[k], order[k]))[:MAX_COLUMNS], key=order.__getitem__)
    return {"columns": columns, "rows": [[r.get(c) if isinstance(r, dict) else None for c in columns] for r in rows]}
