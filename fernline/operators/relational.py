"""DataFrame forms of the clauses: joins, unnest, distinct, grouping, collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_join(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column, bool]], there: list[Column], kind: str) -> DataFrame:
    """Join on keys that are equal or both null; rows for which ``there`` doesn't hold on either side match nothing.

    Where one side can't be null (by its schema, or by the third of a pair), plain equality does, under which Spark drops nulls early and may filter one side by the other's keys.
    """
    sides = [[f.nullable for f in df.select(*[p[i].alias(f"k{n}") for n, p in enumerate(pairs)]).schema] for i, df in enumerate((left, right))]
    on = None
    for (a, b, sure), x, y in zip(pairs, *sides, strict=True):
        same = a.eqNullSafe(b) if x and y and not sure else a == b
        on = same if on is None else on & same
    for c in there:
        on = on & c
    return left.join(right, on, kind)


def unnest(df: DataFrame, array: Column, name: str, position: str | None) -> DataFrame:
    """One row per element; rows with no element go."""
    if position is None:
        return df.select("*", F.explode(array).alias(name))
    return df.select("*", F.posexplode(array).alias(position, name))


def first_by(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``: minima with partial aggregation, not a sort of every group.

    Each column is a minimum of its own, so that those which nothing reads later are pruned down to the scan. They agree on the row: every
    one takes a value over when, and only when, the order of its row is less.
    """
    by = order[0] if len(order) == 1 else F.struct(*order)
    names = [f"__k{i}" for i in range(len(keys))]
    held = df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)], by.alias("__by"))
    return held.groupBy(*names).agg(*[F.min_by(F.col(f"`{c}`"), "__by").alias(c) for c in df.columns]).drop(*names)


def collect(df: DataFrame, key: Column, member: Column, order: list[Column], name: str, items: str) -> DataFrame:
    """The members of each key in order, as an array."""
    by = F.struct(*order) if order else F.struct(F.lit(0))
    listed = F.collect_list(F.struct(by.alias("by"), member.alias("m")))
    if order:
        listed = F.array_sort(listed, lambda a, b: F.when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0))
    return df.groupBy(key.alias(name)).agg(F.transform(listed, lambda x: x["m"]).alias(items))
