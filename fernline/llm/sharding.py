"""Sharding by a hierarchical weighted hash tree.

A document's key descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` from a digest of key and child, and the smallest draw wins: a child
wins in proportion to its weight, and when a weight grows, rows move into that child only. A new
shard opens a region of its own, so that it takes rows only into itself and no row moves between
the others.

Defined cases: a null doc_id is the empty key; a null text has 0 bytes (size 8) and the checksum 0;
rows with one doc_id share a shard; equal rows get different slots; draws that tie go to the child first by name; texts of any length
are taken whole; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, finished, id_text
from .mixing import unit

SHARDS, RACKS, PER_RACK = 24, 2, 4
#: Slots are numbered in so many parts of a shard (hex digits of a digest), so that no task holds a shard.
PART_HEX = 3

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]


def shard_tree(shards: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK, grown: int = 0) -> Tree:
    """Regions of ``racks`` racks of ``per_rack`` shards, all of weight 1; each of ``grown`` more shards is a region of its own."""
    tree: Tree = {}
    for s in range(shards):
        region, rack = s // (racks * per_rack), s // per_rack % racks
        tree.setdefault(f"r{region}", {}).setdefault(f"r{region}/k{rack}", {})[s] = 1.0
    for s in range(shards, shards + grown):
        tree[f"g{s}"] = {f"g{s}/k0": {s: 1.0}}
    return tree


def _children(weights: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(w)).alias("weight")) for k, w in weights.items() if w > 0])


def _winner(key: Column, children: Column) -> Column:
    """Name of the child with the smallest draw."""

    def draw(c: Column) -> Column:
        u = unit(F.concat(key, F.lit("|"), c["name"])) + F.lit(2.0**-33)
        return F.struct((-F.ln(u) / c["weight"]).alias("draw"), c["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that ``key`` (text) reaches; nodes of weight 0 get nothing."""
    racks = {k: sum(shards.values()) for inside in tree.values() for k, shards in inside.items()}
    regions = {r: sum(racks[k] for k in inside) for r, inside in tree.items()}
    in_region = F.create_map(*[x for r, inside in tree.items() if regions[r] > 0 for x in (F.lit(r), _children({k: racks[k] for k in inside}))])
    in_rack = F.create_map(*[x for inside in tree.values() for k, shards in inside.items() if racks[k] > 0 for x in (F.lit(k), _children({f"s{s}": w for s, w in shards.items()}))])
    region = _winner(key, _children(regions))
    rack = _winner(key, F.element_at(in_region, region))
    return F.substring(_winner(key, F.element_at(in_rack, rack)), 2, 9).cast("int")


def _shard_documents(docs: DataFrame, shards: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> DataFrame:
    key = id_text(F.col("doc_id"))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"))
    # Rows equal in all three are one item with a count: however many they are, they meet as partial counts.
    items = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    items = (
        items.withColumn("shard", shard_of(key, shard_tree(shards, racks, per_rack)))
        .withColumn("grown_shard", shard_of(key, shard_tree(shards, racks, per_rack, grown=1)))
        .withColumn("part", F.substring(F.md5(key.cast("binary")), 1, PART_HEX))
    )
    items = durable(items)
    held = items.groupBy("shard", "part").agg(F.sum("n").alias("held"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("shard", "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    slotted = items.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(held, ["shard", "part"])
    return slotted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("ahead") + F.col("before") + F.col("k")).alias("slot"), "grown_shard"
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs`` (doc_id, text)."""
    return finished(docs.sparkSession, lambda: _shard_documents(docs, shards, racks, per_rack))
