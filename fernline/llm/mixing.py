"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. The expected copies are
prefix-summed over the source's documents in a fixed order, one offset between 0 and 1 is added
for the source, and a document is emitted once for every whole number its stretch of the sum
crosses. The order runs through size classes first, so the sample keeps each class's share and
the words taken come near the target.

The prefix sums are built in two levels (buckets of a source, then rows of a bucket), so that no
task holds a whole source. Rows that agree in source, id and size are counted before they are
ordered, so that repeated rows don't meet in one task either.

Defined cases: null text and text of white space have size 0 and take 0 words; sources go by code
point with null last; equal rows share what falls to them in any order; texts of any length are counted whole; columns other than
doc_id, text and source are not read, and `mixed_rows` keeps them all; an empty table gives an empty result; a corpus of size 0 has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, finished, id_text

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is asked for more than so many times its size.
MOST = 3.0
#: A target's documents are dealt to so many buckets (two hex digits of a digest) in each size class.
SALT_HEX = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source (column ``source``): its size and its target.

    The targets share the total size by weight, none above ``most`` times its source's size, what is
    above being shared again by weight: with the sources in order of cap over weight, the first
    that a proportional share of the rest doesn't fill fixes the share of all later ones.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("share", share)
    level = F.min_by(F.when(F.col("share") <= F.col("fill"), F.col("share")), F.when(F.col("share") <= F.col("fill"), F.col("fill"))).over(every)
    return per.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def unit(text: Column) -> Column:
    """A number from 0 up to 1 drawn from a text's MD5 digest (32 bits)."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_class(size: Column) -> Column:
    """Number of digits and the two first digits: classes about a tenth wide."""
    text = size.cast("string")
    return F.concat(F.lpad(F.length(text).cast("string"), 2, "0"), F.substring(text, 1, 2))


def item_places(sized: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per (source, doc_id, size): n rows, at (how many documents come before), rate, offset, source_size, target.

    Rows equal in the three are one item, whose rows follow one another in the prefix sum.
    """
    items = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    items = durable(items.withColumn("class", size_class(F.col("size"))).withColumn("bucket", F.concat("class", F.substring(F.md5(id_text(F.col("doc_id")).cast("binary")), 1, SALT_HEX))))
    # What comes before a bucket: the classes before its own, and the buckets before it in its class.
    before = (Window.unboundedPreceding, -1)
    held = items.groupBy("source", "class", "bucket").agg(F.sum("n").alias("held"))
    inside = F.sum("held").over(Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(*before))
    classes = held.groupBy("source", "class").agg(F.sum("held").alias("held"))
    classes = classes.withColumn("ahead", F.sum("held").over(Window.partitionBy("source").orderBy("class").rowsBetween(*before))).drop("held")
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn(
        "offset", unit(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))))
    )
    classes = classes.join(targets, classes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    held = held.withColumn("inside", inside).drop("held")
    held = held.join(classes, held["source"].eqNullSafe(classes["source"]) & (held["class"] == classes["class"])).drop(classes["source"], classes["class"], held["class"])
    held = held.withColumn("ahead", F.coalesce("ahead", F.lit(0)) + F.coalesce("inside", F.lit(0))).drop("inside")
    within = Window.partitionBy("source", "bucket").orderBy("size", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = items.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = ranked.join(held, ranked["source"].eqNullSafe(held["source"]) & (ranked["bucket"] == held["bucket"])).drop(held["source"], held["bucket"])
    return joined.select("source", "doc_id", "size", "n", (F.col("ahead") + F.col("before")).alias("at"), "rate", "offset", "source_size", "target")


def copies_at(k: Column) -> Column:
    """Copies of the k-th row (from 0) of an item: whole numbers crossed by its stretch of the prefix sum."""
    at = F.col("at") + k
    return (F.floor(F.col("rate") * (at + 1) + F.col("offset")) - F.floor(F.col("rate") * at + F.col("offset"))).cast("bigint")


def _mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = durable(sized)
    places = item_places(sized, source_targets(sized, weights, most), seed)
    rows = places.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).withColumn("copies", copies_at(F.col("k")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of ``docs`` (doc_id, text, source)."""
    return finished(docs.sparkSession, lambda: _mix_documents(docs, weights, most, seed))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any other columns), each as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = durable(rows.select("source", "doc_id", "size"))
    places = item_places(sized, source_targets(sized, weights, most), seed)
    placed = places.select(F.col("source").alias("p_source"), F.col("doc_id").alias("p_doc"), F.col("size").alias("p_size"), "n", "at", "rate", "offset")
    met = rows.join(placed, F.col("source").eqNullSafe(F.col("p_source")) & F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("size") == F.col("p_size")))
    # Only items with several rows need a number for each.
    once = met.where("n = 1").withColumn("k", F.lit(0).cast("bigint"))
    again = met.where("n > 1").withColumn("k", F.row_number().over(Window.partitionBy("source", "doc_id", "size").orderBy(F.lit(0))).cast("bigint") - 1)
    taken = once.unionByName(again).withColumn("copies", copies_at(F.col("k"))).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
