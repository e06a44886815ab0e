"""Benchmark decontamination over a distributed positional inverted index.

The index holds a posting (document, position) for every occurrence of a benchmark term in the
training documents, stored as a Parquet table in segments of documents, each sorted by term and so an inverted list after
the other. A window of a benchmark
item occurs where the position lists of its terms, each shifted back by the term's offset in the
window, intersect. The lists are intersected from the rarest term on: the rarest term's postings
propose places, the second rarest's confirm them, and only the places left meet the postings of
the common terms, and of those only the ones in documents that still have a place.

Words: runs of the characters other than ASCII punctuation, space and control characters, A-Z
lower-cased. A window is ``window`` consecutive words of an item; a shorter item that has a word is
one window. `proximity` finds near matches of phrases; `contamination` has exact matches only.

Defined cases: a null text has no words, and an item without words no window; equal windows are
searched once and count for all their items; a null item_id counts as the empty string; rows of
documents may repeat, each is judged; texts of any length are indexed whole; columns other than doc_id and text are not read, and
`without_contaminated` keeps them all; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, finished, row_key, scratch, small

WINDOW = 10
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most rows (counted) of a table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_TERMS = 200_000
BROADCAST_DOCS = 1_000_000


def terms(text: Column) -> Column:
    """The words of a text in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)), F.expr("cast(array() as array<string>)"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (wid, words, n) with the item ids they stand for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), terms(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (window - 1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("wid", F.monotonically_increasing_id()).withColumn("n", F.size("words"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text) for ``vocabulary`` (term, word, hash): rid, pos, term, n_words, doc_id.

    A document's last word (or the only row of one without words) also carries n_words and doc_id, whether it is a term or not.
    """
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), terms(F.col("text")).alias("ws")).select("doc_id", "rid", F.size("ws").alias("n_words"), "ws")
    places = words.select("doc_id", "rid", "n_words", F.posexplode_outer("ws").alias("pos", "w"))
    found = places.join(vocabulary, (F.xxhash64(F.coalesce("w", F.lit(""))) == F.col("hash")) & (F.col("w") == F.col("word")), "left")
    last = F.col("pos").isNull() | (F.col("pos") == F.col("n_words") - 1)
    rows = found.where(F.col("term").isNotNull() | last).select("rid", "pos", "term", F.when(last, F.col("n_words")).alias("n_words"), F.when(last, F.col("doc_id")).alias("doc_id"))
    return durable(rows.sortWithinPartitions("term"))


def occurrences(index: DataFrame, windows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Places (wid, n, rid, start) where a window of ``windows`` (wid, words, n) occurs."""
    postings = index.where("term is not null").select("rid", "pos", "term")
    rarity = durable(postings.groupBy("term").agg(F.count(F.lit(1)).alias("cf")))
    spelled = windows.select("wid", "n", F.posexplode("words").alias("off", "word")).join(small(vocabulary.select("word", "term"), BROADCAST_TERMS), "word")
    ranked = spelled.join(small(rarity, BROADCAST_TERMS), "term").groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("cf", "off", "term"))).alias("by_cf"))
    # a window with a term that no document has can't occur
    ranked = durable(ranked.where(F.size("by_cf") == F.col("n")))

    def term_at(k: int) -> list[Column]:
        return [F.col("by_cf")[k]["term"].alias("term"), F.col("by_cf")[k]["off"].alias("off")]

    first = small(ranked.select("wid", "n", *term_at(0)), BROADCAST_TERMS)
    places = postings.join(first, "term").select("wid", "n", "rid", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    second_terms = ranked.where("n > 1").select("wid", *term_at(1))
    second = places.join(small(second_terms, BROADCAST_TERMS), "wid").withColumn("pos", F.col("start") + F.col("off")).drop("off")
    lists = postings.join(small(second_terms.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi")
    both = durable(second.join(lists, ["rid", "pos", "term"]).select("wid", "n", "rid", "start"))
    # What is left of the windows longer than two words meets the common terms' lists, in the documents concerned only.
    rest = both.where("n > 2").join(small(ranked.where("n > 2").select("wid", F.explode(F.expr("slice(by_cf, 3, n)")).alias("t")), BROADCAST_TERMS), "wid")
    rest = rest.select("wid", "n", "rid", "start", (F.col("start") + F.col("t.off")).alias("pos"), F.col("t.term").alias("term"))
    left = postings.join(small(both.where("n > 2").select("rid").distinct(), BROADCAST_DOCS), "rid", "left_semi")
    whole = rest.join(left, ["rid", "pos", "term"]).groupBy("wid", "n", "rid", "start").agg(F.count(F.lit(1)).alias("met")).where("met = n - 2").drop("met")
    return places.where("n = 1").unionByName(both.where("n = 2")).unionByName(whole)


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    windows = durable(benchmark_windows(benchmark, window))
    vocabulary = durable(windows.select(F.explode("words").alias("word")).distinct().select("word", F.xxhash64("word").alias("hash"), F.monotonically_increasing_id().alias("term")))
    index = build_index(docs, small(vocabulary, BROADCAST_TERMS))
    found = durable(occurrences(index, windows, vocabulary))
    by_start = Window.partitionBy("rid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("rid", "start", "n").distinct().withColumn("reached", F.max(F.col("start") + F.col("n")).over(by_start))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce("reached", "start")))
    hits = spans.groupBy("rid").agg(F.sum(fresh).alias("n_hit"))
    items = found.select("rid", "wid").distinct().join(windows.select("wid", F.explode("items").alias("item")), "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return (
        index.where("n_words is not null")
        .select("rid", "doc_id", F.col("n_words").cast("bigint").alias("n_words"))
        .join(hits.join(items, "rid"), "rid", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``."""
    return finished(docs.sparkSession, lambda: _contamination(docs, benchmark, window))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) in which no window of the benchmark occurs."""
    key = row_key(F.col("doc_id"), F.col("text"))
    with scratch(docs.sparkSession):  # the index goes when the decisions are written
        found = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, window)
        hit = durable(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), keep=True)
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(small(hit, BROADCAST_DOCS // 10), "key", "left_anti").select("row.*")


def proximity(docs: DataFrame, phrases: DataFrame, slop: int = 2) -> DataFrame:
    """Near matches: (doc_id, item, start, end) where the phrase's terms occur in order, each at most ``slop`` words late.

    ``phrases`` has item and text. The rarest term proposes places; every other term must have a posting at
    its offset from there give or take ``slop``, in order. Phrases of one word match exactly.
    """
    spelled = durable(phrases.select("item", terms(F.col("text")).alias("words")).where(F.size("words") > 0).distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("n", F.size("words")))
    vocabulary = durable(spelled.select(F.explode("words").alias("word")).distinct().select("word", F.xxhash64("word").alias("hash"), F.monotonically_increasing_id().alias("term")))
    index = build_index(docs, small(vocabulary, BROADCAST_TERMS))
    postings = index.where("term is not null").select("rid", "pos", "term")
    rarity = postings.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    order = spelled.select("wid", "n", F.posexplode("words").alias("off", "word")).join(vocabulary.select("word", "term"), "word").join(rarity, "term")
    ranked = order.groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("cf", "off", "term"))).alias("by_cf")).where("size(by_cf) = n")
    anchors = ranked.select("wid", "n", "by_cf", F.col("by_cf")[0]["term"].alias("term"), F.col("by_cf")[0]["off"].alias("anchor_off"))
    places = postings.join(small(anchors, BROADCAST_TERMS), "term").select("wid", "n", "rid", F.col("pos").alias("anchor"), "anchor_off", "by_cf")
    wanted = places.select("wid", "n", "rid", "anchor", "anchor_off", F.explode("by_cf").alias("t")).select("wid", "n", "rid", "anchor", F.col("t.off").alias("off"), F.col("t.term").alias("term"), (F.col("anchor") + F.col("t.off") - F.col("anchor_off")).alias("at"), (F.col("t.off") == F.col("anchor_off")).alias("own"))
    shifts = F.when(F.col("own"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(-slop), F.lit(slop)))
    tried = wanted.withColumn("pos", F.explode(F.transform(shifts, lambda s: F.col("at") + s)))
    met = tried.join(postings, ["rid", "pos", "term"]).groupBy("wid", "n", "rid", "anchor", "off").agg(F.array_sort(F.collect_set("pos")).alias("ps"))
    lists = met.groupBy("wid", "n", "rid", "anchor").agg(F.array_sort(F.collect_list(F.struct("off", "ps"))).alias("lists")).where("size(lists) = n")
    # the first posting after the one before it, list by list; -1 where there is none
    chain = F.aggregate("lists", F.lit(-1), lambda last, x: F.when(last == -2, F.lit(-2)).otherwise(F.coalesce(F.array_min(F.filter(x["ps"], lambda p: p > last)), F.lit(-2))))
    start = F.array_min(F.col("lists")[0]["ps"])
    ids = index.where("n_words is not null").select("rid", "doc_id")
    return lists.withColumn("end", chain + 1).where("end > 0").select("wid", "rid", start.alias("start"), "end").distinct().join(spelled.select("wid", "item"), "wid").join(ids, "rid").select("doc_id", "item", "start", "end")
