"""SimHash near-duplicates with BK-trees.

Fingerprints: 64-bit SimHash over the XXH64 values (seed 42) of 4-word shingles. Two documents are
linked when their fingerprints differ in at most four bits.

The distinct fingerprints are dealt to shards by the pigeonhole principle: of six blocks of a
fingerprint, four differing bits leave at least two untouched, so linked fingerprints share one of
the fifteen pairs of blocks. Each shard is a BK-tree (children keyed by the integer Hamming
distance to their parent) in the task that owns the shard, and every link is found by a search of a tree, which follows only
the edges within the radius. The trees are dealt by a shuffle and not broadcast, since all trees together
grow with the corpus and may not pass through the driver. A shard of more than SHARD_ROWS fingerprints is split into parts, and its
fingerprints search all parts, the parts' trees being bounded in size. A shard reports a
spanning forest of its links, never all pairs of a group; components are then joined across shards.

Defined cases: null texts and texts without a word have fingerprint zero and link to one another;
fewer than four words make one shingle; equal texts share a fingerprint; a null doc_id is never a
component's id unless all its documents have none; rows may repeat, and texts of any length are taken whole; other
columns are not read, and `without_near_duplicates` keeps them all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, finished, row_key, scratch, small
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: (first bit, width) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: The most fingerprints of one tree.
SHARD_ROWS = 100_000
#: Most keys of removed rows (counted) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Shards of up to so many fingerprints are searched while their tree grows, value by value.
GROWN = 1_000
#: In larger trees, which are built at once, a node with so few fingerprints below it keeps them as a list.
LEAF = 48
#: Bits are summed over so many shingles at a time.
SUM_ROWS = 32_768


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 text as an unsigned number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    last = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, first, last)), repeat(SEED)), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SUM_ROWS):
        part = hashes[i : i + SUM_ROWS]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for i in range(0, b.num_rows, 256):
            found = np.array([fingerprint(t.as_py()) for t in texts[i : i + 256]], np.uint64).view(np.int64)
            keep = b.slice(i, 256)
            yield pa.RecordBatch.from_arrays([keep.column(j) for j in range(keep.num_columns) if keep.schema.names[j] != "text"] + [pa.array(found)], names=[n for n in keep.schema.names if n != "text"] + ["fp"])


def with_fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and fp, the fingerprint as a signed long."""
    from pyspark.sql.types import LongType, StructField, StructType

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = StructType([f for f in rows.schema.fields if f.name != "text"] + [StructField("fp", LongType())])
    return rows.mapInArrow(_fingerprints, schema)


class BKTree:
    """A static BK-tree over distinct fingerprints, built at once: children are keyed by distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.root = self._build(np.arange(len(values)))

    def _build(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids
        away = np.bitwise_count(self.values[ids[1:]] ^ self.values[ids[0]])
        return int(ids[0]), int(self.values[ids[0]]), {int(d): self._build(ids[1:][away == d]) for d in np.unique(away)}

    def near(self, value: int, radius: int = RADIUS) -> np.ndarray:
        """Indexes of the values within ``radius`` of ``value``."""
        found, todo, v = [], [self.root], np.uint64(value)
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                d = (node[1] ^ value).bit_count()
                if d <= radius:
                    found.append(np.array([node[0]]))
                todo += [child for k, child in node[2].items() if d - radius <= k <= d + radius]
            elif len(node):
                found.append(node[np.bitwise_count(self.values[node] ^ v) <= radius])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def grown_forest(values: list[int]) -> list[tuple[int, int]]:
    """The same as `forest` for a few values: each searches the tree of those before it, and is then put into it."""
    root: tuple[int, int, dict] = (0, values[0], {})
    group, edges = list(range(len(values))), []

    def head(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i, value in enumerate(values[1:], 1):
        todo = [root]
        while todo:
            j, other, children = todo.pop()
            d = (other ^ value).bit_count()
            if d <= RADIUS and (a := head(i)) != (b := head(j)):
                group[a] = b
                edges.append((j, i))
            todo += [children[k] for k in range(d - RADIUS, d + RADIUS + 1) if k in children]
        node = root
        while (d := (node[1] ^ value).bit_count()) in node[2]:
            node = node[2][d]
        node[2][d] = (i, value, {})
    return edges


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of indexes that join the values within the radius of one another: a spanning tree of each group."""
    if len(values) <= GROWN:
        return grown_forest(values.tolist())
    tree, seen, edges = BKTree(values), np.zeros(len(values), bool), []
    for i in range(len(values)):
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            j = todo.pop()
            near = tree.near(int(values[j]))
            near = near[~seen[near]]
            seen[near] = True
            edges += [(j, int(k)) for k in near]
            todo += near.tolist()
    return edges


def _out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


class _Shard:
    """A split shard's part: its members' tree, and of each member the number of the group that its links lead to."""

    def __init__(self, members: np.ndarray):
        self.members, pairs = members, forest(members)
        self.tree, group = BKTree(members), list(range(len(members)))

        def head(i: int) -> int:
            while group[i] != i:
                group[i] = i = group[group[i]]
            return i

        for i, j in pairs:
            group[head(j)] = head(i)
        self.group = np.array([head(i) for i in range(len(members))], np.int64)
        self.pairs = np.array(pairs, np.int64).reshape(-1, 2)

    def own(self) -> pa.RecordBatch:
        return _out(self.members[self.pairs[:, 0]], self.members[self.pairs[:, 1]])

    def search(self, guests: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of other parts' fingerprints: one to each group of members they touch."""
        for g in guests:
            near = self.tree.near(int(g))
            if len(near):
                near = near[np.unique(self.group[near], return_index=True)[1]]
                yield _out(np.repeat(g, len(near)), self.members[near])


def _whole_shards(fp: np.ndarray, key: np.ndarray, part: np.ndarray, member: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links within shards of which all rows are at hand."""
    if not len(fp):
        return
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
    size = np.diff(np.append(start, len(fp)))
    own = np.add.reduceat(member, start, dtype=np.int64)
    whole = (own == size) & (size > 1)
    a: list[int] = []
    b: list[int] = []
    for s, n in zip(start[whole].tolist(), size[whole].tolist(), strict=True):
        for i, j in forest(fp[s : s + n]):
            a.append(s + i)
            b.append(s + j)
    if a:
        yield _out(fp[a], fp[b])
    for s, n in zip(start[own < size].tolist(), size[own < size].tolist(), strict=True):
        inside = member[s : s + n] == 1
        if inside.any():
            shard = _Shard(fp[s : s + n][inside])
            yield shard.own()
            yield from shard.search(fp[s : s + n][~inside])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard, with its members first: links within the shards.

    At most a batch and the members of one shard are held: once a shard's members are complete, its
    guests are searched for as they come.
    """
    held: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8)]
    still: tuple[int, int, _Shard] | None = None
    for b in batches:
        more = [b.column("fp").to_numpy().view(np.uint64), b.column("key").to_numpy(), b.column("part").to_numpy(), b.column("member").to_numpy()]
        if still is not None:
            other = np.flatnonzero((more[1] != still[0]) | (more[2] != still[1]))
            n = int(other[0]) if len(other) else len(more[0])
            yield from still[2].search(more[0][:n])
            more = [x[n:] for x in more]
            if len(other):
                still = None
        fp, key, part, member = held = [np.concatenate(x) for x in zip(held, more, strict=True)]
        if not len(fp):
            continue
        last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last shard may go on in the next batch
        yield from _whole_shards(*[x[:cut] for x in held])
        held = [x[cut:] for x in held]
        if held[3][-1] == 0:
            inside = held[3] == 1
            still = int(held[1][-1]), int(held[2][-1]), _Shard(held[0][inside])
            yield still[2].own()
            yield from still[2].search(held[0][~inside])
            held = [x[:0] for x in held]
    yield from _whole_shards(*held)


def shard_keys(fp: Column) -> Column:
    """The fifteen shard numbers of a fingerprint: a pair of blocks and their bits."""

    def block(at: int, width: int) -> Column:
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))

    pairs = combinations(BLOCKS, len(BLOCKS) - RADIUS)
    return F.array(*[F.lit(k << 22).cast("bigint") + F.shiftleft(block(*x), 11) + block(*y) for k, (x, y) in enumerate(pairs)])


def links(fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Of distinct fingerprints (fp): links (a, b) that join all within the radius of one another."""
    dealt = fps.select("fp", F.explode(shard_keys(F.col("fp"))).alias("key"))
    large = durable(dealt.groupBy("key").count().where(F.col("count") > shard_rows).select("key", F.ceil(F.col("count") / shard_rows).cast("bigint").alias("parts")))
    if large.limit(1).count():
        dealt = dealt.join(large, "key", "left").withColumn("home", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
        dealt = dealt.select("fp", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "home")
        dealt = dealt.select("fp", "key", "part", (F.col("part") == F.col("home")).cast("tinyint").alias("member"))
    else:
        dealt = dealt.select("fp", "key", F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("tinyint").alias("member"))
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", F.desc("member")).mapInArrow(_links, "a bigint, b bigint")


def fingerprint_groups(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp) to one row per fingerprint: fp, root (of its component), component_id (the least doc_id reachable)."""
    per = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = durable(connected_components(links(per.select("fp"))))
    joined = per.join(roots, per["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(ids, "root").select("fp", "root", "component_id")


def _near_duplicates(docs: DataFrame) -> DataFrame:
    prints = durable(with_fingerprints(docs, "doc_id"))
    groups = fingerprint_groups(prints)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs`` (doc_id, text)."""
    return finished(docs.sparkSession, lambda: _near_duplicates(docs))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates of ``docs`` (doc_id, text and any others): the one with the least doc_id.

    Of texts that share that id, and in a group without ids, the one with the least digest stays; of rows that
    repeat both id and text, one.
    """
    key = row_key(F.col("doc_id"), F.col("text")).alias("key")
    with scratch(docs.sparkSession):
        prints = durable(with_fingerprints(docs.select("doc_id", key, "text"), "doc_id", "key"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "key"))
        kept = durable(prints.join(fingerprint_groups(prints), "fp").groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias("key")).distinct())
        repeated = prints.groupBy("key").count().where("count > 1").limit(1).count()
        # The keys that go are far fewer than those that stay, so the texts needn't be shuffled for them as long as they are few.
        gone = durable(prints.select("key").distinct().join(kept, "key", "left_anti"), keep=True)
    stay = docs.select(F.struct("*").alias("row"), key).join(small(gone, BROADCAST_KEYS), "key", "left_anti")
    if repeated:
        stay = stay.dropDuplicates(["key"])
    return stay.select("row.*")
