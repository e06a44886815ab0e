"""LM scoring with Brown class-based bigrams.

``p(w | v) = p(class of w | class of v) * p(w | class of w)``. Exchange clustering puts every word of at least
MIN_COUNT occurrences into one of CLASSES classes:

1. The SEEDS most frequent words are clustered on the driver, each moving in turn to the class in which the
   likelihood of the training bigrams is highest, until a sweep changes nothing. This is only where 2 starts.
2. Distributed sweeps exchange the words of the table (the most frequent, at most TABLE): the neighbours' classes of
   each word are counted over the whole corpus, and every word moves to its best class given the class bigrams
   that the last sweep left, all words at once. Words not placed yet are neighbours of the class RARE.
3. A last sweep places all other words in the same way; their counts meet in shuffles, not in a table.

Words of fewer occurrences and unseen words are the class RARE, within which a word's probability follows its own
count plus one; the end of a text is a class of its own. The transitions are interpolated with the class frequencies;
perplexity is ``10 ** (-score / n_tokens)``.

All counts are of the whole training part. What comes to the driver and is broadcast is bounded: the table
(digest, count and class of a word), the class bigrams, and the seeds' bigrams. The texts are read twice, to count and to
write them as numbers; the sweeps and the scores read the numbers. Words are told apart by a 64-bit digest, which
two of n words share with a chance of about n*n / 4e19 (3.4e-7 for the 3.7 million of the check tool's larger table).

Tokens: A-Z lower-cased words between ASCII white space, and one end per document.

Defined cases: a null or empty text has the end token only; a null doc_id counts as the empty text in the split; without
training documents all scores are those of uniform smoothing; words of equal count are taken by digest and classes
of equal gain by number, so that ties don't depend on partitions; rows may repeat, each is scored; texts of any length are
taken whole; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_bucket, scratch, slices

CLASSES, MIN_COUNT, SEEDS, SEED_SWEEPS, SWEEPS = 40, 2, 1_000, 12, 2
#: Most words of the table that is broadcast (17 bytes each).
TABLE = 1_000_000
#: Class numbers of the end and of rare and unseen words, and how many classes there are with them.
END, RARE, WIDTH = CLASSES, CLASSES + 1, CLASSES + 2
#: Pseudo-count with which class frequencies enter the transitions.
BACKOFF = 10.0
#: Distinct words (or neighbours) that a task counts before it hands counts on, and words whose numbers a worker remembers.
FLUSH, FLUSH_NEIGHBOURS, MEMO = 300_000, 4_000_000, 200_000
#: Tokens that a task takes at once, and words of the table in one bucket of a sweep.
CHUNK, BUCKET = 1_000_000, 4096

Batches = Iterator[pa.RecordBatch]


def digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _count_words(batches: Batches) -> Batches:
    """(id, c) of the words, and of the end with a null id."""
    seen: Counter = Counter()
    ends = 0

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(digests(list(seen))), pa.array(list(seen.values()), pa.int64())], names=["id", "c"])
        seen.clear()
        return rows

    for whole in batches:
        for b in slices(whole, "text"):
            for text in b.column("text").cast(pa.binary()):
                ends += 1
                if (t := text.as_py()) is not None:
                    seen.update(t.lower().split())
                if len(seen) > FLUSH:
                    yield out()
    if seen:
        yield out()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([ends], pa.int64())], names=["id", "c"])


def band(c: str = "c"):
    """Counts in bands, sixteen to a doubling."""
    return F.floor(F.log2(c) * 16).cast("int")


def table_words(vocabulary: DataFrame, most: int = TABLE) -> tuple[np.ndarray, np.ndarray, int]:
    """Digests and counts of the table's words, the most frequent first, and the lowest band that is wholly in it.

    Bands are taken whole from the highest on; of the one that passes ``most``, the words that a draw by digest
    leaves. So no more than about ``most`` words come to the driver, however many partitions and equal counts there are.
    """
    often = vocabulary.where(F.col("id").isNotNull() & (F.col("c") >= MIN_COUNT)).withColumn("band", band())
    least, room, share = None, most, None
    for r in sorted(often.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["band"]):
        if r["n"] > room:
            share = (r["band"], int((1 << 30) * 0.98 * room / r["n"]))
            break
        least, room = r["band"], room - r["n"]
    whole = (1 << 30) if least is None else least
    wanted = F.col("band") >= whole
    if share is not None:
        wanted = wanted | ((F.col("band") == share[0]) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[1]))
    found = often.where(wanted).select("id", "c").toArrow()
    ids, counts = found["id"].to_numpy(), found["c"].to_numpy()
    order = np.lexsort((ids, -counts))[:most]
    return ids[order], counts[order], whole


def _encoder(shared) -> Callable[[Batches], Batches]:
    """Texts as numbers: for each word its rank in the table, or -1 and its digest in ``others``."""

    def encode(batches: Batches) -> Batches:
        sorted_ids, ranks = shared.value["sorted"], shared.value["ranks"]
        memo: dict[bytes, int] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                words: list[bytes] = []
                ends = [0]
                for text in b.column("text").cast(pa.binary()):
                    if (t := text.as_py()) is not None:
                        words += t.lower().split()
                    ends.append(len(words))
                own = np.fromiter(map(memo.get, words, repeat(-2)), np.int32, len(words))
                new = np.flatnonzero(own == -2)
                unknown = [words[i] for i in new.tolist()]
                ids = digests(unknown)
                if len(sorted_ids):
                    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
                    own[new] = np.where(sorted_ids[at] == ids, ranks[at], -1)
                else:
                    own[new] = -1
                if len(memo) < MEMO:
                    memo.update((w, r) for w, r in zip(unknown, own[new].tolist(), strict=True) if r >= 0)
                rest = own[new] < 0
                other_ends = np.searchsorted(new[rest], ends).tolist()
                others = ids[rest]
                lists = [[own[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], [others[x:y].tobytes() for x, y in zip(other_ends, other_ends[1:], strict=False)]]
                keep = [n for n in b.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(x, pa.binary()) for x in lists], names=[*keep, "ids", "others"])

    return encode


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and row ends (from 0 on) of a binary column of packed numbers."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and offsets[-1] > offsets[0] else np.empty(0, kind)
    return values, (offsets - offsets[0]) // size


def _sequences(batches: Batches, words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of encoded rows: the rows, their tokens (rank, ``words`` for an end, ``words + 1`` for others), their ends, and the others' digests."""
    for whole in batches:
        _, ends = _flat(whole.column("ids"), np.int32)
        first = 0
        while first < whole.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
            b = whole.slice(first, last - first)
            own, own_ends = _flat(b.column("ids"), np.int32)
            others, _ = _flat(b.column("others"), np.int64)
            rows = b.num_rows
            seq = np.full(len(own) + rows, words, np.int32)
            at = np.arange(len(own)) + np.repeat(np.arange(rows), np.diff(own_ends))
            seq[at] = np.where(own < 0, words + 1, own)
            yield b, seq, own_ends[1:] + np.arange(1, rows + 1), others
            first = last


def _tallied(key: str, totals: np.ndarray) -> Batches:
    at = np.flatnonzero(totals)
    for i in range(0, len(at), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(totals[at[i : i + 100_000]])], names=[key, "c"])


def _pair_counter(shared, words: int, width: int, open_too: bool = True) -> Callable[[Batches], Batches]:
    """Counts of the pairs of neighbours by class (of ``shared``); without ``open_too`` only where neither is one of the others."""

    def count(batches: Batches) -> Batches:
        of, total = shared.value, np.zeros(width * width, np.int64)
        for _, seq, _, _ in _sequences(batches, words):
            now = of[seq].astype(np.int64)
            before = np.concatenate(([of[words]], now[:-1]))
            pairs = before * width + now
            if not open_too:
                known = seq <= words
                pairs = pairs[known & np.concatenate(([True], known[:-1]))]
            total += np.bincount(pairs, minlength=width * width)
        yield from _tallied("pair", total)

    return count


def _square(counted: DataFrame, width: int) -> np.ndarray:
    found = counted.groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # at most width * width rows
    out = np.zeros(width * width)
    out[found["pair"].to_numpy()] = found["c"].to_numpy()
    return out.reshape(width, width)


def exchange_classes(pairs: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = SEED_SWEEPS) -> np.ndarray:
    """Exchange clustering of ids 0..words-1 given ``pairs`` (square counts; later ids stand as classes of their own).

    Maximises sum of N(c,d) log N(c,d) - sum N(c,.) log N(c,.) - sum N(.,d) log N(.,d), the part of the bigram
    likelihood that depends on the classes. Returns the class of each id of ``pairs``.
    """
    n = len(pairs)
    classes = min(classes, words)
    k = classes + n - words
    of = np.concatenate((np.arange(words) % max(1, classes), classes + np.arange(n - words))).astype(int)
    if classes < 2:
        return of

    def xlogx(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    ones = np.zeros((n, k))
    ones[np.arange(n), of] = 1
    out_to, in_from = pairs @ ones, pairs.T @ ones  # word -> class, and class -> word by word
    between = ones.T @ out_to
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            own = of[w]
            right, left, loop = out_to[w].copy(), in_from[w].copy(), float(pairs[w, w])
            right[own] -= loop
            left[own] -= loop
            # take w out of its class
            between[own] -= right
            between[:, own] -= left
            between[own, own] -= loop
            rows, cols = between.sum(1), between.sum(0)
            r, c = right.sum() + loop, left.sum() + loop
            # gain of each class g: row g gains `right`, column g gains `left`, the corner both and the loop
            g = np.arange(classes)
            gain = (xlogx(between[g] + right) - xlogx(between[g])).sum(1) + (xlogx(between[:, g].T + left) - xlogx(between[:, g].T)).sum(1)
            corner = between[g, g]
            gain += xlogx(corner + right[g] + left[g] + loop) - xlogx(corner + right[g]) - xlogx(corner + left[g]) + xlogx(corner)
            gain -= xlogx(rows[g] + r) - xlogx(rows[g]) + xlogx(cols[g] + c) - xlogx(cols[g])
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            between[best] += right
            between[:, best] += left
            between[best, best] += loop
            if best != own:
                moved += 1
                of[w] = best
                for table, counts in ((out_to, pairs[:, w]), (in_from, pairs[w])):
                    table[:, own] -= counts
                    table[:, best] += counts
        if not moved:
            break
    return of


def _growth(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(x + n) log(x + n) - x log x for n > 0, exact for large x."""
    return n * np.log(x + n) + x * np.log1p(n / np.maximum(x, 1e-300)) * (x > 0)


def best_classes(word: np.ndarray, column: np.ndarray, n: np.ndarray, own: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The class of the greatest likelihood for each word, given the class bigrams ``between`` of all words.

    ``word`` (ascending, every number from 0 on), ``column`` (class of a left neighbour, or WIDTH and that of a right one) and ``n``
    are the words' neighbours; ``own`` is a word's present class (RARE: none), out of which it is taken first. The
    corner of a class with itself is taken as two cells, a difference of second order. Of equal gains the lowest class wins.
    """
    cells = np.concatenate((between[:, :CLASSES], between.T[:, :CLASSES]))  # by column: what the class has with that neighbour
    rows, cols = between.sum(1)[:CLASSES], between.sum(0)[:CLASSES]
    out = np.empty(len(own), np.int8)
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, np.int64)
    bounds = np.append(start, len(word))
    for i in range(0, len(own), 512):
        j = min(len(own), i + 512)
        a, z = bounds[i], bounds[j]
        times, mine = n[a:z].astype(np.float64)[:, None], own[word[a:z]]
        x = cells[column[a:z]]
        placed = np.flatnonzero(mine < CLASSES)
        x[placed, mine[placed]] -= times[placed, 0]
        gain = np.add.reduceat(_growth(np.maximum(x, 0), times), bounds[i:j] - a, axis=0)
        left = column[a:z] < WIDTH
        total = np.add.reduceat(np.where(left, n[a:z], 0), bounds[i:j] - a).astype(np.float64)[:, None]
        for margin in (rows, cols):
            m = np.repeat(margin[None, :], j - i, axis=0)
            placed = np.flatnonzero(own[i:j] < CLASSES)
            m[placed, own[i:j][placed]] -= total[placed, 0]
            gain -= _growth(np.maximum(m, 0), np.maximum(total, 1e-300))
        out[i:j] = np.argmax(np.round(gain, 6), axis=1)
    return out


def _buckets(words: int, size: int) -> int:
    return max(1, -(-words // size))


def _neighbours(shared, words: int) -> Callable[[Batches], Batches]:
    """Counts of the classes beside the table's words, packed by bucket: the words of a rank modulo the number of buckets."""
    size, many, span = BUCKET, _buckets(words, BUCKET), 2 * WIDTH

    def count(batches: Batches) -> Batches:
        of = shared.value
        held: list[np.ndarray] = []
        waiting, keys, times = 0, np.empty(0, np.int64), np.empty(0, np.int64)

        def fold() -> None:
            nonlocal held, waiting, keys, times
            new, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            both = np.concatenate((keys, new))
            order = np.argsort(both, kind="stable")
            both, c = both[order], np.concatenate((times, c))[order]
            start = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
            keys, times = both[start], np.add.reduceat(c, start) if len(start) else c
            held, waiting = [], 0

        def out() -> Batches:
            nonlocal keys, times
            at = np.searchsorted(keys, np.arange(many + 1) * size * span)
            rows = [(b, x, y) for b, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if y > x]
            for i in range(0, len(rows), 64):
                part = rows[i : i + 64]
                packed = [
                    pa.array([np.diff(keys[x:y], prepend=b * size * span).astype(np.int32).tobytes() for b, x, y in part], pa.binary()),
                    pa.array([times[x:y].tobytes() if times[x:y].max() > 255 else times[x:y].astype(np.uint8).tobytes() for _, x, y in part], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in part], pa.int32()), *packed], names=["bucket", "steps", "times"])
            keys, times = np.empty(0, np.int64), np.empty(0, np.int64)

        for _, seq, _, _ in _sequences(batches, words):
            classes = of[seq].astype(np.int64)
            at = np.flatnonzero(seq < words)
            rank = seq[at].astype(np.int64)
            place = (rank % many * size + rank // many) * span
            held.append(place + np.where(at > 0, classes[at - 1], END))
            held.append(place + WIDTH + classes[np.minimum(at + 1, len(seq) - 1)])
            waiting += 2 * len(at)
            if waiting > 2 * FLUSH_NEIGHBOURS:
                fold()
                if len(keys) > FLUSH_NEIGHBOURS:
                    yield from out()
        fold()
        yield from out()

    return count


def _exchange(shared, words: int) -> Callable[[Batches], Batches]:
    """Of packed counts sorted by bucket: the new classes of each bucket's words. One bucket's counts are held at a time."""
    size, many, span = BUCKET, _buckets(words, BUCKET), 2 * WIDTH

    def exchange(batches: Batches) -> Batches:
        of, between = shared.value["of"], shared.value["between"]
        bucket, held = -1, np.zeros(size * span, np.int64)

        def out() -> pa.RecordBatch:
            ranks = np.arange(bucket, words, many)
            counts = held.reshape(size, span)[: len(ranks)]
            word, column = np.nonzero(counts)
            new = best_classes(word, column, counts[word, column], of[ranks], between)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([new.tobytes()], pa.binary())], names=["bucket", "classes"])

        for b in batches:
            for number, steps, times in zip(*[b.column(n).to_pylist() for n in ("bucket", "steps", "times")], strict=True):
                if number != bucket:
                    if bucket >= 0:
                        yield out()
                    bucket = number
                    held[:] = 0
                keys = np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int64)
                held[keys] += np.frombuffer(times, np.uint8 if len(times) < len(keys) * 8 else np.int64)
        if bucket >= 0:
            yield out()

    return exchange


def _occurrences(shared, words: int) -> Callable[[Batches], Batches]:
    """Each of the others' occurrences: its row, digest, the class (or digest) of the word before it, and the class of the one after (null: one of the others)."""

    def find(batches: Batches) -> Batches:
        of = shared.value
        for b, seq, ends, others in _sequences(batches, words):
            if not len(others):
                continue
            classes = of[seq]
            at = np.flatnonzero(seq == words + 1)
            row = np.searchsorted(ends, at, "right")
            before = np.where(at > 0, seq[at - 1], words)
            after = np.minimum(at + 1, len(seq) - 1)
            joined = before == words + 1
            last = seq[after] == words + 1
            previous = np.concatenate(([0], others[:-1]))
            columns = [
                pa.array(b.column("rid").to_numpy()[row]),
                pa.array(b.column("held_out").to_numpy(zero_copy_only=False)[row]),
                pa.array(others),
                pa.array(np.where(at > 0, classes[at - 1], END).astype(np.int32)),
                pa.array(previous, mask=~joined),
                pa.array(classes[after].astype(np.int32), mask=last),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "held_out", "id", "before", "before_id", "after"])

    return find


def _placer(shared) -> Callable[[Batches], Batches]:
    """Classes of words given as (id, beside: list of struct<column, n>)."""

    def place(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("beside")
            flat = lists.flatten()
            word = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            column, n = flat.field("column").to_numpy().astype(np.int64), flat.field("n").to_numpy()
            new = best_classes(word, column, n, np.full(b.num_rows, RARE), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(new.astype(np.int32))], names=["id", "class"])

    return place


def _scorer(shared, words: int, keep: tuple[str, ...]) -> Callable[[Batches], Batches]:
    """Sums over the tokens of the table and the ends, and over the pairs of them."""

    def score(batches: Batches) -> Batches:
        of, seen, base, emit, move = (shared.value[x] for x in ("of", "seen", "base", "emit", "move"))
        for b, seq, ends, _ in _sequences(batches, words):
            row = np.repeat(np.arange(b.num_rows), np.diff(ends, prepend=0))
            known = seq <= words
            classes = of[seq].astype(np.int64)
            before = np.concatenate(([END], classes[:-1]))
            both = known & np.concatenate(([True], known[:-1]))
            own = emit[seq] + np.where(both, move[before, classes], 0.0)
            sums = [
                np.diff(ends, prepend=0).astype(np.int64),
                np.bincount(row, seen[seq], b.num_rows).astype(np.int64),
                np.bincount(row, base[seq], b.num_rows),
                np.bincount(row, own, b.num_rows),
            ]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(x) for x in sums], names=[*keep, "n_tokens", "table_known", "table_base", "table_score"])

    return score


def _class_table(shared, encoded: DataFrame, words: int, **how: bool) -> DataFrame:
    return encoded.select("ids", "others").mapInArrow(_pair_counter(shared, words, WIDTH, **how), "pair bigint, c bigint")


def _table_classes(learn: DataFrame, words: int, send: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the table's words, the end and the others (RARE so far), and the class bigrams with them."""
    seeds = min(SEEDS, words)
    alone = np.full(words + 2, seeds + 1, np.int32)
    alone[:seeds], alone[words] = np.arange(seeds), seeds
    pairs = _square(learn.mapInArrow(_pair_counter(send(alone), words, seeds + 2), "pair bigint, c bigint"), seeds + 2)
    found = np.concatenate((exchange_classes(pairs, seeds)[:seeds], [END, RARE]))
    of = np.full(words + 2, RARE, np.int8)
    of[:seeds], of[words] = found[:seeds], END
    between = np.zeros((WIDTH, WIDTH))
    np.add.at(between, (found[:, None], found[None, :]), pairs)
    many = _buckets(words, BUCKET)
    for _ in range(SWEEPS if words else 0):
        packed = learn.mapInArrow(_neighbours(send(of), words), "bucket int, steps binary, times binary").repartition("bucket").sortWithinPartitions("bucket")
        moved = packed.mapInArrow(_exchange(send({"of": of, "between": between}), words), "bucket int, classes binary")
        new = of.copy()
        for r in moved.collect():  # a byte for each word of the table
            new[r["bucket"] : words : many] = np.frombuffer(r["classes"], np.int8)
        of = new
        between = _square(_class_table(send(of), learn, words), WIDTH)
    return of, between


def _scores(docs: DataFrame, folds: int, held_out: int, send: Callable) -> DataFrame:
    rows = docs.select("doc_id", (id_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    texts = rows.where(~F.col("held_out")).select("text")
    vocabulary = durable(texts.mapInArrow(_count_words, "id bigint, c bigint").groupBy("id").agg(F.sum("c").alias("c")))
    few = F.when(F.col("id").isNotNull() & (F.col("c") < MIN_COUNT), F.col("c"))
    sums = [F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("id").isNull(), F.col("c"))), F.sum(few), F.count(few)]
    n, v, ends, rare_tokens, rare_words = vocabulary.agg(*[F.coalesce(x, F.lit(0)) for x in sums]).first()
    ids, counts, whole = table_words(vocabulary, TABLE)
    words, order = len(ids), np.argsort(ids, kind="stable")
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "held_out", "text")
    lookup = send({"sorted": ids[order], "ranks": order.astype(np.int32)})
    encoded = durable(numbered.mapInArrow(_encoder(lookup), f"rid bigint, doc_id {kind}, held_out boolean, ids binary, others binary"))
    learn = encoded.where(~F.col("held_out")).select("ids", "others")
    of, between = _table_classes(learn, words, send)

    # The others: words beyond the table are placed, and each of their occurrences gets its class and that of the word before it.
    form = "rid bigint, held_out boolean, id bigint, before int, before_id bigint, after int"
    found = durable(encoded.select("rid", "held_out", "ids", "others").mapInArrow(_occurrences(send(of), words), form))
    learned = found.where(~F.col("held_out"))
    beside = learned.select("id", F.col("before").alias("column")).unionByName(learned.select("id", (F.coalesce("after", F.lit(RARE)) + WIDTH).alias("column")))
    beside = beside.groupBy("id", "column").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("column", "n"))).alias("beside"), F.sum(F.when(F.col("column") < WIDTH, F.col("n"))).alias("c"))
    placed = beside.where(F.col("c") >= MIN_COUNT).select("id", "beside").mapInArrow(_placer(send(between)), "id bigint, class int")
    rest = durable(vocabulary.where(F.col("id").isNotNull() & (band() < whole)).join(placed, "id", "left").select("id", "c", F.coalesce("class", F.lit(RARE)).alias("class")))
    after_own = found.where("before_id is not null").join(rest.select(F.col("id").alias("before_id"), F.col("class").alias("was")), "before_id", "left")
    both = found.where("before_id is null").drop("before_id").unionByName(after_own.withColumn("before", F.coalesce("was", F.lit(RARE))).drop("was", "before_id"))
    met = durable(both.join(rest, "id", "left").select("rid", "held_out", "before", F.coalesce("class", F.lit(RARE)).alias("class"), "after", F.coalesce("c", F.lit(0)).alias("c")))
    known = met.where(~F.col("held_out"))
    pairs = [(F.col("before") * WIDTH + F.col("class"), known), (F.col("class") * WIDTH + F.col("after"), known.where("after is not null"))]
    counted = _class_table(send(of), learn, words, open_too=False)
    for pair, among in pairs:
        counted = counted.unionByName(among.groupBy(pair.cast("bigint").alias("pair")).agg(F.count(F.lit(1)).alias("c")))
    between = _square(counted, WIDTH)

    into = (between.sum(0) + 1) / (between.sum() + WIDTH)
    move = np.log10((between + BACKOFF * into) / (between.sum(1, keepdims=True) + BACKOFF))
    held = np.log10(np.maximum(between.sum(0), 1))
    floor, rare_floor = float(np.log10(n + v + 1)), float(np.log10(rare_tokens + rare_words + 1))
    emit = np.concatenate((np.log10(counts) - held[of[:words]], [0.0, 0.0]))
    base = np.concatenate((np.log10(counts + 1.0) - floor, [np.log10(ends + 1.0) - floor, 0.0]))
    seen = np.concatenate((np.ones(words), [float(ends > 0), 0.0]))
    tables = send({"of": of, "seen": seen, "base": base, "emit": emit, "move": move})
    keep = ("rid", "doc_id", "held_out")
    form = f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, table_known bigint, table_base double, table_score double"
    scored = encoded.mapInArrow(_scorer(tables, words, keep), form)
    moves, totals = F.lit(move.ravel().tolist()), F.lit(held.tolist())
    of_class = F.when(F.col("class") == RARE, F.log10(F.col("c") + F.lit(1.0)) - rare_floor).otherwise(F.log10("c") - F.get(totals, F.col("class")))
    onward = F.coalesce(F.get(moves, F.col("class") * WIDTH + F.col("after")), F.lit(0.0))
    own = F.get(moves, F.col("before") * WIDTH + F.col("class")) + of_class + onward
    more = met.groupBy("rid").agg(F.count_if(F.col("c") > 0).alias("known"), F.sum(F.log10(F.col("c") + F.lit(1.0)) - floor).alias("base"), F.sum(own).alias("own"))
    zero = F.lit(0.0)
    return scored.join(more, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("table_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("table_base") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("table_score") + F.coalesce("own", zero)).alias("score"),
    )


def class_lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of ``docs`` (doc_id, text).

    Documents whose crc32(doc_id as text) modulo ``folds`` is ``held_out`` are not learned from.
    """
    spark, sent = docs.sparkSession, []

    def send(value: object):
        sent.append(spark.sparkContext.broadcast(value))
        return sent[-1]

    with scratch(spark):
        result = durable(_scores(docs, folds, held_out, send), keep=True)
    for x in sent:
        x.destroy()
    return result.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
