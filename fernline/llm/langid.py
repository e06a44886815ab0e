"""Language identification: word-first backoff.

A known word scores its log frequency in each language. A word that no language knows is scored
by its character n-grams, from long to short: the longest length at which one of its n-grams
is known decides. A text's language has the largest sum of scores.

Fitting takes at most DOCS_PER_LANGUAGE labelled documents of each language, chosen by a digest of
the id (a bound that is a parameter), and keeps all their words and n-grams. Prediction reads nothing but the text.

Defined cases: null texts and texts without a letter (a character of a Unicode letter category; numerals such as ½ or Ⅷ are
none) get ``und`` with score 0; without any labelled document everything is ``und``; of languages with equal sums the
first by name wins; equal texts get equal predictions, whatever was read before; texts of any length are read
whole; an empty table gives an empty result; a null label is never learned; `identify` replaces columns with the names
of its own and keeps all others.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text

DOCS_PER_LANGUAGE = 500
#: Least score of a row that `with_language` keeps, as a multiple of the score when all languages are alike: below it, none is found.
LEAST = 1.2
#: Lengths of n-grams, in the order they are tried; a word is framed by spaces, but for single characters.
LENGTHS = (5, 4, 3, 2, 1)
#: Words whose scores a worker remembers.
MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    words = _WORD.findall(text.lower())
    if not all(map(str.isalpha, words)):  # numerals such as ½ count as a word's characters there
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        per: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            per[lang].update(words_of(text or ""))
        rows = [(lang, w, n) for lang, c in per.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], names=["lang", "word", "n"])


class Model:
    """Log frequencies by language of words and, for the rest, of character n-grams."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        k = len(self.languages)
        self.words = self._table([counts[lang] for lang in self.languages])
        self.grams = {}
        for n in LENGTHS:
            each = []
            for lang in self.languages:
                c: Counter = Counter()
                for w, times in counts[lang].items():
                    framed = f" {w} " if n > 1 else w
                    for i in range(len(framed) - n + 1):
                        c[framed[i : i + n]] += times
                each.append(c)
            self.grams[n] = self._table(each)
        self.zero = np.zeros(k, np.float32)

    def _table(self, counts: list[dict[str, int]]) -> dict[str, bytes]:
        """Scores by language, packed as 32-bit floats: a quarter of the memory of a tuple in every worker."""
        keys = set().union(*counts) if counts else set()
        totals = [sum(c.values()) for c in counts]
        size = max(1, len(keys))
        return {w: np.array([math.log((c.get(w, 0) + 0.1) / (n + 0.1 * size)) for c, n in zip(counts, totals, strict=True)], np.float32).tobytes() for w in keys}

    def word(self, w: str) -> np.ndarray:
        """Scores of a word by language: its own if any language knows it, else of its longest known n-grams (their mean)."""
        found = self.words.get(w)
        if found is not None:
            return np.frombuffer(found, np.float32)
        for n in LENGTHS:
            grams, framed = self.grams[n], f" {w} " if n > 1 else w
            known = [s for i in range(len(framed) - n + 1) if (s := grams.get(framed[i : i + n])) is not None]
            if known:
                return np.frombuffer(b"".join(known), np.float32).reshape(len(known), -1).sum(axis=0) / len(known)
        return self.zero


class Scorer(dict):
    """word -> row of a growing table of scores; words beyond MEMO are scored and forgotten.

    A text's score is the softmax of its summed log-likelihoods over the square root of its words.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows, self.extra = model, np.zeros((MEMO + 1, len(model.languages)), np.float32), []

    def __missing__(self, w: str) -> int:
        v = self.model.word(w)
        if len(self) >= MEMO:
            self.extra.append(v)
            return MEMO
        i = len(self)
        self.rows[i] = v
        self[w] = i
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return "und", 0.0
        self.extra = []
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        scores = self.rows[at]
        if self.extra:  # in their places, so that the sum doesn't depend on what is remembered
            scores[at == MEMO] = self.extra
        total = scores.sum(axis=0, dtype=np.float64)
        p = np.exp((total - total.max()) / math.sqrt(len(words)))
        best = int(np.argmax(total))
        return self.model.languages[best], float(p[best] / p.sum())


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang); rows with a null text or label are left out."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    draw = F.xxhash64(id_text(F.col("doc_id")), "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model({})
    # A little more than wanted passes a threshold on the digest; copies of a row become one, and the exact number is cut from that.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 40) * min(1.0, (1.2 * docs_per_language + 50) / n)))])
    some = rows.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 40)) < share[F.col("lang")]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 40)), "draw")
    some = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_language)
    counted = some.select("lang", "text").mapInArrow(_count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sorted(sizes)}
    for r in counted.orderBy("lang", "word").collect():  # the words of the sample
        counts[r["lang"]][r["word"]] = r["n"]
    return Model({k: v for k, v in counts.items() if v})


def predictor(docs: DataFrame, model: Model) -> Callable[[Column], Column]:
    """A column function text -> struct<lang_pred, score>; the fitted model (of bounded size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(Scorer(shared.value))
        for b in batches:
            found = [held[0].predict(t.as_py()) for t in b]  # one text at a time
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang_pred", "score"])

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(predict, "struct<lang_pred:string,score:double>")


def with_language(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` (text and any others) in whose text a language is found: with a score of ``least`` times chance, or half way from chance to 1.

    A text of which nothing is known, in another script for instance, scores as chance. Without a model no language is any likelier
    than another, and every row whose text has a letter stays.
    """
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    chance = 1 / len(model.languages)
    rows = docs.select(F.struct("*").alias("row"), predictor(docs, model)(F.col("text").cast("string")).alias("found"))
    return rows.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= min(least * chance, (1 + chance) / 2))).select("row.*")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with two more columns: lang_pred and score; their old columns of these names are replaced."""
    found = docs.select(F.struct("*").alias("row"), predictor(docs, model)(F.col("text").cast("string")).alias("found"))
    keep = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(*keep, "found.lang_pred", "found.score")
