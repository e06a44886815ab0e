import hashlib
import os
from collections import Counter

import corpus_pipeline
from fernline.llm import decontaminate, queries, simhash

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [
        (None, None, "en", "src1", 0), (900001, None, "en", "src1", 0), (900002, "1234 !!", "en", "src1", 7), (900003, "", None, None, 0), (None, "a text without an id", "en", "src1", 20), (None, "a text without an id", "en", "src1", 20),
        (900004, "the same text twice over here", "en", "src2", 30), (900004, "the same text twice over here", "en", "src2", 30), (900005, "the same text twice over here", None, "src3", 30), (900006, "word", "en", None, 4),
    ]
    docs = own.unionByName(spark.createDataFrame(odd, own.schema)).withColumnRenamed("n_chars", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]

    def rows(df):
        return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]

    def step(name, df):
        path = str(tmp_path / name)
        stages[name](spark, df, SF).write.parquet(path)
        return spark.read.parquet(path)

    said = step("language_id", docs)
    assert said.columns == docs.columns
    assert Counter(rows(said)) == Counter(r for r in rows(docs) if r[1] and any(c.isalpha() for c in r[1]))

    kept = step("simhash_near_dedup", said)
    before = rows(said)
    groups = {}
    for (d, t, _), (_, _, c) in zip(before, brute.near_duplicates([(i, t) for i, (_, t, _) in enumerate(before)]), strict=True):
        groups.setdefault(c, []).append((d is None, d, t))
    assert Counter((d, t) for d, t, _ in rows(kept)) == Counter(min(g, key=lambda x: (x[0], x[1] or 0))[1:] for g in groups.values())

    clean = step("benchmark_decontamination", kept)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {(d, t) for (d, t, _), x in zip(rows(kept), brute.contamination([r[:2] for r in rows(kept)], items), strict=True) if x[5]}
    assert dirty and Counter(rows(clean)) == Counter(r for r in rows(kept) if r[:2] not in dirty)

    mixed = step("source_mixing", clean)
    assert mixed.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for _, t, s in rows(clean):
        sizes[s] += len(brute.tokens(t)) - 1
    for _, t, s in rows(mixed):
        taken[s] += len(brute.tokens(t)) - 1
    targets = brute.source_targets(dict(sizes))
    assert sum(abs(taken[s] - targets[s]) for s in targets) < 0.2 * sum(targets.values())
    assert max(Counter(rows(mixed)).values()) <= 3

    dealt = step("sharding", mixed)
    assert Counter(r.doc_id for r in dealt.collect()) == Counter(d for d, _, _ in rows(mixed))


CLASHES = ("row", "key", "found", "fp", "rid", "size", "shard", "lang_pred", "score", "copies", "k", "n", "hit", "component_id")


def odd_documents(spark, schema, labelled=True):
    """Repeated ids with different texts, repeated rows, nulls everywhere, ties, a long text, and columns with the stages' own names."""
    from pyspark.sql import functions as F

    prose = "the ship sailed over the sea and the sailors sang of home while the wind blew from the west all night long"
    rows = [
        (1, prose, "en", "a", 1), (2, prose + " again", "en", "a", 1), (2, "Das Schiff fuhr weit hinaus und niemand wusste wohin die Reise gehen sollte", "de", "b", 1), (3, prose + " again", "en", None, 1),
        (3, prose + " again", "en", None, 1), (None, "a clean text without an id that stands alone here", None, "a", None), (None, None, None, None, None), (4, "", "en", "a", 0), (5, " \n", "en", "", 2), (6, "12 34 ½ Ⅷ", "en", "a", 9),
        (7, "word " * 50_000, "en", "b", 250_000), (None, "x", None, None, 1), (8, "Ship", "en", "a", 4), (9, "ship", "en", "b", 4), (10, "漢字 中文 字", None, "b", 7),
    ]
    frame = spark.createDataFrame([r if labelled else (*r[:2], None, *r[3:]) for r in rows], schema)
    for c in CLASHES:
        frame = frame.withColumn(c, F.lit(c))
    return frame, rows


def test_stages_on_odd_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs, rows = odd_documents(spark, schema)
    stages = dict(corpus_pipeline.STAGES)
    bench = tmp_path / "benchmark.parquet"
    spark.createDataFrame([(1, "Schiff fuhr weit hinaus und niemand wusste wohin die Reise gehen")], "item_id long, text string").write.parquet(str(bench))

    def texts(df):
        return Counter((r.doc_id, r.text) for r in df.collect())

    def all_texts(keep=lambda r: True):
        return Counter(r[:2] for r in rows if keep(r))

    has_letter = lambda r: any(c.isalpha() for c in r[1] or "")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(r[c] == c for r in out.collect() for c in CLASHES), name
    # no language is found where nothing of a text is known
    assert texts(stages["language_id"](spark, docs, str(tmp_path))) == all_texts(lambda r: has_letter(r) and r[1] not in ("x", "漢字 中文 字"))
    unlabelled, _ = odd_documents(spark, schema, labelled=False)
    assert texts(stages["language_id"](spark, unlabelled, str(tmp_path))) == all_texts(has_letter)
    german = rows[2][:2]
    assert texts(stages["benchmark_decontamination"](spark, docs, str(tmp_path))) == all_texts(lambda r: r[:2] != german)
    groups = {}
    for (d, t), (_, _, c) in zip([r[:2] for r in rows], brute.near_duplicates([(i, r[1]) for i, r in enumerate(rows)]), strict=True):
        groups.setdefault(c, []).append((d is None, d or 0, hashlib.sha256(t.encode()).hexdigest() if t is not None else "", d, t))
    assert texts(stages["simhash_near_dedup"](spark, docs, str(tmp_path))) == Counter(min(g, key=lambda x: x[:3])[3:] for g in groups.values())
    dealt = stages["sharding"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in dealt) == Counter(r[0] for r in rows)


def test_stages_on_empty_tables(spark, tmp_path):
    docs, _ = odd_documents(spark, spark.read.parquet(f"{SF}/documents.parquet").schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)
    assert corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_run_leaves_only_its_result(spark, tmp_path):
    from fernline.llm.common import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    n = corpus_pipeline.run(spark, SF).count()
    left = set(os.listdir(shared_dir(spark))) - before
    assert n > 100 and len(left) == 1 and "sharding" in left.pop()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("shard between 0 and 23").count() > 100
    assert set(queries.queries()) == {f.__name__ for f in (queries.op1_url_filters, queries.op2_pii, queries.op3_brown_lm, queries.op4_decontaminate, queries.op5_mpeg_audio, queries.op6_langid, queries.op7_simhash, queries.op8_mix_sources, queries.op9_token_counts, queries.op10_shard_tree)}


def test_different_texts_of_one_id(spark):
    shared = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [
        (3, shared), (5, shared), (5, "nothing in common with the other text of this id"), (5, "a third and quite different story about ships"),
        (6, "one two three four five six seven eight nine ten eleven"), (6, "a clean text that stands beside a contaminated one"), (None, "a clean text without an id"), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(tuple(r) for r in simhash.without_near_duplicates(docs.unionByName(docs)).collect())
    assert kept == Counter(r for r in rows if r != (5, shared))
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    clean = Counter(tuple(r) for r in decontaminate.without_contaminated(docs, bench).collect())
    assert clean == Counter(r for r in rows if not (r[1] or "").startswith("one two"))
