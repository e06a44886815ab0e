import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernline.llm import brown_lm, components, decontaminate, langid, mixing, mpeg_audio, pii, queries, sharding, simhash, token_counts, url_filters

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing names."""
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [
        (None, None, None, None), (900001, None, "en", "src1"), (900002, "", "en", None), (900003, "   \t\n\x0b ", None, "src1"), (900004, "One", "en", "src1"),
        (900004, "One", "en", "src1"), (900005, "one two three", "en", "src1"), (900006, "1234 !!! 5678", "en", ""), (900007, "É é ÀB ab", "fr", "src2"), (900008, "x" * 5000, "en", "src1"),
        (900009, "ask to@a.b.c+d@e.fr, 1.2.3.4.5.6.7.8 or 300.1.1.1; 4111 1111 1111 1111 +1 (614) 555-8001 +12-", "en", "src1"), (None, "ask", "en", "src1"), (None, "ask", "en", "src1"),
        (900010, "a@b.cc@d.com 4111-1111-1111-1112 00001.2.3.255 +1.2.3.4.5.6.7.8.9.10", None, "src9"), (900011, "word " * 3000, "en", "src1"), (900012, "😀 a😀b@c.de ▁ x  y ", "en", "src1"),
        (900013, " ".join(f"w{i % 700} é{i % 11}" for i in range(30_000)), "en", "src2"),
    ]
    frame = own.unionByName(spark.createDataFrame(odd, own.schema))
    for clash in ("size", "fp", "key", "rid", "shard", "words", "lang_pred", "row", "n"):
        frame = frame.withColumn(clash, F.lit("clash"))
    return frame.persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]


def same(frame, expected, columns):
    got = Counter(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())
    assert got == Counter(tuple(x) for x in expected)


def empty(docs):
    return docs.limit(0)


def test_url_filters(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "http://", "http://COM/en/", "http://a.EXAMPLE.com/en/7?x", "https://example.net/de/88#t", "x://example.net/de/7", "ftp://notexample.com/en/7", "http://example.com:80/en/7", "http://org/es/a://b/c", "http://a..com/en/x", "http://xcom/en/"]
    urls += urls[:3]
    pages = spark.createDataFrame([(i if i % 7 else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    expected = [(i if i % 7 else None, *brute.judge(u, queries.URL_RULES)) for i, u in enumerate(urls)]
    same(url_filters.judge_urls(pages, rules), expected, columns)
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    try:
        old = url_filters.BROADCAST_RULES, url_filters.MAX_SHAPES, url_filters.BROADCAST_PLACES
        url_filters.BROADCAST_RULES, url_filters.MAX_SHAPES, url_filters.BROADCAST_PLACES = 1, 1, 1
        same(url_filters.judge_urls(pages, rules), expected, columns)
    finally:
        url_filters.BROADCAST_RULES, url_filters.MAX_SHAPES, url_filters.BROADCAST_PLACES = old


def test_pii_base(docs, rows):
    found = pii.personal_data(docs)
    same(found, [(d, *brute.pii(t)[:5]) for d, t, _, _ in rows], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    assert pii.personal_data(empty(docs)).count() == 0


def pii_corpus():
    """(text, planted spans): seeds with cues on both sides, unseen identifiers behind the same cues, a cue that only discovered ones bring, and look-alikes."""
    rng, out = random.Random(11), []

    def number(form):
        return "".join(str(rng.randrange(10)) if c == "9" else c for c in form)

    def row(text, kind=None, found=None):
        a = text.index(found) if found else 0
        out.append((text, f"{kind}:{a}:{a + len(found)}" if found else None))

    for i in range(30):
        row(f"please call +1 (614) 555-{8000 + i} now and then item {i}")
        row(f"write to person{i}.x@mail{i % 3}.example.com office hours")
    twice = [number("9999 9999") for _ in range(14)]
    for i in range(40):
        unseen = number(["999 555 9999", "(999) 555-9999", "999-999-9999", "99 99 99 99 99", "999.555.9999"][i % 5])
        row(f"{'x' * (i % 7)} please call{' :'[i % 2]}{unseen} today", "phone", unseen)
        unseen = f"person{i}(at)site{i}.org" if i % 2 else f"someone{i}@intranet"
        row(f"write to {unseen} or come", "email", unseen)
    for t in twice:
        row(f"then call {t} later", "phone", t)
        row(f"or ring {t} again", "phone", t)
    for _ in range(10):
        unseen = number("9999 9999 99")
        row(f"so ring {unseen} once", "phone", unseen)
    for i in range(60):
        row(f"the order {number('999-999-9999')} came, bill {number('9999')}, {number('9999 9999')} pieces and part {number('99/9999')}")
    return out


def test_pii_discovers_by_context(spark):
    corpus = pii_corpus()
    found = pii.personal_data(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus)], "doc_id long, text string"))
    got = {r.doc_id: r for r in found.collect()}
    planted = {i: s for i, (_, s) in enumerate(corpus) if s}
    assert sum(s in got[i].spans.split(",") for i, s in planted.items()) >= 0.9 * len(planted)
    assert all(got[i].n_added == 0 and got[i].spans == brute.pii(corpus[i][0])[5] for i in got if i not in planted)
    ring = [i for i, (t, _) in enumerate(corpus) if t.startswith("so ring")]
    assert all(got[i].n_added == 1 for i in ring)  # no seed ever stands behind that cue


def test_pii_spans_against_brute_force(spark, docs, rows):
    texts = [(d, t) for d, t, _, _ in rows] + [(2_000_000 + i, t) for i, (t, _) in enumerate(pii_corpus())]
    texts += [(3_000_000 + i, f"card 4{i:04d}56789012345 code {i}, tie +1234567{i:03d} 12.1.1.{i} tie 99.{i}.1.1 +99{i:03d}4567 {'1.' * (i % 7)}") for i in range(40)]
    texts += [(None, "tie 1234 5678"), (None, "call(at)me [at] x.y@z 5555-55a 1+2345 (12) 34-5 １２３４ ½1234 1234é é1234 1234_ -1234 .1234 12//34 1  2  3 4")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("inst", F.lit("clash")).withColumn("ord", F.lit("clash"))
    expected = brute.bootstrapped_spans(texts, pii.ROUNDS, pii.CONFIDENCE, pii.SUPPORT, pii.MIN_DIGITS, pii.LONG, pii.UNKNOWN)
    assert sum(x[2] for x in expected) > 100
    same(pii.personal_data(frame), expected, ["doc_id", "spans", "n_added"])
    same(pii.personal_data(frame.repartition(9)), expected, ["doc_id", "spans", "n_added"])


def test_pii_long_texts_take_linear_time(spark):
    import time

    texts = ["".join(f"{i} 12.34.56.{i % 300} a{i}@b " for i in range(100_000 // 3)), "7 " * 100_000, "x@y " * 50_000, "1." * 100_000, "word " * 100_000 + "+12345678901"]
    began = time.time()
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 90
    assert got[0].n_ip == sum(i % 300 <= 255 for i in range(100_000 // 3)) and got[4].spans == "phone:500000:500012"


def test_class_lm(docs, rows):
    got = brown_lm.class_lm_scores(docs)
    key = lambda x: (str(x[0]), x[2], x[3], round(x[5], 6))
    have = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got.collect()), key=key)
    for a, b in zip(have, sorted(brute.lm_base([r[:2] for r in rows]), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # classes predict unseen text better than single words
    assert brown_lm.class_lm_scores(empty(docs)).count() == 0


def test_class_lm_is_a_distribution(spark):
    text = ["a b a c", "b a d", "c c a e f", "a b g h"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text) if brute.crc_mod(i, 7) != 2], "doc_id long, text string")
    vocabulary = sorted({w for t in text for w in t.split()})
    ask = [(1000 + i, w) for i, w in enumerate([*vocabulary, ""])]
    ask = [(d, w) for d, w in ask]
    ids = [i for i in range(1000, 9000) if brute.crc_mod(i, 7) == 2][: len(ask)]
    probe = spark.createDataFrame([(i, w) for i, (_, w) in zip(ids, ask, strict=True)], "doc_id long, text string")
    got = {r.doc_id: 10**r.score for r in brown_lm.class_lm_scores(docs.unionByName(probe)).collect()}
    assert all(0 < got[i] <= 1 for i in ids) and sum(got[i] for i in ids) <= 1 + 1e-9


@pytest.mark.parametrize("most", [100_000, 60, 0])
def test_class_lm_against_brute_force(spark, monkeypatch, most):
    """Scores word by word: with a table of all words, of a part (the rest is placed by shuffles) and of none; many equal counts."""
    own = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 500").select("doc_id", "text").limit(60).collect()
    rows = [tuple(r) for r in own] + [(None, None), (7, ""), (900, "a b a b zz"), (901, "a b a b zz"), (901, "a b a b zz"), (902, "b a q1 q2 q1 q2 q3"), (903, "q1 q2 Q3 unseen words here"), (904, "x " * 700)]
    rows += [(1000 + i, f"w{i % 90} v{(i * 7) % 90} w{i % 90}") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("clash")).withColumn("class", F.lit("clash"))
    monkeypatch.setattr(brown_lm, "TABLE", most)
    monkeypatch.setattr(brown_lm, "SEEDS", 30)
    monkeypatch.setattr(brown_lm, "BUCKET", 16)
    learned = [brute.tokens(t) for d, t in rows if brute.crc_mod(d, 7) != 2]
    counts = Counter(w for ts in learned for w in ts if w is not None)
    number = {int(brown_lm.digests([w.encode()])[0]): w for w in counts}
    vocabulary = spark.createDataFrame([(i, counts[w]) for i, w in number.items()], "id long, c long")
    table = [number[int(i)] for i in brown_lm.table_words(vocabulary, most)[0]]
    assert len(table) == min(most, sum(c >= 2 for c in counts.values())) or most == 60 and 30 < len(table) <= 60
    seeds = lambda pairs, m: brown_lm.exchange_classes(np.array(pairs), m)[:m]
    expected = brute.class_lm(rows, table, seeds, brown_lm.CLASSES, 30, brown_lm.SWEEPS, brown_lm.BACKOFF)
    got = brown_lm.class_lm_scores(docs).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(d), round(x, 6)) for d, x in expected)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)


def test_best_class_is_the_one_of_greatest_likelihood():
    """A word's best class is found by trying all: the likelihood of the class bigrams with the word in each."""
    rng = np.random.default_rng(2)
    k, width = brown_lm.CLASSES, brown_lm.WIDTH
    between = rng.integers(1, 4000, (width, width)).astype(float)
    left, right = rng.integers(0, 9, width), rng.integers(0, 9, width)
    right[0] += left.sum() - right.sum()
    left[:k], right[:k] = left[:k] * (np.arange(k) % 2), right[:k] * (1 - np.arange(k) % 2)  # no corner: both neighbours never in one class
    right[k] += left.sum() - right.sum()

    def likelihood(g):
        x = between.copy()
        x[:, g] += left
        x[g] += right
        return (x * np.log(np.maximum(x, 1))).sum() - sum((s * np.log(np.maximum(s, 1))).sum() for s in (x.sum(0)[:k], x.sum(1)[:k]))

    column = np.concatenate((np.flatnonzero(left), width + np.flatnonzero(right)))
    n = np.concatenate((left[left > 0], right[right > 0]))
    found = brown_lm.best_classes(np.zeros(len(n), int), column, n, np.array([brown_lm.RARE]), between)
    assert found[0] == max(range(k), key=likelihood)


def test_exchange_clustering_finds_groups():
    pairs = np.zeros((7, 7))
    for a in (0, 2, 4):
        for b in (1, 3, 5):
            pairs[a, b] = pairs[b, a] = 10
    of = brown_lm.exchange_classes(pairs, 6, classes=2)
    assert len(set(of[[0, 2, 4]])) == len(set(of[[1, 3, 5]])) == 1 and of[0] != of[1] and of[6] == 2


def test_decontaminate(spark, docs, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(77, "one"), (78, "Two three"), (78, None), (None, "É é"), (80, "..."), (items[0][0] + 500, items[0][1]), (90, "word " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = brute.contamination([r[:2] for r in rows], items)
    assert sum(x[5] for x in expected) > 5
    same(decontaminate.contamination(docs, bench), expected, columns)
    old = decontaminate.BROADCAST_TERMS, decontaminate.BROADCAST_DOCS
    try:
        decontaminate.BROADCAST_TERMS, decontaminate.BROADCAST_DOCS = 1, 1
        same(decontaminate.contamination(docs, bench), expected, columns)
    finally:
        decontaminate.BROADCAST_TERMS, decontaminate.BROADCAST_DOCS = old
    assert decontaminate.contamination(empty(docs), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick and brown fox"), (3, "quick fox brown"), (4, "brown quick zzz fox")], "doc_id long, text string")
    phrases = spark.createDataFrame([("p", "quick brown fox")], "item string, text string")
    got = {(r.doc_id, r.start, r.end) for r in decontaminate.proximity(docs, phrases, slop=1).collect()}
    assert got == {(1, 1, 4), (2, 1, 5)}


def test_mpeg_round_trip(docs, rows):
    got = mpeg_audio.media_columns(docs)
    expected = []
    for d, t, _, _ in rows:
        payload = (b := (t or "").encode()) + b"\xff" * ((-len(b)) % 576 if b else 576)
        expected.append((d, len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    same(got, expected, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"])
    for r in got.collect():
        assert f"samples={r.payload_bytes};rate=16000" in r.feature and "bad_crc=0;skipped=0" in r.feature
    assert mpeg_audio.media_columns(empty(docs)).count() == 0


def test_mpeg_parser(spark):
    media = mpeg_audio.pack(mpeg_audio.payload_of(("\xff" * 3000).encode("latin-1")))
    tag = b"ID3\x04\x00\x00\x00\x00\x00\x12TIT2\x00\x00\x00\x06\x00\x00\x03Title\x00\x00"
    end = b"TAG" + b"Song".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    s = mpeg_audio.parse(tag + b"junk\xff\xf2" + media + end)
    assert (len(s.offsets), s.samples, s.rate, s.skipped, s.bad_crc) == (6, 6 * 576, 16000, 6, 0)
    assert s.offsets[0] == len(tag) + 6 + 648 and s.vbr == {"frames": 6, "bytes": len(media)} and s.kbps == {144, 160}
    assert s.tags == {"TIT2": "Title", "title": "Song", "artist": "Artist"} and s.seconds == 6 * 576 / 16000
    broken = bytearray(media)
    broken[648 + 8] ^= 1  # in the side information of the first frame
    assert mpeg_audio.parse(bytes(broken)).bad_crc == 1
    cut = media[:700] + media[1000:]  # the stream is found again after a hole
    assert mpeg_audio.parse(cut).skipped and len(mpeg_audio.parse(cut).offsets) >= 4
    frame = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"no"))], "id long, media binary")
    got = {r.id: r.audio for r in mpeg_audio.audio_index(frame).collect()}
    assert got[1].frames == 6 and got[1].offsets == mpeg_audio.parse(media).offsets and got[2].frames == 0 and got[3].skipped == 2


def test_mpeg_columns_against_a_plain_reader(docs, rows):
    """Media, durations and offsets as a reader finds them that only knows the written layout."""
    expected = []
    for d, t, _, _ in rows:
        payload = mpeg_audio.payload_of((t or "").encode() or None)
        n = len(payload) // 576
        media = mpeg_audio.pack(payload)
        at = [648 + 648 * i for i in range(n)]
        assert b"".join(media[o + 15 : o + 591] for o in at) == payload and len(media) == 648 * n + 720
        assert all(media[o : o + 2] == b"\xff\xf2" for o in at) and media[15:19] == b"Xing" and int.from_bytes(media[23:27], "big") == n
        seek = zlib.crc32(b"".join(o.to_bytes(8, "big") for o in at))
        told = f"frames={n};samples={n * 576};rate=16000;channels=1;kbps={'144/160' if n > 1 else '160'};vbr_frames={n};bad_crc=0;skipped=0;seek_crc32={seek}"
        expected.append((d, len(media), hashlib.sha256(media).hexdigest(), told, n * 576 / 16000, str(at)))
    got = mpeg_audio.media_columns(docs).withColumn("offsets", F.concat(F.lit("["), F.array_join("offsets", ", "), F.lit("]")))
    same(got, expected, ["doc_id", "media_bytes", "media_sha256", "feature", "seconds", "offsets"])


def frame(version, layer, index, rate, pad, mode, ext=0, protect=False, length=None, body=b""):
    """A frame from its header's fields; version and layer as the header's bits have them."""
    head = bytes((0xFF, 0xE0 | version << 3 | layer << 1 | (not protect), index << 4 | rate << 2 | pad << 1, mode << 6 | ext << 4))
    h = mpeg_audio.header(head)
    body = body.ljust((length or h.length) - 4 - 2 * protect, b"\0")
    crc = mpeg_audio.crc16(head[2:] + body[: h.side]).to_bytes(2, "big") if protect else b""
    return head + crc + body


def test_mpeg_layers_and_tables():
    # (header's fields, frame length by the standard's formula, samples)
    cases = [
        ((3, 3, 8, 0, 1, 3), (12 * 256000 // 44100 + 1) * 4, 384, 1), ((3, 2, 8, 1, 0, 0), 144 * 128000 // 48000, 1152, 2), ((3, 1, 9, 0, 1, 1), 144 * 128000 // 44100 + 1, 1152, 3),
        ((2, 3, 5, 2, 0, 1), (12 * 80000 // 16000) * 4, 384, 1), ((2, 2, 9, 0, 0, 3), 144 * 80000 // 22050, 1152, 2), ((0, 1, 8, 2, 0, 3), 72 * 64000 // 8000, 576, 3),
    ]
    for fields, length, samples, layer in cases:
        data = frame(*fields) * 5
        s = mpeg_audio.parse(b"noise" + data + b"\xff\xfb")
        assert (s.offsets, s.samples, s.layer, s.skipped) == ([5 + length * i for i in range(5)], 5 * samples, layer, 7), fields
    for mode, ext in ((3, 0), (0, 0), (1, 0), (1, 2)):  # checksums of Layer I cover the bands' allocation
        good = frame(3, 3, 8, 1, 0, mode, ext, protect=True, body=bytes(range(40)))
        broken = bytearray(good)
        broken[6] ^= 1
        assert mpeg_audio.parse(good * 3).bad_crc == 0 and mpeg_audio.parse(good + bytes(broken) + good).bad_crc == 1
    assert mpeg_audio.parse(frame(3, 2, 8, 1, 0, 0, protect=True) * 3).unchecked == 3
    free = mpeg_audio.parse(frame(3, 1, 0, 0, 0, 0, length=500) + frame(3, 1, 0, 0, 1, 0, length=501) + frame(3, 1, 0, 0, 0, 0, length=500))
    assert free.offsets == [0, 500, 1001] and free.kbps == {0}
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4000, 3, 2, 1, 2, 2) + b"\1\2\3\4"
    s = mpeg_audio.parse(frame(3, 1, 9, 0, 0, 0, body=bytes(32) + vbri) + frame(3, 1, 9, 0, 0, 0) * 3)
    assert len(s.offsets) == 3 and s.vbr["frames"] == 3 and s.vbr["bytes"] == 4000 and s.toc == b"\1\2\3\4"
    info = b"Info" + (1).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    s = mpeg_audio.parse(frame(3, 1, 9, 0, 0, 0, body=bytes(32) + info) + frame(3, 1, 9, 0, 0, 0) * 3)
    assert s.samples == 3 * 1152 and s.played == 3 * 1152 - 576 - 1000 and s.seconds == s.played / 44100
    text = b"TIT2" + (5).to_bytes(4, "big") + bytes(2) + b"\0a\xff\x00bc"
    tag = b"ID3\3\0\x80" + bytes((0, 0, 0, len(text))) + text
    assert mpeg_audio.parse(tag + frame(3, 1, 9, 0, 0, 0) * 2).tags == {"TIT2": "a\xffbc"} and mpeg_audio.parse(b"").offsets == mpeg_audio.parse(b"\xff" * 5000).offsets == []


def test_langid(spark):
    got = queries.op6_langid(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got.collect() if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_langid_cases(docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model)
    assert set(got.columns) == {*docs.columns, "score"}
    for r in got.select("text", "lang_pred", "score").collect():
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty(docs))).collect()} == {"und"}
    assert langid.identify(empty(docs), model).count() == 0
    assert np.array_equal(model.word("zzqqzzqq"), model.word("zzqqzzqq")) and langid.Scorer(model).predict("le la les")[0] == "fr"


def test_langid_against_brute_force(spark, docs, rows, monkeypatch):
    learned = [r for r in rows if brute.crc_mod(r[0], 4) != 2]
    odd = ["½ ² ①", "Ⅷ", "٣", "ª", "ßx½y", "qqqzzz", "İstanbul", "1a2", "é"]
    texts = [r[1] for r in rows] + odd
    expected = brute.languages({(r[0], r[1], r[2]): (r[1], r[2]) for r in learned}.values(), texts, langid.LENGTHS)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("found", F.lit("clash"))
    model = queries.fitted_languages(docs)
    for memo in (langid.MEMO, 40):  # what a worker remembers makes no difference
        scorer = langid.Scorer(model)
        monkeypatch.setattr(langid, "MEMO", memo)
        scorer.rows = np.zeros((memo + 1, len(model.languages)), np.float32)
        again = [scorer.predict(t) for t in texts]
        assert again == [scorer.predict(t) for t in texts] == [langid.Scorer(model).predict(t) for t in texts]
        for (lang, p), (want, q) in zip(again, expected, strict=True):
            assert lang == want and math.isclose(p, q, rel_tol=1e-3, abs_tol=1e-4)
    got = langid.identify(frame, model).collect()
    assert Counter((r.text, r.lang_pred) for r in got) == Counter(zip(texts, (x[0] for x in expected), strict=True))
    assert [x[0] == "und" for x in expected[-len(odd) :]] == [True, True, True, False, False, False, False, False, False]


def test_simhash(docs, rows):
    columns = ["doc_id", "fingerprint", "component_id"]
    same(simhash.near_duplicates(docs), brute.near_duplicates([r[:2] for r in rows]), columns)
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_links_join_all_within_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base[:20]:
        for _ in range(30):
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)  # chains away from the base
    dense = {base[50] ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}
    fps |= dense
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    expected = defaultdict(set)
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    for f in fps:
        expected[find(f)].add(f)
    wanted = {frozenset(g) for g in expected.values() if len(g) > 1}
    for most in (100_000, 40):
        got = defaultdict(set)
        for r in components.connected_components(simhash.links(frame, most)).collect():
            got[r.root].add(r.node % (1 << 64))
        assert {frozenset(g) for g in got.values()} == wanted


def test_bk_tree_matches_scan():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 16, 3000).astype(np.uint64))
    tree = simhash.BKTree(values)
    for v in values[:50]:
        assert sorted(tree.near(int(v), 2)) == np.flatnonzero(np.bitwise_count(values ^ v) <= 2).tolist()


def test_grown_tree_matches_scan():
    rng = random.Random(9)
    values = list({rng.getrandbits(12) << 20 for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    group = {v: v for v in values}
    for i, j in simhash.grown_forest(values):
        assert (values[i] ^ values[j]).bit_count() <= simhash.RADIUS
        a, b = group[values[i]], group[values[j]]
        assert a != b  # a forest: no link twice
        group = {v: b if g == a else g for v, g in group.items()}
    assert all((a ^ b).bit_count() > simhash.RADIUS or group[a] == group[b] for a in values for b in values)


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_mixing(docs, rows):
    got = mixing.mix_documents(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(brute.tokens(t)) - 1
    targets = brute.source_targets(dict(sizes))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(brute.tokens(t)) - 1) for d, t, _, _ in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    biggest = defaultdict(int)
    for r in got:
        biggest[r.source] = max(biggest[r.source], r.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.1 * t + 1.5 * biggest[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs.repartition(7)).collect()))
    assert mixing.mix_documents(empty(docs)).count() == 0


def test_mixed_rows(docs):
    expected = Counter()
    for r in mixing.mix_documents(docs).collect():
        expected[r.doc_id] += r.copies
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +expected


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    slots, shard = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert shard.setdefault(r.doc_id, r.shard) == r.shard and r.law == "key"
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert sharding.shard_documents(empty(docs)).count() == 0


def test_sharding_is_balanced_and_moves_little(spark):
    keys = spark.range(40_000).withColumn("key", F.col("id").cast("string"))
    tree = sharding.shard_tree()
    counts = [r["count"] for r in keys.groupBy(sharding.shard_of(F.col("key"), tree)).count().collect()]
    assert len(counts) == 24 and max(counts) < 1.15 * 40_000 / 24
    heavier = sharding.shard_tree()
    heavier["r1"]["r1/k1"][13] = 2.0  # movement goes into the subtree whose weight grew only
    moved = keys.select(sharding.shard_of(F.col("key"), tree).alias("a"), sharding.shard_of(F.col("key"), heavier).alias("b")).where("a <> b").collect()
    assert moved and all(8 <= r.b < 16 for r in moved)
    without = sharding.shard_tree()
    without["r1"]["r1/k1"][13] = 0.0
    assert keys.where(sharding.shard_of(F.col("key"), without) == 13).count() == 0


def test_token_counts(spark, docs, rows):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path(token_counts.MODEL))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = [(d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for d, t, _, _ in rows]
    same(token_counts.count_tokens(docs, path), expected, ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    assert token_counts.count_tokens(empty(docs), path).count() == 0
    table = token_counts.counts(path)
    assert table.chunks
    for t in ["a  b c", " lead and trail  ", "▁x <s> é\n\tz", "".join(["word "] * 40) + "y" * 100 + " end"]:
        got = table.prefixes(t)
        for i in range(len(t) + 1):
            exact = len(model.encode(t[:i]))
            assert got[i] in (exact, -1) and token_counts.tokens_at(path, t, i) == exact
    one = token_counts.count_tokens(spark.createDataFrame([(1, "a b  c")], "doc_id long, text string"), path, limit=2, prefixes=True).first()
    assert one.over_limit and len(model.encode("a b  c"[: one.fits_chars])) <= 2 and one.prefix_tokens == [len(model.encode("a b  c"[:i])) for i in range(7)]


def test_token_counts_inside_long_chunks(spark):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path(token_counts.MODEL))
    model, table, rng = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Counts(path), random.Random(3)
    assert table.merges
    texts = ["".join(rng.choices(a, k=300)) for a in ("abcdefghinrst", "ABCabc0123+/", "日本語中文字漢執梦ゼ", "é😀x▁a", "eE= \n", "x")]
    texts.append("".join(rng.choice([*table.scores]).replace("▁", "") for _ in range(100)))
    for t in texts:
        exact = [len(model.encode(t[:i])) for i in range(len(t) + 1)]
        assert table.prefixes(t).tolist() == exact
        for limit in (3, 50):
            r = token_counts.count_tokens(spark.createDataFrame([(1, t)], "doc_id long, text string"), path, limit=limit).first()
            assert r.n_tokens == exact[-1] and r.fits_chars == max(i for i, k in enumerate(exact) if k <= limit)
