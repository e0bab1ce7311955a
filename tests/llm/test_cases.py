"""Nulls, repeats, empty tables, long texts and clashing names; classifiers against plain Python."""

import math
import sys
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest

from quarrylight.llm import bpe, quality, token_files, toxicity

vocabularies = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

LONG = "the cat sat on the mat, and that was it. " * 8000


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    t = tokenizers.Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    rows = [(None, f"null {k}") for k in range(50)] + [(3, "a"), (3, "a"), (3, "b c"), (1, None), (9, LONG)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, ids int").repartition(5)
    path = token_files.write_tokens(df, str(tmp_path / "t"), vocabularies.path("word_bpe_49k.json"), end_id=2)
    got = token_files.read_tokens(spark, path).collect()
    want = Counter((i, array("I", t.encode(x or "", add_special_tokens=False).ids + [2]).tobytes()) for i, x in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_bpe_of_nothing_and_long_texts(spark):
    t = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(1, LONG, 7, "x")], "doc_id long, text string, ids int, decoded string")
    got = bpe.encode(df, vocabularies.path("byte_bpe_50k.json"), decode=True).first()
    assert bytes(got.ids) == array("I", t.encode(LONG, add_special_tokens=False).ids).tobytes() and got.decoded == LONG
    assert bpe.encode(df.limit(0), vocabularies.path("byte_bpe_50k.json")).count() == 0


def plain_features(text):
    """The seventeen surface figures of a text, one by one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * 17
    size, n, times = len(raw), len(words), Counter(words)
    of = lambda chars: sum(raw.count(c.encode()) for c in chars)
    upper, lower, high = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw), sum(c > 127 for c in raw)
    odd = of("#$%&*+/<=>@[\\]^_`{|}~")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log(1 + n), math.log(1 + min(size / n, 100)), upper / max(1, upper + lower + high / 2), odd / n, of("!") / n, of("|") / n,
        sum(48 <= c <= 57 for c in raw) / size, of(".,;:?'\"()-") / n, high / size, len(times) / n, math.log(len(times) + 1) / math.log(n + 1),
        max(times.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / len(lines), math.log(1 + n / len(lines)),
        (raw.count(b".") + raw.count(b"?")) / n, float(odd > 0.2 * n),
    ]


TEXTS = [None, "", " \n", "One two two.\nOne two two.\n!!", "$$$ *** ###", "Ein Satz für alle | 12 34", "A b c? D e f. " * 40, LONG]


def test_quality_against_plain_python(spark):
    rng = np.random.default_rng(3)
    x = np.array([plain_features(t) for t in TEXTS])
    model = quality.fit_pairs(rng.normal(size=(60, 17)) + np.repeat([[0.0], [0.7]], 30, 0), np.repeat([0, 1], 30), 0.3)
    df = spark.createDataFrame([(k, t, 5.0) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 5.0)], "doc_id long, text string, score double")
    got = quality.with_score(df, model).collect()
    for r in got:
        z = sum(max(-6, min(6, (v - m) / s)) * w for v, m, s, w in zip(x[r.doc_id], model.mean, model.scale, model.weights)) - model.cut
        want = 1 / (1 + math.exp(-max(-40, min(40, z + math.log(0.3 / 0.7)))))
        assert r.score == pytest.approx(want, rel=1e-9) and r.predicted == int(r.score >= 0.3)
    assert len(got) == len(TEXTS) + 1 and quality.with_score(df.limit(0), model).count() == 0


def plain_bucket(gram):
    """The bucket of one character n-gram."""
    mask, h = (1 << 64) - 1, 0
    for n, c in enumerate(gram, 1):
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + n) & mask
    h = ((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) & mask
    return (h >> 40) % toxicity.BUCKETS


def plain_logit(text, model):
    """The worst window's mean over its subwords, word by word."""
    words = []
    for w in (text or "").lower().split():
        if not words or words[-1] != w:
            words.append(w)
    if not words:
        return model.bias
    grams = [[plain_bucket(f"<{w}>"[i : i + n]) for n in toxicity.GRAMS for i in range(len(w) + 3 - n)] for w in words]
    best, k = -math.inf, 0
    while True:
        window = [g for w in grams[k : k + toxicity.WINDOW] for g in w]
        best = max(best, sum(float(model.gain[g]) for g in window) / max(1, len(window)))
        if k + toxicity.WINDOW >= len(words):
            return best + model.bias
        k += toxicity.STRIDE


def test_toxicity_against_plain_python(spark):
    rng = np.random.default_rng(4)
    model = toxicity.ToxicModel(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.25, 1.3, -0.4)
    texts = [None, "", "a", "You you YOU fool", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen", "é\U0001f600 ßx " * 9, " ".join(f"w{k % 37}" for k in range(500))]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, predicted int")
    for r in toxicity.with_score(df, model).collect():
        want = 1 / (1 + math.exp(-(1.3 * plain_logit(texts[r.doc_id], model) - 0.4)))
        assert r.score == pytest.approx(want, rel=1e-6) and r.predicted == int(r.score >= 0.7)
    assert toxicity.with_score(df.limit(0), model).count() == 0


def test_the_fit_of_toxicity_is_bounded(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    from quarrylight.llm.common import labelled_sample

    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 15, 1000, 1100).collect()
    assert Counter(r.y for r in rows) == {0: 5, 1: 5}
    assert Counter(r.y for r in labelled_sample(docs, labels, "toxic", F.lit(True), 15, 1000).collect()) == {0: 15, 1: 15}


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages_with_odd_rows(spark):
    """Every stage on nulls, repeats, clashing names and an empty table."""
    sys.path.insert(0, "/root/repo")
    import corpus_pipeline

    good = "The cat and the dog went to the house by the river, and it was a good day for all of them. " * 6
    rows = [(1, good, "en", "s", 1, "x"), (1, good, "en", "s", 1, "x"), (2, None, None, None, None, "y"), (None, good + " more", "en", "s", 1, "z"), (3, "", "en", "s", 0, "z"), (4, LONG, "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, "/root/testdata/sf0.001")
            n = out.count()
            assert n == 0 or df is docs, name
            if name != "packing":
                assert out.columns == docs.columns and n <= len(rows), name
    kept = corpus_pipeline.exact_copies(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 4), (True, 0)]
    near = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sum(r.doc_id == 1 for r in near) == 2 and {r.doc_id for r in near} == {1, 2, 3, 4, None}
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, None} and all(zlib.crc32(bytes(r.ids)) >= 0 for r in packed)
