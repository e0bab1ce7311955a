"""Language profiles against a plain-Python version, and held-out accuracy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import language

DATA = os.environ.get("QUARRYLIGHT_DATA", "/root/testdata/sf0.001")


def plain_vector(text, dim):
    """The sum of stretch vectors, letter by letter."""
    vector = lambda code: np.random.default_rng([language.SEED, code]).choice(np.array([-1, 1], np.int8), dim).astype(int)
    codes = [0]
    for c in text:
        if c.isalpha():
            codes.append(ord(c.lower()[0]))
        elif codes[-1]:
            codes.append(0)
    codes += [0] * (codes[-1] > 0)
    out = np.zeros(dim, int)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


TEXTS = [("en", "The cat, the hat AND the 3 mats."), ("en", "that is the thing"), ("de", "Der Hund über die Straße"), ("de", "Ähren und Öl"), ("ja", "日本語のテキスト"), ("tr", "İstanbul ıı x")]


def test_profiles_against_plain_python(spark):
    dim = 256
    rows = TEXTS * 3 + [(None, "nothing learnt"), ("xx", None), ("zz", "123 !")]
    df = spark.createDataFrame([(k, t, l, "s") for k, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, score string").repartition(3)
    model = language.fit(df, dim=dim)
    assert model.languages == ["de", "en", "ja", "tr"]
    sums = np.array([sum(plain_vector(t, dim) for l, t in TEXTS * 3 if l == lang) for lang in model.languages], float)
    assert np.allclose(model.prototypes, language.Profiles.of(model.languages, sums).prototypes)
    texts = [None, "", "12 !?", "the", "STRASSE über", "日本", "x", "the cat " * 20_000] + [t for _, t in TEXTS]
    asked = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)] + [(None, "the", "q"), (3, "the", "q")], "doc_id long, text string, lang_pred string")
    got = language.predict(asked, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        v = plain_vector((texts[r.doc_id] if r.doc_id is not None else "the") or "", dim) if r.doc_id != 7 else plain_vector("the cat " * 20, dim)
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = model.prototypes @ v / np.linalg.norm(v)
        assert r.lang_pred == model.languages[cosine.argmax()]
        assert r.score == pytest.approx(max(0, cosine.max()), abs=1e-2 if r.doc_id == 7 else 1e-6)
    assert language.predict(asked.limit(0), model).count() == 0


def test_nothing_learnt(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert [tuple(r) for r in language.predict(df, model).collect()] == [(1, "und", 0.0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_languages(spark):
    from quarrylight.llm.registry import QUERIES

    got = QUERIES["op13_language"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.97
