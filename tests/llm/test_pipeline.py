"""The pipeline against a brute-force version, and every registered query on a table of odd rows."""

import sys
from array import array
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute_secrets
from test_dedup import brute_components, normal, shingle_set
from test_texts import corpus

import corpus_pipeline
from quarrylight.llm import packing, quality
from quarrylight.llm import registry as llm
from quarrylight.llm.common import remainder


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    rows = corpus(150, 5)
    texts = [(i, t) for i, t, _, _ in rows]
    texts += [(1000 + k, rows[k % 7][1]) for k in range(30)] + [(2000 + k, rows[k][1] + " rea") for k in range(20)]
    texts += [(3000, rows[0][1] + " password = hunter2hunter2 end"), (3001, None), (3002, ""), (3003, "thas " * 5000)]
    docs = [(i, t, "en", "src0", len(t or "")) for i, t in texts]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{base}/labels.parquet")
    vectors = [(k, [float(k % 3), 1.0, 0.1 * (k % 5)], k % 2) for k in range(30)] + [(99, None, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{base}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<article>a</article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    spark.createDataFrame([(1, "thas?"), (2, None), (3, "unheardof")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), texts


def test_stages_do_what_brute_force_does(spark, tables):
    base, texts = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{base}/labels.parquet"), remainder(F.col("doc_id"), 5) != 0)
    good = {i: t for i, t in texts if model.score(quality.features(t)[None])[0] >= 0.3}
    first = {}
    for i in sorted(good):
        first.setdefault(normal(good[i]), i)
    left = {i: good[i] for i in first.values()}
    sets = {i: shingle_set(t) for i, t in left.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = brute_components(sets, linked)
    want = {i: brute_secrets.redacted(left[i]) for i in left if low[i] == i}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id: r.text for r in docs.collect()} == want and 0 < len(want) < len(texts)
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    ids = {i: array("I", [*t.encode(x or "", add_special_tokens=False).ids, 1]).tobytes() for i, x in want.items()}
    got = corpus_pipeline.run(spark, base).collect()
    assert {(r.doc_id, r.start, r.length, bytes(r.ids)) for r in got} == {(i, s, n, x[4 * s : 4 * (s + n)]) for i, x in ids.items() for s, n in packing.pieces(len(x) // 4)}


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_queries_return_a_row_for_each_of_theirs(spark, tables, name):
    base, texts = tables
    got = llm.QUERIES[name](spark, base)
    key = {"op2_embedding_dedup": "vec_id", "op5_html_text": "page_id", "op12_search": "item_id"}.get(name, "doc_id")
    want = {"vec_id": 31, "page_id": 2, "item_id": 1}.get(key, len(texts))
    assert got.select(key).distinct().count() == want
