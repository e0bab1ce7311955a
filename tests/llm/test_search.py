"""Ranked lexical search against plain Python, with ties, nulls, repeats and clashing names."""

import math
import random
import re
from collections import Counter

from quarrylight.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for i, c, n in held:
            m = 10 + (90 * n * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = ["a", "b", "Zoo", "zoo", "éa", "Éa", "x9", "日本", "q_r", "s-t", "ſ", "İ", " ", *(f"w{k}" for k in range(40))]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.choice([0, 1, 3, 10, 40])))) for k in range(700)]
    docs += [(2000 + k, "zoo w1 w2 w3") for k in range(300)]  # ties
    docs += [(5, "zoo w1"), (5, "zoo w1"), (None, "zoo w1 w2 w3"), (None, None), (9001, ""), (9002, None), (9003, "--- !!"), (9004, "zoo " * 40_000)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(60)]
    items += [(7, None), (8, ""), (9, "unheard"), (10, "zoo"), (10, "zoo"), (10, "w1 w2"), (11, "!")]
    schema = "doc_id long, text string, score long, rank string"
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], schema).repartition(3)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    key = lambda r: (r[0], r[1], repr(r))
    for segment, chars, k in ((4096, 1_000_000, 10), (100, 200, 3)):
        monkeypatch.setattr(search, "SEGMENT", segment)
        got = [tuple(r) for r in search.rank(d, it, k, pass_chars=chars).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, [x for x in items if x[1]], k)))
    assert search.rank(d.limit(0), it).count() == 0
    assert search.rank(d, it.limit(0)).count() == 0


def test_tree_opens_few_leaves():
    """A rare term's leaf is opened, and not those whose bound is below."""
    import numpy as np

    n = 4096
    term = np.r_[np.zeros(n, "<i4"), np.ones(1, "<i4")]
    doc = np.r_[np.arange(n), [2000]].astype("<i4")
    tf = np.ones(n + 1, "<i4")
    segment = {"doc_ids": np.arange(n, dtype="<i8").tobytes(), "null_ids": np.zeros(n, "u1").tobytes(), "doc_terms": np.full(n, 5, "<i8").tobytes(), "term": term.tobytes(), "doc": doc.tobytes(), "tf": tf.tobytes()}
    tree = search.MaxTree.of(segment, np.array([10, 5000]), n, 5 * n)
    found, opened = [], []
    tree.leaf_first = type("Spy", (), {"__getitem__": lambda s, j, a=tree.leaf_first: opened.append(j) or a[j]})()
    tree.search(np.array([0, 1]), np.array([True, True]), found, 1)
    assert found[0][1] == -2000 and len(set(opened)) <= 2
