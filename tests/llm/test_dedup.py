"""Exact, near and embedding dedup against brute force, with hot groups, nulls, repeats and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import embed_dedup, exact_dedup, graph, near_dedup

DOCS = "doc_id long, text string, r string, digest string, id long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in texts], DOCS)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_copies_and_index(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, None), (8, ""), (1, "z"), (None, "z"), (None, "only null"), (3, "a\tb"), (4, "x" * 50_000)]
    rows += [(100 + k, "hot  text") for k in range(300)]
    df = docs(spark, rows)
    index = exact_dedup.DigestIndex(spark, buckets=4)
    got = exact_dedup.find_copies(df, index).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    want = set()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    assert {tuple(r) for r in got} == want
    again = exact_dedup.find_copies(df, index).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))  # a batch that is added twice changes nothing
    more = exact_dedup.drop_copies(docs(spark, [(0, "hot text"), (2, "new"), (1, "z")]), index).collect()
    assert {(r.doc_id, r.text, r.r, r.id) for r in more} == {(2, "new", "x", 7), (1, "z", "x", 7)}
    assert exact_dedup.find_copies(docs(spark, [])).count() == 0


def test_drop_copies_leaves_one_row_per_text(spark):
    rows = [(3, "a"), (3, "a"), (None, "a"), (2, "b"), (None, "n"), (7, None), (8, "")]
    got = exact_dedup.drop_copies(docs(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == [(False, 2, "b"), (False, 3, "a"), (False, 7, None), (True, 0, "n")]


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_components(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def near_texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 30, 120]))]
        out.append(base)
        for _ in range(rng.randint(0, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    out += [passage + [word() for _ in range(rng.choice([3, 8, 20, 60]))] for _ in range(40)]
    texts = [" ".join(t) for t in out] + ["", "  \n", None, "One", "one", "ONE TWO", "A b\tc d e", "a B c d e"] + ["w" * 3000 + " x"] * 3
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("small", ["", "crowds", "crowds in pieces"])
def test_near_copies(spark, small, monkeypatch):
    if small:  # every bucket is looked at by its rare elements
        monkeypatch.setattr(near_dedup, "CROWD", 1)
    if "pieces" in small:
        monkeypatch.setattr(near_dedup, "PIECE", 3)
    rows = near_texts()
    sets = {i: shingle_set(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = brute_components(sets, linked)
    got = near_dedup.link_documents(docs(spark, [*rows, (None, "One")])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id), r
    if not small:
        left = near_dedup.drop_near_copies(docs(spark, rows)).collect()
        assert sorted(r.doc_id for r in left) == sorted({low[i] for i, _ in rows}) and left[0].id == 7


@pytest.mark.parametrize("crowd", [512, 3])
def test_near_copies_that_share_one_band_of_a_large_bucket(spark, crowd, monkeypatch):
    core = [f"c{k}" for k in range(39)]
    one = core + ["a3608"] + [f"a3608x{k}" for k in range(4)]
    two = [f"b38x{k}" for k in range(6)] + core  # 35 of 46 shingles are shared
    bands = lambda words: near_dedup.signature(near_dedup.shingles(" ".join(words)))[0]
    (shared,) = set(bands(one)) & set(bands(two))
    others = (core + [f"h{h}x{k}" for k in range(40)] for h in range(2000))
    busy = next(o for o in others if shared in bands(o))  # 35 of 80 and of 81 shingles
    rows = list(enumerate(map(" ".join, [one, two, busy, *([*busy, f"more{k}"] for k in range(4))])))
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    assert sum(shared in bands(t.split()) for _, t in rows) > 3
    got = {r.doc_id: r.component_id for r in near_dedup.link_documents(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2}


def test_a_shared_passage_makes_no_square(spark):
    """Sets that have 0.6 to 0.7 of their union in common by one passage meet over no rare element; similar ones do."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(304)]  # 300 shingles
    texts = [passage + [word() for _ in range(n)] for n in [rng.randint(70, 96) for _ in range(150)]]
    texts += [texts[k] + [word() for _ in range(20)] for k in range(5)]
    made = [near_dedup.shingles(" ".join(t)) for t in texts]
    df = docs(spark, [(k, " ".join(t)) for k, t in enumerate(texts)]).select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h"))
    sets = spark.createDataFrame([(k, k, len(s), near_dedup._key(s)) for k, s in enumerate(made)], "id long, first long, n long, key binary").join(df.select("id", "h"), "id")
    entries = near_dedup._sides(near_dedup._by_rare_elements(sets.select("id", F.col("id").alias("component")), sets, df))
    buckets = entries.groupBy("bucket").agg(F.collect_list(F.struct("id", "piece", "first", "last")).alias("x")).collect()
    met = {(a.id, b.id) for r in buckets for a in r.x for b in r.x if a.id < b.id and a.first <= b.piece <= a.last}
    similar = {(a, b) for b in range(len(made)) for a in range(b) if 100 * len(np.intersect1d(made[a], made[b])) >= 75 * len(np.union1d(made[a], made[b]))}
    assert {(k, 150 + k) for k in range(5)} <= similar <= met and len(met) < len(similar) + 20


def test_near_copies_of_nothing(spark):
    assert near_dedup.link_documents(docs(spark, [])).count() == 0
    assert near_dedup.link_documents(docs(spark, [(1, None)])).first().kept


def test_sketch_limit_lets_similar_sets_through():
    rng = np.random.default_rng(1)
    for n in (4, 30, 300, 5000):
        union = int(2 * n / 1.75)
        both = int(np.ceil(0.75 * union))
        x = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
        cut = both + (union - both) // 2
        a, b = np.unique(x[:cut]), np.unique(np.concatenate([x[:both], x[cut:]]))
        (_, oa, sa), (_, ob, sb) = near_dedup.signature(a), near_dedup.signature(b)
        differ = np.bitwise_count(np.array(oa).view(np.uint64) ^ np.array(ob).view(np.uint64)).sum()
        assert differ <= near_dedup.most_different(float(len(a)), float(len(b)), sa, sb)


@pytest.mark.parametrize("union", [100, 200])
def test_sketch_limit_drops_next_to_no_similar_pair(union):
    rng, kept, n = np.random.default_rng(union), 0, 8000
    both = 3 * union // 4
    cut = both + (union - both) // 2
    for _ in range(n):
        x = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(x[:cut]), np.sort(np.concatenate([x[:both], x[cut:]]))
        (_, oa, sa), (_, ob, sb) = near_dedup.signature(a), near_dedup.signature(b)
        differ = np.bitwise_count(np.array(oa).view(np.uint64) ^ np.array(ob).view(np.uint64)).sum()
        kept += differ <= near_dedup.most_different(float(len(a)), float(len(b)), sa, sb)
    assert kept == n  # a limit that is right to 1e-5 drops none of them with a probability of 92 %


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    low = brute_components({x for p in links for x in p}, links)
    got = {r.id: r.component for r in graph.components(df).collect()}
    assert got == {i: m for i, m in low.items() if any(i in p and p[0] != p[1] for p in links)}
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("residents", [256, 3])
def test_vectors(spark, residents, monkeypatch):
    monkeypatch.setattr(embed_dedup, "RESIDENTS", residents)
    monkeypatch.setattr(embed_dedup, "VISITORS", residents + 1)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 24))
    rows = []
    for k, v in enumerate(base):
        for _ in range(int(rng.integers(1, 9))):
            rows.append(((v + rng.normal(scale=0.12, size=24)).tolist(), k % 2))
    rows += [(rows[0][0], rows[0][1])] * 5 + [((2 * np.array(rows[3][0])).tolist(), rows[3][1])]
    rows += [(None, 0), ([0.0] * 24, 0), ([float("nan")] + [1.0] * 23, 0), ([None] + [1.0] * 23, 0), ([], 0), (rows[0][0], None), ([1.0, 2.0], 0), ([2.0, 4.0], 0)]
    ids = list(range(50, 50 + len(rows)))
    df = spark.createDataFrame([(i, v, lab, 1) for i, (v, lab) in zip(ids, rows)] + [(None, rows[0][0], rows[0][1], 1)], "vec_id long, embedding array<float>, label int, key int")
    ok = {i: (np.array(v, np.float32).astype(float), lab) for i, (v, lab) in zip(ids, rows) if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y))
    linked = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and cos(ok[a][0], ok[b][0]) >= 0.98]
    low = brute_components(ids, linked)
    got = {r.vec_id: r for r in embed_dedup.link_vectors(df).collect()}
    assert got.pop(None).kept and set(got) == set(ids)
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in linked), low[i], low[i] == i)
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("residents", [3, 256])
def test_vectors_of_repeated_ids_and_labels_of_any_type(spark, monkeypatch, residents):
    monkeypatch.setattr(embed_dedup, "RESIDENTS", residents)
    monkeypatch.setattr(embed_dedup, "VISITORS", residents + 1)
    rng = np.random.default_rng(9)
    a, b, c = (rng.normal(size=40) for _ in range(3))
    near = lambda v: v + rng.normal(scale=0.02, size=40)
    # two vectors under id 1, each with one neighbour; an id whose two vectors link; the same vector twice under one id
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (9, c), (9, near(c)), (7, 3 * a), (7, 3 * a), (20, -a)]
    hot = [(100 + k, near(c)) for k in range(40)]
    unit = lambda v: v / np.linalg.norm(v)
    for kind, value in (("long", 5_000_000_000), ("string", "a:b"), ("double", 0.5)):
        every = [(i, v.tolist(), value) for i, v in rows + hot] + [(50, a.tolist(), None), (51, a.tolist(), type(value)(1))]
        df = spark.createDataFrame(every, f"vec_id long, embedding array<double>, label {kind}")
        linked = [[x != y and every[x][2] is not None and every[x][2] == every[y][2] and unit(np.array(every[x][1])) @ unit(np.array(every[y][1])) >= 0.98 for y in range(len(every))] for x in range(len(every))]
        low = brute_components(range(len(every)), [(x, y) for x in range(len(every)) for y in range(x) if linked[x][y]])
        least = {r: min(every[x][0] for x in low if low[x] == r) for r in set(low.values())}
        want = sorted((i, sum(linked[x]), least[low[x]], i == least[low[x]]) for x, (i, _, _) in enumerate(every))
        assert sorted(tuple(r) for r in embed_dedup.link_vectors(df).collect()) == want


def test_deeper_grids_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base, *(base + rng.normal(scale=s, size=base.shape) for s in (0.03, 0.1, 0.2))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.98).sum(1) - 1).tolist()
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for few in (1, 1000):
        monkeypatch.setattr(embed_dedup, "FEW", few)
        assert [r.n_links for r in embed_dedup.link_vectors(df).orderBy("vec_id").collect()] == want


def test_one_id_under_several_texts(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    near = a.rsplit(" ", 2)[0] + " other end"
    rows = [(1, a), (1, b), (5, b), (6, near), (7, "zz"), (7, "zz"), (0, c), (1, c), (None, a), (None, c)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.link_documents(docs(spark, rows)).collect())
    n = len(shingle_set(a))
    want = [(False, 0, n, 0, True), (False, 1, n, 0, False), (False, 1, n, 1, True), (False, 1, n, 1, True), (False, 5, n, 1, False), (False, 6, n, 1, False)]
    want += [(False, 7, 1, 7, True)] * 2 + [(True, 0, n, None, True)] * 2
    assert got == sorted(want, key=lambda r: tuple(-1 if x is None else x for x in r))


def test_bands_bring_similar_sets_together():
    rng = np.random.default_rng(31)
    met = 0
    for _ in range(400):  # 150 of 200 elements shared: a similarity of exactly 0.75
        x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        (p, _, _), (q, _, _) = near_dedup.signature(np.sort(x[:175])), near_dedup.signature(np.sort(np.concatenate([x[:150], x[175:]])))
        met += any(i == j for i, j in zip(p, q))
    assert met >= 0.99 * 400


def test_components_never_end_half_merged(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(400)], "a long, b long").repartition(40)
    with pytest.raises(RuntimeError):
        graph.components(chain, most_rounds=0)
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_links_where_pieces_meet_join_each_component_once():
    """Many sets that all are near each other: what comes out is a spanning tree, and the search for roots ends."""
    import pyarrow as pa

    rows = []
    for k in range(40):
        s = near_dedup.shingles(" ".join(f"w{j}" for j in range(200)) + f" end{k}")
        bands, sketch, samples = near_dedup.signature(s)
        row = {"bucket": 7, "p": 0, "q": 0, "piece": 0, "bands": [7, *bands[1:]], "id": k, "component": k % 20, "n": len(s)}
        rows.append(row | {"samples": samples, "sketch": sketch, "hub": -1, "s": s.tobytes()})
    out = [r for b in near_dedup._across(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert len(out) == 19  # 20 components
    low = brute_components(range(20), [(r["a"] % 20, r["b"] % 20) for r in out])
    assert set(low.values()) == {0}
