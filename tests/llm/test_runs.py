"""Periodic runs against brute force."""

import random

import pytest

from quarrylight.llm import runs


def brute(words, min_length, min_exponent):
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - s
            if length >= max(min_length, min_exponent * q) and not any(all(words[s + j] == words[s + j + d] for j in range(length - d)) for d in range(1, q)):
                out.append((s, length, q))
            s = e + 1 if e > s else s + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(5)
    out = [None, "", " \t", "a", "a a a a a a", "\ta  b\n" * 9, "x y " * 5, "é e " * 4 + "é", "long " * 30_000 + "end"]
    for k in range(400):
        n, letters = rng.randint(0, 70), "ab" if k % 2 else "abcd"
        words = [rng.choice(letters) for _ in range(n)]
        if k % 3 == 0 and n:
            a = rng.randint(0, n - 1)
            p = rng.randint(1, max(1, (n - a) // 4))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        out.append(rng.choice([" ", "  ", "\n", "\x0b"]).join(words))
    return out


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (2, 2), (4, 3)])
def test_runs_against_brute_force(spark, min_length, min_exponent):
    rows = list(enumerate(texts())) + [(None, "b b b b b b b"), (7, "c c c c c c"), (7, "c c c c c c")]
    df = spark.createDataFrame([(i, t, 1, "r", "c") for i, t in rows], "doc_id long, text string, n_words int, runs string, collapsed string")
    got = runs.find_runs(df, min_length, min_exponent).collect()
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        found = brute(words, min_length, min_exponent) if len(words) < 1000 else [(0, 30_000, 1)]
        want.append((i, len(words), found, collapsed(words, found)))
    assert sorted(map(repr, ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got))) == sorted(map(repr, want))
    assert runs.find_runs(df.limit(0)).count() == 0


def test_words_of_fibonacci_and_hostile_texts():
    """Texts full of repeats: every stretch agrees with brute force."""
    import pyarrow as pa

    a, b = ["a"], ["a", "b"]
    while len(b) < 150:
        a, b = b, b + a
    hostile = [b, ["a"] * 120, (["a"] * 7 + ["b"]) * 15, (["a", "b"] * 6 + ["c"]) * 9]
    found = runs._in_one(pa.array([" ".join(w) for w in hostile]), 2, 2)[0].to_pylist()
    assert [[(r["start"], r["length"], r["period"]) for r in f] for f in found] == [brute(w, 2, 2) for w in hostile]
