"""Encoders, token files, packing and BPE against the tokenizers library."""

import random
import zlib
from array import array

import numpy as np
import pytest

from quarrylight.llm import bpe, packing, token_files, tokens

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")

PIECES = list(" \n\t \x1c\x85ab'sS.,!1२²ßéÉéİıΣς 日本ªⅣ_$ǅ") + ["'re", "'s", "<|endoftext|>", "  ", " the", "word,", "\n", "aaaa", "\U0001f600"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20))) for _ in range(n)] + ["", "a" * 3000, "ab" * 500 + " " * 70]


def library(name):
    t = tokenizers.Tokenizer.from_file(vocabularies.path(name))
    return t, lambda text: array("I", t.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 400)  # memory is forgotten on the way
    texts, (_, ids) = fuzz(3000), library(name)
    assert tokens.library_encoder(vocabularies.path(name))(texts) == [ids(t).tobytes() for t in texts]


def test_merge_rounds(spark):
    texts, (t, ids) = fuzz(3000, 2), library("byte_bpe_50k.json")
    model, encode = bpe.bpe_of(vocabularies.path("byte_bpe_50k.json"))
    got = encode(texts)
    assert got == [ids(x).tobytes() for x in texts]
    assert [model.decode(x) for x in got] == texts
    rng = random.Random(3)
    for _ in range(500):
        some = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert model.decode(array("I", some).tobytes()) == t.decode(some, skip_special_tokens=False)
    df = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    rows = bpe.encode(df, vocabularies.path("byte_bpe_50k.json"), decode=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 0, ""), (1, 2, "a b"), (1, 2, "a b")]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 4096, 70_001])
def test_planes(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 7 else 49408, n).astype("<u4")
    planes, sizes = token_files.to_planes(ids, bits)
    assert len(sizes) == 32 // bits and (token_files.from_planes(planes, sizes, n, bits) == ids).all()


@pytest.mark.parametrize("bits,block", [(8, 1 << 16), (1, 64)])
def test_token_files(spark, tmp_path, monkeypatch, bits, block):
    monkeypatch.setattr(token_files, "BLOCK", block)
    _, ids = library("word_bpe_49k.json")
    rows = [(k * 3 % 101, t) for k, t in enumerate(fuzz(98, 5))] + [(5000, None), (5001, "the cat " * 900)]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, start int, shard string")
    path = token_files.write_tokens(df, str(tmp_path / "t"), vocabularies.path("word_bpe_49k.json"), end_id=2, plane_bits=bits)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    at = 0
    for i, t in sorted(rows):
        want = ids(t).tobytes() + (2).to_bytes(4, "little")
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (at, len(want) // 4, bytearray(want))
        at += len(want) // 4
    index = token_files.chunk_index(spark, path).collect()
    assert sum(r.n_ids for r in index) == at and all(r.n_ids <= block for r in index)
    empty = token_files.write_tokens(df.limit(0), str(tmp_path / "e"), vocabularies.path("word_bpe_49k.json"), end_id=2)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_pieces():
    for n in (0, 1, 5, 2047, 2048, 2049, 10_000):
        got = packing.pieces(n)
        assert [s for s, _ in got] == [sum(x for _, x in got[:k]) for k in range(len(got))] and sum(x for _, x in got) == n
        assert all(x & (x - 1) == 0 and x <= 2048 for _, x in got)


def test_packing(spark, tmp_path):
    _, ids = library("byte_bpe_50k.json")
    rows = [(k, t) for k, t in enumerate(fuzz(60, 6))] + [(99, None), (99, None), (None, "x")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    packed = packing.pack(df, vocabularies.path("byte_bpe_50k.json"), end_id=1)
    got = packed.collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length == 1 << r.bucket for r in got)
    for i, t in rows[:60]:
        want = ids(t).tobytes() + (1).to_bytes(4, "little")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == want and all(r.doc_tokens == len(want) // 4 for r in mine)
        assert zlib.crc32(want) == zlib.crc32(b"".join(bytes(r.ids) for r in mine))
    assert sum(r.doc_id == 99 for r in got) == 2 and packing.pack(df.limit(0), vocabularies.path("byte_bpe_50k.json")).count() == 0
    packing.write_buckets(packed, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == len(got)
