"""Byte-level BPE encoding and decoding by batched merge rounds in numpy.

The symbols of many words lie in one flat array. Each round finds every word's adjacent pair of lowest rank, by
binary search over the sorted pair keys, and merges all its occurrences from left to right; only the pairs next to
a merge are looked up again. A pair that holds a merged symbol ranks after the merge, so this gives the ids that
merging one pair at a time gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkEncoder, byte_of_char

_NONE = np.int64(1 << 40)
#: Fixed value of this vocabulary family: how a text falls into words before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, "Bpe"] = {}


class Bpe:
    """A vocabulary and its merges, from a tokenizers file of byte-level BPE."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_char, vocab = byte_of_char(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(of_char[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.zeros(256, np.int64)
        for c, b in of_char.items():
            self.first[b] = vocab[c]
        self.size = np.int64(max(self.bytes_of) + 1)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in pairs)))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (or _NONE) and where it lies among the keys."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty word, as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(words)
        if not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank, at = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], at[inside] = self._look_up(sym[inside], sym[inside + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(start, len(sym)))
            low = np.minimum.reduceat(rank, start)
            done = low == _NONE
            if done.any():
                raw = sym.astype("<u4")
                for s, n, w in zip(start[done].tolist(), length[done].tolist(), word[start[done]].tolist()):
                    out[w] = raw[s : s + n].tobytes()
                keep = np.repeat(~done, length)
                sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
                low, length = low[~done], length[~done]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(low, length))
            fresh = np.concatenate([[True], np.diff(pick) != 1])  # of pairs that overlap, every second one merges
            run = np.arange(len(pick)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            pick = pick[run % 2 == 0]
            sym[pick] = self.made[at[pick]]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            moved = np.cumsum(keep) - 1
            merged = moved[pick]
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            touched = np.unique(np.concatenate([merged, merged[merged > 0] - 1]))
            last = touched + 1 == len(sym)
            ok = ~last
            ok[ok] = word[touched[ok]] == word[touched[ok] + 1]
            rank[touched[~ok]] = _NONE
            rank[touched[ok]], at[touched[ok]] = self._look_up(sym[touched[ok]], sym[touched[ok] + 1])
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: special tokens as such, the rest word by word."""
        parts: list[list[bytes | str]] = []
        for text in texts:
            mine: list[bytes | str] = []
            at = 0
            for m in self.cut.finditer(text) if self.cut else ():
                mine += self.words.findall(text[at : m.start()])
                mine.append(self.special[m[0]].to_bytes(4, "little"))
                at = m.end()
            parts.append(mine + self.words.findall(text[at:]))
        names = list({p for mine in parts for p in mine if isinstance(p, str)})
        ids = dict(zip(names, self.merge([w.encode("utf-8") for w in names])))
        return [b"".join(p if isinstance(p, bytes) else ids[p] for p in mine) for mine in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; special tokens are spelled out, unknown ids left out, broken UTF-8 is replaced."""
        return b"".join(self.bytes_of.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


def bpe_of(path: str) -> tuple[Bpe, ChunkEncoder]:
    """The vocabulary at `path` and an encoder with a memory of chunks, one for each process."""
    if path not in _loaded:
        bpe = Bpe(path)
        _loaded[path] = (bpe, ChunkEncoder(bpe.encode_all))
    return _loaded[path]


def _coder(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = bpe_of(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = encode([t or "" for t in part.column(1).to_pylist()])
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                cols += [pa.array([bpe.decode(x) for x in ids], pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (32-bit, little-endian) of every whole text, and with `decode` the text decoded from them.

    A null text counts as empty and has no ids; a null id is kept; repeated rows are encoded each, very long texts
    whole; an empty table gives none. Other columns are not read. No shuffle.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode
    return pairs.mapInArrow(_coder(tokenizer, decode), schema)
