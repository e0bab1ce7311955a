"""Encoding with public tokenizers, chunk by chunk with a memory of chunks.

A chunk is what lies between two single spaces, with the space before it. Both pre-tokenisers in use split within
chunks only, unless white space meets white space. So encoding a chunk once and joining the ids of a text's chunks
gives the ids of the whole text. A text in which white space meets white space is cut before each space that follows
a visible character instead: no word of either pre-tokeniser reaches over that.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

#: Characters of a chunk that is remembered at most, chunks that a worker remembers before it starts anew, texts in
#: one round.
LONGEST, CACHE, ROUND = 48, 1_000_000, 256

#: From here on, lowering or composing a letter may change the number of characters.
PLAIN = "İ"

#: A run of these after a word is one word of its own.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_UNIT = re.compile(r"(?<=\S)(?= )")
_encoders: dict[tuple[str, str], "ChunkEncoder"] = {}


class _Memory(dict):
    """Chunks and their ids, in two generations: what the younger one lacks is looked for in the older one.

    A chunk that is new and plain (a word of letters, signs after it or none) is learnt at once; any other waits and is
    None until its round ends.
    """

    def __init__(self, owner: "ChunkEncoder", before: str):
        self.owner, self.before, self.old, self.pending = owner, before, {}, set()
        self.signs, self.word, self.apart, self.long = owner.signs, owner.word, owner.apart, owner.long

    def __missing__(self, c: str) -> bytes | None:
        ids = self.old.get(c)
        if ids is None:
            base = c.rstrip(SIGNS)
            if self.word and base.isalpha() and (base.isascii() or max(base) < PLAIN):
                after = c[len(base) :]
                tail = self.signs.get(after)
                if tail is None:
                    tail = self.apart(after)
                ids = self.get(base) or self.old.get(base)
                if ids is None:
                    ids = self.word(self.before, base)
                if after:
                    self[base] = ids
                    ids += tail
                if len(c) > LONGEST:
                    self.long += ((self, c), (self, base))
            elif not c or c[0].isspace() or c[-1].isspace():
                pass  # it can't stand alone
            elif (ids := self.lines(c) if self.word and "\n" in c else None) is None:
                self.pending.add(c)
                return None
        self[c] = ids
        return ids

    def lines(self, c: str) -> bytes | None:
        """The ids of a chunk of several lines of a plain word each."""
        first, *others = c.split("\n")
        if not others[-1][:1].isalpha():
            return None
        parts = [self[first], *map(self.owner.head.__getitem__, others)]
        if len(c) > LONGEST:
            self.long.append((self, c))
        return None if None in parts else self.owner.line.join(parts)

    def age(self) -> None:
        """Let go of what was not used since the last time."""
        self.old = self.copy()
        self.clear()


class ChunkEncoder:
    """Encodes texts into bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], word: Callable[[str, str], bytes] | None = None):
        """encode_all: from a list of texts to a list of id bytes; it is given chunks or parts of texts.

        word: from the space before a word (or "") and a word of letters below PLAIN to its id bytes. With it, a chunk
        of such words, signs and ends of lines is encoded word by word.
        """
        self.encode_all, self.word = encode_all, word
        self.signs: dict[str, bytes] = {"": b""}
        self.long: list[tuple[_Memory, str]] = []
        self.head, self.tail = _Memory(self, ""), _Memory(self, " ")
        self.line = encode_all(["\n"])[0]

    def apart(self, after: str) -> bytes:
        """The ids of signs that follow a word: they are one word of their own."""
        ids = self.encode_all([after])[0]
        if len(after) <= LONGEST and len(self.signs) < CACHE // 8:
            self.signs[after] = ids
        return ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), ROUND):
            out += self._round(texts[lo : lo + ROUND])
        return out

    def _round(self, texts: list[str]) -> list[bytes]:
        if len(self.head) + len(self.tail) > CACHE // 2:
            self.head.age()
            self.tail.age()
        out = [self._joined(t) for t in texts]
        if None in out:
            self._settle(self.head)
            self._settle(self.tail)
            late = [k for k, ids in enumerate(out) if ids is None]
            for k in late:
                out[k] = self._joined(texts[k])
            self._in_units(texts, [k for k in late if out[k] is None], out)
        for memory, c in self.long:
            memory.pop(c, None)
        self.long.clear()
        return out

    def _settle(self, memory: _Memory) -> None:
        """Encode the chunks that wait, all at once."""
        waiting = list(memory.pending)
        memory.pending.clear()
        memory.update(zip(waiting, self.encode_all([memory.before + c for c in waiting])))
        self.long += [(memory, c) for c in waiting if len(c) > LONGEST]

    def _joined(self, text: str) -> bytes | None:
        first, *others = text.split(" ")
        parts = [self.head[first], *map(self.tail.__getitem__, others)]
        try:
            return b"".join(parts)
        except TypeError:
            return None

    def _in_units(self, texts: list[str], which: list[int], out: list[bytes | None]) -> None:
        """Encode texts in which white space meets white space, their new parts all at once."""
        cut = [_UNIT.split(texts[k]) for k in which]
        known: dict[str, bytes | None] = {u: self.tail.get(u[1:]) if u[:1] == " " else self.head.get(u) for u in set().union(*cut)}
        new = [u for u, ids in known.items() if ids is None]
        known.update(zip(new, self.encode_all(new)))
        for k, units in zip(which, cut):
            out[k] = b"".join(map(known.__getitem__, units))


def library_encoder(path: str) -> ChunkEncoder:
    """The encoder of a tokenizers file, without the special tokens that a template adds. One for each process."""
    if (key := (path, "library")) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()

        def encode_all(texts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        _encoders[key] = ChunkEncoder(encode_all, _word_encoder(tokenizer))
    return _encoders[key]


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself if it is visible, else from 256 up."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _word_encoder(tokenizer) -> Callable[[str, str], bytes] | None:
    """Words of plain letters by the library's model alone: what stands before it leaves them whole.

    Both vocabularies' patterns keep letters together, the space before them too or else drop it; the normaliser
    only lowers such letters. None if a trial shows that a tokenizer is not like that.
    """
    tokenize, lowers = tokenizer.model.tokenize, tokenizer.normalizer is not None
    stands = {b: c for c, b in byte_of_char().items()}
    space = stands[32]
    keeps_space = tokenizer.encode(" a", add_special_tokens=False).ids != tokenizer.encode("a", add_special_tokens=False).ids

    def word(before: str, w: str) -> bytes:
        if lowers:
            w = w.lower()
        if not w.isascii():
            w = w.encode().decode("latin-1").translate(stands)
        return array("I", [t.id for t in tokenize(space + w if before and keeps_space else w)]).tobytes()

    trials = [(b, w) for b in ("", " ") for w in ("a", "the", "Zebra", "Éclair", "ßtraße", "ÀÖøÿ", "hELLo", "ª", "µ")]
    same = all(word(b, w) == array("I", tokenizer.encode(b + w, add_special_tokens=False).ids).tobytes() for b, w in trials)
    return word if same else None
