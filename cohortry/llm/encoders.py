"""Encoding of many texts with the tokenizers library, each distinct chunk once.

A chunk is what stands between two spaces.  Under both vocabularies no merge reaches over a space
that has no white space after it, so chunks are encoded alone and the ids of a text are those of its
chunks.  Texts in which white space follows a space are encoded as they are where that matters, and so
are texts that spell a special token, which the library gives its own id wherever it stands.
"""

from __future__ import annotations

import struct
from itertools import islice

def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _spelling() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + rest.index(b)) for b in range(256)]


_SPELT = dict(enumerate(_spelling()))

#: After letters, any run of these is one piece under every pattern in use.
MARKS = ".,:;!?*%&$#"


class _WhiteRun(Exception):
    """A piece shows that a space has white space after it."""


class _Chunks(dict):
    """Packed ids by chunk, made when first met; two generations, the older one dropped as a whole.

    It only saves work; what it gives never depends on its size.
    """

    def __init__(self, make, entries: int = 300_000, chars: int = 8_000_000):
        super().__init__()
        self.make, self.entries, self.chars, self.old, self.held = make, entries, chars, {}, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        self[chunk] = ids
        self.held += len(chunk)
        return ids

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.entries or self.held > self.chars:
            self.old, self.held = dict(self), 0
            self.clear()


class _Chunked:
    """Letters, and letters followed by ``MARKS``, are pieces of their own under either pattern: the model gets them as they are, anything else goes through the whole tokenizer."""

    special: list[str] = []  # spellings with an id of their own

    def __init__(self, path: str, width: int = 4):
        self.tok = _load(path)
        self.tokenize = self.tok.model.tokenize
        self.form = {2: "H", 4: "I"}[width]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.tails: dict[str, bytes] = {}
        self.cache = _Chunks(self._chunk)

    def _pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}{self.form}", *ids)

    def _alone(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _spells_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _piece(self, spelt: str) -> bytes:
        return self._pack([t.id for t in self.tokenize(spelt)])

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            if len(self.tails) > 1000:
                self.tails.clear()
            ids = self.tails[tail] = self._alone(tail)
        return ids


class SpaceLed(_Chunked):
    """Byte-level vocabularies in which a word carries the space before it."""

    def __init__(self, path: str, width: int = 4):
        super().__init__(path, width)
        self.first = _Chunks(self._opening, entries=100_000)

    def _spell(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(_SPELT)

    def _chunk(self, c: str) -> bytes:
        """Ids of " " + c."""
        word = c.rstrip(MARKS)
        if word.isalpha():
            if len(word) < len(c):
                return self.cache[word] + self._tail(c[len(word) :])
            return self._piece(self._spell(" " + c))
        if not c or c[0].isspace():
            raise _WhiteRun
        a, feed, b = c.partition("\n")
        if a and b[:1].isalpha() and not a[-1].isspace():
            # a line feed between another character and a letter is a piece of its own
            return self.cache[a] + self._tail(feed) + self.first[b]
        return self._alone(" " + c)

    def _opening(self, c: str) -> bytes:
        """Ids of what stands at the start of a text or a line."""
        word = c.rstrip(MARKS)
        if word.isalpha():
            own = self._piece(self._spell(word))
            return own + self._tail(c[len(word) :]) if len(word) < len(c) else own
        return self._alone(c) if c else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        cache, first, out = self.cache, self.first, []
        for t in texts:
            if self._spells_special(t):
                out.append(self._alone(t))
                continue
            parts = t.split(" ")
            try:
                out.append(first[parts[0]] + b"".join(map(cache.__getitem__, islice(parts, 1, None))))
            except _WhiteRun:
                out.append(self._alone(t))
            cache.turn()
            first.turn()
        return out


class WordEnded(_Chunked):
    """Vocabularies that drop white space and mark the end of a word."""

    def __init__(self, path: str, width: int = 4):
        super().__init__(path, width)
        self.cache = _Chunks(self._chunk, entries=600_000, chars=16_000_000)
        self.normal = self.tok.normalizer.normalize_str

    def _chunk(self, c: str) -> bytes:
        word = c.rstrip(MARKS)
        plain = word.lower() if word.isascii() else self.normal(word)
        if word.isalpha() and plain.isalpha():  # no letter came apart
            if len(word) < len(c):
                return self.cache[word] + self._tail(c[len(word) :])
            return self._piece(plain.encode().decode("latin-1").translate(_SPELT))
        return self._alone(c)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        cache, out = self.cache, []
        for t in texts:
            if self._spells_special(t):
                out.append(self._alone(t))
                continue
            out.append(b"".join(map(cache.__getitem__, t.replace("\n", " ").split(" "))))  # both are dropped
            cache.turn()
        return out


_MADE: dict = {}


def encoder(kind: type, path: str, width: int = 4):
    """One encoder per kind, file and width in each worker process, kept between tasks."""
    if (kind, path, width) not in _MADE:
        _MADE[kind, path, width] = kind(path, width)
    return _MADE[kind, path, width]
