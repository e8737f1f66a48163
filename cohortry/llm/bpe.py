"""Byte-level BPE by longest matches and backtracking over compatible neighbours.

A sequence of tokens is the one that merging by rank gives exactly if every two neighbours are what
merging gives for the two alone: a merge over a boundary would be the first one in the pair as well.
So a piece is covered from the left by the longest token at each place, a token that does not go
with its left neighbour is replaced by its longest prefix that is a token, and places from which no
way leads on are remembered and never entered again.  Each place is left at most once per token
length, so the work is linear in the piece.  Whether two tokens go together is worked out once and
remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import free_name, slices, text_or_empty
from cohortry.llm.encoders import SpaceLed, _Chunks

#: Bound of the remembered pairs in a worker; on reaching it they are forgotten and found again.
_PAIRS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    """Encoder of single pieces.  Bytes stand as Latin-1 characters, one each."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.token = {r: t for t, r in self.rank.items()}
        self.found = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.found.add_word(t, (len(t), r))
        self.found.make_automaton()
        self.size = [len(self.token.get(r, "")) for r in range(max(self.token, default=-1) + 1)]
        self.pairs: dict[int, bool] = {}  # left << 32 | right
        self.alone: dict[int, bool] = {}
        self.prefix: dict[int, int] = {}

    def merged(self, s: str) -> list[int]:
        """Merging by rank, the definition itself; for short strings."""
        rank, parts = self.rank, list(s)
        while len(parts) > 1:
            best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if best == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def _fits(self, left: int | None, right: int) -> bool:
        if left is None:
            if right not in self.alone:
                self.alone[right] = self.merged(self.token[right]) == [right]
            return self.alone[right]
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 32 | right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def _shorter(self, t: int) -> int:
        """The longest token that is a proper prefix of ``t``; -1 if there is none."""
        if t not in self.prefix:
            s = self.token[t]
            self.prefix[t] = next((self.rank[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.rank), -1)
        return self.prefix[t]

    def piece(self, s: str) -> list[int]:
        """The ids of one piece."""
        whole = self.rank.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest = [-1] * n
        for end, (length, r) in self.found.iter(s):  # by end, so the last one seen at a start is the longest
            longest[end - length + 1] = r
        out, ends, dead = [], [0], bytearray(n + 1)
        size, known, at, left = self.size, self.pairs.get, 0, None
        t = longest[0] if n else -1
        while at < n:
            while t != -1:
                to = at + size[t]
                if not dead[to]:
                    fits = None if left is None else known(left << 32 | t)
                    if self._fits(left, t) if fits is None else fits:
                        break
                t = self._shorter(t)
            if t == -1:
                if not out:
                    raise ValueError("a byte is missing in the vocabulary")
                dead[at] = 1
                ends.pop()
                at, t = ends[-1], self._shorter(out.pop())
                left = out[-1] if out else None
            else:
                out.append(t)
                ends.append(to)
                at, left = to, t
                t = longest[to] if to < n else -1
        return out


class TextEncoder(SpaceLed):
    """Whole texts: cut at spaces as ``SpaceLed`` does, then by the pattern, then piece by piece."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe = ByteBpe(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.form, self.tails = "I", {}
        self.cache, self.first = _Chunks(self._chunk), _Chunks(self._opening, entries=100_000)
        self.pieces = _Chunks(self._of_text, entries=100_000)

    def _spell(self, piece: str) -> str:
        return piece.encode().decode("latin-1")

    def _piece(self, spelt: str) -> bytes:
        return self._pack(self.bpe.piece(spelt))

    def _of_text(self, piece: str) -> bytes:
        return self._piece(self._spell(piece))

    def _alone(self, text: str) -> bytes:
        self.pieces.turn()
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


_MADE: dict = {}


def _text_encoder(path: str, pattern: str) -> TextEncoder:
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = TextEncoder(path, pattern)
    return _MADE[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without the text, with a binary column of packed little-endian unsigned 32-bit ids.

    A NULL text is an empty one; an empty text has no ids.  Whole texts of any length, no special
    tokens.  Other columns pass through; a column that is called as the result is renamed by the
    caller (it raises).  Repeated rows stay.
    """
    if out in docs.columns:
        raise ValueError(f"a column is called {out} already")
    rest = [c for c in docs.columns if c != text]
    narrow = docs.select(*rest, text_or_empty(text).alias(free_name(docs, "_text")))
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _text_encoder(path, pattern)
        for b in batches:
            for part in slices(b, at):
                ids = pa.array(enc.encode(part.column(at).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], ids], [*rest, out])

    schema = docs.select(*rest).schema.add(out, "binary")
    return narrow.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with a binary column of the bytes that the packed ids stand for."""
    at = tokens.columns.index(ids)
    schema = tokens.select("*").schema.add(out, "binary")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {r: t for t, r in read_ranks(path).items()}.__getitem__
        for b in batches:
            texts = [None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names)

    return tokens.mapInArrow(run, schema)
