"""Packing of tokenised documents into windows of fixed length, best fit decreasing.

A document is first cut into full windows; what is left of it goes to the open window with the
tightest room that still holds it, longest pieces first.  Only the length of a piece decides where
it goes, so the plan is made from the histogram of lengths (at most one entry per length below the
window) and holds runs of equal windows, never single ones: its size depends on the window, not on
the corpus.  Pieces then find their run by their place in one global sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.ranking import running_totals


class RoomTree:
    """A segment tree over room 0..size that holds how many open windows have it."""

    def __init__(self, size: int):
        self.base = 1
        while self.base < size + 1:
            self.base *= 2
        self.count = [0] * (2 * self.base)

    def add(self, room: int, n: int) -> None:
        i = room + self.base
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open window has."""
        i = need + self.base
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def plan(lengths: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Runs (first place, length, pieces per window, first window, offset) and the number of windows.

    ``lengths`` maps a length in 1..window to how many pieces have it.  Places number the pieces
    from the longest to the shortest.  In a run, each window gets ``pieces per window`` pieces.
    Windows with equal room are alike, so whole ranges of them are moved at once; the result is
    what placing the pieces one by one would give.
    """
    tree, ranges = RoomTree(window), [[] for _ in range(window + 1)]
    runs, place, windows = [], 0, 0

    def put(size, per, first, n_windows, room):
        nonlocal place
        runs.append((place, size, per, first, window - room))
        place += per * n_windows
        left = room - per * size
        if left:
            ranges[left].append((first, n_windows))
            tree.add(left, n_windows)

    for size in sorted(lengths, reverse=True):
        n = lengths[size]
        while n:
            room = tree.tightest(size)
            if room is None:
                room, first, have = window, windows, n
            else:
                first, have = ranges[room].pop()
                tree.add(room, -have)
            per = room // size
            use = min(have, n // per)
            per, use = (per, use) if use else (n, 1)
            if room == window:
                windows += use
            elif have > use:
                ranges[room].append((first + use, have - use))
                tree.add(room, have - use)
            put(size, per, first, use, room)
            n -= per * use
    return np.array(runs, np.int64).reshape(-1, 5), windows


def place_of(runs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of the pieces at the given places."""
    r = runs[np.searchsorted(runs[:, 0], places, side="right") - 1]
    k = places - r[:, 0]
    return r[:, 3] + k // r[:, 2], r[:, 4] + k % r[:, 2] * r[:, 1]


def pack(tokens: DataFrame, window: int = 1024, width: int = 4) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``tokens`` holds (doc_id, ids, n, row) as ``tokens.encoded`` gives them; ``ids`` comes back as
    packed little-endian unsigned 32-bit ids.  Every id is in exactly one piece; pieces in a
    sequence leave no gap from offset 0.  A row without ids gives no piece; an empty table gives an
    empty result.  Equal lengths are placed by doc_id (NULL first), then row; repeated rows are
    packed each for itself.  Ids travel once, joined by row to the narrow plan.

    Runs jobs: the sort of the narrow rows and one histogram of at most ``window`` lengths.
    """
    if window < 1:
        raise ValueError("window must be positive")
    narrow = tokens.select(
        "row", "doc_id", "n", F.expr(f"n % {window}").alias("rest"), F.expr(f"n div {window}").alias("full"), F.lit(1).cast("long").alias("one")
    )
    placed = running_totals(narrow, [F.col("rest").desc(), "doc_id", "row"], {"upto": "one", "full_upto": "full"})
    lengths = {r["rest"]: r["k"] for r in narrow.where("rest > 0").groupBy("rest").agg(F.count("*").alias("k")).collect()}
    runs, windows = plan(lengths, window)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = b.column("rest").to_numpy(zero_copy_only=False)
            at = b.column("upto").to_numpy(zero_copy_only=False) - 1
            seq, off = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            some = rest > 0
            if some.any():
                seq[some], off[some] = place_of(runs, at[some])
            before = windows + b.column("full_upto").to_numpy(zero_copy_only=False) - b.column("full").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(seq), pa.array(off), pa.array(before)], ["row", "seq", "off", "full_from"])

    where = placed.select("row", "rest", "upto", "full", "full_upto").mapInArrow(look_up, "row long, seq long, off long, full_from long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "n", "seq", "off", "full_from", "ids")]
            held = 0
            for doc, n, seq, off, full, ids in zip(*cols):
                raw = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                for i in range(n // window):
                    out.append((doc, i * window, window, n, full + i, 0, raw[4 * i * window : 4 * (i + 1) * window]))
                if n % window:
                    s = n - n % window
                    out.append((doc, s, n - s, n, seq, off, raw[4 * s :]))
                held += len(raw)
                if held > 8_000_000:
                    yield _pieces(out)
                    out, held = [], 0
            yield _pieces(out)

    wide = tokens.select("row", "doc_id", "n", "ids").join(where, "row")
    return wide.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols)], names)


def sequences(pieces: DataFrame, pad_id: int, window: int = 1024) -> DataFrame:
    """(sequence_id, ids, length): the packed rows themselves, padded to the window.

    A sequence is not padded if its length is a power of two.  A group is one window at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    odd = F.expr("length & (length - 1)") != 0
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), F.when(odd, F.lit(window) - F.col("length")).otherwise(F.lit(0)).cast("int")))
    return whole.select("sequence_id", F.concat(joined, pad).alias("ids"), "length")
