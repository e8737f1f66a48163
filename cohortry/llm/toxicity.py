"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max index, calibrated votes.

Terms are the words of a text in lower case, known by a 64-bit hash; all words of the examples are in
the cosine.  Weights come from document frequencies over all documents, and terms that mark toxic
examples clearly weigh more.  Postings of the rarer terms are added up; of the common ones every block
of examples knows its largest weights, and only examples whose bound reaches the k-th best cosine
found so far are compared in full, so the neighbours are exactly the nearest ones.  Their votes are
weighted by distance, and an isotonic fit over votes that leave the example itself out turns them
into probabilities.  A document that is an example is scored by the others too.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortry.llm.common import free_name, give_memory_back, new_folder, put_file, read_file, slices, stored, text_or_empty

#: Bounds: labelled examples, and terms of them, each counted once an example (the first by a hash of their id).
MOST_EXAMPLES, MOST_TERMS = 20_000, 8_000_000
#: A term is clear if it is in so many examples, stands so many standard deviations above chance, and
#: its examples are toxic so many times as often as all are.  It weighs so many times its TF-IDF:
#: chosen among 1, 2, 4 and 8 by leaving out one of the examples, none of which is held out.
LEAST_EXAMPLES, LEAST_Z, LEAST_LIFT, CLEAR_WEIGHT = 5, 6.0, 3.0, 4.0
NEIGHBOURS, BLOCK, COMMON = 15, 64, 512
#: From this share of marked blocks on, all are compared.
DENSE = 0.25
EVIDENCE = "array<struct<doc_id: bigint, cosine: double, label: int>>"

_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W")
_FOREIGN_GAP = re.compile(r"[^\w\x00-\x7f]+")
#: Whether a byte belongs to a word; of letters beyond ASCII all do, once ``_FOREIGN_GAP`` is gone.
_IN_WORD = np.array([b >= 128 or bool(_WORD.match(chr(b))) for b in range(256)])


def terms(text: str) -> Counter:
    """How often each word occurs."""
    return Counter(_WORD.findall(text.lower()))


def _pieces(text: str, size: int = 2_000_000) -> Iterator[str]:
    """The text in lower case, a very long one cut between words."""
    text, at = text.lower(), 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def _words_of(pieces: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the pieces in their order, as UTF-8, and how many each piece has."""
    raw = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    inside = _IN_WORD[raw]
    start = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    end = np.flatnonzero(~inside & np.r_[False, inside[:-1]])
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    upto = np.searchsorted(start, np.cumsum([len(p) + 1 for p in pieces]))
    return words, np.diff(upto, prepend=0)


def _hashes(words: pa.Array) -> np.ndarray:
    """The hash of each of the binary words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, content = words.buffers()
    at, content = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist(), content.to_pybytes()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(content.__getitem__, map(slice, at, at[1:]))), np.uint64, len(words))


def counted_words(texts: Iterable[str], vocabulary: np.ndarray | None = None, room: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of every different word of every text, by row and term.

    A term is the word's hash, or its place in the sorted hashes of a vocabulary; words outside it are
    left out.  Holds the words of about ``room`` letters at a time.
    """
    parts: list[tuple] = []
    pieces: list[bytes] = []
    rows: list[int] = []

    def flush():
        words, lengths = _words_of(pieces)
        coded = words.dictionary_encode()
        hashed = _hashes(coded.dictionary)
        by = np.argsort(hashed)
        hashed, place = hashed[by], np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        code, row = place[coded.indices.to_numpy()], np.repeat(np.array(rows, np.int64), lengths)
        term = hashed
        if vocabulary is not None:
            term = np.searchsorted(vocabulary, hashed)
            known = vocabulary[np.minimum(term, len(vocabulary) - 1)] == hashed if len(vocabulary) else np.zeros(len(hashed), bool)
            some = known[code]
            code, row = code[some], row[some]
        key, n = np.unique(row * max(len(hashed), 1) + code, return_counts=True)
        row, code = np.divmod(key, max(len(hashed), 1))
        parts.append((row, term[code], n))
        pieces.clear(), rows.clear()

    held = 0
    for i, t in enumerate(texts):
        for piece in _pieces(t):
            pieces.append((piece if piece.isascii() else _FOREIGN_GAP.sub(" ", piece)).encode())
            rows.append(i)
            held += len(piece)
            if held >= room:
                flush()
                held = 0
    flush()
    own = [p[0] for p in parts if len(p[0])]
    row, term, n = (np.concatenate(x) for x in zip(*parts))
    if all(a[-1] < b[0] for a, b in zip(own, own[1:])):
        return row, term, n
    by = np.lexsort((term, row))  # some text was counted in pieces
    row, term, n = row[by], term[by], n[by]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[first], term[first], np.add.reduceat(n, first) if len(first) else n


def _by_row(n_rows: int, row: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The columns' parts of each row."""
    at = np.searchsorted(row, np.arange(n_rows + 1))
    for i in range(n_rows):
        yield tuple(c[at[i] : at[i + 1]] for c in columns)


def _joined(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The values from each start to its end, one range after the other."""
    content, size = memoryview(values).cast("B") if len(values) else b"", values.itemsize
    return np.frombuffer(b"".join(map(content.__getitem__, map(slice, (start * size).tolist(), (end * size).tolist()))), values.dtype)


class BlockMaxIndex:
    """Unit vectors: postings of the rarer terms; of the commonest, rows of weights and largest weights a block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, common: int = COMMON):
        n, self.block = len(vectors), block
        term = np.concatenate([np.zeros(0, np.int32), *(t.astype(np.int32, copy=False) for t, _ in vectors)])
        weight = np.concatenate([np.zeros(0, np.float32), *(w.astype(np.float32, copy=False) for _, w in vectors)])
        at = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in vectors])
        often = np.bincount(term, minlength=n_terms)
        common = min(common, n_terms)
        self.column = np.full(n_terms, -1, np.int32)  # of a common term
        self.column[np.argsort(-often, kind="stable")[:common]] = np.arange(common)
        some = self.column[term] >= 0
        full = np.zeros((n, common), np.float32)
        full[at[some], self.column[term[some]]] = weight[some]
        # similar examples into the same block: by their heaviest common term
        self.order = np.lexsort((np.arange(n), np.argmax(full, 1) if common else np.zeros(n))).tolist() if n else []
        del full  # before the rows are filled: a task that builds holds one of the two
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        self.n, self.blocks = n, -(-n // block)
        rows = np.zeros((self.blocks * block, common), np.float32)
        rows[place[at[some]], self.column[term[some]]] = weight[some]
        self.rows = rows.reshape(self.blocks, block, common)
        self.largest = self.rows.max(1)
        self.norm = np.sqrt(np.einsum("ij,ij->i", rows, rows)).astype(np.float32)
        term, at, weight = term[~some], place[at[~some]], weight[~some]
        by = np.argsort(term, kind="stable")
        self.at, self.weight = at[by].astype(np.min_scalar_type(n)), weight[by]
        self.start = np.searchsorted(term[by], np.arange(n_terms + 1)).astype(np.int64)

    def __getstate__(self):
        """Arrays compressed: every Python worker reads them."""
        return {k: (v.dtype.str, v.shape, pa.compress(np.ascontiguousarray(v).tobytes(), "zstd", asbytes=True)) if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}

    def __setstate__(self, state):
        for k, v in state.items():
            if isinstance(v, tuple):
                kind, shape, packed = v
                size = int(np.prod(shape)) * np.dtype(kind).itemsize
                v = np.frombuffer(pa.decompress(packed, size, "zstd"), kind).reshape(shape) if size else np.zeros(shape, kind)
            self.__dict__[k] = v

    def nearest(self, terms_: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest, best first (ties: lower place); only cosines above 0."""
        return self.nearest_of([(terms_, weights)], [k])[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], ks: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query; a block is compared at once with all the queries it can matter to."""
        m, width = len(queries), self.blocks * self.block
        rarer = np.zeros((m, width))
        heavy = np.zeros((m, self.rows.shape[2]), np.float32)
        for i, (t, w) in enumerate(queries):
            column = self.column[t]
            rare, w = column < 0, np.asarray(w, np.float32)
            heavy[i, column[~rare]] = w[~rare]
            start, end = self.start[t[rare]], self.start[t[rare] + 1]
            product = np.repeat(w[rare], end - start)
            product *= _joined(self.weight, start, end)
            rarer[i] = np.bincount(_joined(self.at, start, end), product, width)
        score = rarer.astype(np.float32).reshape(m, self.blocks, self.block)
        bound = np.minimum((heavy @ self.largest.T)[:, :, None], np.linalg.norm(heavy, axis=1)[:, None, None] * self.norm.reshape(self.blocks, self.block))
        bound = (score + bound).max(2)
        seeds = np.zeros((m, self.blocks), bool)
        some = min(-(-2 * max(ks) // self.block) + 3, self.blocks)
        np.put_along_axis(seeds, np.argpartition(bound, self.blocks - some, axis=1)[:, self.blocks - some :], True, axis=1)
        reached = np.full((m, self.blocks, self.block), -1.0, np.float32)
        self._complete(score, heavy, seeds, reached)
        least = np.array([_kth(reached[i, seeds[i]].reshape(-1), k) for i, k in enumerate(ks)])
        # a cosine of the common terms is a sum of 32-bit products here: a little room, then exactly
        self._complete(score, heavy, (bound >= least[:, None] - 1e-4) & ~seeds, reached)
        out = []
        for i, (t, w) in enumerate(queries):
            found = np.flatnonzero(reached[i].reshape(-1) >= least[i] - 1e-4)
            found = found[reached[i].reshape(-1)[found] >= _kth(reached[i].reshape(-1)[found], ks[i]) - 1e-4]
            few = np.flatnonzero(heavy[i])
            rows = self.rows[found // self.block, found % self.block][:, few]
            cosine = rarer[i, found] + np.einsum("ij,j->i", rows.astype(np.float64), heavy[i, few].astype(np.float64))
            found, cosine = found[cosine > 0], cosine[cosine > 0]
            top = np.lexsort((found, -cosine))[: ks[i]]
            out.append((found[top], cosine[top]))
        return out

    def _complete(self, score, heavy, live, reached) -> None:
        """The common terms added to the scores of the blocks marked for each query."""
        if live.mean() > DENSE:  # one large product is faster than so many small ones
            width = self.blocks * self.block
            np.matmul(heavy, self.rows.reshape(width, -1).T, out=reached.reshape(len(heavy), width))
            reached += score
            return
        for b in np.flatnonzero(live.any(0)):
            some = np.flatnonzero(live[:, b])
            reached[some, b] = score[some, b] + heavy[some] @ self.rows[b].T


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, but not below 0 (0 if there are fewer)."""
    return max(float(np.partition(values, len(values) - k)[len(values) - k]), 0.0) if len(values) >= k else 0.0


class Model:
    """Vocabulary (sorted hashes), weights, examples and calibration; bounded by the examples.

    ``example`` are (doc_id, label) and ``vectors`` their terms and weights, of length one each.
    """

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, examples: list[tuple], vectors: list[tuple], prior: float):
        self.vocabulary, self.idf, self.prior, self.known = vocabulary, idf, prior, {}
        self.index, self.ids, self.labels, self.places, self.knots = None, [], np.zeros(0), {}, (np.zeros(0), np.zeros(0))
        none = [y for (_, y), (t, _) in zip(examples, vectors) if not len(t)]
        self.without = (sum(none) + 0.5) / (len(none) + 1) if none else prior
        some = [(e, v) for e, v in zip(examples, vectors) if len(v[0])]
        if not some:
            return
        self.index = BlockMaxIndex([v for _, v in some], len(idf))
        self.ids = [some[i][0][0] for i in self.index.order]
        self.labels = np.array([some[i][0][1] for i in self.index.order], float)
        for place, i in enumerate(self.ids):
            self.places.setdefault(i, []).append(place)

    def vector(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return numbers, unit(numbers, counts, self.idf)

    def votes(self, texts: list[tuple]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each (terms, counts, doc_id) the vote, and the nearest examples with their cosines; not those of its id."""
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            leave = [self.places.get(i, ()) for _, _, i in some]
            found = self.index.nearest_of([self.vector(t, n) for t, n, _ in some], [NEIGHBOURS + len(x) for x in leave])
            for own, (places, cosines) in zip(leave, found):
                if own:
                    keep = ~np.isin(places, own)
                    places, cosines = places[keep], cosines[keep]
                places, cosines = places[:NEIGHBOURS], cosines[:NEIGHBOURS]
                w = 1 / (1.05 - np.minimum(cosines, 1))
                yield float((w * self.labels[places]).sum() + self.prior) / float(w.sum() + 1), places, cosines

    def scores(self, texts: list[tuple]) -> list[tuple[float, list[tuple]]]:
        """For each (terms, counts, doc_id) the probability of the toxic label, and the three nearest examples (doc_id, cosine, label)."""
        if len(self.known) >= 20_000:  # bounds memory only
            self.known.clear()
        keys, new = [], {}
        for t, n, i in texts:
            if self.index is None or not len(t):
                keys.append(None)
                continue
            own = i if i in self.places else None
            key = (own, hashlib.blake2b(t.tobytes() + n.tobytes(), digest_size=16).digest())
            keys.append(key)
            if key not in self.known:
                new[key] = (t, n, own)
        for key, (vote, places, cosines) in zip(new, self.votes(list(new.values()))):
            p = float(np.interp(vote, *self.knots)) if len(places) else self.without
            self.known[key] = p, [(self.ids[i], float(c), int(self.labels[i])) for i, c in zip(places[:3], cosines[:3])]
        return [self.known[key] if key else (self.without, []) for key in keys]


def unit(numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a text's terms, of length one."""
    w = (1 + np.log(np.maximum(counts, 1))) * idf[numbers]
    return (w / (np.linalg.norm(w) or 1.0)).astype(np.float32)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising fit of y to x, kept off 0 and 1."""
    by = np.argsort(x, kind="stable")
    stack: list[list[float]] = []  # sum of y, weight, first x, last x
    for a, b in zip(x[by], y[by]):
        if stack and stack[-1][3] == a:
            stack[-1][0] += b
            stack[-1][1] += 1
        else:
            stack.append([b, 1, a, a])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            s, n, _, last = stack.pop()
            stack[-1][0] += s
            stack[-1][1] += n
            stack[-1][3] = last
    at = np.array([v for s in stack for v in (s[2], s[3])])
    fit = np.array([v for s in stack for v in [min(max(s[0] / s[1], 0.001), 0.999)] * 2])
    return at, fit


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def examples_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled examples (doc_id, digest, toxic, terms, counts: packed), at most ``MOST_EXAMPLES`` (an action).

    One row for each id and text, the first by a hash of the id among those of which a document exists.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.md5(text_or_empty()).alias("digest"))
    chosen = rows.select("doc_id", "digest").join(known, "doc_id").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(MOST_EXAMPLES)
    chosen = F.broadcast(stored(chosen, "chosen"))  # at most so many short rows
    sample = rows.join(chosen, ["doc_id", "digest"]).select(F.col("doc_id").cast("long"), "digest", "toxic", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            for part in slices(b, 3):
                ids = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                new = [i for i, key in enumerate(ids) if key not in seen and not seen.add(key)]
                part = part.take(pa.array(new, pa.int64()))
                found = list(_by_row(part.num_rows, *counted_words(part.column(3).to_pylist())))
                packed = [pa.array([f[0].astype(np.uint64).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.int32).tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *packed], ["doc_id", "digest", "toxic", "terms", "counts"])

    packed = sample.mapInArrow(_given_back(vectors), "doc_id long, digest string, toxic int, terms binary, counts binary")
    parts = docs.sparkSession.sparkContext.defaultParallelism  # each later votes on its examples
    return stored(packed.repartition(parts, "doc_id", "digest").dropDuplicates(["doc_id", "digest"]), "examples")


_opened: dict = {}


def _once(path: str, read: Callable[[bytes], Any]) -> Any:
    """A file of the shared folder, read once in a task, which holds the last one."""
    if path not in _opened:
        _opened.clear()
        _opened[path] = read(read_file(path))
    return _opened[path]


def _forget() -> None:
    _opened.clear()
    give_memory_back()


def _given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and then its memory back: a Python worker outlives its task, and waits beside the tasks of later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _forget()

    return whole


def _words(folder: str) -> np.ndarray:
    return _once(f"{folder}/words", lambda content: np.frombuffer(content, np.uint64))


class Fitted:
    """A model in the shared folder, where tasks write and read it, and its calibration.

    A task reads it anew, some tenths of a second, and holds it no longer than it runs.
    """

    def __init__(self, folder: str, knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))):
        self.folder, self.knots = folder, knots

    def opened(self) -> Model:
        model = _once(f"{self.folder}/model", pickle.loads)
        model.knots = self.knots
        return model


def _in_a_task(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], None]) -> None:
    """Rows that are bounded, all in one task (an action); the driver holds none of them."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run(batches)
        yield pa.RecordBatch.from_arrays([pa.array([True])], ["done"])

    rows.coalesce(1).mapInArrow(_given_back(all_of), "done boolean").collect()


def _model(rows: pa.Table, vocabulary: np.ndarray, df: np.ndarray) -> Model:
    """The model of the examples; ``df``: documents with each word, and at the end all documents."""
    order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("digest", "ascending")]).to_pylist()
    ids, toxic, terms_, times = (rows.column(c) for c in ("doc_id", "toxic", "terms", "counts"))
    examples = [(ids[i].as_py(), toxic[i].as_py()) for i in order]
    length = pc.binary_length(terms_).to_numpy()[order].astype(np.int64) // 8
    ends = np.cumsum(length)
    number, counts = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.int32)
    for i, a, b in zip(order, ends - length, ends):
        number[a:b] = np.searchsorted(vocabulary, np.frombuffer(terms_[i].as_py(), np.uint64))
        counts[a:b] = np.frombuffer(times[i].as_py(), np.int32)
    del rows, ids, toxic, terms_, times
    give_memory_back()
    label, size, n = np.array([y for _, y in examples]), len(vocabulary), len(examples)
    p = float(label.mean())
    often = np.bincount(number, minlength=size)
    toxic = sum(y * np.bincount(number[np.repeat(label == y, length)], minlength=size) for y in np.unique(label))
    z = (toxic - often * p) / np.sqrt(often * (p * (1 - p) or 1.0))
    clear = (often >= LEAST_EXAMPLES) & (z >= LEAST_Z) & (toxic >= min(LEAST_LIFT * p, 0.9) * often)
    idf = (np.log((1 + df[size]) / (1 + df[:size])) + 1) * np.where(clear, CLEAR_WEIGHT, 1.0)
    del often, toxic, z, clear
    vectors = [(number[a:b], unit(number[a:b], counts[a:b], idf)) for a, b in zip(ends - length, ends)]
    del counts
    return Model(vocabulary, idf, examples, vectors, (label.sum() + 0.5) / (n + 1))


def fit(docs: DataFrame, labels: DataFrame) -> Fitted:
    """The model of documents (doc_id, text) and labels (doc_id, toxic).

    Learns labels only from rows that are not held out.  Of rows with one doc_id the larger label
    counts; NULL ids and labels are left out.  Without labels every score is 0.5; with one label only,
    or no term at all, every score is its smoothed share.

    Runs jobs: the words of the examples (at most ``MOST_TERMS`` with repeats), the document
    frequencies of these words over all documents, the model, and the vote of the others on each
    example.  Words and model, bounded like the examples, are put together by a task each and lie in
    the shared folder; the driver sees one number for each example, and its vote.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "model")
    sample = examples_of(docs, labels)
    sizes = sample.select("doc_id", "digest", (F.length("terms") / 8).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "digest").toArrow()
    if not sizes.num_rows:
        put_file(folder, "model", pickle.dumps(Model(np.zeros(0, np.uint64), np.zeros(0), [], [], 0.5)))
        return Fitted(folder)
    fits = max(int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), MOST_TERMS, side="right")), 1)
    if fits < sizes.num_rows:
        some = sizes.slice(0, fits).select(["doc_id", "digest"])
        sample = sample.join(F.broadcast(spark.createDataFrame(some)), ["doc_id", "digest"], "left_semi")  # bounded like the examples

    def words(batches: Iterator[pa.RecordBatch]) -> None:
        found = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for b in batches for x in b.column(0)]))
        put_file(folder, "words", found.tobytes())

    _in_a_task(sample.select("terms"), words)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _words(folder)
        size = len(vocabulary)
        df, rows = np.zeros(size + 1, np.int64), 0
        for b in batches:
            for part in slices(b, 0):
                df[:size] += np.bincount(counted_words(part.column(0).to_pylist(), vocabulary)[1], minlength=size)
            rows += b.num_rows
        df[size] = rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(_given_back(frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    counted = stored(counted, "frequencies")

    def build(batches: Iterator[pa.RecordBatch]) -> None:
        vocabulary = _words(folder)
        df, parts = np.zeros(len(vocabulary) + 1), []
        for b in batches:
            own = pc.is_valid(b.column("df"))
            some = b.filter(own)
            df[some.column("term").to_numpy()] = some.column("df").to_numpy()
            parts.append(b.filter(pc.invert(own)))
        rows = [pa.Table.from_batches(parts)]
        parts.clear()  # the model needs the memory
        put_file(folder, "model", pickle.dumps(_model(rows.pop(), vocabulary, df), pickle.HIGHEST_PROTOCOL))

    own = sample.select("doc_id", "digest", "toxic", "terms", "counts")
    _in_a_task(own.unionByName(counted, allowMissingColumns=True), build)
    model = Fitted(folder)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.opened()
        for b in batches:
            ids, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = [(np.searchsorted(m.vocabulary, np.frombuffer(t, np.uint64)).astype(np.int32), np.frombuffer(c, np.int32), i) for i, t, c in zip(ids, b.column(2).to_pylist(), b.column(3).to_pylist())]
            given = m.votes([t for t in texts if len(t[0])])
            found = [next(given)[0] if len(t[0]) else None for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(found, pa.float64())], ["label", "vote"])

    found = sample.select("doc_id", "toxic", "terms", "counts").mapInArrow(_given_back(votes), "label int, vote double").toArrow()
    found = found.drop_null().sort_by([("vote", "ascending"), ("label", "ascending")])
    return Fitted(folder, isotonic(found.column("vote").to_numpy(), found.column("label").to_numpy()))


def scored(docs: DataFrame, model: Fitted, text: str = "text", keep_text: bool = True, id_: str = "doc_id") -> DataFrame:
    """``docs`` with toxic_score (0 to 1) and toxic_evidence, the nearest examples.

    Examples with the id of a row (column ``id_``, if there is one) do not vote on it.  A text without
    a term of any example, empty or NULL, gets the share of toxic ones among such examples.  Repeated
    rows score alike.  Columns of ``docs`` called like a result raise.
    """
    if {"toxic_score", "toxic_evidence"} & set(docs.columns):
        raise ValueError("a column is called as a result")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if keep_text or c != text]
    own = F.col(id_).cast("long") if id_ in docs.columns else F.lit(None).cast("long")
    own, cut = own.alias(free_name(docs, "_id")), text_or_empty(text).alias(free_name(docs, "_text"))
    at = len(kept)
    once = text in kept and dict(docs.dtypes)[text] == "string"  # a batch holds each text once
    narrow, read = (docs.select(*kept, own), kept.index(text)) if once else (docs.select(*kept, own, cut), at + 1)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value.opened()
        for b in batches:
            for part in slices(b, read):
                texts = (t or "" for t in part.column(read).to_pylist())
                rows = _by_row(part.num_rows, *counted_words(texts, m.vocabulary))
                found = m.scores([(t.astype(np.int32), n, i) for i, (t, n) in zip(part.column(at).to_pylist(), rows)])
                near = [[{"doc_id": d, "cosine": c, "label": y} for d, c, y in f[1]] for f in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array([f[0] for f in found], pa.float64()), pa.array(near, evidence)], [*kept, "toxic_score", "toxic_evidence"])

    schema = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL(f"toxic_score double, toxic_evidence {EVIDENCE}").fields])
    return narrow.mapInArrow(_given_back(run), schema)
