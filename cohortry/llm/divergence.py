"""How far the sources of a language differ in their words, over the words that enough documents have.

Which terms are kept is found by iceberg prefix refinement.  A prefix that fewer than ``min_docs``
documents have cannot belong to a kept term, so level by level the prefixes are lengthened, only below
prefixes that survived, until the surviving ones are whole terms.

Documents are cut into terms once and stored in blocks.  A block holds the sorted terms of its
documents in one language, which of its documents have each rare term, and the occurrences by source.
Each document lies in one block, so the documents that have a prefix are counted exactly within a
block and added up over blocks; a term or prefix that the whole corpus has is one row a block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import stored, stream_groups

#: Bytes of text of a block, bytes of a long text cut into terms at once, sources compared in a task, terms compared in a task.
BLOCK, PIECE, SOURCES, TERMS = 32 << 20, 4 << 20, 128, 16384

#: ASCII letters in lower case and every byte above ASCII as they are, the rest as spaces: what lies between spaces is a term.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def counted(text: bytes) -> Counter:
    """Occurrences of each term of a text."""
    clean = text.translate(_LETTERS)
    found, at = Counter(), 0
    while at < len(clean):
        to = clean.find(b" ", at + PIECE) if len(clean) - at > PIECE else -1
        found.update(clean[at : to if to >= 0 else None].split())
        at = to if to >= 0 else len(clean)
    return found


class _Block:
    """Documents of one language gathered in a task."""

    def __init__(self):
        self.ids = defaultdict(count().__next__)
        self.sources = defaultdict(count().__next__)
        self.terms, self.times, self.source = [], [], []

    def add(self, source: str, text: bytes) -> None:
        found = counted(text)
        self.terms.append(np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        self.source.append(self.sources[source])

    def row(self, min_docs: int) -> dict:
        names = sorted(self.ids)
        n = len(names)
        place = np.empty(n, np.int64)
        place[np.fromiter(map(self.ids.__getitem__, names), np.int64, n)] = np.arange(n)
        term = place[np.concatenate(self.terms)]
        sizes = [len(t) for t in self.terms]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        docs = np.bincount(term, minlength=n)
        rare = np.flatnonzero(docs[term] < min_docs)
        rare = rare[np.argsort(term[rare], kind="stable")]
        pair = np.repeat(np.array(self.source, np.int64), sizes) * max(n, 1) + term
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], np.concatenate(self.times)[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
        return {
            "terms": b" ".join(names), "docs": docs.astype("<i4").tobytes(), "postings": doc[rare].astype("<i4").tobytes(),
            "sources": list(self.sources), "pairs": pair[starts].astype("<i8").tobytes(), "times": (np.add.reduceat(times, starts) if len(starts) else times).astype("<i8").tobytes(),
        }


_BLOCKS = "block long, lang string, terms binary, docs binary, postings binary, sources array<string>, pairs binary, times binary"


def _blocks(docs: DataFrame, min_docs: int, size: int) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("terms", pa.binary()), ("docs", pa.binary()), ("postings", pa.binary()), ("sources", pa.list_(pa.string())), ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), count()
        held: dict[str, _Block] = defaultdict(_Block)
        weight = 0

        def flush():
            for lang, block in held.items():
                yield pa.RecordBatch.from_pylist([{"block": (task << 32) + next(number), "lang": lang} | block.row(min_docs)], schema)
            held.clear()

        for b in batches:
            text = b.column(2).cast(pa.binary())
            for lang, source, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text):
                value = value.as_py()
                held[lang].add(source, value)
                weight += len(value)
                if weight > size:
                    yield from flush()
                    weight = 0
        yield from flush()

    return stored(docs.select("lang", "source", "text").mapInArrow(run, _BLOCKS), "term-blocks")


def _numbers(value: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(value, kind)


def prefix_counts(terms: list[bytes], docs: np.ndarray, postings: np.ndarray, ranges: list[tuple[int, int]], length: int, min_docs: int) -> list[tuple[bytes, int, int, int, bool]]:
    """(key, documents, from, to, whole) of the prefixes of ``length`` bytes of a block's sorted terms.

    A term shorter than that ends in a space, by which it differs from every prefix and is whole.
    Documents are counted once each; a count of ``min_docs`` or more may be given as ``min_docs``.
    """
    first = np.concatenate([[0], np.cumsum(np.where(docs < min_docs, docs, 0))]).tolist()
    docs, postings = docs.tolist(), postings.tolist()
    out = []
    for low, high in ranges:
        keys = [(t + b" ")[:length] for t in terms[low:high]]
        keys.append(None)
        at = low
        for to in range(low + 1, high + 1):
            key = keys[to - low - 1]
            if keys[to - low] != key:
                most = docs[at] if to == at + 1 else max(docs[at:to])
                if to > at + 1 and most < min_docs:
                    most = min(min_docs, len(set(postings[first[at] : first[to]])))
                out.append((key, most, at, to, key[-1] == 32))
                at = to
    return out


def _level(blocks: DataFrame, length: int, min_docs: int) -> DataFrame:
    """Prefixes of one length in each block, below the ranges that survived (all terms if ``ranges`` is NULL)."""
    schema = "lang string, key binary, docs int, block long, low int, high int, whole boolean"
    arrow = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("docs", pa.int32()), ("block", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                terms = r["terms"].split()
                ranges = [(0, len(terms))] if r["ranges"] is None else sorted((x["low"], x["high"]) for x in r["ranges"])
                found = prefix_counts(terms, _numbers(r["docs"], "<i4"), _numbers(r["postings"], "<i4"), ranges, length, min_docs)
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    key, docs, low, high, whole = zip(*part)
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([r["lang"]] * n, key, docs, [r["block"]] * n, low, high, whole), arrow)], schema=arrow)

    return blocks.select("block", "lang", "terms", "docs", "postings", "ranges").mapInArrow(run, schema)


def kept_terms(blocks: DataFrame, min_docs: int) -> DataFrame:
    """(block, low) of every term of a block that ``min_docs`` documents of the language have (runs a few jobs a level)."""
    now = blocks.withColumn("ranges", F.lit(None).cast("array<struct<low:int,high:int>>"))
    length, found = 4, []
    while True:
        # a prefix has one row a block at most, so the sums run over few rows
        docs = F.sum("docs").over(Window.partitionBy("lang", "key"))
        alive = _level(now, length, min_docs).withColumn("_docs", docs).where(F.col("_docs") >= min_docs)
        alive = stored(alive.select("block", "low", "high", "whole"), "prefixes-alive")
        found.append(alive.where("whole").select("block", "low"))
        open_ = alive.where("NOT whole")
        if open_.isEmpty():
            break
        ranges = open_.groupBy("block").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
        now = blocks.join(ranges, "block")
        length = max(length + 4, length * 3 // 2)
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def _occurrences(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the kept terms."""
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                terms = pa.array(r["terms"].split(), pa.binary()).cast(pa.string())
                keep = np.zeros(len(terms), bool)
                keep[r["kept"]] = True
                pair, times = _numbers(r["pairs"], "<i8"), _numbers(r["times"], "<i8")
                source, term = np.divmod(pair, max(len(terms), 1))
                sources = pa.array(r["sources"], pa.string())
                index = np.flatnonzero(keep[term])
                for at in range(0, len(index), 50_000):
                    k = index[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(k), pa.string()), sources.take(pa.array(source[k])), terms.take(pa.array(term[k])), pa.array(times[k])], schema=arrow)

    lists = kept.groupBy("block").agg(F.collect_list("low").alias("kept"))
    rows = blocks.select("block", "lang", "terms", "sources", "pairs", "times").join(lists, "block")
    return rows.drop("block").mapInArrow(run, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(1,000,000,000 * n / total) in whole numbers that fit a long, by long division in steps of 1,000."""
    whole, rest = np.divmod(n, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)² / (p + q))."""
    d = p - q
    return d * d // (p + q)


def _compared(batches: Iterator[pa.RecordBatch], top: int, side: int) -> Iterator[pa.RecordBatch]:
    """Per group (lang, bi, bj, salt): sums over its terms for pairs of sources, and the best terms of the sources of one block.

    Rows are the sums of the sources (without a term), the occurrences of a term in a source, and its
    occurrences in the language (without a source).
    """
    schema = pa.schema([("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("term", pa.string()), ("value", pa.int64())])
    for group in stream_groups(batches, 4):
        lang, bi, bj, salt = (group.column(k)[0].as_py() for k in range(4))
        term, idx, times = (group.column(c).combine_chunks() for c in ("term", "idx", "n"))
        head, whole = np.asarray(term.is_null()), np.asarray(idx.is_null())
        idx, times = idx.fill_null(-1).to_numpy(), times.to_numpy()
        names = np.sort(idx[head])
        place = {s: k for k, s in enumerate(names.tolist())}
        v, total = (group.column(c)[int(np.flatnonzero(head)[0])].as_py() for c in ("v", "total"))
        own = np.empty(len(names), np.int64)
        own[np.searchsorted(names, idx[head])] = times[head]
        own += 2 * v
        left, right = ([k for s, k in place.items() if s // side == b] for b in (bi, bj))
        # a kept term of which these sources have none has no row: all terms count as such once, and those with rows as what they differ by
        absent = share(np.full(len(own), 2), own)
        apart = distance(absent[left, None], absent[right])
        sums = (v if salt == 0 else 0) * apart
        best: list[tuple] = []
        seen = term.filter(pa.array(~head)).dictionary_encode()
        code, idx, times, whole = seen.indices.to_numpy(), idx[~head], times[~head], whole[~head]
        words = seen.dictionary.to_pylist()
        all_n = np.zeros(len(words), np.int64)
        all_n[code[whole]] = times[whole]
        code, idx, times = code[~whole], np.searchsorted(names, idx[~whole]), times[~whole]
        order = np.argsort(code, kind="stable")
        code, idx, times = code[order], idx[order], times[order]
        for start in range(0, len(words), 2048):
            a, b = np.searchsorted(code, [start, start + 2048])
            n = np.zeros((min(2048, len(words) - start), len(names)), np.int64)
            n[code[a:b] - start, idx[a:b]] = times[a:b]
            p = share(n + 2, own)
            sums -= len(n) * apart
            for x, k in enumerate(left):
                sums[x] += distance(p[:, k, None], p[:, right]).sum(axis=0)
            if bi == bj:
                q = share(all_n[start : start + len(n)] + 2, total + 2 * v)
                for s, k in place.items():
                    here = np.flatnonzero((n[:, k] > 0) & (p[:, k] > q))
                    value = distance(p[here, k], q[here])
                    if len(here) > top:
                        high = value >= np.partition(value, len(value) - top)[len(value) - top]
                        here, value = here[high], value[high]
                    # code points and UTF-8 bytes sort alike
                    best += sorted((s, -int(w), words[start + t]) for t, w in zip(here, value))[:top]
        names = names.tolist()
        rows = [(lang, names[k], names[m], None, int(sums[x, y])) for x, k in enumerate(left) for y, m in enumerate(right) if names[k] < names[m]]
        rows += [(lang, s, None, word, -w) for s, w, word in best]
        for begin in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[begin : begin + 50_000]), schema)], schema=schema)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block_bytes: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others.

    Terms are maximal runs of ASCII letters, lower-cased, and of characters beyond ASCII.  A language
    keeps the V terms that at least ``min_docs`` of its documents have; a group of N kept occurrences
    gives a term that occurs n times there the share p = 1 + floor(10^9 (n + 2) / (N + 2 V)).  Part
    ``pair``: per other source of the language the sum over the kept terms of floor((p - q)² / (p + q)).
    Part ``term``: the ``top`` kept terms of a source with n > 0 and p above the language's q, by that
    distance from it.  All arithmetic is in whole numbers; ranks break ties by the item.

    NULL text, lang and source are empty ones.  Every row is a document, also where rows or doc_ids
    repeat; only ``lang``, ``source`` and ``text`` are read.  Sources without terms take part; if no
    term is kept the pairs have the value 0.  An empty table gives an empty result.  Runs jobs.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")}
    docs = docs.select(*[e.alias(c) for c, e in text.items()])
    blocks = _blocks(docs, min_docs, block_bytes)
    times = stored(_occurrences(blocks, kept_terms(blocks, min_docs)), "kept-occurrences")

    whole = stored(times.groupBy("lang", "term").agg(F.sum("n").alias("n")), "kept-terms")

    sources = docs.select("lang", "source").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    sums = times.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    sources = sources.join(sums, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["n", "v", "total"])
    sources = stored(sources, "sources").withColumn("side", F.floor(F.col("idx") / SOURCES))

    # terms are dealt by a hash, each to the pairs of blocks of sources that one of its sources is in
    width = sources.groupBy("lang").agg((F.max("side") + 1).alias("sides"), F.max(F.ceil(F.col("v") / TERMS)).alias("salts")).where("salts > 0")
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda i: F.transform(F.sequence(i, F.col("sides") - 1), lambda j: F.struct(i.alias("bi"), j.alias("bj"))))))
    salt, none = F.pmod(F.xxhash64("term"), F.col("salts")), F.lit(None)
    mine = (F.col("side") == F.col("pair.bi")) | (F.col("side") == F.col("pair.bj"))
    group = ["lang", "pair.bi", "pair.bj", "salt"]
    heads = sources.join(width, "lang").withColumn("pair", pairs).where(mine).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    heads = heads.select(*group, none.cast("string").alias("term"), "idx", "n", "v", "total")
    none = none.cast("long")
    terms = times.join(sources.select("lang", "source", "idx", "side"), ["lang", "source"]).join(width, "lang").withColumn("salt", salt)
    terms = terms.withColumn("pair", pairs).where(mine).select(*group, "term", "idx", "n", none.alias("v"), none.alias("total"))
    alone = F.explode(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda i: F.struct(i.alias("bi"), i.alias("bj"))))
    whole = whole.join(width, "lang").withColumn("salt", salt).withColumn("pair", alone).select(*group, "term", none.cast("int").alias("idx"), "n", none.alias("v"), none.alias("total"))
    dealt = heads.unionByName(terms).unionByName(whole).repartition("lang", "bi", "bj", "salt").sortWithinPartitions("lang", "bi", "bj", "salt")
    side = SOURCES
    found = stored(dealt.mapInArrow(lambda b: _compared(b, top, side), "lang string, i long, j long, term string, value long"), "divergences")

    named = lambda a, b: sources.select("lang", F.col("source").alias(a), F.col("idx").alias(b))
    half = found.where("j IS NOT NULL").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", "j", "i", "value"))
    every = named("source", "i").join(named("item", "j"), "lang").where("i <> j").join(both, ["lang", "i", "j"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = every.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    term = found.where("term IS NOT NULL").join(named("source", "i"), ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pair, term = (d.withColumn("rank", F.row_number().over(order)) for d in (pair, term))
    return pair.unionByName(term.where(F.col("rank") <= top))
