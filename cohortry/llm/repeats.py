"""Long passages that repeat anywhere in a corpus, found with run-length compressed indexes.

Every string of ``length`` bytes belongs to one of its own grams, the first with the least hash, so
equal strings belong to equal grams at the same place.  The strings next to each other that belong to
one gram form a segment.  Equal segments of a gram are one row with its number of copies; grams that
occur once are done with.  What needs comparing are the different segments of one gram.

Those are dealt by their gram into bundles, and a task builds an index of its bundle: the
Burrows-Wheeler transform of the segments, compressed into runs of equal letters, and the suffix array
at the ends of the runs only.  The longest match of a position with the neighbour before it in the
suffix order is one less than that of the position before it in the text, unless it is the head of a
run; with the neighbour after it, unless it is the tail of one.  So matching statistics are streamed
over the text from the samples at the ends of the runs, and matches of ``length`` or more are marked.

A gram with more bytes of different segments than a bundle may hold is split: its strings by their
place around the gram, in halves, and each half by all the bytes that its strings have in common.  In
the end a segment is a single string, and equal ones are one row, so no group has to be held whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import slices, stored, stream_groups, text_or_empty

#: Bytes of a gram (a power of two), window starts looked at together, bytes of segments indexed together.
GRAM, STARTS, BUNDLE = 128, 1 << 20, 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64((1 << 21) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on."""
    raw = np.frombuffer(data + bytes(7), np.uint8)
    h = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()
    h, size = _mixed(h * _A), 8
    while size < gram:
        h = _mixed(h[: len(h) - size] * _A + h[size:])
        size *= 2
    return h[: len(data) - gram + 1]


def owners(data: bytes, length: int, gram: int) -> np.ndarray:
    """For each start of a string of ``length`` bytes the place of its least gram, the first of equal ones."""
    h = gram_hashes(data, gram)
    h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, n = length - gram + 1, len(data) - length + 1
    padded = np.full(-(-len(h) // width) * width, np.uint64((1 << 64) - 1))
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(onward[:n], upto[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)


def segments(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, from, gram at, to) of all segments of the texts, which are looked at a part at a time."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def look():
        data = b"".join(part for _, _, part in held)
        if len(data) < length:
            return
        ends = np.cumsum([len(part) for _, _, part in held])
        own = owners(data, length, gram)
        at = np.arange(len(own))
        part = np.searchsorted(ends, at, side="right")
        inside = at + length <= ends[part]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.zeros(len(own), bool)
        stop[:-1] = new[1:] | ~inside[1:]
        stop[-1] = True
        last = np.flatnonzero(stop & inside)
        for s, e, o, p in zip(first.tolist(), last.tolist(), own[first].tolist(), part[first].tolist()):
            text, begin, piece = held[p]
            shift = begin - (int(ends[p]) - len(piece))
            yield text, s + shift, o + shift, e + shift + length

    for i, text in enumerate(texts):
        for begin in range(0, max(len(text) - length + 1, 0), STARTS):
            part = text[begin : begin + STARTS + length - 1]
            if size + len(part) > STARTS + length and held:
                yield from look()
                held, size = [], 0
            held.append((i, begin, part))
            size += len(part)
    if held:
        yield from look()


def _name(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        for part in slices(b, column, 8 << 20):
            yield part, part.column(column).cast(pa.binary()).to_pylist()


def _found(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, key, seg, starts, size, n): the segments of each text, with the copies met together."""
    schema = pa.schema([("doc", pa.binary()), ("key", pa.int64()), ("seg", pa.int64()), ("starts", pa.list_(pa.int32())), ("lead", pa.int16()), ("size", pa.int16()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            copies = Counter(t for t in texts if len(t) >= length)
            texts = list(copies)
            names = [_name(t) for t in texts]
            rows: dict[tuple, list] = defaultdict(list)
            for i, s, o, e in segments(texts, length, gram):
                t = texts[i]
                rows[i, _signed(xxhash.xxh3_64_intdigest(t[o : o + gram])), _signed(xxhash.xxh3_64_intdigest(t[s:e])), o - s, e - s].append(s)
            if rows:
                i, key, seg, lead, size = zip(*rows)
                n = [len(starts) * copies[texts[k]] for k, starts in zip(i, rows.values())]
                columns = ([names[k] for k in i], key, seg, list(rows.values()), lead, size, n)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select("text").mapInArrow(run, "doc binary, key long, seg long, starts array<int>, lead short, size short, n long")


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffix array of segments that end in a 0 each, every 0 a letter of its own.

    ``symbols`` are 0 or byte + 1, ``left`` the letters before the next 0.  Positions are first ranked by
    seven letters; ranks of twice as many letters follow from pairs of ranks, for what is still tied.
    """
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | np.where(left >= j, wide[j : j + n], np.uint64(0))
    order = np.argsort(key, kind="stable")  # of equal keys that hold a 0 the earlier is less, so they differ
    tied_next = (key[order][1:] == key[order][:-1]) & (left[order][1:] >= 7)
    head = np.concatenate([[True], ~tied_next])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = order[~head | ~np.concatenate([head[1:], [True]])]
    step = 7
    while len(tied):
        first, second = rank[tied], rank[tied + step]
        sort = np.argsort(first * n + second)
        tied, first, second = tied[sort], first[sort], second[sort]
        at = np.arange(len(tied))
        group = np.concatenate([[True], first[1:] != first[:-1]])
        head = group | np.concatenate([[True], second[1:] != second[:-1]])
        start = np.maximum.accumulate(np.where(group, at, 0))
        rank[tied] = first + np.maximum.accumulate(np.where(head, at, 0)) - start
        tied = tied[~head | ~np.concatenate([head[1:], [True]])]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from the positions ``a`` and ``b`` on, at most ``most``; ``words`` holds eight bytes from each."""
    out = most.copy()
    live = np.flatnonzero(most > 0)
    done = 0
    while len(live):
        differ = words[a[live] + done] ^ words[b[live] + done]
        hit = differ != 0
        low = differ[hit] & (~differ[hit] + np.uint64(1))  # the lowest differing bit; words are little-endian
        out[live[hit]] = np.minimum(most[live[hit]], done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
        done += 8
        live = live[~hit]
        live = live[most[live] > done]
    return out


def longest_matches(parts: list[bytes]) -> tuple[np.ndarray, int, int]:
    """(matches, runs, letters): for each position of the joined parts the longest match elsewhere.

    A 0 follows each part and matches nothing.
    """
    size = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"\0".join(parts) + bytes(9), np.uint8)
    n = int(size.sum()) + len(parts)
    ends = np.cumsum(size + 1) - 1
    symbols = data[:n].astype(np.uint16) + 1
    symbols[ends] = 0
    left = np.repeat(ends, size + 1) - np.arange(n)
    order = suffix_order(symbols, left)
    letter = symbols[order - 1]  # the letter before; before the first position lies the last 0
    change = (letter[1:] != letter[:-1]) | (letter[1:] == 0)
    heads, tails = np.flatnonzero(change) + 1, np.flatnonzero(change)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    out = np.zeros(n, np.int64)
    at = np.arange(n)
    for ends_of_runs, neighbour, edge in ((heads, -1, order[0]), (tails, 1, order[-1])):
        a, b = order[ends_of_runs], order[ends_of_runs + neighbour]
        sampled = np.full(n, -1, np.int64)
        sampled[a] = a + common_prefix(words, a, b, np.minimum(left[a], left[b]))
        sampled[edge] = edge  # the first and the last suffix have one neighbour only
        out = np.maximum(out, np.maximum.accumulate(sampled) - at)
    return out, len(heads) + 1, n


def _spans(hit: np.ndarray, length: int) -> list[int]:
    """Covered stretches of a segment, from the starts of repeated strings: from, to, from, to, ..."""
    if not hit.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2] - 1 + length
    new = np.concatenate([[True], first[1:] > last[:-1]])
    stop = np.concatenate([new[1:], [True]])
    return np.stack([first[new], last[stop]], axis=1).ravel().tolist()


def _indexed(segs: DataFrame, length: int, bundle: int) -> DataFrame:
    """(key, seg, spans) of segments that share long strings with others of their key."""
    total = segs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, 1):
            parts = group.column("text").to_pylist()
            match, _, _ = longest_matches(parts)
            hit, at, rows = match >= length, 0, []
            for key, seg, part in zip(group.column("key").to_pylist(), group.column("seg").to_pylist(), parts):
                spans = _spans(hit[at : at + len(part)], length)
                at += len(part) + 1
                if spans:
                    rows.append((key, seg, spans))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    dealt = segs.select(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // bundle)))).alias("bundle"), "key", "seg", "text")
    return dealt.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(run, "key long, seg long, spans array<int>")


def _halves(segs: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of hot keys, each cut into those of the two halves of its range of places; the key becomes the half's common bytes."""
    schema = pa.schema([("up_key", pa.int64()), ("up_seg", pa.int64()), ("shift", pa.int32()), ("key", pa.int64()), ("seg", pa.int64()), ("lead", pa.int16()), ("low", pa.int16()), ("high", pa.int16()), ("text", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, seg, lead, low, high, text, n in zip(*[b.column(c).to_pylist() for c in ("key", "seg", "lead", "low", "high", "text", "n")]):
                # places: how far before the gram a string starts; the segment has those from lead down to this
                nearest = lead - (len(text) - length)
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    near, far = max(lo, nearest), min(hi, lead)
                    if near <= far:
                        part = text[lead - far : lead - near + length]
                        common = text[lead - lo : lead - hi + length]
                        rows.append((key, seg, lead - far, _signed(xxhash.xxh3_64_intdigest(common, seed=(key ^ lo) & ((1 << 64) - 1))), _signed(xxhash.xxh3_64_intdigest(part)), far, lo, hi, part, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return segs.select("key", "seg", "lead", "low", "high", "text", "n").mapInArrow(run, "up_key long, up_seg long, shift int, key long, seg long, lead short, low short, high short, text binary, n long")


def _marks(segs: DataFrame, length: int, gram: int, bundle: int) -> DataFrame:
    """(key, seg, spans) of different segments, of which several or many have one key."""
    weight = segs.groupBy("key").agg(F.sum(F.octet_length("text")).alias("_w"))
    hot = weight.where(F.col("_w") > bundle).select("key")
    if hot.isEmpty():
        return _indexed(segs, length, bundle)
    hot = stored(hot, "hot-grams")
    cold = _indexed(segs.join(hot, "key", "left_anti"), length, bundle)
    halves = stored(_halves(segs.join(hot, "key", "left_semi"), length, gram), "halves")
    distinct = halves.groupBy("key", "seg", "lead", "low", "high").agg(F.first("text").alias("text"), F.sum("n").alias("n"))
    distinct = stored(distinct, "distinct-halves")
    several = distinct.groupBy("key").agg(F.min("seg").alias("_a"), F.max("seg").alias("_b")).where("_a <> _b").select("key")
    copied = distinct.where("n > 1").select("key", "seg", F.array(F.lit(0), F.octet_length("text")).alias("spans"))
    deeper = stored(_marks(distinct.join(several, "key", "left_semi"), length, gram, bundle), "marks")
    below = copied.unionByName(deeper).withColumnRenamed("spans", "_s")
    up = halves.select("up_key", "up_seg", "shift", "key", "seg").join(below, ["key", "seg"])
    up = up.groupBy("up_key", "up_seg").agg(F.flatten(F.collect_list(F.transform("_s", lambda x: x + F.col("shift")))).alias("spans"))
    return cold.unionByName(up.select(F.col("up_key").alias("key"), F.col("up_seg").alias("seg"), "spans"))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows (from, to), sorted and joined where they touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([new[1:], [True]])]], axis=1)


def removed(docs: DataFrame, length: int = 400, bundle: int = BUNDLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text without its repeated passages.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in another row
    or the same; overlapping ones count.  ``kept`` holds the other bytes, which need not be UTF-8.
    Strings are judged on the input and never cross rows.  A NULL text is an empty one, and a text
    shorter than ``length`` stays whole.  Rows are documents of their own also where a doc_id is NULL or
    repeats, so equal texts of that length go whole.  Further columns are not read.  ``length`` must be
    at least twice a gram and below 16,384.  Runs jobs; stores segments, never the texts.
    """
    gram = GRAM
    while gram * 2 > length:
        gram //= 2
    if gram < 8 or length >= 1 << 14:
        raise ValueError("length must lie between 16 and 16,383")
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    found = stored(_found(docs, length, gram), "segments")
    grams = found.groupBy("key").agg(F.min("seg").alias("_a"), F.max("seg").alias("_b"), F.sum("n").alias("_n")).where("_n > 1")
    again = stored(found.join(grams.select("key", (F.col("_a") != F.col("_b")).alias("several")), "key"), "repeated-grams")

    # one row per segment, its text cut from the document of the least name
    segs = again.groupBy("key", "seg", "lead", "size", "several").agg(F.sum("n").alias("n"), F.min(F.struct("doc", F.col("starts")[0].alias("start"))).alias("at"))
    segs = stored(segs, "distinct-segments")
    wanted = segs.where("several").groupBy("at.doc").agg(F.collect_list(F.struct("key", "seg", "lead", "size", "n", "at.start")).alias("wanted"))
    distinct = _cut(docs, wanted, length, gram)
    marks = segs.where("n > 1").select("key", "seg", F.array(F.lit(0), F.col("size").cast("int")).alias("spans"))
    marks = stored(marks.unionByName(_marks(stored(distinct, "segment-texts"), length, gram, bundle)), "marks")

    hits = again.select("doc", "key", "seg", "starts").join(marks, ["key", "seg"])
    per_doc = hits.groupBy("doc").agg(F.collect_set(F.struct("starts", "spans")).alias("hits"))
    return _kept(docs, per_doc)


def _packed(docs: DataFrame, least: int, once: bool = False) -> DataFrame:
    """(doc_id, doc, packed): the name of each text, and the text as a zstd frame, smaller to shuffle.

    With ``once`` a task leaves out texts it has already met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for part, texts in _texts(batches, 1):
            names = [_name(t) for t in texts]
            rows = range(len(names))
            if once:
                rows = list({n: i for i, n in enumerate(names) if n not in seen}.values())
                seen.update(names)
            columns = part.column(0).take(pa.array(rows, pa.int64())), [names[i] for i in rows], [press.compress(texts[i]) for i in rows]
            yield pa.RecordBatch.from_arrays([columns[0], *[pa.array(c, pa.binary()) for c in columns[1:]]], ["doc_id", "doc", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.octet_length("text") >= least).mapInArrow(run, f"doc_id {kind}, doc binary, packed binary")


def _cut(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The texts of wanted segments, once each; equal texts leave a task once."""
    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("lead", pa.int16()), ("n", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                whole = unpack.decompress(b.column(0)[i].as_py())
                rows = [(w["key"], w["seg"], w["lead"], w["n"], whole[w["start"] : w["start"] + w["size"]]) for w in b.column(1)[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    cut = _packed(docs, length, once=True).join(wanted, "doc").select("packed", "wanted").mapInArrow(run, "key long, seg long, lead short, n long, text binary")
    single = cut.groupBy("key", "seg", "lead", "n").agg(F.first("text").alias("text"))
    return single.withColumns({"low": F.lit(0).cast("short"), "high": F.lit(length - gram).cast("short")})


def _kept(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i in range(b.num_rows):
                whole = unpack.decompress(b.column(1)[i].as_py())
                hits = b.column(2)[i].as_py()
                gone, keep = np.empty((0, 2), np.int64), whole
                if hits:
                    spans = [np.add.outer(np.array(h["starts"], np.int64), np.array(h["spans"], np.int64)).reshape(-1, 2) for h in hits]
                    gone = _merged(np.concatenate(spans))
                    keep = b"".join(whole[s:e] for s, e in zip([0, *gone[:, 1].tolist()], [*gone[:, 0].tolist(), len(whole)]))
                for column, value in zip(out, (len(whole), len(whole) - len(keep), len(gone), keep)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _packed(docs, 0).join(per_doc, "doc", "left").select("doc_id", "packed", "hits")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
