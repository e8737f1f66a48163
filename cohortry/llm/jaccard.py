"""Documents whose sets of word shingles overlap: a MinHash LSH forest with exact verification.

A signature is a number of min-hashes per tree; each tree is a trie over the sorted paths they form.
Two documents are candidates in a tree if their paths share a prefix.  A shorter prefix finds more,
at the price of more comparisons: from the full path upwards the prefix is shortened until a pair at
the threshold is found in some tree with the probability asked for.  Documents that share a longer
prefix share the shorter one too, so only the prefix at which that ends has to be looked up.

Candidates form groups; inside a group, in blocks, the candidates' shingle sets are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.blocks import LINKS, block_pairs, comparable, links_and_roots, per_block_pair
from cohortry.llm.common import WHITE, free_name, slices, stored, text_or_empty
from cohortry.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Shingles in a block of a group, and how many a short document counts for.
BLOCK_SHINGLES, LEAST_SHINGLES = 1_500_000, 1_500

_M = 0xFFFFFFFFFFFFFFFF
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_LONG = 24


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened step by step from ``depth``, that finds a pair at the threshold with the given probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles and the row of each, row by row.

    A shingle is five words in a row; a text of one to four words has one shingle of all of them, one
    without words has none.  Words are runs of other than white space.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    white = _IS_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    opens = np.flatnonzero(~white & (np.r_[True, white[:-1]] | edge[:-1]))
    closes = np.flatnonzero(~white & (np.r_[white[1:], True] | edge[1:])) + 1
    if not len(opens):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = closes - opens
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.flatnonzero(size <= _LONG)
    for k in range(_LONG):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = h[live] * np.uint64(0x100000001B3) + data[opens[live] + k] + np.uint64(1)
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[opens[i] : closes[i]].tobytes(), digest_size=8).digest(), "little")
    h = _mixed(h)
    row = np.searchsorted(bounds, opens, side="right") - 1
    per_row = np.bincount(row, minlength=len(texts))
    factor = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 3)) & _M | 1) for k in range(WORDS)]
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= WORDS:
        last = len(h) - WORDS + 1
        whole = row[:last] == row[WORDS - 1 :]
        s = np.zeros(last, np.uint64)
        for k in range(WORDS):
            s += h[k : k + last] * factor[k]
        out, rows = _mixed(s[whole]), row[:last][whole]
    few = np.flatnonzero((per_row > 0) & (per_row < WORDS))
    if len(few):
        first = np.searchsorted(row, few)
        s = per_row[few].astype(np.uint64)
        for k in range(WORDS - 1):
            more = per_row[few] > k
            s[more] += h[first[more] + k] * factor[k]
        out, rows = np.r_[out, _mixed(s)], np.r_[rows, few]
        by = np.argsort(rows, kind="stable")
        out, rows = out[by], rows[by]
    return out, rows


def _paths(values: np.ndarray, rows: np.ndarray, n: int, depth: int, trees: int = TREES) -> list:
    """Per row the keys of its path prefixes, one per tree; None for a row without shingles."""
    out: list = [None] * n
    if not len(values):
        return out
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    rng = np.random.default_rng(5)
    a = rng.integers(1 << 31, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    key = np.zeros((len(first), trees), np.uint64)
    for t in range(trees):
        path = np.full(len(first), t + 1, np.uint64)
        for d in range(depth):
            least = np.minimum.reduceat(x * a[t * depth + d] + b[t * depth + d], first)
            path = _mixed(path * np.uint64(0x9E3779B97F4A7C15) + least)
        key[:, t] = path
    for i, k in zip(rows[first].tolist(), key.view(np.int64).tolist()):
        out[i] = k
    return out


def _signed(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, node, keys, weight) per row of (doc_id, node, text); node is a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                n = part.num_rows
                values, rows = shingles(part.column(2))
                weight = np.bincount(rows, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(_paths(values, rows, n, depth), pa.list_(pa.int64())), pa.array(weight)], ["doc_id", "node", "keys", "weight"]
                )

    return docs.mapInArrow(run, "doc_id long, node binary, keys array<long>, weight long")


def _linked(texts: pa.Array, keys: np.ndarray, allowed: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the texts share a path prefix and have a Jaccard similarity of at least the threshold."""
    n = len(texts)
    candidate = np.zeros((n, n), bool)
    for t in range(keys.shape[1]):
        candidate |= keys[:, t][:, None] == keys[:, t][None, :]
    candidate &= allowed
    values, rows = shingles(texts)
    by = np.lexsort((values, rows))
    values, rows = values[by], rows[by]
    fresh = np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])] if len(values) else np.zeros(0, bool)
    values, rows = values[fresh], rows[fresh]
    size = np.bincount(rows, minlength=n)
    # |A| / |B| bounds the similarity
    candidate &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
    a, b = np.nonzero(np.triu(candidate))
    out = np.zeros((n, n), bool)
    if not len(a):
        return out
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    width = int((often > 1).sum())
    if len(a) * 4e-5 < n * n * width * 1e-10:
        ends = np.cumsum(size)
        sets = [values[e - s : e] for e, s in zip(ends.tolist(), size.tolist())]
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())])
    else:
        place = (np.cumsum(often > 1) - 1)[column[shared]]
        own = rows[shared]
        total = np.zeros((n, n), np.float32)
        by = np.argsort(place, kind="stable")
        place, own = place[by], own[by]
        for at in range(0, width, 8192):
            s, e = np.searchsorted(place, [at, at + 8192])
            x = np.zeros((n, min(8192, width - at)), np.float32)
            x[own[s:e], place[s:e] - at] = 1
            total += x @ x.T
        common = np.rint(total[a, b]).astype(np.int64)
    union = size[a] + size[b] - common
    good = common * 10_000 >= round(threshold * 10_000) * union
    out[a[good], b[good]] = True
    return out | out.T


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, class_id, n_links, kept) per row: the links of a document and its class.

    Two rows are linked if their texts are equal, or the Jaccard similarity of their sets of shingles
    is at least ``threshold`` and the forest has found them (at the threshold with the probability
    ``recall``, more surely above).  ``n_links`` counts the linked rows; ``class_id`` is the least
    doc_id reachable by links (NULL if none has an id), and ``kept`` tells whether the row has that
    doc_id and, of texts with it, the one chosen.  Texts without a word are linked only with equal
    ones.  Rows that repeat doc_id and text are rows of their own and kept alike; ``node`` is a digest
    of the text.

    Equal texts are compared once.  No pair is a row anywhere: a group of near copies is compared in
    blocks inside tasks, of which only counts and one edge per document leave.
    """
    depth = prefix_length(threshold, recall=recall)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.md5(text_or_empty(text))).alias("node"), text_or_empty(text).alias("text"))
    rows = stored(_signed(narrow, depth), "signatures")
    texts = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    paths = rows.where("keys is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("weight").alias("weight"))
    paths = stored(paths, "distinct-texts")

    met = paths.select(F.explode("keys").alias("path"), "node")
    least = met.groupBy("path").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1")
    groups = components(met.join(least, "path").where("node != least").select("node", "least").distinct(), "node", "least")

    members = groups.join(paths, "node")
    weight = F.greatest(F.col("weight"), F.lit(LEAST_SHINGLES))
    spelt = members.join(narrow.withColumnRenamed("doc_id", "_id"), "node").where(F.col("_id").eqNullSafe(F.col("first")))
    dealt = block_pairs(spelt, "component", "node", BLOCK_SHINGLES, weight)

    def find(group: pa.Table, block: np.ndarray) -> pa.RecordBatch | None:
        group = group.combine_chunks()
        nodes = group.column("node").to_pylist()
        one = {v: i for i, v in reversed(list(enumerate(nodes)))}  # a text may come from several rows with one id
        keep = sorted(one.values())
        if len(keep) < len(nodes):
            group, nodes, block = group.take(keep).combine_chunks(), [nodes[i] for i in keep], block[keep]
        keys = np.array(group.column("keys").to_pylist(), np.int64)
        linked = _linked(group.column("text").chunk(0), keys, comparable(block), threshold)
        return links_and_roots(nodes, group.column("copies").to_numpy(), linked)

    found = stored(per_block_pair(dealt, "component", ["node", "copies", "keys", "text"], find, LINKS), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select("node", "other"), "node", "other")
    chosen = classes.join(texts, "node").groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("c"))
    of_node = texts.join(links, "node", "left").join(classes.join(chosen, "component").select("node", "c"), "node", "left")
    own = F.struct(F.col("first").isNull(), "first", "node")
    of_node = of_node.select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("c", own)["first"].alias("class_id"), F.coalesce("c", own)["node"].alias("_keeper")
    )
    out = rows.select("doc_id", "node").join(of_node, "node")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("_keeper"))
    return out.select("doc_id", "node", "class_id", "n_links", kept.alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, with the columns they came with."""
    rows = stored(join(docs, threshold, key=key, text=text).where("kept").groupBy("doc_id", "node").agg(F.count("*").alias("k")), "kept")
    node, id_ = free_name(docs, "_node"), free_name(docs, "_id")
    mine = docs.withColumns({node: F.unhex(F.md5(text_or_empty(text))), id_: F.col(key).cast("long")})

    def of(which: DataFrame) -> DataFrame:
        right = which.select(F.col("doc_id").alias("_k_id"), F.col("node").alias("_k_node"))
        return mine.join(right, (F.col(node) == F.col("_k_node")) & F.col(id_).eqNullSafe(F.col("_k_id")), "left_semi")

    once, again = of(rows.where("k = 1")), of(rows.where("k > 1"))
    if not rows.where("k > 1").isEmpty():  # rows that repeat id and text: one of them
        once = once.unionByName(again.dropDuplicates([node, id_]))
    return once.drop(node, id_)
