"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by random signs and fast Hadamard transforms, three times; its hash is the axis
it is closest to, with the sign.  A table joins several such hashes to one key; a vector also enters
the keys in which one hash is replaced by the second closest axis.  Vectors that meet under a key are
compared exactly; what is linked forms components, and inside a component all pairs are compared, so
that no count depends on where two vectors met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.blocks import LINKS, block_pairs, comparable, links_and_roots, per_block_pair, roots
from cohortry.llm.common import stored
from cohortry.llm.components import components

TABLES, JOINED, ROUNDS = 16, 3, 3
#: Members of a block; a block pair is one matrix product of at most twice as many rows.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width must be a power of two."""
    n, w = x.shape
    h = 1
    while h < w:
        x = x.reshape(n, w // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, w)
        h *= 2
    return x / np.sqrt(w)


def keys(x: np.ndarray, tables: int = TABLES, joined: int = JOINED, seed: int = 11) -> np.ndarray:
    """(n, tables * (1 + joined)) keys of unit vectors: per table the own one, then the probes."""
    n, d = x.shape
    width = 1 << max(0, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, d])
    out = []
    for table in range(tables):
        first, second = [], []
        for _ in range(joined):
            y = padded
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            best = size.argmax(axis=1)
            rows = np.arange(n)
            sign = y[rows, best] < 0
            size[rows, best] = -1
            next_ = size.argmax(axis=1)
            first.append(2 * best + sign)
            second.append(2 * next_ + (y[rows, next_] < 0))
        for probe in range(-1, joined):
            key = np.full(n, (d << 16) + table, np.uint64)
            for j in range(joined):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + (second if j == probe else first)[j].astype(np.uint64) + np.uint64(1))
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _hashed(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, unit, keys): node is a digest of the components; the last three are NULL where nothing may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                n = b.num_rows
                node, unit, key = [None] * n, [None] * n, [None] * n
                by_width: dict[int, list] = {}
                for i, v in enumerate(b.column(1).to_pylist()):
                    if v and None not in v:
                        by_width.setdefault(len(v), []).append((i, v))
                for rows in by_width.values():
                    x = np.array([v for _, v in rows], np.float64) + 0.0
                    with np.errstate(all="ignore"):
                        top = np.abs(x).max(axis=1)
                        ok = np.isfinite(top) & (top > 0)
                        scaled = x[ok] / top[ok, None]
                    where = [i for (i, _), k in zip(rows, ok) if k]
                    if not where:
                        continue
                    u = scaled / np.linalg.norm(scaled, axis=1)[:, None]
                    for i, raw, one, k in zip(where, x[ok], u, keys(u).tolist()):
                        node[i], unit[i], key[i] = hashlib.blake2b(raw.tobytes(), digest_size=16).digest(), one.tobytes(), sorted(set(k))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.binary()), pa.array(unit, pa.binary()), pa.array(key, pa.list_(pa.int64()))], ["vec_id", "node", "unit", "keys"])

    return vectors.mapInArrow(run, "vec_id long, node binary, unit binary, keys array<long>")


def _cosines(group: pa.Table, block: np.ndarray, threshold: float) -> tuple[list[bytes], np.ndarray]:
    """The nodes of a pair of blocks and which of them are linked."""
    nodes = group.column("node").to_pylist()
    x = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(nodes), -1)
    return nodes, (x @ x.T >= threshold) & comparable(block)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two vectors are linked if their cosine, in double precision, is at least ``threshold`` and they
    were found; ``n_links`` counts the other rows a row is linked with, ``component_id`` is the least
    vec_id reachable by links.  Vectors that are NULL, empty, zero, or hold NULL or non-finite
    components link with nothing, nor do vectors of different widths.  Equal vectors are compared once
    and stand for all their rows; rows that repeat a vec_id count as rows of their own.  A NULL vec_id
    is never a component's id unless it is alone in it.
    """
    rows = stored(_hashed(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))), "vectors")
    copies = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    single = rows.where("node is not null").select("node", "unit", "keys").groupBy("node").agg(F.first("unit").alias("unit"), F.first("keys").alias("keys"))
    single = stored(single, "distinct-vectors")

    met = single.select(F.explode("keys").alias("key"), "node")
    dealt = block_pairs(met, "key", "node", BLOCK).select("key", "node", "_b", "_i", "_j").join(single.select("node", "unit"), "node")

    def meet(group: pa.Table, block: np.ndarray) -> pa.RecordBatch | None:
        nodes, linked = _cosines(group, block, threshold)
        root = roots(linked)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in moved], pa.binary()), pa.array([nodes[root[i]] for i in moved], pa.binary())], ["node", "other"])

    edges = per_block_pair(dealt, "key", ["node", "unit"], meet, "node binary, other binary").distinct()
    groups = components(edges, "node", "other")

    members = groups.join(single.select("node", "unit"), "node").join(copies, "node")

    def count(group: pa.Table, block: np.ndarray) -> pa.RecordBatch | None:
        nodes, linked = _cosines(group, block, threshold)
        return links_and_roots(nodes, group.column("copies").to_numpy(), linked)

    found = per_block_pair(block_pairs(members, "component", "node", BLOCK), "component", ["node", "unit", "copies"], count, LINKS)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    least = groups.join(copies, "node").groupBy("component").agg(F.min("first").alias("least"))
    of_node = copies.join(links, "node", "left").join(groups.join(least, "component").select("node", "least"), "node", "left")
    of_node = of_node.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    out = rows.select("vec_id", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
