"""Pairs within groups of any size, met block by block inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stream_groups


def block_pairs(members: DataFrame, key: str, node: str, limit: int, weight: Column | None = None) -> DataFrame:
    """``members`` of groups of two or more, once for each pair of blocks (_i <= _j) that holds their block _b.

    A group whose weights add up to more than ``limit`` is dealt into blocks by a hash of the node.
    A member of a group of b blocks leaves b times; no pair of members is ever a row.
    """
    own = F.lit(1) if weight is None else weight
    sizes = members.groupBy(key).agg(F.count("*").alias("_n"), F.sum(own).alias("_w")).where("_n > 1")
    blocks = F.when(F.col("_w") > limit, F.ceil(2 * F.col("_w") / limit)).otherwise(F.lit(1)).cast("int")
    dealt = members.join(sizes.select(key, blocks.alias("_blocks")), key)
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_o", "_blocks")


def per_block_pair(dealt: DataFrame, key: str, columns: list[str], find: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``find(members, allowed)`` to each pair of blocks; ``allowed`` says in which block a member is.

    Members of one block are compared among themselves only where _i = _j, members of different
    blocks where _i < _j: each pair of a group is met once.  Where _i < _j and no member was dealt to
    one of the two blocks there is nothing to compare, and ``find`` is not called.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, 3):
            block = group.column("_b").to_numpy()
            one = group.column("_i")[0].as_py() == group.column("_j")[0].as_py()
            if group.num_rows > 1 and (one or block.min() < block.max()):
                out = find(group, block)
                if out is not None and out.num_rows:
                    yield out

    sorted_ = dealt.select(key, "_i", "_j", "_b", *columns).repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")
    return sorted_.mapInArrow(run, schema)


def comparable(block: np.ndarray) -> np.ndarray:
    """Which members of a pair of blocks are compared: all with all in one block, else only across.

    ``per_block_pair`` sees to it that two blocks both have members.
    """
    if block.min() == block.max():
        out = np.ones((len(block), len(block)), bool)
        np.fill_diagonal(out, False)
        return out
    return block[:, None] != block[None, :]


def roots(linked: np.ndarray) -> np.ndarray:
    """For each member the least member that links lead to."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_and_roots(nodes: list[bytes], copies: np.ndarray, linked: np.ndarray) -> pa.RecordBatch | None:
    """Rows (node, other, links): per linked member the copies it is linked with, and the root it is joined to."""
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return None
    root = roots(linked)
    counts = linked[some].astype(np.int64) @ copies
    return pa.RecordBatch.from_arrays(
        [pa.array([nodes[i] for i in some], pa.binary()), pa.array([nodes[root[i]] for i in some], pa.binary()), pa.array(counts, pa.int64())], ["node", "other", "links"]
    )


LINKS = "node binary, other binary, links long"
