"""Trees stored as (node, parent, level) rows, and the code crosswalks built from them.

Column names: ``node_id``, ``parent_id`` (0 for a root), ``level``, ``is_leaf``; code map:
``code``, ``node_id``, ``common_use``, ``default_use``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.session import materialize


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent_id") == 0)


def children(nodes: DataFrame, parent_ids: Iterable[int]) -> DataFrame:
    return nodes.where(F.col("parent_id").isin(list(parent_ids)))


def parent_child(nodes: DataFrame) -> DataFrame:
    """Every node with its parent's name and level."""
    parent = nodes.select(F.col("node_id").alias("parent_id"), F.col("node_name").alias("parent_name"), F.col("level").alias("parent_level"))
    return nodes.join(parent, "parent_id")


def descendants(nodes: DataFrame, root_ids: Iterable[int]) -> DataFrame:
    """All nodes below the given ones, which are left out themselves (runs two actions a round).

    A step goes exactly one level down.  A node below two of the given nodes appears once for each,
    and so does one that is reached over two rows; rows without a parent or level are below nothing.
    Every round doubles the length of the steps, so a tree of depth d takes about log2(d) rounds; only
    (node, level) pairs are stored in between, and whole rows are joined once at the end.
    """
    level, root_ids = F.col("level").cast("bigint"), list(root_ids)
    found = nodes.where(F.col("node_id").isin(root_ids)).select(F.col("node_id").alias("_id"), level.alias("_level"))
    steps = nodes.select(F.col("node_id").alias("_id"), level.alias("_level"), F.col("parent_id").alias("_up"), (level - 1).alias("_up_level"))
    while True:
        above = found.select(F.col("_id").alias("_up"), F.col("_level").alias("_up_level"))
        found = materialize(found.unionByName(steps.join(above, ["_up", "_up_level"]).select("_id", "_level")))
        first = steps.select("_id", "_level", F.col("_up").alias("_mid"), F.col("_up_level").alias("_mid_level"))
        then = steps.select(F.col("_id").alias("_mid"), F.col("_level").alias("_mid_level"), "_up", "_up_level")
        steps = materialize(first.join(then, ["_mid", "_mid_level"]).drop("_mid", "_mid_level"))
        if steps.isEmpty():
            break
    above = found.select(F.col("_id").alias("_up"), F.col("_level").alias("_up_level"))
    return nodes.join(above, (F.col("parent_id") == F.col("_up")) & (level == F.col("_up_level") + 1)).select(*nodes.columns)


def preferred_codes(codes: DataFrame) -> DataFrame:
    """Codes whose node is their common and default use."""
    return codes.where((F.col("common_use") == 1) & (F.col("default_use") == 1)).select("code", "node_id")


def codes_per_class(nodes: DataFrame, codes: DataFrame, root_ids: Iterable[int]) -> DataFrame:
    """Number of codes of each class below the roots; classes without a code are left out."""
    below = descendants(nodes, root_ids)
    counts = preferred_codes(codes).groupBy("node_id").agg(F.count("code").alias("n_codes"))
    return below.join(counts, "node_id")


def build_crosswalk(nodes: DataFrame, codes: DataFrame, root_ids: Iterable[int], not_parents: Iterable[int] = (), not_nodes: Iterable[int] = ()) -> DataFrame:
    """Distinct (node, code) pairs below the roots, without excluded branches and leaves."""
    below = descendants(nodes, root_ids)
    not_parents, not_nodes = list(not_parents), list(not_nodes)
    if not_parents:
        below = below.where(~F.col("parent_id").isin(not_parents))
    if not_nodes:
        below = below.where(~F.col("node_id").isin(not_nodes))
    below = below.select("node_id", "node_name").distinct()
    return preferred_codes(codes).join(below, "node_id").select("node_id", "node_name", "code").distinct()


def leaf_codes(nodes: DataFrame, codes: DataFrame) -> DataFrame:
    """Leaves of the tree with their preferred codes."""
    leaves = nodes.where(F.col("is_leaf") == 1)
    return preferred_codes(codes).join(leaves, "node_id")


def coverage(used: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Distinct codes used, distinct codes known, and used codes nobody knows."""
    seen = used.select(code).distinct()
    known = codes.select(code).distinct()
    missing = seen.join(known, code, "left_anti")
    return seen.agg(F.count(code).alias("n_used")).withColumns(
        {"n_known": known.agg(F.count(code)).scalar(), "n_unmapped": missing.agg(F.count(code)).scalar()}
    )
