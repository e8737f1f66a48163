"""Shards of near-equal size from indivisible groups, best fit decreasing.

Groups, largest first, go into the shard with the tightest room that still holds them.  Where a
group goes depends on the sizes alone, so the plan is made from the histogram of group sizes and
consists of runs of groups of one size; a table of B bytes has at most sqrt(2 B) different sizes.
Rows, groups and their order stay in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import free_name, text_or_empty
from cohortry.operators.ranking import global_rank, running_totals


class _Node:
    __slots__ = ("key", "level", "left", "right")

    def __init__(self, key):
        self.key, self.level, self.left, self.right = key, 1, None, None


class Rooms:
    """A balanced (AA) tree of (room, shard)."""

    def __init__(self):
        self.root = None

    def tightest(self, need: int):
        """The least (room, shard) whose room is at least ``need``, or None."""
        node, best = self.root, None
        while node:
            if node.key >= (need, -1):
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            up = n.left
            n.left, up.right = up.right, n
            return up
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.right.right.level == n.level:
            up = n.right
            n.right, up.left = up.left, n
            up.level += 1
            return up
        return n

    def _add(self, n, key):
        if n is None:
            return _Node(key)
        if key < n.key:
            n.left = self._add(n.left, key)
        else:
            n.right = self._add(n.right, key)
        return self._split(self._skew(n))

    def _remove(self, n, key):
        if n is None:
            return None
        if key < n.key:
            n.left = self._remove(n.left, key)
        elif key > n.key:
            n.right = self._remove(n.right, key)
        elif n.left is None:
            return n.right
        else:
            least = n.left
            while least.right:
                least = least.right
            n.key = least.key
            n.left = self._remove(n.left, least.key)
        level = min(n.left.level if n.left else 0, n.right.level if n.right else 0) + 1
        if level < n.level:
            n.level = level
            if n.right and n.right.level > level:
                n.right.level = level
        n = self._skew(n)
        n.right = self._skew(n.right)
        if n.right:
            n.right.right = self._skew(n.right.right)
        n = self._split(n)
        n.right = self._split(n.right)
        return n


def fill(sizes: dict[int, int], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Runs (size, from, to, shard) and the number of shards; None if more than ``most`` are needed.

    ``sizes`` maps a size to how many groups have it; ``from`` and ``to`` number the groups of that
    size from 0.  No size may exceed ``capacity``.
    """
    tree, runs, shards = Rooms(), [], 0
    for size in sorted(sizes, reverse=True):
        at, n = 0, sizes[size]
        while at < n:
            found = tree.tightest(size)
            if found is None:
                if shards == most:
                    return None
                room, shard = capacity, shards
                shards += 1
            else:
                room, shard = found
                tree.remove(found)
            # the shard stays the tightest one until it holds no further group of this size
            k = min(n - at, room // size if size else n - at)
            runs.append((size, at, at + k, shard))
            at += k
            if room > k * size:
                tree.add((room - k * size, shard))
    return runs, shards


def plan(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, from, to, shard) over exactly the given shards with about the least capacity.

    A group larger than an equal share of what is left has a shard of its own.  The capacity of the
    others is found by doubling a step from the equal share and halving it again.
    """
    left, runs, first = dict(sizes), [], 0
    total = sum(s * k for s, k in left.items())
    while left and shards - first > 1 and max(left) * (shards - first) > total:
        size = max(left)
        taken = sizes[size] - left[size]
        runs.append((size, taken, taken + 1, first))
        first, total = first + 1, total - size
        left[size] -= 1
        if not left[size]:
            del left[size]
    if not left:
        return runs
    count = shards - first
    low, step = max(-(-total // count), max(left)) - 1, 1
    while (done := fill(left, low + step, count)) is None:
        step *= 2
    high, low = low + step, low + step // 2
    while high - low > max(1, high // 20_000):
        middle = (low + high) // 2
        better = fill(left, middle, count)
        if better is None:
            low = middle
        else:
            high, done = middle, better
    for size, a, b, shard in done[0]:
        taken = sizes[size] - left[size]
        runs.append((size, a + taken, b + taken, first + shard))
    return runs


def assign(docs: DataFrame, shards: int, keys: Sequence[str] = ("doc_id",), text: str = "text", overhead: int = 8) -> DataFrame:
    """(keys, size, text_crc32, shard, slot): every row with its shard and its place in it.

    ``size`` is the UTF-8 length of the text (NULL: none) plus ``overhead``.  Rows with equal texts
    are one group and share a shard, NULL with the empty text; so a group larger than an equal share
    makes its shard larger than the others.  ``slot`` counts from 0 in the order of the keys (NULL
    first), then of the text's checksum; repeated rows have a slot each.  Other columns are ignored.
    An empty table gives an empty result.

    Runs jobs: two global sorts of narrow rows and the histogram of group sizes.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = docs.select(*keys, text_or_empty(text).alias("_text")).select(
        *keys, (F.octet_length("_text") + overhead).cast("long").alias("size"), F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"), F.unhex(F.md5("_text")).alias("_group")
    )
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    ranked = global_rank(groups, [F.col("_bytes").desc(), "_group"], "_place").rows
    sizes = {r["_bytes"]: (r["k"], r["first"]) for r in ranked.groupBy("_bytes").agg(F.count("*").alias("k"), F.min("_place").alias("first")).collect()}
    runs = [(s, sizes[s][1] + a, sizes[s][1] + b, shard) for s, a, b, shard in plan({s: k for s, (k, _) in sizes.items()}, shards)]
    table = docs.sparkSession.createDataFrame(runs, "_bytes long, _from long, _to long, shard int")
    where = ranked.join(table, "_bytes").where("_place >= _from AND _place < _to").select("_group", "shard")
    placed = rows.join(where, "_group").drop("_group").withColumn("_one", F.lit(1).cast("long"))
    out = running_totals(placed, [*keys, "text_crc32"], {"slot": "_one"}, groups=["shard"])
    return out.select(*keys, "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, folder: str, key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write the documents as Parquet, one folder per shard and files of ``rows_per_file`` slots.

    ``key`` must be unique.  A shard is written by as many tasks as it has files.
    """
    part = free_name(docs, "part")
    where = assigned.select(key, "shard", "slot", F.expr(f"slot div {rows_per_file}").alias(part))
    joined = docs.join(where, key)
    joined.repartition("shard", part).sortWithinPartitions("shard", "slot").drop(part).write.partitionBy("shard").parquet(folder)
