"""Exact nearest neighbours in blocks, and the resampling built on them.

Points are put in order of (nearest pivot, distance to it) and cut into blocks of bounded
size, so neighbours tend to share a block and no block grows with the data's skew.  For each
block, the blocks that can hold one of its k neighbours follow from centre and radius by the
triangle inequality; only those block pairs are compared, strip by strip of blocks, and only
k rows per point and strip leave a task.  The result is exact; where the data has no structure
to prune by, all block pairs are compared, by a matrix product that leaves few pairs to look at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import row_hash, unit_hash
from cohortry.operators.ranking import global_rank, rank_within
from cohortry.session import materialize

MAX_BLOCKS = 20_000  # keeps the table of block centres to a few MB per 100 dimensions
STRIP_BYTES = 32 << 20  # points of a strip, of which a task holds two


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # plain differences: copies get exactly 0, which the expanded form does not give
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def _nearest_pivot(pivots: np.ndarray):
    def assign(frames):
        for f in frames:
            x = np.stack(f["features"].to_numpy()) if len(f) else np.zeros((0, pivots.shape[1]))
            cell, dist = np.zeros(len(f), dtype="int32"), np.zeros(len(f))
            for i in range(0, len(f), 512):
                d = _square_distances(x[i : i + 512], pivots)
                cell[i : i + 512], dist[i : i + 512] = d.argmin(axis=1), np.sqrt(d.min(axis=1))
            yield f.assign(cell=cell, to_pivot=dist)

    return assign


def _block_shape(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per block: its shape, and ids and points packed (a NULL id is marked and sorts last)."""
    x = np.stack(pdf["features"].to_numpy())
    centre = x.mean(axis=0)
    ids = np.where(pdf["no_id"], np.iinfo(np.int64).max, pdf["id"]).astype(np.int64)
    return pd.DataFrame({
        "block": [int(pdf["block"].iloc[0])], "n": [len(x)], "centre": [centre.tolist()],
        "radius": [float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))], "grp": [pdf["grp"].iloc[0]],
        "ids": [ids.tobytes()], "no_ids": [pdf["no_id"].to_numpy(dtype=bool).tobytes()], "points": [x.tobytes()],
    })


def _pruner(shapes: list, k: int):
    """For a block's place in ``shapes``, which blocks can hold one of the k nearest of its points."""
    n = np.array([s["n"] for s in shapes])
    centre = np.array([s["centre"] for s in shapes])
    radius = np.array([s["radius"] for s in shapes])
    group = np.array([s["grp"] for s in shapes])

    def hit(i: int) -> np.ndarray:
        gap = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
        own = group == group[i]
        far = np.where(own, gap + radius + radius[i], np.inf)
        order = far.argsort()
        enough = np.searchsorted(np.cumsum(n[order]), k + 1)  # the point itself counts once
        bound = far[order[min(enough, len(order) - 1)]]
        return own & (gap - radius - radius[i] <= bound * (1 + 1e-9) + 1e-9)

    return hit


def _block_pairs(shapes: list, k: int):
    block = np.array([s["block"] for s in shapes])
    hit = _pruner(shapes, k)

    def prune(frames):
        for f in frames:
            for i in f["i"]:
                some = hit(i)
                yield pd.DataFrame({"query_block": np.full(some.sum(), block[i]), "data_block": block[some]})

    return prune


class _Nearest:
    """The k nearest found so far of some points, among blocks of data shown one by one.

    A matrix product gives all squared distances up to a known error; only pairs that may be among
    the k nearest are then computed as plain differences, so results are exact.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, no_ids: np.ndarray, k: int):
        self.x, self.ids, self.no_ids, self.k = x, ids, no_ids, k
        self.dist = np.full((len(x), k), np.inf)  # squared
        self.near = np.full((len(x), k), np.iinfo(np.int64).max)
        self.no_near = np.zeros((len(x), k), bool)

    def _rough(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Squared distances, and a bound of their error."""
        shift = y.mean(axis=0)
        a, b = self.x - shift, y - shift
        aa, bb = (a**2).sum(axis=1), (b**2).sum(axis=1)
        scale = (np.sqrt(aa.max()) + np.sqrt(bb.max())) ** 2
        error = lambda kind: 4 * (a.shape[1] + 8) * float(np.finfo(kind).eps) * scale
        reach = np.median(self.dist[:, -1])
        # 32 bits are faster; they serve where their error is small beside the distances looked for
        kind = np.float32 if 1e-20 < scale < 1e20 and reach < np.inf and error(np.float32) <= 1e-3 * reach else np.float64
        one = lambda n: np.ones((n, 1))
        left = np.hstack([-2 * a, aa[:, None], one(len(a))]).astype(kind)
        right = np.hstack([b, one(len(b)), bb[:, None]]).astype(kind)
        return left @ right.T, error(kind) + np.finfo(np.float64).tiny

    def show(self, y: np.ndarray, ids: np.ndarray, no_ids: np.ndarray) -> None:
        rough, error = self._rough(y)
        bound = self.dist[:, -1]
        if np.isinf(bound).any():
            same = (self.ids[:, None] == ids[None, :]) & ~self.no_ids[:, None] & ~no_ids[None, :]
            rough[same] = np.inf  # not its own neighbour
            rough[np.isnan(rough)] = np.inf
            if len(y) >= self.k:
                bound = np.minimum(bound, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1].astype(float) + error)
        limit = np.nextafter((bound + error).astype(rough.dtype), np.inf, dtype=rough.dtype)
        row, col = np.divmod(np.flatnonzero(rough <= limit[:, None]), len(y))
        # where k copies are known already, another one only counts if its id is smaller
        open_ = (self.dist[row, -1] > 0) | (ids[col] < self.near[row, -1])
        row, col = row[open_], col[open_]
        other = (self.ids[row] != ids[col]) | self.no_ids[row] | no_ids[col]
        row, col = row[other], col[other]
        d, step = np.empty(len(row)), max(1, 4_000_000 // max(1, y.shape[1]))
        for i in range(0, len(row), step):
            d[i : i + step] = ((self.x[row[i : i + step]] - y[col[i : i + step]]) ** 2).sum(axis=1)
        some = d <= self.dist[row, -1]
        some &= np.isfinite(d)
        self._merge(row[some], d[some], ids[col[some]], no_ids[col[some]])

    def _merge(self, row: np.ndarray, d: np.ndarray, ids: np.ndarray, no_ids: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        old = np.repeat(touched, self.k)
        row, d = np.r_[old, row], np.r_[self.dist[touched].ravel(), d]
        ids, no_ids = np.r_[self.near[touched].ravel(), ids], np.r_[self.no_near[touched].ravel(), no_ids]
        by = np.lexsort((no_ids, ids, d, row))
        row = row[by]
        pos = np.arange(len(row)) - np.searchsorted(row, row)
        by, row, pos = by[pos < self.k], row[pos < self.k], pos[pos < self.k]
        self.dist[row, pos], self.near[row, pos], self.no_near[row, pos] = d[by], ids[by], no_ids[by]

    def found(self) -> pd.DataFrame:
        row, pos = np.nonzero(np.isfinite(self.dist))
        named = lambda ids, none: pd.array(ids, dtype="Int64") if not none.any() else pd.arrays.IntegerArray(ids, none)
        return pd.DataFrame({
            "id": named(self.ids[row], self.no_ids[row]), "neighbour": named(self.near[row, pos], self.no_near[row, pos]),
            "distance": np.sqrt(self.dist[row, pos]),
        })


def _unpacked(packed: pd.DataFrame, side: str) -> dict:
    """Points, ids and marks of NULL ids of each block."""
    return {
        int(b): (np.frombuffer(x).reshape(n, -1), np.frombuffer(i, np.int64), np.frombuffer(z, bool))
        for b, n, x, i, z in zip(*(packed[f"{side}_{c}"] for c in ("block", "n", "points", "ids", "no_ids")))
    }


def _top_k(shapes: list, k: int, rows: int = 512):
    """Compare a strip of query blocks with a strip of data blocks, where ``shapes`` do not rule it out."""
    place = {s["block"]: i for i, s in enumerate(shapes)}
    hit = _pruner(shapes, k)

    def compare(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        data, out = _unpacked(data, "data"), []
        for block, (x, ids, no_ids) in _unpacked(queries, "query").items():
            some = hit(place[block])
            # its own block first; then in order, so copies come by id
            meets = sorted((b for b in data if some[place[b]]), key=lambda b: (b != block, b))
            for i in range(0, len(x), rows):
                best = _Nearest(x[i : i + rows], ids[i : i + rows], no_ids[i : i + rows], k)
                for b in meets:
                    best.show(*data[b])
                out.append(best.found())
        return pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "distance": []}).astype({"id": "int64", "neighbour": "int64"})

    return compare


def knn(points: DataFrame, k: int, block: int = 2048, seed: int = 42, group: str | None = None) -> DataFrame:
    """The k nearest other points of each point: (id, neighbour, distance, pos 1..k).

    ``points``: ``id`` (bigint, unique) and ``features`` (array of doubles).  With ``group``
    (a column of few values) neighbours come from the point's own group.  Ties go to the
    smaller id.  Runs actions.
    """
    grp = F.col(group).cast("string") if group else F.lit("")
    points = materialize(points.select(
        F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features"), grp.alias("grp")))
    spark = points.sparkSession
    n = points.count()
    if n < 2:
        return spark.createDataFrame([], "id bigint, neighbour bigint, distance double, pos int")
    block = max(block, -(-n // MAX_BLOCKS))
    n_pivots = min(256, max(1, n // block))
    pivots = points.orderBy(row_hash("id", seed=seed), "id").limit(n_pivots).collect()
    assign = _nearest_pivot(np.array([r["features"] for r in pivots]))
    placed = points.mapInPandas(assign, "id bigint, features array<double>, grp string, cell int, to_pivot double")
    ranked = global_rank(placed, ["grp", "cell", "to_pivot", "id"], "_rank").rows
    ranked = ranked.join(ranked.groupBy("grp").agg(F.min("_rank").alias("_first")), "grp")
    # blocks of a group are numbered from its first rank on, so numbers of two groups never meet
    number = F.col("_first") + F.floor((F.col("_rank") - F.col("_first")) / block)
    no_id = F.col("id").isNull()
    blocks = ranked.select(number.cast("bigint").alias("block"), "grp", F.coalesce("id", F.lit(0)).alias("id"), no_id.alias("no_id"), "features")
    shape = "block bigint, n bigint, centre array<double>, radius double, grp string, ids binary, no_ids binary, points binary"
    packed = materialize(blocks.groupBy("block").applyInPandas(_block_shape, shape))
    shapes = packed.select("block", "n", "centre", "radius", "grp").orderBy("block").collect()
    # blocks next to each other make a strip, so that a block travels once per strip and not once per block
    width = max(1, STRIP_BYTES // max(1, 8 * block * len(shapes[0]["centre"])))
    strips = math.ceil(4 * math.sqrt(spark.sparkContext.defaultParallelism))
    width = min(width, -(-len(shapes) // strips))
    strip_of = spark.createDataFrame([(s["block"], i // width) for i, s in enumerate(shapes)], "block bigint, strip int")
    pairs = spark.range(len(shapes)).select(F.col("id").alias("i")).mapInPandas(_block_pairs(shapes, k), "query_block bigint, data_block bigint")
    sides = [strip_of.select(F.col("block").alias(f"{s}_block"), F.col("strip").alias(f"{s}_strip")) for s in ("query", "data")]
    pairs = materialize(pairs.join(sides[0], "query_block").join(sides[1], "data_block"))  # read twice below
    content = ["block", "n", "ids", "no_ids", "points"]
    queries, data = (
        pairs.select(F.col("query_strip").alias(f"{s}_i"), F.col("data_strip").alias(f"{s}_j"), F.col(f"{s}_block")).distinct()
        .join(packed.select(*[F.col(c).alias(f"{s}_{c}") for c in content]), f"{s}_block")
        for s in ("query", "data"))
    near = (
        queries.groupBy("query_i", "query_j").cogroup(data.groupBy("data_i", "data_j"))
        .applyInPandas(_top_k(shapes, k), "id bigint, neighbour bigint, distance double")
    )
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return near.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def tomek_links(df: DataFrame, label: str = "label", block: int = 2048) -> DataFrame:
    """Pairs of mutually nearest points of different classes: (a, b, distance), a < b."""
    nearest = materialize(knn(df, 1, block).select("id", "neighbour", "distance"))
    back = nearest.select(F.col("id").alias("neighbour"), F.col("neighbour").alias("id"))
    mutual = nearest.where(F.col("id") < F.col("neighbour")).join(back, ["id", "neighbour"])
    y = df.select(F.col("id").cast("bigint").alias("_id"), F.col(label).alias("_y"))
    a = mutual.join(y.withColumnsRenamed({"_id": "id", "_y": "_ya"}), "id")
    b = a.join(y.withColumnsRenamed({"_id": "neighbour", "_y": "_yb"}), "neighbour")
    return b.where(F.col("_ya") != F.col("_yb")).select(F.col("id").alias("a"), F.col("neighbour").alias("b"), "distance")


def drop_tomek_links(df: DataFrame, label: str = "label", block: int = 2048) -> DataFrame:
    """Rows that are in no Tomek link."""
    links = tomek_links(df, label, block)
    ends = links.select(F.explode(F.array("a", "b")).alias("id"))
    return df.join(ends, "id", "left_anti")


def smote(df: DataFrame, targets: dict, label: str = "label", k: int = 5, seed: int = 42, block: int = 2048) -> DataFrame:
    """Add synthetic points until each class in ``targets`` has its target count.

    ``df``: ``id``, label, ``features``.  A synthetic point lies on the line from a point of
    its class to one of that point's k nearest neighbours in the class; point, neighbour and
    place on the line follow from a seeded hash.  Synthetic ids continue above the largest
    id.  Output: ``id``, label, ``features``, ``synthetic`` (runs actions).
    """
    spark = df.sparkSession
    rows = df.select(F.col("id").cast("bigint").alias("id"), F.col(label), F.col("features").cast("array<double>").alias("features"))
    counts = {r[0]: r["_n"] for r in rows.groupBy(label).agg(F.count("*").alias("_n")).collect()}
    missing = {c: t - counts.get(c, 0) for c, t in targets.items() if t > counts.get(c, 0)}
    thin = [c for c in missing if counts.get(c, 0) < 2]
    if thin:
        raise ValueError(f"classes with fewer than two rows: {thin}")
    out = rows.withColumn("synthetic", F.lit(False))
    if not missing:
        return out
    own = materialize(rows.where(F.col(label).isin(list(missing))))
    numbered = materialize(rank_within(own, [label], ["id"], "_row"))
    near = knn(own, k, block, seed, group=label).select("id", "neighbour", F.col("pos").alias("_pos"))
    next_id = rows.agg(F.max("id")).first()[0] + 1
    kind = rows.schema[label].dataType
    seeds = None
    for cls, m in missing.items():
        choices = min(k, counts[cls] - 1)
        part = spark.range(next_id, next_id + m).select(
            F.col("id").alias("_new"),
            F.lit(cls).cast(kind).alias(label),
            (F.pmod(row_hash("id", seed=seed), F.lit(counts[cls])) + 1).alias("_row"),
            (F.pmod(row_hash("id", seed=seed + 1), F.lit(choices)) + 1).cast("int").alias("_pos"),
            unit_hash("id", seed=seed + 2).alias("_gap"),
        )
        seeds = part if seeds is None else seeds.unionByName(part)
        next_id += m
    other = numbered.select(F.col("id").alias("neighbour"), F.col("features").alias("_to"))
    made = seeds.join(numbered, [label, "_row"]).join(near, ["id", "_pos"]).join(other, "neighbour")
    between = F.zip_with("features", "_to", lambda x, y: x + F.col("_gap") * (y - x))
    made = made.select(F.col("_new").alias("id"), label, between.alias("features"), F.lit(True).alias("synthetic"))
    return out.unionByName(made)


def smote_tomek(df: DataFrame, targets: dict, label: str = "label", k: int = 5, seed: int = 42, block: int = 2048) -> DataFrame:
    """Oversample, then remove both ends of every Tomek link."""
    return drop_tomek_links(materialize(smote(df, targets, label, k, seed, block)), label, block)
