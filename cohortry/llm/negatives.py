"""Hard negatives of anchor vectors, scored by the Four-Russians method.

The components of a candidate are cut into bit planes, and each plane into bytes of eight dimensions.
For an anchor, a table per eight dimensions holds the sums of all 256 subsets of its components.  The
inner product is then read from the tables: the sum over the bytes of a plane, doubled from plane to
plane, the sign plane taken off.  All arithmetic is in whole numbers and exact.

Anchors and candidates are dealt into blocks; a task holds one block of each and keeps the best few
rows per anchor, so that what is shuffled after scoring does not depend on the size of a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import stored, stream_groups

#: Rows of a block: of candidates, and of anchors.
CANDIDATES, ANCHORS = 4096, 512
_LONG = (1 << 63) - 1


def planes(x: np.ndarray, count: int) -> np.ndarray:
    """(n, count, groups) bytes: bit p of eight neighbouring components, in two's complement."""
    n, d = x.shape
    padded = np.zeros((n, max(1, -(-d // 8)) * 8), np.int64)
    padded[:, :d] = x
    return np.stack([np.packbits((padded >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(count)], axis=1)


def subset_sums(x: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, n): for each eight dimensions the sums over all subsets of their components."""
    n, d = x.shape
    groups = max(1, -(-d // 8))
    padded = np.zeros((n, groups * 8), kind)
    padded[:, :d] = x.astype(kind)
    parts = padded.reshape(n, groups, 8).transpose(1, 2, 0)
    out = np.zeros((groups, 256, n), kind)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, bit, None, :]
    return out


def scores(bits: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products from packed planes and subset sums."""
    n, count, groups = bits.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    for p in range(count - 1, -1, -1):
        plane = sum((tables[g][bits[:, p, g]] for g in range(1, groups)), tables[0][bits[:, p, 0]])
        total = -plane if p == count - 1 else total + total + plane
    return total


def _best(score: np.ndarray, index: np.ndarray, k: int) -> np.ndarray:
    """The k of ``index`` with the largest scores; on ties the earlier one."""
    if len(index) > k:
        s = score[index]
        index = index[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return index[np.argsort(-score[index], kind="stable")[:k]]


def _per_block(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], shape: tuple[int, int, int], pick: Callable, schema: str) -> DataFrame:
    """Score every block of anchors with every block of candidates and keep what ``pick`` returns."""
    count, width, bound = shape
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    side = ["ablock", "block", "kind", "row", "vec_id", "label", "x", "positives"]
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = anchors.withColumns({"ablock": block(blocks[1]), "kind": F.lit(0)}).withColumn("block", every(blocks[0]))
    there = rows.withColumns({"block": block(blocks[0]), "kind": F.lit(1), "positives": F.lit(None).cast("array<long>")}).withColumn("ablock", every(blocks[1]))

    def matrix(t: pa.Table) -> np.ndarray:
        out = np.zeros((t.num_rows, width), np.int64)
        for i, v in enumerate(t.column("x").combine_chunks()):
            v = v.values.to_numpy()
            out[i, : len(v)] = v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, 2):
            first = int((group.column("kind").to_numpy() == 0).sum())
            a, c = group.slice(0, first), group.slice(first)
            if not a.num_rows or not c.num_rows:
                continue
            s = scores(planes(matrix(c), count), subset_sums(matrix(a), kind))
            if kind is object:
                s = np.maximum(np.minimum(s, _LONG), -_LONG - 1)
            row, label = c.column("row").to_numpy(), c.column("label").to_numpy()
            ids = c.column("vec_id").to_pylist()
            out = []
            for j, (own, name, cls, known) in enumerate(zip(*[a.column(n).to_pylist() for n in ("row", "vec_id", "label", "positives")])):
                for place, index in pick(s[:, j], row != own, label == cls, known):
                    out += [(own, name, place, int(row[i]), ids[i], int(s[i, j])) for i in index]
            if out:
                cols = [pa.array(col, pa.int32() if k == 2 else pa.int64()) for k, col in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "anchor_id", "place", "other", "other_id", "score"])

    both = here.select(*side).unionByName(there.select(*side)).repartition("ablock", "block")
    return both.sortWithinPartitions("ablock", "block", "kind", F.col("vec_id").asc_nulls_last(), "row").mapInArrow(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has ``vec_id`` (long), ``label`` (int) and ``x`` (array of long); further columns are
    not read.  An anchor's positives are its first ``positives`` other rows of its label, by inner
    product and then the smaller vec_id.  For each, the first ``negatives`` rows of another label with
    share[0] * positive score <= share[1] * score <= share[1] * positive score are returned.

    Rows with a NULL label, vector or component take no part.  Rows that repeat a vec_id are rows of
    their own; a NULL vec_id comes last among ties and is an anchor only if ``is_anchor`` says so.  A
    shorter vector has zeros in the dimensions it lacks, an empty one scores 0.  Where scores could
    leave the range of a long the tables hold Python integers, and a score beyond it counts as the end
    of the range.  No anchors, or no rows: an empty result.  Runs jobs.
    """
    ok = F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull())
    rows = vectors.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))).where(ok)
    rows = stored(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("x").cast("array<long>"), "is_anchor").withColumn("row", F.monotonically_increasing_id()), "anchors-and-rows")
    span = rows.agg(
        F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("x")).alias("width"),
        F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"),
    ).first()
    low, high = span["low"] or 0, span["high"] or 0
    count = max(int(high).bit_length(), int(-1 - low if low < 0 else low).bit_length()) + 1
    largest = max(abs(low), abs(high))
    width = max(1, span["width"] or 0)
    shape = (count, width, 2 * max(share) * width * largest * largest)
    blocks = (max(1, -(-span["n"] // CANDIDATES)), max(1, -(-span["anchors"] // ANCHORS)))
    schema = "anchor long, anchor_id long, place int, other long, other_id long, score long"
    order = [F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other"]

    def same(score, others, alike, _):
        return [(0, _best(score, np.flatnonzero(others & alike), positives))]

    anchors = rows.where("is_anchor")
    near = _per_block(rows, anchors.withColumn("positives", F.lit(None).cast("array<long>")), blocks, shape, same, schema)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= positives)
    near = stored(near, "positives")

    def other(score, others, alike, known):
        index = np.flatnonzero(~alike)
        s = score[index]
        for place, best in enumerate(known, 1):
            inside = index[(s * share[1] >= share[0] * best) & (s <= best)]
            yield place, _best(score, inside, negatives)

    known = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("positives"))
    far = _per_block(rows, anchors.join(known.withColumnRenamed("anchor", "row"), "row"), blocks, shape, other, schema)
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    found = near.select("anchor", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(found, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def whole_numbers(embedding: str, scale: int = 256) -> Column:
    """floor(scale * component) of every component; NULL if one is NULL, infinite or not a number."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)))
