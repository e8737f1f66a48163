"""Token ids in files: frequency-ranked, byte-aligned variable length, control bytes apart.

Every id is replaced by its rank in the corpus (0: the most frequent), and a rank is written in as
many bytes as it needs, one to four.  Two bits a rank say how many; four ranks share a control byte,
and all control bytes of a file stand before its data bytes.  A table from the control byte to the
places of sixteen output bytes decodes four ranks at a time.

A folder holds ``vocabulary`` (id by rank), ``data`` (the files, named in ascending order of their
documents) and ``manifest``; the manifest is committed last, so a folder without one is not whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import put_file

MAGIC = b"RVB1"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By control byte: the bytes that its four ranks take, and where each of 16 output bytes comes from (16: a zero)."""
    control = np.arange(256)
    lengths = np.stack([(control >> (2 * k) & 3) + 1 for k in range(4)], axis=1)
    starts = np.cumsum(lengths, axis=1) - lengths
    byte = np.arange(4)
    places = np.where(byte < lengths[:, :, None], starts[:, :, None] + byte, 16).reshape(256, 16)
    return lengths, places


LENGTHS, PLACES = _tables()
TAKES = LENGTHS.sum(axis=1)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes; the last control byte is filled up with one-byte zeros."""
    r = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    r[: len(ranks)] = ranks
    length = 1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF)
    quads = (length - 1).reshape(-1, 4).astype(np.uint8)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(control, np.uint8)
    takes = TAKES[c]
    starts = np.cumsum(takes) - takes
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(17, np.uint8)])
    out = np.empty((len(c), 16), np.uint8)
    for at in range(0, len(c), 1 << 18):
        place = PLACES[c[at : at + (1 << 18)]]
        out[at : at + (1 << 18)] = np.where(place < 16, padded[starts[at : at + (1 << 18), None] + place], 0)
    return out.reshape(-1).view("<u4")[:n]


def _file(docs: list, counts: list[int], ranks: np.ndarray, before: int) -> bytes:
    control, data = pack_ranks(ranks)
    head = json.dumps({"docs": len(docs), "ids": len(ranks), "before": before, "control": len(control), "data": len(data)}).encode()
    null = np.array([d is None for d in docs], np.uint8).tobytes()
    keys = np.array([0 if d is None else d for d in docs], "<i8").tobytes()
    body = b"".join([len(head).to_bytes(4, "little"), head, null, keys, np.array(counts, "<i8").tobytes(), control, data])
    return MAGIC + zlib.crc32(body).to_bytes(4, "little") + body


def _read(content: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """The ids before the file in its part, doc ids, ids per document, and all ranks of a file."""
    if content[:4] != MAGIC or zlib.crc32(memoryview(content)[8:]) != int.from_bytes(content[4:8], "little"):
        raise ValueError("not a whole file of ranks")
    at = 12 + int.from_bytes(content[8:12], "little")
    head = json.loads(content[12:at])
    n = head["docs"]
    null = np.frombuffer(content, np.uint8, n, at)
    keys = np.frombuffer(content, "<i8", n, at + n)
    counts = np.frombuffer(content, "<i8", n, at + 9 * n)
    at += 17 * n
    control, data = content[at : at + head["control"]], content[at + head["control"] :]
    return head["before"], [None if x else k for x, k in zip(null.tolist(), keys.tolist())], counts, unpack_ranks(control, data, head["ids"])


def rank_ids(tokens: DataFrame, width: int = 4) -> np.ndarray:
    """The ids that occur, most frequent first (ties: smaller id), counted over the whole table.

    Each task counts its rows and sends one number per id it met; the result is bounded by the
    vocabulary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), f"<u{width}"), minlength=len(total))
            n[: len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["id", "k"])

    counts = tokens.select("ids").mapInArrow(count, "id long, k long").groupBy("id").agg(F.sum("k").alias("k"))
    rows = counts.collect()
    ids, k = np.array([r["id"] for r in rows], np.int64), np.array([r["k"] for r in rows], np.int64)
    return ids[np.lexsort((ids, -k))]


def write(tokens: DataFrame, folder: str, width: int = 4, file_ids: int = 16_000_000) -> None:
    """Write (doc_id, ids, row) in ascending order of doc_id (NULL first, then row) to a new folder.

    The order is dealt to tasks by range, so a task holds one file of ``file_ids`` ids (or one longer
    document) at a time.  Files have fixed names and are renamed into place; a task that is run again
    writes the same files.  An empty table gives a folder without files.
    """
    spark = tokens.sparkSession
    by_rank = rank_ids(tokens, width)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, docs, counts, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def put():
            nonlocal number, before, docs, counts, ids, held
            name = f"part-{part:07d}-{number:05d}.rvb"
            put_file(f"{folder}/data", name, _file(docs, counts, rank_of[np.frombuffer(b"".join(ids), f"<u{width}")], before))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64())], ["part", "file", "docs", "ids"])
            before += held
            number, docs, counts, ids, held = number + 1, [], [], [], 0
            return row

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(d)
                ids.append(x)
                counts.append(len(x) // width)
                held += len(x) // width
                if held >= file_ids:
                    yield put()
        if docs:
            yield put()

    ordered = tokens.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    ordered.mapInArrow(run, "part long, file string, docs long, ids long").write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder written by ``write``.

    ``start`` counts the ids of all documents before it; ``ids`` are packed little-endian unsigned
    32-bit ids.  One number per part (task of the writer) goes through the driver; where a file stands
    in its part is in its head.
    """
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()], "<u4")
    starts, total = {}, 0
    for r in spark.read.parquet(f"{folder}/manifest").groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect():
        starts[r["part"]] = total
        total += r["ids"]
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not starts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                before, docs, counts, ranks = _read(content.as_py())
                before += starts[int(name.split("-")[1])]
                raw, ends = by_rank[ranks].tobytes(), np.cumsum(counts)
                for at in range(0, len(docs), 1000):
                    to = min(at + 1000, len(docs))
                    n, own = counts[at:to], (ends - counts)[at:to]
                    ids = [raw[4 * s : 4 * (s + k)] for s, k in zip(own.tolist(), n.tolist())]
                    cols = [pa.array(docs[at:to], pa.int64()), pa.array(before + own), pa.array(n), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rvb").load(f"{folder}/data")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)
