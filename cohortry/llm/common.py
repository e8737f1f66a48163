"""What the operators of this package share: tables, stored intermediates, caches, streamed groups."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import shared_folder

#: Words are runs of anything but these (space, tab, line feed, vertical tab, form feed, return).
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the folder every executor sees."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there (an action).

    For columns of packed bytes this is much smaller than a checkpoint, and like one it survives
    the loss of executors.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of the given text column, at least one row each."""
    text = batch.column(column)
    if not len(text):
        return
    ends = np.cumsum([0 if v is None else v for v in pc.binary_length(text).to_pylist()])
    at = 0
    while at < len(text):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def give_memory_back() -> None:
    """What Arrow and the C library hold of freed memory goes back to the system; other libraries than glibc are left alone."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def stream_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, from rows sorted by them.

    Holds one group at a time.
    """
    held: list[pa.RecordBatch] = []

    def first(b):
        return tuple(b.column(k)[0].as_py() for k in range(keys))

    def last(b):
        return tuple(b.column(k)[b.num_rows - 1].as_py() for k in range(keys))

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        if held and last(held[-1]) != first(b):
            yield pa.Table.from_batches(held)
            held = []
        cut = np.zeros(max(n - 1, 0), bool)
        for k in range(keys):
            c = b.column(k)
            if n > 1:
                differs = pc.not_equal(c.slice(1), c.slice(0, n - 1))
                one_null = pc.xor(c.slice(1).is_null(), c.slice(0, n - 1).is_null())
                cut |= np.asarray(pc.or_kleene(pc.fill_null(differs, False), one_null))
        at = 0
        for to in [*(np.flatnonzero(cut) + 1).tolist(), n]:
            part = b.slice(at, to - at)
            at = to
            if to < n:
                yield pa.Table.from_batches([*held, part])
                held = []
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def put_file(folder: str, name: str, content) -> None:
    """Write bytes (or an iterable of bytes) under a temporary name, then rename.

    A repeated attempt writes the same content under the same name; readers skip the temporary
    names, which start with a point.  ``folder`` is any URI that Arrow's file systems know.
    """
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden, compression=None) as out:
        for part in [content] if isinstance(content, bytes) else content:
            out.write(part)
    store.move(hidden, f"{path}/{name}")


def read_file(path: str) -> bytes:
    """What ``put_file`` wrote."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(path)
    with store.open_input_stream(path, compression=None) as content:
        return content.read()
