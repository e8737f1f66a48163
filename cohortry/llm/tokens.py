"""Documents to packed token ids, stored once because later steps read them twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import encoders
from cohortry.llm.common import slices, stored, text_or_empty


def encoded(docs: DataFrame, kind: type, path: str, end_id: int, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n, row): the packed ids of each text and ``end_id`` after them.

    Runs a job and returns the stored table.  A NULL text is an empty one and gets the end id
    alone.  ``width`` is the number of bytes per id (2 if every id is below 65,536).  ``row`` is
    unique even where rows or keys repeat, and fixed once stored.
    """
    end = np.array([end_id], f"<u{width}").tobytes()
    kind_name = kind.__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders.encoder(getattr(encoders, kind_name), path, width)
        for b in batches:
            for part in slices(b, 1):
                ids = [x + end for x in enc.encode(part.column(1).to_pylist())]
                n = np.array([len(x) // width for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(n)], ["doc_id", "ids", "n"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    out = narrow.mapInArrow(run, "doc_id long, ids binary, n long")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "tokens")
