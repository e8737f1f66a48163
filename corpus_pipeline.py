"""A corpus prepared in four stages, each an operator of ``cohortry.llm``.

Toxic documents go, then those that fail the quality rules, then all but one document of each group
of near copies; what is left is packed.  Every stage takes (spark, docs, sf_dir) and returns a
DataFrame; between two stages the documents are written as Parquet and read again.  Rows with NULLs,
empty texts, repeated rows and further columns pass through a stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import jaccard, quality, toxicity
from cohortry.llm.catalog import packed
from cohortry.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; labels of rows that are not held out are all it learns from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    named = {f"_{i}": c for i, c in enumerate(docs.columns)}  # columns called like a result stay
    of = {c.lower(): i for i, c in named.items()}
    rows = toxicity.scored(docs.toDF(*named), model, of["text"], id_=of["doc_id"])
    return rows.where(F.col("toxic_score") < 0.5).select(*named).toDF(*named.values())


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by the removal of common lines.

    A line is common if more than ``quality.LINE_DOCS`` documents of its host have it, however many the host has.
    """
    return quality.kept(docs, share=0.0)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 ids."""
    return packed(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_good), ("n-gram jaccard join", keep_one_copy), ("packing", pack)]

#: SQL has neither the nearest examples nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
