"""Readers and writers."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Role keywords in file names and the renames each role needs.
ROLE_RENAMES = {
    "label": {"cand_id": "candidate_id", "ideal_donor": "target"},
    "donation": {"cand_id": "candidate_id"},
    "feature": {"cand_id": "candidate_id"},
}

LABEL_SCHEMA = "cand_id bigint, ideal_donor int"
DONATION_SCHEMA = "cand_id bigint, trans_date date, amount double"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, drop: Sequence[str] = ("Unnamed: 0", "_c0")) -> DataFrame:
    """CSV with a header; unnamed index columns are dropped.

    Give a schema for anything large: without one the file is read twice to infer types.
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.drop(*drop)


def load_roles(spark: SparkSession, paths: Sequence[str], schemas: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Label, donation and feature tables, told apart by a keyword in each path.

    Raises if a role has no file.
    """
    found = {}
    for path in paths:
        role = next((r for r in ROLE_RENAMES if r in os.path.basename(path)), None) or next((r for r in ROLE_RENAMES if r in path), None)
        if role:
            found[role] = read_csv(spark, path, (schemas or {}).get(role)).withColumnsRenamed(ROLE_RENAMES[role])
    missing = [r for r in ROLE_RENAMES if r not in found]
    if missing:
        raise FileNotFoundError(f"no file for: {', '.join(missing)}")
    return found["label"], found["donation"], found["feature"]


def load_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or Parquet if the name looks like a path."""
    return spark.read.parquet(name) if "/" in name or name.endswith(".parquet") else spark.table(name)


def read_jdbc(spark: SparkSession, table: str, url: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, user_env: str = "JDBC_USER", password_env: str = "JDBC_PASSWORD", **options) -> DataFrame:
    """A database table read in parallel ranges of ``key``; credentials from the environment."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for option, env in (("user", user_env), ("password", password_env)):
        if env in os.environ:
            reader = reader.option(option, os.environ[env])
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.options(**options).load()


def publish(df: DataFrame, name: str, partition_by: Sequence[str] = (), bucket_by: tuple[int, str] | None = None) -> None:
    """Replace a table (or a Parquet folder if the name is a path).

    Bucketing a table by its join key lets later joins on that key skip their shuffle.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in name:
        writer.parquet(name)
    else:
        if bucket_by:
            writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
        writer.saveAsTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metrics table as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def save_artifact(model: PipelineModel, held_out: DataFrame, path: str) -> None:
    """A fitted pipeline together with its held-out rows."""
    model.write().overwrite().save(f"{path}/model")
    held_out.write.mode("overwrite").parquet(f"{path}/held_out")


def load_artifact(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/held_out")


def save_params(spark: SparkSession, params: Mapping, path: str) -> None:
    """Tuned parameters as rows (name, value as JSON text)."""
    rows = [Row(name=k, value=json.dumps(v)) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> dict:
    return {r["name"]: json.loads(r["value"]) for r in spark.read.json(path).select(F.col("name"), F.col("value")).collect()}
