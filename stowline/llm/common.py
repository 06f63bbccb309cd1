"""What the document operators share: table access, the shared work folder, small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests, local mode)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_spread(rows: DataFrame, other: DataFrame, key: list[str] | Column, how: str = "inner") -> DataFrame:
    """rows joined with ``other`` by a shuffle of both, never by broadcast.

    Both grow with the documents. Spark takes an exploded table for as small as what it was exploded from, and would collect
    dozens of rows for each of that table's on the driver.
    """
    return rows.join(other.hint("merge"), key, how)


def release_shuffles(spark: SparkSession) -> None:
    """Ask the driver for a collection, so that Spark's cleaner deletes the shuffle files of finished jobs.

    Without it a job of several rounds holds the shuffle files of all its rounds until the driver's heap fills.
    """
    spark.sparkContext._jvm.System.gc()


#: Rows of a key, and as a share of all, from which on it is hot: no more than 100,000 keys can be.
HOT_ROWS, HOT_SHARE = 200_000, 1e-5


def join_hot(rows: DataFrame, one: DataFrame, key: list[str], total: int, least: int = HOT_ROWS) -> DataFrame:
    """rows joined with ``one``, which has one row for each key and ``n``, the number of rows that have it.

    Keys with many rows are joined by broadcast, so that no task gets them all; there are at most 1 / HOT_SHARE of them.
    Both inputs are read twice: tables, not plans.
    """
    bound = max(least, int(total * HOT_SHARE))
    hot = F.broadcast(one.where(F.col("n") > bound).drop("n"))
    rest = rows.join(hot.select(*key), key, "left_anti").join(one.where(F.col("n") <= bound).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; other columns, whatever their names, play no part.

    A null text is empty. A row without a doc_id is no document and is left out, in all operators.
    """
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def frame(schema: str, **columns) -> pd.DataFrame:
    """A pandas frame with the columns in the order of the schema's field names."""
    names = [part.split()[0] for part in schema.split(",")]
    return pd.DataFrame({n: columns[n] for n in names})
