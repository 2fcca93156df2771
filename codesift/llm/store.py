"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  A local session without that
    setting (tests) gets a temporary folder; any other master must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage, and a lost
    executor costs nothing but the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm_{label}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def order_key(column: str) -> Column:
    """An integer id as a long that sorts null after every id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is exchanged at any size.  Spark judges a side by the bytes of
    its files, so packed columns and exploded rows of tens of times that size would pass for
    small ones and be collected by the driver."""
    return df.hint("merge")


SMALL_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join with a table whose row count is known.  Up to SMALL_ROWS it is sent to all
    executors; beyond that both sides are exchanged and adaptive execution splits hot keys."""
    return df.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on, how)
