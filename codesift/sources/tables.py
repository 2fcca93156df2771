"""Reads a corpus that is already a table (Parquet, ORC or JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.schema import FILE_SCHEMA


# What a walk may say of a file, as boolean columns that a table may have.
FLAGS = ("git_ignored", "walk_error", "inaccessible", "symlink", "non_regular", "read_error")


def files_from_table(df: DataFrame, repo: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """Project any table to files(repo, path, content, size) and the flags it has; nothing
    else is read."""
    text = F.col(content)
    if df.schema[content].dataType.simpleString() == "binary":
        text = F.decode(text, "UTF-8")
    size = F.col("size").cast("bigint") if "size" in df.columns else F.octet_length(F.col(content)).cast("bigint")
    return df.select(F.col(repo).alias("repo"), F.col(path).alias("path"), text.alias("content"), size.alias("size"), *[c for c in FLAGS if c in df.columns])


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(FILE_SCHEMA)
    return files_from_table(reader.load(path))
