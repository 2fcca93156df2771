"""Session settings the library relies on, and where intermediate tables may be written."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Joins inside one file are on (file_id, something).  Every token-level table is
# hash-partitioned on file_id alone, so allowing a subset of the join keys to
# satisfy co-partitioning removes one shuffle per join.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.requireAllClusterKeysForDistribution": "false",
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    # Sides are broadcast only where the code says so, for tables of fixed size.
    # Everything else is co-located by bucket, so a sort-merge join moves nothing.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call on any existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "codesift") -> SparkSession:
    """A local session for tests and benchmarks.  Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODESIFT_DRIVER_MEMORY", "12g"))
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without that setting, as tests do: driver and
    executors are one process there.  Any other master must name a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="codesift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}"


# Text of one piece of a token-level table; its tokens take several times that.
PIECE_BYTES = 32 << 20
LEAST_PIECES = 8
_PIECES = "codesift.pieces"


def size_pieces(spark: SparkSession, text_bytes: int) -> None:
    """Set the number of pieces of token-level tables from the bytes of text to cut."""
    spark.conf.set(_PIECES, str(max(LEAST_PIECES, -(-text_bytes // PIECE_BYTES))))


def buckets(spark: SparkSession) -> int:
    """How many pieces token-level tables have: by the volume of text if it was told, else
    the session's shuffle width; never more than Spark allows for a table."""
    told = spark.conf.get(_PIECES, None) or spark.conf.get("spark.sql.shuffle.partitions")
    return min(int(told), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


def keep(df: DataFrame, key: str | None = "file_id", label: str = "t") -> DataFrame:
    """Write an intermediate table to the shared folder, bucketed by ``key`` if given.

    Reading it back is column-pruned, needs no exchange for windows and joins
    inside a file, starts a fresh short plan, and survives the loss of any
    executor because the files are in the shared folder.  Tables that are only
    scanned or exchanged again anyway are written as they come, without buckets.
    """
    spark = df.sparkSession
    plain = "".join(c if c.isalnum() else "_" for c in label)
    name = f"codesift_{plain}_{uuid.uuid4().hex[:12]}"
    path = shared_dir(spark, name)
    if key is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.format("parquet").bucketBy(buckets(spark), key).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)
