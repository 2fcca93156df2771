"""Continuous scanning with Structured Streaming.

New file snapshots are scanned as they land.  Line rules are stateless; first-wins
dedup keeps fingerprints within a watermark; the running summary is an ordinary
streaming aggregation.  Rules that need token tables or other files of the repo
run per micro-batch, where each file is complete in itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.operators.findings import attach_analyzer, describe, normalize
from codesift.operators.inventory import analysed, inventory
from codesift.operators.rules_generic import file_rules, line_rules, text_files
from codesift.schema import FILE_SCHEMA, RAW_COLUMNS
from codesift.session import shared_dir

LANDING_SCHEMA = T.StructType([*FILE_SCHEMA.fields, T.StructField("ingest_ts", T.TimestampType())])


def landed_files(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of file snapshots written under ``path``."""
    return spark.readStream.format(fmt).schema(LANDING_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(path)


def line_findings(files: DataFrame, *carry: str) -> DataFrame:
    """Raw findings of the stateless rules (everything generic but G015); ``carry`` names
    columns of the files that they keep, such as the time for a watermark."""
    texts = text_files(analysed(inventory(files, carry=carry)))
    found = line_rules(texts, *carry).unionByName(file_rules(texts, *carry))
    return found.withColumns({"variant": F.lit(""), "column": F.lit(0)}).select(*RAW_COLUMNS, *carry)


def first_seen(found: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First occurrence per (repo, fingerprint); repeats later than the watermark may reappear."""
    printed = normalize(attach_analyzer(found))
    return printed.withWatermark("ingest_ts", watermark).dropDuplicatesWithinWatermark(["repo", "fingerprint"])


def running_summary(found: DataFrame) -> DataFrame:
    """Counts per repo; write it in update or complete mode."""
    return found.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("verdict") == "needs_validation").alias("needs_validation"),
        F.count_if(F.col("verdict") == "hardening").alias("hardening"),
    )


def audit_batches(files: DataFrame, out_dir: str, checkpoint: str):
    """Full audits per micro-batch (token and data-flow rules), appended as Parquet.

    Scripts that excuse a container file (G015) are looked up in the same batch; where they
    may land apart, take G015 from ``versions`` instead.
    """
    from codesift.plans.audit import Audit

    def audit(batch: DataFrame, batch_id: int) -> None:
        found = Audit(batch.drop("ingest_ts")).findings
        # The batch number makes a retried batch overwrite itself.
        found.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return files.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land(files: DataFrame, path: str, hour: int = 0) -> None:
    """Add files of the corpus to a landing folder, stamped within this hour."""
    stamped = files.withColumns({
        "size": F.octet_length("content").cast("bigint"), "ingest_ts": F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour) + F.col("doc_id") % 3600),
    })
    stamped.select(*LANDING_SCHEMA.names).write.mode("append").parquet(path)


def land_corpus(spark: SparkSession, sf_dir: str) -> str:
    """Write the corpus as landed snapshots, in a fresh folder."""
    from codesift.plans.corpus import code_files

    path = shared_dir(spark, f"landing-{uuid.uuid4().hex[:12]}")
    land(code_files(spark, sf_dir), path)
    return path


def drain(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan the landed corpus as a stream and return what reached the sink."""
    run = uuid.uuid4().hex[:12]
    out = shared_dir(spark, f"stream-{run}")
    found = first_seen(line_findings(landed_files(spark, land_corpus(spark, sf_dir)), "ingest_ts"))
    shown = found.select("repo", "path", "rule_id", "line", "evidence", "verdict")
    drain(shown.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", shared_dir(spark, f"stream-cp-{run}")
    ).trigger(availableNow=True).start())
    return spark.read.schema(shown.schema).parquet(out)


def summary_stream_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running summary of the landed corpus; each batch replaces the last result."""
    run = uuid.uuid4().hex[:12]
    out = shared_dir(spark, f"summary-{run}")
    totals = running_summary(line_findings(landed_files(spark, land_corpus(spark, sf_dir))))
    empty = spark.createDataFrame([], totals.schema)
    empty.write.parquet(f"{out}/none")
    last = [f"{out}/none"]  # what an empty stream leaves

    def put(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    drain(totals.writeStream.outputMode("complete").foreachBatch(put).option(
        "checkpointLocation", shared_dir(spark, f"summary-cp-{run}")
    ).trigger(availableNow=True).start())
    return spark.read.schema(totals.schema).parquet(last[0])


def described(found: DataFrame) -> DataFrame:
    """Attach catalogue texts to streamed findings (a broadcast of 58 fixed rows)."""
    return describe(found)
