"""A code corpus derived from the ``documents`` table.

Every document contributes the files of one case (picked by ``doc_id``), in the
repository named by its source, with the document's whole text appended as a
comment, a raw string or plain text.  The corpus therefore grows with the table
in rows and in bytes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators.inventory import inventory
from codesift.plans.cases_generic import GENERIC_CASES
from codesift.plans.cases_go import GO_CASES
from codesift.plans.cases_js import JS_CASES
from codesift.schema import local_table
from codesift.session import configure


def all_cases() -> list[tuple[str, list[tuple[str, str, str]]]]:
    """Case number = position: (name, [(path, body, note style)])."""
    out = list(GENERIC_CASES)
    out += [(name, [(path, body, "//")]) for name, path, body, _ in JS_CASES]
    out += [(name, [(path, body, "gostr")]) for name, path, body, _ in GO_CASES]
    return out


def expected_rows() -> list[tuple[int, str, str, str, int, int, str]]:
    """(case_no, path, rule, variant, line, column, evidence) of the code cases."""
    number = {name: no for no, (name, _) in enumerate(all_cases())}
    rows = []
    for name, path, body, expected in [*JS_CASES, *GO_CASES]:
        lines = body.split("\n")
        for rule, variant, line, anchor, evidence in expected:
            column = len(lines[line - 1][: lines[line - 1].index(anchor)].encode()) + 1
            rows.append((number[name], path, rule, variant, line, column, evidence))
    return rows


def case_rows() -> list[tuple[int, str, str, str]]:
    return [(no, *file) for no, (_, files) in enumerate(all_cases()) for file in files]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo, path, content, doc_id): documents x the literal case table.

    The case table has a fixed size (about a hundred rows), so it is broadcast
    and the join is a map-side lookup.
    """
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    types = [pa.int64(), pa.string(), pa.string(), pa.string()]
    cases = local_table(spark, case_rows(), ["case_no", "path_text", "body_text", "note"], types)
    joined = docs.withColumn("case_no", F.pmod("doc_id", F.lit(len(all_cases())))).join(F.broadcast(cases), "case_no")
    number = F.col("doc_id").cast("string")

    def commented(mark: str):
        return F.concat(F.lit(mark), F.replace(F.col("text"), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))

    note = (
        F.when(F.col("note") == "#", commented("# "))
        .when(F.col("note") == "//", commented("// "))
        .when(F.col("note") == "raw", F.concat("text", F.lit("\n")))
        .when(F.col("note") == "gostr", F.concat(F.lit("const notes = `"), F.replace(F.col("text"), F.lit("`"), F.lit("'")), F.lit("`\n")))
        .otherwise(F.lit(""))
    )
    return joined.select(
        F.col("source").alias("repo"),
        F.replace(F.col("path_text"), F.lit("@@ID@@"), number).alias("path"),
        F.concat(F.replace(F.col("body_text"), F.lit("@@ID@@"), number), note).alias("content"),
        "doc_id",
    )


def code_inventory(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return inventory(code_files(spark, sf_dir), **options)


def sql_text(value: str) -> str:
    """A SQL string literal; characters outside the printable range by code."""
    out = "'" + value.replace("'", "''") + "'"
    for code in (1,):
        out = out.replace(chr(code), f"' || chr({code}) || '")
    return out.replace("\n", "' || chr(10) || '")


def corpus_sql() -> str:
    """The same corpus as common table expressions for the checking engine."""
    rows = ",\n".join(f"({no}, {sql_text(path)}, {sql_text(body)}, '{note}')" for no, path, body, note in case_rows())
    return f"""cases(case_no, path_text, body_text, note) AS (VALUES {rows}),
code_files AS (
  SELECT d.doc_id, d.source AS repo, replace(path_text, '@@ID@@', CAST(d.doc_id AS VARCHAR)) AS path,
    replace(body_text, '@@ID@@', CAST(d.doc_id AS VARCHAR)) || CASE note
      WHEN '#' THEN '# ' || replace(d.text, chr(10), chr(10) || '# ') || chr(10)
      WHEN '//' THEN '// ' || replace(d.text, chr(10), chr(10) || '// ') || chr(10)
      WHEN 'raw' THEN d.text || chr(10)
      WHEN 'gostr' THEN 'const notes = `' || replace(d.text, '`', '''') || '`' || chr(10)
      ELSE '' END AS content
  FROM documents d JOIN cases c ON d.doc_id % {len(all_cases())} = c.case_no
)"""
