"""Coverage: what was looked at, what was not, and the class matrix."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators.code_js import script_files
from codesift.operators.inventory import is_dockerfile, is_shell_like, is_workflow
from codesift.operators.rules_generic import text_files
from codesift.plans.attack_classes import ATTACK_CLASSES, COVERED
from codesift.schema import GENERIC, GO, JS, local_table

PARTIAL, NOT_AUTOMATED, NOT_APPLICABLE, BLOCKED = "partial", "not_automated", "not_applicable", "blocked"

# analyzer, class, status, which count is reported
_CLASS_ROWS = [
    (GENERIC, "Cryptography and secrets", PARTIAL, "text"),
    (GENERIC, "Obvious things", PARTIAL, "text"),
    (GENERIC, "Supply chain and release", PARTIAL, "supply"),
    (GENERIC, "Cloud and deployment", PARTIAL, "docker"),
    *[(GO, c, PARTIAL, "go") for c in (
        "Injection", "Resource and file handling", "Cryptography and secrets",
        "Resource exhaustion and availability", "Client-side and rendering", "Obvious things")],
    *[(GO, c, NOT_AUTOMATED, "go") for c in (
        "Access control", "Business logic", "Chained vulnerabilities and trust boundaries")],
    *[(JS, c, PARTIAL, "js") for c in (
        "Injection", "Cryptography and secrets", "Client-side and rendering", "Resource and file handling")],
    *[(JS, c, NOT_AUTOMATED, "js") for c in (
        "Access control", "Business logic", "Resource exhaustion and availability",
        "Chained vulnerabilities and trust boundaries")],
]
LANGUAGE_ALIASES = {
    "all": ["go", "javascript-typescript"], "go": ["go"], "golang": ["go"],
    "js": [JS], "ts": [JS], "javascript": [JS], "typescript": [JS], "javascript-typescript": [JS],
}


def file_counts(
    files: DataFrame, scripts: DataFrame | None = None, go: DataFrame | None = None, repos: DataFrame | None = None
) -> DataFrame:
    """Per repo: files each pack looked at, and parse or lexical failures.

    ``files`` are analysed inventory rows; an optional ``read_error`` column marks files whose
    content could not be read: the Go pack counts them as failures, the script pack leaves
    them out.  ``scripts`` and ``go`` are the packs' cut files, which know their errors;
    without them files count as free of errors.  ``repos`` adds those without analysed files.
    """
    has_error = "read_error" in files.columns
    read_error = F.coalesce("read_error", F.lit(False)) if has_error else F.lit(False)
    path = F.col("path")
    kinds = text_files(files.where(~read_error)).select(
        "repo", F.lit(1).alias("text"), is_dockerfile(path).cast("int").alias("docker"),
        (is_workflow(path).cast("int") + is_dockerfile(path).cast("int") + is_shell_like(path).cast("int")).alias("supply"),
    )
    out = files.select("repo", F.lit(1).alias("files"), read_error.cast("int").alias("read_errors"))
    parts = [kinds, out]
    readable = files.where(~read_error)
    lost = files.where(read_error)
    if scripts is None:
        scripts = script_files(readable).withColumn("errors", F.lit(0))
    if go is None:
        go = readable.where(F.col("ext") == ".go").withColumn("errors", F.lit(0))
    # Text between tags is not an error in markup files.
    lexical = F.when(F.col("ext").isin(".jsx", ".tsx"), 0).otherwise(F.col("errors"))
    parts += [
        scripts.select("repo", F.lit(1).alias("js"), lexical.alias("js_errors")),
        go.select("repo", (F.col("errors") == 0).cast("int").alias("go"), (F.col("errors") > 0).cast("int").alias("go_failures")),
        lost.where(F.col("ext") == ".go").select("repo", F.lit(0).alias("go"), F.lit(1).alias("go_failures")),
    ]
    if repos is not None:
        parts.append(repos.select("repo", F.lit(0).alias("files")))
    names = ["files", "read_errors", "text", "docker", "supply", "go", "go_failures", "js", "js_errors"]
    # Counted per part first: every branch combines map-side before the union.
    sums = [p.groupBy("repo").agg(*[F.sum(c).alias(c) for c in p.columns if c != "repo"]) for p in parts]
    whole = sums[0]
    for part in sums[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.groupBy("repo").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])


def applies() -> Column:
    a = F.col("analyzer")
    return (
        F.when(a == GENERIC, F.col("files") > 0).when(a == GO, F.col("go") + F.col("go_failures") > 0).otherwise(F.col("js") > 0)
    )


def ran(counts: DataFrame) -> DataFrame:
    """(repo, analyzer, failures) of the analyzers that looked at a repo; a read failure stops
    the generic one."""
    analyzers = counts.withColumn("analyzer", F.explode(F.array(F.lit(GENERIC), F.lit(GO), F.lit(JS))))
    stopped = (F.col("analyzer") == GENERIC) & (F.col("read_errors") > 0)
    return analyzers.where(applies()).select("repo", "analyzer", stopped.alias("stopped"), "read_errors", "go_failures", "js_errors")


def coverage_rows(counts: DataFrame) -> DataFrame:
    """coverage(repo, analyzer, attack_class, status, detail, files).

    The class table is fixed (21 rows), so the expansion is a broadcast product
    with one row per repo.
    """
    spark = counts.sparkSession
    classes = F.broadcast(local_table(spark, _CLASS_ROWS, ["analyzer", "attack_class", "status", "counted"]))
    rows = counts.join(classes)
    files = (
        F.when(F.col("counted") == "text", F.col("text")).when(F.col("counted") == "supply", F.col("supply"))
        .when(F.col("counted") == "docker", F.col("docker")).when(F.col("counted") == "go", F.col("go")).otherwise(F.col("js"))
    )
    n = files.cast("string")
    partial_detail = (
        F.when(F.col("analyzer") == GENERIC, F.lit("deterministic patterns over text; no outside checks"))
        .when((F.col("analyzer") == GO) & (F.col("go_failures") > 0),
              F.concat(n, F.lit(" Go files read; "), F.col("go_failures").cast("string"), F.lit(" could not be read; partial coverage")))
        .when(F.col("analyzer") == GO, F.concat(n, F.lit(" Go files read; known sinks, no flow across functions")))
        .when(F.col("js_errors") > 0, F.concat(n, F.lit(" script files read with "), F.col("js_errors").cast("string"), F.lit(" lexical errors; partial coverage")))
        .otherwise(F.concat(n, F.lit(" script files read; known sinks, no types, no flow across functions")))
    )
    detail = F.when(F.col("status") == NOT_AUTOMATED, F.lit("needs a model of authority or state; not automated")).otherwise(partial_detail)
    blocked = (F.col("analyzer") == GENERIC) & (F.col("read_errors") > 0)
    shown = rows.where(applies() & ~blocked).select(
        "repo", "analyzer", "attack_class",
        F.when((F.col("analyzer") == GENERIC) & (files == 0), F.lit(NOT_APPLICABLE)).otherwise(F.col("status")).alias("status"),
        detail.alias("detail"), files.alias("files"),
    )
    analyzers = counts.withColumn("analyzer", F.explode(F.array(F.lit(GENERIC), F.lit(GO), F.lit(JS))))
    stopped = (F.col("analyzer") == GENERIC) & (F.col("read_errors") > 0)
    rest = analyzers.where(~applies() | stopped).select(
        "repo", "analyzer", F.lit("").alias("attack_class"),
        F.when(stopped, F.lit(BLOCKED)).otherwise(F.lit(NOT_APPLICABLE)).alias("status"),
        F.when(stopped, F.lit("a file could not be read")).otherwise(F.lit("no matching files")).alias("detail"),
        F.lit(0).cast("bigint").alias("files"),
    )
    return shown.unionByName(rest)


def drop_blocked(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """A read error discards the generic findings of its repo."""
    blocked = counts.where(F.col("read_errors") > 0).select("repo", F.lit(GENERIC).alias("analyzer"))
    return findings.join(blocked, ["repo", "analyzer"], "left_anti")


def sorted_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.orderBy("repo", "analyzer", "attack_class", "detail")


def status_histogram(coverage: DataFrame) -> DataFrame:
    """Per repo and status, with the flag that something was not fully covered."""
    return coverage.groupBy("repo").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in (PARTIAL, NOT_AUTOMATED, NOT_APPLICABLE, BLOCKED)],
        F.bool_or(F.col("status").isin(PARTIAL, NOT_AUTOMATED, BLOCKED)).alias("incomplete"),
    )


# ---- class matrix ---------------------------------------------------------------------


def attack_classes(spark: SparkSession) -> DataFrame:
    rows = [(domain, source, name) for domain, source, names in ATTACK_CLASSES for name in names]
    return local_table(spark, rows, ["domain", "source", "name"])


def overrides(spark: SparkSession) -> DataFrame:
    """Long form: one row per class and language that a rule covers in part."""
    note = "selected high-signal patterns; no flow across functions"
    rows = [
        (source, name, language, PARTIAL, rules, note)
        for (source, name), by_language in COVERED.items() for language, rules in zip((GO, JS), by_language) if rules
    ]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    return local_table(spark, rows, ["source", "name", "language", "status", "rules", "note"], kinds)


def coverage_matrix(classes: DataFrame, covered: DataFrame) -> DataFrame:
    """Every class in both languages: default status unless an override covers it."""
    both = classes.withColumn("language", F.explode(F.array(F.lit(GO), F.lit(JS))))
    native = (F.col("source") == "MEMORY-SAFETY-AND-BINARY.md") & (F.col("language") == JS)
    browser = (F.col("source") == "CLIENT-SIDE.md") & (F.col("language") == GO)
    default = F.when(native | browser, F.lit(NOT_APPLICABLE)).otherwise(F.lit(NOT_AUTOMATED))
    why = (
        F.when(native, F.lit("native memory; audit the native part in its own language"))
        .when(browser, F.lit("browser runtime; the server side is covered by related classes"))
        .otherwise(F.lit("needs semantic or boundary analysis that no rule automates"))
    )
    given = covered.withColumnsRenamed({"status": "own_status", "note": "own_note"})
    return both.join(F.broadcast(given), ["source", "name", "language"], "left").select(
        "domain", "source", "name", "language", F.coalesce("own_status", default).alias("status"),
        F.array_sort(F.coalesce("rules", F.array().cast("array<string>"))).alias("rules"), F.coalesce("own_note", why).alias("note"),
    )


def matrix_summary(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("language").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in (PARTIAL, NOT_APPLICABLE, NOT_AUTOMATED)]
    )


def of_language(matrix: DataFrame, language: str) -> DataFrame:
    wanted = LANGUAGE_ALIASES.get(language.strip().lower())
    if wanted is None:
        raise ValueError(f"unknown language filter: {language}")
    return matrix.where(F.col("language").isin(wanted))


def catalog_violations(classes: DataFrame, matrix: DataFrame) -> DataFrame:
    """Rows that break the catalogue's rules: (problem, source, name)."""
    empty = classes.where((F.col("domain") == "") | (F.col("source") == "") | (F.col("name") == "")).select(
        F.lit("incomplete class").alias("problem"), "source", "name"
    )
    twice = classes.groupBy("source", "name").count().where(F.col("count") > 1).select(F.lit("duplicate class").alias("problem"), "source", "name")
    status = matrix.where(~F.col("status").isin(PARTIAL, NOT_AUTOMATED, NOT_APPLICABLE)).select(F.lit("bad status").alias("problem"), "source", "name")
    note = matrix.where(F.coalesce("note", F.lit("")) == "").select(F.lit("missing note").alias("problem"), "source", "name")
    return empty.unionByName(twice).unionByName(status).unionByName(note)


def matrix_with_findings(matrix: DataFrame, findings: DataFrame) -> DataFrame:
    """The matrix next to what the corpus holds: findings and repos per cell.

    Findings are counted per rule first, so the join is over a few dozen rows.
    """
    per_rule = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    cells = matrix.select("domain", "source", "name", "language", "status", F.explode_outer("rules").alias("rule_id"))
    joined = cells.join(per_rule, "rule_id", "left")
    return joined.groupBy("domain", "source", "name", "language", "status").agg(
        F.count("rule_id").alias("n_rules"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings")
    )
