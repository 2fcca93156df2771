"""Named queries over a directory of tables, with the SQL that checks each."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions.text import looks_like_secret, redact, unquoted
from codesift.operators import coverage as cov
from codesift.operators import findings as fd
from codesift.operators import structure as st
from codesift.operators import tokens as tk
from codesift.operators.inventory import SCRIPT_EXTENSIONS, file_key
from codesift.operators.lines import to_lines
from codesift.operators.rules_go import go_pack
from codesift.operators.rules_js import js_pack
from codesift.plans import cases_tables, checks, checks_tokens
from codesift.plans.audit import Audit, corpus_audit, unreadable_audit
from codesift.plans.corpus import code_files
from codesift.schema import RAW_COLUMNS
from codesift.session import configure, shared_dir
from codesift.sources.tables import read_files

Query = Callable[[SparkSession, str], DataFrame]

GENERIC_QUERIES = {
    "env_files": ["G001"], "secret_lines": ["G002", "G003", "G004", "G005", "G006"], "config_secrets": ["G007"],
    "todo_comments": ["G008"], "unpinned_actions": ["G009"], "workflow_permissions": ["G010"], "workflow_expr": ["G011"],
    "pr_target_mix": ["G012"], "docker_env_secret": ["G013"], "docker_pipe_to_shell": ["G014"], "docker_no_user": ["G015"],
    "pipe_to_shell": ["G016"],
}
GO_QUERIES = {
    "go_tls_config": "GO001", "go_shell_command": "GO002", "go_dynamic_sql": "GO003", "go_joined_path": "GO004",
    "go_weak_random": "GO005", "go_unbounded_read": "GO006", "go_default_client": "GO007", "go_client_timeout": "GO008",
    "go_template_html": "GO009", "go_sensitive_log": "GO010", "go_world_writable": "GO011", "go_fatal_call": "GO012",
    "go_pprof_import": "GO013", "go_server_timeout": "GO014", "go_todo_comment": "GO015", "go_request_target": "GO016",
    "go_redirect": "GO017", "go_cookie": "GO018", "go_executable": "GO019", "go_weak_hash": "GO021", "go_cors": "GO022",
}
JS_QUERIES = {
    "js_tls_option": "JS001", "js_shell_command": "JS002", "js_dynamic_code": "JS003", "js_html_sink": "JS004",
    "js_weak_random": "JS005", "js_dynamic_sql": "JS006", "js_file_path": "JS007", "js_request_target": "JS008",
    "js_navigation": "JS009", "js_post_message": "JS010", "js_web_storage": "JS011", "js_redirect": "JS012",
    "js_sensitive_log": "JS013", "js_dynamic_module": "JS014", "js_vm_code": "JS015", "js_executable": "JS016",
    "js_cors": "JS017",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files → inventory → lines → credential rules → findings → rank."""
    audit = corpus_audit(configure(spark), sf_dir)
    raw = audit.raw("generic").where(F.col("rule_id").isin("G002", "G003", "G004", "G005", "G006", "G007"))
    found = fd.ranked(fd.findings([raw]))
    return found.select("repo", "fingerprint", "rule_id", "verdict", "confidence", "path", "line", "evidence")


# ---- inventory ---------------------------------------------------------------------


def inventory_by_language(spark, sf_dir):
    kept = corpus_audit(spark, sf_dir).kept
    return kept.groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_bytes"))


def skip_reasons(spark, sf_dir):
    inv = corpus_audit(spark, sf_dir).inventory
    return inv.groupBy("repo", F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def test_paths(spark, sf_dir):
    return corpus_audit(spark, sf_dir).inventory.where("is_test").select("repo", "path", "lang")


def project_summary(spark, sf_dir):
    p = corpus_audit(spark, sf_dir).projects
    return p.select(
        "repo", "files", "total_bytes", "skipped_files", F.size("languages").alias("n_languages"),
        F.coalesce(F.try_element_at("languages", F.lit("go")), F.lit(0)).alias("go_files"),
    )


def odd_files(spark, sf_dir):
    """Inventory of the corpus stored as a table of bytes, as if a walk had met some files in
    odd ways, with paths to be cleaned, a small size limit and no tests."""
    files = code_files(configure(spark), sf_dir)
    odd, path = F.pmod("doc_id", F.lit(13)), F.col("path")
    cleaned = F.when(odd == 7, F.concat(F.lit("./x/..//"), path)).when(odd == 8, F.concat(F.lit("../"), path)).otherwise(path)
    flags = {"symlink": 1, "non_regular": 2, "inaccessible": 3, "walk_error": 4, "git_ignored": 5}
    place = shared_dir(spark, f"files-{uuid.uuid4().hex[:12]}")
    files.select("repo", cleaned.alias("path"), F.col("content").cast("binary"), *[(odd == no).alias(f) for f, no in flags.items()]).write.parquet(place)
    found = Audit(read_files(spark, place), max_bytes=1500, include_tests=False).inventory
    return found.select("repo", "path", "lang", "size", F.coalesce("skip_reason", F.lit("kept")).alias("reason"))


def binary_files(spark, sf_dir):
    """Generic findings of the corpus as if some files ended in a NUL; a file counts as binary
    if that NUL is among its first 8,192 bytes."""
    ended = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat("content", F.lit("\0"))).otherwise(F.col("content"))
    raw = Audit(code_files(configure(spark), sf_dir).withColumn("content", ended)).raw("generic")
    return raw.select("repo", "path", "rule_id", "line", "evidence", "verdict")


# ---- rules ----------------------------------------------------------------------------


def generic_rule(rules, spark, sf_dir):
    raw = corpus_audit(spark, sf_dir).raw("generic").where(F.col("rule_id").isin(rules))
    return raw.select("repo", "path", "rule_id", "line", "evidence", "verdict")


def _code_columns(raw):
    return raw.select("repo", "path", "rule_id", "variant", "line", F.col("column").alias("column_no"), "evidence")


def go_rule(rule, spark, sf_dir):
    audit = corpus_audit(configure(spark), sf_dir)
    return _code_columns(go_pack(audit.kept, only=[rule], tables=audit.go))


def js_rule(rule, spark, sf_dir):
    audit = corpus_audit(configure(spark), sf_dir)
    return _code_columns(js_pack(audit.kept, only=[rule], tables=audit.scripts))


# ---- findings and reports ----------------------------------------------------------------


def fingerprints(spark, sf_dir):
    found = fd.normalize(fd.attach_analyzer(corpus_audit(spark, sf_dir).raw_findings))
    return found.groupBy("rule_id", "fingerprint").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("repo").alias("repos"))


def dedup_findings(spark, sf_dir):
    return corpus_audit(spark, sf_dir).findings.select(
        "repo", "fingerprint", "rule_id", "analyzer", "attack_class", F.col("verdict"), "confidence", "path", "line", F.col("column").alias("column_no"), "evidence"
    )


def ranked_findings(spark, sf_dir):
    """Every finding in report order."""
    return fd.ranked(corpus_audit(spark, sf_dir).findings, within_repo=False).select("repo", "rule_id", "verdict", "path", "line")


def summary_by_repo(spark, sf_dir):
    return corpus_audit(spark, sf_dir).summary


def accepted_by_analyzer(spark, sf_dir):
    return corpus_audit(spark, sf_dir).accepted


def coverage_rows(spark, sf_dir):
    return corpus_audit(spark, sf_dir).coverage.select("repo", "analyzer", "attack_class", "status", "files")


def blocked_analyzers(spark, sf_dir):
    """Coverage of the corpus as if the files of some documents could not be read."""
    files = code_files(configure(spark), sf_dir).withColumn("read_error", F.pmod("doc_id", F.lit(97)) == 5)
    counts = cov.file_counts(Audit(files).kept)
    return cov.coverage_rows(counts).where(F.col("status") == "blocked").select("repo", "analyzer", "status", "detail")


def coverage_status(spark, sf_dir):
    return cov.status_histogram(corpus_audit(spark, sf_dir).coverage)


def _matrix(spark):
    return cov.coverage_matrix(cov.attack_classes(spark), cov.overrides(spark))


def coverage_matrix(spark, sf_dir):
    return cov.matrix_with_findings(_matrix(spark), corpus_audit(spark, sf_dir).findings)


def matrix_summary(spark, sf_dir):
    cells = cov.matrix_with_findings(_matrix(spark), corpus_audit(spark, sf_dir).findings)
    return cells.groupBy("language").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("partial", "not_applicable", "not_automated")],
        F.sum("findings").alias("findings"),
    )


def language_matrix(spark, sf_dir):
    """How many classes of each status apply to the languages that a repo has, and whatever
    breaks the catalogue's rules (then without a repo)."""
    matrix = _matrix(spark)
    names = ("go", "javascript", "typescript")
    cells = [cov.of_language(matrix, n).groupBy("status").agg(F.count(F.lit(1)).alias("classes")).withColumn("lang", F.lit(n)) for n in names]
    files = corpus_audit(configure(spark), sf_dir).kept.where(F.col("lang").isin(*names)).groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("files"))
    # Nine rows at most: three languages by three statuses.
    shown = files.join(F.broadcast(reduce(DataFrame.unionByName, cells)), "lang").select("repo", "lang", "files", "status", "classes")
    broken = cov.catalog_violations(cov.attack_classes(spark), matrix).groupBy(F.col("problem").alias("status")).agg(F.count(F.lit(1)).alias("classes"))
    return shown.unionByName(broken, allowMissingColumns=True)


def report_parts(spark, sf_dir):
    from codesift.sinks import report_documents

    doc = F.col("document")
    began, ended = (F.unix_millis(F.get_json_object(doc, f"$.{c}").cast("timestamp")) for c in ("started_at", "finished_at"))
    took = F.get_json_object(doc, "$.duration_ms").cast("bigint")
    return report_documents(corpus_audit(spark, sf_dir)).select(
        "repo", "kind", F.get_json_object(doc, "$.schema_version").alias("schema_version"),
        F.get_json_object(doc, "$.summary.total").cast("bigint").alias("total"), F.get_json_object(doc, "$.project.files").cast("bigint").alias("files"),
        *[F.get_json_object(doc, f"$.finding.{c}").alias(c) for c in ("rule_id", "fingerprint", "verdict", "evidence")],
        F.get_json_object(doc, "$.finding.location.path").alias("path"),
        F.get_json_object(doc, "$.project.discovery_mode").alias("discovery_mode"), ((took >= 0) & (ended - began == took)).alias("timed"),
    )


def event_log(spark, sf_dir):
    """Every event by its number in the repo, with what it says."""
    from codesift.sinks import event_envelopes

    return event_envelopes(corpus_audit(spark, sf_dir)).select(
        "repo", F.col("seq").cast("bigint").alias("seq"), "type", "phase", "analyzer", "message", F.col("finding.fingerprint").alias("fingerprint"),
        F.col("progress.total").alias("files"), F.col("summary.total").alias("total"),
    )


def unreadable_files(spark, sf_dir):
    """Findings, coverage and warnings of the corpus as if the files of some documents could
    not be read: what is left of the findings, what is blocked, and what is said."""
    audit = unreadable_audit(configure(spark), sf_dir)
    found = audit.findings.select("repo", F.lit("finding").alias("kind"), "analyzer", F.col("path").alias("place"), F.col("rule_id").alias("said"))
    blocked = audit.coverage.where("status = 'blocked'").select("repo", F.lit("coverage").alias("kind"), "analyzer", F.lit("").alias("place"), F.col("detail").alias("said"))
    told = audit.warnings.select("repo", F.lit("warning").alias("kind"), "analyzer", F.col("path").alias("place"), F.col("message").alias("said"))
    return found.unionByName(blocked).unionByName(told)


def findings_table(spark, sf_dir):
    """The findings table after a second audit of some repos, of half their documents and by
    the generic pack alone."""
    from codesift.plans.audit import PACKS
    from codesift.sinks import read_findings, write_findings

    path = shared_dir(configure(spark), f"findings-{uuid.uuid4().hex[:12]}")
    write_findings(corpus_audit(spark, sf_dir), path)
    again = code_files(spark, sf_dir).where(F.col("repo").rlike("1$") & (F.floor(F.col("doc_id") / 20) % 2 == 0))
    write_findings(Audit(again, packs={"generic": PACKS["generic"]}), path)
    return read_findings(spark, path).select("repo", "fingerprint", "rule_id", "path", "line", "verdict")


def own_pack(spark, sf_dir):
    """A pack of our own, for plain links in documents, in findings, coverage and events."""
    from codesift.plans.audit import OwnPack
    from codesift.sinks import event_envelopes

    def links(audit: Audit) -> DataFrame:
        lines = to_lines(audit.kept.where(docs_kind), "repo", "path")
        found = lines.where(F.contains("text", F.lit("http://"))).withColumns({
            "rule_id": F.lit("X001"), "variant": F.lit(""), "verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string"),
            "column": F.lit(0), "evidence": F.regexp_extract("text", "http://[A-Za-z0-9./_-]*", 0), "phase": F.lit(0), "pos": F.col("line"), "rule_no": F.lit(0),
        })
        return found.select(*RAW_COLUMNS)

    docs_kind = F.col("ext").isin(".md", ".yml", ".sh")
    pack = OwnPack(links, docs_kind, (("Supply chain and release", "partial"), ("Business logic", "not_automated")), (
        ("X001", "", "Supply chain and release", "hardening", "high", "A plain link", "Use an encrypted one.", "Check what is fetched."),
    ))
    audit = Audit(code_files(configure(spark), sf_dir), packs={"links": pack})
    found = audit.findings.groupBy("repo", F.concat_ws(" ", "analyzer", "rule_id", "verdict", "attack_class").alias("said")).agg(F.count(F.lit(1)).alias("n"))
    covered = audit.coverage.select("repo", F.concat_ws(" ", "analyzer", "attack_class", "status").alias("said"), F.col("files").alias("n"))
    told = event_envelopes(audit).where("analyzer = 'links' and type <> 'finding'").select("repo", F.concat_ws(" ", "type", "message").alias("said"), F.lit(1).cast("bigint").alias("n"))
    return found.unionByName(covered).unionByName(told)


def skipped_repos(spark, sf_dir):
    """Sorted coverage of a corpus in which some repos consist of dependencies alone."""
    files = code_files(configure(spark), sf_dir)
    vendored = F.when(F.col("repo").rlike("[37]$"), F.concat(F.lit("node_modules/"), F.col("path"))).otherwise(F.col("path"))
    audit = Audit(files.withColumn("path", vendored))
    counts = cov.file_counts(audit.kept, repos=audit.projects)
    return cov.sorted_coverage(cov.coverage_rows(counts)).select("repo", "analyzer", "attack_class", "status", "files")


# ---- code tables -----------------------------------------------------------------------------


def js_tokens(spark, sf_dir):
    """Token counts by kind for every script file."""
    t = corpus_audit(configure(spark), sf_dir).scripts.tokens
    return t.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("tokens"), F.max("line").alias("last_line"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("ident", "keyword", "string", "template", "regex", "number")],
    )


def brace_depth(spark, sf_dir):
    """Delimiter pairs and greatest depth per script file and kind."""
    t = corpus_audit(configure(spark), sf_dir).scripts
    where = t.tokens.where(F.col("idx") == 0).select("file_id", "repo", "path")
    pairs = st.pairs(t.rows).groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("pairs"), F.max("depth").alias("max_depth"))
    return pairs.join(where, "file_id").select("repo", "path", "kind", "pairs", "max_depth")


def call_args(spark, sf_dir):
    """Arguments of every bracketed group: how many, and how long the longest is."""
    t = corpus_audit(configure(spark), sf_dir).scripts
    where = t.tokens.where(F.col("idx") == 0).select("file_id", "repo", "path")
    per_file = t.args.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("args"), F.max("arg_no").alias("max_arg_no"), F.max(F.col("end_idx") - F.col("start_idx") + 1).alias("longest")
    )
    return per_file.join(where, "file_id").select("repo", "path", "args", "max_arg_no", "longest")


def script_imports(spark, sf_dir):
    t = corpus_audit(configure(spark), sf_dir).scripts
    where = t.tokens.where(F.col("idx") == 0).select("file_id", "repo", "path")
    return t.imports.join(where, "file_id").select("repo", "path", "local", "family", F.coalesce("member", F.lit("*")).alias("member"))


def tainted_bindings(spark, sf_dir):
    """Variables of script files that a lower-trust source reaches."""
    t = corpus_audit(configure(spark), sf_dir).scripts
    where = t.tokens.select("file_id", F.col("idx").alias("pos"), "repo", "path", "line", F.col("text").alias("name"))
    return t.tainted.distinct().join(where, ["file_id", "pos"]).select("repo", "path", "line", "name")


def go_bindings(spark, sf_dir):
    """Variables of Go files: where they are set, and whether a source reaches them."""
    t = corpus_audit(configure(spark), sf_dir).go
    where = t.tokens.select("file_id", F.col("idx").alias("decl"), "repo", "path", "line")
    hit = t.tainted.withColumn("hit", F.lit(True))
    return t.bindings.join(hit, ["file_id", "pos", "name"], "left").join(where, ["file_id", "decl"]).select(
        "repo", "path", "line", "name", "is_barrier", F.coalesce("hit", F.lit(False)).alias("tainted")
    )


# ---- the given texts themselves ------------------------------------------------------------------

_INLINE = r"(?i)(?:api[_-]?key|token|secret|password|passwd)[\"']?[\t\n\f\r ]*[:=][\t\n\f\r ]*[\"']?([A-Za-z0-9_./+=:@%!?$~,-]{16,256})"


def documents_secret_scan(spark, sf_dir):
    """Inline credential assignments in the documents' whole texts (an inline form
    of the configuration rule), redacted."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    gated = docs.where(F.rlike("content", F.lit(r"(?i)key|token|secret|passw")))
    lines = to_lines(gated, "doc_id")
    hits = lines.where(F.rlike("text", F.lit(_INLINE))).withColumn("value", F.explode(F.regexp_extract_all("text", F.lit(_INLINE), F.lit(1))))
    return hits.where(looks_like_secret(unquoted(F.col("value")))).select("doc_id", "line", redact(F.col("value")).alias("evidence"))


def page_script_tokens(spark, sf_dir):
    """Tokens of the scripts inside the pages."""
    pages = configure(spark).read.parquet(f"{sf_dir}/pages.parquet")
    scripts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<script[^>]*>([\s\S]*?)</script>"), F.lit(1))).alias("no", "content"))
    files = scripts.select(
        F.col("page_id").cast("string").alias("repo"), F.concat(F.lit("script"), F.col("no").cast("string"), F.lit(".js")).alias("path"), "content"
    ).withColumn("file_id", file_key(F.col("repo"), F.col("path")))
    return tk.js_tokens(files).select(
        F.col("repo").cast("bigint").alias("page_id"), "path", "idx", "kind", "text", "line", F.col("col").alias("column_no")
    )


def stream_findings(spark, sf_dir):
    from codesift.streaming.scan import stream_of_corpus

    return stream_of_corpus(configure(spark), sf_dir)


def stream_summary(spark, sf_dir):
    from codesift.streaming.scan import summary_stream_of_corpus

    return summary_stream_of_corpus(configure(spark), sf_dir)


def stream_retractions(spark, sf_dir):
    from codesift.streaming.versions import retractions_of_corpus

    return retractions_of_corpus(configure(spark), sf_dir)


def stream_stages(spark, sf_dir):
    from codesift.streaming.versions import stages_of_corpus

    return stages_of_corpus(configure(spark), sf_dir)


QUERIES: dict[str, Query] = {
    "credential_report": flagship,
    "inventory_by_language": inventory_by_language, "skip_reasons": skip_reasons, "test_paths": test_paths,
    "project_summary": project_summary, "odd_files": odd_files, "binary_files": binary_files, "language_matrix": language_matrix,
    **{name: partial(generic_rule, rules) for name, rules in GENERIC_QUERIES.items()},
    **{name: partial(go_rule, rule) for name, rule in GO_QUERIES.items()},
    **{name: partial(js_rule, rule) for name, rule in JS_QUERIES.items()},
    "fingerprints": fingerprints, "dedup_findings": dedup_findings, "ranked_findings": ranked_findings,
    "summary_by_repo": summary_by_repo, "accepted_by_analyzer": accepted_by_analyzer, "coverage_rows": coverage_rows,
    "blocked_analyzers": blocked_analyzers, "coverage_status": coverage_status, "coverage_matrix": coverage_matrix, "matrix_summary": matrix_summary,
    "report_parts": report_parts, "event_log": event_log, "unreadable_files": unreadable_files, "skipped_repos": skipped_repos,
    "findings_table": findings_table, "own_pack": own_pack,
    "js_tokens": js_tokens, "brace_depth": brace_depth, "call_args": call_args, "script_imports": script_imports,
    "tainted_bindings": tainted_bindings, "go_bindings": go_bindings,
    "documents_secret_scan": documents_secret_scan, "page_script_tokens": page_script_tokens,
    "stream_findings": stream_findings, "stream_summary": stream_summary,
    "stream_retractions": stream_retractions, "stream_stages": stream_stages,
}


def oracles() -> dict[str, str]:
    inv, generic, code, found = checks.inventory_sql(), checks.generic_sql(), checks.corpus_sql() + ",\n" + checks.code_sql(), checks.findings_sql()
    coverage, matrix = checks.coverage_sql(), checks.matrix_sql()
    shown = "repo, path, rule_id, line, evidence, verdict"
    out = {
        "credential_report": f"WITH {found} SELECT repo, fingerprint, rule_id, final_verdict AS verdict, confidence, path, CAST(line AS INT) AS line, evidence FROM found WHERE rule_id BETWEEN 'G002' AND 'G007'",
        "inventory_by_language": f"WITH {inv} SELECT repo, lang, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes FROM kept GROUP BY repo, lang",
        "skip_reasons": f"WITH {inv} SELECT repo, coalesce(skip_reason, 'kept') AS reason, count(*) AS files FROM inv GROUP BY ALL",
        "test_paths": f"WITH {inv} SELECT repo, path, lang FROM inv WHERE is_test",
        "project_summary": f"WITH {inv} SELECT repo, count(*) FILTER (WHERE skip_reason IS NULL) AS files, CAST(coalesce(sum(size) FILTER (WHERE skip_reason IS NULL), 0) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped_files, CAST(count(DISTINCT lang) FILTER (WHERE skip_reason IS NULL) AS INT) AS n_languages, count(*) FILTER (WHERE skip_reason IS NULL AND lang = 'go') AS go_files FROM inv GROUP BY repo",
        "fingerprints": f"WITH {found} SELECT rule_id, fingerprint, count(*) AS rows, count(DISTINCT repo) AS repos FROM printed GROUP BY ALL",
        "dedup_findings": f"WITH {found} SELECT repo, fingerprint, rule_id, analyzer, attack_class, final_verdict AS verdict, confidence, path, CAST(line AS INT) AS line, CAST(column_no AS INT) AS column_no, evidence FROM found",
        "ranked_findings": f"WITH {found} SELECT repo, rule_id, final_verdict AS verdict, path, CAST(line AS INT) AS line FROM found",
        "summary_by_repo": f"WITH {found} SELECT repo, count(fingerprint) AS total, CAST(0 AS BIGINT) AS confirmed, count(*) FILTER (WHERE final_verdict = 'needs_validation') AS needs_validation, count(*) FILTER (WHERE final_verdict = 'hardening') AS hardening, "
        + ", ".join(f"CAST(0 AS BIGINT) AS severity_{s}" for s in fd.SEVERITY_RANK) + " FROM (SELECT DISTINCT repo FROM inv) LEFT JOIN found USING (repo) GROUP BY repo",
        "accepted_by_analyzer": f"WITH {found}, {checks.coverage_part()}, ran AS (SELECT DISTINCT repo, analyzer FROM cells WHERE applies > 0) SELECT repo, analyzer, count(fingerprint) AS accepted FROM ran LEFT JOIN found USING (repo, analyzer) GROUP BY ALL",
        "coverage_rows": f"WITH {coverage} SELECT repo, analyzer, attack_class, status, files FROM coverage",
        "blocked_analyzers": f"WITH {inv} SELECT DISTINCT repo, 'generic' AS analyzer, 'blocked' AS status, 'a file could not be read' AS detail FROM kept WHERE doc_id % 97 = 5",
        "coverage_status": f"WITH {coverage} SELECT repo, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'not_automated') AS not_automated, count(*) FILTER (WHERE status = 'not_applicable') AS not_applicable, count(*) FILTER (WHERE status = 'blocked') AS blocked, bool_or(status <> 'not_applicable') AS incomplete FROM coverage GROUP BY repo",
        "documents_secret_scan": documents_sql(),
        "page_script_tokens": pages_sql(),
        "report_parts": f"""WITH {found}, repos AS (SELECT repo, count(*) FILTER (WHERE skip_reason IS NULL) AS files FROM inv GROUP BY repo)
SELECT repo, 'header' AS kind, '1' AS schema_version, (SELECT count(*) FROM found f WHERE f.repo = r.repo) AS total, files,
  NULL AS rule_id, NULL AS fingerprint, NULL AS verdict, NULL AS evidence, NULL AS path, 'filesystem' AS discovery_mode, true AS timed FROM repos r
UNION ALL SELECT repo, 'line', '1', NULL, NULL, rule_id, fingerprint, final_verdict, evidence, path, NULL, NULL FROM found""",
        "odd_files": f"""WITH {inv} SELECT repo, path, lang, size, CASE WHEN odd = 5 THEN 'git_ignored' WHEN skip_reason = 'dependency_or_build_dir' THEN skip_reason
  WHEN odd = 4 THEN 'walk_error' WHEN odd = 3 THEN 'inaccessible' WHEN odd = 1 THEN 'symlink' WHEN odd = 2 THEN 'non_regular'
  WHEN size > 1500 THEN 'too_large' WHEN is_test THEN 'tests_excluded' ELSE 'kept' END AS reason FROM (SELECT *, doc_id % 13 AS odd FROM inv) WHERE odd <> 8""",
        "js_tokens": checks_tokens.js_tokens_sql(), "brace_depth": checks_tokens.brace_depth_sql(), "call_args": checks_tokens.call_args_sql(),
    }
    head = "FROM kept WHERE base = 'dockerfile'"
    assert generic.count(head) == 1
    text_only = generic.replace(head, "FROM (SELECT * FROM kept WHERE NOT (doc_id % 3 = 0 AND strlen(content) < 8192)) WHERE base = 'dockerfile'")
    out["binary_files"] = f"WITH {text_only} SELECT repo, path, rule_id, CAST(line AS INT) AS line, evidence, verdict FROM generic"
    out["language_matrix"] = f"""WITH {inv}, {matrix}, held AS (SELECT repo, lang, count(*) AS files FROM kept WHERE lang IN ('go', 'javascript', 'typescript') GROUP BY repo, lang),
counted AS (SELECT language, status, count(*) AS classes FROM matrix GROUP BY ALL)
SELECT repo, lang, files, status, classes FROM held JOIN counted ON language = CASE lang WHEN 'go' THEN 'go' ELSE 'javascript-typescript' END"""
    cells = f"""WITH {found}, {matrix}, per_rule AS (SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id),
cells AS (SELECT m.domain, m.source, m.name, m.language, m.status, count(u.rule_id) AS n_rules, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS findings
  FROM matrix m LEFT JOIN (SELECT source, name, language, unnest(rules) AS rule_id FROM covered) u ON u.source = m.source AND u.name = m.name AND u.language = m.language
  LEFT JOIN per_rule p ON p.rule_id = u.rule_id GROUP BY ALL)"""
    out["coverage_matrix"] = f"{cells} SELECT * FROM cells"
    out["matrix_summary"] = f"{cells} SELECT language, count(*) AS total, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'not_applicable') AS not_applicable, count(*) FILTER (WHERE status = 'not_automated') AS not_automated, CAST(sum(findings) AS BIGINT) AS findings FROM cells GROUP BY language"
    for name, rules in GENERIC_QUERIES.items():
        listed = ", ".join(f"'{r}'" for r in rules)
        out[name] = f"WITH {generic} SELECT repo, path, rule_id, CAST(line AS INT) AS line, evidence, verdict FROM generic WHERE rule_id IN ({listed})"
    for name, rule in {**GO_QUERIES, **JS_QUERIES}.items():
        out[name] = f"WITH {code} SELECT repo, path, rule_id, variant, CAST(line AS INT) AS line, CAST(column_no AS INT) AS column_no, evidence FROM code WHERE rule_id = '{rule}'"
    out["tainted_bindings"] = checks.table_sql(cases_tables.TAINTED, ["line", "name"])
    out["script_imports"] = checks.table_sql(cases_tables.IMPORTED, ["local", "family", "member"])
    out["go_bindings"] = checks.table_sql(cases_tables.GO_BOUND, ["line", "name", "is_barrier", "tainted"])
    out["stream_findings"] = f"WITH {generic} SELECT DISTINCT repo, path, rule_id, CAST(line AS INT) AS line, evidence, verdict FROM generic WHERE rule_id <> 'G015'"
    out["stream_summary"] = f"WITH {generic} SELECT repo, count(*) AS total, count(*) FILTER (WHERE verdict = 'needs_validation') AS needs_validation, count(*) FILTER (WHERE verdict = 'hardening') AS hardening FROM generic WHERE rule_id <> 'G015' GROUP BY repo"
    def with_emptied(sql: str, test: str) -> str:
        head = "named AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS base FROM code_files)"
        assert head in sql
        return sql.replace(head, head.replace("FROM code_files", f"FROM (SELECT * REPLACE (CASE WHEN {test} THEN '' ELSE content END AS content) FROM code_files)"))

    half = "FROM (SELECT * FROM code_files WHERE NOT regexp_matches(repo, '1$') OR (doc_id // 20) % 2 = 0)"
    out["findings_table"] = f"""WITH {found.replace("AS base FROM code_files)", f"AS base {half})")}
SELECT repo, fingerprint, rule_id, path, CAST(line AS INT) AS line, final_verdict AS verdict FROM found WHERE analyzer = 'generic' OR NOT regexp_matches(repo, '1$')"""
    out["own_pack"] = f"""WITH {inv}, looked AS (SELECT * FROM kept WHERE ext IN ('.md', '.yml', '.sh')),
split AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS text FROM looked),
hits AS (SELECT DISTINCT repo, path, regexp_extract(text, 'http://[A-Za-z0-9./_-]*') AS said FROM split WHERE contains(text, 'http://')),
n AS (SELECT repo, count(looked.path) AS files FROM (SELECT DISTINCT repo FROM inv) LEFT JOIN looked USING (repo) GROUP BY repo),
found AS (SELECT repo, count(*) AS n FROM hits GROUP BY repo)
SELECT repo, 'links X001 hardening Supply chain and release' AS said, n FROM found
UNION ALL SELECT repo, unnest(['links Supply chain and release partial', 'links Business logic not_automated']), files FROM n WHERE files > 0
UNION ALL SELECT repo, 'links  not_applicable', 0 FROM n WHERE files = 0
UNION ALL SELECT repo, unnest(['analyzer.start', 'analyzer.done ' || coalesce(found.n, 0) || ' unique findings']), 1 FROM n LEFT JOIN found USING (repo) WHERE files > 0"""
    emptied = with_emptied(generic, "doc_id % 3 = 0")
    out["stream_retractions"] = f"""WITH {emptied}, one AS (SELECT DISTINCT repo, path, rule_id, trim(regexp_replace(evidence, '\\s+', ' ', 'g')) AS said, verdict FROM generic WHERE rule_id <> 'G015')
SELECT repo, count(*) AS total, count(*) FILTER (WHERE verdict = 'needs_validation') AS needs_validation, count(*) FILTER (WHERE verdict = 'hardening') AS hardening FROM one GROUP BY repo"""
    late = with_emptied(generic, "doc_id % 2 = 0 AND regexp_matches(lower(path), '[.](sh|bash|zsh|ps1)$')")
    out["stream_stages"] = f"WITH {late} SELECT repo, path, CAST(line AS INT) AS line, evidence FROM generic WHERE rule_id = 'G015'"
    verdicts = "CASE final_verdict WHEN 'confirmed' THEN -3 WHEN 'needs_validation' THEN -2 WHEN 'hardening' THEN -1 ELSE 0 END"
    out["event_log"] = f"""WITH {found}, {checks.coverage_part()}, repos AS (SELECT repo, count(*) FILTER (WHERE skip_reason IS NULL) AS files FROM inv GROUP BY repo),
totals AS (SELECT repo, count(fingerprint) AS total FROM repos LEFT JOIN found USING (repo) GROUP BY repo),
ran AS (SELECT DISTINCT repo, analyzer FROM cells WHERE applies > 0),
events AS (
  SELECT repo, 'audit.start' AS type, 'setup' AS phase, 0 AS p, 0 AS s, NULL AS analyzer, NULL AS message, NULL AS fingerprint, NULL::BIGINT AS files, NULL::BIGINT AS total, 0 AS v, NULL AS path, NULL::INT AS line, NULL AS rule_id FROM repos
  UNION ALL SELECT repo, 'discovery.done', 'discovery', 1, 0, NULL, NULL, NULL, files, NULL, 0, NULL, NULL, NULL FROM repos
  UNION ALL SELECT repo, 'analyzer.start', 'analysis', 2, 0, analyzer, NULL, NULL, NULL, NULL, 0, NULL, NULL, NULL FROM ran
  UNION ALL SELECT repo, 'finding', 'analysis', 2, 2, analyzer, NULL, fingerprint, NULL, NULL, {verdicts}, path, line, rule_id FROM found
  UNION ALL SELECT repo, 'analyzer.done', 'analysis', 2, 3, analyzer, count(fingerprint) || ' unique findings', NULL, NULL, NULL, 0, NULL, NULL, NULL FROM ran LEFT JOIN found USING (repo, analyzer) GROUP BY repo, analyzer
  UNION ALL SELECT repo, 'audit.complete', 'report', 3, 0, NULL, NULL, NULL, NULL, total, 0, NULL, NULL, NULL FROM totals
  UNION ALL SELECT repo, 'report', 'report', 3, 1, NULL, NULL, NULL, NULL, total, 0, NULL, NULL, NULL FROM totals)
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY p, analyzer, s, v, encode(path), line, rule_id, fingerprint) AS seq, type, phase, analyzer, message, fingerprint, files, total FROM events"""
    lost = "doc_id % 97 = 5"
    out["unreadable_files"] = f"""WITH {found}, lost AS (SELECT * FROM kept WHERE {lost}), stopped AS (SELECT repo, count(*) AS n FROM lost GROUP BY repo),
code_left AS (SELECT f.* FROM printed f WHERE analyzer <> 'generic' AND NOT EXISTS (SELECT 1 FROM lost WHERE lost.repo = f.repo AND lost.path = f.path)),
left_over AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, fingerprint ORDER BY analyzer, path, line, column_no) AS rn FROM (
  SELECT * FROM code_left UNION ALL SELECT * FROM printed WHERE analyzer = 'generic')) WHERE rn = 1)
SELECT repo, 'finding' AS kind, analyzer, path AS place, rule_id AS said FROM left_over WHERE analyzer <> 'generic' OR repo NOT IN (SELECT repo FROM stopped)
UNION ALL SELECT repo, 'coverage', 'generic', '', 'a file could not be read' FROM stopped
UNION ALL SELECT repo, 'warning', 'generic', '', n || ' files could not be read, so the analyzer stopped' FROM stopped
UNION ALL SELECT repo, 'warning', CASE WHEN ext = '.go' THEN 'go' ELSE 'javascript-typescript' END, path, 'could not read ' || path FROM lost WHERE ext = '.go' OR ext IN {checks._list(SCRIPT_EXTENSIONS)}"""
    vendored = coverage.replace("named AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS base FROM code_files)", "named AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS base FROM (SELECT * REPLACE (CASE WHEN regexp_matches(repo, '[37]$') THEN 'node_modules/' || path ELSE path END AS path) FROM code_files))")
    out["skipped_repos"] = f"WITH {vendored} SELECT repo, analyzer, attack_class, status, files FROM coverage"
    return out


def documents_sql() -> str:
    pattern = r"""(?i)(?:api[_-]?key|token|secret|password|passwd)["'']?\s*[:=]\s*["'']?([A-Za-z0-9_./+=:@%!?$~,-]{16,256})"""
    return f"""WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM split),
hits AS (SELECT doc_id, line, unnest(regexp_extract_all(text, '{pattern}', 1)) AS value FROM lines WHERE regexp_matches(text, '{pattern}'))
SELECT doc_id, CAST(line AS INT) AS line, {checks._redact('value')} AS evidence FROM hits WHERE {checks._secret('value')}"""


def pages_sql() -> str:
    return r"""WITH bodies AS (SELECT page_id, regexp_extract_all(html, '(?i)<script[^>]*>((?:.|\n)*?)</script>', 1) AS bs FROM pages),
scripts AS (SELECT page_id, unnest(bs) AS body, unnest(range(len(bs))) AS no FROM bodies),
cut AS (SELECT page_id, no, regexp_extract_all(body, '\s+|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|[0-9]+|[A-Za-z_$][A-Za-z0-9_$]*|.') AS ps FROM scripts),
pieces AS (SELECT page_id, no, unnest(ps) AS text, unnest(range(len(ps))) AS pos, ps FROM cut),
placed AS (SELECT page_id, no, pos, text, array_to_string(ps[1:pos], '') AS head FROM pieces),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id, no ORDER BY pos) - 1 AS idx FROM placed WHERE NOT regexp_matches(text, '^\s'))
SELECT page_id, 'script' || no || '.js' AS path, CAST(idx AS INT) AS idx,
  CASE WHEN text = 'var' THEN 'keyword' WHEN regexp_matches(text, '^["'']') THEN 'string' WHEN regexp_matches(text, '^[0-9]') THEN 'number'
       WHEN regexp_matches(text, '^[A-Za-z_$]') THEN 'ident' WHEN text IN ('=', '<', '>', '/', '+', '-') THEN 'op' ELSE 'punct' END AS kind,
  text, CAST(1 AS INT) AS line, CAST(strlen(head) + 1 AS INT) AS column_no FROM kept"""
