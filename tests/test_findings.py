import time

from pyspark.sql import functions as F

from codesift.operators import coverage as cov
from codesift.operators import findings as fd
from codesift.plans.audit import PACKS, Audit, corpus_audit
from codesift.plans.corpus import all_cases, expected_rows
from codesift.plans.queries import QUERIES, oracles
from codesift.sinks import event_envelopes, report_documents
from codesift.sources.tables import files_from_table


def raw(spark, rows):
    names = "repo string, rule_id string, analyzer string, variant string, verdict string, severity string, confidence string, path string, line int, column int, evidence string, phase int, pos int, rule_no int"
    return spark.createDataFrame(rows, names)


def test_first_analyzer_wins_and_severity_needs_confirmation(spark):
    rows = [
        ("r", "X1", "zeta", "", "confirmed", "high", None, "a.go", 9, 1, "same  text", 0, 1, 0),
        ("r", "X1", "alpha", "", "hardening", "high", None, "a.go", 3, 1, "same text", 0, 5, 0),
    ]
    got = fd.first_wins(fd.normalize(raw(spark, rows))).collect()
    assert len(got) == 1 and got[0].analyzer == "alpha" and got[0].severity is None and got[0].confidence == "medium"
    again = fd.first_wins(fd.normalize(raw(spark, rows[::-1]))).collect()
    assert again[0].analyzer == "alpha"


def test_ranking_and_summary(spark):
    rows = [
        ("r", "A", "a", "", "hardening", None, "low", "a", 1, 0, "1", 0, 0, 0),
        ("r", "B", "a", "", "confirmed", "low", "low", "b", 1, 0, "2", 0, 0, 0),
        ("r", "C", "a", "", "confirmed", "critical", "low", "c", 1, 0, "3", 0, 0, 0),
    ]
    found = fd.normalize(raw(spark, rows))
    assert [r.rule_id for r in fd.ranked(found).collect()] == ["C", "B", "A"]
    s = fd.by_severity(fd.summarize(found)).first()
    assert (s.total, s.confirmed, s.hardening, s.by_severity) == (3, 2, 1, {"critical": 1, "low": 1})


def test_code_rules_match_the_cases(spark, sf_dir):
    audit = corpus_audit(spark, sf_dir)
    got = audit.raw("go", "javascript-typescript").groupBy("rule_id").count().collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    want: dict[str, int] = {}
    for no, _, rule, *_ in expected_rows():
        want[rule] = want.get(rule, 0) + sum(d % len(all_cases()) == no for d in docs)
    assert {r["rule_id"]: r["count"] for r in got} == want


def test_class_matrix(spark):
    classes = cov.attack_classes(spark)
    matrix = cov.coverage_matrix(classes, cov.overrides(spark))
    rows = {r.language: (r.total, r.partial, r.not_applicable, r.not_automated) for r in cov.matrix_summary(matrix).collect()}
    assert rows == {"go": (162, 19, 13, 130), "javascript-typescript": (162, 20, 20, 122)}
    assert cov.catalog_violations(classes, matrix).count() == 0
    assert cov.of_language(matrix, "TS").select("language").distinct().count() == 1


def test_reports_and_events(spark, sf_dir):
    audit = corpus_audit(spark, sf_dir)
    lines = report_documents(audit)
    assert lines.where("kind = 'line'").count() == audit.findings.count()
    assert lines.where("kind = 'header'").count() == audit.projects.count()
    kinds = {r["type"] for r in event_envelopes(audit).select("type").distinct().collect()}
    assert {"audit.start", "discovery.done", "analyzer.start", "finding", "analyzer.done", "audit.complete", "report"} <= kinds


def test_read_error_blocks_the_generic_analyzer(spark, sf_dir):
    audit = corpus_audit(spark, sf_dir)
    counts = audit.counts.withColumn("read_errors", F.when(F.col("repo") == "src1", 1).otherwise(0).cast("bigint"))
    rows = cov.coverage_rows(counts).where((F.col("repo") == "src1") & (F.col("analyzer") == "generic")).collect()
    assert [r.status for r in rows] == ["blocked"]
    assert cov.drop_blocked(audit.findings, counts).where((F.col("repo") == "src1") & (F.col("analyzer") == "generic")).count() == 0


def test_every_query_has_a_name_and_checks_are_known():
    assert set(oracles()) <= set(QUERIES)


def test_pieces_follow_the_volume_of_text(spark):
    from codesift import session

    told = spark.conf.get("codesift.pieces", None)
    try:
        session.size_pieces(spark, 1000)
        assert session.buckets(spark) == session.LEAST_PIECES
        session.size_pieces(spark, 1000 * session.PIECE_BYTES + 1)
        assert session.buckets(spark) == 1001
        spark.conf.unset("codesift.pieces")
        assert session.buckets(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("codesift.pieces", told) if told else spark.conf.unset("codesift.pieces")


def test_reports_say_when_and_how(spark):
    import json

    rows = [("r", "a/x.txt", b"AKIA", False, True), ("r", "a/y.txt", b"plain", False, False)]
    files = files_from_table(spark.createDataFrame(rows, "repo string, path string, content binary, symlink boolean, git_ignored boolean"))
    assert files.columns == ["repo", "path", "content", "size", "git_ignored", "symlink"]
    for options, mode, kept in (({}, "git", 1), ({"include_ignored": True}, "filesystem", 2)):
        audit = Audit(files, packs={"generic": PACKS["generic"]}, **options)
        head = json.loads(report_documents(audit).where("kind = 'header'").first().document)
        assert (head["project"]["discovery_mode"], head["project"]["files"]) == (mode, kept)
        assert head["started_at"] <= head["finished_at"] and head["duration_ms"] >= 0
    assert audit.started_ms <= time.time() * 1000


def test_scripts_are_cut_alike_by_the_checking_engine():
    import duckdb

    from codesift.operators.tokens import js_cut
    from codesift.plans.checks_tokens import script_tokens_sql
    from codesift.plans.corpus import case_rows
    from codesift.plans.corpus import sql_text

    made = ["a = b / c / d; e = /[/]x/g.test(f)", "`a${`b${{c: 1}}`}d` + {e: `f`}", "x = '//' // y\n/* z */ w", "return /q\\//u; i++ / 2", "'open\nnext `$$${1}$`"]
    bodies = [body for _, _, body, _ in case_rows()] + made
    rows = ", ".join(f"({no}, 'a{no}.ts', {sql_text(b)}, '')" for no, b in enumerate(bodies))
    sql = f"WITH RECURSIVE cases(case_no, path_text, body_text, note) AS (VALUES {rows}), {script_tokens_sql()}"
    got = duckdb.sql(f"{sql} SELECT case_no, list(text ORDER BY step) FROM kinds GROUP BY case_no").fetchall()
    assert dict(got) == {no: js_cut(b.replace("@@ID@@", "7")) for no, b in enumerate(bodies)}
