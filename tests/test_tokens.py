import time

from pyspark.sql import functions as F

from codesift.operators import tokens as tk
from codesift.operators.inventory import file_key


def files(spark, *texts):
    rows = [("r", f"f{i}.js", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    return df.withColumn("file_id", file_key(F.col("repo"), F.col("path"))).withColumn("ext", F.lit(".js"))


def shown(spark, text):
    return [(r.kind, r.text, r.line, r.col) for r in tk.js_tokens(files(spark, text)).orderBy("idx").collect()]


def test_regex_or_divide_and_positions(spark):
    got = shown(spark, "#!/bin/x\r\na = b / 2 / c; re = /[/]x/g\nreturn /y/")
    assert [k for k, *_ in got].count("regex") == 2
    assert got[0] == ("ident", "a", 2, 1) and ("regex", "/[/]x/g", 2, 21) in got


def test_regex_after_blanks_and_comments(spark):
    for gap in ("/* c */ ", " " * 70, "// c\n", "/* a */ // b:\n /* c */", ""):
        got = [(k, t) for k, t, *_ in shown(spark, f'const q = {gap}/["(]/; eval(z); const s = "x";')]
        assert ("regex", '/["(]/') in got and ("ident", "eval") in got and ("string", '"x"') in got, gap
        # After a name it stays a division, whatever the comment ends with.
        assert "regex" not in [k for k, *_ in shown(spark, f"a {gap}/ b / c")], gap


def test_regex_after_a_comment_hides_no_finding(spark):
    from codesift.plans.audit import Audit

    gaps = ("/* c */", " " * 70)
    rows = [(f"r{i}", "a.js", f'const q = {gap} /["(]/; eval(z); const s = "x";\n') for i, gap in enumerate(gaps)]
    deep = "eval(z)"
    for _ in range(8):
        deep = f"`a${{ {deep} }}b`"
    rows.append(("deep", "a.js", f"const q = {deep};\n"))
    found = Audit(spark.createDataFrame(rows, "repo string, path string, content string")).raw("javascript-typescript")
    assert {r["repo"] for r in found.where("rule_id = 'JS003'").collect()} == {"r0", "r1", "deep"}


def test_templates_of_any_depth(spark):
    text = "x"
    for i in range(40):
        text = f"`{i}${{ {{a: {text}}}.a }}z`"
    got = [k for k, *_ in shown(spark, text)]
    assert got.count("tstart") == got.count("tend") == 40 and got.count("template") == 0 and got.count("ident") == 81


def test_nested_templates(spark):
    got = [(k, t) for k, t, *_ in shown(spark, "`a${b + `c${d}` + {e: '}'}.e}f`")]
    assert got[0] == ("tstart", "`a${") and got[-1] == ("tend", "}f`") and ("tstart", "`c${") in got


def test_pieces_rebuild_the_text(spark):
    text = "x = `t ${y} u`; // é\n/* a\n b */ foo?.bar ?? 'q\\'s' ✓ ↑\n"
    df = tk.js_pieces(files(spark, text))
    assert df.select(F.array_join("pieces", "")).first()[0] == text


def test_go_statement_ends(spark):
    rows = tk.go_tokens(files(spark, "package a\n\nvar x = 1 // c\nfunc f() {\n}\n")).orderBy("idx").collect()
    assert [r.text for r in rows] == ["package", "a", ";", "var", "x", "=", "1", ";", "func", "f", "(", ")", "{", "}", ";"]


def test_long_lines_are_measured_in_one_pass(spark):
    # The last line of a piece was looked for again from each character of the lines before it.
    began = time.monotonic()
    text = "package a\nconst s = `é\n" + "x " * 200_000 + "\n`; var t = 1\n"
    got = {r.text[:3]: (r.line, r.col) for r in tk.go_tokens(files(spark, text)).select("text", "line", "col").collect()}
    assert got["var"] == (4, 4) and got["1"] == (4, 12) and got["`é\n"] == (2, 11)
    assert time.monotonic() - began < 30


def test_columns_behind_a_carriage_return(spark):
    rows = tk.go_tokens(files(spark, "package a\nconst s = `x\ny\rzé` + t\n")).where("text = 't'").collect()
    assert [(r.line, r.col) for r in rows] == [(3, 8)]
