"""Token tables hold no more than what is read of them."""

from pyspark.sql import functions as F

from codesift.operators.code_go import LONG_LITERAL, GoTables
from codesift.operators.code_js import COUNTERS, ScriptTables
from codesift.operators.inventory import file_key
from codesift.operators.rules_js import GATES, js_pack, may_hold
from codesift.plans.audit import PACKS, Audit

LONG = "x" * (4 * LONG_LITERAL)


def files(spark, ext, *texts):
    rows = [("r", f"f{i}{ext}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    return df.withColumns({"file_id": file_key(F.col("repo"), F.col("path")), "ext": F.lit(ext), "is_test": F.lit(False)})


def test_long_go_literals_are_not_copied_to_neighbours(spark):
    text = f"package a\nconst notes = `{LONG}`\nvar other = \"{LONG}\" + `{LONG}`\nfunc f() {{ g(`{LONG}`, \"b\") }}\n"
    rows = GoTables(files(spark, ".go", text)).rows
    around = [c for c in rows.columns if c[0] in "pn" and c[1:].isdigit()]
    sizes = rows.select(*[F.max(F.octet_length(c)).alias(c) for c in around if c != "n1"]).first()
    assert max(sizes) <= LONG_LITERAL
    # In full where a call's argument is read, and nowhere else.
    held = rows.where(F.octet_length("n1") > LONG_LITERAL).select("text", "n1").distinct().collect()
    assert [tuple(r) for r in held] == [("(", f"`{LONG}`")]
    assert rows.where((F.col("kind") == "string") & (F.octet_length("text") > LONG_LITERAL)).select("text").distinct().count() == 2


def test_values_of_long_go_literals_count(spark):
    deep = "/a" * LONG_LITERAL
    head = 'package a\nimport "os/exec"\n'
    body = head + 'func f(d string) {{ exec.Command("{}", "-c", "run "+d) }}\n'
    rows = [(name, "a.go", body.format(f"{deep}/{name}")) for name in ("bash", "cash")]
    found = Audit(spark.createDataFrame(rows, "repo string, path string, content string"), packs={"go": PACKS["go"]}).raw("go")
    assert {r["repo"] for r in found.where("rule_id = 'GO002'").collect()} == {"bash"}


def test_last_token_of_a_script_needs_no_aggregate(spark):
    t = ScriptTables(files(spark, ".js", "a = b", "const s = '';\nlet t = `${s}`", "f(x) // c\n", "", "// c"))
    plan = t.file_ends._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    want = t.tokens.groupBy("file_id").agg(F.max(F.struct("idx", "kind", *[f"c_{c}" for c in COUNTERS])).alias("e"))
    assert sorted(map(tuple, t.file_ends.select("file_id", "eof.*").collect())) == sorted(map(tuple, want.select("file_id", "e.*").collect()))


def test_ends_of_expressions_read_marks_only(spark):
    t = ScriptTables(files(spark, ".js", "a = f(b, {c: d})\ne = [g\n, h]; i = {j: k}", "x = y"))
    got = {tuple(r) for r in t.assigned.select("eq", "s", "e", "x_solid").collect()}
    assert got == {(1, 2, 11, 8), (13, 14, 18, 5), (21, 22, 26, 5), (1, 2, 2, 1)}
    eqs = t.tokens.where(F.col("text") == "=").select("file_id", "idx", "lv", *[f"c_{c}" for c in COUNTERS])
    plan = t.statement_spans(eqs)._jdf.queryExecution().optimizedPlan().toString()
    # Starts, their joined rows, marks, closers, ends and file ends; no join of closers with marks.
    assert plan.count("Join") == 3


def test_rules_asked_for_alone_cut_only_scripts_that_hold_their_words(spark):
    some = files(
        spark, ".js", "localStorage.setItem('userToken', x)", "#! localStorage\nsessionStorage.setItem('apiSecret', x)", "localStorage['setItem']",
        "a.postMessage(myToken, '*')", "eval(x); new Function(y)", "const key = {rejectUnauthorized: false}; nonceToken = Math.random()", "b = c", None,
    )
    shown = ["path", "rule_id", "variant", "line", "column", "evidence"]
    whole = ScriptTables(some)
    assert whole.rows.count() > 0
    every = sorted(map(tuple, js_pack(some, only=list(GATES), tables=whole).select(*shown).collect()))
    assert {r[1] for r in every} == set(GATES)
    for rule in GATES:
        t = ScriptTables(some)
        got = sorted(map(tuple, js_pack(some, only=[rule], tables=t).select(*shown).collect()))
        assert got == [r for r in every if r[1] == rule]
        assert "rows" not in t._made
    held = ScriptTables(some).holding("JS011", may_hold(["JS011"])).cuts
    assert sorted(r["path"] for r in held.select("path").collect()) == ["f0.js", "f1.js", "f2.js"]
    # Tokens that lie there already are read.
    assert whole.holding("JS011", may_hold(["JS011"])) is whole
