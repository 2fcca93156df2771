"""Flow inside files: passes and graphs against brute force, and inputs that once took too long."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codesift.operators import flow, sweeps
from codesift.operators.code_js import ScriptTables
from codesift.operators.inventory import file_key
from codesift.operators.tokens import ScriptCut, js_cut
from codesift.plans.audit import Audit


def audit_of(spark, *texts, ext="js"):
    rows = [(f"r{i}", f"a.{ext}", t) for i, t in enumerate(texts)]
    return Audit(spark.createDataFrame(rows, "repo string, path string, content string"))


def rules_of(spark, *texts, ext="js"):
    pack = "go" if ext == "go" else "javascript-typescript"
    out = [set() for _ in texts]
    for r in audit_of(spark, *texts, ext=ext).raw(pack).collect():
        out[int(r["repo"][1:])].add(r["rule_id"])
    return out


# ---- graphs --------------------------------------------------------------------------------


def random_bindings(rnd, n=12, names="abcd"):
    out = []
    for pos in range(n):
        refs = [{"pos": b["pos"], "name": b["name"]} for b in out if rnd.random() < 0.3]
        out.append({"pos": pos, "name": rnd.choice(names), "src": rnd.random() < 0.15, "refs": refs})
    return out


def brute_reached(bindings):
    by = {b["pos"]: b for b in bindings}

    def hit(pos, met):
        b = by[pos]
        return b["name"] not in met and (b["src"] or any(hit(r["pos"], met | {b["name"]}) for r in b["refs"]))

    return {(b["pos"], b["name"]) for b in bindings if hit(b["pos"], frozenset())}


def test_reachability_equals_walking_all_paths():
    rnd = random.Random(4)
    for _ in range(400):
        bindings = random_bindings(rnd, names=rnd.choice(["ab", "abcd", "abcdefgh"]))
        assert set(flow.reached(bindings)) == brute_reached(bindings)


def test_safe_values_equal_walking_all_paths():
    rnd = random.Random(5)
    for _ in range(400):
        bindings = [{"pos": b["pos"], "name": b["name"], "refs": [r["pos"] for r in b["refs"]] + ([99] if rnd.random() < 0.1 else [])} for b in random_bindings(rnd, names="abcdefgh")]
        by = {b["pos"]: b for b in bindings}

        def safe(pos, met, by=by):
            return pos in by and by[pos]["name"] not in met and all(safe(r, met | {by[pos]["name"]}) for r in by[pos]["refs"])

        assert flow.all_safe(bindings) == [b["pos"] for b in bindings if safe(b["pos"], frozenset())]


def test_chains_stop_before_a_name_met_already():
    rnd = random.Random(6)
    for _ in range(300):
        names = [rnd.choice("abcdef") for _ in range(14)]
        up = {p: rnd.randrange(p) for p in range(1, 14) if rnd.random() < 0.85}
        links = [{"pos": p, "name": names[p], "to_pos": t, "to_name": names[t]} for p, t in up.items()]

        def end(p, up=up, names=names):
            met = {names[p]}
            while p in up and names[up[p]] not in met:
                p = up[p]
                met.add(names[p])
            return p

        assert sorted(flow.chain_ends(links)) == sorted((p, names[p], end(p), names[end(p)]) for p in up)


@pytest.mark.parametrize("layers", [14, 40, 2000])
def test_diamonds_are_decided_in_linear_time(layers):
    bindings, last = [{"pos": 0, "name": "s", "src": True, "refs": []}], [(0, "s")]
    for i in range(1, layers + 1):
        here = []
        for name in (f"x{i}", f"y{i}"):
            for _ in range(2):
                bindings.append({"pos": len(bindings), "name": name, "src": False, "refs": [{"pos": p, "name": n} for p, n in last]})
                here.append((bindings[-1]["pos"], name))
        last = here
    start = time.time()
    assert len(flow.reached(bindings)) == len(bindings) and time.time() - start < 2


def test_long_chains_of_aliases_are_followed_in_linear_time():
    links = [{"pos": i, "name": f"n{i}", "to_pos": i - 1, "to_name": f"n{i - 1}"} for i in range(1, 50_000)]
    start = time.time()
    assert set(flow.chain_ends(links)) == {(i, f"n{i}", 0, "n0") for i in range(1, 50_000)} and time.time() - start < 2


def test_taint_of_layers_and_of_a_name_set_from_itself(spark):
    lines = ["const s0 = req.query.u;", "let a0 = s0, b0 = s0;"]
    for i in range(1, 41):
        lines += [f"let a{i} = a{i - 1} + b{i - 1};", f"a{i} = a{i - 1} + b{i - 1} + 'x';", f"let b{i} = b{i - 1} + a{i - 1};"]
    layered = "\n".join([*lines, "fetch(a40);"])
    clean = 'let t = req.query.u;\nt = t + "a";\nfetch(t);\n'
    assert rules_of(spark, layered, clean) == [{"JS008"}, set()]


def test_targets_that_a_loop_swaps_at_once(spark):
    body = "package a\nimport \"net/http\"\nfunc f(r *http.Request) {\n\tfor i, j := r.Host, \"x\"; i != j; i, j = j, i {\n\t\thttp.Get(i)\n\t}\n}\n"
    assert rules_of(spark, body, ext="go") == [{"GO007", "GO016"}]


# ---- nesting --------------------------------------------------------------------------------


def tables_of(spark, *texts):
    rows = [("r", f"f{i}.js", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    return ScriptTables(df.withColumns({"file_id": file_key(F.col("repo"), F.col("path")), "ext": F.lit(".js"), "is_test": F.lit(False)}))


def test_deep_nesting_costs_no_row_per_level(spark):
    deep = 1000
    text = "const u = req.query.u;\n" + "".join(f"if (a{i}) {{ let v{i} = u;\n" for i in range(deep)) + "fetch(v0); fetch(v999);" + "}" * deep
    t = tables_of(spark, text)
    assert t.tokens.count() < 20 * deep
    assert t.bindings.count() <= 2 * deep + 1
    points = t.tokens.where("kind = 'ident'").select("file_id", "idx", "bl", F.col("idx").alias("point_id"), F.col("text").alias("name"))
    assert t.see(points).count() <= points.count()
    hits = [r["idx"] for r in t.tainted_sinks(t.calls.where("p1 = 'fetch'").select(
        "file_id", F.col("open_idx").cast("string").alias("sink_id"), F.col("open_idx").alias("idx"), "bl", F.col("s0").alias("s"), F.col("e0").alias("e"), "x_src",
    )).select(F.col("sink_id").alias("idx")).collect()]
    assert len(hits) == 2


def test_visible_bindings_equal_a_search_backwards(spark):
    rnd = random.Random(7)
    opened, points, bound, want = [], [], [], set()
    for file in range(6):
        stack, bindings = [], []
        for idx in range(200):
            name = rnd.choice("abc")
            kind = rnd.random()
            if kind < 0.2:
                opened.append((file, idx, len(stack), rnd.random() < 0.3))
                stack.append((idx, opened[-1][3]))
            elif kind < 0.4 and stack:
                stack.pop()
            elif kind < 0.65:
                bindings.append((idx, name, list(stack)))
                bound.append((file, idx, len(stack), idx, name, idx % 7 == 0))
            else:
                points.append((file, idx, len(stack), idx, name))
                at = max((i for i, (_, fn) in enumerate(stack) if fn), default=None)
                for in_function in (False, True):
                    seen = [p for p, n, s in bindings if n == name and s == stack[: len(s)] and (not in_function or (at is not None and len(s) > at))]
                    if seen:
                        want.add((in_function, file, idx, seen[-1]))
    frames = [spark.createDataFrame(rows, names).repartition(4) for rows, names in (
        (points, "file_id long, idx int, lv int, point_id int, name string"), (bound, "file_id long, at int, scope_level int, pos int, name string, is_barrier boolean"),
        (opened, "file_id long, idx int, lv int, is_fn boolean"))]
    got = {(f, r["file_id"], r["point_id"], r["pos"]) for f in (False, True) for r in sweeps.visible(*frames, "lv", in_function=f).collect()}
    assert got == want


def test_marks_in_spans_equal_testing_every_pair(spark):
    rnd = random.Random(8)
    spans = [(f, i, rnd.randrange(60)) for f in range(4) for i in range(60)]
    spans = [(f, i, s, s + rnd.choice([0, 1, 5, 30, 59])) for f, i, s in spans]
    marks = [(f, idx, rnd.choice("abc"), rnd.random() < 0.7, rnd.random() < 0.7) for f in range(4) for idx in range(80) if rnd.random() < 0.6]
    want = {(f, i, k) for f, i, s, e in spans for g, idx, k, first, inner in marks if f == g and s <= idx <= e and (first if idx == s else inner)}
    got = sweeps.marks_in_spans(
        spark.createDataFrame(spans, "file_id long, span int, start_idx int, end_idx int").repartition(3),
        spark.createDataFrame(marks, "file_id long, idx int, text string, as_first boolean, as_inner boolean"), "text", ["span"], ["text"],
    )
    assert {(r["file_id"], r["span"], r["text"]) for r in got.collect()} == want


def test_marks_outside_covers(spark):
    covers = spark.createDataFrame([(1, 2, 5), (1, 4, 8), (2, 0, 0)], "file_id int, start_idx int, end_idx int")
    marks = spark.createDataFrame([(f, i) for f in (1, 2, 3) for i in range(11)], "file_id int, idx int")
    got = {tuple(r) for r in flow.not_covered(marks, covers).collect()}
    assert got == {(f, i) for f in (1, 2, 3) for i in range(11)} - {(1, i) for i in range(2, 9)} - {(2, 0)}


# ---- inputs that were judged wrongly ---------------------------------------------------------------


def test_query_words_of_all_literals_of_an_expression(spark):
    texts = [
        'db.query("SELECT" + cols + "x");', 'const q = "SELECT" + cols + "x";\ndb.query(q);', 'db.query("ORDER" + "BY" + col + "y" );',
        'db.query("a" + cols + "b");', 'db.query("x ORDER" + "BY" + col + "y" );', "db.query(`SELECT${cols} `);",
    ]
    assert rules_of(spark, *texts) == [{"JS006"}, {"JS006"}, {"JS006"}, set(), {"JS006"}, set()]


def test_parameters_in_nested_patterns_hide_outer_names(spark):
    head = "const link = req.query.u;\n"
    texts = [
        head + "items.forEach(([a, [b, link]]) => fetch(link));", head + "items.forEach(([a, link]) => fetch(link));",
        head + "items.forEach((a, link) => { fetch(link); });", head + "items.forEach(([a, [b]]) => fetch(link));",
        # A pattern in braces before the name is no list the walk back can pass.
        head + "items.forEach(({ a }, link) => { fetch(link); });",
    ]
    assert rules_of(spark, *texts) == [set(), set(), set(), {"JS008"}, {"JS008"}]


def test_sensitive_names_outside_sanitizers(spark):
    body = "package a\nimport \"log\"\nfunc f() {\n%s\n}\n"
    texts = [body % x for x in ("\tlog.Println(redact(token))", "\tlog.Println(redact(a, token), token)", "\tlog.Println(b, mask(redact(token)), c)", "\tlog.Println(token, redact(x))")]
    assert rules_of(spark, *texts, ext="go") == [set(), {"GO010"}, set(), {"GO010"}]


# ---- cutting -----------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["/* " * 300_000, "`${" * 300_000, "${`" * 200_000 + "}" * 200_000, '\\"' * 400_000, "(/[" * 300_000, "x = '" + "\\'" * 400_000])
def test_cutting_is_linear(text):
    start = time.time()
    half = "".join(js_cut(text[: len(text) // 2]))
    middle = time.time()
    assert "".join(js_cut(text)) == text and half == text[: len(text) // 2]
    assert time.time() - middle < 4 * (middle - start) + 1


def test_unreadable_characters_are_counted_in_the_same_pass():
    for text, errors in (("a = 1;", 0), ("a # b ✓ `", 3), ("'open\nx", 1), ("/* never", 0)):
        cut = ScriptCut(text)
        list(cut.pieces())
        assert cut.errors == errors, text
