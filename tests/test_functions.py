from pyspark.sql import functions as F

from codesift.functions import names, text
from codesift.operators import inventory as inv


def one(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_redaction_hides_the_value(spark):
    secret = "token=QwErTyUiOpAsDfGhJkLz"
    shown = one(spark, [secret, "  "], text.redact)
    assert "QwErTy" not in shown[0] and f"len={len(secret)}" in shown[0]
    assert shown[1] == "[redacted]"


def test_secret_shape(spark):
    rows = ["Zx9Cv8Bn7Mq6Wt5Er4", "short", "aaaaaaaaaaaaaaaaaaaa", "replace-with-your-key", "dev-Zx9Cv8Bn7Mq6Wt5", "Zx9Cv8Bn7 Mq6Wt5Er4"]
    assert one(spark, rows, text.looks_like_secret) == [True, False, False, False, False, False]


def test_fingerprint_ignores_line_and_spacing(spark):
    got = one(spark, ["a  b\tc", " a b c "], lambda v: text.fingerprint(F.lit("G001"), F.lit("x.go"), v))
    assert got[0] == got[1] and got[0].startswith("fp:") and len(got[0]) == 27


def test_patterns_modes_and_refs(spark):
    assert one(spark, ["^[A-Za-z0-9_-]+$", "^[a-zA-Z0-9_-]{2,8}$", "^[A-Za-z0-9_-]{0,8}$", "^[A-Za-z0-9_-]{9,8}$", "^.*$"], text.safe_segment_pattern) == [True, True, False, False, False]
    assert one(spark, ["0666", "0o777", "0644", "0x2", "438", "0b10", "x"], text.world_writable) == [True, True, False, True, True, True, False]
    assert one(spark, ["a" * 40, "a" * 39, "v4", "g" * 40], text.is_pinned_ref) == [True, False, False, False]


def test_names(spark):
    assert one(spark, ["sessionToken", "session_count", "csrf-value", "plain"], names.js_value_name) == [True, False, True, False]
    assert one(spark, ["tokenErr", "apiToken", "isSecret", "sessions"], names.go_log_name) == [False, True, False, False]
    assert one(spark, ["usedTokens", "tokenBudget", "accessToken", "hasCookie"], names.js_log_name) == [False, False, True, False]


def test_paths(spark):
    tests = ["a_test.go", "web/x.spec.tsx", "E2E/a.go", "pkg/testdata/a.txt", "x.test.mjs", "latest/a.go"]
    assert one(spark, tests, inv.is_test) == [True, True, True, True, False, False]
    assert one(spark, ["a/./b", "a/../b", "../x", "a//b", "a/b"], inv.normal_path) == ["a/b", "b", None, "a/b", "a/b"]
    assert one(spark, ["view.jsx", "service.tsx", "Dockerfile.prod", "a.zig"], inv.language) == ["javascript", "typescript", "dockerfile", "other"]
    assert one(spark, ["x/Vendor/a.go", "vendor", "src/bin.go"], inv.in_dependency_dir) == [True, False, False]


def test_words_are_found_anywhere_in_either_case(spark):
    from pyspark.sql import functions as F

    from codesift.functions.text import any_of, any_of_folded

    rows = spark.createDataFrame([("a GHP_ b",), ("ghp_",), ("x${y",), ("Todo",), ("-----X",), ("tod o",), ("]]",)], "t string")
    got = rows.select(any_of(F.col("t"), ["ghp_", "${", "-----", "]]"]), any_of_folded(F.col("t"), ["todo", "ghp_"])).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True), (True, False), (False, True), (True, False), (False, False), (True, False)]
