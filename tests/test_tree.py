"""The tree reader: hidden files, pushed filters, errors, two levels, and changes as a stream."""

import os
import time

import pytest
from pyspark.sql import functions as F

from codesift.plans.audit import Audit
from codesift.sources import tree
from codesift.sources.tree import SourceTree, read_tree

FILES = {
    "one/.env": "A=1\n", "one/.github/workflows/ci.yml": "permissions: write-all\n", "one/node_modules/x.js": "x", "one/a/b/c.js": "eval(x)\n",
    "two/_a.go": "package a\n", "two/docs/x.md": "x\n",
}


@pytest.fixture
def root(spark, tmp_path):
    for path, body in FILES.items():
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(body)
    os.symlink(tmp_path / "two/_a.go", tmp_path / "two/link.go")
    spark.dataSource.register(SourceTree)
    return tmp_path


def load(spark, root):
    return spark.read.format("source_tree").option("root", str(root)).load()


def test_hidden_files_are_read_and_dependencies_are_not(spark, root):
    got = {(r.repo, r.path, r.ext, r.symlink) for r in load(spark, root).collect()}
    assert got == {
        ("one", ".env", ".env", False), ("one", ".github/workflows/ci.yml", ".yml", False), ("one", "a/b/c.js", ".js", False),
        ("two", "_a.go", ".go", False), ("two", "link.go", ".go", True), ("two", "docs/x.md", ".md", False),
    }
    found = Audit(load(spark, root)).raw("generic").select("rule_id").collect()
    assert sorted(r.rule_id for r in found) == ["G001", "G010"]


def test_two_levels_give_the_same_rows(spark, root):
    assert sorted(map(tuple, read_tree(spark, str(root)).collect())) == sorted(map(tuple, load(spark, root).collect()))


def test_filters_reach_the_walk(spark, root):
    files = load(spark, root)
    cases = {
        "repo = 'two'": {"_a.go", "link.go", "docs/x.md"}, "ext in ('.js', '.md')": {"a/b/c.js", "docs/x.md"}, "path = '.env'": {".env"},
        "startswith(path, 'a/')": {"a/b/c.js"}, "ext = '.go' and not symlink": {"_a.go"}, "size < 5": {".env", "docs/x.md"},
    }
    for test, want in cases.items():
        some = files.where(test)
        assert {r.path for r in some.collect()} == want, test
    plan = files.where("ext = '.js' and startswith(path, 'a/')")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "= .js" not in plan  # applied by the walk alone


def test_what_cannot_be_listed_or_read_is_a_row(spark, tmp_path, monkeypatch):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.js").write_text("x")
    real_scan = os.scandir

    def scan(path):
        if str(path).endswith("one"):
            raise PermissionError
        return real_scan(path)

    monkeypatch.setattr(tree.os, "scandir", scan)
    rows = [*tree.walk(str(tmp_path), "one", "", True, tree.Wanted())]
    assert [(r[1], r[9]) for r in rows] == [("one", True)]
    monkeypatch.undo()

    def refuse(*_, **__):
        raise OSError

    monkeypatch.setitem(tree.__dict__, "open", refuse)
    (row,) = tree.walk(str(tmp_path), "one", "", True, tree.Wanted())
    assert row[3] is None and row[8] and not row[7]
    columns = [f.name for f in tree.ARROW]
    files = spark.createDataFrame([rows[0], row], tree.SCHEMA).select(*columns)
    audit = Audit(files)
    assert {r.skip_reason for r in audit.inventory.where("path = 'one'").collect()} == {"walk_error"}
    assert audit.kept.where("read_error").count() == 1
    assert {r.message for r in audit.warnings.collect()} == {"1 files could not be read, so the analyzer stopped", "could not read x.js"}


def test_changes_come_as_a_stream(spark, root, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp(n)) for n in ("out", "state"))

    def run():
        read = spark.readStream.format("source_tree").option("root", str(root)).option("settle_seconds", 0).load()
        query = read.select("repo", "path", "content").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema("repo string, path string, content string").parquet(out)

    time.sleep(0.05)
    assert run().count() == len(FILES)  # one is a dependency, one a link
    (root / "one/a/b/c.js").write_text("changed\n")
    (root / "three").mkdir()
    (root / "three/new.js").write_text("new\n")
    time.sleep(0.05)
    got = run()
    assert got.count() == len(FILES) + 2
    assert {r.content for r in got.where(F.col("path").isin("a/b/c.js", "new.js")).collect()} == {"eval(x)\n", "changed\n", "new\n"}
