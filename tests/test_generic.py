from codesift.operators.inventory import inventory
from codesift.operators.rules_generic import open_stages, stage_rule


def test_entrypoint_may_contain_the_script_name(spark):
    drop = "#!/bin/sh\nexec su-exec app \"$@\"\n"
    rows = [
        ("a", "Dockerfile", "FROM x\nENTRYPOINT [\"/docker-entrypoint.sh\"]\n"), ("a", "run/entrypoint.sh", drop),
        ("b", "Dockerfile", "FROM x\nENTRYPOINT [\"/entrypoint.sh\"]\n"), ("b", "docker-entrypoint.sh", drop),
        ("c", "Dockerfile", "FROM x\nENTRYPOINT [\"/bin/boot.sh\", \"Start.SH\"]\n"), ("c", "start.sh", drop),
    ]
    files = inventory(spark.createDataFrame(rows, "repo string, path string, content string"))
    assert [r.repo for r in stage_rule(files).collect()] == ["b"]


def test_lines_of_container_files_are_read_once(spark):
    # The optimizer copied the list of trimmed lines to every place that used it.
    rows = [("a", "Dockerfile", "from x\n  user y\nFrom z \nentrypoint [\"/a.sh\"]\n"), ("b", "Dockerfile", "FROM x\nUSER y\n"), ("c", "Dockerfile", "# x\n")]
    stages = open_stages(inventory(spark.createDataFrame(rows, "repo string, path string, content string")))
    assert [tuple(r) for r in stages.collect()] == [("a", "Dockerfile", 3, "From z", "entrypoint [\"/a.sh\"]")]
    assert stages._jdf.queryExecution().executedPlan().toString().count("transform(split(") == 1
