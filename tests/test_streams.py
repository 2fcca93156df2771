"""Streams of file versions: any order and any cut into batches gives the same state."""

import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codesift.operators.rules_generic import script_names
from codesift.streaming.scan import LANDING_SCHEMA
from codesift.streaming.versions import Folders, LastVersion, LastVersions, ScriptNames, findings_now, stages_now, summary_now

DROP = 'exec su-exec app "$@"\n'
IMAGE = 'FROM x\nENTRYPOINT ["/{}"]\n'
# (hour, repo, path, content)
LANDED = [
    (1, "a", ".env", "K=1\n"), (1, "a", "Dockerfile", IMAGE.format("run.sh")), (1, "a", "x.yml", "token: Ab3dEf6hIj9lMn2pQr5t\ntoken: Ab3dEf6hIj9lMn2pQr5t\n"),
    (2, "a", "ops/run.sh", DROP), (2, "b", "Dockerfile", IMAGE.format("run.sh")), (2, "a", "x.yml", "token: Zb3dEf6hIj9lMn2pQr5u\n"),
    (3, "b", "tools/run.sh", DROP), (3, "a", "ops/run.sh", "echo\n"), (4, "b", "Dockerfile", IMAGE.format("other.sh")),
    (5, "b", "run.sh", DROP), (5, "b", "Dockerfile", IMAGE.format("run.sh")), (6, "b", "tools/run.sh", "echo\n"), (7, "c", "Dockerfile", "FROM y\n"),
]


def write(spark, rows, path):
    full = [(r, p, c, len(c), h) for h, r, p, c in rows]
    df = spark.createDataFrame(full, "repo string, path string, content string, size long, hour long")
    df.withColumn("ingest_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("hour"))).select(*LANDING_SCHEMA.names).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    told = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", told)


def states_of(spark, batches):
    """What holds after each batch: findings, repos with an open stage, totals."""
    run = Folders(spark)
    for rows in batches:
        write(spark, rows, run.landing)
        run.catch_up()
        run.catch_up_excuses()
        changes = run.log("changes")
        found = {(r["repo"], r["path"], r["rule_id"], r["line"]) for r in findings_now(changes).collect()}
        stages = {r["repo"] for r in stages_now(changes, run.log("excuses")).collect()}
        yield found, stages, {r["repo"]: r["total"] for r in summary_now(changes).collect()}


def test_order_and_batches_do_not_matter(spark):
    want = ({("a", ".env", "G001", 1), ("a", "x.yml", "G007", 1)}, {"a", "c"}, {"a": 2})
    shuffled = LANDED + LANDED[:6]
    random.Random(3).shuffle(shuffled)
    assert [*states_of(spark, [LANDED])][-1] == want
    assert [*states_of(spark, [shuffled[:7], shuffled[7:]])][-1] == want


def test_a_script_excuses_while_it_is_there(spark):
    batches = [[], LANDED[:2], LANDED[3:4], LANDED[7:8]]
    assert [x[1] for x in states_of(spark, batches)] == [set(), {"a"}, set(), {"a"}]


def test_names_in_a_long_entrypoint_line(spark):
    import time

    line = "entrypoint " + "/a.sh/" * 100_000 + "run.bash"
    rows = spark.createDataFrame([("r", line, [4, 8])], "repo string, entry string, lengths array<int>")
    start = time.time()
    got = {r["script"] for r in script_names(rows, "repo").collect()}
    assert got == {"a.sh", "run.bash", "bash"} and time.time() - start < 20


def test_few_messages_to_the_state_per_version():
    # Every question to the state is a message; files without findings asked four times per version.
    class Held:
        def __init__(self):
            self.value, self.pairs, self.asked = None, {}, 0

        def get(self):
            self.asked += 1
            return self.value

        def exists(self):
            self.asked += 1
            return self.value is not None or bool(self.pairs)

        def update(self, value):
            self.asked += 1
            self.value = value

        def iterator(self):
            self.asked += 1
            return iter(list(self.pairs.items()))

        def updateValue(self, key, value):
            self.pairs[key] = value

        def removeKey(self, key):
            del self.pairs[key]

    def version(hour, *facts):
        rows = [{"kind": "file", "fact_key": ""}, *facts]
        blank = {"ingest_ts": pd.Timestamp(hour, unit="h"), "phase": 0, "pos": 0, "rule_no": 0, **dict.fromkeys(LastVersion.columns)}
        return iter([pd.DataFrame([blank | r for r in rows])])

    def said(state, *args):
        return [tuple(x) for out in state.handleInputRows(("r", "p"), version(*args), None) for x in out[["fact_key", "op"]].itertuples(index=False)]

    state = LastVersion()
    state.since, state.facts = Held(), Held()
    assert said(state, 2) == [] and state.since.asked + state.facts.asked <= 2
    assert said(state, 2) == [] and state.since.asked + state.facts.asked <= 4
    assert said(state, 3, {"kind": "finding", "fact_key": "x", "line": 1}) == [("x", 1)]
    assert said(state, 1, {"kind": "finding", "fact_key": "y", "line": 1}) == []
    assert said(state, 4) == [("x", -1)] and state.facts.pairs == {}


class Entries:
    """A map state in memory that counts messages."""

    def __init__(self):
        self.pairs, self.asked = {}, 0

    def getValue(self, key):
        self.asked += 1
        return self.pairs.get(key)

    def containsKey(self, key):
        self.asked += 1
        return key in self.pairs

    def updateValue(self, key, value):
        self.asked += 1
        self.pairs[key] = value

    def removeKey(self, key):
        self.asked += 1
        del self.pairs[key]

    def keys(self):
        self.asked += 1
        return iter(list(self.pairs))


def last_versions():
    state = LastVersions()
    state.files = Entries()
    return state


def frame(rows, columns):
    return pd.DataFrame([dict.fromkeys(columns) | {"phase": 0, "pos": 0, "rule_no": 0} | r for r in rows], columns=columns)


def rows_of(out):
    return [tuple(None if pd.isna(x) else x for x in row) for df in out for row in df.itertuples(index=False)]


def test_one_call_serves_the_files_of_a_slot():
    # A call per file took some five milliseconds for each version; two messages per new version are left.
    state = last_versions()
    files = [{"repo": None if i % 7 == 0 else "r", "path": f"p{i}", "at": 5, "kind": "file", "fact_key": ""} for i in range(500)]
    facts = [f | {"kind": "finding", "fact_key": "x", "line": 3} for f in files[:50]]
    out = rows_of(state.handleInputRows((1,), iter([frame(files + facts, LastVersions.columns)]), None))
    assert len(out) == 50 and state.files.asked == 1000
    assert rows_of(state.handleInputRows((1,), iter([frame(files + facts, LastVersions.columns)]), None)) == [] and state.files.asked == 1500


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_of_many_files_add_up_to_their_last_versions(seed):
    rnd, state, log, landed = random.Random(seed), last_versions(), collections.Counter(), {}
    for _ in range(30):
        rows = []
        for _ in range(rnd.randint(1, 12)):
            repo, path, at = rnd.choice(["r", "s", None]), rnd.choice("abc"), rnd.randint(0, 40)
            made = random.Random(f"{repo}{path}{at}")  # a version of a time is always the same
            facts = {("finding", k): (made.randint(1, 3), None, made.choice(["é\"", None]), "e", None) for k in made.sample("xyz", made.randint(0, 3))}
            landed.setdefault((repo, path), {})[at] = facts
            own = {"repo": repo, "path": path, "at": at}
            rows.append(own | {"kind": "file", "fact_key": ""})
            for (kind, key), fact in facts.items():
                rows.append(own | {"kind": kind, "fact_key": key, **dict(zip(LastVersion.columns, fact, strict=True))})
                # A later finding with the same print says nothing.
                rows.append(own | {"kind": kind, "fact_key": key, "pos": 1, "line": 99})
        rnd.shuffle(rows)
        parts = iter([frame(rows[:5], LastVersions.columns), *([frame(rows[5:], LastVersions.columns)] if rows[5:] else [])])
        for repo, path, kind, key, op, *fact in rows_of(state.handleInputRows((1,), parts, None)):
            log[(repo, path, kind, key, *fact)] += op
        want = {(*f, *k, *v) for f, versions in landed.items() for k, v in versions[max(versions)].items()}
        assert {k for k, n in log.items() if n} == want and set(log.values()) <= {0, 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_excuses_of_many_names_add_up(seed):
    rnd, state, log = random.Random(seed), ScriptNames(), collections.Counter()
    state.names, state.stages = Entries(), Entries()
    scripts, stages = set(), set()
    for _ in range(60):
        rows = []
        for _ in range(rnd.randint(1, 6)):
            repo, name, path, kind = rnd.choice(["r", None]), rnd.choice("mn"), rnd.choice("abc"), rnd.choice(["script", "stage"])
            held = scripts if kind == "script" else stages
            op = -1 if (repo, name, path) in held else 1
            (held.discard if op < 0 else held.add)((repo, name, path))
            rows.append({"repo": repo, "name": name, "path": path, "kind": kind, "op": op})
        out = state.handleInputRows((1,), iter([pd.DataFrame(rows)]), None)
        for repo, path, op in rows_of(out):
            log[repo, path] += op
        there = {s[:2] for s in scripts}
        assert +log == collections.Counter((r, p) for r, n, p in stages if (r, n) in there)
        assert set(state.stages.pairs) == stages
