"""Streams of file versions: what a new version of a file takes back, and what files that
land apart say together.

Two hops with a change log between them.  The first keeps, per file, the facts of its last
version (findings, open container stages, scripts that drop privileges); a newer version
adds what is new and takes back what is gone, an older or repeated one changes nothing.
The second keeps, per repository and script name, how many scripts have it and which stages
ask for it, so that a stage is excused as soon as both have landed, in whatever order and
batch, and no longer when the last such script goes.  Sums over the logs are the state of
the corpus; they are the same for any order and any cut into batches.

Both are arbitrary state operators on the RocksDB store: state lies on disk and in the
checkpoint, so a lost executor loses none of it.  A file's facts are bounded by its text.
A call of an operator, its frames and its state's key cost as much as hundreds of versions,
so files and names are dealt to slots by their hash and a call serves a slot; inside, each
file and name has an entry of its own, and only entries that a batch tells of are asked for.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codesift.operators.findings import attach_analyzer, normalize
from codesift.operators.inventory import analysed, inventory, is_shell_like
from codesift.operators.rules_generic import open_stages, privilege_dropping_scripts, script_names, text_files
from codesift.session import shared_dir
from codesift.streaming.scan import drain, land, landed_files, line_findings

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACT = "line int, rule_id string, verdict string, evidence string, name string"
CHANGES = f"repo string, path string, kind string, fact_key string, op int, {FACT}"
EXCUSES = "repo string, path string, op int"
# Fixed value: the longest base name that common file systems allow.
NAME_LIMIT = 255
# Groups of files and of names; part of the state, so a checkpoint holds for this number only.
SLOTS = 1024
# Fixed value: a version without a time is older than all others.
NEVER = -(1 << 62)


def _slot(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(SLOTS)).cast("int").alias("slot")


def file_facts(files: DataFrame) -> DataFrame:
    """A row per landed version (kind ``file``) and per fact of it, all with its time.

    Findings carry their fingerprint as key, so equal ones of a file are one fact, the first.
    """
    kept = inventory(files, carry=("ingest_ts",))
    texts = text_files(analysed(kept))
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in FACT.split(", ")}
    order = ["phase", "pos", "rule_no"]

    def shaped(df: DataFrame, kind: str, key, **columns) -> DataFrame:
        own = {**none, "phase": F.lit(0), "pos": F.lit(0), "rule_no": F.lit(0)} | columns
        return df.select("repo", "path", "ingest_ts", F.lit(kind).alias("kind"), key.alias("fact_key"), *[c.alias(n) for n, c in own.items()])

    found = normalize(attach_analyzer(line_findings(files, "ingest_ts")))
    told = {c: F.col(c) for c in ["rule_id", "verdict", "evidence", *order]} | {"line": F.col("line").cast("int")}
    stages = open_stages(texts, "ingest_ts")
    scripts = privilege_dropping_scripts(texts, "path", "ingest_ts")
    parts = [
        shaped(files, "file", F.lit("")),
        shaped(found, "finding", F.col("fingerprint"), **told),
        shaped(stages, "stage", F.lit("stage"), line=F.col("line").cast("int"), evidence=F.col("evidence"), name=F.col("entry")),
        shaped(scripts, "script", F.lit("script"), name=F.col("script")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def differences(held: dict, fresh: dict) -> list[tuple]:
    """(op, key, fact): held facts that go, then fresh ones that come."""
    gone = [(-1, k, v) for k, v in held.items() if fresh.get(k) != v]
    return gone + [(1, k, v) for k, v in fresh.items() if held.get(k) != v]


class LastVersion(StatefulProcessor):
    """Facts of the last version of a file; gives out what changes.  For streams keyed by file."""

    columns = [c.split()[0] for c in FACT.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "at timestamp")
        self.facts = handle.getMapState("facts", "kind string, fact_key string", FACT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        some = pd.concat(parts) if len(parts) > 1 else parts[0]
        newest = some["ingest_ts"].max()
        since = self.since.get()
        if since is not None and pd.Timestamp(since[0]) > newest:
            return
        # Each question to the state is a message: a time is told only when it moves, a new file has no facts.
        if since is None or pd.Timestamp(since[0]) != newest:
            self.since.update((newest.to_pydatetime(),))
        fresh: dict[tuple, tuple] = {}
        told = some["kind"] != "file"
        if told.any():
            now = some[(some["ingest_ts"] == newest) & told].sort_values(["phase", "pos", "rule_no"], kind="stable")
            for row in now.itertuples():
                fresh.setdefault((row.kind, row.fact_key), tuple(self.plain(getattr(row, c)) for c in self.columns))
        held = {} if since is None else {tuple(k): tuple(v) for k, v in self.facts.iterator()}
        out = []
        for op, k, v in differences(held, fresh):
            out.append((*key, *k, op, *v))
            if op < 0:
                self.facts.removeKey(k)
            else:
                self.facts.updateValue(k, v)
        if out:
            yield pd.DataFrame(out, columns=["repo", "path", "kind", "fact_key", "op", *self.columns]).astype({"line": "Int32"})

    @staticmethod
    def plain(value):
        return None if pd.isna(value) else int(value) if not isinstance(value, str) else value

    def close(self) -> None:
        pass


class LastVersions(StatefulProcessor):
    """The same for the files of a slot: an entry per file, with its time and its facts."""

    columns = ["repo", "path", "at", "kind", "fact_key", "phase", "pos", "rule_no", *LastVersion.columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "repo string, path string", "at bigint, facts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        plain = LastVersion.plain
        newest: dict[tuple, tuple[int, list]] = {}  # file: time and facts of its newest version here
        for part in rows:
            for repo, path, at, kind, *rest in zip(*(part[c].tolist() for c in self.columns), strict=True):
                file = (plain(repo), plain(path))
                if file not in newest or newest[file][0] < at:
                    newest[file] = (at, [])
                if kind != "file" and newest[file][0] == at:
                    newest[file][1].append((kind, *rest))
        out = []
        for file, (at, told) in newest.items():
            # Two messages to the state for a newer version, one for an older or repeated one.
            since, facts = self.files.getValue(file) or (None, None)
            if since is not None and since > at:
                continue
            fresh: dict[tuple, tuple] = {}
            for kind, fact_key, _, _, _, *fact in sorted(told, key=lambda row: row[2:5]):
                fresh.setdefault((kind, fact_key), tuple(map(plain, fact)))
            held = {(kind, fact_key): tuple(fact) for kind, fact_key, *fact in json.loads(facts)} if facts else {}
            moved = differences(held, fresh)
            if moved or since != at:
                self.files.updateValue(file, (at, json.dumps([(*k, *v) for k, v in fresh.items()]) if fresh else None))
            out += [(*file, *k, op, *v) for op, k, v in moved]
        if out:
            yield pd.DataFrame(out, columns=["repo", "path", "kind", "fact_key", "op", *LastVersion.columns]).astype({"line": "Int32"})

    def close(self) -> None:
        pass


def file_changes(files: DataFrame) -> DataFrame:
    """The change log of a stream of file versions, as CHANGES."""
    facts = file_facts(files).select("*", _slot("repo", "path"), F.coalesce(F.unix_micros("ingest_ts"), F.lit(NEVER)).alias("at"))
    return facts.drop("ingest_ts").groupBy("slot").transformWithStateInPandas(
        statefulProcessor=LastVersions(), outputStructType=CHANGES, outputMode="Append", timeMode="None"
    )


class ScriptNames(StatefulProcessor):
    """Scripts of each name that drop privileges, and stages that ask for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "repo string, name string", "scripts int, asked boolean")
        self.stages = handle.getMapState("stages", "repo string, name string, path string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        scripts, stages, plain = Counter(), Counter(), LastVersion.plain
        for part in rows:
            for repo, name, path, kind, op in zip(*(part[c].tolist() for c in ("repo", "name", "path", "kind", "op")), strict=True):
                if kind == "script":
                    scripts[plain(repo), name] += op
                else:
                    stages[plain(repo), name, plain(path)] += op
        moved: dict[tuple, list] = {k: [] for k in scripts}
        for (*name, path), n in stages.items():
            moved.setdefault(tuple(name), []).append((path, n))
        counts, turned = {}, {}
        for name, paths in moved.items():
            before, asked = self.names.getValue(name) or (0, False)
            after, now = before + scripts[name], asked or any(n > 0 for _, n in paths)
            counts[name] = before, after, asked
            if (after, now) != (before, asked):
                self.names.updateValue(name, (after, now))
            if asked and (before > 0) != (after > 0):
                turned[name] = set()
        # All stages of a name matter only where it gets its first script or loses its last one.
        for *name, path in self.stages.keys() if turned else ():
            if tuple(name) in turned:
                turned[tuple(name)].add(path)
        out = []
        for name, paths in moved.items():
            before, after, asked = counts[name]
            excused_before = set(turned.get(name, ()) if before > 0 else ())
            excused_now = set(turned.get(name, ()) if after > 0 else ())
            for path, n in paths:
                if n == 0:
                    continue
                # Without a script before and after, whether a new stage was there says nothing.
                asks = asked and (n < 0 or before > 0 or after > 0)
                was = path in turned[name] if name in turned else asks and self.stages.containsKey((*name, path))
                if n > 0 and not was:
                    self.stages.updateValue((*name, path), (1,))
                elif n < 0 and was:
                    self.stages.removeKey((*name, path))
                if was and before > 0:
                    excused_before.add(path)
                if n > 0 and after > 0:
                    excused_now.add(path)
                else:
                    excused_now.discard(path)
            out += [(name[0], p, 1) for p in excused_now - excused_before] + [(name[0], p, -1) for p in excused_before - excused_now]
        if out:
            yield pd.DataFrame(out, columns=["repo", "path", "op"])

    def close(self) -> None:
        pass


def excuses(changes: DataFrame) -> DataFrame:
    """From a stream of changes: stages that a script excuses (+1) or no longer does (-1)."""
    scripts = changes.where("kind = 'script'").select("repo", "name", "path", "kind", "op")
    stages = changes.where("kind = 'stage' and name is not null").select(
        "repo", "path", "op", F.col("name").alias("entry"), F.sequence(F.lit(1), F.lit(NAME_LIMIT)).alias("lengths")
    )
    asked = script_names(stages, "repo", "path", "op").select("repo", F.col("script").alias("name"), "path", F.lit("stage").alias("kind"), "op")
    return scripts.unionByName(asked).select("*", _slot("repo", "name")).groupBy("slot").transformWithStateInPandas(
        statefulProcessor=ScriptNames(), outputStructType=EXCUSES, outputMode="Append", timeMode="None"
    )


def current(log: DataFrame, *names: str) -> DataFrame:
    """Rows of a change log that were added and not taken back."""
    return log.groupBy(*names).agg(F.sum("op").alias("held")).where("held > 0").drop("held")


def findings_now(changes: DataFrame) -> DataFrame:
    return current(changes.where("kind = 'finding'"), "repo", "path", "fact_key", "rule_id", "line", "evidence", "verdict")


def stages_now(changes: DataFrame, excused: DataFrame) -> DataFrame:
    """G015 as of now: open stages that no script excuses."""
    stages = current(changes.where("kind = 'stage'"), "repo", "path", "line", "evidence")
    return stages.join(current(excused, "repo", "path"), ["repo", "path"], "left_anti")


def summary_now(changes: DataFrame) -> DataFrame:
    """Counts per repo; findings that were taken back cancel out, so this is a plain sum over
    the log and combines map-side."""
    op = F.col("op")
    found = changes.where("kind = 'finding'").groupBy("repo").agg(
        F.sum(op).alias("total"), *[F.coalesce(F.sum(F.when(F.col("verdict") == v, op)), F.lit(0)).alias(v) for v in ("needs_validation", "hardening")]
    )
    return found.where("total > 0")


class Folders:
    """A run's folders: landing, logs and checkpoints, all in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_dir(spark, f"versions-{uuid.uuid4().hex[:12]}")
        for name, schema in (("changes", CHANGES), ("excuses", EXCUSES)):
            spark.createDataFrame([], schema).write.parquet(f"{self.base}/{name}")  # an empty stream leaves an empty log

    @property
    def landing(self) -> str:
        return f"{self.base}/landing"

    def log(self, name: str) -> DataFrame:
        return self.spark.read.schema(CHANGES if name == "changes" else EXCUSES).parquet(f"{self.base}/{name}")

    def _run(self, rows: DataFrame, name: str) -> None:
        # A retried batch overwrites its own folder; readers take all batches.
        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={number}")

        keeps = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        try:
            drain(rows.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{self.base}/{name}-state").trigger(availableNow=True).start())
        finally:
            if keeps is None:
                self.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
            else:
                self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", keeps)

    def catch_up(self, files_per_trigger: int = 100) -> None:
        """Bring the change log up to what has landed."""
        self._run(file_changes(landed_files(self.spark, self.landing, files_per_trigger=files_per_trigger)), "changes")

    def catch_up_excuses(self, files_per_trigger: int = 100) -> None:
        """Bring the excuses up to the change log, read as a stream of its own."""
        read = self.spark.readStream.schema(f"{CHANGES}, batch int").option("maxFilesPerTrigger", files_per_trigger)
        self._run(excuses(read.parquet(f"{self.base}/changes").drop("batch")), "excuses")


def _emptied(files: DataFrame, share: int) -> DataFrame:
    return files.where(F.col("doc_id") % share == 0).withColumn("content", F.lit(""))


def retractions_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary after every file landed twice and every third document's files were emptied."""
    from codesift.plans.corpus import code_files

    files, run = code_files(spark, sf_dir), Folders(spark)
    for hour, some in enumerate((files, files, _emptied(files, 3))):
        land(some, run.landing, hour)
        run.catch_up()
    return summary_now(run.log("changes"))


def stages_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G015 where container files land first, their scripts later, and the scripts of every
    second document are emptied in the end."""
    from codesift.plans.corpus import code_files

    files, run = code_files(spark, sf_dir), Folders(spark)
    shell = is_shell_like(F.col("path"))
    for hour, some in enumerate((files.where(~shell), files.where(shell), _emptied(files.where(shell), 2))):
        land(some, run.landing, hour)
        run.catch_up()
        run.catch_up_excuses()
    return stages_now(run.log("changes"), run.log("excuses"))
