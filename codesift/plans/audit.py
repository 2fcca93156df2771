"""A whole audit as one object: inventory, packs, findings, summary and coverage."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.operators import coverage as cov
from codesift.operators import findings as fd
from codesift.operators.code_go import GoTables
from codesift.operators.code_js import ScriptTables
from codesift.operators.inventory import SCRIPT_EXTENSIONS, analysed, inventory, inventory_counts
from codesift.operators.rules_generic import generic_pack
from codesift.operators.rules_go import go_pack
from codesift.operators.rules_js import js_pack
from codesift.operators.tables import TableSet
from codesift.plans.corpus import code_files
from codesift.schema import GENERIC, GO, JS
from codesift.session import size_pieces

# The extension point: a pack maps an audit to raw findings.  Custom packs may
# add the columns analyzer, severity, tags and blocker.
Pack = Callable[["Audit"], DataFrame]


@dataclass(frozen=True)
class OwnPack:
    """A pack with all that an analyzer says about itself, so that coverage and events know it.

    ``run`` gives raw findings (RAW_COLUMNS, and severity, tags or blocker if wanted);
    ``looks_at`` is true for the analysed files it reads, and a repo without any is not
    applicable; ``classes`` are (attack class, status); ``rules`` have RULE_COLUMNS without
    the analyzer, which is the name the pack is registered under.
    """

    run: Pack
    looks_at: Column
    classes: tuple[tuple[str, str], ...]
    rules: tuple[tuple[str, ...], ...]
    detail: str = "files read"

    def __call__(self, audit: Audit) -> DataFrame:
        return self.run(audit)


class Audit(TableSet):
    """Tables of one corpus.  Tables that several results share are written when first asked
    for, which runs jobs; results themselves are lazy."""

    label = "audit"

    def __init__(self, files: DataFrame, packs: dict[str, Pack] | None = None, **options):
        super().__init__()
        self.started_ms = time.time_ns() // 1_000_000
        self.files = files
        # How files were found: with what a repository ignores marked, or all that is there.
        self.discovery_mode = "git" if "git_ignored" in files.columns and not options.get("include_ignored") else "filesystem"
        self.inventory = inventory(files, **options)
        self.packs = packs or PACKS

    @property
    def kept(self) -> DataFrame:
        return analysed(self.inventory)

    def _code(self) -> DataFrame:
        """Files that the code packs look at; tells the storage how much text there is."""
        code = self.kept
        if "read_error" in code.columns:
            code = code.where(~F.coalesce("read_error", F.lit(False)))
        size_pieces(code.sparkSession, code.agg(F.sum("size")).first()[0] or 0)
        return code

    @property
    def scripts(self) -> ScriptTables:
        return self._once("scripts", lambda: ScriptTables(self._once("code", self._code)))

    @property
    def go(self) -> GoTables:
        return self._once("go", lambda: GoTables(self._once("code", self._code)))

    def raw(self, *names: str) -> DataFrame:
        """Raw findings of the named packs (all by default), each written once."""
        wanted = names or tuple(self.packs)

        def found(name: str) -> DataFrame:
            out = self.packs[name](self)
            return out.withColumn("analyzer", F.lit(name)) if isinstance(self.packs[name], OwnPack) else out

        return fd.union_packs(self.all_of({f"raw_{n}": partial(found, n) for n in wanted}))

    @property
    def own(self) -> dict[str, OwnPack]:
        return {n: p for n, p in self.packs.items() if isinstance(p, OwnPack)}

    def all_of(self, makers):
        with ThreadPoolExecutor(len(makers)) as pool:
            jobs = [pool.submit(self._once, name, make, True, None) for name, make in makers.items()]
            return [job.result() for job in jobs]

    @property
    def raw_findings(self) -> DataFrame:
        return self.raw()

    @property
    def findings(self) -> DataFrame:
        """Deduplicated findings; those of an analyzer that a read failure stopped are left out."""

        def make() -> DataFrame:
            rules = [(r[0], r[1], name, *r[2:]) for name, pack in self.own.items() for r in pack.rules]
            found = fd.findings([self.raw_findings], rules)
            return cov.drop_blocked(found, self.unreadable) if "read_error" in self.files.columns else found

        return self._once("findings", make, True, None)

    @property
    def unreadable(self) -> DataFrame:
        """(repo, read_errors) of the repos with files that could not be read."""
        return self.counts.where("read_errors > 0").select("repo", "read_errors")

    @property
    def ran(self) -> DataFrame:
        """(repo, analyzer) that looked at the repo and finished."""
        stopped = cov.ran(self.counts).where("stopped").select("repo", "analyzer")
        return self.started.join(stopped, ["repo", "analyzer"], "left_anti")

    @property
    def started(self) -> DataFrame:
        """(repo, analyzer) of the packs that apply to the repo."""
        out = cov.ran(self.counts).where(F.col("analyzer").isin(list(self.packs))).select("repo", "analyzer")
        return out.unionByName(self.looked_at.where("files > 0").select("repo", "analyzer")) if self.own else out

    @property
    def accepted(self) -> DataFrame:
        return fd.accepted(self.findings, self.ran)

    @property
    def warnings(self) -> DataFrame:
        """(repo, analyzer, path, message): what an analyzer could not look at.  The generic one
        stops for the whole repo; the others leave the file out."""
        said = F.concat(F.lit("could not read "), F.col("path"))
        parts = [cov.ran(self.counts).where(F.col("stopped") & F.lit(GENERIC in self.packs)).select(
            "repo", "analyzer", F.lit("").alias("path"), F.concat(F.col("read_errors").cast("string"), F.lit(" files could not be read, so the analyzer stopped")).alias("message")
        )]
        if GO in self.packs:
            broken = F.concat(F.lit("could not parse "), F.col("path")).alias("message")
            parts.append(self.go.cuts.where("errors > 0").select("repo", F.lit(GO).alias("analyzer"), "path", broken))
        if "read_error" in self.files.columns:
            lost = self.kept.where(F.coalesce("read_error", F.lit(False)))
            for analyzer, extensions in ((GO, [".go"]), (JS, SCRIPT_EXTENSIONS)):
                if analyzer not in self.packs:
                    continue
                parts.append(lost.where(F.col("ext").isin(extensions)).select("repo", F.lit(analyzer).alias("analyzer"), "path", said.alias("message")))
        return reduce(DataFrame.unionByName, parts)

    @property
    def counts(self) -> DataFrame:
        """Per repo what the built-in packs looked at; those that are not registered cut nothing."""
        scripts = self.scripts.cuts if JS in self.packs else None
        go = self.go.cuts if GO in self.packs else None
        return self._once("counts", lambda: cov.file_counts(self.kept, scripts, go, self.projects), True, None)

    @property
    def looked_at(self) -> DataFrame:
        """(repo, analyzer, files): what own packs read, with 0 where there is nothing for them."""

        def make() -> DataFrame:
            kept = self.kept.select("repo", *[F.coalesce(p.looks_at, F.lit(False)).cast("bigint").alias(n) for n, p in self.own.items()])
            sums = kept.groupBy("repo").agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in self.own])
            each = F.inline(F.array(*[F.struct(F.lit(n).alias("analyzer"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("files")) for n in self.own]))
            return self.projects.select("repo").join(sums, "repo", "left").select("repo", each)

        return self._once("looked_at", make, True, None)

    @property
    def coverage(self) -> DataFrame:
        out = cov.coverage_rows(self.counts).where(F.col("analyzer").isin(list(self.packs)))
        for name, pack in self.own.items():
            rows = self.looked_at.where(F.col("analyzer") == name)
            classes = F.inline(F.array(*[F.struct(F.lit(c).alias("attack_class"), F.lit(s).alias("status")) for c, s in pack.classes]))
            some = rows.where("files > 0").select("repo", "analyzer", "files", classes).withColumn("detail", F.concat(F.col("files").cast("string"), F.lit(f" {pack.detail}")))
            none = rows.where("files = 0").select(
                "repo", "analyzer", "files", F.lit("").alias("attack_class"), F.lit(cov.NOT_APPLICABLE).alias("status"), F.lit("no matching files").alias("detail")
            )
            out = out.unionByName(some).unionByName(none)
        return out

    @property
    def summary(self) -> DataFrame:
        """One row per repo of the corpus, with zeros where nothing was found."""
        return fd.summarize(self.findings, self.projects.select("repo"))

    @property
    def projects(self) -> DataFrame:
        return inventory_counts(self.inventory)


PACKS: dict[str, Pack] = {
    "generic": lambda a: generic_pack(a.kept),
    "go": lambda a: go_pack(a.kept, tables=a.go),
    "javascript-typescript": lambda a: js_pack(a.kept, tables=a.scripts),
}

_AUDITS: dict[tuple[str, str, str], Audit] = {}


def _version(spark: SparkSession, sf_dir: str) -> str:
    """Changes when a file of the input does."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    ).distinct()
    return str(files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0])


def corpus_audit(spark: SparkSession, sf_dir: str) -> Audit:
    """The audit of the corpus derived from ``sf_dir``, shared within a session."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _version(spark, sf_dir))
    if key not in _AUDITS:
        _AUDITS[key] = Audit(code_files(spark, sf_dir))
    return _AUDITS[key]


def unreadable_audit(spark: SparkSession, sf_dir: str) -> Audit:
    """The same corpus as if the files of some documents could not be read."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _version(spark, sf_dir) + ":unreadable")
    if key not in _AUDITS:
        _AUDITS[key] = Audit(code_files(spark, sf_dir).withColumn("read_error", F.pmod("doc_id", F.lit(97)) == 5))
    return _AUDITS[key]


def forget_audits() -> None:
    """Drop shared audits (benchmarks measure each build from scratch)."""
    _AUDITS.clear()
