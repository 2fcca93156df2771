"""Generic rule pack: credentials, to-dos, workflows, container files and scripts.

All sixteen rules run over one scan.  Cheap substring gates on the whole text
decide which files are exploded to lines; on the lines every rule is one branch
of a single projection.  Only G015 needs a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.text import (
    any_of, any_of_folded, computed, is_comment_line, is_pinned_ref, looks_like_secret, redact, trimmed, unquoted,
)
from codesift.operators import inventory as inv
from codesift.operators.lines import line_array, line_of, to_lines
from codesift.schema import HARD, NV, RAW_COLUMNS

# The credential and configuration patterns.  Look-around replaces
# \b so that word characters are ASCII on every JDK.
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"
TOKEN_PATTERNS = {
    "G002": "-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "G003": WORD_START + "AKIA[0-9A-Z]{16}" + WORD_END,
    "G004": WORD_START + "gh[pousr]_[A-Za-z0-9_]{30,}" + WORD_END,
    "G005": WORD_START + "xox[baprs]-[A-Za-z0-9-]{20,}" + WORD_END,
    "G006": WORD_START + "sk_live_[A-Za-z0-9]{16,}" + WORD_END,
}
TOKEN_GATES = ["PRIVATE KEY-----", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_"]
CONFIG_SECRET = (
    r"(?iu)^[\t\n\f\r ]*(?:export[\t\n\f\r ]+)?[\"']?[A-Za-z0-9_.-]*"
    r"(?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|token|secret|password|passwd)[\"']?"
    r"[\t\n\f\r ]*[:=][\t\n\f\r ]*[\"']?([A-Za-z0-9_./+=:@%!?$~,-]{16,256})[\"']?"
    r"[\t\n\f\r ]*,?[\t\n\f\r ]*(?:[#;].*)?\z"
)
_TODO = "(?:TODO|FIXME|HACK|XXX)"
_CONTROL = "(?:auth|permission|authoriz|saniti|secur|secret|token|credential)"
SECURITY_TODO = f"(?diu){_TODO}.{{0,120}}{_CONTROL}|{_CONTROL}.{{0,120}}{_TODO}"
TODO_GATES = ["todo", "fixme", "hack", "xxx"]
WORKFLOW_USES = r"(?iu)^[\t\n\f\r ]*-?[\t\n\f\r ]*uses:[\t\n\f\r ]*([^\t\n\f\r #]+)@([^\t\n\f\r #]+)"
WORKFLOW_EVENT = (
    r"\$\{\{[\t\n\f\r ]*github\.event\.(?:issue\.title|issue\.body|comment\.body|pull_request\.title|"
    r"pull_request\.body|pull_request\.head\.ref|workflow_run\.head_branch)[\t\n\f\r ]*\}\}"
)
DOCKER_SECRET = (
    r"(?iu)^[\t\n\f\r ]*(?:ENV|ARG)[\t\n\f\r ]+"
    r"([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|API_KEY|APIKEY)[A-Z0-9_]*)"
    r"[\t\n\f\r ]*[= ][\t\n\f\r ]*([^\t\n\f\r ]+)"
)
PIPE_TO_SHELL = (
    r"(?iu)(?:curl|wget)" + WORD_END + r"[^\n|]*\|[\t\n\f\r ]*(?:sh|bash|zsh|powershell|pwsh)" + WORD_END
)
PR_MIX = ["pull_request_target:", "actions/checkout", "github.event.pull_request.head"]

SALTS = 8


def text_files(files: DataFrame) -> DataFrame:
    """Files of the pack: an allowed kind and not binary."""
    return files.where(inv.is_text_candidate(F.col("path"))).where(~inv.looks_binary(F.col("content")))


def _kinds(files: DataFrame, *carry: str) -> DataFrame:
    path, content = F.col("path"), F.col("content")
    plain = F.lower(inv.extension(path))
    return files.select(
        "repo", "path", "is_test", "content", *carry,
        inv.is_workflow(path).alias("workflow"),
        inv.is_dockerfile(path).alias("docker"),
        inv.is_shell_like(path).alias("shell"),
        (~F.col("is_test") & (inv.is_env_file(path) | plain.isin(inv.CONFIG_EXTENSIONS))).alias("config"),
        (~plain.isin(".go", ".md", ".txt")).alias("todo_kind"),
        any_of(content, TOKEN_GATES).alias("token_gate"),
    )


def _hit(test: Column, rule: str, phase: int, rule_no: int, verdict: Column, confidence: str, secret: Column | None = None) -> Column:
    """One branch of the line projection: a struct where the test holds, else NULL."""
    return F.when(test, F.struct(
        F.lit(rule).alias("rule_id"), verdict.alias("verdict"), F.lit(confidence).alias("confidence"),
        F.lit(phase).alias("phase"), F.lit(rule_no).alias("rule_no"),
        (F.lit(None).cast("string") if secret is None else secret).alias("secret"),
    ))


REDACTED = [*TOKEN_PATTERNS, "G007", "G013"]


def line_rules(files: DataFrame, *carry: str) -> DataFrame:
    """G002–G011, G013, G014 and G016: rules decided by one line.  ``carry`` names further
    columns of the files that findings keep."""
    content = F.col("content")
    fetches = (F.col("docker") | F.col("shell")) & any_of_folded(content, ["curl", "wget"])
    gated = _kinds(files, *carry).withColumns({
        "todo_gate": F.col("todo_kind") & any_of_folded(content, TODO_GATES), "fetch_gate": fetches,
    }).where("token_gate or config or todo_gate or workflow or docker or fetch_gate")
    lines = to_lines(
        gated, "repo", "path", "is_test", "workflow", "docker", "shell", "config", "token_gate", "todo_gate", "fetch_gate", *carry
    )
    text = F.col("text")
    by_context = F.when(F.col("is_test"), F.lit(HARD)).otherwise(F.lit(NV))
    hits = [
        _hit(F.col("token_gate") & text.rlike(pattern), rule, number, 0, by_context, "high")
        for number, (rule, pattern) in enumerate(TOKEN_PATTERNS.items(), start=1)
    ]
    fetched = F.col("fetch_gate") & F.contains(text, F.lit("|")) & text.rlike(PIPE_TO_SHELL)
    hits += [
        _hit(F.col("config") & (F.length(text) >= 20) & text.rlike(CONFIG_SECRET), "G007", 6, 0, F.lit(NV), "medium",
             F.regexp_extract(text, CONFIG_SECRET, 1)),
        _hit(F.col("todo_gate") & any_of_folded(text, TODO_GATES) & is_comment_line(text) & text.rlike(SECURITY_TODO),
             "G008", 7, 0, F.lit(HARD), "medium"),
        _hit(F.col("workflow") & text.rlike(WORKFLOW_USES)
             & ~is_pinned_ref(unquoted(F.regexp_extract(text, WORKFLOW_USES, 2))), "G009", 8, 0, F.lit(HARD), "high"),
        _hit(F.col("workflow") & any_of_folded(text, ["permissions: write-all"]), "G010", 8, 1, F.lit(HARD), "high"),
        _hit(F.col("workflow") & text.rlike(WORKFLOW_EVENT), "G011", 8, 2, F.lit(NV), "medium"),
        _hit(F.col("docker") & text.rlike(DOCKER_SECRET), "G013", 10, 0, F.lit(NV), "medium",
             F.regexp_extract(text, DOCKER_SECRET, 2)),
        _hit(F.col("docker") & fetched, "G014", 10, 1, F.lit(HARD), "high"),
        _hit(F.col("shell") & fetched, "G016", 12, 0, F.lit(HARD), "high"),
    ]
    found = lines.select("repo", "path", "line", "text", *carry, F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    # The rest is evaluated on hits only.
    real = found.where(F.col("hit.secret").isNull() | looks_like_secret(unquoted(F.col("hit.secret"))))
    evidence = F.when(F.col("hit.rule_id").isin(REDACTED), redact(text)).otherwise(trimmed(text))
    return real.select("repo", "path", "hit.*", "line", F.col("line").alias("pos"), evidence.alias("evidence"), *carry).drop("secret")


def file_rules(files: DataFrame, *carry: str) -> DataFrame:
    """G001 and G012: rules decided by the path or by the whole text."""
    base = F.lower(inv.base_name(F.col("path")))
    env = ((base == ".env") | F.startswith(base, F.lit(".env."))) & ~any_of(base, ["example", "sample", "template"])
    mixed = reduce(lambda a, b: a & b, [any_of_folded(F.col("content"), [needle]) for needle in PR_MIX])
    hits = [
        _hit(env, "G001", 0, 0, F.lit(NV), "high"),
        _hit(inv.is_workflow(F.col("path")) & mixed, "G012", 9, 0, F.lit(NV), "high"),
    ]
    found = files.where(env | inv.is_workflow(F.col("path"))).select(
        "repo", "path", "content", *carry, F.explode(F.array_compact(F.array(*hits))).alias("hit")
    )
    whole = F.col("hit.rule_id") == "G012"
    return found.select(
        "repo", "path", "hit.*",
        F.when(whole, line_of(F.col("content"), PR_MIX[0])).otherwise(F.lit(1)).alias("line"), F.lit(0).alias("pos"),
        F.when(whole, F.lit("pull_request_target + actions/checkout + github.event.pull_request.head"))
        .otherwise(F.col("path")).alias("evidence"), *carry,
    ).drop("secret")


def privilege_dropping_scripts(files: DataFrame, *carry: str) -> DataFrame:
    """(repo, script, ...): base names of scripts that hand over to an unprivileged user."""
    text = F.col("content")
    drops = (
        any_of_folded(text, ["exec su-exec ", "exec gosu "])
        | (any_of_folded(text, ["setpriv "]) & any_of_folded(text, ["--reuid"]))
        | (any_of_folded(text, ["runuser "]) & any_of_folded(text, [" -u "]))
    )
    scripts = files.where(inv.is_shell_like(F.col("path"))).where(drops & ~inv.looks_binary(F.col("content")))
    return scripts.select("repo", F.lower(inv.base_name(F.col("path"))).alias("script"), *carry)


SHELL_NAME_END = re.compile(r"\.(?:sh|bash|zsh|ps1)")
NAMES_AT_ONCE = 20_000


def script_names(stages: DataFrame, *keys: str) -> DataFrame:
    """(keys, script): the substrings of ``entry`` that could be a script's base name.

    A rule asks whether the line contains the base name.  A base name has no slash, ends in a
    shell extension and has one of the ``lengths`` that its repo has: a look at each end and
    length turns the containment into an equi-join, in time linear in the line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entry, lengths = batch.column("entry")[i].as_py(), batch.column("lengths")[i].as_py()
                ends = [m.end() for m in SHELL_NAME_END.finditer(entry)]
                slash, starts = -1, []
                for at, end in enumerate(ends):
                    slash = max(slash, entry.rfind("/", ends[at - 1] if at else 0, end))
                    starts.append(slash + 1)
                for length in sorted(set(lengths)):
                    names = list({entry[e - length : e] for e, first in zip(ends, starts, strict=True) if e - length >= first})
                    for j in range(0, len(names), NAMES_AT_ONCE):
                        some = names[j : j + NAMES_AT_ONCE]
                        own = [pa.array([batch.column(k)[i].as_py()] * len(some), batch.schema.field(k).type) for k in keys]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(some, pa.string())], names=[*keys, "script"])

    ddl = ", ".join([*(f"{k} {stages.schema[k].dataType.simpleString()}" for k in keys), "script string"])
    return stages.select(*keys, "entry", "lengths").mapInArrow(run, ddl)


def open_stages(files: DataFrame, *carry: str) -> DataFrame:
    """Container files whose final stage names no user: (repo, path, line, evidence, entry, ...);
    ``entry`` is the last entrypoint line in lower case, or NULL."""
    dockers = files.where(inv.is_dockerfile(F.col("path")))
    lines = F.transform(line_array(F.col("content")), trimmed)
    marked = computed(dockers.select("repo", "path", *carry, "content"), "rows", lines).drop("content")
    marked = computed(marked, "upper", F.transform("rows", F.upper))

    def last(prefix: str) -> Column:
        at = F.transform("upper", lambda row, i: F.when(F.startswith(row, F.lit(prefix)), i))
        return F.coalesce(F.array_max(at), F.lit(-1))

    places = F.struct(last("FROM ").alias("from_at"), last("USER ").alias("user_at"), last("ENTRYPOINT ").alias("entry_at"))
    found = computed(marked, "at", places).select("repo", "path", *carry, "rows", "at.*").where(
        (F.col("from_at") >= 0) & (F.col("user_at") < F.col("from_at"))
    )
    return found.select(
        "repo", "path", (F.col("from_at") + 1).alias("line"), F.element_at("rows", F.col("from_at") + 1).alias("evidence"),
        F.when(F.col("entry_at") >= 0, F.lower(F.element_at("rows", F.col("entry_at") + 1))).alias("entry"), *carry,
    )


def stage_rule(files: DataFrame) -> DataFrame:
    """G015: the final stage names no user, and no entrypoint script drops privileges."""
    stages = open_stages(files)
    names = privilege_dropping_scripts(files).distinct()
    lengths = names.groupBy("repo").agg(F.collect_set(F.char_length("script")).alias("lengths"))
    # One repo and one popular script name may hold a third of all rows: the
    # distinct script side is copied to every salt, the other side is spread.
    asked = script_names(stages.where(F.col("entry").isNotNull()).join(lengths, "repo"), "repo", "path").withColumn(
        "salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    )
    scripts = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    excused = asked.join(scripts, ["repo", "script", "salt"], "left_semi").select("repo", "path").distinct()
    return stages.join(excused, ["repo", "path"], "left_anti").select(
        "repo", "path", F.lit("G015").alias("rule_id"), F.lit(HARD).alias("verdict"), F.lit("high").alias("confidence"),
        "evidence", F.lit(11).alias("phase"), F.lit(0).alias("rule_no"), "line", F.lit(0).alias("pos"),
    )


def generic_pack(files: DataFrame) -> DataFrame:
    """All findings of the pack in the shared raw layout."""
    texts = text_files(files)
    out = line_rules(texts).unionByName(file_rules(texts)).unionByName(stage_rule(texts))
    return out.withColumns({"variant": F.lit(""), "column": F.lit(0)}).select(*RAW_COLUMNS)
