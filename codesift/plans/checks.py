"""SQL for the checking engine: the same answers from the same tables.

Generic rules, inventory and report operators are computed from the texts.  For
the code rules the expected rows of the literal cases are joined to the
documents that use the case, so the checked rows grow with the table.
"""

from __future__ import annotations

from codesift.operators.coverage import _CLASS_ROWS
from codesift.operators.inventory import (
    CONFIG_EXTENSIONS, DEPENDENCY_DIRS, LANGUAGE_EXTENSIONS, SCRIPT_EXTENSIONS, TEST_DIRS, TEST_SUFFIXES, TEXT_EXTENSIONS,
)
from codesift.functions.text import PLACEHOLDER_WORDS, THROWAWAY_PREFIXES
from codesift.plans.attack_classes import ATTACK_CLASSES, COVERED
from codesift.plans.corpus import corpus_sql, expected_rows, all_cases, sql_text
from codesift.schema import GO, JS, _ROWS


def _list(words) -> str:
    return "(" + ", ".join(sql_text(w) for w in words) + ")"


def _any(expr: str, words, form: str = "contains") -> str:
    return "(" + " OR ".join(f"{form}({expr}, {sql_text(w)})" for w in words) + ")"


LANGUAGE_CASE = "CASE " + " ".join(
    f"WHEN ext IN {_list(exts)} THEN '{lang}'" for lang, exts in LANGUAGE_EXTENSIONS.items()
) + " WHEN base = 'dockerfile' OR starts_with(base, 'dockerfile.') THEN 'dockerfile' ELSE 'other' END"


def inventory_sql() -> str:
    parts = "string_split(lower(path), '/')"
    dirs = f"{parts}[1:len({parts}) - 1]"
    return corpus_sql() + f""",
named AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS base FROM code_files),
exts AS (SELECT *, lower(regexp_extract(base, '\\.[^.]*$')) AS ext, strlen(content) AS size,
    ({_any('lower(path)', TEST_SUFFIXES, 'ends_with')} OR list_has_any({dirs}, {list(TEST_DIRS)})) AS is_test,
    CASE WHEN list_has_any({dirs}, {list(DEPENDENCY_DIRS)}) THEN 'dependency_or_build_dir'
         WHEN strlen(content) > 4194304 THEN 'too_large' END AS skip_reason FROM named),
inv AS (SELECT *, {LANGUAGE_CASE} AS lang FROM exts),
kept AS (SELECT * FROM inv WHERE skip_reason IS NULL)"""


def _secret(value: str) -> str:
    v = f"trim(trim({value}, chr(34) || chr(39)))"
    return (
        f"(strlen({v}) >= 16 AND NOT {_any(f'lower({v})', PLACEHOLDER_WORDS)} AND NOT {_any(f'lower({v})', THROWAWAY_PREFIXES, 'starts_with')}"
        f" AND NOT regexp_matches({v}, '\\s') AND len(list_distinct(string_split({v}, ''))) >= 8)"
    )


def _redact(value: str) -> str:
    return f"'[redacted len=' || strlen(trim({value})) || ' sha256=' || substr(sha256(trim({value})), 1, 12) || ']'"


_TOKENS = {
    "G002": "-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "G003": r"\bAKIA[0-9A-Z]{16}\b",
    "G004": r"\bgh[pousr]_[A-Za-z0-9_]{30,}\b",
    "G005": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    "G006": r"\bsk_live_[A-Za-z0-9]{16,}\b",
}
_CONFIG = (
    r"""(?i)^\s*(?:export\s+)?["'']?[A-Za-z0-9_.-]*(?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|token|secret|password|passwd)["'']?\s*[:=]\s*["'']?([A-Za-z0-9_./+=:@%!?$~,-]{16,256})["'']?\s*,?\s*(?:[#;].*)?$"""
)
_T = "(?:TODO|FIXME|HACK|XXX)"
_C = "(?:auth|permission|authoriz|saniti|secur|secret|token|credential)"
_USES = r"(?i)^\s*-?\s*uses:\s*([^\s#]+)@([^\s#]+)"
_EVENT = r"\$\{\{\s*github\.event\.(?:issue\.title|issue\.body|comment\.body|pull_request\.title|pull_request\.body|pull_request\.head\.ref|workflow_run\.head_branch)\s*\}\}"
_DOCKER = r"(?i)^\s*(?:ENV|ARG)\s+([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|API_KEY|APIKEY)[A-Z0-9_]*)\s*[= ]\s*(\S+)"
_PIPE = r"(?i)(?:curl|wget)\b[^\n|]*(?:\||\|\s*)(?:sh|bash|zsh|powershell|pwsh)\b"


def generic_sql() -> str:
    """All generic findings: (repo, path, rule_id, line, evidence, verdict, phase, pos, rule_no)."""
    nv_or_hard = "CASE WHEN is_test THEN 'hardening' ELSE 'needs_validation' END"
    rules = [
        f"SELECT repo, path, '{rule}', line, {_redact('text')}, {nv_or_hard}, {no}, line, 0 FROM lines WHERE regexp_matches(text, '{pattern}')"
        for no, (rule, pattern) in enumerate(_TOKENS.items(), start=1)
    ]
    env = "(base = '.env' OR starts_with(base, '.env.')) AND NOT " + _any("base", ["example", "sample", "template"])
    rules += [
        f"SELECT repo, path, 'G001', 1, path, 'needs_validation', 0, 0, 0 FROM texts WHERE {env}",
        f"SELECT repo, path, 'G007', line, {_redact('text')}, 'needs_validation', 6, line, 0 FROM lines WHERE NOT is_test AND (starts_with(base, '.env') OR ext IN {_list(CONFIG_EXTENSIONS)}) AND regexp_matches(text, '{_CONFIG}') AND {_secret(f'''regexp_extract(text, '{_CONFIG}', 1)''')}",
        f"SELECT repo, path, 'G008', line, trim(text), 'hardening', 7, line, 0 FROM lines WHERE ext NOT IN ('.go', '.md', '.txt') AND regexp_matches(text, '(?i){_T}.{{0,120}}{_C}|{_C}.{{0,120}}{_T}') AND regexp_matches(trim(text), '^(//|#|/\\*|\\*|<!--|;)')",
        f"SELECT repo, path, 'G009', line, trim(text), 'hardening', 8, line, 0 FROM lines WHERE workflow AND regexp_matches(text, '{_USES}') AND NOT regexp_matches(trim(regexp_extract(text, '{_USES}', 2), chr(34) || chr(39)), '^[0-9A-Fa-f]{{40}}$')",
        "SELECT repo, path, 'G010', line, trim(text), 'hardening', 8, line, 1 FROM lines WHERE workflow AND contains(lower(text), 'permissions: write-all')",
        f"SELECT repo, path, 'G011', line, trim(text), 'needs_validation', 8, line, 2 FROM lines WHERE workflow AND regexp_matches(text, '{_EVENT}')",
        "SELECT repo, path, 'G012', (SELECT min(l.line) FROM lines l WHERE l.repo = t.repo AND l.path = t.path AND contains(lower(l.text), 'pull_request_target:')), 'pull_request_target + actions/checkout + github.event.pull_request.head', 'needs_validation', 9, 0, 0 FROM texts t WHERE workflow AND contains(lower(content), 'pull_request_target:') AND contains(lower(content), 'actions/checkout') AND contains(lower(content), 'github.event.pull_request.head')",
        f"SELECT repo, path, 'G013', line, {_redact('text')}, 'needs_validation', 10, line, 0 FROM lines WHERE docker AND regexp_matches(text, '{_DOCKER}') AND {_secret(f'''regexp_extract(text, '{_DOCKER}', 2)''')}",
        f"SELECT repo, path, 'G014', line, trim(text), 'hardening', 10, line, 1 FROM lines WHERE docker AND regexp_matches(text, '{_PIPE}')",
        f"SELECT repo, path, 'G016', line, trim(text), 'hardening', 12, line, 0 FROM lines WHERE shell AND regexp_matches(text, '{_PIPE}')",
        """SELECT f.repo, f.path, 'G015', f.from_at, (SELECT trim(l.text) FROM lines l WHERE l.repo = f.repo AND l.path = f.path AND l.line = f.from_at), 'hardening', 11, 0, 0
           FROM stages f WHERE from_at IS NOT NULL AND coalesce(user_at, 0) < from_at AND NOT EXISTS (
             SELECT 1 FROM scripts s WHERE s.repo = f.repo AND f.entry IS NOT NULL AND contains(f.entry, s.base))""",
    ]
    return inventory_sql() + f""",
texts AS (SELECT *, starts_with(lower(path), '.github/workflows/') AND (ends_with(lower(path), '.yml') OR ends_with(lower(path), '.yaml')) AS workflow,
    (base = 'dockerfile' OR starts_with(base, 'dockerfile.')) AS docker, ext IN ('.sh', '.bash', '.zsh', '.ps1') AS shell
  FROM kept WHERE base = 'dockerfile' OR starts_with(base, 'dockerfile.') OR starts_with(base, '.env') OR base IN ('go.mod', 'go.sum', '.gitignore') OR ext IN {_list(TEXT_EXTENSIONS)}),
split AS (SELECT repo, path, base, ext, is_test, workflow, docker, shell, string_split(content, chr(10)) AS ls FROM texts),
lines AS (SELECT repo, path, base, ext, is_test, workflow, docker, shell, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM split),
stages AS (SELECT repo, path, max(CASE WHEN starts_with(upper(trim(text)), 'FROM ') THEN line END) AS from_at,
    max(CASE WHEN starts_with(upper(trim(text)), 'USER ') THEN line END) AS user_at,
    arg_max(lower(trim(text)), line) FILTER (WHERE starts_with(upper(trim(text)), 'ENTRYPOINT ')) AS entry FROM lines WHERE docker GROUP BY repo, path),
scripts AS (SELECT repo, base FROM texts WHERE shell AND (contains(lower(content), 'exec su-exec ') OR contains(lower(content), 'exec gosu ')
    OR (contains(lower(content), 'setpriv ') AND contains(lower(content), '--reuid')) OR (contains(lower(content), 'runuser ') AND contains(lower(content), ' -u ')))),
generic(repo, path, rule_id, line, evidence, verdict, phase, pos, rule_no) AS (
{" UNION ALL ".join(rules)})"""


def code_sql() -> str:
    """Expected code findings: (repo, path, rule_id, variant, line, column_no, evidence)."""
    rows = ",\n".join(
        f"({no}, {sql_text(path)}, '{rule}', '{variant}', {line}, {column}, {sql_text(evidence)})"
        for no, path, rule, variant, line, column, evidence in expected_rows()
    )
    return f"""expected(case_no, path_text, rule_id, variant, line, column_no, evidence) AS (VALUES {rows}),
code AS (SELECT d.source AS repo, replace(e.path_text, '@@ID@@', CAST(d.doc_id AS VARCHAR)) AS path, e.rule_id, e.variant, e.line, e.column_no,
    replace(e.evidence, '@@ID@@', CAST(d.doc_id AS VARCHAR)) AS evidence
  FROM documents d JOIN expected e ON d.doc_id % {len(all_cases())} = e.case_no)"""


def findings_sql() -> str:
    """Every finding after first-wins dedup, with its catalogue columns."""
    rules = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', {sql_text(r[3])}, '{r[4]}', '{r[5]}')" for r in _ROWS)
    return generic_sql() + ",\n" + code_sql() + f""",
rules(rule_id, variant, analyzer, attack_class, rule_verdict, confidence) AS (VALUES {rules}),
raw AS (SELECT repo, path, rule_id, '' AS variant, line, 0 AS column_no, evidence, verdict FROM generic
  UNION ALL SELECT repo, path, rule_id, variant, line, column_no, evidence, NULL FROM code),
printed AS (SELECT raw.*, analyzer, attack_class, coalesce(verdict, rule_verdict) AS final_verdict, confidence,
    'fp:' || substr(sha256(raw.rule_id || chr(0) || path || chr(0) || trim(regexp_replace(evidence, '\\s+', ' ', 'g'))), 1, 24) AS fingerprint
  FROM raw JOIN rules USING (rule_id, variant)),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, fingerprint ORDER BY analyzer, path, line, column_no) AS rn FROM printed) WHERE rn = 1)"""


def coverage_sql() -> str:
    return generic_sql() + ",\n" + coverage_part()


def coverage_part() -> str:
    classes = ", ".join(f"('{a}', {sql_text(c)}, '{s}', '{k}')" for a, c, s, k in _CLASS_ROWS)
    return f"""n AS (SELECT k.repo, count(*) FILTER (WHERE skip_reason IS NULL) AS files, count(*) FILTER (WHERE skip_reason IS NULL AND ext = '.go') AS go,
  count(*) FILTER (WHERE skip_reason IS NULL AND ext IN {_list(SCRIPT_EXTENSIONS)}) AS js FROM inv k GROUP BY k.repo),
tn AS (SELECT repo, count(*) AS text, sum(docker::INT) AS docker, sum(docker::INT + workflow::INT + shell::INT) AS supply FROM texts GROUP BY repo),
counts AS (SELECT n.*, coalesce(text, 0) AS text, coalesce(docker, 0) AS docker, coalesce(supply, 0) AS supply FROM n LEFT JOIN tn USING (repo)),
classes(analyzer, attack_class, status, counted) AS (VALUES {classes}),
cells AS (SELECT repo, analyzer, attack_class, status, CASE counted WHEN 'text' THEN text WHEN 'supply' THEN supply WHEN 'docker' THEN docker WHEN 'go' THEN go ELSE js END AS seen,
    CASE analyzer WHEN 'generic' THEN files WHEN 'go' THEN go ELSE js END AS applies FROM counts, classes),
coverage AS (
  SELECT repo, analyzer, attack_class, CASE WHEN analyzer = 'generic' AND seen = 0 THEN 'not_applicable' ELSE status END AS status, CAST(seen AS BIGINT) AS files FROM cells WHERE applies > 0
  UNION ALL SELECT DISTINCT repo, analyzer, '', 'not_applicable', CAST(0 AS BIGINT) FROM cells WHERE applies = 0)"""


def matrix_sql() -> str:
    classes = ", ".join(f"({sql_text(d)}, '{s}', {sql_text(n)})" for d, s, ns in ATTACK_CLASSES for n in ns)
    rows = ", ".join(
        f"('{s}', {sql_text(n)}, '{lang}', {rules})"
        for (s, n), both in COVERED.items() for lang, rules in zip((GO, JS), both) if rules
    )
    return f"""classes(domain, source, name) AS (VALUES {classes}),
covered(source, name, language, rules) AS (VALUES {rows}),
matrix AS (SELECT c.*, l.language, CASE WHEN o.rules IS NOT NULL THEN 'partial'
    WHEN c.source = 'MEMORY-SAFETY-AND-BINARY.md' AND l.language = '{JS}' THEN 'not_applicable'
    WHEN c.source = 'CLIENT-SIDE.md' AND l.language = '{GO}' THEN 'not_applicable' ELSE 'not_automated' END AS status, o.rules
  FROM classes c CROSS JOIN (VALUES ('{GO}'), ('{JS}')) l(language) LEFT JOIN covered o ON o.source = c.source AND o.name = c.name AND o.language = l.language)"""


def table_sql(expected: dict[str, list[tuple]], columns: list[str]) -> str:
    """Rows of a code table: those expected of a case, for every document that uses it."""
    number = {path: no for no, (_, files) in enumerate(all_cases()) for path, _, _ in files}

    def shown(value) -> str:
        return sql_text(value) if isinstance(value, str) else str(value)

    rows = ", ".join(f"({number[path]}, {sql_text(path)}, {', '.join(shown(v) for v in row)})" for path, found in expected.items() for row in found)
    return f"""WITH expected(case_no, path_text, {', '.join(columns)}) AS (VALUES {rows})
SELECT d.source AS repo, replace(path_text, '@@ID@@', CAST(d.doc_id AS VARCHAR)) AS path, {', '.join(columns)}
FROM documents d JOIN expected ON d.doc_id % {len(all_cases())} = case_no"""
