"""SQL that cuts the literal scripts into tokens and pairs their brackets.

The checking engine walks each script on its own, a token per step; what a slash or a
brace means is decided from the token before it and the braces that are open.  Counts per
script are then joined to the documents that use the case.
"""

from __future__ import annotations

from codesift.operators.inventory import SCRIPT_EXTENSIONS
from codesift.operators.tokens import JS_BEFORE_REGEX, JS_OPERATORS, JS_PUNCTUATION, JS_RESERVED
from codesift.plans.checks import _list, inventory_sql
from codesift.plans.corpus import all_cases, sql_text

_SPACE = r"[\s\x{a0}\x{feff}\x{2028}\x{2029}]+|//[^\r\n]*|<!--[^\r\n]*"
_NAME = r"#?[\p{L}\p{Nl}$_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}$]*"
_NUMBER = r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?"
_SIGNS = "|".join("".join("\\" + c for c in word) for word in ["=>", "...", *JS_OPERATORS, *(p for p in JS_PUNCTUATION if len(p) == 1)])
_TEMPLATE = r"^[`}](?:[^`\\$]|\\(?s:.)|\$+[^{$`\\])*\$*?(?:`|\$\{)"
_REGEX = r"^/(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z0-9_$]*"
_AFTER = ["(", "[", "{", ",", ":", ";", "?", "=>", *JS_BEFORE_REGEX, *(o for o in JS_OPERATORS if o not in ("?.", "++", "--", "<", ">", "/"))]


def script_tokens_sql() -> str:
    """``toks``(case_no, path_text, step, kind, text, line, idx) of every literal script."""

    def take(pattern: str) -> str:
        return f"nullif(regexp_extract(rest, {sql_text(pattern)}), '')"

    strings = [f"WHEN starts_with(rest, {sql_text(q)}) THEN {take(rf'^{q}(?:[^{q}\\\r\n]|\\(?s:.))*{q}')}" for q in "\"'"]
    special = f"""CASE WHEN starts_with(rest, '`') OR (starts_with(rest, '}}') AND ends_with(open, 'T')) THEN {take(_TEMPLATE)}
      {' '.join(strings)}
      WHEN starts_with(rest, '/*') THEN {take(r'^/\*(?s:.*?)\*/')}
      WHEN starts_with(rest, '//') THEN NULL
      WHEN starts_with(rest, '/') AND may THEN {take(_REGEX)} END"""
    plain = f"regexp_extract(rest, {sql_text(f'^(?:{_SPACE}|{_NUMBER}|{_NAME}|{_SIGNS}|(?s:.))')})"
    trivia = f"regexp_matches(piece, {sql_text(f'^(?:{_SPACE}|/[*])')})"
    return f"""scripts_of AS (SELECT case_no, path_text, replace(body_text, '@@ID@@', '7') AS body FROM cases WHERE lower(regexp_extract(path_text, '[.][^.]*$')) IN {_list(SCRIPT_EXTENSIONS)}),
walk(case_no, path_text, step, rest, piece, open, may, line) AS (
  SELECT case_no, path_text, 0, body, '', '', true, 1 FROM scripts_of
  UNION ALL
  SELECT case_no, path_text, step + 1, substr(rest, length(piece) + 1), piece,
    CASE WHEN piece = '{{' THEN open || 'B'
         WHEN piece = '}}' THEN open[:-2]
         WHEN starts_with(piece, '`') AND ends_with(piece, '${{') THEN open || 'T'
         WHEN starts_with(piece, '}}') AND ends_with(piece, '`') THEN open[:-2] ELSE open END,
    CASE WHEN {trivia} THEN may WHEN piece IN {_list(_AFTER)} OR ends_with(piece, '${{') THEN true ELSE false END,
    line + length(before) - length(replace(before, chr(10), ''))
  FROM (SELECT case_no, path_text, step, rest, open, may, line, piece AS before, coalesce({special}, {plain}) AS piece FROM walk WHERE rest <> '')),
kinds AS (SELECT case_no, path_text, step, piece AS text, line,
    CASE WHEN {trivia} THEN 'trivia'
      WHEN starts_with(piece, '`') AND length(piece) > 1 THEN CASE WHEN ends_with(piece, '`') THEN 'template' ELSE 'tstart' END
      WHEN starts_with(piece, '}}') AND length(piece) > 1 THEN CASE WHEN ends_with(piece, '`') THEN 'tend' ELSE 'tmid' END
      WHEN piece[1] IN ('"', '''') AND length(piece) > 1 THEN 'string'
      WHEN piece[1] = '/' AND length(piece) > 1 AND piece <> '/=' THEN 'regex'
      WHEN regexp_matches(piece, '^[.]?[0-9]') THEN 'number'
      WHEN piece IN {_list(JS_RESERVED)} THEN 'keyword'
      WHEN regexp_matches(piece, '^[\\p{{L}}\\p{{Nl}}$_]') THEN 'ident'
      WHEN piece[1] = '#' AND length(piece) > 1 THEN 'private'
      WHEN piece IN {_list(JS_PUNCTUATION)} THEN 'punct' WHEN piece IN {_list(JS_OPERATORS)} THEN 'op' ELSE 'error' END AS kind
  FROM walk WHERE step > 0),
toks AS (SELECT *, row_number() OVER (PARTITION BY case_no, path_text ORDER BY step) - 1 AS idx FROM kinds WHERE kind NOT IN ('trivia', 'error'))"""


def _brackets_sql() -> str:
    """``marks``: openers, closers and commas by the level they stand in, with the opener of it."""
    return f"""{script_tokens_sql()},
steps AS (SELECT *, CASE WHEN text IN ('(', '[', '{{') OR kind = 'tstart' THEN 1 WHEN text IN (')', ']', '}}') OR kind = 'tend' THEN -1 ELSE 0 END AS turn FROM toks),
levels AS (SELECT *, sum(turn) OVER (PARTITION BY case_no, path_text ORDER BY idx) - least(turn, 0) AS lv FROM steps),
marks AS (SELECT *, last_value(CASE WHEN turn = 1 THEN idx END IGNORE NULLS) OVER level AS opener, last_value(CASE WHEN turn = 1 THEN text END IGNORE NULLS) OVER level AS opener_text
  FROM levels WHERE turn <> 0 OR text = ',' WINDOW level AS (PARTITION BY case_no, path_text, lv ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


def _for_documents(tables: str, columns: str) -> str:
    return f"""WITH RECURSIVE {inventory_sql()}, {tables}
SELECT k.repo, k.path, {columns} FROM kept k JOIN per_script c ON k.doc_id % {len(all_cases())} = c.case_no AND k.path = replace(c.path_text, '@@ID@@', CAST(k.doc_id AS VARCHAR)) WHERE NOT k.is_test"""


def js_tokens_sql() -> str:
    kinds = ("ident", "keyword", "string", "template", "regex", "number")
    counted = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in kinds)
    per_script = f"per_script AS (SELECT case_no, path_text, count(*) AS tokens, CAST(max(line) AS INT) AS last_line, {counted} FROM toks GROUP BY case_no, path_text)"
    return _for_documents(f"{script_tokens_sql()}, {per_script}", f"tokens, last_line, {', '.join(kinds)}")


def brace_depth_sql() -> str:
    per_script = """per_script AS (SELECT case_no, path_text, opener_text AS kind, count(*) AS pairs, CAST(max(lv) - 1 AS INT) AS max_depth
  FROM marks WHERE turn = -1 AND opener IS NOT NULL GROUP BY case_no, path_text, opener_text)"""
    return _for_documents(f"{_brackets_sql()}, {per_script}", "replace(c.kind, '@@ID@@', CAST(k.doc_id AS VARCHAR)) AS kind, pairs, max_depth")


def call_args_sql() -> str:
    per_script = """cut AS (SELECT *, lead(idx) OVER part AS next_idx, row_number() OVER part - 1 AS arg_no FROM marks WHERE opener_text = '(' WINDOW part AS (PARTITION BY case_no, path_text, opener ORDER BY idx)),
per_script AS (SELECT case_no, path_text, count(*) AS args, CAST(max(arg_no) AS INT) AS max_arg_no, CAST(max(next_idx - idx - 1) AS INT) AS longest
  FROM cut WHERE turn <> -1 AND next_idx - idx > 1 GROUP BY case_no, path_text)"""
    return _for_documents(f"{_brackets_sql()}, {per_script}", "args, max_arg_no, longest")
