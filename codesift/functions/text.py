"""Scalar column functions: trimming, redaction, fingerprints and literal tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space as the reference trims it.
SPACE_CLASS = r"[\t-\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Words that mark a literal as a placeholder.
PLACEHOLDER_WORDS = [
    "example", "sample", "dummy", "changeme", "change-me", "your_", "your-", "replace",
    "reemplazar", "cambia_", "cambiar_", "placeholder", "not-a-real", "fake", "mock",
    "testtest", "xxxx", "${", "{{",
]

# Prefixes of throw-away credentials.
THROWAWAY_PREFIXES = ["test-", "test_", "e2e-", "e2e_", "dev-", "dev_", "local-", "local_"]

# Shells and the flag that makes them read a command string.
SHELL_FLAGS = {
    "-c": ["sh", "bash", "zsh", "dash", "ksh", "powershell", "powershell.exe", "pwsh", "pwsh.exe"],
    "/c": ["cmd", "cmd.exe"],
    "-command": ["powershell", "powershell.exe", "pwsh", "pwsh.exe"],
}

FINGERPRINT_PREFIX = "fp:"


def _literal(text: str) -> str:
    """Quote a literal for use inside a regular expression."""
    return "".join("\\" + c if c in "\\.[]{}()*+?^$|" else c for c in text)


def _alternatives(words: list[str]) -> str:
    return "(?:" + "|".join(_literal(word) for word in words) + ")"


# One regular expression per word list: the tested expression is evaluated once,
# and the generated code stays small enough to be compiled.


def _first_letters(words: list[str]) -> str:
    """A look at one character, so that most places of a text are passed without trying each word."""
    firsts = sorted({c for word in words for c in (word[0].lower(), word[0].upper())})
    return "(?=[" + "".join("\\" + c if not c.isalnum() else c for c in firsts) + "])"


def any_of(col: Column, needles: list[str]) -> Column:
    """True if ``col`` contains one of the literal needles."""
    return F.rlike(col, F.lit(_first_letters(needles) + _alternatives(needles)))


def any_of_folded(col: Column, needles: list[str]) -> Column:
    """``any_of`` without regard to case; the needles are lower-case ASCII."""
    return F.rlike(col, F.lit("(?i)" + _first_letters(needles) + _alternatives(needles)))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column whose expression is evaluated once per row.  Filters and projections above
    would otherwise hold a copy of it for each time they use it."""
    return df.withColumn(name, F.explode(F.array(value)))


def starts_with_any(col: Column, prefixes: list[str]) -> Column:
    return F.rlike(col, F.lit("^" + _alternatives(prefixes)))


def ends_with_any(col: Column, suffixes: list[str]) -> Column:
    return F.rlike(col, F.lit(_alternatives(suffixes) + "\\z"))


def trimmed(col: Column) -> Column:
    """Trim Unicode white space (``F.trim`` removes blanks only)."""
    return F.regexp_replace(col, f"^{SPACE_CLASS}+|{SPACE_CLASS}+\\z", "")


def squeezed(col: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col, f"{SPACE_CLASS}+", " "))


def fingerprint(rule: Column, path: Column, evidence: Column) -> Column:
    """Identity of a finding: rule, path and evidence, but not the line."""
    payload = F.concat_ws("\0", trimmed(rule), trimmed(path), squeezed(evidence))
    return F.concat(F.lit(FINGERPRINT_PREFIX), F.substring(F.sha2(payload, 256), 1, 24))


def redact(col: Column) -> Column:
    """Byte length and a short digest in place of the value."""
    value = trimmed(col)
    shown = F.concat(
        F.lit("[redacted len="), F.octet_length(value).cast("string"),
        F.lit(" sha256="), F.substring(F.sha2(value, 256), 1, 12), F.lit("]"),
    )
    return F.when(value == "", F.lit("[redacted]")).otherwise(shown)


def unquoted(col: Column) -> Column:
    """Strip leading and trailing quote characters of both kinds."""
    return F.regexp_replace(col, "^[\"']+|[\"']+\\z", "")


def looks_like_secret(col: Column) -> Column:
    """Long enough, varied enough, and not a known placeholder."""
    value = trimmed(unquoted(col))
    low = F.lower(value)
    return (
        (F.octet_length(value) >= 16)
        & ~any_of(low, PLACEHOLDER_WORDS)
        & ~starts_with_any(low, THROWAWAY_PREFIXES)
        & ~F.rlike(value, F.lit(SPACE_CLASS))
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    )


def is_pinned_ref(col: Column) -> Column:
    return F.rlike(col, F.lit(r"^[0-9A-Fa-f]{40}\z"))


def is_comment_line(col: Column) -> Column:
    """True if the first visible text of a line opens a comment."""
    return F.rlike(col, F.lit(f"^{SPACE_CLASS}*(?://|#|/\\*|\\*|<!--|;)"))


def is_shell_mode(shell: Column, flag: Column) -> Column:
    base = F.lower(F.regexp_extract(trimmed(shell), r"([^/]*)/*\z", 1))
    low_flag = F.lower(trimmed(flag))
    out = F.lit(False)
    for name, shells in SHELL_FLAGS.items():
        out = out | ((low_flag == name) & base.isin(shells))
    return out


def clipped(col: Column, limit: int = 280) -> Column:
    """Evidence text: white space collapsed, cut to ``limit`` bytes."""
    text = squeezed(col)
    raw = F.encode(text, "UTF-8")
    cut = F.concat(F.decode(F.substring(raw, 1, limit - 1), "UTF-8"), F.lit("…"))
    return F.when(F.octet_length(text) > limit, cut).otherwise(text)


def clean_tags(col: Column) -> Column:
    """Trim, drop empties, deduplicate and sort."""
    kept = F.filter(F.transform(col, trimmed), lambda tag: tag != "")
    return F.array_sort(F.array_distinct(kept))


def safe_segment_pattern(col: Column) -> Column:
    """A regular expression that only admits one plain path segment."""
    parts = r"^\^\[(?:A-Za-z|a-zA-Z)0-9_-\]"
    bounded = parts + r"\{\+?0*([0-9]+)(?:,\+?0*([0-9]+))?\}\$\z"
    first = F.regexp_extract(col, bounded, 1)
    second = F.regexp_extract(col, bounded, 2)
    return F.rlike(col, F.lit(parts + r"\+\$\z")) | (
        F.rlike(col, F.lit(bounded))
        & (first.try_cast("bigint") >= 1)
        & ((second == "") | (second.try_cast("bigint") >= first.try_cast("bigint")))
    )


def world_writable(col: Column) -> Column:
    """An integer literal, in any base, whose 0o002 bit is set."""
    text = F.lower(F.regexp_replace(col, "_", ""))
    value = (
        F.when(F.rlike(text, F.lit("^0x[0-9a-f]+\\z")), F.conv(F.substring(text, 3, 64), 16, 10))
        .when(F.rlike(text, F.lit("^0b[01]+\\z")), F.conv(F.substring(text, 3, 64), 2, 10))
        .when(F.rlike(text, F.lit("^0o[0-7]+\\z")), F.conv(F.substring(text, 3, 64), 8, 10))
        .when(F.rlike(text, F.lit("^0[0-7]+\\z")), F.conv(F.substring(text, 2, 64), 8, 10))
        .when(F.rlike(text, F.lit("^(?:0|[1-9][0-9]*)\\z")), text)
    ).try_cast("bigint")
    return F.coalesce(value.bitwiseAND(F.lit(2)) != 0, F.lit(False))
