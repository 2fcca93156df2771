"""Name tests: which identifiers look like credentials, per language and use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions.text import any_of, ends_with_any, starts_with_any

# Parts of a value name that suggest a credential.
GO_VALUE_PARTS = ["password", "passwd", "secret", "token", "nonce", "session", "credential", "apikey", "otp", "authcode"]
GO_LOG_PREFIXES = ["has", "is"]
GO_LOG_SUFFIXES = [
    "err", "error", "ttl", "timeout", "duration", "window", "limit", "attempts", "method", "type",
    "name", "path", "file", "count", "enabled", "present",
]
GO_LOG_PARTS = [
    "password", "passwd", "secret", "token", "credential", "apikey", "authcode", "authorization", "cookie", "bearer",
]
JS_VALUE_SUFFIXES = [
    "count", "ttl", "timeout", "duration", "window", "limit", "attempts", "method", "type", "name",
    "path", "file", "enabled", "present", "length",
]
JS_VALUE_PARTS = GO_VALUE_PARTS + ["csrf"]
JS_LOG_SUFFIXES = [
    "count", "counts", "ttl", "timeout", "duration", "window", "limit", "limits", "budget", "budgets",
    "usage", "cost", "costs", "score", "scores", "length", "size", "entry", "entries", "tokens",
    "enabled", "present", "name", "type", "path", "file",
]
JS_LOG_PARTS = [
    "password", "passwd", "secret", "credential", "apikey", "authorization", "bearer", "cookie", "authcode", "token",
]
# Calls that make a value fit for logging.
LOG_SANITIZERS = ["fingerprint", "redact", "redacted", "mask", "masked", "hashforlog"]


def _plain(col: Column, separators: str) -> Column:
    return F.lower(F.translate(col, separators, ""))


def go_value_name(col: Column) -> Column:
    return any_of(_plain(col, "_-"), GO_VALUE_PARTS)


def go_log_name(col: Column) -> Column:
    name = _plain(col, "_-")
    return (
        ~starts_with_any(name, GO_LOG_PREFIXES)
        & ~ends_with_any(name, GO_LOG_SUFFIXES)
        & any_of(name, GO_LOG_PARTS)
    )


def js_value_name(col: Column) -> Column:
    name = _plain(col, "_-$")
    return ~ends_with_any(name, JS_VALUE_SUFFIXES) & any_of(name, JS_VALUE_PARTS)


def js_log_name(col: Column) -> Column:
    name = _plain(col, "_-$")
    return (
        ~starts_with_any(name, GO_LOG_PREFIXES)
        & ~ends_with_any(name, JS_LOG_SUFFIXES)
        & any_of(name, JS_LOG_PARTS)
    )
