"""Predicates of the validation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.text import any_contains, col

# Fragments that make a value a placeholder for validation.
PLACEHOLDER_PARTS = [
    "your_key_here", "your_secret_here", "your_token_here", "change_me", "changeme", "replace_me",
    "example", "xxx", "todo", "generate-with", "placeholder", "<", ">",
]
# Fragments of a predictable secret.
WEAK_PARTS = ["secret", "password", "dev", "test", "1234", "abcd", "changeme", "example"]
# Format patterns.
URL_RE = r"\Ahttps?://[^\s/$.?#][^\n][^\s]*\z"
PORT_RE = r"\A[0-9]{1,5}\z"
EMAIL_RE = r"\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
KEY_RE = r"\A[A-Za-z][A-Za-z0-9_]*\z"
NAMING_RE = r"\A[A-Z][A-Z0-9_]*\z"


def is_placeholder(c: Column | str) -> Column:
    c = col(c)
    return (c == "") | any_contains(F.lower(c), PLACEHOLDER_PARTS)


def is_weak_secret(c: Column | str) -> Column:
    c = col(c)
    return (F.octet_length(c) < 32) | any_contains(F.lower(c), WEAK_PARTS)


def is_boolean_trap(c: Column | str) -> Column:
    return col(c).isin("True", "False")


def is_url(c: Column | str) -> Column:
    return col(c).rlike("(?U)" + URL_RE)


def is_port(c: Column | str) -> Column:
    c = col(c)
    return c.rlike(PORT_RE) & F.coalesce(c.try_cast("int").between(1, 65535), F.lit(False))


def is_email(c: Column | str) -> Column:
    return col(c).rlike(EMAIL_RE)


def points_to_localhost(key: Column, value: Column) -> Column:
    return any_contains(value, ["localhost", "127.0.0.1"]) & any_contains(key, ["URL", "HOST", "ADDR"])


def is_valid_key(c: Column | str, strict: bool = False) -> Column:
    c = col(c)
    ok = c.rlike(KEY_RE)
    return ok & (c == F.upper(c)) if strict else ok


def follows_naming(c: Column | str) -> Column:
    return col(c).rlike(NAMING_RE)


def file_contains(content: Column | str, needle: str) -> Column:
    return col(content).contains(needle)
