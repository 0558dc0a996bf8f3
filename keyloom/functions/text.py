"""String helpers: Unicode trimming, case styles, escapes, previews, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for use inside a regex character class (valid in Java and RE2).
WS_CLASS = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Trim every Unicode white-space character, not only U+0020.

    Most texts have none at their ends, which the first and last character show; that
    short cut is for named columns only, so that nested expressions stay small.
    """
    if not isinstance(c, str):
        return F.btrim(c, F.lit(WHITESPACE))
    return F.when(_is_space(F.left(c, F.lit(1))) | _is_space(F.right(c, F.lit(1))), trim(F.col(c))).otherwise(F.col(c))


def ltrim(c: Column | str) -> Column:
    if not isinstance(c, str):
        return F.ltrim(c, F.lit(WHITESPACE))
    return F.when(_is_space(F.left(c, F.lit(1))), ltrim(F.col(c))).otherwise(F.col(c))


def rtrim(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(WHITESPACE))


def _is_space(one: Column) -> Column:
    return F.contains(F.lit(WHITESPACE), one)


def any_contains(c: Column, needles: list[str]) -> Column:
    """True if the string holds any needle. Plain substring search, no regex."""
    found = c.contains(needles[0])
    for needle in needles[1:]:
        found = found | c.contains(needle)
    return found


def after_first(c: Column, sep: str) -> Column:
    """Text after the first ``sep`` (the caller checks that it occurs)."""
    return F.substr(c, F.instr(c, sep) + F.lit(len(sep)))


# -- escapes -------------------------------------------------------------------

def unescape(c: Column | str) -> Column:
    r"""Decode ``\n \r \t \\ \" \'`` in one left-to-right pass.

    Splitting into escape pairs and plain runs keeps the pass linear and makes
    ``\\n`` a backslash followed by ``n``; unknown pairs stay as they are.
    """
    c = col(c)
    decoded = F.transform(
        F.regexp_extract_all(c, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0)),
        lambda t: F.when(t == r"\n", "\n")
        .when(t == r"\r", "\r")
        .when(t == r"\t", "\t")
        .when(t.isin("\\\\", '\\"', "\\'"), F.substr(t, F.lit(2)))
        .otherwise(t),
    )
    return F.when(c.contains("\\"), F.array_join(decoded, "")).otherwise(c)


# -- display helpers -----------------------------------------------------------

def preview(c: Column | str, limit: int = 20, head: int = 8, tail: int = 5) -> Column:
    """Keep short values; show the first 8 and last 5 characters of longer ones."""
    c = col(c)
    return F.when(
        F.char_length(c) > limit, F.concat(F.left(c, F.lit(head)), F.lit("..."), F.right(c, F.lit(tail)))
    ).otherwise(c)


def truncate(c: Column | str, max_len: int) -> Column:
    """Cut values longer than ``max_len`` bytes and add ``...``; cuts on characters."""
    c = col(c)
    keep = max(max_len - 3, 0)
    return F.when(F.octet_length(c) <= max_len, c).otherwise(F.concat(F.left(c, F.lit(keep)), F.lit("...")))


def redact(c: Column | str) -> Column:
    """Stars for up to 8 bytes, otherwise the first 4 characters and ``...****``."""
    c = col(c)
    return F.when(F.octet_length(c) <= 8, F.repeat(F.lit("*"), F.octet_length(c))).otherwise(
        F.concat(F.left(c, F.lit(4)), F.lit("...****"))
    )


def pluralize(n: Column | str, singular: str, plural: str) -> Column:
    n = col(n)
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, singular).otherwise(plural))


def human_readable_size(n: Column | str) -> Column:
    """Binary units, two decimals, capped at TB."""
    size = col(n).cast("double")
    out = F.format_string("%.2f TB", size / F.lit(1024.0**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(
            size < F.lit(1024.0 ** (power + 1)), F.format_string(f"%.2f {unit}", size / F.lit(1024.0**power))
        ).otherwise(out)
    return out


# -- key styles ----------------------------------------------------------------

def camel_case(c: Column | str) -> Column:
    parts = F.split(col(c), "_")
    tail = F.transform(
        F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p != ""),
        lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2)))),
    )
    return F.concat(F.lower(F.element_at(parts, 1)), F.array_join(tail, ""))


def snake_case(c: Column | str) -> Column:
    """Underscore at lower->Upper and before the last capital of a run, then lower."""
    return F.lower(
        F.regexp_replace(col(c), r"(?<=\p{javaLowerCase})(?=\p{javaUpperCase})"
                         r"|(?<=\p{javaUpperCase})(?=\p{javaUpperCase}\p{javaLowerCase})", "_")
    )


def base64_text(c: Column | str) -> Column:
    """Standard padded base64 of the UTF-8 bytes, on one line."""
    return F.translate(F.base64(F.encode(col(c), "UTF-8")), "\r\n", "")


def json_string(c: Column | str) -> Column:
    """A JSON string literal, quotes included."""
    wrapped = F.to_json(F.array(col(c)))
    return F.substr(wrapped, F.lit(2), F.char_length(wrapped) - F.lit(2))


# -- globs ---------------------------------------------------------------------

def wildcard_regex(pattern: str) -> str:
    """Regex for ``*`` (any run) and ``?`` (any one character), whole string."""
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return rf"(?s)\A{body}\z"


def path_glob_regex(pattern: str) -> str | None:
    """Regex for a path glob with ``* ? [..] [!..]``; None if it is malformed.

    ``*`` also crosses ``/``. ``**`` is only valid as a whole path component.
    """
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**", i):
            starts = i == 0 or pattern[i - 1] == "/"
            ends = pattern[i + 2 : i + 3] in ("", "/")
            if not (starts and ends):
                return None
            if pattern[i + 2 : i + 3] == "/":
                out.append("(?:.*/)?")
                i += 3
            else:
                out.append(".*")
                i += 2
            continue
        if ch == "[":
            negated = pattern[i + 1 : i + 2] == "!"
            start = i + (2 if negated else 1)
            end = pattern.find("]", start + 1)
            if end < 0:
                return None
            members = re.sub(r"([\\\[\]^&])", r"\\\1", pattern[start:end])
            out.append("[" + ("^" if negated else "") + members + "]")
            i = end + 1
            continue
        out.append({"*": ".*", "?": "."}.get(ch, re.escape(ch)))
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def affix_match(c: Column | str, pattern: str) -> Column:
    """Single-pattern filter: ``*`` is a wildcard only at either end."""
    c = col(c)
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*") and pattern.endswith("*"):
        return c.contains(pattern[1:-1])
    if pattern.startswith("*"):
        return c.endswith(pattern[1:])
    if pattern.endswith("*"):
        return c.startswith(pattern[:-1])
    return c == pattern
