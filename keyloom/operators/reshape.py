"""Key renaming, payload export and rename audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import (
    affix_match, base64_text, camel_case, json_string, snake_case, wildcard_regex,
)
from keyloom.operators.documents import document_rows

STYLES = {"upper": F.upper, "lower": F.lower, "camel": camel_case, "snake": snake_case}


def select_keys(vars_: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Single-pattern filter, exclude first; ``*`` only at the ends of a pattern."""
    if exclude is not None:
        vars_ = vars_.filter(~affix_match("key", exclude))
    return vars_.filter(affix_match("key", include)) if include is not None else vars_


def select_keys_any(
    vars_: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """Pattern lists: keep on any include, drop on any exclude; ``*`` and ``?`` anywhere."""
    any_of = lambda patterns: F.col("key").rlike("|".join(wildcard_regex(p) for p in patterns))
    if include is not None:
        vars_ = vars_.filter(any_of(include) if include else F.lit(False))
    return vars_.filter(~any_of(exclude)) if exclude else vars_


def new_key(prefix: str | None = None, style: str | None = None, key: Column | str = "key") -> Column:
    """Prefix first, then the case style."""
    k = F.col(key) if isinstance(key, str) else key
    k = F.concat(F.lit(prefix), k) if prefix else k
    return STYLES[style](k) if style else k


def rename(
    vars_: DataFrame, prefix: str | None = None, style: str | None = None, base64: bool = False
) -> DataFrame:
    """Adds ``new_key`` and ``new_value``; narrow."""
    value = base64_text("value") if base64 else F.col("value")
    return vars_.withColumn("new_key", new_key(prefix, style)).withColumn("new_value", value)


def restrip(vars_: DataFrame, strip: str | None = None, add: str | None = None) -> DataFrame:
    """Strip then add a prefix; keys that collide keep the first position and the last value."""
    k = F.col("key")
    if strip:
        k = F.when(k.startswith(strip), F.substr(k, F.lit(len(strip) + 1))).otherwise(k)
    if add:
        k = F.concat(F.lit(add), k)
    return collapse(vars_.withColumn("new_key", k).withColumn("new_value", F.col("value")))


def collapse(renamed: DataFrame) -> DataFrame:
    """One row per (file, new key): last value, first position."""
    return renamed.groupBy("file_id", "new_key").agg(
        F.max_by("new_value", "pos").alias("new_value"), F.min("pos").alias("pos")
    )


# -- payloads ------------------------------------------------------------------

# Format names and their aliases.
FORMAT_ALIASES = {
    "json": "json",
    "yaml": "yaml", "yml": "yaml",
    "shell": "shell", "bash": "shell", "export": "shell",
    "aws": "aws-secrets", "aws-secrets": "aws-secrets", "aws-secrets-manager": "aws-secrets",
    "docker": "docker-compose", "docker-compose": "docker-compose", "compose": "docker-compose",
    "kubernetes": "kubernetes", "k8s": "kubernetes", "kubectl": "kubernetes",
    "terraform": "terraform", "tfvars": "terraform", "tf": "terraform",
    "doppler": "doppler", "vercel": "vercel", "railway": "railway",
}
JSON_FORMATS = ["json", "aws-secrets", "railway", "doppler", "vercel"]
LINE_FORMATS = ["yaml", "shell", "docker-compose", "kubernetes", "terraform"]
# Fixed parts of the payloads.
KUBERNETES_HEADER = "apiVersion: v1\nkind: Secret\nmetadata:\n  name: app-secrets\ntype: Opaque\n"
VERCEL_TARGETS = '["production","preview","development"]'


def format_name(name: str) -> str:
    return FORMAT_ALIASES[name.lower()]


def payload_entry(fmt: str, key: Column, value: Column) -> Column:
    """Text of one variable in a format."""
    k, v = json_string(key), json_string(value)
    if fmt in ("json", "aws-secrets", "railway"):
        return F.concat(k, F.lit(":"), v)
    if fmt == "doppler":
        return F.concat(k, F.lit(':{"value":'), v, F.lit(',"computed":false}'))
    if fmt == "vercel":
        return F.concat(k, F.lit(':{"type":"plain","value":'), v, F.lit(f',"target":{VERCEL_TARGETS}}}'))
    if fmt == "yaml":
        # A JSON string is a valid YAML scalar, so no value needs special cases.
        return F.concat(key, F.lit(": "), v, F.lit("\n"))
    if fmt == "shell":
        return F.concat(
            F.lit("export "), key, F.lit('="'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"\n')
        )
    if fmt == "docker-compose":
        return F.concat(F.lit("  - "), key, F.lit("="), value, F.lit("\n"))
    if fmt == "kubernetes":
        return F.concat(F.lit("  "), key, F.lit(": "), value, F.lit("\n"))
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lower(key), F.lit(' = "'), escaped, F.lit('"\n'))


def payload_header(fmt: Column, base64: bool = False) -> Column:
    data = "data:\n" if base64 else "stringData:\n"
    return (
        F.when(fmt.isin(JSON_FORMATS), "{")
        .when(fmt == "shell", "#!/bin/bash\n# Generated by keyloom\n\n")
        .when(fmt == "terraform", "# Generated by keyloom\n\n")
        .when(fmt == "docker-compose", "environment:\n")
        .when(fmt == "kubernetes", KUBERNETES_HEADER + data)
        .otherwise("")
    )


def export(
    vars_: DataFrame,
    formats: list[str],
    prefix: str | None = None,
    style: str | None = None,
    base64: bool = False,
    salts: int | None = None,
) -> DataFrame:
    """Document rows ``(file_id, format, section, pos, text)`` for several formats at once.

    Each variable explodes into one entry per format (a fixed, short list), so the
    variables are read once and there is no cross join. ``salts`` is accepted for callers
    of earlier versions; nothing is copied any more. JSON objects hold a key once
    (last value); line formats repeat colliding keys, as the formats' users expect.
    """
    names = list(dict.fromkeys(format_name(f) for f in formats))
    renamed = rename(vars_, prefix, style, base64).select("file_id", "pos", "new_key", "new_value")
    parts = []
    for rows, wanted in (
        (collapse(renamed), [n for n in names if n in JSON_FORMATS]),
        (renamed, [n for n in names if n in LINE_FORMATS]),
    ):
        if not wanted:
            continue
        entries = F.array(*[
            F.struct(F.lit(n).alias("format"), payload_entry(n, F.col("new_key"), F.col("new_value")).alias("text"))
            for n in wanted
        ])
        parts.append(rows.select("file_id", "pos", F.explode(entries).alias("e")).select("file_id", "pos", "e.*"))
    entries = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    is_json = F.col("format").isin(JSON_FORMATS)
    return document_rows(
        entries, ["file_id", "format"], ["pos"],
        header=payload_header(F.col("format"), base64),
        separator=F.when(is_json, ",").otherwise(""),
        footer=F.when(is_json, "}").otherwise(""),
    )


def destination_key(destination: Column, key: Column) -> Column:
    """Key spelling a destination accepts."""
    dashed = F.translate(key, "_", "-")
    return (
        F.when(destination == "azure", dashed)
        .when(destination == "gcp", F.lower(dashed))
        .when(destination == "terraform", F.lower(key))
        .otherwise(key)
    )


def collisions(renamed: DataFrame) -> DataFrame:
    """New keys that several old keys of a file share (counts only, nothing is gathered)."""
    return (
        renamed.groupBy("file_id", "new_key")
        .agg(
            F.count(F.lit(1)).alias("n_keys"),
            F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        )
        .filter(F.col("n_keys") > 1)
    )


def collision_members(renamed: DataFrame) -> DataFrame:
    """The variables behind :func:`collisions`, one row each."""
    found = collisions(renamed).select("file_id", "new_key")
    return renamed.join(found, ["file_id", "new_key"], "left_semi")
