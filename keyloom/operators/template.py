"""Template rendering: templates and variables meet in one join on (project, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.filters import FILTERS, apply_filter
from keyloom.operators.joins import join_skewed

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_REFERENCE = rf"\$\{{{_NAME}\}}|\{{\{{{_NAME}(?:\|[^}}]+)?\}}\}}|\${_NAME}(?U:\b)"
# One reference of any style, or a plain run, or a single stray character.
_PIECES = rf"(?s){_REFERENCE}|[^$\{{]+|."


def pieces(body: Column | str) -> Column:
    """Template pieces in order: ``text``, and ``name`` / ``filter`` for references."""

    def piece(s: Column) -> Column:
        inner = F.regexp_extract(s, rf"\A(?:\$\{{|\{{\{{|\$)({_NAME})", 1)
        is_ref = s.rlike(rf"\A(?:{_REFERENCE})\z")
        filtered = F.regexp_extract(s, r"\A\{\{[^|]*\|([^}]+)\}\}\z", 1)
        return F.struct(
            s.alias("text"),
            F.when(is_ref, inner).alias("name"),
            F.when(is_ref & (filtered != ""), filtered).alias("filter"),
        )

    return F.transform(F.regexp_extract_all(body, F.lit(_PIECES), F.lit(0)), piece)


def references(templates: DataFrame) -> DataFrame:
    """``(project_id, template_id, pos, name, filter)`` of every reference."""
    return _exploded(templates).filter(F.col("name").isNotNull()).drop("text")


def _exploded(templates: DataFrame) -> DataFrame:
    return templates.select(
        "project_id", "template_id", F.posexplode(pieces("body")).alias("pos", "_p")
    ).select("project_id", "template_id", "pos", "_p.*")


def _frequencies(templates: DataFrame) -> DataFrame:
    """References of every 16th template: they tell a join which names are hot, and decide nothing else."""
    return references(templates.where(F.pmod(F.xxhash64("template_id"), F.lit(16)) == 0))


def undefined(templates: DataFrame, vars_: DataFrame) -> DataFrame:
    """Distinct names without a variable, ``pos`` of the first use."""
    known = vars_.select("project_id", F.col("key").alias("name"))
    return (
        join_skewed(references(templates), known, ["project_id", "name"], "left_anti", _frequencies(templates))
        .groupBy("project_id", "template_id", "name")
        .agg(F.min("pos").alias("pos"))
    )


def render(templates: DataFrame, vars_: DataFrame, default_when_absent: bool = False) -> DataFrame:
    """``(project_id, template_id, text, error)`` of every template.

    Values are inserted literally, once, and never scanned again. A reference without
    a variable or with an unknown filter stays as written; ``|default:x`` replaces a
    blank value (and an absent variable with ``default_when_absent``). A failing
    ``|int`` gives a null text and an error that names the variable.
    """
    flat = _exploded(templates)
    lookup = vars_.select("project_id", F.col("key").alias("name"), F.col("value").alias("_v"))
    name, value, how = F.col("name"), F.col("_v"), F.col("filter")
    known_filter = how.isNull() | how.isin(FILTERS) | how.startswith("default:")
    result = apply_filter(how, value)
    fallback = F.col("text")
    if default_when_absent:
        fallback = F.when(how.startswith("default:"), apply_filter(how, F.lit(""))).otherwise(fallback)
    out = F.when(value.isNull(), fallback).when(~known_filter, F.col("text")).otherwise(result)
    failed = value.isNotNull() & (how == "int") & result.isNull()
    refs = join_skewed(flat.filter(name.isNotNull()), lookup, ["project_id", "name"], "left", _frequencies(templates)).select(
        "project_id", "template_id", "pos", F.coalesce(out, F.lit("")).alias("text"),
        F.when(failed, F.concat(F.lit("not an integer: "), name)).alias("error"),
    )
    plain = flat.filter(name.isNull()).select(
        "project_id", "template_id", "pos", "text", F.lit(None).cast("string").alias("error")
    )
    # The group is one template's own pieces.
    whole = refs.unionByName(plain).groupBy("project_id", "template_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_g"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"),
    )
    text = F.when(F.col("error").isNull(), F.array_join(F.col("_g.text"), ""))
    return whole.select("project_id", "template_id", text.alias("text"), "error")
