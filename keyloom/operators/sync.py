"""Masked synchronisation between a project's env and example variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.checks import follows_naming
from keyloom.functions.placeholders import DEFAULT_PLACEHOLDER, is_placeholder_value, make_placeholder
from keyloom.operators.joins import join_skewed

PLAN_COLUMNS = [
    "project_id", "target", "action", "key", "old_value", "new_value", "is_placeholder", "naming_violation",
]


def _named(plan: DataFrame, policy: str) -> DataFrame:
    """``ignore``/``warn`` only mark odd names; ``error`` fails the job on the first one."""
    bad = ~follows_naming("key")
    if policy == "error":
        message = F.concat(
            F.lit("Non-standard variable name '"), F.col("key"), F.lit("'. Expected: UPPERCASE_WITH_UNDERSCORES")
        )
        bad = F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(False))
    return plan.withColumn("naming_violation", bad).select(*PLAN_COLUMNS)


def _plan(rows: DataFrame, target: str, new_value: Column, is_placeholder: Column) -> DataFrame:
    return rows.select(
        "project_id", F.lit(target).alias("target"), F.lit("add").alias("action"), "key",
        F.lit(None).cast("string").alias("old_value"), new_value.alias("new_value"),
        is_placeholder.alias("is_placeholder"),
    )


def forward(
    env: DataFrame,
    example: DataFrame,
    rules: list[tuple[str, str]] | None = None,
    default: str = DEFAULT_PLACEHOLDER,
    actual_values: bool = False,
    naming: str = "warn",
) -> DataFrame:
    """Keys to add to the example side. A project without an example gets all its keys."""
    absent = env.select("project_id", "key", "value").join(
        example.select("project_id", "key"), ["project_id", "key"], "left_anti"
    )
    value = F.col("value") if actual_values else make_placeholder("key", "value", rules, default)
    return _named(_plan(absent, ".env.example", value, F.lit(not actual_values)), naming)


def reverse(
    env: DataFrame,
    example: DataFrame,
    default: str = DEFAULT_PLACEHOLDER,
    placeholders: bool = True,
    naming: str = "warn",
) -> DataFrame:
    """Keys to add to the env side.

    Projects that have an env get placeholders built with the default rules; projects
    without one get a copy, marked where a value is a placeholder already. Having an
    env is a distinct list of projects.
    """
    absent = example.select("project_id", "key", "value").join(
        env.select("project_id", "key"), ["project_id", "key"], "left_anti"
    )
    known = env.select("project_id").distinct().withColumn("_has_env", F.lit(True))
    rows = join_skewed(absent, known, "project_id", "left", frequencies=example)
    has_env = F.coalesce("_has_env", F.lit(False))
    value = F.when(has_env & F.lit(placeholders), make_placeholder("key", "value")).otherwise(F.col("value"))
    flag = F.when(has_env, F.lit(placeholders)).otherwise(is_placeholder_value("value", default))
    return _named(_plan(rows, ".env", value, flag), naming)


def masked_copy(
    vars_: DataFrame, rules: list[tuple[str, str]] | None = None, default: str = DEFAULT_PLACEHOLDER
) -> DataFrame:
    """Every variable with its placeholder; narrow."""
    return vars_.withColumn("value", make_placeholder("key", "value", rules, default))


def summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("project_id", "target", "action").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if("is_placeholder").alias("n_placeholders"),
        F.count_if("naming_violation").alias("n_naming_violations"),
    )
