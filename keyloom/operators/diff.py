"""Snapshot comparison per project: one full outer join on (project, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.secrets import is_sensitive_key


def _joined(left: DataFrame, right: DataFrame, reverse: bool) -> DataFrame:
    if reverse:
        left, right = right, left
    a = left.select("project_id", "key", F.col("value").alias("left_value"), F.col("pos").alias("left_pos"))
    b = right.select("project_id", "key", F.col("value").alias("right_value"), F.col("pos").alias("right_pos"))
    return a.join(b, ["project_id", "key"], "full_outer")


def _redacted(value: Column) -> Column:
    return F.when(is_sensitive_key("key"), F.concat(F.left(value, F.lit(2)), F.lit("***")))


def diff(left: DataFrame, right: DataFrame, ignore: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Missing (only right), extra (only left) and different keys.

    Sides hold one row per (project, key). ``pos`` orders each status: the right
    side's position for missing keys, the left side's otherwise. Redacted copies are
    set for different values of sensitive keys.
    """
    if ignore:
        left, right = (d.filter(~F.col("key").isin(ignore)) for d in (left, right))
    lp, rp = F.col("left_pos"), F.col("right_pos")
    status = (
        F.when(lp.isNull(), "missing")
        .when(rp.isNull(), "extra")
        .when(F.col("left_value") != F.col("right_value"), "different")
    )
    both = lp.isNotNull() & rp.isNotNull()
    return (
        _joined(left, right, reverse)
        .withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .select(
            "project_id", "key", "status", "left_value", "right_value",
            F.when(both, _redacted(F.col("left_value"))).alias("left_redacted"),
            F.when(both, _redacted(F.col("right_value"))).alias("right_redacted"),
            F.coalesce(F.when(lp.isNull(), rp), lp).alias("pos"),
        )
    )


def similarity(left: DataFrame, right: DataFrame, reverse: bool = False) -> DataFrame:
    """Key counts, overlap and Sørensen–Dice percent per project (no ignore list)."""
    counted = _joined(left, right, reverse).groupBy("project_id").agg(
        F.count("left_pos").alias("total_left"),
        F.count("right_pos").alias("total_right"),
        F.count_if(F.col("left_pos").isNotNull() & F.col("right_pos").isNotNull()).alias("overlap"),
    )
    return counted.withColumn("similarity_percent", dice("overlap", "total_left", "total_right"))


def dice(overlap: str, left: str, right: str) -> Column:
    total = F.col(left) + F.col(right)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.round(F.lit(2.0) * F.col(overlap) / total * 100.0, 2))


def has_changes(changes: DataFrame, projects: DataFrame) -> DataFrame:
    """One flag per project, False where the diff is empty."""
    marks = projects.select("project_id", F.lit(False).alias("c")).unionByName(
        changes.select("project_id", F.lit(True).alias("c"))
    )
    return marks.groupBy("project_id").agg(F.max("c").alias("has_changes"))


# Section titles of the patch format.
PATCH_TITLES = ["# Add these to .env:", "# Remove these from .env:", "# Update these in .env:"]


def patch_lines(changes: DataFrame, projects: DataFrame) -> DataFrame:
    """Patch text as ordered rows ``(project_id, section, pos, sub, text)``.

    Rows sort into the patch; nothing is gathered per project.
    """
    kv = lambda sign, value: F.concat(F.lit(sign), F.col("key"), F.lit("="), F.col(value))
    section = F.when(F.col("status") == "missing", 1).when(F.col("status") == "extra", 2).otherwise(3)
    texts = (
        F.when(F.col("status") == "missing", F.array(kv("+ ", "right_value")))
        .when(F.col("status") == "extra", F.array(kv("- ", "left_value")))
        .otherwise(F.array(kv("- ", "left_value"), kv("+ ", "right_value")))
    )
    body = changes.select("project_id", section.alias("section"), "pos", F.posexplode(texts).alias("sub", "text"))
    titles = F.array(*[
        F.struct(F.lit(i).alias("section"), F.lit(t).alias("text")) for i, t in enumerate(PATCH_TITLES, 1)
    ])
    heads = projects.select("project_id", F.explode(titles).alias("t")).select(
        "project_id", "t.section", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).alias("sub"), "t.text"
    )
    return body.withColumn("pos", F.col("pos").cast("bigint")).unionByName(heads)
