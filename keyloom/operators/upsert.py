"""Upsert planning against the keys a destination already holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(
    secrets: DataFrame,
    existing: DataFrame,
    skip_existing: bool = False,
    overwrite: bool = False,
    dry_run: bool = False,
) -> DataFrame:
    """``action`` upload/skip and ``conflict`` per (destination, key).

    A dry run asks nothing of the destination, so it sees no existing keys. Existing
    keys are skipped unless they may be overwritten.
    """
    if dry_run:
        found = secrets.withColumn("_found", F.lit(False))
    else:
        known = existing.select("destination", "key").distinct().withColumn("_found", F.lit(True))
        found = secrets.join(known, ["destination", "key"], "left").withColumn(
            "_found", F.coalesce("_found", F.lit(False))
        )
    replace = F.lit(overwrite and not skip_existing)
    upload = ~F.col("_found") | replace
    return found.withColumn("action", F.when(upload, "upload").otherwise("skip")).withColumn(
        "conflict", F.col("_found") & replace
    ).drop("_found")


def summary(planned: DataFrame, dry_run: bool = False, lists_existing: bool = True) -> DataFrame:
    """Counts per destination.

    In a dry run nothing is uploaded; destinations that never list existing keys
    report every secret as skipped.
    """
    n_upload = F.count_if(F.col("action") == "upload")
    n_skip = F.count_if(F.col("action") == "skip")
    total = F.count(F.lit(1))
    uploaded = F.lit(0).cast("bigint") if dry_run else n_upload
    skipped = total if dry_run and not lists_existing else n_skip
    return planned.groupBy("destination").agg(
        total.alias("total"), n_upload.alias("planned"), uploaded.alias("uploaded"), skipped.alias("skipped"),
        F.count_if("conflict").alias("conflicts"),
        F.lit(0).cast("bigint").alias("failed"),
    )
