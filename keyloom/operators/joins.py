"""Joins of rows with a small side when one key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Counters of the frequency sketch: what it holds at any table size.
SKETCH_CELLS = 1 << 16
# A cell is hot if its rows are more than this part of an exchange's task.
HOT_PART = 0.25
# How many parts a task's worth of a hot key is dealt into: many small ones even out.
PARTS_PER_TASK = 8


def shuffle_width(spark: SparkSession) -> int:
    """How many tasks an exchange of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _cell(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(SKETCH_CELLS))


def heavy_hitters(rows: DataFrame, on: list[str], width: int) -> DataFrame:
    """``(_cell, _copies)`` of the sketch's hot cells, in a table of at most ``width / HOT_PART`` rows.

    A cell counts all keys of one hash, so it never counts a key too low; keys that share a
    cell with a hot one are split with it, which costs copies but changes no result. The
    counts are pre-aggregated in the tasks. The copies of all hot cells together are at most
    ``PARTS_PER_TASK * width`` and one for each hot cell.
    """
    counts = rows.groupBy(_cell(on).alias("_cell")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each cell, at most SKETCH_CELLS
    whole = counts.groupBy().agg(F.sum("n").alias("total"), F.collect_list(F.struct("_cell", "n")).alias("cells"))
    hot = F.filter("cells", lambda c: c["n"] * width > F.col("total") * HOT_PART)
    return whole.select("total", F.explode(hot).alias("c")).select(
        F.col("c._cell").alias("_cell"), F.ceil(F.col("c.n") * PARTS_PER_TASK * width / F.col("total")).cast("int").alias("_copies")
    )


def join_skewed(
    rows: DataFrame, groups: DataFrame, on: str | list[str], how: str = "inner", frequencies: DataFrame | None = None
) -> DataFrame:
    """Join ``rows`` with ``groups`` on ``on``; only keys that hold many rows meet copies of their groups.

    Hot keys are found by :func:`heavy_hitters`, whose bounded result is broadcast; a hot
    key's rows are dealt over as many copies of its groups as its share of all rows asks
    for. All other keys take part as they are, in the same join. ``frequencies`` may stand
    for ``rows`` where counting all of them costs too much: it steers the plan, never the
    result. ``how`` is inner, left, left_semi or left_anti.
    """
    on = [on] if isinstance(on, str) else list(on)
    hot = F.broadcast(heavy_hitters((rows if frequencies is None else frequencies).select(*on), on, shuffle_width(rows.sparkSession)))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = rows.withColumn("_cell", _cell(on)).join(hot, "_cell", "left").withColumn(
        "_copy", F.when(F.col("_copies") > 1, F.pmod(F.xxhash64(*rows.columns), F.col("_copies")).cast("int")).otherwise(0)
    )
    copied = groups.withColumn("_cell", _cell(on)).join(hot, "_cell", "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), copies - 1))
    ).drop("_cell", "_copies")
    return dealt.drop("_cell", "_copies").join(copied, [*on, "_copy"], how).drop("_copy")
