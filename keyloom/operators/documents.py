"""Documents as ordered rows: a header, the entries, a footer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, ENTRY, FOOTER = 0, 1, 2


def document_rows(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    text: str = "text",
    header: Column | None = None,
    separator: str | Column = "",
    footer: Column | None = None,
) -> DataFrame:
    """``(keys, section, order, text)``: the rows of each document, of any size.

    Texts in the order of ``section`` and ``order`` concatenate to the document; of entries
    with equal order, the one without a separator comes first. No task gathers a document
    and nothing is copied: equal entries are counted, and the first of a document, which
    alone has no separator before it, is found by a join on its whole place, which is not
    hot however long the document. Rows are dealt by their place before they are counted:
    most are unique, and counts beside the reader would hold a whole split of them in one
    task. Header and footer rows have null order columns; empty ones are left out.
    """
    place = list(dict.fromkeys([*order, text]))
    counted = rows.repartition(*keys, *place).groupBy(*keys, *place).agg(F.count(F.lit(1)).alias("_n"))
    first = counted.groupBy(*keys).agg(F.min(F.struct(*place)).alias("_first"))
    sep = F.lit(separator) if isinstance(separator, str) else separator
    named = first.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(f"_first.{c}").alias(f"_at_{c}") for c in place], F.lit(True).alias("_is_first"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys] + [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in place])
    joined = counted.join(named, same, "left").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    opens = F.coalesce(F.col("_is_first") & (F.col("_i") == 1), F.lit(False))
    entries = joined.select(*keys, F.lit(ENTRY).alias("section"), *order, F.concat(F.when(opens, "").otherwise(sep), F.col(text)).alias("text"))
    ends = F.array(*[
        F.struct(F.lit(n).alias("section"), (F.lit("") if c is None else c).alias("text")) for n, c in ((HEADER, header), (FOOTER, footer))
    ])
    types = dict(rows.dtypes)
    outer = first.select(*keys, F.explode(ends).alias("_e")).filter(F.col("_e.text") != "").select(
        *keys, "_e.section", *[F.lit(None).cast(types[c]).alias(c) for c in order], "_e.text"
    )
    return entries.unionByName(outer)


def write_lines(rows: DataFrame, path: str, order: list[str], text: str = "text", partitions: int | None = None) -> None:
    """Write ordered rows as text: range partitioning splits even one huge document."""
    by = [F.col(c) for c in order]
    spread = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).select(F.col(text).alias("value")).write.text(path)


def write_documents(
    rows: DataFrame, path: str, keys: list[str], order: list[str], partition_by: str | None = None, separator: str = ""
) -> None:
    """Write the rows of :func:`document_rows` as text lines, a document's rows in order.

    ``separator`` tells the first of several entries with equal order from the others.
    """
    by = [F.col(c) for c in dict.fromkeys([*([partition_by] if partition_by else []), *keys, "section", *order])]
    by += [F.col("text").startswith(separator)] if separator else []
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    line = F.regexp_replace("text", r"\n\z", "").alias("value")  # the writer ends each line
    writer = ordered.select(line, *([F.col(partition_by)] if partition_by else [])).write
    (writer.partitionBy(partition_by) if partition_by else writer).text(path)
