"""Secret scan: lines -> units -> detections -> findings -> roll-ups.

The scan is one narrow pass (no shuffle) up to the findings; the roll-ups add one
partially aggregated shuffle. A huge or repeated source only adds input splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.secrets import DEFAULT_DETECTORS, Detector, is_placeholder
from keyloom.functions.text import WS_CLASS, after_first, ltrim, preview, trim
from keyloom.operators.checkpoints import cut
from keyloom.operators.extract import line_array, to_lines

TOKEN_SPLIT = rf"""[{WS_CLASS}=:"']"""
MIN_TOKEN_BYTES = 20


def tokens(line: Column | str) -> Column:
    """Tokens longer than 20 bytes between white space, ``= : " '``."""
    return F.filter(F.split(line, TOKEN_SPLIT), lambda t: F.octet_length(t) > MIN_TOKEN_BYTES)


_UNITS = "array<struct<key:string,value:string>>"


def unit_array(line: Column, is_kv: Column) -> Column:
    """What the detectors look at in a line: one pair in KV mode, else every long token."""
    key = trim(F.regexp_replace(trim(F.substring_index(line, "=", 1)), r"\A(?:export)+", ""))
    pair = F.array(F.struct(key.alias("key"), trim(after_first(line, "=")).alias("value")))
    singles = F.transform(tokens(line), lambda t: F.struct(F.lit("").alias("key"), t.alias("value")))
    return F.when(is_kv, F.when(line.contains("="), pair).otherwise(F.array().cast(_UNITS))).otherwise(singles)


def line_units(lines: DataFrame, is_kv: Column) -> DataFrame:
    """Units as rows; ``variable`` is the key of a pair and null for a token."""
    rest = [c for c in lines.columns if c != "line"]
    exploded = lines.select(*rest, is_kv.alias("_pair"), F.explode(unit_array(F.col("line"), is_kv)).alias("_u"))
    return exploded.select(*rest, "_u.*", F.when(F.col("_pair"), F.col("_u.key")).alias("variable"))


def detect_units(
    units: DataFrame, detectors: list[Detector] | None = None, key: Column | None = None, value: str = "value",
    keep_clean: bool = False,
) -> DataFrame:
    """One row per hit of any detector, as ``_d``; with ``keep_clean`` also rows without one.

    The detectors are columns of one projection, which shares their common parts
    (lower-casing, trimming, the placeholder test) between all of them.
    """
    key = F.col("key") if key is None else key
    hits = [d(key, F.col(value)).alias(f"_hit{i}") for i, d in enumerate(detectors or DEFAULT_DETECTORS)]
    names = [f"_hit{i}" for i in range(len(hits))]
    explode = F.explode_outer if keep_clean else F.explode
    return units.select("*", *hits).select(*units.columns, explode(F.array_compact(F.array(*names))).alias("_d"))


def scan(
    files: DataFrame,
    detectors: list[Detector] | None = None,
    is_kv: Column | None = None,
    ignore_placeholders: bool = True,
    spread: int | None = None,
) -> DataFrame:
    """Findings of a corpus (``file_id``, ``path``, ``content`` and any other columns).

    ``is_kv`` picks the key/value mode; by default a path holding ``.env``.
    ``spread`` redistributes lines over that many tasks first, for corpora where a
    few texts hold most of the bytes.
    """
    mode = F.col("path").contains(".env") if is_kv is None else is_kv
    lines = to_lines(files.withColumn("_kv", mode))
    if spread:
        lines = lines.repartition(spread)
    units = line_units(lines, F.col("_kv"))
    rest = [c for c in units.columns if c not in ("key", "value", "variable", "_kv")]
    hits = detect_units(units, detectors)
    if ignore_placeholders:
        # The built-in detectors already skip placeholders; this covers added ones.
        hits = hits if detectors is None else hits.filter(~is_placeholder("value"))
    return hits.select(
        *rest,
        "_d.detector", "_d.pattern", "_d.confidence",
        preview("value").alias("value_preview"),
        location("path", "line_no", "variable").alias("location"),
        "variable", "_d.action_url",
    )


def location(path: str, line_no: str, variable: str) -> Column:
    base = F.concat(F.col(path), F.lit(":"), F.col(line_no).cast("string"))
    return F.when(F.col(variable).isNull(), base).otherwise(
        F.concat(base, F.lit(" ("), F.col(variable), F.lit(")"))
    )


def scan_lines(lines: DataFrame, rules: list[Detector]) -> DataFrame:
    """Opt-in rules over whole lines, for shapes that contain blanks (key headers)."""
    rest = [c for c in lines.columns if c != "line"]
    hits = detect_units(lines, rules, key=F.lit(""), value="line")
    return hits.select(*rest, "_d.*", preview("line").alias("value_preview"))


def _counts(confidence: Column) -> list[Column]:
    return [
        F.count(confidence).alias("secrets_found"),
        F.count_if(confidence == "high").alias("high_confidence"),
        F.count_if(confidence == "medium").alias("medium_confidence"),
        F.count_if(confidence == "low").alias("low_confidence"),
    ]


def scan_summary(files: DataFrame, findings: DataFrame, by: str = "project_id") -> DataFrame:
    """Report counters per group; groups without findings stay, with zeros.

    Files and findings go through one aggregate as (file, confidence) markers, so a
    group needs no join and a hot one arrives pre-aggregated.
    """
    marks = files.select(F.col(by), F.lit(1).alias("_file"), F.lit(None).cast("string").alias("confidence")).unionByName(
        findings.select(F.col(by), F.lit(0).alias("_file"), "confidence")
    )
    out = marks.groupBy(by).agg(F.sum("_file").cast("bigint").alias("files_scanned"), *_counts(F.col("confidence")))
    return out.withColumn("critical", (F.col("high_confidence") + F.col("medium_confidence")) > 0)


def scan_rollup(
    files: DataFrame, by: list[str], detectors: list[Detector] | None = None, is_kv: Column | None = None
) -> DataFrame:
    """Counters per group straight from the texts, in one pass over them.

    Every line stays inside its file's row here: only the hit confidences are
    carried to the aggregate, so clean groups keep their row without a join and the
    shuffle moves one short row per file at most.
    """
    mode = F.col("path").contains(".env") if is_kv is None else is_kv
    lines = files.select(*by, mode.alias("_kv"), F.explode_outer(line_array("content")).alias("line"))
    line = F.col("line")
    comment = ltrim("line").startswith("#")
    units = F.when(comment, F.array().cast(_UNITS)).otherwise(unit_array(line, F.col("_kv")))
    exploded = lines.select(*by, F.explode_outer(units).alias("_u")).select(*by, "_u.key", "_u.value")
    hits = detect_units(exploded, detectors, keep_clean=True)
    out = hits.groupBy(*by).agg(*_counts(F.col("_d.confidence")))
    return out.withColumn("critical", (F.col("high_confidence") + F.col("medium_confidence")) > 0)


def history(
    versions: DataFrame,
    needle: str,
    by: tuple[str, ...] = ("file_id",),
    order: str = "ver",
    bucket_size: int | None = None,
) -> DataFrame:
    """Versions that change how often ``needle`` occurs in a file; only the count travels.

    ``order`` is any column that sorts: numbers, however sparse, or times. ``bucket_size``
    is the number of versions a partition of the scan holds; the session's shuffle width
    decides it by default.
    """
    count = (F.char_length("content") - F.char_length(F.replace("content", F.lit(needle), F.lit("")))) / len(needle)
    counted = versions.select(*by, order, count.cast("int").alias("occurrences"))
    with_previous = previous_value(counted, list(by), order, "occurrences", bucket_size)
    previous = F.coalesce("_previous", F.lit(0))
    return (
        with_previous.select(*by, order, previous.alias("previous"), "occurrences")
        .filter(F.col("occurrences") != F.col("previous"))
    )


def previous_value(df: DataFrame, by: list[str], order: str, value: str, bucket_size: int | None = None) -> DataFrame:
    """``_previous``: the value of the row before in ``order``, for groups of any size.

    A prefix scan over range partitions: rows are sorted into partitions by group and
    order, so a large group lies in several partitions that follow each other. Inside a
    partition the row before is at hand; the first row of a group there takes the last
    value that an earlier partition holds of it, found among one row for each partition
    and group. The sorted rows are stored once, so that both readings see the same partitions.
    """
    parts = max(1, -(-df.count() // bucket_size)) if bucket_size else None
    places = [F.col(c) for c in (*by, order)]
    ranged = df.repartitionByRange(parts, *places) if parts else df.repartitionByRange(*places)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_part").orderBy(order)
    told = placed.withColumn("_lag", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    ends = placed.groupBy(*by, "_part").agg(F.max_by(value, order).alias("_last"))
    # a group has as many rows here as partitions
    carry = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*by).orderBy("_part"))).select(*by, "_part", "_carry")
    joined = told.join(carry, [*by, "_part"], "left")
    return joined.select(*df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")).alias("_previous"))
