"""Detection rules that come as a table: thousands of regexes, of which a value runs few.

1. A regex that matches only texts with a certain literal names that literal
   (:func:`required_literal`). The literals of the whole table make one Aho-Corasick
   automaton, built once in a task, that finds all of them in one pass over a value.
2. A value is then a candidate of the rules whose literals it holds, and of those without
   a literal. Candidates meet their regexes in the same task, and Spark's own ``rlike``
   decides, so the result is that of running every rule on every value. Of rules with one
   regex only the first can be a hit, so a regex runs once on a value. Candidates are never
   shuffled: only each task's best hits of a unit are.

The rules are read in chunks of at most ``CHUNK_BYTES``: what a task holds and the driver
sends is bounded, and a larger table takes more passes over the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

CHUNK_BYTES = 32 << 20
MIN_LITERAL = 2
PIECE = 1 << 16  # candidates that a task holds at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def folded(text: str) -> str:
    return text.translate(_FOLD)


def _class_end(regex: str, at: int) -> int:
    """Behind the character class that begins at ``at``."""
    depth, i = 1, at + 1
    if regex[i:i + 1] == "^":
        i += 1
    if regex[i:i + 1] == "]":
        i += 1
    while i < len(regex) and depth:
        if regex[i] == "\\":
            i += 1
        elif regex[i] == "[":
            depth += 1
        elif regex[i] == "]":
            depth -= 1
        i += 1
    return i


def required_literal(regex: str) -> str:
    """The longest run of plain characters that every match holds, A-Z lower-cased; empty if none is certain.

    Only what stands outside groups, classes and alternatives counts, and a character that a
    quantifier may drop does not. A regex with flags, quoted parts or an alternative outside
    groups has no literal, which costs time only.
    """
    if "(?" in regex and not all(regex[i + 2:i + 3] in (":", "=", "!", "<", ">") for i in range(len(regex)) if regex[i:i + 2] == "(?"):
        return ""
    best, run, i, depth = "", "", 0, 0
    while i < len(regex):
        c, width, plain = regex[i], 1, ""
        if c == "\\":
            follow = regex[i + 1:i + 2]
            if follow in "QE" or not follow:
                return ""
            if follow.isalnum():
                # classes, anchors and escapes by number: nothing certain, and how far they reach is not read
                width = 2
                if follow in "xucpPkN0":
                    brace = regex.find("}", i) if regex[i + 2:i + 3] == "{" else -1
                    width = brace - i + 1 if brace > 0 else {"x": 4, "u": 6, "c": 3}.get(follow, 3)
            else:
                width, plain = 2, follow
        elif c == "[":
            width = _class_end(regex, i) - i
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|":
            if depth <= 0:
                return ""
        elif c not in ".^$*+?{":
            plain = c
        quantifier = regex[i + width:i + width + 1]
        may_be_absent = quantifier in ("*", "?") or (quantifier == "{" and regex[i + width + 1:i + width + 2] in ("0", ","))
        if c == ")" and depth == 0 or depth or not plain or may_be_absent:
            run = ""
        else:
            run += plain
            best = max(best, run, key=len)
            if quantifier in ("+", "{"):
                run = ""
        i += width
        if quantifier == "{":
            brace = regex.find("}", i)
            if brace < 0:
                return ""
            i = brace + 1
        elif quantifier in ("*", "+", "?") and quantifier:
            i += 1
    return folded(best) if len(best) >= MIN_LITERAL else ""


def _chunks(rules: DataFrame, limit: int) -> Iterator[tuple[list[tuple[int, str]], DataFrame]]:
    """(rule, literal) of the whole table in lists of at most ``limit`` bytes, with their rows; one list reaches the driver at a time."""
    size = rules.agg(F.coalesce(F.sum(F.octet_length("regex") + 64), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-int(size) * 2 // limit))
    for part in range(parts):
        some = rules.where(F.pmod(F.xxhash64("_rule"), F.lit(parts)) == part)
        yield [(r["_rule"], required_literal(r["regex"])) for r in some.select("_rule", "regex").toLocalIterator()], some


def _finder(literals: list[tuple[int, str]]):
    """Per batch: the rules that each value, the last column, is a candidate of, as lists of at most ``PIECE`` rules."""
    by_literal: dict[str, list[int]] = {}
    for rule, literal in literals:
        by_literal.setdefault(literal, []).append(rule)
    always = by_literal.pop("", [])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for literal, rules in by_literal.items():
            automaton.add_word(literal, rules)
        if by_literal:
            automaton.make_automaton()

        def piece(batch: pa.RecordBatch, rows: list[int], lists: list[list[int]]) -> pa.RecordBatch:
            taken = batch.take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "_rules"])

        for batch in batches:
            rows, lists, held = [], [], 0
            for row, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                met = set(always)
                if by_literal:
                    for _, rules in automaton.iter(folded(value)):
                        met.update(rules)
                found = list(met)
                for i in range(0, len(found), PIECE):
                    rows.append(row)
                    lists.append(found[i:i + PIECE])
                    held += len(lists[-1])
                    if held >= PIECE:
                        yield piece(batch, rows, lists)
                        rows, lists, held = [], [], 0
            if rows:
                yield piece(batch, rows, lists)

    return task


def numbered(rules: DataFrame) -> DataFrame:
    """``rules`` with a number for each distinct row, the same whenever it is read."""
    return rules.withColumn("_rule", F.xxhash64("name", "regex", "confidence", "action_url", "prio"))


def _asked(units: DataFrame, literals: list[tuple[int, str]]) -> DataFrame:
    """``units``, whose last column is the value, with ``_rule`` for each candidate."""
    schema = StructType([*units.schema.fields, StructField("_rules", ArrayType(LongType()))])
    found = units.mapInArrow(_finder(literals), schema)
    return found.select(*units.columns, F.explode("_rules").alias("_rule"))


def candidates(units: DataFrame, rules: DataFrame, value: str = "value", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(_unit, _rule)``: the rules of the table that a unit has to run."""
    out = units.sparkSession.createDataFrame([], "_unit long, _rule long")
    asked = units.where(F.col(value).isNotNull()).select("_unit", value)
    for literals, _ in _chunks(rules, chunk_bytes):
        out = out.unionByName(_asked(asked, literals).select("_unit", "_rule"))
    return out


def scan_rules(units: DataFrame, rules: DataFrame, unit: list[str], value: str = "value", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The hit of lowest ``prio`` (then name) of every unit: its ``unit`` columns, ``pattern``, ``confidence``, ``action_url``.

    ``units`` holds values beside the columns that name them; ``rules`` is a table
    ``(name, regex, confidence, action_url, prio)``. Rows with the same ``unit`` columns
    are one unit with several values.
    """
    order, hit = ["prio", "name", "regex"], ["name", "confidence", "action_url"]
    first = rules.where(F.col("regex").isNotNull()).groupBy("regex").agg(F.min(F.struct("prio", *hit)).alias("_b"))
    named = numbered(first.select("_b.*", "regex"))
    asked = units.where(F.col(value).isNotNull()).select(*unit, F.col(value).alias("_value"))
    met = None
    for literals, some in _chunks(named, chunk_bytes):
        # A chunk is bounded, so one task may order it and its rows may go to every task.
        placed = some.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
        hits = _asked(asked, literals).join(F.broadcast(placed.select("_rule", "regex", "_place")), "_rule").where(F.rlike(F.col("_value"), F.col("regex")))
        best = hits.groupBy(*unit).agg(F.min("_place").alias("_place")).join(F.broadcast(placed), "_place")
        best = best.select(*unit, F.struct(*order, *hit[1:]).alias("_b"))
        met = best if met is None else met.unionByName(best)
    return met.groupBy(*unit).agg(F.min("_b").alias("_b")).select(*unit, F.col("_b.name").alias("pattern"), "_b.confidence", "_b.action_url")
