"""Quoted values that span lines, stitched for files of any length.

Between two lines a reader is in one of four states: outside a value, or inside one that
``"``, ``'`` or a back-quote opened. A line is a function from the state before it to the
state behind it. Only lines that open a quote or end in one can change the state; all
others are the identity and take no part. Such functions compose associatively, so the
marked lines of one file are walked in blocks by many tasks:

1. every block of ``BLOCK`` lines folds its marked lines into one function (four states);
2. blocks are composed the same way into blocks of blocks, until a file is one row;
3. on the way back each block learns the state it begins in, and the place where the
   value that is open there began;
4. every block then walks its marked lines once, from that state.

A block is a run of sorted rows that a task reads one by one: no row and no task holds a
block, and sorts may spill. What comes out are the spans of values, met by their lines in
a join on the line's whole place.

Spans, their lines and the lengths of files grow with the input, while Spark estimates
them by the scan that they are exploded from. Both joins therefore ask for a merge of
sorted rows: a broadcast would gather a row for each such line or file on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from keyloom.functions.text import WS_CLASS, any_contains, rtrim, trim

QUOTES = ["\"", "'", "`"]
# A line that starts a quoted value and does not close it: the text after the
# opening quote does not end in the same quote.
OPENS = rf"""(?s)\A[{WS_CLASS}]*(?:export[{WS_CLASS}]+)?[A-Za-z][A-Za-z0-9_]*[{WS_CLASS}]*=[{WS_CLASS}]*(["'`])(?!.*\1[{WS_CLASS}]*\z)"""
BLOCK = 65536
STATES = range(len(QUOTES) + 1)  # 0: outside; i: inside a value that QUOTES[i - 1] opened


def opening_quote(line: Column) -> Column:
    """The quote a line opens and does not close, or an empty text."""
    return F.when(any_contains(line, QUOTES), F.regexp_extract(line, OPENS, 1)).otherwise("")


def _marked(lines: DataFrame, by: list[str]) -> DataFrame:
    """``(by, i, moves, opened)`` of the lines that open a quote or end in one.

    ``moves`` holds two bits for each state: the state behind the line if it is entered in that one.
    ``opened`` is null: only state 0 opens a value here, at the line itself.
    """
    own = F.col("line_no").cast("long") - 1
    quotes = F.array(*map(F.lit, QUOTES))
    marks = lines.where(any_contains(F.col("line"), QUOTES)).select(
        *by, own.alias("i"), F.array_position(quotes, opening_quote(F.col("line"))).cast("int").alias("_q"),
        F.array_position(quotes, F.right(rtrim("line"), F.lit(1))).cast("int").alias("_e"),
    )
    inside = [F.when(F.col("_e") == q, 0).otherwise(q << 2 * q) for q, _ in enumerate(QUOTES, 1)]
    return marks.where("_q > 0 or _e > 0").select(*by, "i", reduce(Column.__add__, inside, F.col("_q")).alias("moves"), F.lit(None).cast("array<bigint>").alias("opened"))


def _after(moves: int, opened: list | None, i: int, state: int, since: int | None) -> tuple[int, int | None]:
    """The state behind an entry and where the value that is then open began."""
    after = moves >> 2 * state & 3
    if after == 0:
        return 0, None
    began = (None if state else i) if opened is None else opened[state]
    return after, since if began is None else began


def _begins(batch: pa.RecordBatch, n_key: int, last: tuple | None) -> tuple[list[bool], tuple | None]:
    """Which rows begin another block than the row before, and the last row's key; ``last`` is the key before the batch."""
    if batch.num_rows == 0:
        return [], last
    new = np.zeros(batch.num_rows, bool)
    for c in batch.columns[:n_key]:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first, end = (tuple(c[i].as_py() for c in batch.columns[:n_key]) for i in (0, batch.num_rows - 1))
    new[0] = first != last
    return new.tolist(), end


def _ints(column: pa.Array) -> list:
    """Nulls come out as -1."""
    return column.fill_null(-1).to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.Array) -> list:
    return [None] * len(column) if column.null_count == len(column) else column.to_pylist()


def _folded(n_by: int):
    """Sorted ``(by, _b, i, moves, opened)`` -> ``(by, i, moves, opened)``: one row for each block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, key, reached = None, None, []

        def composed(keys: pa.RecordBatch, done: list) -> pa.RecordBatch:
            moves = [sum(after << 2 * s for s, (after, _) in enumerate(r)) for r in done]
            return pa.RecordBatch.from_arrays(
                [*keys.columns, pa.array(moves, pa.int32()), pa.array([[since for _, since in r] for r in done], pa.list_(pa.int64()))],
                names=[*keys.schema.names[:n_by], "i", "moves", "opened"],
            )

        for batch in batches:
            new, last = _begins(batch, n_by + 1, last)
            keys, ends, done = batch.select(range(n_by + 1)), [], []
            for at, (begins, i, moves, opened) in enumerate(zip(new, _ints(batch.column(n_by + 1)), _ints(batch.column(n_by + 2)), _lists(batch.column(n_by + 3)), strict=True)):
                if begins:
                    if at > 0:
                        ends.append(at - 1)
                        done.append(reached)
                    elif key is not None:
                        yield composed(key, [reached])
                    reached = [(s, None) for s in STATES]
                reached = [_after(moves, opened, i, s, since) for s, since in reached]
            if new:
                key = keys.slice(len(new) - 1)
            yield composed(keys.take(pa.array(ends, pa.int64())), done)
        if key is not None:
            yield composed(key, [reached])

    return task


def _walked(n_by: int):
    """Sorted ``(by, _b, i, moves, opened, state, since)`` -> ``(by, i, state, since, after)``.

    A row without ``i`` begins a block with its ``state`` and ``since``; without one a block begins outside.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, since = None, 0, None
        for batch in batches:
            new, last = _begins(batch, n_by + 1, last)
            rows = zip(new, *[_ints(batch.column(n_by + k)) for k in (1, 2)], _lists(batch.column(n_by + 3)), *[_ints(batch.column(n_by + k)) for k in (4, 5)], strict=True)
            kept, out = [], []
            for at, (begins, i, moves, opened, begin, begin_since) in enumerate(rows):
                if begins:
                    state, since = 0, None
                if i < 0:
                    state, since = begin, begin_since
                    continue
                after, opens = _after(moves, opened, i, state, since)
                kept.append(at)
                out.append((i, state, since, after))
                state, since = after, opens
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.select(range(n_by)).take(pa.array(kept, pa.int64())).columns, *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)]],
                names=[*batch.schema.names[:n_by], "i", "state", "since", "after"],
            )

    return task


def _in_order(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Each block's rows in one task, in order; a row without ``i`` leads."""
    return blocks.repartition(*by, "_b").sortWithinPartitions(*by, "_b", F.col("i").asc_nulls_first())


def entry_states(entries: DataFrame, by: list[str], levels: int, block: int = BLOCK) -> DataFrame:
    """``(by, i, state, since, after)`` for every entry ``(by, i, moves, opened)``; ``levels`` is the number of levels above these entries."""
    files = [f for f in entries.schema.fields if f.name in by]
    files.sort(key=lambda f: by.index(f.name))
    place, moves = StructField("i", LongType()), [StructField("moves", IntegerType()), StructField("opened", ArrayType(LongType()))]
    state = [StructField("state", IntegerType()), StructField("since", LongType())]
    blocks = entries.select(*by, F.floor(F.col("i") / block).alias("_b"), "i", "moves", "opened")
    rows = blocks.withColumns({f.name: F.lit(None).cast(f.dataType) for f in state})
    if levels > 0:
        folded = _in_order(blocks, by).mapInArrow(_folded(len(by)), StructType([*files, place, *moves]))
        above = entry_states(folded, by, levels - 1, block)
        starts = above.select(*by, F.col("i").alias("_b"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in (place, *moves)], "state", "since")
        # blocks that begin outside a value need no row to say so
        rows = rows.unionByName(starts.where("state > 0"))
    return _in_order(rows, by).mapInArrow(_walked(len(by)), StructType([*files, place, *state, StructField("after", IntegerType())]))


def _spans(lines: DataFrame, by: list[str], levels: int, block: int) -> DataFrame:
    """``(by, first, last, ended)`` of every value that spans lines, counted from 0."""
    states = entry_states(_marked(lines, by), by, levels, block)
    turns = states.where("(state = 0) != (after = 0)")
    spans = turns.groupBy(*by, F.coalesce("since", "i").alias("first")).agg(F.max(F.when(F.col("after") == 0, F.col("i"))).alias("last"))
    lengths = lines.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg((F.max("line_no").cast("long") - 1).alias("_end"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    dangling = spans.where("last is null").join(lengths.hint("merge"), same).select(*by, "first", F.col("_end").alias("last"), F.lit(False).alias("ended"))
    return spans.where("last is not null").withColumn("ended", F.lit(True)).unionByName(dangling)


def line_values(lines: DataFrame, by: list[str], levels: int = 1, block: int = BLOCK) -> DataFrame:
    """``(by, line_no, text, multi, ended)``: the statements of files given as lines ``(by, line_no, line)``.

    Line numbers are dense from 1. A value that spans lines is one row, its lines after
    the first as they are; one that is never closed reaches to the end of its file and
    is not ``ended``. Blank lines and comments outside values are left out. ``levels``
    blocks of blocks hold files of ``block ** (levels + 1)`` lines: one is enough for any int.
    """
    spans = _spans(lines, by, levels, block)
    # first the blocks of a span, then their lines: no list is longer than a block
    steps = spans.select("*", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("_b"))
    within = F.sequence(F.greatest(F.col("first"), F.col("_b") * block) + 1, F.least(F.col("last") + 1, (F.col("_b") + 1) * block))
    inside = steps.select(
        *[F.col(c).alias(f"_in_{c}") for c in by], (F.col("first") + 1).alias("_first"), F.col("ended").alias("_ended"), F.explode(within).alias("_in_line")
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in by])
    told = lines.join(inside.hint("merge"), same & (F.col("line_no").cast("long") == F.col("_in_line")), "left")
    text = trim("line")
    single = told.where(F.col("_first").isNull() & (text != "") & ~text.startswith("#")).select(
        *by, F.col("line_no").cast("int").alias("line_no"), F.col("line").alias("text"), F.lit(False).alias("multi"), F.lit(True).alias("ended")
    )
    piece = F.when(F.col("line_no") == F.col("_first"), rtrim("line")).otherwise(F.col("line"))
    # the group is one value's own lines
    whole = told.where("_first is not null").groupBy(*by, "_first").agg(
        F.sort_array(F.collect_list(F.struct(F.col("line_no"), piece.alias("line")))).alias("_l"), F.max("_ended").alias("ended")
    )
    multi = whole.select(
        *by, F.col("_first").cast("int").alias("line_no"), F.array_join(F.col("_l.line"), "\n").alias("text"), F.lit(True).alias("multi"), "ended"
    ).where(trim("text") != "")
    return single.unionByName(multi)
