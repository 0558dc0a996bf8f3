"""Lines and sentences of whole texts, their hashes, and texts without some of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ROW, cut, in_batches, keyed, marked
from .textbytes import SPACES, blocks, combine, hashes, runs, texts

NULL_DOC = (1 << 63) - 1  # a null doc_id comes last

# (start byte, row, hash, words) of each segment; a segment reaches to the next one's start
Finder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _of_words(start: np.ndarray, row: np.ndarray, h: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments that begin where ``new`` is set; a hash of the words in order."""
    first = np.flatnonzero(new)
    if not len(first):
        return start[:0], row[:0], h[:0], row[:0]
    segment = np.cumsum(new) - 1
    place = np.arange(len(h)) - first[segment]
    with np.errstate(over="ignore"):
        total = np.add.reduceat(combine(h, place), first)
    n = np.diff(np.append(first, len(h)))
    return start[first], row[first], combine(total, n), n


def _after_newline(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    line = np.searchsorted(np.flatnonzero(data == 0x0A), start)
    new = np.ones(len(start), bool)
    new[1:] = line[1:] != line[:-1]
    return new


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word; case of A-Z and white space make no difference."""
    start, end, row = runs(data, offsets, SPACES)
    new = _after_newline(data, start)
    new[1:] |= row[1:] != row[:-1]
    return _of_words(start, row, hashes(data, start, end), new)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences: they end with a word that ends in . ! or ?, or with the line; however long, each is whole."""
    start, end, row = runs(data, offsets, SPACES)
    new = _after_newline(data, start)
    closing = np.isin(data[end - 1], [0x21, 0x2E, 0x3F]) if len(end) else np.zeros(0, bool)
    new[1:] |= (row[1:] != row[:-1]) | closing[:-1]
    return _of_words(start, row, hashes(data, start, end), new)


def found(docs: DataFrame, finder: Finder, emit: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows that ``emit`` makes of the segments of each block of (key, doc, text) rows.

    ``emit`` gets key, doc, row, place in the row, hash and words of every segment: the key names
    the row of the table, doc only orders rows, and row is the place in the block.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            data, offsets = texts(batch.column(2))
            for first, last, part, bounds in blocks(data, offsets):
                _, row, h, n = finder(part, bounds)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                columns = emit(keys[first:last][row], ids[first:last][row], row, place, h, n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return in_batches(keyed(docs)).select(ROW, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("doc"), "text").mapInArrow(task, schema)


def without(docs: DataFrame, finder: Finder, ranges: DataFrame) -> DataFrame:
    """Keyed ``docs`` with texts cut by ``ranges`` (key, place, n), plus _removed: merged (first, last) segments.

    Only rows that may have a range are shuffled; the others keep their texts as they are.
    ``n_chars``, where there is one, is counted anew for texts that change. The keys go.
    """
    per_row = cut(ranges.groupBy(F.col("key").alias("_range_key")).agg(F.collect_set(F.struct("place", "n")).alias("_ranges")))
    rows = marked(docs, ROW, per_row.select("_range_key"))
    docs = docs.drop(ROW)
    spans = "array<struct<first:long,last:long>>"
    same = rows.where("not _marked").select(*docs.columns, F.array().cast(spans).alias("_removed"))
    likely = rows.where("_marked").join(per_row, F.col(ROW) == F.col("_range_key"), "left")
    names = [c for c in docs.columns if c != "text"]
    changed_schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != "text"), "text string", f"_removed {spans}"])
    at = len(names)

    def shortened(data: np.ndarray, offsets: np.ndarray, asked: list) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
        start, row, _, _ = finder(data, offsets)
        begin = np.searchsorted(row, np.arange(len(asked) + 1))
        for i, wanted in enumerate(asked):
            own, base, end = start[begin[i]:begin[i + 1]], int(offsets[i]), int(offsets[i + 1])
            drop = np.zeros(len(own) + 1, np.int64)
            for r in wanted or ():
                drop[min(r["place"], len(own))] += 1
                drop[min(r["place"] + r["n"], len(own))] -= 1
            drop = np.cumsum(drop)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
            spans_of = [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            limits = np.append(own, end) - base
            text, kept, last = data[base:end].tobytes(), [], 0
            for a, b in spans_of:
                kept.append(text[last:int(limits[a])])
                last = int(limits[b + 1])
            yield b"".join([*kept, text[last:]]), spans_of

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(at))
            for first, last, part, bounds in blocks(data, offsets):
                piece = batch.slice(first, last - first)
                new = list(shortened(part, bounds, piece.column(at + 1).to_pylist()))
                removed = pa.array([[{"first": a, "last": b} for a, b in s] for _, s in new], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
                same_text = piece.column(at).to_pylist()
                text = pa.array([t.decode() if s else old for (t, s), old in zip(new, same_text, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(at)), text, removed], names=[*names, "text", "_removed"])

    changed = in_batches(likely).select(*[F.col(f"`{c}`") for c in names], "text", "_ranges").mapInArrow(task, changed_schema)
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.when(F.size("_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return same.union(changed.select(*same.columns))
