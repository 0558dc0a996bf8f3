"""Filter interaction audit: sorted posting lists of failing documents, merged by galloping.

1. One pass over the texts gives each row a number, the filters A to D that it fails and
   a 128-bit hash of its text. Numbers ascend within a task, so a range of numbers is a
   piece of one task's rows. Filter E comes from a join on the hash.
2. For every part and range of ``RANGE`` numbers there are seven lists: the sorted numbers
   of the rows that fail each filter, and those labelled good and toxic. What a filter
   does behind others depends on which went before, not on their order, so the unions of
   all 32 sets of filters are merged once, each from a smaller union and one more list:
   the shorter list is searched in the longer one by doubling steps. Sizes of unions, and
   of their meetings with the labelled rows, are summed over the ranges.
3. Every order and step is then a difference of two of these sums.

A part's rows are split by range, however many there are; a text with very many copies is
looked up in a broadcast table, which holds at most ``HOT_SHARE`` texts, each of more than
that share of all rows.

Defined results: a null text is empty; a null lang is the part ""; every row is a document
of its own, repeated ids included, and takes the labels of its id, if any label row of the
id says so. A null doc_id is larger than all others and has no label. Rows that share an
id and a text do not fail E by each other. An empty table has no parts. Columns other than
those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, in_batches, keyed, ROW
from .textbytes import EXACT, SPACES, blocks, hashes, mix, per_row, runs, texts

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
# The contract's symbols.
SYMBOLS = "#$%&*|"
RANGE = 1 << 16
HOT_SHARE = 1024
GOOD, TOXIC = len(FILTERS), len(FILTERS) + 1


def _members(characters: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(characters.encode())] = 1
    return table


def _sums(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[data])])
    return total[offsets[1:]] - total[offsets[:-1]]


def failures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bit set of the filters A to D that each row fails, and two hashes of its text."""
    upper, symbols = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _members(SYMBOLS)
    points = np.ones(256, np.int64)
    points[0x80:0xC0] = 0
    rows = len(offsets) - 1
    start, end, row = runs(data, offsets, SPACES)
    word = hashes(data, start, end, EXACT)
    words = per_row(row, rows)
    order = np.lexsort((word, row))
    new = np.ones(len(word), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (word[order][1:] != word[order][:-1])
    distinct = per_row(row[order][new], rows)
    fails = [
        words < MIN_WORDS,
        100 * distinct < MIN_DISTINCT_PERCENT * words,
        100 * _sums(upper, data, offsets) > MAX_UPPER_PERCENT * _sums(points, data, offsets),
        _sums(symbols, data, offsets) > 0,
    ]
    mask = sum(f.astype(np.int64) << i for i, f in enumerate(fails))
    # two polynomials over independent byte values name a text
    h1 = hashes(data, offsets[:-1], offsets[1:], EXACT)
    h2 = hashes(data, offsets[:-1], offsets[1:], mix(EXACT))
    return mask, h1, h2


def digest(docs: DataFrame) -> DataFrame:
    """(row, part, doc, mask, h1, h2) of every keyed row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(3))
            for first, last, part, bounds in blocks(data, offsets):
                mask, h1, h2 = failures(part, bounds)
                held = [batch.column(i).slice(first, last - first) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(mask), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["row", "part", "doc", "mask", "h1", "h2"])

    number = F.monotonically_increasing_id() if ROW not in docs.columns else F.col(ROW)
    numbered = in_batches(docs).select(number.alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc"), "text")
    return numbered.mapInArrow(task, "row long, part string, doc long, mask long, h1 long, h2 long")


def later_copies(rows: DataFrame) -> DataFrame:
    """(row, part) of rows whose text a smaller doc has; ``rows`` is a stored digest."""
    name = ["h1", "h2"]
    same = cut(rows.groupBy(*name).agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null"))
    total = rows.count()
    hot = F.col("n") * HOT_SHARE > total  # so many of all rows that there are no more than HOT_SHARE such texts
    few = F.broadcast(same.where(hot).select(*name, F.col("least").alias("hot_least")))
    told = rows.select("row", "part", "doc", *name).join(few, name, "left")
    rest = told.where("hot_least is null").join(same.where(~hot).select(*name, "least"), name)
    later = F.col("doc").isNull() | (F.col("doc") > F.col("least"))
    return told.where("hot_least is not null").select("row", "part", "doc", F.col("hot_least").alias("least")).union(rest.select("row", "part", "doc", "least")).where(later).select("row", "part")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, part, good, toxic) of rows with a label."""
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    ).where("good or toxic")
    return rows.select("row", "part", "doc").join(of, "doc").select("row", "part", "good", "toxic")


def _in_lists(rows: DataFrame, lists: Column) -> DataFrame:
    """(part, block, list, id): a row in each list that it belongs to."""
    return rows.select("part", F.expr(f"row div {RANGE}").alias("block"), (F.col("row") % RANGE).cast("int").alias("id"), F.explode(lists).alias("list"))


def postings(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored rows' (part, n), and the members of all posting lists."""
    rows = cut(digest(docs))
    fails = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, i) for i in range(4)]), lambda x: x.isNotNull())
    labels_of = F.filter(F.array(F.when(F.col("good"), GOOD), F.when(F.col("toxic"), TOXIC)), lambda x: x.isNotNull())
    members = (
        _in_lists(rows.where("mask > 0"), fails)
        .union(_in_lists(later_copies(rows), F.array(F.lit(4))))
        .union(_in_lists(labelled(rows, labels), labels_of))
    )
    return rows.groupBy("part").agg(F.count("*").alias("n")), members


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For every element of a sorted list, its place in a longer one.

    From the place of the element before, steps double until they pass the element; the rest is a binary search in
    the last step. All elements take their steps at once: an element starts from the place that the doubling of a
    run of 64 elements has found for the first of them.
    """
    if len(short) * 16 >= len(long):
        return np.searchsorted(long, short)
    out = np.empty(len(short), np.int64)
    at = 0
    for begin in range(0, len(short), 64):
        run, step = short[begin:begin + 64], 64
        while at + step < len(long) and long[at + step] < run[-1]:
            step *= 2
        out[begin:begin + 64] = at + np.searchsorted(long[at:at + step + 1], run)
        at = int(out[min(begin + 63, len(short) - 1)])
    return out


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of the shorter list the longer one has too, as (shorter list's) booleans."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short):
        return np.zeros(0, bool)
    at = gallop(short, long)
    return long[np.minimum(at, len(long) - 1)] == short


def united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two sorted lists: what the shorter one adds is put at its place in the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short):
        return long
    new = short[~meeting(short, long)]
    return np.insert(long, gallop(new, long), new) if len(new) else long


def union_sizes(lists: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """For each set of filters: how many rows fail one of them, and how many of these are good and toxic."""
    unions: list[np.ndarray] = []
    out = []
    for subset in range(1 << len(FILTERS)):
        top = subset.bit_length() - 1
        merged = united(unions[subset ^ (1 << top)], lists[top]) if subset else np.zeros(0, np.int32)
        unions.append(merged)
        out.append((len(merged), int(meeting(merged, lists[GOOD]).sum()), int(meeting(merged, lists[TOXIC]).sum())))
    return out


def _merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [np.sort(pdf["id"].to_numpy()[(pdf["list"] == i).to_numpy()]) for i in range(len(FILTERS) + 2)]
    sizes = union_sizes(lists)
    return pd.DataFrame({"part": key[0], "subset": range(len(sizes)), "failing": [s[0] for s in sizes], "good": [s[1] for s in sizes], "toxic": [s[2] for s in sizes]})


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, subset, failing, good, toxic): sums over all ranges, for each of the 32 sets of filters."""
    parts, members = postings(docs, labels)
    merged = members.repartition("part", "block").groupBy("part", "block").applyInPandas(_merged, "part string, subset int, failing long, good long, toxic long")
    sums = merged.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("failing", "good", "toxic")])
    every = parts.select("part", "n", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("subset"))
    return every.join(sums, ["part", "subset"], "left").na.fill(0, ["failing", "good", "toxic"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    every = interactions(docs, labels).groupBy("part").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("subset", "failing", "good", "toxic"))).alias("u"))
    names = len(FILTERS)
    whole = (1 << names) - 1
    orders = []
    for order in permutations(range(names)):
        before = 0
        for step, f in enumerate(order):
            orders.append((("".join(FILTERS[i] for i in order)), step + 1, f, before))
            before |= 1 << f
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("f"), F.lit(b).alias("before")) for o, s, f, b in orders])

    def size(subset: Column, what: str = "failing") -> Column:
        return F.get("u", subset)[what]

    # the orders in which a set of b filters stands before one more: b! (4 - b)!
    weight = [math.factorial(bin(b).count("1")) * math.factorial(names - 1 - bin(b).count("1")) if bin(b).count("1") < names else 0 for b in range(whole + 1)]

    def in_all_orders(f: int) -> Column:
        return sum((weight[b] * (size(F.lit(b | 1 << f)) - size(F.lit(b))) for b in range(whole + 1) if not b >> f & 1), F.lit(0).cast("long"))

    shares = every.select("part", "n", "u", F.array(*[in_all_orders(f) for f in range(names)]).alias("shares"))
    # the 600 steps are a fixed list
    placed = shares.select("*", F.explode(steps).alias("at")).select("part", "n", "u", "shares", "at.*")
    own = F.call_function("shiftleft", F.lit(1), F.col("f"))
    after = F.col("before").bitwiseOR(own)
    removed = size(after) - size(F.col("before"))
    return placed.select(
        "part", "filter_order", "step",
        (F.col("n") - size(after)).alias("kept"), removed.alias("removed"), (size(own) - removed).alias("redundant"),
        (size(F.lit(whole)) - size(F.lit(whole).bitwiseXOR(own))).alias("unique_fails"),
        (size(after, "good") - size(F.col("before"), "good")).alias("good_lost"), (size(after, "toxic") - size(F.col("before"), "toxic")).alias("toxic_lost"),
        F.get("shares", F.col("f")).alias("shapley"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    min(doc_id) OVER (PARTITION BY t) AS least FROM d
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN least < doc_id OR (doc_id IS NULL AND least IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN marks USING (doc_id)
), kinds AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS l, left(filter_order, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), told AS (
  SELECT part, filter_order, CAST(step AS int) AS step, l, n, good, toxic, fails,
    contains(fails, l) AS failing, before <> '' AND regexp_matches(fails, '[' || CASE before WHEN '' THEN '_' ELSE before END || ']') AS earlier
  FROM kinds, steps
), counted AS (
  SELECT part, filter_order, step, l,
    coalesce(sum(n) FILTER (NOT earlier AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT earlier AND failing), 0) AS removed,
    coalesce(sum(n) FILTER (earlier AND failing), 0) AS redundant, coalesce(sum(n) FILTER (fails = l), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT earlier AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT earlier AND failing), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, l
)
SELECT part, filter_order, step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant,
  CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS bigint) AS shapley
FROM counted
"""
