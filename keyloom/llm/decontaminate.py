"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a run of whole documents inside one task. Its words become the symbols of a
sequence; a suffix array gives the Burrows-Wheeler transform, kept in a wavelet matrix.
Every benchmark window is searched backwards through wavelet ranks, all windows at once;
occurrences are located by walking to the nearest sampled suffix, and the hit words of a
document are merged into spans. Documents never leave their task, so nothing is shuffled.

Words outside the benchmark's vocabulary match no window: they end a segment, and only
segments at least as long as the shortest window enter the index. That leaves out no
occurrence. The benchmark is taken in blocks of bounded size, each broadcast once.

Defined results: a null or empty text has no words and no hit; a null, empty or wordless
item has no window; repeated items keep their own ids; repeated documents each get their
row; a null item_id counts as the string "". Other columns of either table are ignored
by :func:`hits` and kept by :func:`decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ROW, in_batches, keyed
from .textbytes import NON_ALNUM, blocks, combine, per_row, texts, word_hashes, words

WINDOW = 13
SAMPLE_EVERY = 8
SHARD_BYTES = 4 << 20
BLOCK_CHARS = 16 << 20

HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, item_ids array<string>, spans array<struct<first_word:long,last_word:long>>"


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``seq`` in order, by prefix doubling; the end sorts first."""
    n = len(seq)
    rank, step = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    while True:
        following = np.zeros(n, np.int64)
        following[:max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        changed = np.empty(n, np.int64)
        changed[0] = 0
        changed[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank[order] = changed
        if n == 0 or changed[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access over integer symbols; one bit row and its prefix counts per level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = (seq >> bit) & 1
            counts = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, ones.astype(bool), counts, len(seq) - int(counts[-1])))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros(len(at), np.int64)
        for bit, _, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            at = np.where(one, zeros + counts[at], at - counts[at])
            low = np.where(one, zeros + counts[low], low - counts[low])
        return at - low

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for bit, ones, counts, zeros in self.levels:
            one = ones[at]
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + counts[at], at - counts[at])
            low = np.where(one, zeros + counts[low], low - counts[low])
        return symbol, at - low


class FmIndex:
    """Backward search and location over a sequence of symbols in [1, symbols); 1 parts segments, 0 ends the shard."""

    def __init__(self, seq: np.ndarray, symbols: int, every: int = SAMPLE_EVERY):
        seq = np.concatenate([seq, [0]])
        order = suffix_array(seq)
        self.size = len(seq)
        self.tree = WaveletMatrix(seq[order - 1], symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.sampled = order % every == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of right-aligned patterns (rows of ``patterns``)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, -back]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk backwards until a sampled suffix is met."""
        place, walked, left = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        at = at.copy()
        while len(left):
            found = self.sampled[at]
            place[left[found]] = self.samples[self.sample_rank[at[found]]] + walked
            left, at = left[~found], at[~found]
            if len(left):
                symbol, rank = self.tree.step(at)
                at = self.below[symbol] + rank
            walked += 1
        return place


class Windows:
    """The distinct windows of a block of benchmark items, as symbols of their vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        per_item = [(item, word_hashes(text, NON_ALNUM)) for item, text in items]
        per_item = [(item, h) for item, h in per_item if len(h)]
        self.items = sorted({item for item, _ in per_item})
        self.vocabulary = np.unique(np.concatenate([h for _, h in per_item])) if per_item else np.zeros(0, np.uint64)
        number = {item: i for i, item in enumerate(self.items)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, h in per_item:
            ids = (np.searchsorted(self.vocabulary, h) + 2).tolist()
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i:i + window]), set()).add(number[item])
        keys = list(found)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.patterns = np.zeros((len(keys), window), np.int64)
        for i, k in enumerate(keys):
            self.patterns[i, window - len(k):] = k
        owners = [sorted(found[k]) for k in keys]
        self.owner_from = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owners = np.array([x for o in owners for x in o], np.int64)

    @classmethod
    def held(cls, fields: dict) -> Windows:
        """Windows over broadcast fields (plain arrays, which need no class to be loaded)."""
        windows = cls.__new__(cls)
        vars(windows).update(fields)
        return windows

    def occurrences(self, row: np.ndarray, h: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence; ``row`` and ``h`` are the words of a shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(h) or not len(self.lengths):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        edge = np.ones(len(h), bool)
        edge[1:] = ~known[1:] | ~known[:-1] | (row[1:] != row[:-1])
        segment = np.cumsum(edge) - 1
        keep = known & (np.bincount(segment)[segment] >= self.lengths.min())
        places = np.flatnonzero(keep)
        if not len(places):
            return none
        new = np.ones(len(places), bool)
        new[1:] = segment[places][1:] != segment[places][:-1]
        target = np.arange(len(places)) + np.cumsum(new) - 1  # a separator before each further segment
        seq, word = np.ones(target[-1] + 1, np.int64), np.zeros(target[-1] + 1, np.int64)
        seq[target], word[target] = at[places] + 2, places
        index = FmIndex(seq, len(self.vocabulary) + 2, every)
        low, high = index.search(self.patterns, self.lengths)
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        return word[index.locate(np.repeat(low, count) + inside)], window


def _shard(ids: list, data: np.ndarray, offsets: np.ndarray, searched: list, every: int) -> pa.RecordBatch:
    rows = len(offsets) - 1
    row, h = words(data, offsets, NON_ALNUM)
    mark = np.zeros(len(h) + 1, np.int64)
    names: list[set[str]] = [set() for _ in range(rows)]
    for block in searched:
        windows = Windows.held(block.value)
        start, window = windows.occurrences(row, h, every)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + windows.lengths[window], -1)
        pair = np.unique(row[start] * (len(windows.lengths) + 1) + window) if len(start) else start
        for doc, w in zip((pair // (len(windows.lengths) + 1)).tolist(), (pair % (len(windows.lengths) + 1)).tolist(), strict=True):
            names[doc].update(windows.items[i] for i in windows.owners[windows.owner_from[w]:windows.owner_from[w + 1]])
    hit = np.cumsum(mark[:-1]) > 0
    n_words, n_hit = per_row(row, rows), per_row(row[hit], rows)
    first_word = np.cumsum(n_words) - n_words
    edges = hit.copy()
    edges[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
    begin = np.flatnonzero(edges)
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    end = np.flatnonzero(last)
    spans: list[list[dict]] = [[] for _ in range(rows)]
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        spans[row[b]].append({"first_word": b - int(first_word[row[b]]), "last_word": e - int(first_word[row[b]])})
    listed = [sorted(x) for x in names]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]), pa.array(listed, pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))),
    ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "item_ids", "spans"])


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> list:
    """Broadcast the benchmark's windows in blocks of about ``block_chars`` characters (one item at least)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_chars))
    context = benchmark.sparkSession.sparkContext
    return [
        context.broadcast(vars(Windows([tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()], window)))
        for part in range(parts)
    ]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, every: int = SAMPLE_EVERY) -> DataFrame:
    """Per document: words, hit words, the items met and the merged spans of hit words."""
    searched = benchmark_blocks(benchmark, window)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = texts(batch.column(1))
            for first, last, part, bounds in blocks(data, offsets, SHARD_BYTES):
                yield _shard(ids[first:last], part, bounds, searched, every)

    return in_batches(docs).select("doc_id", "text").mapInArrow(task, HITS)


def contaminated() -> Column:
    """The rule over the columns of :func:`hits`: at least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay as they are.

    Every row is judged by itself, under a stored key; null and repeated ids do not matter.
    """
    rows = keyed(docs)
    bad = hits(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark, window).where(contaminated()).select(F.col("doc_id").alias("_bad_key"))
    return rows.join(bad, F.col(ROW) == F.col("_bad_key"), "left_anti").drop(ROW)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
places AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
),
met AS (SELECT r, p, n, item FROM places JOIN win USING (n, k)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM met)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
