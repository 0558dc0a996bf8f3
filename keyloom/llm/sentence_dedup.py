"""Substring dedup by sliding spans of sentences.

A span is the shortest run of consecutive sentences from each sentence on that has
``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words. Its hash is joined over the whole
corpus: the first document that holds it, and there its first place, keep it; every
sentence that another occurrence covers is removed.

Counting a hash's documents is pre-aggregated in the tasks, so a passage of very many
documents is no hot group. Only spans whose hash was met again are shuffled a second time.

Defined results: null and empty texts stay as they are; the first document is the one
with the smallest doc_id, null last, and of rows that share a doc_id or have none the one read
first: every row is a document of its own, named by a key that is stored with the rows;
other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import found, sentences, without
from .tables import cut, keyed, marked
from .textbytes import combine, signed

MIN_SENTENCES = 2
MIN_WORDS = 10


def _spans(least: int, min_words: int):
    def emit(key: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, h: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        total = np.concatenate([[0], np.cumsum(n)])
        index = np.arange(len(n))
        end = np.maximum(index + least, np.searchsorted(total, total[:-1] + min_words))
        row_end = np.searchsorted(row, row, "right")
        whole = end <= row_end
        index, end = index[whole], end[whole]
        powers = combine(h, np.zeros(len(h), np.int64))
        name, step = combine(end - index), 0
        while True:  # hash the sentences of all spans in step; a span leaves when it is read
            live = np.flatnonzero(index + step < end)
            if not len(live):
                break
            name[live] = combine(name[live], powers[index[live] + step])
            step += 1
        # an earlier place of the same document has the same span
        order = np.lexsort((index, name, row[index]))
        again = np.zeros(len(index), bool)
        again[order[1:]] = (name[order[1:]] == name[order[:-1]]) & (row[index][order[1:]] == row[index][order[:-1]])
        return {"h": signed(name), "key": key[index], "doc": doc[index], "place": place[index].astype(np.int32), "n": (end - index).astype(np.int32), "again": again}

    return emit


def repeated(docs: DataFrame, least: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, place, n): every span that is not the first with its text."""
    spans = found(docs, sentences, _spans(least, min_words), "h long, key long, doc long, place int, n int, again boolean")
    first = cut(spans.groupBy("h").agg(F.min(F.struct("doc", "key")).alias("first"), F.count("*").alias("times")).where("times > 1").select("h", "first"))
    likely = marked(spans, "h", first.select("h")).where("_marked").drop("_marked")
    return likely.join(first, "h").where(F.col("again") | (F.struct("doc", "key") > F.col("first"))).select("key", "place", "n")


def dedup(docs: DataFrame, least: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated sentences, and their places as _removed."""
    docs = keyed(docs)
    return without(docs, sentences, repeated(docs, least, min_words))
