"""Line dedup: a suffix array over line ids by distributed prefix doubling.

Lines become ids; every suffix of a document's line sequence is named by its first line,
then by its first 2, 4, 8 ... lines: the name of twice as many lines is made of the names
of the suffix and of the one that begins where its known part ends. Suffixes with one
name form a longest-common-prefix interval of that depth. A suffix whose name no other
has is settled and leaves, as do lines that the corpus has only once; what is left goes
on until no interval has two suffixes, so the longest repeated run is found in as many
rounds as its length has bits. Names are hashes instead of order ranks: an interval needs
equality only, and no round has to sort the whole corpus.

In each interval the first suffix (smallest document, then row, then place) keeps its lines. Every
other one is a later copy, and the lines of its depth are deleted when the run has two
lines or more and ``MIN_WORDS`` words, or is one line of ``MIN_LINE_WORDS`` words.

Maximal runs are of any length. A prefix of any other length is named by two names of the
power of two below it, which overlap: equal at both, equal throughout. Such prefixes are
needed only where one of the two is short of ``MIN_WORDS`` words: any run of enough words
is a union of its power-of-two windows of enough words and of these. So exactly the lines
go that lie in a run with an earlier copy, two lines or more and ``MIN_WORDS`` words in all.

Defined results: null and empty texts stay; blank lines are no lines; the first document
is the one with the smallest doc_id, null last, and of rows that share a doc_id or have
none the one read first: every row is a document of its own, named by a key that is stored
with the rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import found, lines, without
from .tables import cut, keyed, marked
from .textbytes import signed

MIN_WORDS = 8
MIN_LINE_WORDS = 20


def _each_line(key: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, h: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    return {"name": signed(h), "key": key, "doc": doc, "place": place.astype(np.int32), "before": np.cumsum(n, dtype=np.int64) - n, "words": n.astype(np.int64)}


NAMED = ["name", "key", "doc", "place", "before", "words"]


def _shared(suffixes: DataFrame) -> DataFrame:
    """Suffixes (name, key, doc, place, before, words) whose name another has, with the interval's first place.

    ``before`` counts words from some line of the block on: only differences within a row mean something.
    """
    first = suffixes.groupBy("name").agg(F.min(F.struct("doc", "key", "place")).alias("first"), F.count("*").alias("times")).where("times > 1").select("name", "first")
    return suffixes.join(first, "name")


def intervals(docs: DataFrame) -> list[DataFrame]:
    """For each depth 1, 2, 4 ... the stored suffixes of intervals with two suffixes or more."""
    every = found(docs, lines, _each_line, "name long, key long, doc long, place int, before long, words long")
    again = cut(every.groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name"))
    likely = marked(every, "name", again).where("_marked").drop("_marked")
    levels, depth = [cut(_shared(likely))], 1
    while not levels[-1].isEmpty():
        known = levels[-1].select(*NAMED)
        ahead = known.select(F.col("name").alias("next"), "key", (F.col("place") - depth).alias("place"), F.col("words").alias("more"))
        longer = known.join(ahead, ["key", "place"]).select(F.xxhash64("name", "next").alias("name"), "key", "doc", "place", "before", (F.col("words") + F.col("more")).alias("words"))
        levels.append(cut(_shared(longer)))
        depth *= 2
    return levels[:-1]


def between(suffixes: DataFrame, depth: int, min_words: int) -> DataFrame:
    """(name, key, doc, place, n): prefixes of more lines than ``depth`` and fewer than twice as many, of ``min_words`` words.

    Made of the stored suffixes of one depth, of which one at least is short of ``min_words`` words.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(depth - 1))).alias("step")
    known = suffixes.select(*NAMED)
    short = known.where(F.col("words") < min_words)
    end = known.select(F.col("name").alias("next"), "key", F.col("place").alias("at"), F.col("before").alias("from"), F.col("words").alias("more"))
    forward = short.select("*", steps).withColumn("at", F.col("place") + F.col("step")).join(end, ["key", "at"])
    start = known.where(F.col("words") >= min_words)
    back = end.where(F.col("more") < min_words).select("*", steps).withColumn("place", F.col("at") - F.col("step")).join(start, ["key", "place"])
    columns = [F.xxhash64("name", "next", "step").alias("name"), "key", "doc", "place", (F.col("step") + depth).cast("int").alias("n")]
    enough = F.col("from") + F.col("more") - F.col("before") >= min_words
    return forward.where(enough).select(*columns).union(back.where(enough).select(*columns))


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """(key, place, n): the runs of lines that an earlier place has too."""
    runs = docs.sparkSession.createDataFrame([], "key long, place int, n int")
    for level, suffixes in enumerate(intervals(docs)):
        depth = 1 << level
        later = F.struct("doc", "key", "place") > F.col("first")
        enough = F.col("words") >= (min_words if level else min_line_words)
        runs = runs.union(suffixes.where(later & enough).select("key", "place", F.lit(depth).alias("n")))
        if 1 < depth < min_words:  # as many lines have as many words
            runs = runs.union(_shared(between(suffixes, depth, min_words)).where(later).select("key", "place", "n"))
    return runs


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """``docs`` without later copies of line runs, and the places of those as _removed."""
    docs = keyed(docs)
    return without(docs, lines, later_runs(docs, min_words, min_line_words))
