"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding look-alike characters.

Folding lower-cases, maps homoglyphs, digits and symbols inside words to the letters they
stand for, and drops what has no width; letters that one look-alike stands for (i, l, 1)
become one. A lexicon entry is a whole word or the beginning of words. Each distinct word
that it hits adds its weight unless it stands in an exception phrase; the sum, also
divided by the logarithm of the text's length, goes through a logistic calibration.

The lexicon, the exception phrases and the calibration are learned from labelled rows: a
sample of at most ``SAMPLE`` documents of each label, chosen by the hash of their ids, of
which near copies count once. Entries are chosen greedily by the toxic documents that
hold them, until each such document is covered ``COVER`` times or nothing likely is left.

Defined results: null and empty texts have no hit and get the score of such texts; a
document with several labels is toxic if one of them says so; without labelled rows
nothing is known to be toxic, and every score is 0; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import shingle_sets
from .tables import crc_mod, cut, in_batches
from .textbytes import blocks, signed
from .textbytes import texts as text_bytes

SAMPLE = 10_000
MAX_CANDIDATES = 20_000
MAX_EXCEPTIONS = 1_000
MIN_SUPPORT = 5
MIN_WEIGHT = 2.0
COVER = 3
STEMS = range(4, 9)
THRESHOLD = 0.7

# Characters that stand for a letter; i, l, 1, ! and | are one class.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ł": "i", "ø": "o", "đ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): LOOKALIKES.get(c, c if c.isalnum() else " ") for c in map(chr, range(128))}
    table.update({ord(c): LOOKALIKES[c] for c in LOOKALIKES})
    table.update({c: None for c in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)})  # loose marks and what has no width
    table.update({ord(c): " " for c in "@$!|"})
    return table


TABLE = _table()
INSIDE = re.compile(r"(?<=\w)[@$!|](?=\w)|(?<![^\W_])[@$](?=[^\W_])")


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = INSIDE.sub(lambda m: LOOKALIKES[m[0]], text)
    return text.translate(TABLE)


def trained_on(column: str = "doc_id") -> Column:
    """Rows whose labels may be learned from."""
    return F.coalesce(crc_mod(column, 3) != 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most ``sample`` documents of each label, stored."""
    each = labels.where(trained_on() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    picked = [each.where(F.col("_toxic") == t).orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample) for t in (0, 1)]
    chosen = picked[0].union(picked[1])
    texts = in_batches(docs).select(F.col("doc_id").alias("_doc_id"), "text").join(F.broadcast(chosen), F.col("_doc_id") == F.col("_label_id")).select(F.col("_toxic").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    return cut(texts.mapInArrow(_with_key, "key long, toxic int, text string").dropDuplicates(["key", "toxic"]).select("toxic", "text"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the least hash of a text's word shingles, which near copies mostly share."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        keys = [int(signed(s[:1])[0]) if len(s) else 0 for _, _, part, bounds in blocks(data, offsets) for s in shingle_sets(part, bounds)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *batch.columns], names=["key", "toxic", "text"])


def _features(text: str) -> set[str]:
    """Whole words, and beginnings of words marked with a star."""
    words = set(fold(text).split())
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[toxic].update(_features(text.as_py()))
        names = list(counts[1])  # what no toxic text has is no candidate
        names += [f for f in counts[0] if f not in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], names=["feature", "toxic", "clean"])


def _odds(toxic: float, clean: float, toxic_docs: int, clean_docs: int) -> float:
    return math.log((toxic + 0.5) / (toxic_docs + 1)) - math.log((clean + 0.5) / (clean_docs + 1))


def learn_lexicon(sample: DataFrame, toxic_docs: int, clean_docs: int) -> dict[str, float]:
    """Entry -> weight; an entry that ends in a star is the beginning of words."""
    counted = sample.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic_docs + 1)) - F.log((F.col("clean") + 0.5) / (clean_docs + 1))
    likely = counted.where((F.col("toxic") >= MIN_SUPPORT) & (odds >= MIN_WEIGHT)).orderBy(F.desc(odds * F.col("toxic")), "feature").limit(MAX_CANDIDATES)
    counts = {r["feature"]: (r["toxic"], r["clean"]) for r in likely.collect()}
    names = sorted(counts)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {f: i for i, f in enumerate(names)}
        for batch in batches:
            rows = [sorted(number[f] for f in _features(t.as_py()) if f in number) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["held"])

    docs_of: dict[int, set[int]] = defaultdict(set)
    for d, r in enumerate(sample.where("toxic = 1").select("text").mapInArrow(held, "held array<int>").collect()):
        for f in r["held"]:
            docs_of[f].add(d)
    odd_of = {f: _odds(*counts[names[f]], toxic_docs, clean_docs) for f in docs_of}
    lexicon: dict[str, float] = {}
    open_docs = Counter({d: COVER for ds in docs_of.values() for d in ds})
    while docs_of:
        best = max(docs_of, key=lambda f: (len(docs_of[f]) * odd_of[f], not names[f].endswith("*"), len(names[f]), names[f]))
        explained = docs_of.pop(best)
        if len(explained) < MIN_SUPPORT:
            break
        lexicon[names[best]] = odd_of[best]
        open_docs.subtract(explained)
        done = {d for d in explained if open_docs[d] <= 0}
        word = names[best].rstrip("*")
        same = {f for f in docs_of if names[f].rstrip("*").startswith(word) and odd_of[f] <= odd_of[best] + 0.5}
        docs_of = {f: rest for f, d in docs_of.items() if f not in same and len(rest := d - done) >= MIN_SUPPORT}
    return lexicon


def matcher(lexicon: dict[str, float], exceptions: frozenset[str] = frozenset()):
    """folded text -> [(weight, word before and word, word and word after)] of the distinct words that count."""
    import ahocorasick

    entries: dict[str, list[tuple[bool, float]]] = defaultdict(list)
    for entry, weight in lexicon.items():
        entries[entry.rstrip("*")].append((entry.endswith("*"), weight))
    automaton = ahocorasick.Automaton()
    for text, kinds in entries.items():
        automaton.add_word(text, (len(text), kinds))
    automaton.make_automaton()

    def hits(text: str) -> list[tuple[float, str, str]]:
        best: dict[int, float] = {}
        for last, (length, kinds) in automaton.iter(text):
            start = last - length + 1
            if start and text[start - 1].isalnum():
                continue
            whole = last + 1 == len(text) or not text[last + 1].isalnum()
            for stem, weight in kinds:
                if stem or whole:
                    best[start] = max(weight, best.get(start, weight))
        found: dict[str, tuple[float, str, str]] = {}
        for start, weight in best.items():
            end = start
            while end < len(text) and text[end].isalnum():
                end += 1
            word = text[start:end]
            before = f"{''.join(text[max(0, start - 64):start].split()[-1:])} {word}"
            after = f"{word} {''.join(text[end:end + 64].split()[:1])}"
            if before not in exceptions and after not in exceptions:
                found[word] = (weight, before, after)
        return list(found.values())

    return hits if entries else lambda text: []


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float], toxic_docs: int, clean_docs: int) -> frozenset[str]:
    """Phrases of a lexicon word and a neighbour that clean texts hold more often than toxic ones."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = matcher(lexicon)
        for batch in batches:
            rows = [(p, toxic) for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for p in {p for _, *ps in hits(fold(text.as_py())) for p in ps}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["phrase", "toxic"])

    counted = sample.mapInArrow(contexts, "phrase string, toxic long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    harmless = counted.where((F.col("clean") >= 3) & (F.col("clean") * max(1, toxic_docs) > F.col("toxic") * max(1, clean_docs)))
    return frozenset(r["phrase"] for r in harmless.orderBy(F.desc("clean"), "phrase").limit(MAX_EXCEPTIONS).collect())


def _inputs(weight: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), weight / np.log(math.e + length)])


def calibrate(sample: DataFrame, lexicon: dict[str, float], exceptions: frozenset[str], prior: float) -> list[float]:
    """Logistic weights over the sum of weights, plain and by length, for texts of which a share ``prior`` is toxic."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = matcher(lexicon, exceptions)
        for batch in batches:
            folded = [fold(t.as_py()) for t in batch.column(1)]
            weight = [round(math.log1p(sum(h[0] for h in hits(t))), 1) for t in folded]
            length = [round(math.log1p(len(t))) for t in folded]
            yield pa.RecordBatch.from_arrays([pa.array(weight, pa.float64()), pa.array(length, pa.float64()), batch.column(0)], names=["w", "len", "toxic"])

    rows = sample.mapInArrow(cells, "w double, len double, toxic int").groupBy("w", "len", "toxic").count().collect()
    if not rows:
        return [-30.0, 0.0, 0.0]
    w, length, toxic, n = (np.array([r[i] for r in rows], float) for i in range(4))
    x = _inputs(np.expm1(w), np.expm1(length))
    share = (n * toxic).sum() / n.sum()
    weight = n / n.sum() * np.where(toxic > 0, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9)) * 1000
    b = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        slope = x @ (weight * (toxic - p)) - 0.001 * b
        curve = (x * (weight * p * (1 - p))) @ x.T + 0.001 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        b = b + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Lexicon, exceptions and calibration; their size is bounded by the sample."""
    chosen = labelled_sample(docs, labels, sample)
    seen = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    every = labels.where(trained_on() & F.col("toxic").isNotNull()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    toxic_docs, clean_docs = seen.get(1, 0), seen.get(0, 0)
    lexicon = learn_lexicon(chosen, toxic_docs, clean_docs) if toxic_docs else {}
    exceptions = learn_exceptions(chosen, lexicon, toxic_docs, clean_docs) if lexicon else frozenset()
    fit = calibrate(chosen, lexicon, exceptions, min(max(every or 0.0, 1e-3), 1 - 1e-3)) if toxic_docs else [-30.0, 0.0, 0.0]
    return {"lexicon": lexicon, "exceptions": exceptions, "fit": fit}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, hits, weight) of every row."""
    lexicon, exceptions, fit = model["lexicon"], model["exceptions"], np.array(model["fit"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = matcher(lexicon, exceptions)
        for batch in batches:
            length, weight, n = np.zeros(len(batch)), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for i, text in enumerate(batch.column(1)):
                folded = fold(text.as_py() or "")
                found = hits(folded)
                length[i], weight[i], n[i] = len(folded), sum(h[0] for h in found), len(found)
            p = 1 / (1 + np.exp(-np.clip(fit @ _inputs(weight, length), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(n), pa.array(weight)], names=["doc_id", "score", "hits", "weight"])

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double, hits long, weight double")
