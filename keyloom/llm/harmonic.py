"""Harmonic packing: length classes by reciprocals of the capacity, a fixed number of documents in each bin.

A document is its token ids and an end id. Class k holds documents of length in
(capacity / (k + 1), capacity / k]; its bins take k documents each, in input order and
with no search. Every worker packs what it reads, in loads of about ``LOAD_TOKENS``
tokens, and needs nothing from the others: there is no shuffle.

What the fixed numbers leave open in the bins is filled to the brim with fillers: the
load's longest documents, which are cut wherever a bin is full. As few documents as
possible are fillers: the smallest number that leaves no more bins than the load's
tokens can fill. What is left of the fillers gives full sequences and, for the last
tokens, sequences whose lengths are powers of two, which need no padding. So no load
pads a token, and all but the fillers stay whole.

Ids come from the public tokenizer file. Its pre-tokenizer never joins text across white
space, so a worker tokenizes each distinct run without white space once and looks the
others up by the hash of their bytes.

Defined results: a null or empty text is its end id alone; repeated rows are packed each
on their own; a null doc_id stays null; an empty table gives an empty table; columns
other than doc_id and text are ignored. Numbers of sequences are (partition, count), so a
task that runs again gives the same ones.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import in_batches
from .textbytes import EXACT, SPACES, blocks, hashes, runs, texts

CAPACITY = 4096
END_ID = 2
LOAD_TOKENS = 1 << 22
KNOWN_RUNS = 1 << 20
JOINED = 256
# A special token of the vocabulary: the tokenizer takes what stands on its two sides as texts of their own.
BETWEEN = "<|startoftext|>"


def vocabulary_file() -> str:
    """The public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts; each distinct run without white space is tokenized once while it is remembered."""

    def __init__(self, file: str, known_runs: int = KNOWN_RUNS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core only
        self.tokenizer = Tokenizer.from_file(file)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.known_runs = known_runs
        self.forget()

    def forget(self) -> None:
        self.names = np.zeros(0, np.uint64)
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, names: np.ndarray, runs_of_text: list[str]) -> None:
        """Remember new runs, ``names`` in ascending order."""
        coded, lengths = [], []
        for at in range(0, len(runs_of_text), JOINED):
            some = runs_of_text[at:at + JOINED]
            if any(BETWEEN in x for x in some):
                for x in some:
                    coded.append(self.ids_of(x))
                    lengths.append(np.array([len(coded[-1])]))
                continue
            ids = self.ids_of(BETWEEN.join(some))
            cuts = np.flatnonzero(ids == self.between)
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            coded.append(ids[ids != self.between])
        length = np.concatenate(lengths).astype(np.int64)
        first = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, *coded])
        at = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, at, names)
        self.first, self.length = np.insert(self.first, at, first), np.insert(self.length, at, length)

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def known(self, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(names), bool)
        return self.names[np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)] == names

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, each row with its end id, and the rows' ends in it."""
        start, end, row = runs(data, offsets, SPACES)
        name = hashes(data, start, end, EXACT)
        distinct, sample = np.unique(name, return_index=True)
        if len(self.names) + len(distinct) > self.known_runs:
            self.forget()
        new = ~self.known(distinct)
        if new.any():
            raw = data.tobytes()
            self.learn(distinct[new], [raw[a:b].decode() for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist(), strict=True)])
        at = np.searchsorted(self.names, name)
        length = self.length[at]
        rows = len(offsets) - 1
        count = np.bincount(row, length, rows).astype(np.int64) + 1
        ends = np.cumsum(count)
        ids = np.full(int(ends[-1]) if rows else 0, END_ID, np.uint32)
        # the ids of a run stand behind those of the runs before it and the end ids of the rows before it
        place = np.cumsum(length) - length + row
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        ids[np.repeat(place, length) + within] = self.ids[np.repeat(self.first[at], length) + within]
        return ids, ends


def _bins(classes: np.ndarray) -> int:
    """How many bins documents of these classes take."""
    count = np.bincount(classes)
    held = np.flatnonzero(count)
    return int((-(-count[held] // held)).sum())


def fillers(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The fewest of the longest documents without which the others' bins are no more than all tokens fill."""
    order = np.argsort(-lengths, kind="stable")
    classes = capacity // lengths[order]
    full = int(lengths.sum()) // capacity
    low, high = int((lengths > capacity).sum()), len(lengths)
    while low < high:  # the number of bins falls as documents become fillers
        middle = (low + high) // 2
        if _bins(classes[middle:]) <= full:
            high = middle
        else:
            low = middle + 1
    return order[:low]


def place(lengths: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a load."""
    loose = fillers(lengths, capacity)
    whole = np.ones(len(lengths), bool)
    whole[loose] = False
    whole = np.flatnonzero(whole)
    kind = capacity // lengths[whole]
    order = np.argsort(kind, kind="stable")
    whole, kind = whole[order].tolist(), kind[order].tolist()
    gaps: list[tuple[int, int]] = []  # (sequence, filled so far) of what fillers have to fill
    sequence, held, filled, last = -1, 0, 0, 0
    for doc, k in zip(whole, kind, strict=True):
        if k != last or held == k:
            if sequence >= 0:
                gaps.append((sequence, filled))
            sequence, held, filled, last = sequence + 1, 0, 0, k
        size = int(lengths[doc])
        yield doc, 0, size, sequence, filled
        held, filled = held + 1, filled + size
    if sequence >= 0:
        gaps.append((sequence, filled))
    left = int(lengths[loose].sum())
    targets = [(s, at, capacity) for s, at in gaps]
    left -= sum(capacity - at for _, at in gaps)
    while left:
        size = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        size = min(size, capacity)
        sequence += 1
        targets.append((sequence, 0, size))
        left -= size
    stream = iter(loose.tolist())
    doc, start, rest = -1, 0, 0
    for target, at, end in targets:
        while at < end:
            if not rest:
                doc = next(stream)
                start, rest = 0, int(lengths[doc])
            size = min(rest, end - at)
            yield doc, start, size, target, at
            at, start, rest = at + size, start + size, rest - size


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(file: str, capacity: int, load_tokens: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 33
        names = [part.split()[0] for part in SCHEMA.split(", ")] + ["ids"] * with_ids
        doc_ids: list = []
        load: list[np.ndarray] = []
        tokens = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            lengths = np.array([len(x) for x in load], np.int64)
            rows: list[tuple] = []
            used = 0
            for doc, start, size, sequence, offset in place(lengths, capacity):
                ids = load[doc][start:start + size]
                rows.append((doc_ids[doc], start, size, zlib.crc32(ids.astype("<u4").tobytes()), int(lengths[doc]), first + sequence, offset, *([ids.tolist()] if with_ids else [])))
                used = max(used, sequence + 1)
                if len(rows) == 1 << 16:
                    yield batch_of(rows)
                    rows = []
            first += used
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = texts(batch.column(1))
            for begin, end, part, bounds in blocks(data, offsets):
                ids, ends = encoder.encode(part, bounds)
                load += np.split(ids.astype(np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32), ends[:-1])
                doc_ids += keys[begin:end]
                tokens += len(ids)
                if tokens >= load_tokens:
                    yield from packed()
                    doc_ids, load, tokens = [], [], 0
        if load:
            yield from packed()

    return task


def pack(docs: DataFrame, capacity: int = CAPACITY, file: str | None = None, load_tokens: int = LOAD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence; ``with_ids`` adds the piece's token ids.

    ``capacity`` is a power of two. ``load_tokens`` bounds what a worker holds, besides the text it has read last.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity of a sequence has to be a power of two")
    task = _packer(file or vocabulary_file(), capacity, load_tokens, with_ids)
    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SCHEMA + ", ids array<int>" * with_ids)
