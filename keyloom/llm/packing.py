"""Best-fit packing of tokenised documents, improved by swap-based local search.

A document is its token ids and an end id. One longer than a sequence is cut into full
pieces with the remainder first; a full piece is a sequence of its own. The other pieces
are dealt by hash into groups of bounded size. Each group is packed best-fit decreasing;
then the emptiest bins are emptied into fuller ones: a piece moves where it fits, or one
or two pieces change places with a smaller one. Every step raises the sum of squared
fills, so it ends; it stops early once the group has no more bins than it must have.

Defined results: a null or empty text is its end id alone; repeated rows are packed each
on their own; a null doc_id stays null; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, in_batches

SEQUENCE = 1024
END_ID = 2
GROUP_PIECES = 1 << 14
HARD_CHARS = 1 << 21

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_files() -> tuple[str, str]:
    """The public vocabulary as a tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(files: tuple[str, str]):
    """text -> ids, as the tokenizer file gives them.

    The same vocabulary as ranks is several times faster; texts that spell a special
    token, or so long that its pattern matcher may refuse them, go to the tokenizer itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(files[0])
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(files[1], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) > HARD_CHARS or any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, length: int = SEQUENCE, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds their token ids."""
    files = files or vocabulary_files()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                first = len(ids) % length or length
                cuts = [0, *range(min(first, len(ids)), len(ids) + 1, length)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    out.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tolist() if with_ids else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)][:6 if with_ids else 5], names=names[:6 if with_ids else 5])

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, PIECES + ", ids array<int>" * with_ids)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indices."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    open_gaps = np.zeros(room + 1, bool)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = int(np.argmax(open_gaps[sizes[i]:]))
        gap = sizes[i] + at
        if open_gaps[gap]:
            b = by_gap[gap].pop()
            open_gaps[gap] = bool(by_gap[gap])
            bins[b].append(i)
        else:
            gap, b = room, len(bins)
            bins.append([i])
        left = gap - sizes[i]
        if left:
            by_gap[left].append(b)
            open_gaps[left] = True
    return bins


class _Fuller:
    """Fuller bins by what they can take: for each piece size, the largest gap beside such a piece."""

    def __init__(self, bins: list[list[int]], sizes: list[int], room: int):
        self.bins, self.sizes, self.room = bins, sizes, room
        self.gap = [room - sum(sizes[i] for i in b) for b in bins]
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]
        self.most = np.full(room + 1, -(1 << 30), np.int64)
        self.out: set[int] = set()
        for b in range(len(bins)):
            self.note(b)

    def note(self, b: int) -> None:
        """Enter a bin; size 0 stands for a move, which takes nothing in exchange."""
        for size in {0, *(self.sizes[i] for i in self.bins[b])}:
            heappush(self.heaps[size], (-self.gap[b], b))
            self.top(size)

    def top(self, size: int) -> int | None:
        heap = self.heaps[size]
        while heap:
            gap, b = heap[0]
            if b not in self.out and -gap == self.gap[b] and (size == 0 or any(self.sizes[i] == size for i in self.bins[b])):
                self.most[size] = -gap
                return b
            heappop(heap)
        self.most[size] = -(1 << 30)
        return None

    def smallest(self, size: int) -> int | None:
        """The smallest piece that something of ``size`` can replace in a fuller bin."""
        while True:
            fits = self.most[:size] + np.arange(size) >= size
            x = int(np.argmax(fits)) if size else 0
            if not size or not fits[x]:
                return None
            held = self.most[x]
            if self.top(x) is not None and self.most[x] == held:
                return x

    def exchange(self, target: int, given: list[int], taken_size: int) -> None:
        b = self.top(taken_size)
        taken = [next(i for i in self.bins[b] if self.sizes[i] == taken_size)] if taken_size else []
        for mine, theirs, go, come in ((self.bins[b], b, taken, given), (self.bins[target], target, given, taken)):
            for i in go:
                mine.remove(i)
            mine.extend(come)
            self.gap[theirs] += sum(self.sizes[i] for i in go) - sum(self.sizes[i] for i in come)
        self.note(b)


def local_search(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Empty the emptiest bins into fuller ones as far as moves and exchanges go."""
    least = max(-(-sum(sizes) // room), sum(2 * s > room for s in sizes))
    spare = len(bins) - least
    if spare <= 0:
        return bins
    fuller = _Fuller(bins, sizes, room)
    left = spare
    for target in sorted(range(len(bins)), key=lambda b: -fuller.gap[b])[:4 * spare + 16]:
        fuller.out.add(target)  # what is emptier than a bin never receives from it
        while bins[target] and left > 0:
            mine = sorted(bins[target], key=lambda i: -sizes[i])
            choices = [[i] for i in mine] + [[mine[a], mine[b]] for a in range(len(mine)) for b in range(a + 1, len(mine)) if sizes[mine[a]] + sizes[mine[b]] <= room]
            best = None
            for given in choices:
                size = sum(sizes[i] for i in given)
                x = fuller.smallest(size)
                if x is not None and (best is None or size - x > best[0]):
                    best = (size - x, given, x)
            if best is None:
                break
            fuller.exchange(target, best[1], best[2])
        left -= not bins[target]
        if left <= 0:
            break
    return [b for b in bins if b]


def _packed(room: int):
    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].tolist()
        bins = local_search(best_fit(sizes, room), sizes, room)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = b, at
                at += sizes[i]
        return pdf.drop(columns="pack_group").assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return group


def pack(cut_pieces: DataFrame, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to rows of :func:`pieces`; full pieces get negative numbers.

    The rows are read more than once, so they should be stored (see :func:`pack_documents`).
    """
    packed_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id long, offset long"
    part = cut_pieces.where(F.col("length") < length)
    groups = max(1, -(-part.count() // group_pieces))
    part = part.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    packed = part.groupBy("pack_group").applyInPandas(_packed(length), packed_schema)
    full = cut_pieces.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).where(F.col("length") == length).withColumn("offset", F.lit(0).cast("long"))
    return packed.union(full.select(*packed.columns))


def pack_documents(docs: DataFrame, length: int = SEQUENCE, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise once, store the pieces, pack them."""
    return pack(cut(pieces(docs, length, files, with_ids)), length)
