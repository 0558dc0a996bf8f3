"""License scan: exact phrases, and an exact set-similarity join of text blocks with templates.

The join finds every block B and template T with ``|B & T| >= ceil(threshold * |T|)`` over
sets of words. The words of the templates are ordered by how many blocks of the whole
corpus hold them, rarest first. A block that meets the threshold holds one of the first
``|T| - needed + 1`` words of T (prefix filter), has at least ``needed`` words (length
filter), and after its first match at place i of T there remain enough words
(positional filter); what passes is counted exactly. The templates are a parameter and
travel with the tasks; documents stay in their task, so the join shuffles no text.

A block is a line; a paragraph of several lines, where blank lines part the text; or, for
a template of n words, a run of lines of one paragraph that begins with any line and goes
on until the lines after its first one hold n - 1 words or the paragraph ends. A wrapped
passage of a template therefore lies whole in a run, wherever in a line it begins, and
a long text without blank lines is not one block that holds every common word.

Defined results: null and empty texts have no words, no label and score 0; repeated
phrases count at each place, overlapping ones too; a template without words matches
nothing; repeated documents each get their row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import in_batches
from .textbytes import NON_ALNUM, blocks, hashes, per_row, runs, texts, word_hashes

# The phrases and labels of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Passages of public licences and of the notices that refer to them.
TEMPLATES = [
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-work-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0"),
    ("mit-notice", "Released under the MIT License"),
    ("warranty-disclaimer", "The software is provided as is, without warranty of any kind, express or implied"),
    ("rights-reserved", "All rights reserved"),
]
THRESHOLD = 0.8

SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, template_labels array<string>, containment double"


def _block_rows(data: np.ndarray, starts: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line and paragraph number of every word, and of those in a text that blank lines part, the paragraph again (else -1)."""
    feed = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(feed, starts)
    before = np.zeros(len(starts), np.int64)
    before[1:] = line[1:] - line[:-1]
    other_row = np.ones(len(starts), bool)
    other_row[1:] = row[1:] != row[:-1]
    by_line = np.cumsum(other_row | (before > 0)) - 1
    by_paragraph = np.cumsum(other_row | (before > 1)) - 1
    parted = np.zeros(int(row.max()) + 1 if len(row) else 0, bool)
    parted[row[~other_row & (before > 1)]] = True
    return by_line, by_paragraph, np.where(parted[row], by_paragraph, -1)


def _word_blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    starts, ends, row = runs(data, offsets, NON_ALNUM)
    return row, hashes(data, starts, ends), _block_rows(data, starts, row)


def _last_lines(by_line: np.ndarray, by_paragraph: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: the last line of its run for a template of ``n_words`` words, and the runs' first and last words + 1."""
    lines = int(by_line[-1]) + 1
    first = np.searchsorted(by_line, np.arange(lines))
    after = np.append(first[1:], len(by_line))
    end = np.searchsorted(by_paragraph, by_paragraph[first], "right")  # of the paragraph
    wanted = np.minimum(after + max(n_words - 1, 0), end)
    last = np.maximum(by_line[np.maximum(wanted, 1) - 1], np.arange(lines))
    return last, first, after[last]


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, np.ndarray]]:
    return [(label, np.unique(word_hashes(text, NON_ALNUM))) for label, text in templates]


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """In how many blocks of the corpus each word of a template stands (as many rows as template words)."""
    sets = template_sets(templates)
    vocabulary = np.unique(np.concatenate([s for _, s in sets])) if sets else np.zeros(0, np.uint64)
    if not len(vocabulary):
        return {}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for _, _, part, bounds in blocks(data, offsets):
                row, h, (by_line, *_) = _word_blocks(part, bounds)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[at] == h
                pairs = np.unique(by_line[known] * len(vocabulary) + at[known])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], names=["word", "n"])

    counted = in_batches(docs).select("text").mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: phrase places and labels, template labels and the best containment (0 if none meets it)."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    wanted = [(word_hashes(p, NON_ALNUM), label) for p, label in phrases.items()]
    frequency = word_frequencies(docs, templates)
    ordered = []
    for label, words in template_sets(templates):
        rank = sorted(words.tolist(), key=lambda w: (frequency.get(int(np.uint64(w).view(np.int64)), 0), w))
        needed = math.ceil(threshold * len(rank) - 1e-9)
        if rank:
            ordered.append((label, np.array(rank, np.uint64), needed))
    lengths = {label: len(word_hashes(text, NON_ALNUM)) for label, text in templates}
    vocabulary = np.unique(np.concatenate([w for _, w, _ in ordered])) if ordered else np.zeros(0, np.uint64)
    # word of the vocabulary -> its place in each template (-1: not in it)
    places = np.full((len(ordered), len(vocabulary) + 1), -1, np.int64)
    for t, (_, words, _) in enumerate(ordered):
        places[t, np.searchsorted(vocabulary, words)] = np.arange(len(words))

    def joined(row: np.ndarray, h: np.ndarray, block: np.ndarray, labels: list[set[str]], best: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = np.flatnonzero((vocabulary[at] == h) & (block >= 0))
        if not len(known):
            return
        pair = np.unique(block[known] * len(vocabulary) + at[known])
        in_block, word = pair // len(vocabulary), pair % len(vocabulary)
        size = np.bincount(block[block >= 0], minlength=int(block.max()) + 1)  # words, so at least the set's size
        owner = np.zeros(int(block.max()) + 1, np.int64)
        owner[block[block >= 0]] = row[block >= 0]
        for t, (label, words, needed) in enumerate(ordered):
            met(in_block, places[t, word], size, owner, (label, words, needed), labels, best)

    def met(in_block: np.ndarray, place: np.ndarray, size: np.ndarray, owner: np.ndarray, template: tuple, labels: list[set[str]], best: np.ndarray) -> None:
        """Label the owners of blocks that meet a template; (in_block, place) are distinct, a place below 0 is none."""
        label, words, needed = template
        member = place >= 0
        first = np.full(len(size), len(words), np.int64)
        np.minimum.at(first, in_block[member], place[member])
        prefix = first <= len(words) - needed
        candidate = prefix & (size >= needed) & (len(words) - first >= needed)
        overlap = np.bincount(in_block[member & candidate[in_block]], minlength=len(size))
        for b in np.flatnonzero(candidate & (overlap >= needed)).tolist():
            labels[owner[b]].add(label)
            best[owner[b]] = max(best[owner[b]], overlap[b] / len(words))

    def joined_runs(row: np.ndarray, h: np.ndarray, by_line: np.ndarray, by_paragraph: np.ndarray, labels: list[set[str]], best: np.ndarray) -> None:
        """The same for runs of lines; only those of several lines, and a word counts for all runs that its line is in."""
        if not len(h):
            return
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[at] == h
        for t, template in enumerate(ordered):
            last, first, end = _last_lines(by_line, by_paragraph, lengths[template[0]])
            place = np.where(known, places[t, at], -1)
            own = np.flatnonzero(place >= 0)
            # a run with fewer words of the template than needed, repeats included, can't meet it
            count = np.concatenate([[0], np.cumsum(place >= 0)])
            likely = (count[end] - count[first] >= template[2]) & (last > np.arange(len(last)))
            if not likely.any():
                continue
            earliest = np.searchsorted(last, by_line[own])  # last never falls from line to line
            n = by_line[own] - earliest + 1
            runs_of = np.repeat(earliest - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            there = likely[runs_of]
            pair = np.unique(runs_of[there] * len(template[1]) + np.repeat(place[own], n)[there])
            met(pair // len(template[1]), pair % len(template[1]), end - first, row[first], template, labels, best)

    def shard(ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        rows = len(offsets) - 1
        row, h, (by_line, by_paragraph, parted) = _word_blocks(data, offsets)
        n_words = per_row(row, rows)
        begins = np.cumsum(n_words) - n_words
        n_base, base = np.zeros(rows, np.int64), [set() for _ in range(rows)]
        first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, np.int64)
        for words, label in wanted:
            at = np.flatnonzero(h == words[0]) if len(words) else np.zeros(0, np.int64)
            at = at[at + len(words) <= len(h)]
            for step in range(1, len(words)):
                at = at[(h[at + step] == words[step]) & (row[at + step] == row[at])]
            np.add.at(n_base, row[at], 1)
            np.minimum.at(first, row[at], at - begins[row[at]])
            np.maximum.at(last, row[at], at - begins[row[at]])
            for r in np.unique(row[at]).tolist():
                base[r].add(label)
        more, best = [set() for _ in range(rows)], np.zeros(rows)
        if len(vocabulary):
            for block in (by_line, parted):
                joined(row, h, block, more, best)
            joined_runs(row, h, by_line, by_paragraph, more, best)
        none = n_base == 0
        strings = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
            pa.array([sorted(x) for x in base], strings), pa.array([sorted(x) for x in more], strings), pa.array(best),
        ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "template_labels", "containment"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = texts(batch.column(1))
            for start, end, part, bounds in blocks(data, offsets):
                yield shard(ids[start:end], part, bounds)

    return in_batches(docs).select("doc_id", "text").mapInArrow(task, SCAN)
