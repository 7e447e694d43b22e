"""License scans by an exact set-similarity join of text blocks with license templates.

A document's words are cut into overlapping blocks of ``2 * stride`` words,
``stride`` apart, so that every passage of at most ``stride`` words lies whole
in a block; the stride is ``STRIDE`` or, where that is more, the words of the longest
template.  A block meets a template when it holds at least ``ceil(threshold *
size)`` of the template's different words.  Templates' words are ordered by
their frequency in all documents, rarest first.  A block can only meet a
template if it holds one of the template's first ``size - needed + 1`` words
(prefix), if it has at least as many words as needed (length), and if, in that
order, both the template and the block have enough template words from the first
shared one on (positional); what passes is counted exactly.

Phrases are templates that need all their words; a block that meets one is
then searched for the places where its words stand consecutively.

The templates are a fixed small table that is sent to each task; documents are
never shuffled.  Null texts are empty, each input row gives one row, repeated
rows and null ids too; no rows give no rows.  Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_words, in_sorted, words

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening passages of public license texts and their labels.
TEMPLATES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction": "mit-text",
    "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl-notice",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "This work is licensed under a Creative Commons Attribution International License": "cc-by-notice",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Released under the MIT License": "mit-notice",
}
THRESHOLD = 0.85
STRIDE = 48


class Index:
    """The templates' words as ids in global frequency order, and which templates a prefix word may start."""

    def __init__(self, frequency: dict[int, int] | None = None, threshold: float = THRESHOLD) -> None:
        texts = [*PHRASES, *TEMPLATES]
        hashed = hash_words(texts, True)
        self.labels = [*PHRASES.values(), *TEMPLATES.values()]
        self.phrases = hashed[: len(PHRASES)]
        vocabulary = sorted({int(h) for x in hashed for h in x}, key=lambda h: ((frequency or {}).get(h, 0), h))
        rank = {h: i for i, h in enumerate(vocabulary)}
        self.keys = np.sort(np.array(vocabulary, np.uint64))
        self.rank = np.array([rank[int(h)] for h in self.keys], np.int64)  # by place in keys
        self.phrase_ranks = [np.array([rank[int(h)] for h in x]) for x in self.phrases]
        self.sets = [np.array(sorted({rank[int(h)] for h in x})) for x in hashed]  # rarest first
        self.longest = max(map(len, hashed))
        self.needed = [len(s) if k < len(PHRASES) else ceil(threshold * len(s) - 1e-9) for k, s in enumerate(self.sets)]
        self.starts: dict[int, list[tuple[int, int]]] = {}  # rank of a prefix word: template, place in its order
        for k, s in enumerate(self.sets):
            for place in range(len(s) - self.needed[k] + 1):
                self.starts.setdefault(int(s[place]), []).append((k, place))
        self.is_prefix = np.zeros(len(vocabulary), bool)
        self.is_prefix[list(self.starts)] = True


def _scan(index: Index, ranks: np.ndarray, places: np.ndarray, n_words: int, stride: int) -> tuple[dict[int, set[int]], dict[int, float]]:
    """Of one document: start places by phrase; best containment by template met. ranks, places: its template words."""
    found: dict[int, set[int]] = {}
    best: dict[int, float] = {}
    candidates: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(index.is_prefix[ranks]):
        last = int(places[i]) // stride
        for block in range(max(0, last - 1), last + 1):
            for k, place in index.starts[int(ranks[i])]:
                candidates[block, k] = min(place, candidates.get((block, k), place))
    for (block, k), place in sorted(candidates.items()):
        a, b = block * stride, min((block + 2) * stride, n_words)
        if b - a < index.needed[k]:
            continue
        lo, hi = np.searchsorted(places, [a, b])
        own, at = ranks[lo:hi], places[lo:hi]
        in_order = np.unique(own)
        if min(len(index.sets[k]) - place, len(in_order) - np.searchsorted(in_order, index.sets[k][place])) < index.needed[k]:
            continue
        shared = len(np.intersect1d(own, index.sets[k]))
        if shared < index.needed[k]:
            continue
        if k < len(index.phrases):
            phrase = index.phrase_ranks[k]
            n = len(phrase)
            ok = np.ones(max(0, len(own) - n + 1), bool)
            for j in range(n):
                ok &= (own[j : len(own) - n + 1 + j] == phrase[j]) & (at[j : len(own) - n + 1 + j] - at[: len(ok)] == j)
            if ok.any():
                found.setdefault(k, set()).update(at[: len(ok)][ok].tolist())
        else:
            best[k] = max(best.get(k, 0.0), shared / len(index.sets[k]))
    return found, best


def word_frequency(docs: DataFrame) -> dict[int, int]:
    """How often each word of the templates occurs in all texts; as many rows as the templates have words."""
    keys = Index().keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                found, place = in_sorted(keys, words(data, bounds, True)[0])
                n += np.bincount(place[found], minlength=len(keys))
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(keys)), "n": n})

    rows = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {int(keys[r.k]): r.n for r in rows}


def scan(docs: DataFrame, threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each (doc_id, text).

    score: the greatest containment of a template that a block meets, 1 for a phrase's occurrence, else 0.
    """
    made = Index(word_frequency(docs), threshold)
    stride = max(stride, made.longest)
    index = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            n = batch.num_rows
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first: list[int | None] = [None] * n
            last: list[int | None] = [None] * n
            base, labels = [""] * n, [""] * n
            for at, to, data, bounds in chunks(batch.column(1)):
                value, row, _, _ = words(data, bounds, True)
                counts = np.bincount(row, minlength=to - at)
                n_words[at:to] = counts
                begin = np.concatenate([[0], np.cumsum(counts)])
                known, place = in_sorted(ix.keys, value)
                where = np.flatnonzero(known)
                rank = ix.rank[place[where]]
                for r in np.unique(row[where[ix.is_prefix[rank]]]):
                    lo, hi = np.searchsorted(where, [begin[r], begin[r + 1]])
                    found, best = _scan(ix, rank[lo:hi], where[lo:hi] - begin[r], int(counts[r]), stride)
                    starts = [p for x in found.values() for p in x]
                    if starts:
                        first[at + r], last[at + r] = min(starts), max(starts)
                    n_base[at + r] = len(starts)
                    own = {ix.labels[k] for k in found}
                    base[at + r] = ",".join(sorted(own))
                    labels[at + r] = ",".join(sorted(own | {ix.labels[k] for k in best}))
                    score[at + r] = max([1.0 if starts else 0.0, *best.values()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
