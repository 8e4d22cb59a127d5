"""License notices by exact set-similarity join.

A text's blocks are all its windows of consecutive words, for each template as long as the template
divided by the threshold, wherever lines or paragraphs end. A block matches a template if it contains
at least ``threshold`` of the template's distinct words. Words are put in order of how many blocks of
the corpus hold them; a block and a template can only match if their rarest words meet (prefix
filter), if the block has enough words (length filter), and if enough words follow the first that
meets (positional filter). What is left is verified in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivist.llm.common import alnum_words, small_batches, text_bytes, written

# Phrases whose places are counted, and sentences of public licenses by label.
PHRASES: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under CC BY-NC 3.0"),
    ("cc", "CC0 1.0 Universal Public Domain Dedication"),
    ("cc", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Words that name a license: a block that lacks one of a template's doesn't match it, however like it it is.
NAMING = frozenset("affero apache boost cc cc0 commons creative eclipse gnu lesser mozilla".split())


def _hashed(text: str) -> np.ndarray:
    return alnum_words().of(pa.array([text]))[0]


def _scan(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], threshold: float):
    """Per text: words, phrase places and, for every block that holds enough words of a template,
    which of the templates' words it holds."""
    wanted = [_hashed(p) for p, _ in phrases]
    words_of = [_hashed(t) for _, t in templates]
    sets = [np.unique(w) for w in words_of]
    vocabulary = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    needs = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    spans = [math.ceil(len(w) / threshold - 1e-9) for w in words_of]
    member = np.array([np.isin(vocabulary, s) for s in sets]).reshape(len(sets), len(vocabulary))

    def blocks(place: np.ndarray, token: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, span, tokens) of windows of ``span`` words from the known word ``first`` on, with
        all distinct known words in it, if there are as many words of a template of that span, counted
        with repeats, as it needs. ``place`` is each known word's, far apart for different texts."""
        for span in sorted(set(spans)):
            start = np.zeros(len(place), bool)
            for own, need, length in zip(member, needs, spans, strict=True):
                if length == span:
                    at = np.flatnonzero(own[token])
                    end = np.searchsorted(place[at], place[at] + span)
                    start[at[end - np.arange(len(at)) >= need]] = True
            first = np.flatnonzero(start)
            last = np.searchsorted(place, place[first] + span)
            for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
                yield lo, span, np.unique(token[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = alnum_words()
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            start, end = cut.bounds(data, at)
            words, first = cut.hashes(data, start, end), np.searchsorted(start, at)
            n = len(at) - 1
            doc = np.repeat(np.arange(n), np.diff(first))
            n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            for phrase, (_, label) in zip(wanted, phrases, strict=True):
                size = len(words) - len(phrase) + 1
                if size <= 0:
                    continue
                here = doc[:size] == doc[len(phrase) - 1 :]
                for k, word in enumerate(phrase):
                    here &= words[k : k + size] == word
                places = np.flatnonzero(here)
                docs = doc[places]
                np.add.at(n_base, docs, 1)
                np.minimum.at(low, docs, places - first[docs])
                np.maximum.at(high, docs, places - first[docs])
                for d in np.unique(docs).tolist():
                    labels[d].add(label)
            held: list[dict] = [{} for _ in range(n)]  # equal windows of a text once
            if len(vocabulary):
                token = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[token] == words)
                place = known + doc[known] * max(spans)
                for at_word, span, tokens in blocks(place, token[known]):
                    held[doc[known[at_word]]].setdefault((span, tokens.tobytes()), {"block": int(known[at_word]), "span": span, "tokens": tokens.tolist()})
            some = n_base > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(n_base, pa.int64()),
                    pa.array(low, pa.int64(), mask=~some),
                    pa.array(high, pa.int64(), mask=~some),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                    pa.array([list(h.values()) for h in held], pa.list_(pa.struct([("block", pa.int64()), ("span", pa.int32()), ("tokens", pa.list_(pa.int32()))]))),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
            )

    index = [np.searchsorted(vocabulary, s).tolist() for s in sets]
    naming = np.concatenate([_hashed(w) for w in sorted(NAMING)])
    named = [np.searchsorted(vocabulary, s[np.isin(s, naming)]).tolist() for s in sets]
    return run, index, spans, named


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``labels`` are those of the phrases found and of all templates that a block matches; ``score``
    is 1 if a phrase is found, else the largest containment of a matching block, else 0. Null and
    empty texts have no words and no labels; very long texts are scanned whole; repeated rows are found
    alike; an empty table gives an empty result; other columns are ignored, whatever their names. Templates
    and phrases are short lists that go to every task; the words of all templates together are what is
    counted over the corpus. Of a template the words that name a license must all be in the block.
    """
    small_batches(docs.sparkSession)
    run, index, spans, named = _scan(phrases, templates, threshold)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<block: long, span: int, tokens: array<int>>>"
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(plain.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.span", "b.tokens")
    counts = {r[0]: r[1] for r in blocks.select(F.explode("tokens").alias("t")).groupBy("t").count().collect()}  # words of templates
    rank = {t: k for k, t in enumerate(sorted({t for s in index for t in s}, key=lambda t: (counts.get(t, 0), t)))}
    spark = docs.sparkSession
    prefixes = []
    for k, ((label, _), tokens) in enumerate(zip(templates, index, strict=True)):
        need = math.ceil(threshold * len(tokens) - 1e-9)
        line = sorted(rank[t] for t in tokens)
        names = [rank[t] for t in named[k]]
        prefixes += [(r, spans[k], at, k, label, line, need, names) for at, r in enumerate(line[: len(line) - need + 1])]
    known = spark.createDataFrame(prefixes, "token int, span int, t_at int, template int, label string, line array<int>, need int, names array<int>")
    order = F.array(*[F.lit(rank[t]) for t in sorted(rank)]) if rank else F.array().cast("array<int>")
    ordered = blocks.withColumn("ranks", F.array_sort(F.transform("tokens", lambda t: F.element_at(order, t + 1))))
    probes = ordered.select("row", "block", "span", "ranks", F.posexplode("ranks").alias("b_at", "token"))
    size, t_size = F.size("ranks"), F.size("line")
    met = probes.join(F.broadcast(known), ["token", "span"]).where(
        (size >= F.col("need"))
        & (F.col("b_at") <= size - F.col("need"))
        & (1 + F.least(size - F.col("b_at") - 1, t_size - F.col("t_at") - 1) >= F.col("need"))
    )
    pairs = met.dropDuplicates(["row", "block", "span", "template"])
    share = F.size(F.array_intersect("ranks", "line")) / t_size
    found = pairs.withColumn("share", share).where((F.col("share") >= threshold - 1e-9) & (F.size(F.array_except("names", "ranks")) == 0))
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    full = rows.drop("blocks").join(found, "row", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return full.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
