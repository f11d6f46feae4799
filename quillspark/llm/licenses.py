"""License scans by an exact set-similarity join.

Template tokens are ordered by their document frequency over the whole corpus, the rarest first. A text block holds a
template if at least `THRESHOLD` of the template's distinct tokens are in it. Such a block has all but few of them, so it has
one of the template's rarest (prefix filter), as many tokens at least as must match (length filter), and enough tokens
left after its first match in that order (positional filter); what passes is compared in full. A block is a run of words in a
paragraph (neighbouring lines with words) of at most twice the template's length, so words that lie scattered over a long text
are no match. All blocks that meet the threshold are found.

Words: A-Z in lower case, runs of letters a-z, digits and non-ASCII bytes. Null texts have no words. Repeated rows give
repeated results. Without documents there is no result.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_texts, table, texts_of

THRESHOLD = 0.9
#: Phrases whose words stand consecutively, with the label each gives.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Well-known notices.
TEMPLATES = {
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    "apache-2": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "gpl-3": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "bsd-3": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "gpl-2": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "lgpl-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "agpl-3": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "boost-1": ("Distributed under the Boost Software License, Version 1.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "epl-2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",),
}
#: A-Z to a-z, and separators other than line ends to blanks.
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c == 10 else 32 for c in range(256))


def lines_of(text: str | None) -> list[list[bytes]]:
    """Words of each line."""
    return [x.split() for x in (text or "").encode("utf-8", "replace").translate(_WORDS).split(b"\n")]


def templates(texts: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, frozenset[bytes], int]]:
    """Label, distinct words and number of words."""
    out = []
    for label, some in texts.items():
        for t in some:
            words = [w for line in lines_of(t) for w in line]
            out.append((label, frozenset(words), len(words)))
    return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Word index and label of each place of a phrase."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        wanted = b" " + phrase.encode() + b" "
        at = joined.find(wanted)
        while at >= 0:
            out.append((joined.count(b" ", 0, at), label))
            at = joined.find(wanted, at + 1)
    return out


class Matcher:
    """The join's probe side: blocks against the templates' prefix index."""

    def __init__(self, order: list[bytes], threshold: float, known: list[tuple[str, frozenset[bytes], int]]):
        self.rank = {w: i for i, w in enumerate(order)}
        self.words = frozenset(order)
        self.known = [(label, sorted(self.rank[w] for w in words), max(1, math.ceil(threshold * len(words) - 1e-9))) for label, words, _ in known if words]
        self.spans = [2 * n for _, words, n in known if words]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (_, tokens, need) in enumerate(self.known):
            for at, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.index.setdefault(token, []).append((t, at))
        self.least = min((need for _, _, need in self.known), default=1)

    def matches(self, block: set[bytes]) -> list[tuple[int, float]]:
        """Templates that the block holds, with their containment."""
        found = block & self.words
        if len(found) < self.least:
            return []
        own = sorted(self.rank[w] for w in found)
        seen, out = set(), []
        for at, token in enumerate(own):
            for t, there in self.index.get(token, ()):
                _, tokens, need = self.known[t]
                if t in seen or len(own) < need or 1 + min(len(tokens) - there, len(own) - at) - 1 < need:
                    continue
                seen.add(t)
                both = len(set(tokens).intersection(own))
                if both >= need:
                    out.append((t, both / len(tokens)))
        return out


    def densest(self, t: int, at: list[tuple[int, int]]) -> int:
        """The most distinct tokens of a template within its span; at: place and rank of the paragraph's words that any template has."""
        wanted, span = set(self.known[t][1]), self.spans[t]
        inside: dict[int, int] = {}
        best = first = 0
        own = [(p, r) for p, r in at if r in wanted]
        for place, rank in own:
            inside[rank] = inside.get(rank, 0) + 1
            while own[first][0] <= place - span:
                gone = own[first][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                first += 1
            best = max(best, len(inside))
        return best

    def found(self, paragraph: list[bytes]) -> list[tuple[int, float]]:
        """Templates that a block of the paragraph holds, with the best containment of one."""
        out = []
        some = self.matches(set(paragraph))
        if some:
            at = [(i, self.rank[w]) for i, w in enumerate(paragraph) if w in self.words]
            for t, _ in some:
                _, tokens, need = self.known[t]
                n = self.densest(t, at)
                if n >= need:
                    out.append((t, n / len(tokens)))
        return out


def paragraphs_of(lines: list[list[bytes]]):
    """Words of neighbouring lines that have any."""
    paragraph: list[bytes] = []
    for line in [*lines, []]:
        if line:
            paragraph += line
        elif paragraph:
            yield paragraph
            paragraph = []


def token_order(docs: DataFrame, known: list[tuple[str, frozenset[bytes], int]]) -> list[bytes]:
    """The templates' tokens, those in the fewest documents first. Each task sends a count for each token at most."""
    words = frozenset(w for _, some, _ in known for w in some)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                seen.update(words.intersection((x.as_py() or "").encode("utf-8", "replace").translate(_WORDS).split()))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = {bytes(r["word"]): r["n"] for r in texts_of(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def scan(docs: DataFrame, threshold: float = THRESHOLD, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the best containment of a template found, 1 with a phrase."""
    known = templates(texts)
    sent = docs.sparkSession.sparkContext.broadcast(token_order(docs, known))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def start():
        m = Matcher(sent.value, threshold, known)

        def one(x):
            lines = lines_of(x)
            words = [w for line in lines for w in line]
            base = base_places(words)
            found = {}
            for paragraph in paragraphs_of(lines):
                for t, share in m.found(paragraph):
                    label = m.known[t][0]
                    found[label] = max(share, found.get(label, 0.0))
            places = [at for at, _ in base]
            own = {label for _, label in base}
            return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(found))), 1.0 if base else max(found.values(), default=0.0)

        return lambda doc_id, text: {"doc_id": doc_id} | dict(zip(names, map(list, zip(*map(one, text), strict=True)), strict=True))

    return map_texts(texts_of(docs), start, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
