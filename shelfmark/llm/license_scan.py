"""License scans as an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or as many words in a row as a template has, wherever lines end, so that wrapped notices
are found; a template is a short license notice. All are sets of words. A block matches a template if it contains at
least ``threshold`` of the template's words (containment |block and template| / |template|). Words in a row must hold
the telling ones, too: those that the template has in common with its label (nc, sa, mit, a version), without which they
may be the notice of another license. Lines need not, so that the join gives every pair that meets the threshold.

Two options tell near-equal licenses apart. With ``ranked``, near-equal templates (one holds ``threshold`` of the other's
words) that match the same place are ranked: first those whose telling words stand there without a word that only another
license has (lesser, noncommercial), then those whose telling words stand there, then others. A match gives way to a
near-equal one of a higher rank, so a place that meets the threshold always keeps a label. With ``telling``, matches must
be of the first rank, so a notice with another license's word gets no label at all.

The words of the templates are ordered by their document frequency over the whole corpus, rarest first. Any matching block holds
one of the first |T| - ceil(t |T|) + 1 words of a template (prefix filter), has at least ceil(t |T|) words (length
filter), and, where its first hit is the i-th word of a template, can have no more than |T| - i of them (positional
filter). Only blocks that pass are verified.

The templates are a small parameter and travel with the task; the corpus is read twice, for the frequencies (a sum of
at most one row per template word and task) and for the scan, and no text is shuffled.

Defined results: a null text is an empty one, with no words; a text without matches has a score of the largest
containment of any block that passed the filters, else 0; repeated rows are all scanned; ties between templates give
all their labels; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import parts, small_batches

THRESHOLD = 0.8
#: Phrases of the base scan with their labels (fixed values of the contract).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: License notices as they stand in texts, with labels.
TEMPLATES = (
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the"
        " Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
        " copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the"
        " License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache-2",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the"
        " Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gpl-3",
    ),
    (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the"
        " Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "gpl-2",
    ),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
)
#: Words that tell a template with them from near-equal ones, besides those of its label.
TELLING = frozenset({b"noncommercial", b"sharealike", b"attribution", b"apache", b"mozilla", b"gnu", b"redistribution", b"unencumbered", b"fee", b"charge"})
#: Words that a block may hold only if the template does: they make it another license's notice.
OTHERS = frozenset({b"lesser", b"library", b"affero", b"noncommercial", b"sharealike", b"noderivatives", b"nonfree", b"nc", b"sa", b"nd"})
SCAN_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def _word_table() -> bytes:
    """Bytes of a text to bytes of its words: A-Z in lower case, what separates words as a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[byte] = byte
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    return bytes(table)


WORDS = _word_table()
LINES = WORDS[:10] + b"\n" + WORDS[11:]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split(b" ")


class Template(NamedTuple):
    label: str
    #: Distinct words, rarest first.
    words: tuple[bytes, ...]
    #: Words that a block must share.
    need: int
    #: Words that a block of words in a row must hold in any case.
    telling: frozenset[bytes]
    #: Words in a row, repeated ones included.
    length: int
    #: Words that any block must hold, and that none may hold, where near-equal licenses are told apart.
    own: frozenset[bytes] = frozenset()
    others: frozenset[bytes] = frozenset()

    def rank(self, block: set[bytes]) -> int:
        """How sure it is that ``block`` is this license's notice and no near-equal one's."""
        return 0 if not self.own <= block else 1 if self.others & block else 2

    def near(self, other: Template, threshold: float) -> bool:
        return len({*self.words} & {*other.words}) >= threshold * min(len(self.words), len(other.words)) - 1e-9


class Match(NamedTuple):
    """A template found in words start to stop of a line (or of the text), with its containment and rank."""

    template: Template
    score: float
    start: int
    stop: int
    rank: int


def told_apart(matches: list[Match], threshold: float) -> list[Match]:
    """Those that no overlapping match of a near-equal template and a higher rank outdoes."""
    kept = [m for m in matches if m.score >= threshold]
    outdone = lambda m: any(o.rank > m.rank and o.start < m.stop and m.start < o.stop and m.template.near(o.template, threshold) for o in kept)
    return [m for m in matches if not outdone(m)]


def order_templates(templates, frequency: dict[bytes, int], threshold: float, apart: bool = False) -> list[Template]:
    """Templates with their words in the global order: by document frequency, then by bytes."""
    ordered = []
    for text, label in templates:
        words = sorted({w for w in words_of(text) if w}, key=lambda w: (frequency.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        length = len([w for w in words_of(text) if w])
        named = frozenset(words_of(label)) & set(words)
        sets = (named | TELLING & set(words), OTHERS - set(words)) if apart else ()
        ordered.append(Template(label, tuple(words), need, named, length, *sets))
    return ordered


class TemplateJoin:
    """Prefix index over ordered templates."""

    def __init__(self, templates: list[Template], threshold: float):
        self.threshold, self.prefixes = threshold, {}
        for template in templates:
            for i, word in enumerate(template.words[: len(template.words) - template.need + 1]):
                self.prefixes.setdefault(word, []).append((i, template))
        rarest = sorted(self.prefixes, key=len, reverse=True)
        self.probe = re.compile(b"|".join(re.escape(word) for word in rarest) or b"(?!)")

    def matches(self, lines: bytes) -> Iterator[list[Match]]:
        """For each line, its verified pairs with templates."""
        seen = -1
        for hit in self.probe.finditer(lines):
            if hit.start() < seen:
                continue
            start, seen = lines.rfind(b"\n", 0, hit.start()) + 1, lines.find(b"\n", hit.end())
            seen = len(lines) if seen < 0 else seen
            block = set(lines[start:seen].split())
            tried, found = set(), []
            for word in block & self.prefixes.keys():
                for i, template in self.prefixes[word]:
                    size = len(template.words)
                    if template in tried or len(block) < template.need or size - i < template.need:
                        continue
                    if any(w in block for w in template.words[:i]):
                        continue  # found at an earlier word of the template
                    tried.add(template)
                    found.append(Match(template, sum(w in block for w in template.words[i:]) / size, 0, 1, template.rank(block)))
            yield found

    def window_matches(self, words: list[bytes]) -> Iterator[Match]:
        """The best windows of each template's length around its prefix words."""
        done: dict[Template, int] = {}
        for at, word in enumerate(words):
            if word not in self.prefixes:
                continue
            for _, template in self.prefixes[word]:
                length, own = template.length, set(template.words)
                # Windows that hold this word and were not seen at an earlier one.
                start, stop = max(0, at - length + 1, done.get(template, 0)), at + 1
                done[template] = stop
                around = own.intersection(words[start : at + length])
                if len(around) < template.need or not template.telling <= around:
                    continue
                shared = [own.intersection(words[i : i + length]) for i in range(start, stop)]
                best = max((len(s) for s in shared if template.telling <= s), default=0)
                if best >= template.need:
                    yield Match(template, best / len(own), start, at + length, template.rank(set(words[start : at + length])))


def document_frequencies(docs: DataFrame, templates) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each word of the templates; at most one row per such word."""
    wanted = sorted({w for text, _ in templates for w in words_of(text) if w})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(wanted, 0)
        for batch in batches:
            for text in batch.column("text"):
                if text := text.as_py():
                    for word in counts.keys() & set(words_of(text)):
                        counts[word] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    counted = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(row.word): row.n for row in counted.collect()}


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, telling: bool = False, ranked: bool = False
) -> DataFrame:
    """One row per document: word count, places of the base phrases, labels of both methods, best containment.

    ``telling``, ``ranked``: how near-equal licenses are told apart (see the module); without either, all matches count.
    """
    small_batches(docs.sparkSession)
    join = TemplateJoin(order_templates(templates, document_frequencies(docs, templates), threshold, telling or ranked), threshold)
    known = [(b" %s " % phrase.encode(), label) for phrase, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = (text.as_py() or "").encode()
                words = data.translate(WORDS).split()
                line = b" %s " % b" ".join(words)
                places, base = [], set()
                for phrase, label in known:
                    at, before, word = line.find(phrase), 0, 0
                    while at >= 0:
                        word += line.count(b" ", before, at)
                        places.append(word)
                        base.add(label)
                        before, at = at, line.find(phrase, at + 1)
                groups = [*join.matches(data.translate(LINES)), list(join.window_matches(words))]
                if telling:
                    groups = [[m for m in group if m.rank == 2] for group in groups]
                score = max((m.score for group in groups for m in group), default=0.0)
                found = [m for group in groups for m in (told_apart(group, join.threshold) if ranked else group)]
                labels = base | {m.template.label for m in found if m.score >= join.threshold}
                rows.append((
                    doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), score,
                ))
            names = [field.split()[0] for field in SCAN_SCHEMA.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN_SCHEMA)
