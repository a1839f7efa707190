"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words, at any place of a text and over line breaks, as
long as a template of its length and ``threshold`` allow (``span`` words: those of the
template over the threshold).  A template is met where a block holds at least ``threshold``
of the template's word set.  Template words are ordered by how many documents of the whole
corpus have them, rarest first.  A block that meets a template of n words at threshold t has
one of its first n - ceil(t n) + 1 words (prefix filter), so only the words around those are
looked at; they are at least ceil(t n) (length filter), and after the k-th of the template's
words, rarest first, those found and the n - k to come still reach ceil(t n) (positional
filter).  What is left is counted exactly, window by window.

Templates are the caller's, a table of a bounded size; the corpus side is never broadcast.

Defined cases: a null or empty text has no words and no labels; repeated rows are scanned
each; blocks that overlap are reported as one, with the containment of the best; a text
shorter than a span is one block, and one of any length costs time and memory in proportion.
A notice that holds another one's words (the LGPL's long notice those of the GPL's) has the
labels of both.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm.common import PLAIN_WORDS, map_texts, texts

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices and passages of well-known licenses, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def document_frequencies(docs: DataFrame, words: set[str]) -> dict[str, int]:
    """In how many documents each of these words stands; one row a word comes back."""
    wanted = {w.encode() for w in words}

    def make():
        def run(batch, values):
            tally: dict[bytes, int] = {}
            for x in values:
                for w in wanted.intersection((x or b"").translate(PLAIN_WORDS).split()):
                    tally[w] = tally.get(w, 0) + 1
            return {"word": [w.decode() for w in tally], "n": list(tally.values())}

        return run

    rows = map_texts(texts(docs), make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in words} | {r["word"]: r["n"] for r in rows}


class TemplateIndex:
    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], threshold: float):
        self.templates = []
        self.prefixes: dict[bytes, list[int]] = {}  # word: the templates that have it in their prefix
        for k, (label, text) in enumerate(templates):
            words = sorted(set(text.split()), key=lambda w: (counts[w], w))
            need = ceil(threshold * len(words) - 1e-9)
            span = ceil(len(text.split()) / threshold - 1e-9)
            self.templates.append((label, [w.encode() for w in words], need, span))
            for w in words[: len(words) - need + 1]:
                self.prefixes.setdefault(w.encode(), []).append(k)
        self.first = frozenset(self.prefixes)

    def blocks(self, words: list[bytes]) -> list[dict]:
        """The stretches of words that meet a template, by first word."""
        places: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for k in self.prefixes.get(w, ()):
                places.setdefault(k, []).append(i)
        found = []
        for k, at in places.items():
            label, ordered, need, span = self.templates[k]
            for low, high in around(at, span, len(words)):
                if high - low >= need and reaches(ordered, need, set(words[low:high])):
                    found += [{"first_word": a, "last_word": b, "label": label, "containment": n / len(ordered)} for a, b, n in met(words, low, high, frozenset(ordered), need, span)]
        return sorted(found, key=lambda x: (x["first_word"], x["last_word"], x["label"], -x["containment"]))


def around(places: list[int], span: int, size: int) -> list[tuple[int, int]]:
    """The ranges of words that windows of ``span`` words around these places cover, joined where they touch."""
    out: list[tuple[int, int]] = []
    for p in places:
        low, high = max(0, p - span + 1), min(size, p + span)
        if out and low <= out[-1][1]:
            low = out.pop()[0]
        out.append((low, high))
    return out


def reaches(ordered: list[bytes], need: int, have: set[bytes]) -> bool:
    """Whether ``need`` of the words, taken rarest first, are there; stops where those to come cannot make up for it."""
    missing = len(ordered) - need
    for w in ordered:
        if w not in have:
            missing -= 1
            if missing < 0:
                return False
    return True


def met(words: list[bytes], low: int, high: int, template: frozenset[bytes], need: int, span: int) -> list[tuple[int, int, int]]:
    """(first word, last word, template words) of the windows that hold ``need`` template words; overlapping ones are one.

    A window that starts at another word holds no more than the one from the next template word.
    """
    places = [i for i in range(low, high) if words[i] in template]
    out: list[tuple[int, int, int]] = []
    inside: Counter[bytes] = Counter()
    stop = 0
    for start in places:
        while stop < len(places) and places[stop] < start + span:
            inside[words[places[stop]]] += 1
            stop += 1
        if len(inside) >= need:
            block = (start, places[stop - 1], len(inside))
            if out and start <= out[-1][1]:
                first, last, n = out.pop()
                block = (first, max(last, block[1]), max(n, block[2]))
            out.append(block)
        inside[words[start]] -= 1
        if not inside[words[start]]:
            del inside[words[start]]
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``blocks``: first and last word, label and containment."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    counts = document_frequencies(docs, {w for _, t in templates for w in t.split()})
    index = TemplateIndex(templates, counts, threshold)
    spaced = [(f" {p} ".encode(), label) for p, label in phrases.items()]

    def make():
        def one(text: bytes) -> tuple:
            words = text.translate(PLAIN_WORDS).split()
            joined = b" %s " % b" ".join(words)
            starts, base = [], set()
            for phrase, label in spaced:
                at = joined.find(phrase)
                while at >= 0:
                    starts.append(joined.count(b" ", 0, at))
                    base.add(label)
                    at = joined.find(phrase, at + 1)
            blocks = [] if index.first.isdisjoint(words) else index.blocks(words)
            labels = base | {x["label"] for x in blocks}
            score = 1.0 if base else max((x["containment"] for x in blocks), default=0.0)
            return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks

        def run(batch, values):
            cols = zip(*(one(x or b"") for x in values), strict=True)
            return dict(zip(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"), map(list, cols), strict=True)) | {"doc_id": batch.column("doc_id")}

        return run

    return map_texts(
        texts(docs),
        make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<first_word: long, last_word: long, label: string, containment: double>>",
    )
