"""License scans by template-markup matching.

A template is licence wording with markup: <<beginOptional>> ... <<endOptional>>
for text that may be absent and <<var;match=".{m,n}">> for m to n replaceable words.
It compiles to an automaton over words; a place is accepted when all mandatory
wording stands there exactly (case and punctuation aside). A document is scanned
by the automaton only where the template's longest mandatory run occurs.

Defined results: null and empty texts have no words and score 0; equal rows give
equal rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEP, LOWER, text_slices, word_bounds

# Fixed values of the query's contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label -> marked-up wording of short notices and permission texts.
TEMPLATES = {
    "mit-notice": '<<beginOptional>>this <<var;match=".{1,4}">> is<<endOptional>> released under the MIT license',
    "mit": 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files<<beginOptional>> (the "Software")<<endOptional>>, to deal in the software without restriction',
    "apache-2.0": 'licensed under the Apache license, version 2.0<<beginOptional>> (the "License")<<endOptional>>',
    "gpl-3.0": '<<beginOptional>>this <<var;match=".{1,4}">> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU general public license, <<beginOptional>>as published by the free software foundation, either<<endOptional>> version 3<<beginOptional>> of the license, or any later version<<endOptional>>',
    "cc-by-4.0": 'licensed under <<beginOptional>>a creative commons attribution<<endOptional>> <<beginOptional>>(CC BY) <<endOptional>>4.0 <<beginOptional>>international<<endOptional>> license',
    "cc-by-notice": 'licensed under <<beginOptional>>the<<endOptional>> cc by <<var;match=".{0,2}">> <<beginOptional>>license<<endOptional>>',
    "isc": 'permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted',
    "bsd": 'redistribution and use in source and binary forms, with or without modification, are permitted',
    "copyright-line": 'copyright <<beginOptional>>(c)<<endOptional>> <<var;match=".{1,8}">> all rights reserved',
}
#: A template's score, and a base phrase's.
TEMPLATE_SCORE, PHRASE_SCORE = 1.0, 0.5
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r'<<(beginOptional|endOptional|var;match="\.\{(\d+),(\d+)\}")>>')


def tokens(text: str | bytes) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text
    return _TOKEN.findall(bytes(LOWER[np.frombuffer(raw, np.uint8)]))


class Template:
    """Automaton of one marked-up wording: states are numbered, edges carry a word (None: any word), skips none."""

    def __init__(self, markup: str) -> None:
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        runs: list[list[bytes]] = [[]]
        opened: list[int] = []
        at = 0
        for part, mark, low, high in self._parts(markup):
            if mark is None:
                for word in tokens(part):
                    self._edge(word)
                    if not opened:
                        runs[-1].append(word)
                continue
            runs.append([])
            if mark == "beginOptional":
                opened.append(len(self.edges) - 1)
            elif mark == "endOptional":
                self.skips[opened.pop()].append(len(self.edges) - 1)
            else:
                first = len(self.edges) - 1
                for i in range(high):
                    self._edge(None)
                # any state with enough words reaches the end of the region
                for i in range(low, high):
                    self.skips[first + i].append(len(self.edges) - 1)
            at += 1
        if opened:
            raise ValueError("beginOptional without endOptional")
        self.end = len(self.edges) - 1
        self.run = max(runs, key=len)
        if not self.run:
            raise ValueError("a template needs mandatory wording")

    @staticmethod
    def _parts(markup: str) -> Iterator[tuple[str, str | None, int, int]]:
        last = 0
        for m in _MARK.finditer(markup):
            yield markup[last : m.start()], None, 0, 0
            yield "", m[1].split(";")[0], int(m[2] or 0), int(m[3] or 0)
            last = m.end()
        yield markup[last:], None, 0, 0

    def _edge(self, word: bytes | None) -> None:
        self.edges.append([])
        self.skips.append([])
        self.edges[-2].append((word, len(self.edges) - 1))

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    @cached_property
    def start(self) -> frozenset[int]:
        return frozenset(self._close({0}))

    def accepts_at(self, words: list[bytes], i: int) -> bool:
        states = set(self.start)
        while states and self.end not in states:
            if i >= len(words):
                return False
            states = self._close({t for s in states for w, t in self.edges[s] if w is None or w == words[i]})
            i += 1
        return self.end in states

    def found_in(self, words: list[bytes]) -> bool:
        firsts = {w for s in self.start for w, _ in self.edges[s]}
        return any((None in firsts or w in firsts) and self.accepts_at(words, i) for i, w in enumerate(words))


def _phrase_regex(words: list[bytes]) -> re.Pattern[bytes]:
    sep, word = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    return re.compile(rb"(?<!" + word + rb")" + sep.join(map(re.escape, words)) + rb"(?!" + word + rb")")


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> one row a document with phrase places, labels of phrases and templates, and a score."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(max(tokens(p), key=len), _phrase_regex(tokens(p)), label) for p, label in phrases.items()]
        autos = [(label, Template(markup)) for label, markup in templates.items()]
        autos = [(label, t, max(t.run, key=len), _phrase_regex(t.run)) for label, t in autos]
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offs in text_slices(batch.column(1)):
                low = LOWER[data]
                starts, _, firsts = word_bounds(low, offs, ALNUM_SEP)
                raw = low.tobytes()
                out: list[tuple] = []
                for r in range(end - first):
                    text = raw[offs[r] : offs[r + 1]]
                    at: list[int] = []
                    found, more = set(), set()
                    for rare, regex, label in base:
                        if rare in text and (hits := [m.start() for m in regex.finditer(text)]):
                            at += hits
                            found.add(label)
                    words = None
                    for label, t, rare, regex in autos:
                        if rare in text and regex.search(text):
                            words = tokens(text) if words is None else words
                            if t.found_in(words):
                                more.add(label)
                    n = int(firsts[r + 1] - firsts[r])
                    place = np.searchsorted(starts, np.array([min(at), max(at)]) + offs[r]) - firsts[r] if at else None
                    out.append((n, len(at), None if place is None else int(place[0]), None if place is None else int(place[1]), ",".join(sorted(found)), ",".join(sorted(found | more)), TEMPLATE_SCORE if more else PHRASE_SCORE if found else 0.0))
                cols = [list(c) for c in zip(*out, strict=True)]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, RESULT)
