"""License scan by template markup.

A template is a text with optional regions ``[[...]]`` and replaceable regions ``{{n}}`` (up to n words of any kind). Each is
compiled into a token automaton. A text matches where the mandatory words stand exactly, with
each optional region whole or absent and each replaceable one filled with at most its words. Matching starts only at places where a
template's first two mandatory words stand together; these, and the places of the base phrases, are found by word hashes over whole
columns, and checked on the words themselves.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. The score is 1 where a template accepts, else the
largest share of a template's mandatory words that stands in order from a start, at least 0.5 where a base phrase stands.

A null text is empty: no words, no labels, score 0. Null or repeated ids keep a row each. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbwise.llm.words import MARKS, hash_of, hashes, slices, utf8, words

# The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Wordings of public license notices, by label. Words as above, lower case.
TEMPLATES = (
    ("gpl-notice", "licensed under [[the terms of]] the gnu general public license [[version {{2}}]]"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("cc-by-notice", "licensed under [[a]] [[creative commons]] cc by [[nc]] [[sa]] [[nd]] [[4 0]] [[3 0]]"),
    ("gpl-3.0-header", (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version {{1}} of the license or [[at your option]] any later version"
    )),
    ("apache-2.0-header", (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " [[you may obtain a copy of the license at {{8}}]]"
    )),
    ("mit", (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    )),
    ("bsd", (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met"
    )),
)

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_SLICE_BYTES = 4 << 20


class Automaton:
    """States of one template: per state the word it takes, any word, or moves without a word."""

    def __init__(self, markup: str):
        self.words: dict[int, tuple[str, int]] = {}
        self.any: dict[int, int] = {}
        self.free: dict[int, list[int]] = {}
        self.mandatory: list[str] = []
        self.passed: dict[int, int] = {0: 0}  # mandatory words taken on reaching a state
        self.states, state, opened = 1, 0, []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
            if part == "[[":
                opened.append(state)
                continue
            if part == "]]":
                self.free.setdefault(opened.pop(), []).append(state)
                continue
            if part.startswith("{{"):
                ends = [state]
                for _ in range(int(part[2:-2])):
                    state = self._next(state)
                    self.any[ends[-1]] = state
                    ends.append(state)
                for s in ends[:-1]:
                    self.free.setdefault(s, []).append(state)
                continue
            target = self._next(state)
            self.words[state] = (part, target)
            if not opened:
                self.mandatory.append(part)
                self.passed[target] = len(self.mandatory)
            state = target
        self.final = state

    def _next(self, state: int) -> int:
        self.states += 1
        self.passed[self.states - 1] = self.passed[state]
        return self.states - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def run(self, tokens: Iterator[str]) -> tuple[bool, float]:
        """Whether the tokens begin with the template, and the share of its mandatory words taken."""
        states, best = self._closed({0}), 0
        for token in tokens:
            if self.final in states:
                return True, 1.0
            step = {self.words[s][1] for s in states if s in self.words and self.words[s][0] == token}
            step |= {self.any[s] for s in states if s in self.any}
            if not step:
                break
            states = self._closed(step)
            best = max(best, *(self.passed[s] for s in states))
        accepted = self.final in states
        return accepted, 1.0 if accepted else best / len(self.mandatory)


@lru_cache(maxsize=8)
def _compiled(templates: tuple):
    """Automata by the hashes of their first two mandatory words (which begin the template)."""
    out: dict[tuple[int, int], list[tuple[str, Automaton]]] = {}
    for label, markup in templates:
        automaton = Automaton(markup)
        if markup.split()[:2] != automaton.mandatory[:2]:
            raise ValueError(f"template {label} has to begin with two mandatory words")
        key = tuple(int(hash_of(w)) for w in automaton.mandatory[:2])
        out.setdefault(key, []).append((label, automaton))
    return out


def _places(found: np.ndarray, phrase: list[int], row: np.ndarray) -> np.ndarray:
    """Word numbers where the hashes of a phrase stand in one row."""
    if len(found) < len(phrase):
        return np.zeros(0, np.int64)
    n = len(found) - len(phrase) + 1
    hit = row[:n] == row[len(phrase) - 1:]
    for j, h in enumerate(phrase):
        hit &= found[j:j + n] == np.uint64(h)
    return np.flatnonzero(hit)


def scan_rows(column, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> dict[str, list]:
    """The result columns of a text column, without the ids."""
    out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")[1:]}
    automata = _compiled(templates)
    for a, b in slices(len(column), np.diff(utf8(column)[1]), _SLICE_BYTES):
        data, offsets = utf8(column.slice(a, b - a))
        starts, ends, word_offsets = words(data, offsets, MARKS_LOWER)
        found = hashes(data, starts, ends)
        row = np.repeat(np.arange(b - a), np.diff(word_offsets))
        raw = data.tobytes()
        word = lambda i: raw[starts[i]:ends[i]].decode().translate(_LOWER)
        base: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in phrases:
            parts = phrase.split()
            for i in _places(found, [int(hash_of(w)) for w in parts], row).tolist():
                if [word(i + j) for j in range(len(parts))] == parts:
                    base.setdefault(int(row[i]), []).append((i - int(word_offsets[row[i]]), label))
        labels: dict[int, set[str]] = {}
        score: dict[int, float] = {}
        for key, candidates in automata.items():
            for i in _places(found, list(key), row).tolist():
                r = int(row[i])
                last = int(word_offsets[r + 1])
                for label, automaton in candidates:
                    accepted, share = automaton.run(word(j) for j in range(i, last))
                    score[r] = max(score.get(r, 0.0), share)
                    if accepted:
                        labels.setdefault(r, set()).add(label)
        for r, n in enumerate(np.diff(word_offsets).tolist()):
            places = base.get(r, [])
            own = {label for _, label in places}
            at = [i for i, _ in places]
            out["n_words"].append(n)
            out["n_base"].append(len(places))
            out["first_word"].append(min(at) if at else None)
            out["last_word"].append(max(at) if at else None)
            out["base_labels"].append(",".join(sorted(own)))
            out["labels"].append(",".join(sorted(own | labels.get(r, set()))))
            out["score"].append(max(score.get(r, 0.0), 0.5 if places else 0.0))
    return out


#: Upper-case letters are word characters before they are lower-cased.
MARKS_LOWER = MARKS.copy()
MARKS_LOWER[0x41:0x5B] = False
_LOWER = {i: i + 32 for i in range(0x41, 0x5B)}


def scan(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """One row a document; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string()}
        for batch in batches:
            found = scan_rows(batch.column("text"), phrases, templates)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    **{c: pa.array(v, kinds.get(c, pa.int64())) for c, v in found.items()},
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
