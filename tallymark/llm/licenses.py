"""License scans: template markup compiled to token automata, and phrase counts.

A template is a text with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>`` may be missing from a text (it may
be nested), and ``<<var;words=1-4>>`` stands for so many words of any kind. The rest is mandatory wording. A template
is compiled to an automaton over words: each position is a word or any word, optional and replaceable parts add jumps
ahead. A place in a text is accepted if a run of consecutive words from there leads to the automaton's end, so the
mandatory wording matches word for word, in order, with nothing between. Case (A-Z) and punctuation do not matter.

The automaton is started only at words that can begin a template, found for a whole batch at once by their hashes and
then compared as text.

Defined cases: a null or empty text has no words, no labels and a null first and last place; places are counted with
overlaps; repeated rows are scanned each; an empty table gives an empty table; other columns are not read. ``score`` is
1 where a template is accepted, 0.5 where only a base phrase stands, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import LETTERED, Words, slices

# Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0-notice": (
        "Licensed under the Apache License<<beginOptional>>, Version 2.0<<endOptional>>"
        "<<beginOptional>> (the \"License\"); you may not use <<var;words=1-3>> except in compliance with the License"
        "<<endOptional>>"),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met"),
    "cc-notice": (
        "<<beginOptional>>This <<var;words=1-3>> is <<endOptional>>licensed under <<beginOptional>>a <<endOptional>>"
        "<<beginOptional>>the <<endOptional>>"
        "<<beginOptional>>Creative Commons Attribution<<endOptional>><<beginOptional>>CC BY<<endOptional>>"
        "<<beginOptional>>-<<var;words=1-2>><<endOptional>> 4.0<<beginOptional>> International<<endOptional>>"),
    "copyright-notice": "Copyright <<beginOptional>>(c) <<endOptional>><<var;words=1-6>> All rights reserved",
    "gpl-notice": (
        "<<beginOptional>>This <<var;words=1-3>> is <<endOptional>>licensed under the <<beginOptional>>terms of the "
        "<<endOptional>>GNU General Public License<<beginOptional>>, version <<var;words=1-1>><<endOptional>>"),
    "gpl-program-notice": (
        "you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser <<endOptional>>General "
        "Public License as published by the Free Software Foundation"),
    "isc-notice": (
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with"
        " or without fee is hereby granted"),
    "mit-notice": "Released under the MIT License",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction"),
}
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")
ANY = None


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(_LOWER))


class Automaton:
    """Positions 0..n: ``token[i]`` leads from i to i + 1, ``jumps[i]`` are places reached from i without a word."""

    def __init__(self, template: str):
        self.token: list[bytes | None] = []
        self.jumps: dict[int, set[int]] = {}
        open_at: list[int] = []
        at = 0
        for mark in [*_MARK.finditer(template), None]:
            self.token += _words(template[at: mark.start() if mark else len(template)])
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                open_at.append(len(self.token))
            elif mark[1] == "endOptional":
                if not open_at:
                    raise ValueError("endOptional without beginOptional")
                self.jumps.setdefault(open_at.pop(), set()).add(len(self.token))
            else:
                least, most = int(mark[2]), int(mark[3])
                start = len(self.token)
                self.token += [ANY] * most
                for k in range(least, most):
                    self.jumps.setdefault(start + k, set()).add(start + most)
        if open_at:
            raise ValueError("beginOptional without endOptional")
        self.end = len(self.token)
        if self.end in self.closure({0}):
            raise ValueError("a template needs mandatory wording")
        self.start = self.closure({0})
        self.first = {self.token[i] for i in self.start if i < self.end}
        if ANY in self.first:
            raise ValueError("a template must not begin with a replaceable part")

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for j in self.jumps.get(todo.pop(), ()):
                if j not in out:
                    out.add(j)
                    todo.append(j)
        return out

    def length_at(self, words, start: int, stop: int) -> int:
        """Length of the longest accepted run from ``start``; 0 if none. ``words`` gives the word at a place."""
        states, best = self.start, 0
        for at in range(start, stop):
            word = words(at)
            states = self.closure({i + 1 for i in states if i < self.end and self.token[i] in (ANY, word)})
            if not states:
                break
            if self.end in states:
                best = at - start + 1
        return best


def _hashes(words: list[bytes]) -> np.ndarray:
    texts = pa.array([w.decode() for w in words], pa.large_string())
    return Words(texts, LETTERED).hashes()


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases = [(_words(p), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t)) for label, t in sorted(templates.items())]
        starts = sorted({w for _, a in self.automata for w in a.first} | {p[0] for p, _ in self.phrases})
        self.starts = np.sort(_hashes(starts))

    def rows(self, texts: pa.Array) -> Iterator[dict]:
        for start, stop in slices(texts):
            batch = Words(texts[start:stop], LETTERED)
            hashes = batch.hashes()
            place = np.minimum(np.searchsorted(self.starts, hashes), len(self.starts) - 1)
            begins = np.flatnonzero(self.starts[place] == hashes) if len(hashes) else np.zeros(0, np.int64)
            cuts = np.searchsorted(begins, batch.first)
            for row in range(stop - start):
                low, high = int(batch.first[row]), int(batch.first[row + 1])
                yield self._row(batch.word, low, high, begins[cuts[row]: cuts[row + 1]].tolist())

    def _row(self, word, low: int, high: int, begins: list[int]) -> dict:
        places, base, spans = [], set(), []
        for at in begins:
            first = word(at)
            for phrase, label in self.phrases:
                if first == phrase[0] and at + len(phrase) <= high and all(word(at + k) == w for k, w in enumerate(phrase)):
                    places.append(at - low)
                    base.add(label)
            for label, automaton in self.automata:
                if first in automaton.first and (n := automaton.length_at(word, at, high)):
                    spans.append({"label": label, "first": at - low, "words": n})
        labels = sorted(base | {s["label"] for s in spans})
        return {
            "n_words": high - low, "n_base": len(places), "first_word": min(places, default=None),
            "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(labels),
            "score": 1.0 if spans else 0.5 if places else 0.0, "spans": spans,
        }


def scanned(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """``doc_id`` and what was found in each text; ``spans`` lists each accepted template with first word and length."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (
        f"doc_id {dict(source.dtypes)['doc_id']}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,words:bigint>>")
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
    kinds = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
        "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = list(scanner.rows(batch.column(1)))
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *kinds])

    return source.mapInArrow(task, schema)
