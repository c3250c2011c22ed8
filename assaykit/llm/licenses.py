"""License scans by template-markup matching.

A template is license wording in which ``<<optional>> ... <<end>>`` may be left out,
``<<var max=N>>`` stands for 0 to N words of any kind and ``<<one a|b|c>>`` for exactly one of
the listed words. Templates compile to position automata over words; a text is accepted at a
place when the mandatory wording stands there exactly, word by word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alnum_words, map_batches, text_frame

#: Phrases whose consecutive words carry a base label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_WARRANTY = """
the software is provided as is without warranty of any kind express or implied including but not limited to
the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
authors or copyright holders be liable for any claim damages or other liability whether in an action of contract
tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
"""
_BSD_HEAD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright
notice this list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form
must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution
"""
_BSD_TAIL = """
this software is provided by <<var max=12>> as is and any express or implied warranties including but not limited
to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
"""
_GRANT = "<<optional>> this work is <<end>> <<one licensed|released|distributed|available>> under <<optional>> the terms of <<end>>"

#: Label and template of public licenses and of the notices that name them.
TEMPLATES = [
    ("mit", f"{_GRANT} the <<optional>> expat <<end>> mit license"),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all
        copies or substantial portions of the software """ + _WARRANTY,
    ),
    (
        "isc",
        """permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or
        without fee is hereby granted provided that the above copyright notice and this permission notice appear in
        all copies""",
    ),
    ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL),
    (
        "bsd-3-clause",
        _BSD_HEAD
        + """<<optional>> 3 <<end>> neither the name of <<var max=12>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission """
        + _BSD_TAIL,
    ),
    ("apache-2.0", f"{_GRANT} the apache license <<optional>> version <<end>> 2 0 <<optional>> the license <<end>>"),
    ("gpl-2.0", f"{_GRANT} the gnu general public license <<optional>> version <<end>> <<one 2|v2>> <<optional>> or later <<end>>"),
    ("gpl-3.0", f"{_GRANT} the gnu general public license <<optional>> version <<end>> <<one 3|v3>> <<optional>> or later <<end>>"),
    (
        "gpl-3.0",
        """<<one this|the>> program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 3 of the license or
        <<optional>> at your option <<end>> any later version""",
    ),
    ("cc-by-4.0", f"{_GRANT} <<optional>> a <<end>> cc by 4 0"),
    ("cc-by-sa-4.0", f"{_GRANT} <<optional>> a <<end>> cc by sa 4 0"),
    ("cc-by-nc-4.0", f"{_GRANT} <<optional>> a <<end>> cc by nc 4 0"),
    ("cc0-1.0", f"{_GRANT} <<optional>> the <<end>> cc0 <<optional>> 1 0 <<end>> <<optional>> universal <<end>>"),
]


def parse(markup: str) -> list[tuple]:
    """Markup to nodes ``("word", {words})``, ``("any", most)`` and ``("optional", nodes)``."""
    stack: list[list[tuple]] = [[]]
    for mark, plain in re.findall(r"<<(.*?)>>|([^<]+)", markup, re.S):
        if mark == "optional":
            stack.append([])
        elif mark == "end":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif mark.startswith("var max="):
            stack[-1].append(("any", int(mark[8:])))
        elif mark.startswith("one "):
            stack[-1].append(("word", frozenset(w.strip().encode() for w in mark[4:].split("|"))))
        elif mark:
            raise ValueError(f"unknown mark: {mark}")
        else:
            stack[-1] += [("word", frozenset([w])) for w in alnum_words(plain.encode())]
    if len(stack) != 1:
        raise ValueError("an optional region isn't closed")
    return stack[0]


@dataclass
class Automaton:
    """Positions that each read one word; ``follow[p]`` are the positions that may read the next word."""

    label: str
    reads: list[frozenset | None] = field(default_factory=list)
    follow: list[set[int]] = field(default_factory=list)
    first: set[int] = field(default_factory=set)
    last: set[int] = field(default_factory=set)
    needs: frozenset = frozenset()

    def starts(self) -> set[bytes]:
        return set().union(*(self.reads[p] for p in self.first))

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted stretch of words from ``at``, or -1."""
        now, end, reads = self.first, -1, self.reads
        for i in range(at, len(words)):
            w = words[i]
            hit = [p for p in now if reads[p] is None or w in reads[p]]
            if not hit:
                break
            if not self.last.isdisjoint(hit):
                end = i + 1
            now = set().union(*(self.follow[p] for p in hit))
        return end


def compile_template(label: str, markup: str) -> Automaton:
    a = Automaton(label)

    def add(reads) -> int:
        a.reads.append(reads)
        a.follow.append(set())
        return len(a.reads) - 1

    def chain(nodes: list[tuple], before: set[int], at_start: bool) -> tuple[set[int], bool]:
        """Append nodes after the positions ``before``; at_start: nothing may have been read yet."""
        for kind, what in nodes:
            if kind == "optional":
                out, still = chain(what, before, at_start)
                before, at_start = before | out, at_start or still
                continue
            steps = [what] if kind == "word" else [None] * what
            ends = set() if kind == "word" else set(before)
            begun = at_start
            for reads in steps:
                p = add(reads)
                for q in before:
                    a.follow[q].add(p)
                if begun:
                    a.first.add(p)
                before, begun = {p}, False
                ends.add(p)
            before, at_start = ends, at_start and kind != "word"
        return before, at_start

    nodes = parse(markup)
    a.last, empty = chain(nodes, set(), True)
    if empty or any(a.reads[p] is None for p in a.first):
        raise ValueError("a template starts with a word, or an optional region of words, and isn't all optional")
    a.needs = frozenset(w for kind, what in nodes if kind == "word" and len(what) == 1 for w in what)
    return a


def find_phrases(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand consecutively."""
    return [
        (i, label)
        for want, label in phrases
        for i, w in enumerate(words)
        if w == want[0] and words[i : i + len(want)] == want
    ]


def scan_licenses(docs: DataFrame, templates=None, phrases=None) -> DataFrame:
    """One row per row of ``docs``: words, base phrases and templates found in the whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    matches (label, start and end word of each longest template match, by place).
    score: 1 when a template accepts a stretch, 0.5 when only a base phrase stands there, else 0.
    Null and empty texts have no words, empty labels and score 0. doc_id may be null or repeated;
    each row is scanned by itself, other columns are ignored, an empty table gives no rows.
    No shuffle: the templates are a fixed list of the caller, so they travel with the tasks.
    """
    automata = [compile_template(*t) for t in (TEMPLATES if templates is None else templates)]
    base = [(p.encode().split(), label) for p, label in (BASE_PHRASES if phrases is None else phrases).items()]
    marks = [want[-1] for want, _ in base]

    def scan(words: list[bytes]) -> tuple:
        seen = set(words)
        at = find_phrases(words, [x for x, m in zip(base, marks) if m in seen])
        found = []
        for a in automata:
            if a.needs <= seen:
                begin, i = a.starts(), 0
                while i < len(words):
                    end = a.longest(words, i) if words[i] in begin else -1
                    if end > 0:
                        found.append({"label": a.label, "start": i, "end": end})
                    i = max(i + 1, end)
        places = [i for i, _ in at]
        labels = {label for _, label in at}
        every = labels | {m["label"] for m in found}
        found.sort(key=lambda m: (m["start"], m["label"]))
        return (
            len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(every)), 1.0 if found else 0.5 if at else 0.0, found,
        )

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def run(batches):
        for b in batches:
            rows = [scan(alnum_words(t)) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate([*kinds, match])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    frame = text_frame(docs)
    return map_batches(
        frame, run,
        f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, "
        "last_word long, base_labels string, labels string, score double, "
        "matches array<struct<label:string,start:long,end:long>>",
    )
