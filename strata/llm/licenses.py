"""License scans: template markup compiled to token automata.

Templates use the public license-template markup: text outside tags is mandatory, `<<beginOptional>>...<<endOptional>>`
may be absent, and `<<var;match=N-M>>` stands for any N to M words. Case and punctuation never count, because
templates and texts are cut into the same words. A template accepts a run of words if every mandatory word stands there
in order and only optional or replaceable regions differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import ALNUM, LOWER, bytes_of, ship_package, slices, word_spans

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices as templates, label first.
TEMPLATES = [
    ("mit", "<<beginOptional>>released <<endOptional>><<beginOptional>>licensed <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>mit license"),
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files<<beginOptional>> the software<<endOptional>> to deal in the software without restriction"),
    ("apache-2-notice", "licensed under the apache license version 2 0<<beginOptional>> the license<<endOptional>>"),
    ("apache-2-terms", "you may not use this file except in compliance with the license"),
    ("cc-by-nc-4", "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>creative commons <<endOptional>>cc by nc <<beginOptional>>license <<endOptional>>4 0"),
    ("cc-by", "licensed under <<beginOptional>>a <<endOptional>>creative commons attribution<<var;match=0-2>> <<beginOptional>>4 0 <<endOptional>>international license"),
    ("gpl-3", "licensed under the <<beginOptional>>terms of the <<endOptional>>gnu general public license<<beginOptional>> as published by the free software foundation<<endOptional>><<beginOptional>> either<<endOptional>> version 3<<beginOptional>> of the license<<endOptional>>"),
    ("gpl-2", "under the terms of the gnu general public license<<beginOptional>> as published by the free software foundation<<endOptional>><<beginOptional>> either<<endOptional>> version 2<<beginOptional>> of the license<<endOptional>>"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "<<beginOptional>>copyright <<var;match=1-8>> <<endOptional>>all rights reserved"),
]

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().translate(bytes(LOWER)))


def parse(template: str) -> list:
    """Markup as nested lists: words, ("opt", items) and ("var", least, most)."""
    stack: list[list] = [[]]
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<beginOptional>>":
            stack.append([])
        elif part == "<<endOptional>>":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            group = stack.pop()
            stack[-1].append(("opt", group))
        elif part.startswith("<<var"):
            m = re.search(r"match=(\d+)-(\d+)", part)
            stack[-1].append(("var", int(m[1]), int(m[2])) if m else ("var", 0, 16))
        elif part.startswith("<<"):
            raise ValueError(f"unknown tag {part}")
        else:
            stack[-1].extend(words_of(part))
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


ANY = None


@dataclass
class Automaton:
    """Deterministic by lazy subset construction; states are sets of positions in a nondeterministic one."""

    label: str
    edges: list[list[tuple[bytes | None, int]]]
    skips: list[list[int]]
    final: int
    mandatory: int

    def __post_init__(self) -> None:
        self.start = self.close({0})
        self.memo: dict = {}

    def close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        known = word if any(w == word for s in state for w, _ in self.edges[s]) else ANY
        if (key := (state, known)) not in self.memo:
            self.memo[key] = self.close({to for s in state for w, to in self.edges[s] if w is ANY or w == word})
        return self.memo[key]

    def first_words(self) -> set[bytes]:
        return {w for s in self.start for w, _ in self.edges[s]}

    def match(self, words: list[bytes], at: int) -> int:
        """Length of the longest accepted run that begins at a word; 0 if none."""
        state, best = self.start, 0
        for k in range(at, len(words)):
            state = self.step(state, words[k])
            if not state:
                break
            if self.final in state:
                best = k + 1 - at
        return best


def compile_template(label: str, template: str) -> Automaton:
    edges: list[list] = [[]]
    skips: list[list] = [[]]

    def new() -> int:
        edges.append([])
        skips.append([])
        return len(edges) - 1

    def build(items: list, at: int) -> int:
        for item in items:
            if isinstance(item, bytes):
                edges[at].append((item, to := new()))
                at = to
            elif item[0] == "opt":
                end = build(item[1], at)
                skips[end].append(to := new())
                skips[at].append(to)
                at = to
            else:
                _, least, most = item
                for k in range(most):
                    edges[at].append((ANY, to := new()))
                    if k >= least:
                        skips[at].append(to)
                    at = to
        return at

    items = parse(template)
    mandatory = sum(isinstance(x, bytes) for x in items)
    if not mandatory:
        raise ValueError("a template needs mandatory words")
    end = build(items, 0)
    out = Automaton(label, edges, skips, end, mandatory)
    if ANY in out.first_words():
        raise ValueError("a template begins with a word of its own")
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]) -> None:
        self.phrases = [(p.encode().split(b" "), label) for p, label in phrases.items()]
        self.automata = [compile_template(*t) for t in templates]
        self.by_first: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.first_words():
                self.by_first.setdefault(w, []).append(a)
        # any accepted run holds one of these: a whole phrase, or a template's longest mandatory word
        gap = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        anchors = {max((x for x in parse(t) if isinstance(x, bytes)), key=len) for _, t in templates}
        shortest = {a for a in anchors if not any(b != a and b in a for b in anchors)}
        self.pattern = re.compile(b"|".join([gap.join(map(re.escape, p)) for p, _ in self.phrases] + [re.escape(a) for a in sorted(shortest)]))

    def scan(self, lowered: bytes) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """n_base, first and last place, base labels, all labels, score of a lower-cased text that holds an anchor."""
        words = WORD.findall(lowered)
        places: list[int] = []
        base: set[str] = set()
        found: set[str] = set()
        first_of: dict[bytes, list] = {}
        for phrase, label in self.phrases:
            first_of.setdefault(phrase[0], []).append((phrase, label))
        for i, w in enumerate(words):
            for phrase, label in first_of.get(w, ()):
                if words[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
            for a in self.by_first.get(w, ()):
                if a.label not in found and a.match(words, i):
                    found.add(a.label)
        every = base | found
        score = len(every) / (len(every) + 1)
        return len(places), min(places, default=None), max(places, default=None), base, every, score


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: words, places of base phrases, base labels, all labels, score.

    A NULL or empty text has no words, no labels and score 0. A NULL id is kept. Repeated rows give repeated rows.
    Other columns of docs, whatever their names, are not read. score is k / (k + 1) for k labels. Texts stream through one pass; nothing is shuffled.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    Scanner(phrases, templates)
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in slices(batches, "text"):
            raw, offsets = bytes_of(batch.column(1))
            data = LOWER[raw]
            _, _, first = word_spans(data, offsets, ALNUM)
            n = len(offsets) - 1
            n_base, lo, hi, base, labels, score = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n
            whole = data.tobytes()
            ends = offsets[1:]
            at = -1
            hits: list[int] = []
            for m in scanner.pattern.finditer(whole):
                k = int(np.searchsorted(ends, m.start(), "right"))
                if k != at:
                    hits.append(k)
                    at = k
            for k in hits:
                n_base[k], lo[k], hi[k], b, every, score[k] = scanner.scan(whole[offsets[k] : offsets[k + 1]])
                base[k], labels[k] = ",".join(sorted(b)), ",".join(sorted(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(n_base, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)
