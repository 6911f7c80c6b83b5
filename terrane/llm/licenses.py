"""License scans: template markup compiled into token automata.

A template is license wording in which `[[ ... ]]` is optional (and may nest) and `<<name:2-5>>` is replaceable by two to
five tokens of any kind; all other wording is mandatory and must match word for word. A template compiles into a
nondeterministic automaton over tokens. The automata of all templates run as one, determinised state by state as texts ask for
it, from every place whose word can begin a template. Phrases are templates without markup. A text whose
mandatory wording was altered anywhere is not that license: at most its opening clause is found, as a notice.

Defined results: null text counts as empty; without a match places are null, labels empty strings and the score 0; repeated
keys are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.common import sliced, text_of

_BLANKS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Base phrases and their labels (fixed values).
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Whole public license texts (fixed values), as templates: what may vary is the holder's name and how conditions are numbered.
MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<holder:1-8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_CLAUSE = "[[3]] neither the name of <<holder:1-8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_DISCLAIMED = "this software is provided by the <<holder:1-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the <<holder:1-8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<holder:1-6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<holder:1-6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
#: Public license wording (fixed values), as templates. A label that ends in `-notice` is an opening clause or a mark, not a license.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license [[version]] 2 0 [[the license [[you may not use this file except in compliance with the license]]]]"),
    ("bsd-2-clause", f"{_BSD} {_DISCLAIMED}"),
    ("bsd-3-clause", f"{_BSD} {_CLAUSE} {_DISCLAIMED}"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]"),
    ("cc-by-nc", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[<<share:0-1>> <<major:1-1>> 0]]"),
    ("cc-by-x.0", "licensed under [[a]] [[the]] [[creative commons]] cc by <<major:1-1>> 0"),
    ("cc0", "[[this work is]] released under [[the]] cc0 <<major:0-1>> [[0]] [[universal]]"),
    ("gpl-3.0", "[[this <<kind:1-2>> is]] licensed under the gnu general public license version 3"),
    ("gpl-or-later", "free software you can redistribute it and or modify it under the terms of the gnu <<kind:0-1>> general public license as published by the free software foundation"),
    ("isc", ISC),
    ("mit", MIT),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in <<the:1-2>> without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved-notice", "copyright [[c]] <<holder:1-8>> all rights reserved"),
)
_MARK = re.compile(r"\[\[|\]\]|<<[a-z]+:(\d+)-(\d+)>>|[^\s\[\]<>]+")


def parsed(template: str) -> list:
    """A tree: words, (least, most) for replaceable regions, lists for optional ones."""
    stack: list[list] = [[]]
    for m in _MARK.finditer(template):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            region = stack.pop()
            if not stack:
                raise ValueError(f"an optional region ends before it begins: {template!r}")
            stack[-1].append(region)
        else:
            stack[-1].append((int(m[1]), int(m[2])) if m[1] else m[0])
    if len(stack) > 1:
        raise ValueError(f"an optional region does not end: {template!r}")
    return stack[0]


def as_regex(tree: list) -> str:
    """The same language over words joined by single blanks, each with a blank before it."""
    out = ""
    for x in tree:
        out += f"(?:{as_regex(x)})?" if isinstance(x, list) else f"(?: [^ ]+){{{x[0]},{x[1]}}}" if isinstance(x, tuple) else f" {x}"
    return out


class Automaton:
    """All templates as one automaton over words; `places` runs it from every word that can begin one."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.ends: dict[int, int] = {}
        for k, (_, template) in enumerate(templates):
            at = self._new()
            self.free[0].append(at)
            self.ends[self._chain(at, parsed(template))] = k
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[bytes | None, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.words = {w for arcs in self.arcs for w, _ in arcs if w is not None}
        self.start = self._state(self._closed({0}))
        self.first = {w for s in self.sets[self.start] for w, _ in self.arcs[s] if w is not None}

    def _new(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _chain(self, at: int, tree: list) -> int:
        for x in tree:
            if isinstance(x, list):
                end, after = self._chain(at, x), self._new()
                self.free[end].append(after)
                self.free[at].append(after)
                at = after
            elif isinstance(x, tuple):
                end = self._new()
                for k in range(x[1]):
                    if k >= x[0]:
                        self.free[at].append(end)
                    nxt = self._new()
                    self.arcs[at].append((None, nxt))
                    at = nxt
                self.free[at].append(end)
                at = end
            else:
                nxt = self._new()
                self.arcs[at].append((x.encode(), nxt))
                at = nxt
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def _state(self, states: frozenset) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.accepts.append(tuple(sorted({self.ends[s] for s in states if s in self.ends})))
        return self.number[states]

    def _move(self, state: int, word: bytes | None) -> int:
        target = self._closed({t for s in self.sets[state] for w, t in self.arcs[s] if w is None or w == word})
        n = self.moves[state][word] = self._state(target) if target else -1
        return n

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) of every place where a template's wording stands, once each."""
        if self.first.isdisjoint(words):
            return []
        found, first, known, moves, accepts = [], self.first, self.words, self.moves, self.accepts
        for start in [i for i, w in enumerate(words) if w in first]:
            state, hits, at = self.start, set(), start
            while at < len(words):
                w = words[at]
                w = w if w in known else None
                nxt = moves[state].get(w)
                state = self._move(state, w) if nxt is None else nxt
                if state < 0:
                    break
                hits.update(accepts[state])
                at += 1
            found += [(k, start) for k in sorted(hits)]
        return found


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters a to z and non-ASCII characters, after lower-casing A to Z."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split()


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the places (label, start) of every row.

    The score is 1 where a license's whole wording or a statement that names it stands, 0.75 where only a notice does, 0.5 where a base phrase alone does, else 0.
    """
    n_base = len(phrases)
    label = [k for k, _ in (*phrases, *templates)]
    whole_text = {k for k, name in enumerate(label) if k >= n_base and not name.endswith("-notice")}
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton((*phrases, *templates))
        for whole in batches:
            for b in sliced(whole, 1):
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = words_of(t)
                    found = automaton.places(words)
                    base = [s for k, s in found if k < n_base]
                    own = {label[k] for k, _ in found if k < n_base}
                    score = 1.0 if any(k in whole_text for k, _ in found) else 0.75 if len(base) < len(found) else 0.5 if base else 0.0
                    rows.append((i, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(own)), ",".join(sorted({label[k] for k, _ in found})), score, [{"label": label[k], "start": s} for k, s in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    read = df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("text"))
    return read.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long>>")


def sql(phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> str:
    """The scan as DuckDB SQL over `documents`: places by list positions, wording by regular expressions over joined words."""
    starts = []
    for name, phrase in phrases:
        match = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        starts.append(f"list_transform(list_filter(range(0, len(w)), lambda i: {match}), lambda i: {{'l': '{name}', 's': i}})")
    wording = ", ".join(f"CASE WHEN regexp_matches(j, '{as_regex(parsed(t))} ') THEN '{name}' END" for name, t in templates)
    joined = "coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest({}) AS x) WHERE x IS NOT NULL), '')"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, list_concat(list_concat({starts[0]}, {starts[1]}), {starts[2]}) AS b FROM t),
q AS (SELECT doc_id, w, list_transform(b, lambda x: x.s) AS s, list_distinct(list_transform(b, lambda x: x.l)) AS bl, list_filter([{wording}], lambda x: x IS NOT NULL) AS tl FROM p)
SELECT doc_id, len(w) AS n_words, len(s) AS n_base, list_min(s) AS first_word, list_max(s) AS last_word,
       {joined.format("bl")} AS base_labels, {joined.format("list_concat(bl, tl)")} AS labels,
       CASE WHEN len(list_filter(tl, lambda x: NOT ends_with(x, '-notice'))) > 0 THEN 1.0 WHEN len(tl) > 0 THEN 0.75 WHEN len(s) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM q
"""
