"""Licence scans by a generalised suffix automaton of licence templates' tokens.

The tokens of all templates build one suffix automaton. A file's tokens are streamed through it: after each token the state gives the
matching statistic, the length of the longest run ending here that occurs in some template, and, where that is ``MIN_RUN`` at least, the
state of its last ``MIN_RUN`` tokens gives every place of every template that reads on from there. Places that advance together are
runs, so each template's maximal runs are found, also those within a longer run of another.

Runs are chained per template by the best predecessor: a chain goes up in file and template, skips at most ``MAX_GAP`` words of the file
between runs, and counts what overlaps once. A chain that covers ``COVER`` of its template (all of one under ``SHORT`` tokens) is a span of
that licence; of spans of two licences that lie on each other, the one of more words stays. The score is the best cover of a template
by a chain of the file, or 1 where a base phrase stands.

Base phrases are counted apart, wherever their words stand consecutively, so the method adds labels and takes none away.

Covered are MIT, BSD-2 and -3, ISC, zlib, Boost, Unlicense and WTFPL by their whole operative texts; Apache-2, GPL-2 and -3, LGPL, AGPL-3,
MPL-2, EPL-2 and CC0 by their standard headers or opening passages; these and the CC BY family by common notices as well. The bodies
of the long ones are not templates.

Only the tokens in the templates' vocabulary move the automaton, any other resets it, so most of a file costs one look-up a token.
Memory is that of a slice of the file and its runs: texts are read in slices of ``SLICE`` characters, cut between words, and the
automaton, the phrases and the runs carry over.

Cases: null and empty texts have no words, null first and last word, empty labels and score 0; repeated rows give repeated results;
an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lower_az, table

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence "
    "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_MIT_END = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)


def _gnu(name: str, version: str, what: str = "this program") -> str:
    """The header that the GNU licences ask for."""
    return (
        f"{what} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation "
        f"either version {version} of the license or at your option any later version {what} is distributed in the hope that it will be useful but without any warranty "
        f"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details"
    )


#: Licence -> templates, each one of its own: whole texts, standard headers and common notices. The licences' own wording.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _MIT_END,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense",
        "released under the mit license",
        "licensed under the mit license",
        "distributed under the terms of the mit license",
    ),
    "apache-2": (
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2.0",
        "released under the apache license version 2.0",
        "you may not use this file except in compliance with the license",
    ),
    "bsd-2": (_BSD_START + _BSD_END, "licensed under the bsd 2 clause license"),
    "bsd-3": (
        _BSD_START + "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END,
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "licensed under the bsd 3 clause license",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ),
    "bsl-1": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        "distributed under the boost software license version 1.0",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",),
    "gpl-3": (
        _gnu("general public license", "3"),
        "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ),
    "gpl-2": (
        _gnu("general public license", "2"),
        "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software",
        "licensed under the gnu general public license version 2",
        "released under the gnu general public license version 2",
    ),
    "lgpl": (_gnu("lesser general public license", "2.1", "this library"), _gnu("lesser general public license", "3"), "licensed under the gnu lesser general public license"),
    "agpl-3": (_gnu("affero general public license", "3"), "licensed under the gnu affero general public license"),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
        "subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
    ),
    "epl-2": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at",),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "cc-by-nc": ("licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc-by": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"),
}

MIN_RUN = 3
MAX_GAP = 6
COVER, SHORT = 0.8, 10
SLICE = 1 << 18


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(lower_az(text))


class SuffixAutomaton:
    """Generalised: all templates' token strings in one automaton; each state knows all places (template, tokens so far) where it ends."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, string in enumerate(strings):
            last = 0
            for k, token in enumerate(string):
                last = self._extend(last, token)
                self.ends[last].add((number, k + 1))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()

    def suffix(self, state: int, length: int) -> int:
        """The state of the last ``length`` tokens of a state's strings."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.len.append(length)
        self.ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:  # the string so far is already there
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, token)
        new = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, token)
        return new

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """The matching statistic after one more token."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        nxt = self.next[state].get(token)
        return (0, 0) if nxt is None else (nxt, length + 1)


@dataclass
class Span:
    label: str
    first: int
    last: int
    cover: float


class Scanner:
    """The automaton with what turns its runs into spans. One a worker process; holds nothing of a file between files."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [label for label, clauses in templates.items() for _ in clauses]
        texts = [tokens_of(c) for clauses in templates.values() for c in clauses]
        #: 0 is any word of no template or phrase.
        self.number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t} | {w for p in phrases for w in p.split()}), 1)}
        self.sizes = [len(t) for t in texts]
        self.automaton = SuffixAutomaton([[self.number[w] for w in t] for t in texts])
        self.phrases = [([self.number[w] for w in p.split()], label) for p, label in phrases.items()]
        self.by_last: dict[int, list[tuple[list[int], str]]] = {}
        for p, label in self.phrases:
            self.by_last.setdefault(p[-1], []).append((p, label))
        self.longest = max(len(p) for p, _ in self.phrases)
        #: State -> places where its last MIN_RUN tokens end, for states of as many.
        sa = self.automaton
        self.places = [tuple(sorted(sa.ends[sa.suffix(v, MIN_RUN)])) if sa.len[v] >= MIN_RUN else () for v in range(len(sa.len))]
        self.need = [n if n < SHORT else math.ceil(COVER * n) for n in self.sizes]

    @staticmethod
    def slices(text: str) -> Iterator[str]:
        """Slices that end between words."""
        at = 0
        while at < len(text):
            upto = at + SLICE
            if upto < len(text):
                stop = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(text, upto)
                upto = stop.end() if stop else len(text)
            yield text[at:upto]
            at = upto

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, int, int]]]:
        """(n_words, base places (first, last, label), maximal runs (first, last, template, template place of the first))."""
        sa, number, n, base = self.automaton, self.number, 0, []
        runs: list[tuple[int, int, int, int]] = []
        state = length = 0
        live: dict[tuple[int, int], int] = {}  # place that was reached -> the file's word where its run began
        tail: list[int] = []  # vocabulary numbers of the words just before
        gap_at = -1
        for piece in self.slices(text):
            ids = list(map(number.get, tokens_of(piece)))
            for k, token in ((k, t) for k, t in enumerate(ids) if t is not None):
                k += n
                if k != gap_at:  # other words stood between
                    if live:
                        self._end(runs, live, gap_at - 1)
                        live = {}
                    state = length = 0
                    tail.clear()
                gap_at = k + 1
                state, length = sa.step(state, length, token)
                if length >= MIN_RUN:
                    now = {(t, e): live.pop((t, e - 1), k - MIN_RUN + 1) for t, e in self.places[state]}
                    if live:
                        self._end(runs, live, k - 1)
                    live = now
                elif live:
                    self._end(runs, live, k - 1)
                    live = {}
                tail.append(token)
                if token in self.by_last:
                    for phrase, label in self.by_last[token]:
                        if tail[-len(phrase) :] == phrase:
                            base.append((k - len(phrase) + 1, k, label))
                if len(tail) > 4 * self.longest:
                    del tail[: -self.longest]
            n += len(ids)
        if live:
            self._end(runs, live, gap_at - 1)
        return n, base, runs

    @staticmethod
    def _end(runs: list, live: dict[tuple[int, int], int], last: int) -> None:
        runs.extend((first, last, t, e - (last - first + 1)) for (t, e), first in live.items())

    def chains(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(covered tokens, template, first word, last word) of the best chain that ends with each run."""
        out, near = [], {}
        for first, last, t, at in sorted(runs):
            end = at + last - first + 1
            own = near.setdefault(t, [])
            own[:] = [c for c in own if c[1] >= first - MAX_GAP - 1]
            best = (last - first + 1, first)
            for covered, upto, template_end, began, run_first, run_at in own:
                if run_first < first and run_at < at and end > template_end and last > upto:
                    fresh_tokens = last - first + 1 - max(0, upto + 1 - first, template_end - at)
                    if fresh_tokens > 0:
                        best = max(best, (covered + fresh_tokens, began))
            own.append((best[0], last, end, best[1], first, at))
            out.append((best[0], t, best[1], last))
        return out

    def spans(self, runs: list[tuple[int, int, int, int]]) -> tuple[list[Span], float]:
        """Spans in order of place; the best cover of any template."""
        found = self.chains(runs)
        best = max((n / self.sizes[t] for n, t, _, _ in found), default=0.0)
        enough = sorted((c for c in found if c[0] >= self.need[c[1]]), key=lambda c: (-c[0], c[0] / -self.sizes[c[1]], c[2], c[1]))
        # Where spans lie on each other, the one of more words stays; those of one template never overlap.
        starts: list[int] = []
        kept: dict[int, tuple[int, Span]] = {}  # first word -> (last, span)
        for n, t, first, last in enough:
            k = bisect_left(starts, last + 1)
            if k and kept[starts[k - 1]][0] >= first or k < len(starts) and starts[k] <= last:
                continue
            insort(starts, first)
            kept[first] = (last, Span(self.labels[t], first, last, n / self.sizes[t]))
        return [kept[s][1] for s in starts], best

    def file(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float, int]:
        n, base, runs = self.scan(text)
        spans, best = self.spans(runs)
        base_labels = sorted({label for _, _, label in base})
        labels = sorted({*base_labels, *(s.label for s in spans)})
        return n, len(base), min((f for f, _, _ in base), default=None), max((f for f, _, _ in base), default=None), ",".join(base_labels), ",".join(labels), 1.0 if base else round(best, 6), len(spans)


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans")
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, base phrases, labels and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in batches:
            rows = [s.file(t.as_py() or "") for t in b.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), type=t) for c, t in zip(columns, TYPES, strict=True))], names=["doc_id", *NAMES])

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    ddl = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_spans long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, first_word, last_word, cover): the covered template spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in batches:
            ids, found = [], []
            for k, t in enumerate(b.column(1)):
                for x in s.spans(s.scan(t.as_py() or "")[2])[0]:
                    ids.append(k)
                    found.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, type=pa.int64())), pa.array([x.label for x in found], pa.string()), pa.array([x.first for x in found], pa.int64()), pa.array([x.last for x in found], pa.int64()), pa.array([x.cover for x in found], pa.float64())],
                names=["doc_id", "label", "first_word", "last_word", "cover"],
            )

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, label string, first_word long, last_word long, cover double")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
