"""License scan: licence templates compiled into token automata, beside a count of base phrases.

A template is mandatory wording with two kinds of markup: ``[[ ... ]]`` encloses optional wording, and
``{{n}}`` a replaceable region of at most n words (a holder, a year, a product, an organisation). Compiled over words,
it accepts a region only if all mandatory words stand there in order, with nothing between them but what the markup
allows. Regions are anchored at both ends: they begin where a sentence or line begins and end where one ends, so
that what stands before and behind the wording is either allowed by markup or keeps the template from matching. Whole
licences need their whole wording: a changed, missing or inserted word anywhere rejects the text.

Edge cases: a null text is an empty one (no words, no labels, score 0, positions null); repeated rows are
answered each on its own; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_texts
from .words import ALNUM

# Base phrases and their labels.
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

_MIT = """[[the]] [[mit license]] [[mit]] [[copyright [[c]] {{12}} [[all rights reserved]]]]
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
files the software to deal in the software without restriction including without limitation the rights to use copy modify
merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including
the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is
without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for
a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages
or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
software or the use or other dealings in the software"""
_ISC = """[[isc license]] [[copyright [[c]] {{12}}]] permission to use copy modify and [[or]] distribute this software for any
purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in
all copies the software is provided as is and {{3}} disclaims all warranties with regard to this software including all
implied warranties of merchantability and fitness in no event shall {{3}} be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
negligence or other tortious action arising out of or in connection with the use or performance of this software"""
_BSD_HEAD = """[[bsd {{4}} license]] [[copyright [[c]] {{12}} [[all rights reserved]]]] redistribution and use in source and binary
forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of
source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]]
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = """[[3]] neither the name of [[the]] {{8}} nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission"""
_BSD_TAIL = """this software is provided by {{6}} [[and contributors]] as is and any express or implied warranties including but not
limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
{{6}} [[or contributors]] be liable for any direct indirect incidental special exemplary or consequential damages including
but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however
caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising
in any way out of the use of this software even if advised of the possibility of such damage"""
_ZLIB = """[[zlib license]] [[copyright [[c]] {{12}}]] this software is provided as is without any express or implied warranty in no
event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone
to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to
the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the
original software if you use this software in a product an acknowledgment in the product documentation would be appreciated
but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the
original software [[3]] this notice may not be removed or altered from any source distribution"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or
non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software
dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided
as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness
for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
dealings in the software [[for more information please refer to {{4}}]]"""
_BOOST = """[[boost software license version 1 0 [[august 17th 2003]]]] permission is hereby granted free of charge to any person or
organization obtaining a copy of the software and accompanying documentation covered by this license the software to use
reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit
third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software
and this entire statement including the above license grant this restriction and the following disclaimer must be included in
all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works
are solely in the form of machine executable object code generated by a source language processor the software is provided as
is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for
a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be
liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the
software or the use or other dealings in the software"""
_APACHE_HEADER = """[[copyright [[c]] {{12}}]] licensed under the apache license version 2 0 the license you may not use this file except in
compliance with the license you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in
writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
either express or implied see the license for the specific language governing permissions and limitations under the license"""
_MPL_HEADER = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
with this file you can obtain one at {{8}}"""


def _gnu_header(name: str, version: str) -> str:
    return f"""[[{{{{12}}}} copyright [[c]] {{{{12}}}}]] [[this file is part of {{{{6}}}}]] {{{{6}}}} is free software you can redistribute it and or
modify it under the terms of the {name} public license as published by the free software foundation either version
{version} of the license or [[at your option]] any later version {{{{6}}}} is distributed in the hope that it will be useful but without any
warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name}
public license for more details [[you should have received a copy of the {name} public license along with {{{{6}}}} if not
see {{{{6}}}}]] [[you should have received a copy of the {name} public license along with {{{{6}}}} if not write to the free
software foundation {{{{16}}}}]]"""


def _notice(license_: str) -> str:
    """A line that puts a work under a licence: who or what it is may be replaced, and nothing else may stand in it."""
    return f"[[this {{{{4}}}} is]] [[copyright [[c]] {{{{8}}}}]] [[released]] [[distributed]] [[licensed]] [[available]] under [[the]] [[terms of the]] {license_}"


# The wording of licences, of their standard headers, and of notices, with markup.
TEMPLATES = (
    ("mit-notice", _notice("mit license")),
    ("mit-text", _MIT),
    ("apache-2.0-notice", _notice("apache license version 2 0")),
    ("apache-2.0-header", _APACHE_HEADER),
    ("gpl-3.0-notice", _notice("gnu general public license [[gpl]] version 3 [[or [[at your option]] any later version]]")),
    ("gpl-2.0-notice", _notice("gnu general public license [[gpl]] version 2 [[or [[at your option]] any later version]]")),
    ("gpl-3.0-header", _gnu_header("gnu general", "3")),
    ("gpl-2.0-header", _gnu_header("gnu general", "2")),
    ("lgpl-notice", _notice("gnu lesser general public license [[version {{2}}]]")),
    ("lgpl-header", _gnu_header("gnu lesser general", "{{2}}")),
    ("agpl-notice", _notice("gnu affero general public license [[version {{2}}]]")),
    ("agpl-header", _gnu_header("gnu affero general", "3")),
    ("cc-by-4.0-notice", _notice("[[a]] [[creative commons]] cc by 4 0 [[international]] [[license]]")),
    ("cc-by-nc-4.0-notice", _notice("[[a]] [[creative commons]] cc by nc 4 0 [[international]] [[license]]")),
    ("cc-by-sa-4.0-notice", _notice("[[a]] [[creative commons]] cc by sa 4 0 [[international]] [[license]]")),
    ("bsd-2-clause-text", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-clause-text", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("mpl-2.0-header", _MPL_HEADER),
    ("isc-text", _ISC),
    ("zlib-text", _ZLIB),
    ("unlicense-text", _UNLICENSE),
    ("boost-1.0-text", _BOOST),
)


@dataclass
class Automaton:
    """States are numbers; ``moves[s]`` maps a word to a state, ``free[s]`` is a state that any word leads to, ``skips[s]`` need no word."""

    label: str
    moves: list[dict[bytes, int]] = field(default_factory=list)
    free: list[int] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    mandatory: int = 0
    final: int = 0

    def state(self) -> int:
        self.moves.append({})
        self.free.append(-1)
        self.skips.append([])
        return len(self.moves) - 1

    def closed(self, states) -> set[int]:
        todo, seen = list(states), set()
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.skips[s]
        return seen

    def firsts(self) -> set[bytes]:
        return {w for s in self.closed([0]) for w in self.moves[s]}

    def accept(self, words: list[bytes], at: int, ends: set[int] | None = None) -> int:
        """The end of the longest region from word `at` that the automaton accepts, or -1; with ends, only regions that end there."""
        now, end, i = self.closed([0]), -1, at
        while now and i < len(words):
            w = words[i]
            now = self.closed([t for s in now for t in ((self.moves[s][w],) if w in self.moves[s] else ()) + ((self.free[s],) if self.free[s] >= 0 else ())])
            i += 1
            if self.final in now and (ends is None or i in ends):
                end = i
        return end


def compile_template(label: str, markup: str) -> Automaton:
    a = Automaton(label)
    at, opened = a.state(), []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\S+?(?=\[\[|\]\]|\{\{|\s|$)", markup):
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            a.skips[opened.pop()].append(at)
        elif token.startswith("{{"):
            exits, here = [at], at
            for _ in range(int(token[2:-2])):
                nxt = a.state()
                a.free[here] = nxt
                here = nxt
                exits.append(nxt)
            at = a.state()
            for s in exits:
                a.skips[s].append(at)
        else:
            nxt = a.state()
            a.moves[at][token.encode()] = nxt
            a.mandatory += not opened
            at = nxt
    if opened:
        raise ValueError(f"{label}: optional wording isn't closed")
    a.final = at
    return a


def _table() -> bytes:
    lower = bytes(range(256)).lower()
    return bytes(lower[i] if ALNUM[lower[i]] else 32 for i in range(256))


#: A sentence's end: a mark before a blank, or a new line (of any kind of mark in front).
BREAK = re.compile(rb"[.!?;:](?=[\s\"')\]]|\Z)|\n")


def breaks(text: bytes, table: bytes) -> set[int]:
    """The numbers of words before which a sentence or line ends, the first and the last place included."""
    out, n, at = {0}, 0, 0
    for m in BREAK.finditer(text):
        n += len(text[at : m.end()].translate(table).split())
        out.add(n)
        at = m.end()
    return out | {n + len(text[at:].translate(table).split())}


def license_scan(df: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document: counts and places of the base phrases, and labels of both the phrases and the templates.

    score is 1 where a template is accepted, 0.5 where only a base phrase stands, else 0.
    """
    automata = [compile_template(*t) for t in templates]
    base = [([w.encode() for w in words], label) for words, label in phrases]
    last = {words[-1] for words, _ in base}
    # Without all the words that every accepted region has, no run is needed.
    anchors = [{w for m in a.moves for w in m if compile_needs(a, w)} for a in automata]
    common = [max(ws, key=len) for ws in anchors]
    table = _table()

    def scan(ids, texts):
        out = {k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates")}
        for i, text in zip(ids, texts, strict=True):
            words = text.translate(table).split()
            have = set(words)
            places, found = [], set()
            if have & last:
                for k, w in enumerate(words):
                    if w in last:
                        for phrase, label in base:
                            s = k - len(phrase) + 1
                            if s >= 0 and words[s : k + 1] == phrase:
                                places.append(s)
                                found.add(label)
            live = [k for k, w in enumerate(common) if w in have and anchors[k] <= have]
            accepted = set()
            if live:
                places_ = breaks(text, table)
                for n in live:
                    if any(automata[n].accept(words, k, places_) >= 0 for k in sorted(places_) if k < len(words)):
                        accepted.add(automata[n].label)
            for name, value in zip(out, (i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(found | accepted)), 1.0 if accepted else 0.5 if found else 0.0, len(accepted)), strict=True):
                out[name].append(value)
        return out

    return map_texts(df, scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates long")


def compile_needs(a: Automaton, word: bytes) -> bool:
    """Whether no accepted region lacks the word."""
    todo, seen = [0], set()
    while todo:
        s = todo.pop()
        if s in seen:
            continue
        seen.add(s)
        todo += a.skips[s] + [t for w, t in a.moves[s].items() if w != word] + ([a.free[s]] if a.free[s] >= 0 else [])
    return a.final not in seen
