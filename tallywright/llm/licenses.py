"""License scans by template-markup matching.

A template is a license's wording with marked regions: optional ones, which a text may
have or not, and replaceable ones, in which other words may stand. It is compiled into an
automaton over words: each mandatory word is an edge that only this word passes, an optional
region can be skipped, a replaceable one passes any words up to its bounds, or one of several
wordings. A text is accepted where the automaton gets from its first state to its last over
neighbouring words, so the mandatory wording must match exactly; case, punctuation and
layout do not count. The automaton is made deterministic as far as texts need it.

Only texts that have all mandatory words of a template, in any order, are run through it.

Besides, phrases are found as they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import by_size, table

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = """INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: <<var;name="bullet";match=".{0,1}">> Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. <<var;name="bullet";match=".{0,1}">> Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""

#: Wordings of public licenses and of the notices that name them, with markup
#: as SPDX templates have it. A label may have several.
TEMPLATES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="holder";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", """<<var;name="verb";match="released|licensed|distributed|available|published">> under the
<<beginOptional>>terms of the<<endOptional>> MIT License"""),
    ("Apache-2.0", """<<var;name="verb";match="released|licensed|distributed|available|published">> under the
<<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>,<<endOptional>> Version 2.0
<<beginOptional>>(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.<<endOptional>>"""),
    ("GPL-2.0", """under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2
<<beginOptional>>of the License, or (at your option) any later version<<endOptional>>"""),
    ("GPL-3.0", """under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3
<<beginOptional>>of the License, or (at your option) any later version<<endOptional>>"""),
    ("ISC", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";match=".+">> BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"""{_REDISTRIBUTION} THIS SOFTWARE IS PROVIDED BY <<var;name="holder";match=".+">> "AS IS" AND ANY EXPRESS
OR IMPLIED WARRANTIES, {_AS_IS}"""),
    ("BSD-3-Clause", f"""{_REDISTRIBUTION} <<var;name="bullet";match=".{{0,1}}">> Neither the name of
<<var;name="holder";match=".+">> nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var;name="holder";match=".+">> "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, {_AS_IS}"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
)

#: Words that ``.+`` and ``.*`` pass at most.
REGION = 60
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;\w+=\"[^\"]*\")*)>>")
_MATCH = re.compile(r';match="([^"]*)"')
_ANY_WORDS = re.compile(r"\.(?:(\+)|(\*)|\{(\d+),(\d+)\})")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and whatever is not ASCII, A to Z in lower case."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def parse(markup: str) -> list:
    """A template as a list of words (bytes), optional regions (lists) and replaceable ones: a
    pair of bounds, or a tuple of wordings (tuples of words)."""
    out: list = []
    stack, at = [out], 0
    for mark in _MARK.finditer(markup):
        stack[-1] += words_of(markup[at:mark.start()])
        at = mark.end()
        if mark[1] == "beginOptional":
            stack[-1].append([])
            stack.append(stack[-1][-1])
        elif mark[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("a region ends that has not begun")
            stack.pop()
        else:
            told = _MATCH.search(mark[2])
            if not told:
                raise ValueError(f"a replaceable region without match: {mark[0]}")
            if found := _ANY_WORDS.fullmatch(told[1]):
                bounds = (int(found[3]), int(found[4])) if found[3] else (1 if found[1] else 0, REGION)
                stack[-1].append(bounds)
            else:
                stack[-1].append(tuple(tuple(words_of(x)) for x in told[1].split("|")))
    stack[-1] += words_of(markup[at:])
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return out


def mandatory(parts: list) -> frozenset[bytes]:
    return frozenset(p for p in parts if isinstance(p, bytes))


ANY = b""


class Automaton:
    """The automaton of a template. State 0 is the first one; states are sets of the
    template's places and are numbered as they are met."""

    def __init__(self, markup: str):
        parts = parse(markup)
        self.needs = mandatory(parts)
        self.steps: list[list[tuple[bytes, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.end = self._add(parts, 0)
        self.alphabet = {word for step in self.steps for word, _ in step}
        first = self._closed([0])
        if self.end in first:
            raise ValueError("a template without mandatory wording")
        self.sets, self.numbers, self.next = [first], {first: 0}, [{}]

    def _place(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    def _add(self, parts: Sequence, at: int) -> int:
        """Adds the parts behind a place; returns the place behind them."""
        for part in parts:
            if isinstance(part, bytes):
                self.steps[at].append((part, at := self._place()))
            elif isinstance(part, list):
                begin, at = at, self._add(part, at)
                behind = self._place()
                self.skips[at].append(behind)
                self.skips[begin].append(behind)
                at = behind
            elif isinstance(part[0], int):
                behind = self._place()
                for k in range(part[1]):
                    if k >= part[0]:
                        self.skips[at].append(behind)
                    self.steps[at].append((ANY, at := self._place()))
                self.skips[at].append(behind)
                at = behind
            else:
                behind = self._place()
                for wording in part:
                    self.skips[self._add(wording, at)].append(behind)
                at = behind
        return at

    def _closed(self, places) -> frozenset[int]:
        found, todo = set(places), list(places)
        while todo:
            for other in self.skips[todo.pop()]:
                if other not in found:
                    found.add(other)
                    todo.append(other)
        return frozenset(found)

    def _follow(self, state: int, word: bytes) -> int:
        """The state behind a word (of the alphabet, or ANY for all others); -1 for none."""
        to = self._closed({t for p in self.sets[state] for w, t in self.steps[p] if w == word or w == ANY})
        if not to:
            number = -1
        elif (number := self.numbers.get(to, -1)) < 0:
            number = self.numbers[to] = len(self.sets)
            self.sets.append(to)
            self.next.append({})
        self.next[state][word] = number
        return number

    def longest(self, words: list[bytes], begin: int) -> int:
        """Where the longest accepted stretch from ``begin`` ends; 0 if there is none."""
        state, best = 0, 0
        for i in range(begin, len(words)):
            word = words[i] if words[i] in self.alphabet else ANY
            to = self.next[state].get(word)
            state = self._follow(state, word) if to is None else to
            if state < 0:
                break
            if self.end in self.sets[state]:
                best = i + 1
        return best

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted stretches from left to right, the longest from each begin, none of which
        overlap. As a template passes a bounded number of words, in linear time."""
        first = {w for p in self.sets[0] for w, _ in self.steps[p]}
        out, after = [], 0
        for i, word in enumerate(words):
            if i >= after and (word in first or ANY in first) and (end := self.longest(words, i)):
                out.append((i, end))
                after = end
        return out


def phrase_places(words: list[bytes], phrase: str) -> list[int]:
    """Every place at which the phrase's words stand one after the other."""
    parts = words_of(phrase)
    out, at = [], -1
    try:
        while True:
            at = words.index(parts[-1], at + 1)
            begin = at + 1 - len(parts)
            if begin >= 0 and words[begin:at + 1] == parts:
                out.append(begin)
    except ValueError:
        return out


@cache
def _automata(templates: tuple) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(markup)) for label, markup in templates]


_PLACE = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """``key, n_words, phrases, matches`` of each whole text: all places of the phrases and the
    stretches that templates accept, as structs of label, begin and end (words from 0, end
    exclusive), in order of begin.

    Null and empty texts have no words. Words are compared as they are, but for A to Z.
    Stretches of one template do not overlap; those of several may. Repeated rows give
    repeated results; an empty table gives an empty one; other columns are not read.
    """
    templates, named = tuple(templates), dict(phrases)
    kind = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
    size = {p: len(words_of(p)) for p in named}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(templates)
        for batch in by_size(batches, 1):
            counts, standing, accepted = [], [], []
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                known = frozenset(words)
                counts.append(len(words))
                standing.append(sorted(
                    ({"label": label, "begin": a, "end": a + size[p]} for p, label in named.items()
                     if known.issuperset(words_of(p)) for a in phrase_places(words, p)), key=lambda x: (x["begin"], x["label"])))
                accepted.append(sorted(
                    ({"label": label, "begin": a, "end": b} for label, automaton in automata
                     if automaton.needs <= known for a, b in automaton.places(words)), key=lambda x: (x["begin"], x["end"], x["label"])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(standing, kind), pa.array(accepted, kind)],
                names=["key", "n_words", "phrases", "matches"])

    out = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("phrases", _PLACE), T.StructField("matches", _PLACE)])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out).withColumnRenamed("key", key)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and licenses of every document. The score is 1 where a template accepts, 0.5
    where there is only a phrase, else 0."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.concat(*[
        F.transform(x, lambda m: m["label"]) for x in of]))), ",")
    begins = F.transform("phrases", lambda m: m["begin"])
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(begins).alias("first_word"), F.array_max(begins).alias("last_word"),
        labels("phrases").alias("base_labels"), labels("phrases", "matches").alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("phrases") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def pattern(markup: str) -> str:
    """A template as a regular expression over words that each have a space behind."""

    def told(parts) -> str:
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += part.decode() + " "
            elif isinstance(part, list):
                out += f"(?:{told(part)})?"
            elif isinstance(part[0], int):
                out += f"(?:[^ ]+ ){{{part[0]},{part[1]}}}"
            else:
                out += f"(?:{'|'.join(told(x) for x in part)})"
        return out

    return told(parse(markup))


def _sql() -> str:
    """The same for DuckDB, templates as regular expressions over the joined words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def starts(phrase: str) -> str:
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        return f"[i FOR i IN range(1, len(w) + 1) IF {same}]"

    named = ", ".join(f"CASE WHEN len({x}) > 0 THEN '{label}' END" for x, label in zip("abc", PHRASES.values()))
    of = {}
    for label, markup in TEMPLATES:
        of.setdefault(label, []).append(f"regexp_matches(j, ' {pattern(markup)}')")
    accepted = ", ".join(f"CASE WHEN {' OR '.join(tests)} THEN '{label}' END" for label, tests in of.items())
    a, b, c = map(starts, PHRASES)
    return f"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), found AS (
    SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, {a} AS a, {b} AS b, {c} AS c FROM split
), named AS (
    SELECT doc_id, len(w) AS n_words, list_concat(list_concat(a, b), c) AS places,
           [x FOR x IN [{named}] IF x IS NOT NULL] AS base, [x FOR x IN [{accepted}] IF x IS NOT NULL] AS method
    FROM found
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, method))), ',') AS labels,
       CASE WHEN len(method) > 0 THEN 1.0::DOUBLE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM named"""


OP13_SQL = _sql()
