"""License scans: template markup compiled to token automata.

A template is written in the markup of public license lists:
``<<beginOptional>>...<<endOptional>>`` encloses wording that may be missing and
``<<var;name="...";original="...";match=".{0,N}">>`` a region that any wording of
at most ``N`` characters may replace (its words, joined by single spaces).  A match
of ``.+`` or ``.*`` reaches over ``REGION`` characters at most, and any other
pattern is refused.  All other words are mandatory.  A template accepts a text in
which its mandatory wording stands exactly, word after word; of templates that
accept stretches from one word on, the longest counts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldloom.llm.textbatch import byte_table, lower_ascii, pieces, runs, text_values

#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text: digits, a-z and all beyond ASCII.
WORD = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_WORD_RE = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases and the labels they stand for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Characters that a region without a bound of its own reaches over.
REGION = 200

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;name="holders";original="AUTHORS OR COPYRIGHT HOLDERS";match=".{1,80}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_BEGIN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = '<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";original="the copyright holder";match=".{1,120}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,120}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{1,120}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = '<<var;name="what";original="This program";match=".{1,60}">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version <<var;name="version";original="3";match=".{1,10}">> of the License, or (at your option) any later version.'
_CC = 'This <<var;name="work";original="work";match=".{1,60}">> is licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution{kind} <<beginOptional>>4.0<<endOptional>> <<beginOptional>>International<<endOptional>> License'

#: License texts, notices and short statements, in template markup.
TEMPLATES = {
    "agpl-notice": _GNU.replace("{kind}", "Affero General Public License"),
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>',
    "apache-2.0-notice": 'you may not use this <<var;name="what";original="file";match=".{1,30}">> except in compliance with the License. You may obtain a copy of the License at <<var;name="place";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,60}">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": f"{_BSD_BEGIN} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_BEGIN} {_BSD_NAMES} {_BSD_END}",
    "cc-by-4.0": _CC.replace("{kind}", ""),
    "cc-by-nc": _CC.replace("{kind}", "-NonCommercial"),
    "cc-by-nc-nd": _CC.replace("{kind}", "-NonCommercial-NoDerivatives"),
    "cc-by-nc-nd-short": "Licensed under CC BY-NC-ND <<beginOptional>>4.0<<endOptional>>",
    "cc-by-nc-sa": _CC.replace("{kind}", "-NonCommercial-ShareAlike"),
    "cc-by-nc-sa-short": "Licensed under CC BY-NC-SA <<beginOptional>>4.0<<endOptional>>",
    "cc-by-nc-short": "Licensed under CC BY-NC <<beginOptional>>4.0<<endOptional>>",
    "cc-by-nd": _CC.replace("{kind}", "-NoDerivatives"),
    "cc-by-nd-short": "Licensed under CC BY-ND <<beginOptional>>4.0<<endOptional>>",
    "cc-by-sa": _CC.replace("{kind}", "-ShareAlike"),
    "cc-by-sa-short": "Licensed under CC BY-SA <<beginOptional>>4.0<<endOptional>>",
    "cc-by-short": "Licensed under CC BY <<beginOptional>>4.0<<endOptional>>",
    "gpl-3.0": 'This <<var;name="what";original="work";match=".{1,60}">> is licensed under the GNU General Public License, <<beginOptional>>version<<endOptional>> 3<<beginOptional>>.0<<endOptional>>',
    "gpl-notice": _GNU.replace("{kind}", "General Public License"),
    "isc": 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this <<var;name="what";original="software";match=".{1,40}">> for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="who";original="THE AUTHOR";match=".{1,40}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="liable";original="THE AUTHOR";match=".{1,40}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-notice": _GNU.replace("{kind}", "Lesser General Public License"),
    "mit": f'Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var;name="what";original="software and associated documentation files";match=".{{1,90}}">> (the "<<var;name="short";original="Software";match=".{{1,20}}">>"), to deal in the <<var;name="again";original="Software";match=".{{1,20}}">> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. {_WARRANTY}',
    "mit-short": "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_MARKUP = re.compile(r'<<(?:(beginOptional)[^>]*|(endOptional)|var;((?:(?!>>).)*))>>', re.S)
_MATCH = re.compile(r'match="((?:(?!"(?:;|$)).)*)"(?:;|$)')
_COUNT = re.compile(r"\.(?:\{(\d+),(\d*)\}|([+*]))")


def _region(label: str, attributes: str) -> tuple[int, int]:
    """The least and the greatest number of characters of a replaceable region."""
    found = _MATCH.search(attributes)
    m = _COUNT.fullmatch(found[1]) if found else None
    if m is None:
        raise ValueError(f"{label}: only regions that match .{{a,b}}, .{{a,}}, .+ or .* can be read")
    least = int(m[1]) if m[1] else int(m[3] == "+")
    most = int(m[2]) if m[2] else max(REGION, least)
    if most < max(1, least):
        raise ValueError(f"{label}: a region of at most {most} characters")
    return least, most


def _parts(label: str, markup: str) -> list[tuple]:
    """("word", word), ("open",), ("close",) and ("region", least, most) in order."""
    out, at, opened = [], 0, 0
    for m in [*_MARKUP.finditer(markup), None]:
        plain = markup[at : m.start() if m else len(markup)]
        if "<<" in plain or ">>" in plain:
            raise ValueError(f"{label}: unknown markup in {plain!r}")
        out += [("word", w) for w in words_of(plain.encode())]
        if m is None:
            break
        at, opened = m.end(), opened + bool(m[1]) - bool(m[2])
        if opened < 0:
            raise ValueError(f"{label}: an optional region ends that hasn't begun")
        out.append(("open",) if m[1] else ("close",) if m[2] else ("region", *_region(label, m[3])))
    if opened:
        raise ValueError(f"{label}: an optional region isn't closed")
    return out


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in which A-Z count as a-z."""
    return _WORD_RE.findall(text.lower())


def _size(word: bytes) -> int:
    """The characters of a word."""
    return len(word) if word.isascii() else len(word.decode("utf-8", "replace"))


@dataclass(frozen=True)
class Template:
    """A token automaton without empty moves.

    ``moves[state]`` maps a word to the next states; ``regions[state]`` is the
    (least, most) characters of a region that a word may begin or go on there, with
    the states after the region; ``ends`` are accepting.  A walk is in a state with the
    characters that it has used of its region (-1: in none).
    """

    label: str
    moves: tuple[dict[bytes, frozenset[int]], ...]
    regions: tuple[tuple[int, int, frozenset[int]] | None, ...]
    begin: frozenset[int]
    ends: frozenset[int]
    mandatory: frozenset[bytes]

    def match(self, words: Sequence[bytes], at: int) -> int:
        """The end (exclusive) of the longest accepted stretch from word ``at``; -1 if none."""
        walks, end = {(s, -1) for s in self.begin}, -1
        for i in range(at, len(words) + 1):
            if any(s in self.ends for s, used in walks if used < 0):
                end = i
            if i == len(words) or not walks:
                break
            word, after = words[i], set()
            size = _size(word)
            for s, used in walks:
                if used < 0:
                    after.update((t, -1) for t in self.moves[s].get(word, ()))
                if (region := self.regions[s]) is not None:
                    least, most, beyond = region
                    now = size if used < 0 else used + 1 + size
                    if now <= most:
                        after.add((s, now))
                        if now >= least:
                            after.update((t, -1) for t in beyond)
            walks = after
        return end

    @functools.cached_property
    def first(self) -> frozenset[bytes | None]:
        """Words that it may begin with; None if any."""
        return frozenset(w for s in self.begin for w in self.moves[s]) | (frozenset([None]) if any(self.regions[s] for s in self.begin) else frozenset())


def compile_template(label: str, markup: str) -> Template:
    """Markup to automaton: a chain of states with empty moves around optional regions, then closed over them."""
    parts = _parts(label, markup)
    mandatory, empty, opened = set(), [], []
    words: list[tuple[int, bytes]] = []
    regions: dict[int, tuple[int, int]] = {}
    state = 0
    for kind, *what in parts:
        if kind == "word":
            words.append((state, what[0]))
            if not opened:
                mandatory.add(what[0])
            state += 1
        elif kind == "region":
            regions[state] = (what[0], what[1])
            if what[0] == 0:
                empty.append((state, state + 1))
            state += 1
        elif kind == "open":
            opened.append(state)
        else:
            empty.append((opened.pop(), state))
    if not mandatory:
        raise ValueError(f"{label}: no wording is mandatory")
    reach = [{s} for s in range(state + 1)]
    for a, b in sorted(empty, reverse=True):  # empty moves lead forward only
        reach[a] |= reach[b]
    moves: list[dict[bytes, frozenset[int]]] = [{} for _ in range(state + 1)]
    for a, word in words:
        moves[a][word] = frozenset(reach[a + 1])
    listed = tuple((*regions[s], frozenset(reach[s + 1])) if s in regions else None for s in range(state + 1))
    return Template(label, tuple(moves), listed, frozenset(reach[0]), frozenset([state]), frozenset(mandatory))


@dataclass(frozen=True)
class Scanner:
    """Phrases and templates, with the word of each that is looked for first."""

    templates: tuple[Template, ...]
    phrases: tuple[tuple[tuple[bytes, ...], str], ...]

    @functools.cached_property
    def hints(self) -> re.Pattern[bytes]:
        """Matches a text that may hold any phrase or template: the longest mandatory word of each."""
        longest = {max(t.mandatory, key=lambda w: (len(w), w)) for t in self.templates} | {max(p, key=lambda w: (len(w), w)) if max(map(len, p)) > 3 else rb"(?<![0-9a-z\x80-\xff])" + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(p) for p, _ in self.phrases}
        return re.compile(b"|".join(sorted(longest)))

    @functools.cached_property
    def starts(self) -> dict[bytes, list[Template]]:
        out: dict[bytes, list[Template]] = {}
        for t in self.templates:
            for w in t.first - {None} if None not in t.first else ():
                out.setdefault(w, []).append(t)
        return out

    def scan(self, lowered: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(label, first word, end) of all places of phrases, and of the non-overlapping accepted stretches of each template."""
        if not self.hints.search(lowered):
            return [], []
        words = _WORD_RE.findall(lowered)
        present = set(words)
        base = [(label, i, i + len(p)) for p, label in self.phrases if present.issuperset(p) for i in range(len(words) - len(p) + 1) if words[i] == p[0] and tuple(words[i : i + len(p)]) == p]
        live = [t for t in self.templates if t.mandatory <= present]
        full: list[tuple[str, int, int]] = []
        if live:
            done = dict.fromkeys((t.label for t in live), 0)
            anywhere = [t for t in live if None in t.first]
            for i, word in enumerate(words):
                found = [(t.match(words, i), t.label) for t in (*self.starts.get(word, ()), *anywhere) if t.label in done and i >= done[t.label]]
                longest = max((end for end, _ in found), default=-1)
                for end, label in found:
                    if end >= 0:
                        done[label] = end
                        if end == longest:
                            full.append((label, i, end))
        return base, full


def scanner(templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Scanner:
    """A scanner for the given templates and phrases; by default the ones above."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    return Scanner(tuple(compile_template(k, v) for k, v in sorted(templates.items())), tuple((tuple(words_of(k.encode())), v) for k, v in phrases.items()))


_PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
_ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("phrases", T.ArrayType(_PLACE)), T.StructField("accepted", T.ArrayType(_PLACE))])


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, out: str = "licenses") -> DataFrame:
    """``docs`` with a struct column ``out``: the text's word count, all places of phrases, and the stretches that templates accept.

    A null text counts as empty; whole texts are read, however long.  Rows are
    independent: repeated rows give repeated results, an empty table an empty
    one.  A column that is already called ``out`` is replaced, others are kept.
    """
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, _ADDED)])
    scan_all = scanner(templates, phrases)
    places = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    named = lambda found: [dict(zip(("label", "first_word", "end_word"), x)) for x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                data, offsets = text_values(batch.column(batch.schema.get_field_index(text)))
                lowered = lower_ascii(data)
                _, _, n_words = runs(WORD[lowered], offsets)
                raw, at = lowered.tobytes(), offsets.tolist()
                found = [scan_all.scan(raw[a:b]) for a, b in zip(at, at[1:])]
                column = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array([named(b) for b, _ in found], places), pa.array([named(f) for _, f in found], places)], ["n_words", "phrases", "accepted"])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), column], [*keep, out])

    return docs.select(*keep).mapInArrow(run, schema)


def license_report(docs: DataFrame) -> DataFrame:
    """One row for each document with the counts, labels and score of its scan.

    ``score`` is 1 where a template accepts, 0.5 where only a phrase stands, else 0.
    """
    found = scan_licenses(docs.select("doc_id", "text"), out="_l")
    base, full = F.col("_l.phrases"), F.col("_l.accepted")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        F.col("_l.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first_word"]).alias("first_word"),
        F.array_max(base["first_word"]).alias("last_word"),
        listed(base["label"]).alias("base_labels"),
        listed(F.concat(base["label"], full["label"])).alias("labels"),
        F.when(F.size(full) > 0, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )


def template_regex(label: str, markup: str) -> str:
    """The same language as a template's automaton, as a regular expression over words that each end with one space."""
    out = ""
    for kind, *what in _parts(label, markup):
        if kind == "word":
            out += what[0].decode() + " "
        elif kind == "region":
            least, most = what
            # a word's characters and single spaces, from a word's first to a word's last
            longer = f"[^ ].{{{max(0, least - 2)},{most - 2}}}[^ ] " if most > 1 else ""
            one = "[^ ] " if least <= 1 else ""
            out += f"(?:{'|'.join(x for x in (longer, one) if x)})" + ("?" if least == 0 else "")
        else:
            out += "(?:" if kind == "open" else ")?"
    return out


def _longer(templates: dict[str, str]) -> dict[str, list[str]]:
    """For each template those that accept more, from the same word on, than it does of their wording."""
    compiled = {k: compile_template(k, v) for k, v in templates.items()}
    plain = {k: words_of(_MARKUP.sub(lambda m: m[3] and re.search(r'original="([^"]*)"', m[3])[1] or " ", v).encode()) for k, v in templates.items()}
    bare = {k: [w for kind, *x in _parts(k, v) for w in (x if kind == "word" else [])] for k, v in templates.items()}
    return {a: [b for b in templates if b != a and any(0 <= compiled[a].match(text, 0) < compiled[b].match(text, 0) for text in (plain[b], bare[b]))] for a in templates}


def oracle_sql() -> str:
    """DuckDB SQL for ``license_report`` on ``documents``; templates as regular expressions, after longer ones from the same word are taken out."""
    regexes = {k: template_regex(k, v) for k, v in sorted(TEMPLATES.items())}
    longer = _longer(TEMPLATES)

    def without(label: str) -> str:
        out = "joined"
        for other in longer[label]:
            out = f"regexp_replace({out}, ' {regexes[other]}', ' # ', 'g')"
        return out

    cases = ",\n".join(f"case when regexp_matches({without(k)}, ' {r}') then '{k}' end" for k, r in regexes.items())
    spots = " || ".join(f"list_transform(list_filter(range(len(w)), lambda i: {' and '.join(f'w[i + {n + 1}] = {chr(39)}{x}{chr(39)}' for n, x in enumerate(p.split()))}), lambda i: {{'label': '{label}', 'at': i}})" for p, label in PHRASES.items())
    return f"""
with tokens as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') w from documents),
found as (select doc_id, len(w) n, {spots} spots, list_filter([{cases}], lambda x: x is not null) full_labels
          from (select *, ' ' || array_to_string(w, ' ') || ' ' joined from tokens))
select doc_id, n::bigint n_words, len(spots)::bigint n_base,
       list_min(list_transform(spots, lambda s: s.at))::bigint first_word, list_max(list_transform(spots, lambda s: s.at))::bigint last_word,
       array_to_string(list_sort(list_distinct(list_transform(spots, lambda s: s.label))), ',') base_labels,
       array_to_string(list_sort(list_distinct(list_transform(spots, lambda s: s.label) || full_labels)), ',') labels,
       case when len(full_labels) > 0 then 1.0 when len(spots) > 0 then 0.5 else 0.0 end::double score
from found
"""
