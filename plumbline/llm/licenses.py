"""Operator 9: license scans by template markup.

Templates are written in a markup with optional and replaceable regions. They are compiled together into one
automaton over words, run from every word that can begin a template; a text is accepted where all mandatory
wording stands exactly, in order. Base labels come from fixed phrases and are found beside the templates.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, map_arrow, prepare, texts_of, without

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(.*?)>>", re.S)

#: Phrases and labels of the base.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

#: License notices and texts as templates. var: up to ``max`` words that match. An "-opening" is a
#: license's first sentence alone; the "-text" templates hold all mandatory wording of the license.
_SUBJECT = '<<beginOptional>>this <<var;match="work|project|software|code|program";max=1>> is<<endOptional>> '
_DISCLAIMED = """this software is provided <<var;match="by|the|copyright|holders|and|contributors|author|authors|regents";max=6>> as is and any express
or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose
are disclaimed in no event shall <<var;match=".+";max=8>> be liable for any direct indirect incidental special exemplary or consequential
damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising
in any way out of the use of this software even if advised of the possibility of such damage"""
_CONDITIONS = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution"""
TEMPLATES = [
    ("mit-notice", _SUBJECT + "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction"),
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
<<beginOptional>>the software<<endOptional>> to deal in the software without restriction including without limitation the rights to use copy modify merge
publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all
copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not
limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
<<var;match=".+";max=6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
from out of or in connection with the software or the use or other dealings in the software"""),
    ("apache-notice", _SUBJECT + 'licensed under the apache license version <<var;match="[0-9]+";max=3>>'),
    ("apache-text", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at <<var;match=".+";max=8>> unless required by applicable law or agreed to in writing software distributed
under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the
specific language governing permissions and limitations under the license"""),
    ("gpl-notice", _SUBJECT + 'licensed under the <<beginOptional>>gnu<<endOptional>> general public license <<beginOptional>>version <<var;match="v?[0-9]+";max=2>><<endOptional>>'),
    ("gpl-opening", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-text", """is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
foundation either version <<var;match="[0-9]+";max=1>> of the license or at your option any later version
<<var;match=".+";max=4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
fitness for a particular purpose see the gnu general public license for more details"""),
    ("cc-by-nc-notice", _SUBJECT + 'licensed under <<beginOptional>>a<<endOptional>> cc by nc <<beginOptional>><<var;match="[0-9]+";max=2>><<endOptional>>'),
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-text", _CONDITIONS + " " + _DISCLAIMED),
    ("bsd-3-text", _CONDITIONS + """ <<beginOptional>>3<<endOptional>> neither the name of <<var;match=".+";max=10>> may be used to endorse or promote products derived
from this software without specific prior written permission """ + _DISCLAIMED),
    ("isc-opening", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-text", """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
<<var;match=".+";max=4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
in no event shall <<var;match=".+";max=4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of
use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of
this software"""),
]


def words_of(text: str) -> list[str]:
    """A-Z lower-cased, other characters as they are."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Automaton:
    """All templates as one automaton; its states are made deterministic as they are met."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.moves: list[list[tuple[object, int]]] = []  # state: (word or pattern, next)
        self.skips: list[list[int]] = []
        self.accepts: dict[int, str] = {}
        starts = []
        for label, markup in templates:
            start = self._state()
            starts.append(start)
            end, rest = self._compile(self._parse(markup), start)
            if rest:
                raise ValueError(f"endOptional without beginOptional in {label}")
            self.accepts[end] = label
        self.start = self._closure(starts)
        self.vocabulary = {w for m in self.moves for w, _ in m if isinstance(w, str)}
        self.patterns = sorted({w.pattern for m in self.moves for w, _ in m if not isinstance(w, str)})
        self.tests = [re.compile(p) for p in self.patterns]
        self.first = {w for s in self.start for w, _ in self.moves[s] if isinstance(w, str)}
        if any(not isinstance(w, str) for s in self.start for w, _ in self.moves[s]) or any(s in self.accepts for s in self.start):
            raise ValueError("a template begins with a mandatory or optional word")
        self.steps: dict[tuple[frozenset, object], frozenset] = {}
        self.kinds: dict[str, object] = {}

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    @staticmethod
    def _parse(markup: str) -> list[tuple[str, object]]:
        out, at = [], 0
        for m in _MARK.finditer(markup):
            out += [("word", w) for w in words_of(markup[at : m.start()])]
            name, _, args = m[1].partition(";")
            if name == "var":
                given = dict(x.split("=", 1) for x in re.split(r";(?=\w+=)", args))
                out.append(("var", (given.get("match", ".+").strip('"'), int(given.get("max", "5")))))
            elif name in ("beginOptional", "endOptional"):
                out.append((name, None))
            else:
                raise ValueError(f"unknown markup {m[0]}")
            at = m.end()
        return out + [("word", w) for w in words_of(markup[at:])]

    def _compile(self, parts: list, at: int) -> tuple[int, list]:
        parts = list(parts)
        while parts:
            kind, value = parts.pop(0)
            if kind == "endOptional":
                return at, [("ended", None), *parts]
            if kind == "beginOptional":
                inner, rest = self._compile(parts, self._after(at))
                if not rest or rest[0][0] != "ended":
                    raise ValueError("beginOptional without endOptional")
                end = self._state()
                self.skips[inner].append(end)
                self.skips[at].append(end)
                at, parts = end, rest[1:]
            elif kind == "var":
                pattern, most = re.compile(value[0]), value[1]
                end = self._state()
                for _ in range(most):
                    nxt = self._state()
                    self.moves[at].append((pattern, nxt))
                    self.skips[nxt].append(end)
                    at = nxt
                at = end
            else:
                nxt = self._state()
                self.moves[at].append((value, nxt))
                at = nxt
        return at, []

    def _after(self, at: int) -> int:
        nxt = self._state()
        self.skips[at].append(nxt)
        return nxt

    def _closure(self, states) -> frozenset:
        seen, open_ = set(states), list(states)
        while open_:
            for t in self.skips[open_.pop()]:
                if t not in seen:
                    seen.add(t)
                    open_.append(t)
        return frozenset(seen)

    def _kind(self, word: str):
        """What the automaton can tell of a word: itself, if a template names it, and the patterns it matches."""
        if word not in self.kinds:
            if len(self.kinds) > 100_000:
                self.kinds.clear()
            self.kinds[word] = (word if word in self.vocabulary else None, tuple(bool(t.fullmatch(word)) for t in self.tests))
        return self.kinds[word]

    def _step(self, states: frozenset, word: str) -> frozenset:
        kind = self._kind(word)
        if (states, kind) not in self.steps:
            ok = dict(zip(self.patterns, kind[1]))
            self.steps[states, kind] = self._closure({t for s in states for w, t in self.moves[s] if (w == word if isinstance(w, str) else ok[w.pattern])})
        return self.steps[states, kind]

    def matches(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(first word, words, label) of every accepted place, the longest for each start and label."""
        out = []
        for i, w in enumerate(words):
            if w in self.first:
                states, best = self.start, {}
                for j in range(i, len(words)):
                    states = self._step(states, words[j])
                    if not states:
                        break
                    for s in states:
                        if s in self.accepts:
                            best[self.accepts[s]] = j + 1 - i
                out += [(i, n, label) for label, n in sorted(best.items())]
        return out


class Scanner:
    """Scans texts for phrases and templates. ``anchors``: a text with none of them can hold neither."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.automaton = Automaton(templates)
        self.phrases = [(p.split(), label) for p, label in phrases]
        need = [set(p) for p, _ in self.phrases]
        for _, markup in templates:
            depth, words = 0, set()
            for kind, value in Automaton._parse(markup):
                depth += {"beginOptional": 1, "endOptional": -1}.get(kind, 0)
                if kind == "word" and not depth:
                    words.add(value)
            need.append(words)
        # the longest mandatory word of each stands for it
        self.anchors = re.compile("|".join(sorted({re.escape(max(sorted(n), key=len)) for n in need})))

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Number of words, places of phrases (start, label), and template matches."""
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        words = _WORD.findall(low)
        if not self.anchors.search(low):
            return len(words), [], []
        base = []
        for phrase, label in self.phrases:
            i = -1
            while True:
                try:
                    i = words.index(phrase[0], i + 1)
                except ValueError:
                    break
                if words[i : i + len(phrase)] == phrase:
                    base.append((i, label))
        return len(words), sorted(base), self.automaton.matches(words)


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<start:long,words:long,label:string>>"
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Add COLUMNS to rows with a text (null: empty). Score: 1 where a template is accepted, 0.5 for phrases alone, else 0.

    No place found: 0 places, null first and last word, empty labels. Other columns stay, ones of these names are
    replaced; repeated rows stay; an empty table stays empty. Overlapping places all count.
    """
    added = [f.name for f in extended(docs.select(), COLUMNS).fields]
    docs = without(docs, *added)
    at = docs.columns.index("text")

    def run(batches):
        scanner = Scanner(templates, phrases)
        for b in batches:
            rows = []
            for text in texts_of(b.column(at)):
                n, base, found = scanner.scan(text)
                labels = {label for _, label in base}
                own = labels | {label for _, _, label in found}
                rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(own)), 1.0 if found else 0.5 if base else 0.0, [{"start": s, "words": w, "label": label} for s, w, label in found]))
            cols = list(zip(*rows)) or [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, t in zip(cols, _KINDS)]], names=[*b.schema.names, *added])

    return map_arrow(docs, run, extended(docs, COLUMNS))


def op9_license_templates(spark, sf_dir: str) -> DataFrame:
    """Scan all documents for license phrases and templates.

    Null and empty texts have no words and empty labels; a null doc_id and repeated rows stay; an empty table gives no
    row.
    """
    prepare(spark)
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
