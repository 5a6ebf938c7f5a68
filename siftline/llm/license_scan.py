"""License scan by template markup.

A template is license wording with markup: ``<<optional>>...<</optional>>`` may be absent, ``<<any:N>>`` stands for up
to N words that may be anything. It is compiled to a token automaton (states, word edges, wildcard edges); a place of a
text is accepted if a path of the automaton reads the words from there, every mandatory word exactly as written.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.common import slices, texts, whole

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MARK = re.compile(r"<<(/?optional|any:\d+)>>")

#: Phrase words and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Wording that several templates share.
MODIFY = "redistribute it and or modify it under the terms of the"
PUBLISHED = "<<optional>> as published by the free software foundation<</optional>><<optional>> either<</optional>>"
LATER = "<<optional>> of the license<</optional>><<optional>> or at your option any later version<</optional>>"
CREATIVE = "licensed under <<optional>>a <</optional>><<optional>>the <</optional>>"
FOUR = "4 0<<optional>> international<</optional>><<optional>> public<</optional>><<optional>> license<</optional>>"
BSD_SOURCE = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>>1 <</optional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>>2 <</optional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
BSD_NAMES = (
    "<<optional>>3 <</optional>>neither the name of <<any:8>> nor the names of <<any:2>> contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission "
)
BSD_DISCLAIMER = (
    "this software is provided by <<any:8>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:8>> be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage"
)
#: License wording as templates, each with its label.
TEMPLATES = [
    # Short references.
    ("apache-2.0", "licensed under the apache license<<optional>> version 2 0<</optional>><<optional>> the license<</optional>>"),
    ("gpl-3.0", f"<<optional>>this <<any:2>> is <</optional>>licensed under the <<optional>>terms of the <</optional>>gnu general public license{PUBLISHED} version 3"),
    ("gpl-2.0", f"<<optional>>this <<any:2>> is <</optional>>licensed under the <<optional>>terms of the <</optional>>gnu general public license{PUBLISHED} version 2"),
    ("mit-notice", "<<optional>>this <<any:2>> is <</optional>>released under the <<optional>>terms of the <</optional>>mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this <<any:4>> and associated documentation files"),
    ("cc-by-nc-4.0", "licensed under <<optional>>a <</optional>><<optional>>creative commons <</optional>>cc by nc<<optional>> 4 0<</optional>><<optional>> license<</optional>>"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    # Standard notices.
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 <<optional>>the license <</optional>>you may not use <<any:3>> except in compliance with the license"
        "<<optional>> you may obtain a copy of the license at <<any:7>> license 2 0<</optional>>",
    ),
    ("gpl-3.0", f"{MODIFY} gnu general public license{PUBLISHED} version 3{LATER}"),
    ("gpl-2.0", f"{MODIFY} gnu general public license{PUBLISHED} version 2{LATER}"),
    ("lgpl-3.0", f"{MODIFY} gnu lesser general public license{PUBLISHED} version 3{LATER}"),
    ("lgpl-2.1", f"{MODIFY} gnu lesser general public license{PUBLISHED} version 2 1{LATER}"),
    ("agpl-3.0", f"{MODIFY} gnu affero general public license{PUBLISHED} version 3{LATER}"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-4.0", f"{CREATIVE}creative commons attribution {FOUR}"),
    ("cc-by-4.0", f"{CREATIVE}<<optional>>creative commons <</optional>>cc by {FOUR}"),
    ("cc-by-sa-4.0", f"{CREATIVE}creative commons attribution sharealike {FOUR}"),
    ("cc-by-sa-4.0", f"{CREATIVE}<<optional>>creative commons <</optional>>cc by sa {FOUR}"),
    ("cc-by-nc-4.0", f"{CREATIVE}creative commons attribution noncommercial {FOUR}"),
    # Full texts.
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
        "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice <<optional>>including the next paragraph <</optional>>shall be included in all copies or substantial portions of the software the "
        "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for "
        "a particular purpose and noninfringement in no event shall <<any:8>> be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-clause", BSD_SOURCE + BSD_DISCLAIMER),
    ("bsd-3-clause", BSD_SOURCE + BSD_NAMES + BSD_DISCLAIMER),
    (
        "isc",
        "permission to use copy modify and <<optional>>or <</optional>>distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any:6>> disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:6>> be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
]


@dataclass(frozen=True)
class Automaton:
    """``words[s]``: next states of state s by word; ``free[s]``: next states by any word; state 0 starts, ``final`` accepts."""

    label: str
    words: dict[int, dict[str, frozenset[int]]]
    free: dict[int, frozenset[int]]
    final: frozenset[int]

    def first(self) -> set[str]:
        return set(self.words.get(0, {}))

    def longest(self, tokens: list[str], at: int) -> int:
        """The end of the longest reading that starts at ``at``, or -1."""
        states, end = {0}, -1
        for i in range(at, len(tokens)):
            states = {n for s in states for n in (*self.words.get(s, {}).get(tokens[i], ()), *self.free.get(s, ()))}
            if not states:
                break
            if states & self.final:
                end = i + 1
        return end


def compiled(label: str, template: str) -> Automaton:
    """The automaton of one template. Optional regions may be nested; wording begins with a word, maybe an optional one."""
    words: dict[int, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
    free: dict[int, set[int]] = defaultdict(set)
    skips: dict[int, set[int]] = defaultdict(set)
    state, opened = 0, []
    for part in MARK.split(template):
        if part == "optional":
            opened.append(state)
        elif part == "/optional":
            skips[opened.pop()].add(state)
        elif part.startswith("any:"):
            start = state
            for _ in range(int(part[4:])):
                free[state].add(state + 1)
                state += 1
            for s in range(start, state):
                skips[s].add(state)
        else:
            for word in WORD.findall(part):
                words[state][word].add(state + 1)
                state += 1
    if opened:
        raise ValueError(f"optional region not closed in {label}")

    def closure(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for n in skips[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        return seen

    near = {s: closure(s) for s in range(state + 1)}
    if state in near[0]:
        raise ValueError(f"{label} has no mandatory word")
    if any(free[t] for t in near[0]):
        raise ValueError(f"{label} begins with a replaceable region")
    edges: dict[int, dict[str, frozenset[int]]] = {}
    for s, reach in near.items():
        merged: dict[str, set[int]] = defaultdict(set)
        for t in reach:
            for word, to in words[t].items():
                merged[word] |= to
        edges[s] = {w: frozenset(to) for w, to in merged.items()}
    return Automaton(
        label, edges, {s: frozenset(n for t in reach for n in free[t]) for s, reach in near.items()}, frozenset(s for s, reach in near.items() if state in reach)
    )


def scanner(templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE):
    """A function from a text to ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    phrases, own = [compiled(label, phrase) for phrase, label in base.items()], [compiled(*t[:2]) for t in templates]
    starts: dict[str, list[tuple[bool, Automaton]]] = defaultdict(list)
    for is_base, group in ((True, phrases), (False, own)):
        for a in group:
            for word in a.first():
                starts[word].append((is_base, a))
    known = frozenset(starts)

    def scan(text: str) -> tuple:
        tokens = WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())
        places, labels, extra, covered, upto = [], set(), set(), 0, 0
        if not known.isdisjoint(tokens):
            for i, word in enumerate(tokens):
                if word not in known:
                    continue
                reach = i
                for is_base, automaton in starts[word]:
                    if (end := automaton.longest(tokens, i)) < 0:
                        continue
                    reach = max(reach, end)
                    if is_base:
                        places.append(i)
                        labels.add(automaton.label)
                    else:
                        extra.add(automaton.label)
                covered += max(0, reach - max(i, upto))
                upto = max(upto, reach)
        return len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | extra)), covered / len(tokens) if covered else 0.0

    return scan


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``), in one pass without a shuffle.

    ``base_labels`` are those of phrases whose words stand consecutively, ``n_base`` counts all their places and
    ``first_word``, ``last_word`` are the smallest and largest (null without any). ``labels`` adds the labels of accepted
    templates. ``score`` is the share of the text's words inside an accepted reading. A null text is the empty text: no
    words, no labels, score 0. Other columns are not read; repeated rows give repeated results.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scanner(templates, base)
        for part in slices(batches, "text"):
            rows = list(zip(*map(one, texts(part))))
            names = ["n_words", "n_base", "first_word", "last_word"]
            arrays = [part.column("doc_id"), *(pa.array(r, pa.int64()) for r in rows[:4]), pa.array(rows[4], pa.string()), pa.array(rows[5], pa.string()), pa.array(rows[6], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "base_labels", "labels", "score"])

    return docs.select(docs.doc_id.cast("bigint").alias("doc_id"), whole().alias("text")).mapInArrow(scan, SCHEMA)
