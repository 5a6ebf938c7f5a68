"""A worker's memory of encoded pieces of text, for byte-level BPE vocabularies."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Entries of a generation; two are kept. Longer pieces aren't.
MEMORY, KEPT_CHARS = 300_000, 48
#: Before a space with a character that is no white space behind it. No match of the split pattern reaches across such a
#: place: white space in front of the space ends a match there, and the space belongs to what follows.
WORD_START = re.compile(r" (?=\S)")
#: A sign, digit or line end behind a letter: a match of the split pattern ends between the two, whatever stands before, and
#: what follows is split like a text of its own. Words are thus remembered without the signs behind them.
WORD_END = re.compile(r"[!-@\[-`{-~\t\n\r](?<=[A-Za-zÀ-ÖØ-öø-ÿ][\s\S])")
#: Marks a piece that has no space before it: the first one of a text, and those that follow a word's end.
FIRST = "\0"


class PieceMemory:
    """Encodes each distinct piece once while it is remembered; what is forgotten is encoded again.

    ``encode`` gets pieces as they stand in texts. In the memory a piece goes without its space, one that has none with a mark.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = MEMORY):
        self.encode_new, self.entries = encode, entries
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text."""
        marked = [i for i, text in enumerate(batch) if FIRST in text]
        if marked:  # they hold the mark itself, and are encoded without the memory
            whole = dict(zip(marked, self.encode_new([batch[i] for i in marked])))
            rest = iter(self.encode([text for text in batch if FIRST not in text]))
            return [whole[i] if i in whole else next(rest) for i in range(len(batch))]
        batch = [WORD_END.sub(" " + FIRST + r"\g<0>", text) for text in batch]
        split = [text.split(" ") for text in batch]
        for parts in split:
            parts[0] = FIRST + parts[0]
        memory = self.memory
        found = [list(map(memory.get, parts)) for parts in split]
        lacking = [[i for i, ids in enumerate(own) if ids is None] for own in found]
        new = {parts[i] for parts, places in zip(split, lacking) for i in places}
        # A space before white space or at the end is no place to cut; texts with one are cut anew.
        uneven = {p for p in new if not p or p[0].isspace()}
        if uneven:
            for i, places in enumerate(lacking):
                if not uneven.isdisjoint([split[i][j] for j in places]):
                    first, *rest = WORD_START.split(batch[i])
                    split[i] = [FIRST + first, *rest]
                    found[i] = list(map(memory.get, split[i]))
                    lacking[i] = [j for j, ids in enumerate(found[i]) if ids is None]
            new = {parts[i] for parts, places in zip(split, lacking) for i in places}
        self._learn(new)
        for parts, own, places in zip(split, found, lacking):
            for i in places:
                own[i] = memory[parts[i]]
        self._forget(new)
        return list(map(b"".join, found))

    def _learn(self, new: set[str]) -> None:
        memory, older = self.memory, self.older
        memory.update((p, older[p]) for p in new if p in older)
        unknown = [p for p in new if p not in memory]
        memory.update(zip(unknown, self.encode_new([p[1:] if p[0] == FIRST else " " + p for p in unknown])))

    def _forget(self, new: set[str]) -> None:
        for p in new:
            if len(p) > KEPT_CHARS:
                del self.memory[p]
        if len(self.memory) > self.entries:
            self.memory, self.older = {}, self.memory
