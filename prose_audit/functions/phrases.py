"""Many phrases looked for at once, and sets of spans that don't overlap."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick

_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Phrases that one automaton may hold: it goes to the tasks whole, some 100 bytes a character.
MOST_PHRASES = 200_000


def lowered(text: str) -> str:
    """A-Z in lower case, with every offset as it was."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes lower A-Z alone


class PhraseIndex:
    """An Aho-Corasick automaton over phrases; a text is read once, however many there are.

    What it finds is what ``\\bphrase\\b`` would, case and word edges being ASCII: occurrences of one phrase don't
    overlap, those of different phrases may. With ``curly``, a straight apostrophe of a phrase also stands for a curly one.
    """

    def __init__(self, phrases: list[str], *, curly: bool = True) -> None:
        if len(phrases) > MOST_PHRASES:
            raise ValueError(f"{len(phrases)} phrases; an automaton takes {MOST_PHRASES} at most")
        self.phrases, self.curly = phrases, curly
        numbers: dict[str, list[int]] = {}
        for i, phrase in enumerate(phrases):
            if phrase:
                numbers.setdefault(self._key(phrase), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for key, own in numbers.items():
            self.automaton.add_word(key, (len(key), key[0] in _WORD, key[-1] in _WORD, own))
        if numbers:
            self.automaton.make_automaton()
        self.empty = not numbers
        self.strict = {i for i, p in enumerate(phrases) if "’" in p} if curly else set()

    def _key(self, text: str) -> str:
        low = lowered(text)
        return low.replace("’", "'") if self.curly else low

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Number of the phrase, start and end of each occurrence, by end."""
        if self.empty or not text:
            return
        low, last, n = self._key(text), {}, len(text)
        for at, (length, first, final, own) in self.automaton.iter(low):
            end = at + 1
            start = end - length
            if (start > 0 and low[start - 1] in _WORD) == first or (end < n and low[end] in _WORD) == final:
                continue
            for i in own:
                if last.get(i, 0) <= start and (i not in self.strict or self._same(self.phrases[i], text[start:end])):
                    last[i] = end
                    yield i, start, end

    @staticmethod
    def _same(phrase: str, found: str) -> bool:
        """Whether a phrase with a curly apostrophe stands there with it."""
        return all(b == "’" for a, b in zip(phrase, found) if a == "’")

    def by_phrase(self, text: str) -> list[tuple[int, int, int]]:
        """The same in the order of the phrases, each by place."""
        return sorted(self.hits(text))


class DisjointSpans:
    """Spans that don't overlap, in order. An empty span overlaps what it lies strictly inside."""

    def __init__(self, spans: list[tuple[int, int]] = ()) -> None:
        own = sorted(spans)
        self.starts, self.ends = [a for a, _ in own], [b for _, b in own]

    def add(self, start: int, end: int) -> bool:
        """Adds the span unless it overlaps another one; says whether it did."""
        i = bisect_left(self.starts, end)  # spans from i on begin at or after the end
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True
