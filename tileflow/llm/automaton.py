"""Suffix automaton over word sequences, with the number of places where each state's strings end."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """All factors of the added sequences. ``add`` gives a sequence with the number of its copies."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: Hashable) -> int:
        """The state of the longest factor of p + word that ends where that does, cut out of its class if need be."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: Sequence[Hashable], copies: int = 1) -> None:
        last = 0
        for word in words:
            p = last
            if word in self.next[p]:
                last = self._split(p, word)
            else:
                last = self._state(self.length[p] + 1, {}, 0)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    self.link[last] = self._split(p, word)
            self.count[last] += copies

    def total(self) -> None:
        """Carry the counts to all suffixes; call once, after the last ``add``."""
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def matches(self, words: Sequence[Hashable], times: int = 1):
        """For each word the length of the longest factor that ends there and occurs at least ``times``."""
        v = size = 0
        for word in words:
            while v and (word not in self.next[v] or self.count[self.next[v][word]] < times):
                # A shorter factor has more places; a longer prefix of this state's strings would not help.
                v = self.link[v]
                size = self.length[v]
            u = self.next[v].get(word)
            if u is None or self.count[u] < times:
                size = 0
            else:
                v, size = u, size + 1
            yield size
