"""Suffix automaton over sequences of integers, with weighted occurrence counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Automaton of all substrings of the added sequences (a reference shard).

    ``add`` takes a weight: the number of times the sequence stands for. After ``finish``, a state's
    ``count`` is the weighted number of end positions of its substrings.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A copy of state q for the substrings that p reaches by the symbol."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: Iterable[int], weight: int = 1) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][symbol]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
                last = new
            self.count[last] += weight

    def finish(self) -> SuffixAutomaton:
        """Sums the counts up along the suffix links; call once, after the last ``add``."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        return self

    def statistics(self, sequence: Sequence[int], cap: int) -> Iterator[tuple[int, int]]:
        """Per position, the longest match ending there (at most ``cap``) and its weighted occurrences."""
        state = matched = 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            while state and self.length[self.link[state]] >= cap:
                state = self.link[state]
            matched = min(matched, self.length[state], cap) if self.length[self.link[state]] < cap else cap
            yield matched, self.count[state] if state else 0
