"""Suffix automaton over several word sequences, with occurrence counts."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Built sequence by sequence; ``counts[state]`` is the number of places (with weights) at which
    the state's strings end, once ``finish`` has run."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.counts = [-1], [0], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.counts.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c) -> int:
        """A copy of q for its strings that follow p, of which the others are no suffix."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: Sequence, weight: int = 1) -> None:
        last, nxt, link, length = 0, self.next, self.link, self.length
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
            else:
                new, p = self._state(length[last] + 1, {}, 0), last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = new
            self.counts[last] += weight

    def finish(self) -> SuffixAutomaton:
        """Passes the counts on to the suffixes, longest first."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.counts[self.link[s]] += self.counts[s]
        return self

    def matches(self, words: Sequence, width: int, least: int = 1) -> list[tuple[int, int]]:
        """Streams ``words`` for matching statistics and returns the maximal runs (first, last) of window
        starts whose ``width`` words occur here ``least`` times or more."""
        state = size = 0
        out: list[list[int]] = []
        for i, c in enumerate(words):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(c)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            while self.length[self.link[state]] >= width:       # the state of the last ``width`` words
                state = self.link[state]
                size = self.length[state]
            if size >= width and self.counts[state] >= least:
                start = i - width + 1
                if out and out[-1][1] == start - 1:
                    out[-1][1] = start
                else:
                    out.append([start, start])
        return [(a, b) for a, b in out]
