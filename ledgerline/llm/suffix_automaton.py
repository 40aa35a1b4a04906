"""A suffix automaton over word sequences.

A text is streamed through it word by word; the matching statistic at a word is the length of the longest passage ending
there that the automaton holds. Where it reaches the window, the window's state knows where its words first start.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """All passages of (name, words), given in ascending order of name."""

    def __init__(self, docs: Iterable[tuple[object, list[str]]], window: int):
        self.window, self.next, self.link, self.len, self.first = window, [{}], [-1], [0], [-1]
        self.docs, self.starts = [], []
        last, at = 0, 0
        for doc, words in docs:
            self.docs.append(doc)
            self.starts.append(at)
            for w in words:
                last, at = self._extend(last, w, at), at + 1
            last, at = self._extend(last, (len(self.docs),), at), at + 1  # a mark that no text holds
        self.at = list(range(len(self.len)))  # the state of each state's last `window` words
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            if self.len[self.link[v]] >= window:
                self.at[v] = self.at[self.link[v]]

    def _extend(self, last: int, w, at: int) -> int:
        nxt, link, length, first = self.next, self.link, self.len, self.first
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(at)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p != -1 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def windows(self, words: list[str]) -> Iterator[tuple[int, object, int]]:
        """(place, name, place there) of each window of ``words`` that is held, with its first start."""
        nxt, link, length = self.next, self.link, self.len
        state = size = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state, size = nxt[state][w], size + 1
            if size >= self.window:
                place = self.first[self.at[state]] - self.window + 1
                k = bisect_right(self.starts, place) - 1
                yield i - self.window + 1, self.docs[k], place - self.starts[k]
