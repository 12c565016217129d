"""Tries of word codes in two arrays, which numpy walks from all positions of a text at once.

A phrase is a row of positive codes, padded with zeros. State 0 is the root; the child of state s by code c is
``base[s] + c``, if ``check`` of that place is s. ``accept`` has the phrase that ends in a state, else -1.
"""

from __future__ import annotations

import numpy as np

#: So many places are looked at (tried bases times children) before the children of a state go behind all others.
LOOKS = 1 << 12


class DoubleArray:
    def __init__(self, phrases: np.ndarray):
        """``phrases``: distinct rows of codes, of any order; a row's number is what its state accepts."""
        phrases = np.asarray(phrases, np.int64)
        # Codes are numbered anew, those with the most places in phrases first, so that families of children lie close.
        used, counts = np.unique(phrases[phrases > 0], return_counts=True)
        self.rank = np.zeros(int(phrases.max(initial=0)) + 1, np.int32)
        self.rank[used[np.argsort(-counts, kind="stable")]] = np.arange(1, len(used) + 1)
        phrases = self.rank[phrases].astype(np.int64)
        top = len(used) + 1
        self.base = np.zeros(top, np.int32)
        self.check = np.full(top, -1, np.int32)
        self.accept = np.full(top, -1, np.int32)
        self.check[0] = 0  # the root's own place is taken
        self.end = top
        random = np.random.default_rng(len(phrases))
        order = np.lexsort(phrases.T[::-1])
        state = np.zeros(len(phrases), np.int64)
        for depth in range(phrases.shape[1]):
            code = phrases[:, depth]
            alive = order[code[order] > 0]
            # The prefixes of one more word, each once: sorted rows of the same parent and code stand together.
            parent, word = state[alive], code[alive]
            first = np.concatenate([[True], (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])]) if len(alive) else np.zeros(0, bool)
            heads, words = parent[first], word[first]
            if not len(heads):
                break
            places = words.copy() if depth == 0 else self._place(heads, words, random)
            self.check[places] = heads
            state[alive] = places[np.cumsum(first) - 1]
            following = phrases[alive, depth + 1] if depth + 1 < phrases.shape[1] else np.zeros(len(alive), np.int64)
            last = alive[following == 0]
            self.accept[state[last]] = last
        self.base, self.check, self.accept = (x[: self.end].copy() for x in (self.base, self.check, self.accept))

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) + len(self.check) // 2) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
            self.accept = np.concatenate([self.accept, np.full(more, -1, np.int32)])
        self.end = max(self.end, size)

    def _place(self, heads: np.ndarray, words: np.ndarray, random: np.random.Generator) -> np.ndarray:
        """Free places for the children of each head (these stand together), the largest families first."""
        edges = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]]))
        sizes = np.diff(edges)
        places = np.zeros(len(heads), np.int64)
        for i in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            own = words[edges[i] : edges[i + 1]]
            low, high = -int(own[0]) + 1, self.end - int(own[-1])
            base = self.end - int(own[0])
            if high > low:
                tried = random.integers(low, high, max(64, LOOKS // len(own)))
                free = np.flatnonzero((self.check[tried[:, None] + own] < 0).all(1))
                base = int(tried[free[0]]) if len(free) else base
            self._grow(base + int(own[-1]) + 1)
            places[edges[i] : edges[i + 1]] = base + own
            self.base[heads[edges[i]]] = base
            self.check[base + own] = heads[edges[i]]
        single = edges[:-1][sizes == 1]
        free = np.flatnonzero(self.check[: self.end] < 0)[: len(single)]
        if len(free) < len(single):
            start = self.end
            self._grow(start + len(single) - len(free))
            free = np.concatenate([free, np.arange(start, self.end)])
        places[single] = free
        self.base[heads[single]] = free - words[single]
        return places

    def walk(self, codes: np.ndarray, depth: int):
        """For each level up to ``depth``: the positions that are still in the trie, and what their states accept.

        ``codes`` are those of a text, 0 where no phrase may pass.
        """
        known = (codes > 0) & (codes < len(self.rank))
        codes = np.where(known, self.rank[np.where(known, codes, 0)], 0)
        at = np.flatnonzero(codes)
        state = codes[at]
        inside = self.check[state] == 0
        at, state = at[inside], state[inside]
        yield at, self.accept[state]
        for level in range(1, depth):
            inside = at + level < len(codes)
            at, state = at[inside], state[inside]
            code = codes[at + level]
            to = self.base[state] + code
            inside = (code > 0) & (to > 0) & (to < len(self.check))
            inside[inside] = self.check[to[inside]] == state[inside]
            at, state = at[inside], to[inside]
            yield at, self.accept[state]
