"""Aho-Corasick automaton over UTF-8 bytes, run over whole columns of texts in numpy.

A term is a maximal run of ASCII letters and digits and of bytes from 0x80 up
(on UTF-8 text: every character from U+0080 up), A-Z lower cased. Patterns are
terms between two guards, and every other byte is a guard, so a pattern ends
exactly where a whole term ends; the closing guard opens the next pattern.

The texts stand behind each other, a guard between them, and are cut into lanes
that advance together, one byte at a time. A lane starts where the automaton
is known to be at its root: at a guard, or after more bytes of one term than any
pattern has. So one long text, or one long unbroken word, is spread over lanes
like any others.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np

LANES = 4096
BLOCK = 4 << 20  #: bytes that go through the lanes at once
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


class Automaton:
    def __init__(self, terms: list[bytes]):
        """``terms``: distinct, lower-cased; outputs are their positions in the list."""
        used = sorted({b for t in terms for b in t})
        self.classes = np.zeros(256, np.uint8)  # 0: guard, 1: bytes of no pattern
        self.classes[_INSIDE] = 1
        for c, b in enumerate(used):
            self.classes[b] = c + 2
        self.classes[0x41:0x5B] = self.classes[0x61:0x7B]
        width = len(used) + 2
        children: list[dict[int, int]] = [{0: 1}, {}]  # the root, and an opening guard
        ends: dict[int, int] = {}
        for k, term in enumerate(terms):
            at = 1
            for c in [*self.classes[np.frombuffer(term, np.uint8)].tolist(), 0]:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                at = children[at][c]
            ends[at] = k
        step = np.zeros((len(children), width), np.int32)
        fail = [0] * len(children)
        queue = deque([0])
        while queue:
            s = queue.popleft()
            if s:
                step[s] = step[fail[s]]
            for c, t in children[s].items():
                fail[t] = int(step[fail[s], c]) if s else 0
                step[s, c] = t
                queue.append(t)
        # states that put out a term come last, so that one comparison finds them
        plain = [s for s in range(len(children)) if s not in ends]
        order = np.array([*plain, *ends], np.int64)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.width, self.first = width, len(plain)
        self.step = np.ascontiguousarray(place[step[order]].ravel() * width)  # next state, times the width
        self.outputs = np.array(list(ends.values()), np.int64)
        self.depth = max((len(t) for t in terms), default=0) + 2

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of closing guards and the terms before them; ``codes`` (classes) starts and ends with a guard."""
        n = len(codes)
        guards = np.flatnonzero(codes == 0)
        want = np.unique(np.linspace(0, n, min(LANES, n // 64 + 1), endpoint=False).astype(np.int64))
        after = np.searchsorted(guards, want)
        cuts = np.minimum(guards[np.minimum(after, len(guards) - 1)], np.maximum(want, guards[np.maximum(after - 1, 0)] + self.depth))
        cuts[0] = 0
        cuts = np.unique(cuts)
        length = np.append(cuts[1:], n - 1) - cuts + 1  # the byte after a lane is read too: it may close a term
        order = np.argsort(-length, kind="stable")
        cuts, length = cuts[order], length[order]
        alive = np.searchsorted(-length, -np.arange(length[0]), "left")  # lanes longer than t
        state = np.zeros(len(cuts), np.int32)
        first, found_at, found = self.first * self.width, [], []
        for t in range(int(length[0])):
            m = alive[t]
            state = self.step[state[:m] + codes[cuts[:m] + t]]
            hit = np.flatnonzero(state >= first)
            if len(hit):
                found_at.append(cuts[hit] + t)
                found.append(state[hit])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), self.outputs[np.concatenate(found) // self.width - self.first]

    def counts(self, data: np.ndarray, off: np.ndarray):
        """For texts data[off[i]:off[i + 1]]: number of terms of each text, and (text, term, occurrences) arrays."""
        n = len(off) - 1
        at = off + np.arange(n + 1)  # a guard before every text and after the last one
        codes = np.zeros(len(data) + n + 1, np.uint8)
        body = np.ones(len(codes), bool)
        body[at] = False
        codes[body] = self.classes[data]
        del body
        total = np.zeros(n, np.int64)
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        terms = max(len(self.outputs), 1)
        first = 0
        while first < len(codes) - 1:
            last = self._cut(codes, first + BLOCK)
            part = codes[first:last + 1] if codes[first] == 0 else np.concatenate([[np.uint8(0)], np.full(self.depth, 1, np.uint8), codes[first:last + 1]])
            shift = first - (len(part) - (last + 1 - first))
            if part[-1]:
                part = np.append(part, np.uint8(0))
            inside = codes[first:last] != 0
            inside[1:] &= codes[first:last - 1] == 0
            if first and codes[first - 1]:
                inside[0] = False
            total += np.bincount(np.searchsorted(at, first + np.flatnonzero(inside), "right") - 1, minlength=n + 1)[:n]
            where, term = self.matches(part)
            key, count = np.unique((np.searchsorted(at, where + shift, "left") - 1) * terms + term, return_counts=True)
            keys.append(key)
            sums.append(count)
            first = last
        if len(keys) == 2:
            key, tf = keys[1], sums[1]
        else:  # a text may go on in the next block
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.bincount(back, weights=np.concatenate(sums), minlength=len(key)).astype(np.int64)
        return total, key // terms, key % terms, tf

    def _cut(self, codes: np.ndarray, want: int) -> int:
        """The first place from ``want`` on where the automaton is at its root; the last guard if there is none."""
        if want >= len(codes) - 1:
            return len(codes) - 1
        stretch = codes[max(0, want - self.depth):want + self.depth + 1]
        guards = np.flatnonzero(stretch == 0) + max(0, want - self.depth)
        later = guards[guards >= want]
        if len(later):
            return int(later[0])
        return int(guards[-1]) + self.depth if len(guards) else want
